"""WARC archives: a writer with revisit records, and a salvage reader.

The writer puts one gzip member per record into files of bounded size in a shared folder; each file gets its name only
when it is whole, from its task and number, so that a task that runs twice writes the same names. Of pages with equal
payloads the largest id is the response, the others are revisits that refer to it. Digests alone are counted: those of more than a
ten-thousandth of all rows, at most 10,000, meet their pages by broadcast; pages whose digest occurs once, as a bitmap of the others
tells, are written where they are read; only the rest travels, to tasks by digest.

The reader walks the members of a file, and the records in a member, as streams. Where a check fails (gzip frame and CRC, version
line, lengths, block and payload digest) it searches for the next version line, in a member's content as in a plain file, or for the
next member that opens with one; it goes on there, and logs the gap it left. Records before and after a gap in a member are kept;
those without a digest wait for the member's CRC. It holds one record at a time, and headers of at most 1 MB.

A null payload is empty. Repeated ids with equal payloads are responses all, if they are the largest. Null ids are never referred to
while another id is there. An empty table writes no file and reads no record. Long payloads are one record each. Other columns
are ignored, so their names can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmap
from .runtime import map_batches, new_path, stash

VERSION = b"WARC/1.1"
VERSIONS = (b"WARC/1.",)
MAGIC = b"\x1f\x8b\x08"
STARTS = (MAGIC, *VERSIONS)
CHUNK, PROBE, MOST_HEAD = 1 << 18, 1 << 14, 1 << 20


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") else "file://" + uri)


def record(kind: str, uri: str, headers: dict[str, str], payload: bytes, date: str = "1970-01-01T00:00:00Z") -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    head = {"WARC-Type": kind, "WARC-Date": date, "WARC-Target-URI": "".join(uri.split()), **headers, "WARC-Block-Digest": "sha1:" + sha1(block), "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode()
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


@dataclass
class Salvaged:
    """What a file gave: records as (offset, headers, payload), and gaps as (start, end, reason)."""

    gaps: list[tuple[int, int, str]] = field(default_factory=list)


class Failed(Exception):
    pass


def parse_head(data: bytes) -> dict[str, str]:
    """Headers of the record whose head (to its empty line) is data; Failed if a check fails."""
    if not data.startswith(VERSIONS):
        raise Failed("no version line")
    head = {}
    for line in data.split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            raise Failed("bad header line")
        head[k.decode("utf-8", "replace").strip().lower()] = v.decode("utf-8", "replace").strip()
    size = head.get("content-length", "")
    if not size.isascii() or not size.isdigit():
        raise Failed("no length")
    return head


def payload_of(head: dict[str, str], block: bytes) -> bytes:
    if "warc-block-digest" in head and head["warc-block-digest"] != "sha1:" + sha1(block):
        raise Failed("block digest differs")
    payload = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
    if head.get("warc-type") == "response" and "warc-payload-digest" in head and head["warc-payload-digest"] != "sha1:" + sha1(payload):
        raise Failed("payload digest differs")
    return payload


class Window:
    """Bytes of a stream from an absolute position on, read as needed and dropped when passed."""

    def __init__(self, source: io.RawIOBase):
        self.source, self.start, self.data, self.done = source, 0, bytearray(), False

    def need(self, end: int) -> bool:
        """True if bytes up to `end` (absolute) are there."""
        while not self.done and self.start + len(self.data) < end:
            got = self.source.read(CHUNK)
            self.done = not got
            self.data += got
        return self.start + len(self.data) >= end

    def drop(self, to: int) -> None:
        del self.data[: to - self.start]
        self.start = to

    def seek(self, to: int) -> None:
        self.source.seek(to)
        self.start, self.data, self.done = to, bytearray(), False

    def find(self, what: tuple[bytes, ...], at: int) -> int:
        """Absolute position of the first of `what` from `at` on, -1 at the end."""
        reach = max(map(len, what)) - 1
        while True:
            self.need(at + CHUNK)
            hits = [h for w in what if (h := self.data.find(w, at - self.start)) >= 0]
            if hits:
                return self.start + min(hits)
            if self.done:
                return -1
            at = max(at, self.start + len(self.data) - reach)
            self.drop(at)


class Inflated:
    """The content of the gzip member at `at` of a window, as a stream; at a failure it ends, and says why."""

    def __init__(self, w: Window, at: int):
        self.w, self.pos, self.d, self.why = w, at, zlib.decompressobj(31), ""

    def read(self, size: int) -> bytes:
        out = b""
        while not out and not self.d.eof and not self.why:
            left = self.d.unconsumed_tail
            if not left:
                if not self.w.need(self.pos + 1):
                    self.why = "member is cut short"
                    break
                self.w.drop(self.pos)
                left = bytes(self.w.data[:CHUNK])
                self.pos += len(left)
            before = self.d.copy()
            try:
                out = self.d.decompress(left, size)
            except zlib.error as e:
                self.why, out = f"gzip: {e}", as_far_as_it_goes(before, left)
            self.pos -= len(self.d.unused_data) if self.d.eof else 0
        return out


def as_far_as_it_goes(d, data: bytes) -> bytes:
    """What precedes a failure."""
    out = []
    try:
        for k in range(len(data)):
            out.append(d.decompress(data[k : k + 1]))
    except zlib.error:
        pass
    return b"".join(out)


def one_record(w: Window, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and end of the record at `at`; Failed if a check fails."""
    cut, size = -1, 1 << 12
    while cut < 0:
        more = w.need(at + size)
        cut = w.data.find(b"\r\n\r\n", at - w.start, at - w.start + size)
        if cut < 0 and (not more or size >= MOST_HEAD):
            raise Failed("headers don't end")
        size *= 4
    begin = cut + 4 + w.start
    head = parse_head(bytes(w.data[at - w.start : cut]))
    end = begin + int(head["content-length"])
    if not w.need(end + 4) or w.data[end - w.start : end + 4 - w.start] != b"\r\n\r\n":
        raise Failed("block is cut short")
    return head, payload_of(head, bytes(memoryview(w.data)[begin - w.start : end - w.start])), end + 4


def records(w: Window, gaps: list[tuple[int, int, str]]) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Records of uncompressed data, from its start on."""
    at, bad, why = w.start, -1, ""
    while w.need(at + 1):
        try:
            head, payload, end = one_record(w, at)
        except Failed as e:
            if bad < 0:
                bad, why = at, str(e)
            at = w.find(VERSIONS, at + 1)
            if at < 0:
                break
            continue
        if bad >= 0:
            gaps.append((bad, at, why))
            bad = -1
        yield at, head, payload
        at = end
        w.drop(at)
    if bad >= 0:
        gaps.append((bad, w.start + len(w.data), why))


def opens(w: Window, at: int) -> str:
    """Why no member or record starts at `at`; "" if one does."""
    w.need(at + 7)
    here = w.data[at - w.start : at - w.start + 7]
    if here.startswith(VERSIONS):
        return ""
    if not here.startswith(MAGIC):
        return "neither a member nor a version line"
    w.need(at + PROBE)
    d = zlib.decompressobj(31)
    try:
        content = d.decompress(w.data[at - w.start : at - w.start + PROBE], 7)
    except zlib.error as e:
        return f"gzip: {e}"
    return "" if content.startswith(VERSIONS) else "no version line"


def salvage(source: io.RawIOBase, log: Salvaged) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Records of a file; what lies between them goes to the log. A record in a member has the member's offset."""
    w, at, bad, why = Window(source), 0, -1, ""
    while w.need(at + 1):
        fault = opens(w, at)
        if not fault and w.data[at - w.start : at - w.start + 7].startswith(VERSIONS):
            try:
                head, payload, end = one_record(w, at)
                found: Iterator = iter([(at, head, payload)])
            except Failed as e:
                fault = str(e)
        elif not fault:
            if bad >= 0:
                log.gaps.append((bad, at, why))
                bad = -1
            inside, wait, n = Inflated(w, at), [], 0
            for n, (_, head, payload) in enumerate(records(Window(inside), inner := []), 1):
                if "warc-block-digest" in head or "warc-payload-digest" in head:
                    yield at, head, payload
                else:
                    wait.append((at, head, payload))
            while inside.read(CHUNK):
                pass
            if inside.why:
                bad, why = at, f"{inside.why}, after {n} records"
                w.seek(at + 1)
                at = w.find(STARTS, at + 1)
                if at < 0:
                    break
                continue
            log.gaps += [(at, inside.pos, f"{reason}, bytes {a} to {b} of the member") for a, b, reason in inner]
            yield from wait
            at = inside.pos
            w.drop(at)
            continue
        if fault:
            if bad < 0:
                bad, why = at, fault
            at = w.find(STARTS, at + 1)
            if at < 0:
                break
            continue
        if bad >= 0:
            log.gaps.append((bad, at, why))
            bad = -1
        yield from found
        at = end
        w.drop(at)
    if bad >= 0:
        log.gaps.append((bad, w.start + len(w.data), why))


def write(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = 64 << 20, date: str | None = None) -> DataFrame:
    """Writes page_id, url, html as records; returns path, records and bytes of each file. Lazy: files come as rows are taken."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("key", F.when(F.length("payload") >= min_bytes, F.xxhash64("digest")))
    counts = rows.where("key is not null").groupBy("digest", "key").agg(F.max("page_id").alias("owner"), F.count("*").alias("n"))
    twice = stash(counts.where("n > 1"), "digests")
    copies = twice.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") > copies / 10_000  # true of 10,000 digests at most
    rest = twice.where(~often)
    shared = pages.sparkSession.sparkContext.broadcast(bitmap.build(rest, "key"))
    near = rows.join(F.broadcast(twice.where(often).select("digest", "owner", F.lit(True).alias("often"))), "digest", "left")
    near = near.select("page_id", "url", "payload", "owner", "digest", F.when(F.col("often").isNull(), F.col("key")).alias("key"))

    def chosen(b: pa.RecordBatch, travels: bool) -> pa.RecordBatch:
        """Rows whose digest may occur again among those of `rest`, or the others."""
        key = b.column(5)
        may = bitmap.holds(shared.value, key.fill_null(0).to_numpy(zero_copy_only=False)) & key.is_valid().to_numpy(zero_copy_only=False)
        return b.filter(pa.array(may == travels))

    def travelling(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for b in batches:
            b = chosen(b, True)
            yield {k: b.column(n) for n, k in enumerate(("page_id", "url", "payload", "owner", "digest"))}

    far = map_batches(near, travelling, "page_id bigint, url string, payload binary, owner bigint, digest binary").drop("owner").join(rest.select("digest", "owner"), "digest", "left")
    far = far.select("page_id", "url", "payload", "owner", "digest", F.lit(None).cast("bigint").alias("key"))
    schema = "path string, records bigint, bytes bigint"
    here = map_batches(near, writer(folder, file_bytes, date, "near", lambda b: chosen(b, False)), schema)
    return here.unionByName(map_batches(far, writer(folder, file_bytes, date, "far", lambda b: b), schema))


def writer(folder: str, file_bytes: int, date: str, name: str, chosen: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable:
    """Batches of page_id, url, payload, owner, digest to files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        from pyspark import TaskContext

        store, base = filesystem(folder)
        task, number, held, total = TaskContext.get(), 0, [], 0

        def close() -> dict[str, list]:
            nonlocal number, held, total
            path = f"{base}/{name}-{task.partitionId():06d}-{number:06d}.warc.gz"
            store.create_dir(base, recursive=True)
            with store.open_output_stream(f"{path}.{task.taskAttemptId()}", compression=None) as f:
                for x in held:
                    f.write(x)
            store.move(f"{path}.{task.taskAttemptId()}", path)
            row = {"path": [path], "records": [len(held)], "bytes": [total]}
            number, held, total = number + 1, [], 0
            return row

        for b in map(chosen, batches):
            for page, url, payload, owner, digest in zip(*(b.column(k) for k in range(5)), strict=True):
                page, owner, payload = page.as_py(), owner.as_py(), payload.as_py()
                revisit = owner is not None and (page is None or page < owner)
                head = {"WARC-Record-ID": f"<urn:page:{'null' if page is None else page}>", "WARC-Payload-Digest": "sha1:" + base64.b32encode(digest.as_py()).decode(), "X-Payload-Length": str(len(payload))}
                if revisit:
                    head |= {"WARC-Refers-To": f"<urn:page:{owner}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                data = member(record("revisit" if revisit else "response", url.as_py() or "", head, b"" if revisit else payload, date))
                held.append(data)
                total += len(data)
                if total >= file_bytes:
                    yield close()
        if held:
            yield close()

    return run


RECORDS = "path string, offset bigint, gap_end bigint, gap_reason string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def read(files: DataFrame, folder: str, payloads: bool = True, whole: bool = False) -> DataFrame:
    """files: path. A row per record, and a row with gap_reason per quarantined gap; with `whole` a gap is an error."""

    def number(head: dict[str, str], key: str) -> int | None:
        x = head.get(key, "").removeprefix("<urn:page:").removesuffix(">")
        return int(x) if x.lstrip("-").isdigit() else None

    names = [x.split()[0] for x in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        store, _ = filesystem(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                log, rows, held = Salvaged(), [], 0
                with store.open_input_file(path) as f:
                    for at, head, payload in salvage(f, log):
                        kind = head.get("warc-type")
                        size = len(payload) if kind == "response" else int(head.get("x-payload-length", "0"))
                        digest = sha1(payload) if kind == "response" else head.get("warc-payload-digest", "").removeprefix("sha1:")
                        rows.append((path, at, None, None, number(head, "warc-record-id"), size, digest, kind, number(head, "warc-refers-to"), payload if payloads else None))
                        held += len(payload) if payloads else 200
                        if held > 8 << 20:
                            yield dict(zip(names, zip(*rows, strict=True), strict=True))
                            rows, held = [], 0
                if whole and log.gaps:
                    raise ValueError(f"{path} is damaged: {log.gaps[:3]}")
                rows += [(path, a, e, why, *[None] * 6) for a, e, why in log.gaps]
                if rows:
                    yield dict(zip(names, zip(*rows, strict=True), strict=True))

    return map_batches(files.select("path"), run, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to a new shared folder, then read every archive back."""
    folder = new_path(pages.sparkSession, "warc")
    listed = new_path(pages.sparkSession, "warc-files")
    write(pages, folder).write.parquet(listed)
    files = pages.sparkSession.read.schema("path string, records bigint, bytes bigint").parquet(listed)
    width = max(1, files.count())
    return read(files.repartitionByRange(width, "path"), folder, payloads=False, whole=True)
