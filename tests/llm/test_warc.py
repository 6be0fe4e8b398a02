import base64
import hashlib
import io
import zlib

import pytest

from tracemill.llm import warc


def rows():
    out = [(i, f"http://x/{i} y", f"<p>page {i % 7}é</p>" * (i % 5 + 1), "t") for i in range(60)]
    return out + [(100, None, None, "t"), (101, "u", "", "t"), (102, "u", "WARC/1.1\r\n\r\n" * 50, "t"), (103, "u", "big " * 100_000, "t"), (7, "again", out[7][2], "t"), (None, "n", out[3][2], "t"), (None, "n", "only null", "t")]


def expected(data):
    best = {}
    for i, _, h, _ in data:
        p = (h or "").encode()
        best[p] = max((x for x in (i, best.get(p)) if x is not None), default=None)
    out = []
    for i, _, h, _ in data:
        p = (h or "").encode()
        first = i == best[p]
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if first else "revisit", None if first else best[p]))
    return sorted(out, key=str)


def test_round_trip(spark):
    pages = spark.createDataFrame(rows(), "page_id bigint, url string, html string, payload string").repartition(4)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()]
    assert sorted(got, key=str) == expected(rows())
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_small_payloads_are_all_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id bigint, url string, html string")
    files = warc.write(pages, f"file://{tmp_path}/w", min_bytes=3, file_bytes=1)
    listed = spark.createDataFrame(files.collect(), files.schema)
    got = {r.page_id: (r.record_type, bytes(r.payload)) for r in warc.read(listed, f"file://{tmp_path}/w").collect()}
    assert got == {1: ("response", b"ab"), 2: ("response", b"ab"), 3: ("revisit", b""), 4: ("response", b"abcd")}


def archive(n=8, gz=True):
    recs = [warc.record("response", f"http://x/{i}", {"WARC-Record-ID": f"<urn:page:{i}>", "WARC-Payload-Digest": "sha1:" + warc.sha1(b"p%d" % i * 9000)}, b"p%d" % i * 9000) for i in range(n)]
    return [warc.member(r) if gz else r for r in recs]


def read_all(data):
    log = warc.Salvaged()
    got = [(at, p) for at, _, p in warc.salvage(io.BytesIO(data), log)]
    return got, log.gaps


@pytest.mark.parametrize("gz", [True, False])
def test_salvage_skips_what_is_damaged(gz):
    parts = archive(gz=gz)
    starts = [sum(map(len, parts[:i])) for i in range(9)]
    got, gaps = read_all(b"".join(parts))
    assert [p for _, p in got] == [b"p%d" % i * 9000 for i in range(8)] and not gaps
    bad = bytearray(b"".join(parts))
    bad[starts[2] + len(parts[2]) // 2] ^= 255  # in a member
    bad[starts[5]] ^= 255  # a member's first byte
    got, gaps = read_all(bytes(bad))
    assert [p for _, p in got] == [b"p%d" % i * 9000 for i in (0, 1, 3, 4, 6, 7)]
    assert [(a, b) for a, b, _ in gaps] == [(starts[2], starts[3]), (starts[5], starts[6])]
    cut = bytes(bad[: starts[7] + 30])
    got, gaps = read_all(b"junk" + cut)
    assert [p for _, p in got] == [b"p%d" % i * 9000 for i in (0, 1, 3, 4, 6)]
    assert gaps[0][:2] == (0, 4) and gaps[-1][:2] == (starts[7] + 4, starts[7] + 34)


def test_false_starts_in_gaps_are_passed_over():
    parts = archive(3)
    noise = warc.MAGIC + b"\0" * 5 + b"WARC/1.0\r\n" + zlib.compress(b"x") + warc.member(b"not a record")
    got, gaps = read_all(parts[0] + noise + parts[1] + parts[2][:-9] + parts[0])
    assert [p for _, p in got] == [b"p0" * 9000, b"p1" * 9000, b"p2" * 9000, b"p0" * 9000] and len(gaps) == 2  # of the cut member the record is whole
    got, gaps = read_all(parts[0] + noise + parts[1] + parts[2][: len(parts[2]) // 2] + parts[0])
    assert [p for _, p in got] == [b"p0" * 9000, b"p1" * 9000, b"p0" * 9000] and len(gaps) == 2
    assert read_all(b"") == ([], [])
    assert read_all(b"abc") == ([], [(0, 3, "neither a member nor a version line")])


def test_records_around_a_fault_in_a_member_are_kept():
    plain_ = archive(5, gz=False)
    whole, at = b"".join(plain_), sum(map(len, plain_[:2]))
    damaged = bytearray(whole)
    damaged[at + len(plain_[2]) // 2] ^= 255
    got, gaps = read_all(warc.member(bytes(damaged)) + archive(1)[0])  # a record fails, the member doesn't
    assert [p for _, p in got] == [b"p%d" % i * 9000 for i in (0, 1, 3, 4, 0)]
    assert len(gaps) == 1 and f"bytes {at} to {at + len(plain_[2])} of the member" in gaps[0][2]
    packed = warc.member(whole)
    broken = bytearray(packed)
    broken[-5] ^= 255  # the member's length, at its end
    got, gaps = read_all(bytes(broken) + archive(1)[0])
    assert [p for _, p in got] == [b"p%d" % i * 9000 for i in (0, 1, 2, 3, 4, 0)] and gaps[0][:2] == (0, len(packed)) and "after 5 records" in gaps[0][2]
    import random

    noise = random.Random(1).randbytes(60_000)
    parts = [warc.record("response", "u", {"WARC-Payload-Digest": "sha1:" + warc.sha1(noise[i:])}, noise[i:]) for i in range(4)]
    broken = bytearray(warc.member(b"".join(parts)))
    del broken[150_000:]
    got, gaps = read_all(bytes(broken) + archive(2)[1])
    assert [p for _, p in got] == [noise, noise[1:], b"p1" * 9000] and gaps[0][:2] == (0, len(broken))


def test_records_without_a_digest_wait_for_the_checksum():
    bare = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert read_all(warc.member(bare * 2)) == ([(0, b"abc"), (0, b"abc")], [])
    broken = bytearray(warc.member(bare * 2))
    broken[-6] ^= 255
    assert [p for _, p in read_all(bytes(broken) + archive(1)[0])[0]] == [b"p0" * 9000]
    assert read_all(bare * 2) == ([(0, b"abc"), (len(bare), b"abc")], [])


def test_records_carry_a_date():
    _, head, _ = next(warc.salvage(io.BytesIO(warc.member(warc.record("response", "u", {}, b"x", "2024-05-06T07:08:09Z"))), warc.Salvaged()))
    assert head["warc-date"] == "2024-05-06T07:08:09Z"


def test_a_damaged_archive_is_an_error_of_the_round_trip(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(archive(2)[0][:-9])
    files = spark.createDataFrame([(f"{tmp_path}/a.warc.gz",)], "path string")
    assert [r.gap_reason is not None for r in warc.read(files, f"file://{tmp_path}").collect()] == [False, True]
    with pytest.raises(Exception, match="is damaged"):
        warc.read(files, f"file://{tmp_path}", whole=True).collect()
