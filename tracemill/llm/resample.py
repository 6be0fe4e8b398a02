"""Importance resampling: a share of the documents is drawn so that its words are distributed like those of a target.

Features are runs of 1 to `most` words. Their strings are counted over all documents, task by task before the shuffle, into a
dictionary with a row a distinct string; each string is hashed once there, and the buckets of source and target are summed up from
it. A bucket's gain goes back to the strings of the dictionary, and from there to the counts of each document:

* strings that make up more than a `COMMON`-th of all features, at most COMMON of them by that, travel to all tasks, those of over
  `SHORT` bytes as their MD5;
* the other strings of a document, with their counts, are written down once and meet the dictionary in a join by string, of which none
  has more rows than that share.

Scores are gains plus Gumbel noise drawn by a hash of the id, so the highest scores are a draw without replacement. Their ranks
come from ranges of the order of scores.

A null or empty text has no features and weighs nothing; a null id hashes as an empty string and comes last of equal scores. Equal scores go to the
smaller id, repeated rows of an id in any order, each with a rank of its own. Texts are split window by window, so that a very
long one needs little memory. Empty documents or an empty target give gains all the same (counts are smoothed), no documents
give no rows. Columns besides id and text aren't looked at, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import prefix
from .runtime import map_batches, stash

COMMON, SHORT, WINDOW, FLUSH, HELD = 100_000, 31, 1 << 20, 300_000, 50_000
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def windows(text: bytes) -> Iterator[list[bytes]]:
    """The words, in lists of about WINDOW bytes of text."""
    text = text.translate(LETTERS)
    at = 0
    while len(text) - at > WINDOW and (end := text.find(b" ", at + WINDOW)) >= 0:
        yield text[at:end].split()
        at = end
    yield text[at:].split()


def features(text: bytes | None, most: int) -> Iterator[tuple[int, list[bytes]]]:
    """(words, features) for each window of the text; a feature lies in the window of its last word."""
    tail: list[bytes] = []
    for words in windows(text) if text else ():
        out = list(words)
        for n in range(2, most + 1):
            joined = tail[max(0, len(tail) - n + 1) :] + words
            out += [b" ".join(joined[k : k + n]) for k in range(len(joined) - n + 1)]
        tail = (tail + words)[1 - most :] if most > 1 else []
        yield len(words), out


def dictionary(docs: DataFrame, text_col: str, most: int, buckets: int) -> DataFrame:
    """(feature binary, n, bucket) of all texts: a row a distinct string, hashed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        counts: Counter = Counter()
        for b in batches:
            for text in b.column(0):
                for _, found in features(text.as_py(), most):
                    counts.update(found)
                    if len(counts) > FLUSH:
                        yield {"feature": list(counts), "n": list(counts.values())}
                        counts.clear()
        yield {"feature": list(counts), "n": list(counts.values())}

    counted = map_batches(docs.select(F.col(text_col).cast("binary")), run, "feature binary, n bigint")
    return counted.groupBy("feature").agg(F.sum("n").alias("n")).withColumn("bucket", F.crc32("feature") % buckets)


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) for every bucket, from dictionaries."""
    s, t = (d.groupBy("bucket").agg(F.sum("n").cast("double").alias(name)) for d, name in ((source, "s"), (target, "t")))
    both = source.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(F.broadcast(s), "bucket", "left").join(F.broadcast(t), "bucket", "left").na.fill(0.0)
    whole_s, whole_t = both.agg(F.sum("s"), F.sum("t")).first()
    ratio = (F.col("t") + 1) * F.lit(whole_s + buckets) / ((F.col("s") + 1) * F.lit(whole_t + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("bigint").alias("gain"))


def weights(docs: DataFrame, known: DataFrame, most: int, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight) for each row; known: (feature, n, gain) of every feature there is."""
    total = known.agg(F.sum("n")).first()[0] or 0
    common = F.col("n") * COMMON > total
    short = F.when(F.octet_length("feature") <= SHORT, F.col("feature")).otherwise(F.md5("feature").cast("binary"))
    shipped = docs.sparkSession.sparkContext.broadcast({bytes(r[0]): r[1] for r in known.where(common).select(short, "gain").collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        from pyspark import TaskContext

        row, gain = TaskContext.get().partitionId() << 40, shipped.value.get
        names = ["row", "doc_id", "n_words", "n_features", "weight", "rest"]
        for b in batches:
            out, held = [], 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                n_words = n_features = weight = 0
                rest: list = []
                counts: Counter = Counter()
                for n, found in features(text.as_py(), most):
                    n_words, n_features = n_words + n, n_features + len(found)
                    counts.update(found)
                    if len(counts) > FLUSH:
                        weight += _met(counts, gain, rest)
                        counts.clear()
                weight += _met(counts, gain, rest)
                out.append((row, doc, n_words, n_features, weight, rest))
                row, held = row + 1, held + len(rest)
                if held > HELD:
                    yield dict(zip(names, zip(*out), strict=True))
                    out, held = [], 0
            if out:
                yield dict(zip(names, zip(*out), strict=True))

    here = map_batches(docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("binary")), run, "row bigint, doc_id bigint, n_words bigint, n_features bigint, weight bigint, rest array<struct<feature:binary,c:bigint>>")
    here = stash(here, "features")  # rows are numbered here, once
    rest = here.select("row", F.inline("rest")).join(known.where(~common).select("feature", "gain"), "feature").groupBy("row").agg(F.sum(F.col("c") * F.col("gain")).alias("more"))
    return here.drop("rest").join(rest, "row", "left").withColumn("weight", F.col("weight") + F.coalesce("more", F.lit(0))).drop("more")


def _met(counts: Counter, gain, rest: list) -> int:
    """The weight of the features with a known gain; the others go to rest."""
    weight = 0
    for f, c in counts.items():
        g = gain(f if len(f) <= SHORT else hashlib.md5(f).hexdigest().encode())
        if g is None:
            rest.append({"feature": f, "c": c})
        else:
            weight += c * g
    return weight


def noise(seed: int, doc_id: Column) -> Column:
    """Gumbel noise in thousandths, from the first eight hex digits of the hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, most: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank), all long: rank for the drawn documents, which are `percent` of those with at least
    `least_words` words. buckets: bounded, since their gains travel to all tasks."""
    if buckets > 1_000_000:
        raise ValueError("too many buckets")
    source = stash(dictionary(docs, text_col, most, buckets), "dictionary")
    gain = gains(source, dictionary(target, text_col, most, buckets), buckets)
    known = stash(source.join(F.broadcast(gain), "bucket"), "gains")
    rows = weights(docs, known, most, id_col, text_col).withColumn("score", F.col("weight") + noise(seed, F.col("doc_id")))
    rows = stash(rows.withColumns({"out": (F.col("n_words") < least_words).cast("int"), "nameless": F.col("doc_id").isNull()}), "scores")
    n_drawn = rows.agg(F.count_if(F.col("out") == 0)).first()[0] * percent // 100
    ranked = prefix.running(rows, ["out", "score desc", "nameless", "doc_id", "row"], {"rank": F.lit(1)})
    rank = F.when((F.col("out") == 0) & (F.col("rank") <= n_drawn), F.col("rank").cast("bigint"))
    return ranked.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
