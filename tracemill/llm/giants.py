"""Texts that are too long for one task: cut once a distinct text, dealt to all tasks, summed up again a text.

A text is named by its SHA-256, so its copies are worked on once, whatever rows hold it. What was found for a text meets the
rows by that name; the partition a row was read in salts the join, since copies of one text may be a large share of the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 32


def free(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def split(docs: DataFrame, text_col: str, most_bytes: int, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose text has at most `most_bytes` bytes or is null, the others with the name of their text in `key`)."""
    long = F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)) > most_bytes
    return docs.where(~long), docs.where(long).withColumn(key, F.sha2(F.col(f"`{text_col}`").cast("binary"), 256))


def distinct_texts(rows: DataFrame, text_col: str, key: str) -> DataFrame:
    """(key, text) for each distinct text; tasks keep one copy each before the shuffle."""
    return rows.groupBy(F.col(key).alias("key")).agg(F.first(F.col(f"`{text_col}`").cast("binary")).alias("text"))


def dealt(texts: DataFrame, cut: Callable[[Column], Column]) -> DataFrame:
    """(key, part, bytes): the pieces that `cut` makes of each text, in an array of binaries, dealt evenly."""
    return texts.select("key", F.posexplode(cut(F.col("text"))).alias("part", "bytes")).repartition("key", "part")


def attach(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """rows without `key`, and with the columns of `found` (a row a key) beside them."""
    salt = free(rows, "_salt")
    there = found.withColumnRenamed("key", key).withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn(salt, F.spark_partition_id() % SALTS).join(there, [key, salt], "left").drop(key, salt)
