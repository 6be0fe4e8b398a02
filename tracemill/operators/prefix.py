"""Running sums and row numbers over whole tables, without bringing the table into one task.

Bounds of ranges of the order come from a sample; they balance the ranges and don't touch the result. Each range is summed up, the
sums of the ranges before it come back to it (a row a range and group), and a window within the range does the rest. So the rows are
shuffled once. The table is read three times and must be the same each time: what isn't read from files is written down first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_RANGES, PER_RANGE = 1024, 60


def _order(spec: list[str]) -> list[tuple[str, bool]]:
    """'name' or 'name desc'; nulls first when ascending, last when descending."""
    return [(s.removesuffix(" desc"), not s.endswith(" desc")) for s in spec]


def _at_or_after(order: list[tuple[str, bool]], bound: tuple) -> Column:
    if not order:
        return F.lit(True)
    (name, up), value = order[0], bound[0]
    c = F.col(f"`{name}`")
    if value is None:
        after = c.isNotNull() if up else F.lit(False)
    else:
        after = F.coalesce(c > F.lit(value), F.lit(False)) if up else c.isNull() | (c < F.lit(value))
    return after | (c.eqNullSafe(F.lit(value)) & _at_or_after(order[1:], bound[1:]))


def range_of(df: DataFrame, order: list[str], ranges: int) -> Column:
    """The number of the range, of at most `ranges`, that a row lies in."""
    keys, n = _order(order), df.count()
    if ranges < 2 or n < 2:
        return F.lit(0)
    sample = df.select(*(f"`{c}`" for c, _ in keys)).sample(min(1.0, ranges * PER_RANGE / n), seed=1)
    rows = [tuple(r) for r in sample.orderBy(*(F.col(f"`{c}`").asc() if up else F.col(f"`{c}`").desc() for c, up in keys)).limit(4 * ranges * PER_RANGE).collect()]
    bounds = list(dict.fromkeys(rows[k * len(rows) // ranges] for k in range(1, ranges) if rows))

    def choose(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(_at_or_after(keys, bounds[mid]), choose(mid + 1, hi)).otherwise(choose(lo, mid))

    return choose(0, len(bounds))


def running(df: DataFrame, order: list[str], sums: dict[str, Column], by: list[str] = (), ranges: int | None = None) -> DataFrame:
    """df with, for each name in `sums`, the sum of its Column over the rows of the same `by` up to and with this one, in `order`
    ('name' or 'name desc'). F.lit(1) numbers rows. Nulls count as nothing. Rows that tie in by and order follow each other in any order, in one
    task; add a unique column to the order to avoid both. Columns named like a sum give way."""
    by, names = list(by), list(sums)
    df = df.drop(*(c for c in df.columns if c in names and c not in {*by, *(k for k, _ in _order(order))}))
    part, before = "_range", {n: f"_before_{n}" for n in names}
    if clash := {part, *before.values(), *(f"_own_{n}" for n in names)} & set(df.columns):
        raise ValueError(f"columns in the way: {sorted(clash)}")
    n = ranges or min(MOST_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = {n: F.coalesce(c, F.lit(0)).alias(f"_own_{n}") for n, c in sums.items()}
    rows = df.withColumn(part, range_of(df, [*by, *order], n)).select("*", *own.values())
    totals = rows.groupBy(*by, part).agg(*(F.sum(f"_own_{n}").alias(f"_own_{n}") for n in names))
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col(part).alias("_of"), *(F.coalesce(F.sum(f"_own_{n}").over(earlier), F.lit(0)).alias(before[n]) for n in names))
    same = F.col(part) == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    met = rows.join(offsets if by else F.broadcast(offsets), same, "left").drop("_of", *(f"_by_{c}" for c in by))
    within = Window.partitionBy(part, *by).orderBy(*(F.col(f"`{c}`").asc() if up else F.col(f"`{c}`").desc() for c, up in _order(order))).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return met.withColumns({n: F.col(before[n]) + F.sum(f"_own_{n}").over(within) for n in names}).drop(part, *before.values(), *(f"_own_{n}" for n in names))


def rolled(df: DataFrame, order: list[str], size: Column, most: int, by: list[str] = (), ranges: int | None = None) -> DataFrame:
    """df with running_bytes and file_no (from 1): a new file begins with the first row before which `most` more bytes have passed."""
    out = running(df.withColumn("_size", F.coalesce(size, F.lit(0)).cast("bigint")), order, {"running_bytes": F.col("_size")}, by, ranges)
    return out.withColumn("file_no", F.expr(f"(running_bytes - _size) div {int(most)} + 1")).drop("_size")


def within_budget(df: DataFrame, order: list[str], size: Column, budget: int, by: list[str] = (), ranges: int | None = None) -> DataFrame:
    """The first rows in order whose sizes together are at most `budget`, with their running_bytes."""
    return running(df, order, {"running_bytes": size.cast("bigint")}, by, ranges).where(F.col("running_bytes") <= budget)
