"""What the operators share: shipping this package, scratch tables, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import new_path, stash, unstash
from ..sources.ship import ship

_caches: list[tuple[str, Callable[[], None]]] = []
_entered = ""


def forgets(module: str, *caches) -> None:
    """A worker process drops these caches of a module when it starts with the operator of another module: processes outlive a query,
    and what the operators of a pipeline remember would add up."""
    _caches.extend((module, c.clear) for c in caches)


def give_back() -> None:
    """What was dropped goes back to the machine; the allocators would keep it for the process."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)


def enter(module: str) -> None:
    global _entered
    if module != _entered:
        for owner, clear in _caches:
            if owner != module:
                clear()
        give_back()
        _entered = module


def arrow_schema(ddl: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(ddl)


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[dict[str, list]]], schema: str) -> DataFrame:
    """mapInArrow where f yields dicts of columns; empty dicts are left out."""
    ship(df.sparkSession)
    struct = T._parse_datatype_string(schema)
    arrow, module = arrow_schema(struct), f.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(module)
        for cols in f(batches):
            n = len(cols[arrow.names[0]])
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(cols[x.name], type=x.type) for x in arrow], schema=arrow)

    return df.mapInArrow(run, struct)


def attach(rows: DataFrame, table: DataFrame, keys: list[str], copies: str, total: int) -> DataFrame:
    """rows with the columns of table that belong to their keys (null without); table has a row a key, and in `copies` how many
    rows have it. Keys of more than a ten-thousandth of all `total` rows, 10,000 at most, meet their rows by broadcast, the others in
    a shuffle, and rows with a null key in none: so no task gets more of a key than its share."""
    often = F.col(copies) > total / 10_000
    hot = F.broadcast(table.where(often).drop(copies))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    new = [f for f in table.schema if f.name not in (*keys, copies)]
    near = rows.where(known).join(hot, keys)
    far = rows.where(known).join(hot.select(keys), keys, "left_anti").join(table.where(~often).drop(copies), keys, "left")
    bare = rows.where(~known).withColumns({f.name: F.lit(None).cast(f.dataType) for f in new})
    return near.unionByName(far).unionByName(bare)


__all__ = ["attach", "enter", "forgets", "map_batches", "new_path", "ship", "stash", "unstash"]
