"""Tables written to the folder that driver and executors share, to cut lineage in loops."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_made: set[str] = set()
_dealt: dict[str, str] = {}  # names of tables of dealt rows by path


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of our own, on a single machine only: elsewhere nobody shares it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    found = found or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tracemill-shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a table that lives as long as the application at most."""
    path = f"{shared_dir(spark)}/tracemill-{name}-{uuid.uuid4().hex}"
    _made.add(path)
    return path


@atexit.register
def clear() -> None:
    """Remove what is left, while the session still runs: results are lazy, so nothing can go earlier by itself."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        unlinked = [p for p in list(_made) if _removed(spark, p)]
        _made.difference_update(unlinked)


def _removed(spark: SparkSession, path: str) -> bool:
    try:
        remove(spark, path)
    except Exception:  # the session ends at the same time
        return False
    return True


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._tracemill_path = path
    return back


def deal(df: DataFrame, name: str, parts: int, *keys: str) -> DataFrame:
    """stash for rows that are met by `keys` again and again: a table in so many buckets, so that joins by the keys shuffle it no more."""
    path = new_path(df.sparkSession, name)
    table = "tracemill_" + path.rsplit("-", 1)[1]
    _dealt[path] = table
    df.repartition(parts, *keys).write.option("compression", "zstd").option("path", path).bucketBy(parts, *keys).format("parquet").saveAsTable(table)
    back = df.sparkSession.table(table)
    back._tracemill_path = path
    return back


def remove(spark: SparkSession, path: str) -> None:
    if path in _dealt:
        spark.sql(f"DROP TABLE IF EXISTS {_dealt.pop(path)}")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _made.discard(path)


def unstash(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t._tracemill_path)
