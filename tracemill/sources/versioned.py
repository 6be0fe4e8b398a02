"""An append-only table of versioned rows with compaction, and the stores of evaluations, tasks, git events and cached values on it.

A table is a folder of Parquet folders, and of numbered lists that name those which make up a state of the table. A list is written once,
under a number that didn't exist, so of two writers one takes the next number. Readers take the last list there is and read what it
names; nothing it names is changed or removed by an append or a compaction, so a read sees one state, whatever goes on beside it.
Compaction writes the newest row of each key, spread by key, beside the old folders and puts a list in place in which they are
replaced; appends that came meanwhile stay. Folders that no list of the last few names are removed by `vacuum`.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store


class Table:
    def __init__(self, spark: SparkSession, path: str, key: list[str], version: list[str]):
        self.spark, self.path, self.key, self.version = spark, path.rstrip("/"), key, version

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _numbers(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/lists")
        return sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(p) if f.getPath().getName().endswith(".json")) if fs.exists(p) else []

    def _list(self, number: int) -> list[str]:
        fs, p = self._fs(f"{self.path}/lists/{number:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def state(self) -> tuple[int, list[str]]:
        """(number, folders) of the last list; (0, []) for a new table."""
        numbers = self._numbers()
        return (numbers[-1], self._list(numbers[-1])) if numbers else (0, [])

    def _publish(self, change) -> int:
        """The next list, made by `change` from the last one; again if another writer was faster. Written whole elsewhere, then renamed."""
        while True:
            number, folders = self.state()
            fs, draft = self._fs(f"{self.path}/lists/.draft-{uuid.uuid4().hex}")
            out = fs.create(draft, False)
            out.write(bytearray(json.dumps(change(folders)).encode()))
            out.close()
            _, target = self._fs(f"{self.path}/lists/{number + 1:012d}.json")
            if not fs.exists(target) and fs.rename(draft, target):
                return number + 1
            fs.delete(draft, False)

    def _written(self, rows: DataFrame) -> str:
        name = f"rows-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def append(self, rows: DataFrame) -> int:
        """Number of the state that holds the rows."""
        name = self._written(rows)
        return self._publish(lambda folders: [*folders, name])

    def rows(self, number: int | None = None) -> DataFrame | None:
        """All versions, of the last state or of an earlier one; None for a table without a row folder."""
        folders = self.state()[1] if number is None else self._list(number)
        return self.spark.read.parquet(*(f"{self.path}/{f}" for f in folders)) if folders else None

    def latest(self, number: int | None = None) -> DataFrame | None:
        """The newest row of each key."""
        rows = self.rows(number)
        return None if rows is None else store.latest(rows, self.key, self.version).select(rows.columns)

    def compact(self, buckets: int = 16, meanwhile=None) -> int:
        """meanwhile: called between writing and publishing (for tests of what a reader sees then)."""
        number, old = self.state()
        if not old:
            return number
        name = self._written(self.latest(number).repartition(buckets, *self.key))
        if meanwhile:
            meanwhile()
        return self._publish(lambda folders: [name, *(f for f in folders if f not in old)])

    def clear(self) -> int:
        """An empty state; earlier ones stay readable until a vacuum."""
        return self._publish(lambda _: [])

    def vacuum(self, keep: int = 2) -> int:
        """Remove lists before the last `keep`, and folders that none of those names; returns how many folders went. Not beside an append."""
        numbers = self._numbers()
        kept = {f for n in numbers[-keep:] for f in self._list(n)}
        fs, p = self._fs(self.path)
        gone = [f.getPath() for f in fs.listStatus(p) if f.getPath().getName().startswith("rows-") and f.getPath().getName() not in kept]
        for path in gone:
            fs.delete(path, True)
        for n in numbers[:-keep]:
            fs.delete(self._fs(f"{self.path}/lists/{n:012d}.json")[1], False)
        return len(gone)


class Timeline:
    """Evaluations (eval_id, task_id, trial_index, outcome, created_at, ...), tasks (task_id, ...) and git events (event_id, at, ...)."""

    def __init__(self, spark: SparkSession, path: str):
        self.evals = Table(spark, f"{path}/evals", ["eval_id"], ["trial_index"])
        self.tasks = Table(spark, f"{path}/tasks", ["task_id"], ["created_at"])
        self.events = Table(spark, f"{path}/git_events", ["event_id"], ["at"])

    def save_evals(self, rows: DataFrame) -> int:
        """Evaluations are new or refused: none may be there already, or twice among the rows."""
        there = self.evals.rows()
        if rows.groupBy("eval_id").count().where("count > 1").count() or there is not None and not rows.join(there.select("eval_id"), "eval_id", "left_semi").isEmpty():
            raise ValueError("an evaluation of that id is there already")
        return self.evals.append(rows)

    def load_evals(self, ids: DataFrame) -> DataFrame:
        return store.lookup(self.evals.rows(), ids, "eval_id")

    def trials(self) -> DataFrame:
        """All evaluations with their position within their task; is_latest marks the last trial."""
        from pyspark.sql import Window

        w = Window.partitionBy("task_id").orderBy("trial_index", "eval_id")
        return self.evals.rows().withColumns({"position": F.row_number().over(w), "is_latest": F.lead("eval_id").over(w).isNull()})

    def recent(self, limit: int) -> DataFrame:
        """The newest evaluations; ties go to the greater id."""
        return self.evals.rows().orderBy(F.desc("created_at"), F.desc("eval_id")).limit(limit)

    def save_tasks(self, rows: DataFrame) -> int:
        """A task that is there already is replaced by what was created later."""
        return self.tasks.append(rows)

    def list_tasks(self) -> DataFrame:
        return self.tasks.latest()

    def save_events(self, rows: DataFrame) -> int:
        return self.events.append(rows)

    def recent_events(self, limit: int) -> DataFrame:
        return self.events.latest().orderBy(F.desc("at"), F.desc("event_id")).limit(limit)

    def described(self) -> DataFrame:
        """Trials with the description of their task, or 'Unknown task'."""
        tasks = self.list_tasks()
        out = self.trials()
        if tasks is None:
            return out.withColumn("description", F.lit("Unknown task"))
        return out.join(tasks.select("task_id", "description"), "task_id", "left").withColumn("description", F.coalesce("description", F.lit("Unknown task")))


class Cache:
    """Values by key: what is written last holds."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, Table(spark, path, ["key"], ["number"])

    def write(self, values: DataFrame) -> int:
        """values: key, json; a key once."""
        return self.table.append(values.select("key", "json", F.lit(self.table.state()[0]).cast("bigint").alias("number")))

    def read(self) -> DataFrame:
        rows = self.table.latest()
        return self.spark.createDataFrame([], "key string, json string") if rows is None else rows.select("key", "json")

    def clear(self) -> int:
        return self.table.clear()
