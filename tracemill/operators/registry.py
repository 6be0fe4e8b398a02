"""Versions: sparse vectors carried to a newer feature registry, schema versions, and version requirements."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Remap:
    """From one version of the registry to a later one: places of tools and of phases that moved."""

    frm: int
    to: int
    tools: Mapping[int, int] = field(default_factory=dict)
    phases: Mapping[int, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Registry:
    """A small table of names: places only grow, and a version keeps the remaps of those before it."""

    version: int = 1
    tools: tuple[str, ...] = ("locate", "modify", "verify", "commit", "other")
    phases: tuple[str, ...] = ("locate", "modify", "verify", "commit", "other")
    history: tuple[Remap, ...] = ()
    parent: int | None = None

    def with_tool(self, name: str) -> Registry:
        return self if name in self.tools else Registry(self.version, (*self.tools, name), self.phases, self.history, self.parent)

    def with_phase(self, name: str) -> Registry:
        return self if name in self.phases else Registry(self.version, self.tools, (*self.phases, name), self.history, self.parent)

    def upgraded(self, *remaps: Remap) -> Registry:
        return Registry(self.version + 1, self.tools, self.phases, (*self.history, *remaps), self.version)

    def chain(self, version: int) -> list[Remap]:
        """Remaps from a version on; a gap ends them."""
        out = []
        while version < self.version:
            step = next((r for r in self.history if r.frm == version), None)
            if step is None:
                break
            out.append(step)
            version = step.to
        return out


def _moved(place: Column, table: Mapping[int, int]) -> Column:
    return F.coalesce(*(F.when(place == a, b) for a, b in table.items())) if table else F.lit(None).cast("int")


def _step(r: Remap, width: int) -> Callable[[Column], Column]:
    return lambda p: F.struct(F.coalesce(_moved(p["i"], r.tools), _moved(p["i"], r.phases), F.when(p["i"] < width, p["i"])).alias("i"), p["x"].alias("x"))


def reproject(vectors: DataFrame, registry: Registry) -> DataFrame:
    """vectors: registry_version, indices array<int>, values array<double>. Each place goes through the remaps since its version: the tools'
    first, then the phases'; one in neither stays below the registry's width and is dropped above it. Vectors of the registry's
    own version stay as they are. One expression per older version, without a shuffle."""
    width = max(len(registry.tools), len(registry.phases))

    def carried(version: int) -> tuple[Column, Column]:
        pairs = F.arrays_zip(F.col("indices").alias("i"), F.col("values").alias("x"))
        for r in registry.chain(version):
            pairs = F.filter(F.transform(pairs, _step(r, width)), lambda p: p["i"].isNotNull())
        return F.transform(pairs, lambda p: p["i"]), F.transform(pairs, lambda p: p["x"])

    at, x = F.col("indices"), F.col("values")
    for v in sorted({r.frm for r in registry.history if r.frm < registry.version}):
        a, b = carried(v)
        here = F.col("registry_version") == v
        at, x = F.when(here, a).otherwise(at), F.when(here, b).otherwise(x)
    return vectors.withColumns({"indices": at, "values": x, "registry_version": F.lit(registry.version)})


def incompatible(required: DataFrame, core: DataFrame) -> DataFrame:
    """required: skill, input, version. core: input, version. Requirements that the core's version does not equal; core_version is empty
    where it lacks the input."""
    have = core.select("input", F.col("version").alias("core_version"))
    j = required.join(have, "input", "left").where(~F.col("version").eqNullSafe(F.col("core_version")))
    return j.select("skill", "input", F.col("version").alias("required"), F.coalesce("core_version", F.lit("")).alias("core_version"))


def satisfies(requirement: Column, version: Sequence[int]) -> Column:
    """Whether a version (major, minor, patch) meets comma-separated comparators; false where one can't be read. Releases only."""
    m, n, p = version
    now = F.lit(m * 10**12 + n * 10**6 + p)
    number = lambda a, b, c: a * F.lit(10**12) + b * F.lit(10**6) + c
    shape = r"^(\^|~|>=|<=|>|<|=)?\s*(\d+)(?:\.(\d+))?(?:\.(\d+))?$"

    def meets(raw: Column) -> Column:
        text = F.trim(raw)
        starred = text.endswith(".*")
        c = F.regexp_replace(text, r"(\.\*)+$", "")
        part = lambda k: F.regexp_extract(c, shape, k).try_cast("bigint")
        op = F.when(starred & (F.regexp_extract(c, shape, 1) == ""), "=").otherwise(F.regexp_extract(c, shape, 1))
        a, b, d = part(2), part(3), part(4)
        b0, d0, zero, one = F.coalesce(b, F.lit(0)), F.coalesce(d, F.lit(0)), F.lit(0), F.lit(1)
        low = number(a, b0, d0)
        after = F.when(b.isNull(), number(a + 1, zero, zero)).when(d.isNull(), number(a, b + 1, zero)).otherwise(low + one)  # first beyond what is written
        caret = F.when((a > 0) | b.isNull(), number(a + 1, zero, zero)).when((b > 0) | d.isNull(), number(a, b + 1, zero)).otherwise(low + one)
        tilde = F.when(b.isNull(), number(a + 1, zero, zero)).otherwise(number(a, b + 1, zero))
        ok = (
            F.when(op == ">", now >= after).when(op == ">=", now >= low).when(op == "<", now < low).when(op == "<=", now < after)
            .when(op == "=", (now >= low) & (now < after)).when(op == "~", (now >= low) & (now < tilde)).otherwise((now >= low) & (now < caret))
        )
        return F.when(text == "*", True).otherwise(F.coalesce(ok, F.lit(False)))

    return F.forall(F.split(requirement, ","), meets)
