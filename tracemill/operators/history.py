"""Evaluation history: outcomes, trends, comparisons, regressions and anomalies over trials of a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


def by_task() -> Window:
    return Window.partitionBy("task_id").orderBy("trial")


def outcome(n: Column, passed: Column, failed: Column) -> Column:
    """Of grader counts."""
    return X.case((n == 0, "N/A"), (failed == 0, "Pass"), (passed > 0, "Partial"), otherwise="Fail")


def rollup(graders: DataFrame) -> DataFrame:
    """graders: task_id, passed (boolean)."""
    ok = F.sum(F.col("passed").cast("bigint"))
    bad = F.sum((~F.col("passed")).cast("bigint"))
    return graders.groupBy("task_id").agg(F.count("*").alias("n"), ok.alias("n_passed"), bad.alias("n_failed")).withColumn("outcome", outcome(F.col("n"), F.col("n_passed"), F.col("n_failed")))


def with_previous(trials: DataFrame) -> DataFrame:
    w = by_task()
    return trials.withColumns({"prev_outcome": F.lag("outcome").over(w), "prev_metric": F.lag("metric").over(w), "prev_eval": F.lag("eval_id").over(w), "_last": F.lead("trial").over(w).isNull()})


def trend_of(prev: Column, now: Column) -> Column:
    return X.case((prev.isNull(), F.lit(None).cast("string")), ((prev == "Pass") & (now == "Pass"), "Stable"), (now == "Pass", "Improved"), (prev == "Pass", "Degraded"), otherwise="Stable")


def trends(trials: DataFrame) -> DataFrame:
    return with_previous(trials).withColumn("trend", trend_of(F.col("prev_outcome"), F.col("outcome"))).drop("_last")


# Metrics, and whether they need the tool pattern, need its vector, and are better when lower.
METRICS = (
    ("n_toolcalls", True, False, False), ("n_tokens", True, False, False), ("duration_ms", True, False, False),
    ("tool_entropy", True, True, True), ("phase_entropy", True, True, True), ("loop_ratio", True, True, True), ("backtrack_ratio", True, True, True),
    ("state_stability_score", True, True, False), ("additions", False, False, False), ("deletions", False, False, False),
)


def metric_change(prev: Column, now: Column, lower_is_better: Column | bool = False) -> tuple[Column, Column]:
    """Percentage and direction: Up, Down or Flat within 5 percent; where lower is better, a fall is Up and a rise Down."""
    pct = F.when(prev == 0, F.when(now == 0, 0.0).otherwise(100.0)).otherwise(X.ratio(now - prev, prev) * 100.0)
    sign = F.when(F.lit(lower_is_better) if isinstance(lower_is_better, bool) else lower_is_better, -pct).otherwise(pct)
    return pct, X.case((sign > 5.0, "Up"), (sign < -5.0, "Down"), otherwise="Flat")


def compare_metrics(evals: DataFrame) -> DataFrame:
    """evals: task_id, trial, eval_id and the columns of METRICS. A row per task and metric of its last evaluation against the one before; a
    metric has none where one side lacks it. One window by task, then the metrics unpivoted."""
    names = [m[0] for m in METRICS]
    w = by_task()
    e = evals.withColumns({f"p_{n}": F.lag(n).over(w) for n in names} | {"from_eval": F.lag("eval_id").over(w), "_next": F.lead("eval_id").over(w)})
    e = e.where("_next is null and from_eval is not null")
    each = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(f"p_{n}").cast("double").alias("a"), F.col(n).cast("double").alias("b"), F.lit(low).alias("low")) for n, _, _, low in METRICS))
    m = e.select("task_id", "from_eval", F.col("eval_id").alias("to_eval"), F.explode(each).alias("m")).where("m.a is not null and m.b is not null")
    pct, direction = metric_change(F.col("m.a"), F.col("m.b"), F.col("m.low"))
    return m.select("task_id", "from_eval", "to_eval", "m.metric", F.col("m.a").alias("from_value"), F.col("m.b").alias("to_value"), pct.alias("change_pct"), direction.alias("direction"))


def compare(trials: DataFrame) -> DataFrame:
    """Last against the one before, by task."""
    pct, direction = metric_change(F.col("prev_metric"), F.col("metric"))
    last = with_previous(trials).where("_last and prev_eval is not null")
    return last.select("task_id", F.col("prev_eval").alias("from_eval"), F.col("eval_id").alias("to_eval"), F.col("prev_metric").alias("from_value"), F.col("metric").alias("to_value"), pct.alias("change_pct"), direction.alias("direction"), trend_of(F.col("prev_outcome"), F.col("outcome")).alias("trend"))


def severity_of(prev: Column, now: Column) -> Column:
    step = F.concat_ws(">", prev, now)
    return X.case((step == "Pass>Fail", "Critical"), (step.isin("Pass>Partial", "Partial>Fail"), "High"), (step == "Fail>Partial", "Medium"), otherwise="Low")


def regressions(trials: DataFrame) -> DataFrame:
    """Last trials that differ from the one before with a severity over Low; a step from Fail to Partial is marked as an improvement."""
    last = with_previous(trials).where("_last and prev_eval is not null").withColumn("severity", severity_of(F.col("prev_outcome"), F.col("outcome"))).where("severity <> 'Low'")
    better = F.concat_ws(">", "prev_outcome", "outcome") == "Fail>Partial"
    return last.select("task_id", F.col("prev_eval").alias("from_eval"), F.col("eval_id").alias("to_eval"), F.col("prev_outcome").alias("from_outcome"), F.col("outcome").alias("to_outcome"), "severity", better.alias("is_improvement"))


def described(trials: DataFrame, tasks: DataFrame) -> DataFrame:
    """History with task descriptions; tasks without one are 'Unknown task'."""
    return trials.join(tasks, "task_id", "left").withColumn("description", F.coalesce("description", F.lit("Unknown task")))


def anomalies(trials: DataFrame, least: int = 3, sigmas: float = 2.0) -> DataFrame:
    """Metrics over `sigmas` population deviations from the mean of all earlier trials, where there are at least `least`."""
    w = by_task().rowsBetween(Window.unboundedPreceding, -1)
    t = trials.withColumns({"n_before": F.count("metric").over(w), "mean_before": F.avg("metric").over(w), "sd_before": F.stddev_pop("metric").over(w)})
    off = F.abs(F.col("metric") - F.col("mean_before"))
    return t.where((F.col("n_before") >= least) & (F.col("sd_before") > 0) & (off > sigmas * F.col("sd_before")))


# Rules of degradation: id, severity, metric, threshold in percent.
GROWTH = (("R001", "high", "n_toolcalls", 100.0), ("R002", "high", "duration_ms", 100.0), ("R003", "medium", "n_tokens", 200.0), ("R005", "medium", "network_calls", 0.0))
VALIDATION, CONFIDENCE = ("R004", "critical"), ("R006", "low", 30.0)


def degradations(evals: DataFrame) -> DataFrame:
    """evals: task_id, trial, eval_id, the metrics of GROWTH, validated (boolean), confidence (0 to 1). Each task's last evaluation against the
    one before: rules hit, in order, and a verdict: Degraded by a critical rule, Watch by a high or medium one, else Pass. Growth from zero
    counts as 100 percent; confidence falls in points of a hundred; a rule that lacks a side isn't hit. One window by task."""
    w = by_task()
    names = [m for _, _, m, _ in GROWTH] + ["validated", "confidence"]
    e = evals.withColumns({f"p_{n}": F.lag(n).over(w) for n in names} | {"from_eval": F.lag("eval_id").over(w), "_next": F.lead("eval_id").over(w)})
    e = e.where("_next is null and from_eval is not null")
    hits = {rule: (kind, metric_change(F.col(f"p_{m}"), F.col(m))[0] > most) for rule, kind, m, most in GROWTH}
    hits[VALIDATION[0]] = (VALIDATION[1], F.col("p_validated") & ~F.col("validated"))
    hits[CONFIDENCE[0]] = (CONFIDENCE[1], F.round((F.col("p_confidence") - F.col("confidence")) * 100.0, 6) > CONFIDENCE[2])
    known = {m: F.col(m).isNotNull() & F.col(f"p_{m}").isNotNull() for m in names}
    need = {rule: known[m] for rule, _, m, _ in GROWTH} | {VALIDATION[0]: known["validated"], CONFIDENCE[0]: known["confidence"]}
    hit = {rule: (kind, F.coalesce(need[rule] & cond, F.lit(False))) for rule, (kind, cond) in sorted(hits.items())}
    some = lambda *kinds: F.greatest(F.lit(False), F.lit(False), *(c for k, c in hit.values() if k in kinds))
    verdict = X.case((some("critical"), "Degraded"), (some("high", "medium"), "Watch"), otherwise="Pass")
    rules = F.concat_ws(",", *(F.when(c, rule) for rule, (_, c) in hit.items()))
    return e.select("task_id", "from_eval", F.col("eval_id").alias("to_eval"), rules.alias("rules"), verdict.alias("verdict"))


def recommendations(rolled: DataFrame) -> DataFrame:
    """rolled: as of rollup(), by task_id. A line of advice each: what to do next, by outcome."""
    partial = F.concat(F.col("n_passed").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" graders passed. Focus on the failing graders."))
    # Advice by outcome.
    advice = X.case(
        (F.col("outcome") == "Fail", F.array(F.lit("All graders failed. Review the code for syntax errors or breaking changes."), F.lit("Evaluate again after fixing build/test/lint failures."))),
        (F.col("outcome") == "Partial", F.array(partial, F.lit("Review grader details for specific error messages."))),
        otherwise=F.array(F.lit("All automated checks passed. Review LLM rubric scores for quality insights.")),
    )
    return rolled.select("task_id", "outcome", F.posexplode(advice).alias("position", "advice"))
