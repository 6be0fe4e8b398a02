"""Expected against actual capabilities: exact and semantic verdicts, and the suite's figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X

KEY = ["case_id", "name", "status", "categories"]


def exact(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Both: case_id, name, status, categories (sorted array). Found, missing and extra counts, and whether all is exact.
    Extra names count only where a case has more capabilities than expected."""
    miss = expected.join(actual, KEY, "left_anti").groupBy("case_id").agg(F.count("*").alias("n_missing"))
    extra = actual.join(expected.select("case_id", "name"), ["case_id", "name"], "left_anti").groupBy("case_id").agg(F.count("*").alias("n_extra"))
    ne = expected.groupBy("case_id").agg(F.count("*").alias("n_expected"))
    na = actual.groupBy("case_id").agg(F.count("*").alias("n_actual"))
    j = ne.join(na, "case_id", "full").join(miss, "case_id", "left").join(extra, "case_id", "left").fillna(0)
    more = F.col("n_actual") > F.col("n_expected")
    return j.withColumn("exact", (F.col("n_missing") == 0) & ~(more & (F.col("n_extra") > 0)))


def words(name: Column) -> Column:
    """A name in lower case and its words: what `alike` compares. Worked out once a name, not once a pair."""
    return F.struct(F.lower(name).alias("name"), X.name_tokens(F.lower(name)).alias("words"))


def alike(a: Column, b: Column) -> Column:
    x, y = a["words"], b["words"]
    return X.case((a["name"] == b["name"], 1.0), ((F.size(x) == 0) & (F.size(y) == 0), 1.0), otherwise=X.set_jaccard(x, y))


def word_similarity(a: Column, b: Column) -> Column:
    """Jaccard of the words of two lower-cased names; 1 for equal names or where both have no words, 0 where one has none."""
    return alike(words(a), words(b))


def category_similarity(expected: Column, actual: Column) -> Column:
    """Shared categories over all, whatever their case; 1 where none are expected, 0 where there are none."""
    e, a = F.transform(expected, F.lower), F.transform(actual, F.lower)
    both = F.size(F.filter(e, lambda x: F.array_contains(a, x)))
    return X.case((F.size(e) == 0, 1.0), (F.size(a) == 0, 0.0), otherwise=X.ratio(both, F.size(e) + F.size(a) - both))


def semantic(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Mean over expected of the best 0.7 name + 0.3 category likeness among the case's actual capabilities."""
    side = lambda d, p: d.select("case_id", *(F.col(c).alias(f"{p}_{c}") for c in ("name", "categories")), words(F.col("name")).alias(f"{p}_words"))
    j = side(expected, "e").join(side(actual, "a"), "case_id", "left")
    score = 0.7 * alike(F.col("e_words"), F.col("a_words")) + 0.3 * category_similarity(F.col("e_categories"), F.col("a_categories"))
    best = j.withColumn("score", F.when(F.col("a_name").isNull(), 0.0).otherwise(score)).groupBy("case_id", "e_name", "e_categories").agg(F.max("score").alias("score"))
    return best.groupBy("case_id").agg(F.avg("score").alias("similarity"))


def best_matches(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """The most alike actual name of each expected one; ties go to the first name. Without any, null with score 0."""
    side = lambda d, name: d.select("case_id", F.col("name").alias(name), words(F.col("name")).alias(f"_{name}"))
    j = side(expected, "expected").join(side(actual, "actual"), "case_id", "left")
    score = F.when(F.col("actual").isNull(), 0.0).otherwise(alike(F.col("_expected"), F.col("_actual")))
    # The least of (-score, name) is the first name of the highest score.
    best = F.min(F.struct((-score).alias("less"), "actual")).alias("_b")
    return j.groupBy("case_id", "expected").agg(best).select("case_id", "expected", F.col("_b.actual").alias("actual"), (-F.col("_b.less") + 0.0).alias("score"))


def verdicts(exact_rows: DataFrame, semantic_rows: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Means are compared to nine digits, since the last one depends on the order of a sum."""
    j = exact_rows.join(semantic_rows, "case_id", "left").fillna(0.0, ["similarity"])
    return j.withColumn("verdict", X.case((F.col("exact"), "pass"), (F.round("similarity", 9) > threshold, "semantic_pass"), otherwise="fail"))


def suite(v: DataFrame) -> DataFrame:
    n = lambda k: F.sum((F.col("verdict") == k).cast("bigint"))
    return v.agg(F.count("*").alias("total"), n("pass").alias("passed"), n("semantic_pass").alias("semantic"), n("fail").alias("failed"), X.ratio(n("pass") + n("semantic_pass"), F.count("*")).alias("rate"))
