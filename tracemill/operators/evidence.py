"""How sure a capability is, from three kinds of evidence: its symbols, the rules that hit, and what a text says about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X

LONGEST = 64  # of words whose parts are spelled out


def count_score(n: Column, steps: tuple[tuple[int, float], ...], beyond: float) -> Column:
    return X.case(*((n <= most, score) for most, score in steps), otherwise=beyond)


def named(symbols: DataFrame, fragments: DataFrame) -> DataFrame:
    """symbols: capability, symbol; fragments: capability, fragment (one each). The distinct symbols that the fragment of their capability holds
    as a part. A symbol of word characters lies within one word, so words are spelled out into their parts once each and meet the symbols by
    equality; other symbols, and those of capabilities with words over LONGEST characters, are looked for in the text."""
    s = symbols.select("capability", "symbol").where("symbol is not null and symbol <> ''").distinct()
    words = fragments.select("capability", F.explode(F.array_distinct(F.regexp_extract_all("fragment", F.lit(r"[A-Za-z0-9_]+"), F.lit(0)))).alias("word"))
    sizes = s.groupBy("capability").agg(F.min(F.length("symbol")).alias("least"), F.max(F.length("symbol")).alias("most"))
    n = F.length("word")
    short = words.where(n <= LONGEST).join(sizes, "capability")
    starts = F.sequence(F.lit(1), F.length("word"))
    parts = F.flatten(F.transform(starts, lambda i: F.transform(F.filter(F.sequence(F.col("least"), F.least(F.col("most"), F.lit(LONGEST))), lambda k: k <= F.length("word") - i + 1), lambda k: F.substr(F.col("word"), i, k))))
    spelled = short.where("least <= length(word)").select("capability", F.explode(F.array_distinct(parts)).alias("symbol")).distinct()
    plain = F.col("symbol").rlike(r"^[A-Za-z0-9_]+$") & (F.length("symbol") <= LONGEST)
    by_parts = s.where(plain).join(spelled, ["capability", "symbol"], "left_semi")
    odd = words.where(n > LONGEST).select("capability", "word")
    by_long_words = s.where(F.col("symbol").rlike(r"^[A-Za-z0-9_]+$")).join(odd, "capability").where(F.contains("word", "symbol")).select("capability", "symbol")
    by_text = s.where(~F.col("symbol").rlike(r"^[A-Za-z0-9_]+$")).join(fragments, "capability").where(F.contains("fragment", "symbol")).select("capability", "symbol")
    return by_parts.unionByName(by_long_words).unionByName(by_text).distinct()


def confidence(capabilities: DataFrame, l1: DataFrame, l2: DataFrame, l3: DataFrame) -> DataFrame:
    """capabilities: capability; l1: capability, symbol, visibility; l2: capability, severity; l3: capability, fragment (one each). l1_score: 0.6 for
    how many symbols, 0.4 for the share of public ones; l2_score: half for how many rules, half for the share of high severity; l3_score: half for
    a text, half for the share of symbols that it names. Without evidence a score is 0."""
    share = lambda c, n: X.ratio(c.cast("double"), n)
    n = F.count("*").cast("double")
    a = l1.groupBy("capability").agg(n.alias("n1"), F.count_if(F.col("visibility") == "pub").alias("pub"))
    b = l2.groupBy("capability").agg(n.alias("n2"), F.count_if(F.col("severity") == "high").alias("high"))
    hits = l1.join(named(l1, l3), ["capability", "symbol"], "left_semi").groupBy("capability").agg(F.count("*").alias("hit"))
    # How far a number of symbols or rules is trusted.
    first = 0.6 * count_score(F.col("n1"), ((20, 1.0), (50, 0.7)), 0.4) + 0.4 * share(F.col("pub"), F.col("n1"))
    second = 0.5 * count_score(F.col("n2"), ((1, 0.5), (5, 1.0), (10, 0.7)), 0.4) + 0.5 * share(F.col("high"), F.col("n2"))
    third = F.when(F.col("fragment") != "", 0.5).otherwise(0.0) + 0.5 * F.coalesce(share(F.col("hit"), F.col("n1")), F.lit(0.0))
    j = capabilities.select("capability").distinct()
    for t in (a, b, l3.select("capability", "fragment"), hits):
        j = j.join(t, "capability", "left")
    zero = lambda c, there: F.when(there, c).otherwise(0.0)
    known = F.col("fragment").isNotNull()
    return j.fillna(0, ["hit"]).select("capability", zero(first, F.col("n1").isNotNull()).alias("l1_score"), zero(second, F.col("n2").isNotNull()).alias("l2_score"), zero(third, known).alias("l3_score"))
