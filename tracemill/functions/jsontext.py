"""JSON inside a text: a fenced block, the whole text, or the first balanced stretch that parses.

Balance is found by a fold over the text's structural characters (runs of others are one token), in the JVM: brackets close in
the order they opened, and those within strings don't count, escapes respected. A bracket that closes nothing ends what was open.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENS = r'\\(?s:.)|["{}\[\]\\]|[^"{}\[\]\\]+'
STATE = "struct<at:int,open:string,quoted:boolean,begin:int,spans:array<struct<begin:int,length:int>>>"


def balanced(text: Column) -> Column:
    """Array of (begin, length), from 0: the outermost balanced stretches, in order."""
    start = F.from_json(F.lit('{"at":0,"open":"","quoted":false,"begin":0,"spans":[]}'), STATE)

    def step(s: Column, token: Column) -> Column:
        n = F.length(token)
        inside = s["open"] != ""
        opens, closes = token.isin("{", "["), token.isin("}", "]")
        active = ~s["quoted"]
        fits = closes & (F.substring(s["open"], 1, 1) == token)
        closer = F.when(token == "{", "}").otherwise("]")
        stack = F.when(active & opens, F.concat(closer, s["open"])).when(active & fits, F.substr(s["open"], F.lit(2))).when(active & closes, "").otherwise(s["open"])
        done = active & fits & (F.length(s["open"]) == 1)
        begin = F.when(active & opens & ~inside, s["at"]).otherwise(s["begin"])
        spans = F.when(done, F.array_append(s["spans"], F.struct(s["begin"].alias("begin"), (s["at"] + 1 - s["begin"]).alias("length")))).otherwise(s["spans"])
        quoted = F.when(inside & (token == '"'), ~s["quoted"]).otherwise(s["quoted"])
        return F.struct((s["at"] + n).alias("at"), stack.alias("open"), quoted.alias("quoted"), begin.alias("begin"), spans.alias("spans")).cast(STATE)

    return F.aggregate(F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0)), start, step, lambda s: s["spans"])


def found(text: Column) -> Column:
    """struct<kind, raw>: fenced (the block's content, without a language line), bare (the whole text, trimmed), inline (the first balanced
    stretch that parses), or null. Only inline ones are known to parse."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    named, plain = (F.regexp_extract(t, f"(?s){fence}(.*?)```", 1) for fence in ("```json", "```"))
    block = trim(plain)
    block = F.when(block.contains("\n"), trim(F.regexp_replace(block, r"^[^\n]*\n", ""))).otherwise(block)
    spans = F.transform(balanced(t), lambda s: F.substr(t, s["begin"] + 1, s["length"]))
    inline = F.get(F.filter(spans, lambda s: F.try_parse_json(s).isNotNull()), F.lit(0))
    item = lambda kind, raw: F.struct(F.lit(kind).alias("kind"), raw.alias("raw"))
    return F.when(t.rlike("(?s)```json.*?```"), item("fenced", trim(named))).when(t.rlike("(?s)```.*?```"), item("fenced", block)).when(t.rlike(r"(?s)^[{\[].*[}\]]$"), item("bare", t)).when(inline.isNotNull(), item("inline", inline))


def value(text: Column) -> Column:
    """What was found as a VARIANT; null if nothing was, or if it doesn't parse."""
    return F.try_parse_json(found(text)["raw"])
