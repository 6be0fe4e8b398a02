"""The queries over the operators of this folder, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html, infill, langid, maxent, minhash, packing, pieces, pii, resample, tokcount, topk, vecdup, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs, pii.fit(docs), ["doc_id"])


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdup.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_documents(table(spark, sf_dir, "documents"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_documents(table(spark, sf_dir, "documents"), words=3, percent=85)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    back = pieces.decode(coded, model)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return back.select("doc_id", F.expr("octet_length(piece_ids) div 4").alias("n_ids"), F.crc32("piece_ids").alias("ids_crc32"), same.alias("round_trip"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = infill.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return cut.select("doc_id", F.col("n_units").alias("n"), "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), *digests)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = tokcount.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_pii": op2_pii,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_warc": op6_warc,
    "op7_html": op7_html,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_language_id": op9_language_id,
    "op10_topk": op10_topk,
    "op11_infill": op11_infill,
    "op12_token_counts": op12_token_counts,
    "op13_resample": op13_resample,
}
FINITE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
REACH = "reach AS (SELECT id AS a, id AS b FROM ids UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b), comp AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"
WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
BITS = "array_to_string(list_transform(range(1, 41), lambda i: printf('%04b', strpos('0123456789abcdef', h[i]) - 1)), '')"


def eight_hex(at: int) -> str:
    """SQL for the number in the eight hex digits of h from `at`."""
    return "(" + " + ".join(f"(strpos('0123456789abcdef', h[{at + i}]) - 1)::BIGINT * {16 ** (7 - i)}" for i in range(8)) + ")"


RUNS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
CRC_TABLE = "(SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) FROM range(256) r(i))"
BYTES = "list_transform(range(1, strlen(f) + 1), lambda i: (strpos('0123456789ABCDEF', hex(encode(f))[2 * i - 1]) - 1) * 16 + strpos('0123456789ABCDEF', hex(encode(f))[2 * i]) - 1)"
ORACLE_SQL: dict[str, str] = {
    "op3_embedding_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE {FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
      ids AS (SELECT DISTINCT vec_id AS id FROM embeddings),
      links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9), {REACH}
      SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN comp ON id = vec_id""",
    "op5_minhash_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS w FROM documents), ids AS (SELECT DISTINCT doc_id AS id FROM documents),
      s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
      n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL), shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
      links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)), {REACH}
      SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN comp ON id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op6_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages), b AS (SELECT *, {BITS} AS bits, max(page_id) OVER (PARTITION BY h) AS owner FROM p)
      SELECT page_id, strlen(t)::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum(list_transform(range(5), lambda j: CASE WHEN bits[5 * k + j + 1] = '1' THEN (1 << (4 - j)) ELSE 0 END))::BIGINT]), '') AS payload_digest,
      CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to FROM b""",
    "op10_topk": f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings WHERE {FINITE}),
      p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.w, c.w)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_infill": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents), u AS (SELECT *, {", ".join(f"{eight_hex(8 * k + 1)} AS h{k + 1}" for k in range(4))} FROM d),
      c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
      p AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM c)
      SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "op13_resample": f"""WITH w AS (SELECT doc_id, {RUNS} AS w FROM documents), x AS (SELECT {RUNS} AS w FROM benchmark), crc AS (SELECT {CRC_TABLE} AS t),
      s AS (SELECT f, count(*) AS n FROM (SELECT unnest(w) AS f FROM w) GROUP BY f), t AS (SELECT f, count(*) AS n FROM (SELECT unnest(w) AS f FROM x) GROUP BY f),
      d AS (SELECT f, coalesce(s.n, 0) AS s, coalesce(t.n, 0) AS t, xor(list_reduce({BYTES}, lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM s FULL JOIN t USING (f), crc),
      b AS (SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM d GROUP BY bucket), g AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM b) + 10000) / ((s + 1) * ((SELECT sum(t) FROM b) + 10000))))::BIGINT AS gain FROM b),
      h AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM (SELECT doc_id, unnest(w) AS f FROM w) JOIN d USING (f) JOIN g USING (bucket) GROUP BY doc_id),
      z AS (SELECT doc_id, len(w) AS n, coalesce(weight, 0) AS weight, sha256('2024:' || doc_id) AS h FROM w LEFT JOIN h USING (doc_id)),
      y AS (SELECT *, weight + floor(-1000 * ln(-ln(({eight_hex(1)} + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM z),
      r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM y WHERE n >= 20)
      SELECT y.doc_id, n::BIGINT AS n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM r) THEN rank END AS rank FROM y LEFT JOIN r ON r.doc_id = y.doc_id""",
}
