"""The queries of this package and the SQL of those that SQL can express. Each reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, mixing, pii, quality, runindex, simhash, substring, topk, warc, whiten, winnow, zonemap
from tidemark.llm.common import table, token
from tidemark.session import shared_folder


def op1_substring_dedup(spark: SparkSession, directory: str) -> DataFrame:
    kept = substring.remove_repeats(table(spark, directory, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_personal_data(spark: SparkSession, directory: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, directory, "documents").select("doc_id", "text"))
    n = [F.expr(f"cast(size(filter(base, x -> x.k = {i})) AS bigint)").alias(f"n_{k}") for i, k in enumerate(pii.BASE)]
    return found.select("doc_id", *n, F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def op3_simhash(spark: SparkSession, directory: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, directory, "documents"))


def op4_mix_sources(spark: SparkSession, directory: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, directory, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op5_quality(spark: SparkSession, directory: str) -> DataFrame:
    return quality.classify(table(spark, directory, "documents"), table(spark, directory, "labels")).drop("text_hash")


def op6_run_index(spark: SparkSession, directory: str) -> DataFrame:
    kept = runindex.remove_repeats(table(spark, directory, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "longest_match")


def op7_chat_format(spark: SparkSession, directory: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn int, role string, text string")
    turns = table(spark, directory, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest(chat.format_conversations(turns))


def op8_winnowing(spark: SparkSession, directory: str) -> DataFrame:
    found = winnow.contamination(table(spark, directory, "documents"), table(spark, directory, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op9_top_k(spark: SparkSession, directory: str) -> DataFrame:
    return topk.top_k(table(spark, directory, "embeddings"))


def op10_warc(spark: SparkSession, directory: str) -> DataFrame:
    folder = f"{shared_folder(spark, 'warc')}/{token('archive')}"
    return warc.read_archive(warc.write_archive(table(spark, directory, "pages"), folder), folder)


def op11_byte_bpe(spark: SparkSession, directory: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = bpe.encode(table(spark, directory, "documents"), ranks, public_tokenizers.PATTERN)
    shown = F.col("ids").cast("string")  # [1, 2, 3]
    listed = F.replace(F.substring(shown, F.lit(2), F.length(shown) - 2), F.lit(", "), F.lit(","))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
                        F.sha2(bpe.decode(F.col("ids"), ranks), 256).alias("decoded_sha256"))


def op12_zone_clusters(spark: SparkSession, directory: str) -> DataFrame:
    return zonemap.cluster(table(spark, directory, "embeddings")).drop("compared")


def op13_whitening(spark: SparkSession, directory: str) -> DataFrame:
    return whiten.whitened(table(spark, directory, "embeddings"))


SQL_SUBSTRING = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS h FROM d, unnest(range(1, len(ws) - 18)) t(i)),
gone AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
hit AS (SELECT DISTINCT doc_id, i + o AS p FROM gone, unnest(range(0, 20)) t(o)),
r AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM hit GROUP BY doc_id),
k AS (SELECT d.doc_id, string_agg(ws[t.p], ' ' ORDER BY t.p) AS kept FROM d, unnest(range(1, len(ws) + 1)) t(p)
  LEFT JOIN hit h ON h.doc_id = d.doc_id AND h.p = t.p WHERE h.p IS NULL GROUP BY d.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""

SQL_CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(text) + (length(text) - length(replace(text, '\', '')))
    + (length(text) - length(replace(text, '<<SYS>>', ''))) // 7 + (length(text) - length(replace(text, '<</SYS>>', ''))) // 8
    + (length(text) - length(replace(text, '[INST]', ''))) // 6 + (length(text) - length(replace(text, '[/INST]', ''))) // 7
    + (length(text) - length(replace(text, '<s>', ''))) // 3 + (length(text) - length(replace(text, '</s>', ''))) // 4
    + (length(text) - length(replace(text, '<<ROLE>>', ''))) // 8 + (length(text) - length(replace(text, '<<TEXT>>', ''))) // 8
    + (length(text) - length(replace(text, '<</ROLE>>', ''))) // 9
    + CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 25 + length(role) END AS written
  FROM turns),
numbered AS (
  SELECT *, lag(role) OVER w AS before, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n
  FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(written)::BIGINT AS formatted_chars,
  bool_and(CASE WHEN i = 1 THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user'
    WHEN before = 'user' THEN role = 'assistant' WHEN before = 'assistant' THEN role = 'user' ELSE false END
    AND (i < n OR role = 'assistant')) AS valid
FROM numbered GROUP BY conv_id
"""

SQL_WINNOW = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark WHERE text IS NOT NULL),
item_windows AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS win
  FROM b, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) t(i) WHERE len(ws) > 0),
lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (SELECT rid, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM d, lengths, unnest(range(1, len(ws) - n + 2)) t(i)),
hits AS (SELECT rid, i, w.n, item_id FROM doc_windows w JOIN item_windows v ON w.n = v.n AND w.win = v.win),
covered AS (SELECT rid, count(DISTINCT i + o) AS n_hit FROM hits, unnest(range(0, n)) t(o) GROUP BY rid),
listed AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM hits) GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN listed USING (rid)
"""

SQL_TOP_K = """
WITH rows AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0 GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v::DOUBLE[], d.v::DOUBLE[])::BIGINT AS score
  FROM rows q JOIN rows d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

SQL_WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY b) AS first, sha1(b) AS h FROM p)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::INT >> (5 * (3 - i % 4))::INT) % 32, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""

_ASSIGN = """
a{r} AS MATERIALIZED (
  SELECT id, any_value(vec_id) AS vec_id, any_value(v) AS v, min(d) AS d, arg_min(c, d * 16 + c) AS c FROM (
    SELECT id, vec_id, k.v, m.c, (list_inner_product(k.v::DOUBLE[], k.v::DOUBLE[]) - 2 * list_inner_product(k.v::DOUBLE[], m.v::DOUBLE[])
      + list_inner_product(m.v::DOUBLE[], m.v::DOUBLE[]))::BIGINT AS d FROM kept k, c{r} m) GROUP BY id),"""
_MOVE = """
c{n} AS MATERIALIZED (
  SELECT o.c, coalesce(any_value(m.v), any_value(o.v)) AS v FROM c{r} o LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM (
      SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, unnest(range(1, 65)) t(i) GROUP BY c, i) GROUP BY c) m ON m.c = o.c GROUP BY o.c),"""
SQL_CLUSTERS = """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('1:' || vec_id) AS h, min(v) AS v FROM kept WHERE vec_id IS NOT NULL GROUP BY vec_id)
  QUALIFY row_number() OVER (ORDER BY h) <= 16),""" + "".join(_ASSIGN.format(r=r) + _MOVE.format(r=r, n=r + 1) for r in range(3)) + _ASSIGN.format(r=3) + """
named AS (SELECT c, sha256(array_to_string(v, ',')) AS h FROM c3)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
FROM a3 JOIN named USING (c)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup, "op2_personal_data": op2_personal_data, "op3_simhash": op3_simhash, "op4_mix_sources": op4_mix_sources, "op5_quality": op5_quality, "op6_run_index": op6_run_index, "op7_chat_format": op7_chat_format, "op8_winnowing": op8_winnowing, "op9_top_k": op9_top_k, "op10_warc": op10_warc, "op11_byte_bpe": op11_byte_bpe,
    "op12_zone_clusters": op12_zone_clusters, "op13_whitening": op13_whitening,
}
ORACLES: dict[str, str] = {"op1_substring_dedup": SQL_SUBSTRING, "op7_chat_format": SQL_CHAT, "op8_winnowing": SQL_WINNOW, "op9_top_k": SQL_TOP_K, "op10_warc": SQL_WARC,
                            "op12_zone_clusters": SQL_CLUSTERS}
