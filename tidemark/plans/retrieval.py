"""Retrieval and merging queries: I1-I6, V1-V4, G1-G6, A12, A15."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import vocab
from tidemark.functions.text import r6
from tidemark.functions.urls import normalise_url
from tidemark.operators import cells, merging, retrieval, searchindex
from tidemark.operators import pages as pg
from tidemark.plans.adapters import lit, sql_list
from tidemark.plans.intent import ethics, listed
from tidemark.plans.pages import TOPIC_WORDS, part
from tidemark.plans.registry import cte, query
from tidemark.plans.scoring import intents
from tidemark.session import cut_lineage, shared_folder, stored

TERMS = f"list_filter(list_transform(regexp_extract_all({{x}}, '[A-Za-z]+'), lambda w: lower(w)), lambda w: NOT list_contains({sql_list(vocab.INDEX_STOP_WORDS)}, w))"
cte("field_terms", f"""
SELECT page_id, 'title' AS field, {TERMS.replace('{x}', 'title')} AS terms FROM parsed_pages
UNION ALL SELECT page_id, 'content', {TERMS.replace('{x}', 'content')} FROM parsed_pages""")
cte("postings", """
SELECT term, page_id, field, length, count(*) AS tf FROM (
  SELECT page_id, field, CAST(len(terms) AS INT) AS length, unnest(terms) AS term FROM field_terms) GROUP BY ALL""")
cte("field_df", "SELECT field, term, count(*) AS df FROM postings GROUP BY ALL")
cte("field_stats", """
SELECT field, count(*) AS docs, avg(length) AS avg_length FROM (SELECT DISTINCT page_id, field, length FROM postings) GROUP BY field""")
cte("impacts", f"""
SELECT p.term, p.page_id, p.field, ln(1 + (s.docs - d.df + 0.5) / (d.df + 0.5)) * p.tf * {vocab.BM25_K1 + 1}::DOUBLE
  / (p.tf + {vocab.BM25_K1}::DOUBLE * (1 - {vocab.BM25_B} + {vocab.BM25_B}::DOUBLE * p.length / s.avg_length))
  * CASE WHEN p.field = 'title' THEN 2.0 ELSE 1.0 END::DOUBLE AS impact
FROM postings p JOIN field_df d USING (field, term) JOIN field_stats s USING (field)""")
# the words of the pages' navigation links are the searches
cte("searches", "SELECT row_number() OVER (ORDER BY query) AS query_id, query FROM (SELECT DISTINCT anchor_text AS query FROM page_links WHERE anchor_text <> '')")


def parsed(t):
    return pg.html_to_page(t.table("pages"))


def searches(t):
    return pg.extract_links(t.table("pages")).where(F.col("anchor_text") != "").select(F.col("anchor_text").alias("query")).distinct()


@query("build_index", "SELECT p.term, p.page_id, p.field, p.length, p.tf, d.df FROM postings p JOIN field_df d USING (field, term)")
def _(t):
    index = retrieval.build_index(parsed(t))
    return index["postings"].join(index["df"], ["field", "term"]).select("term", "page_id", "field", "length", "tf", "df")


@query("build_index_docs", "SELECT page_id, primary_goal, use_cases, complexity, result_type, skill_level, round(quality_score, 6) AS quality_score FROM indexed_pages")
def _(t):
    d = retrieval.build_index(parsed(t))["docs"]
    return d.select("page_id", "primary_goal", listed(F.col("use_cases")).alias("use_cases"), "complexity", "result_type", "skill_level",
                    r6(F.col("quality_score")).alias("quality_score"))


@query("delete_from_index", "SELECT term, page_id, field, tf FROM postings WHERE page_id NOT IN (SELECT source_page_id FROM page_links WHERE anchor_text = 'The')")
def _(t):
    gone = pg.extract_links(t.table("pages")).where(F.col("anchor_text") == "The").select(F.col("source_page_id").alias("page_id"))
    return retrieval.delete_from_index(retrieval.postings(parsed(t)), gone).select("term", "page_id", "field", "tf")


@query("index_stats", """
SELECT (SELECT count(*) FROM tagged_pages) AS documents, (SELECT count(DISTINCT term) FROM postings) AS terms,
  (SELECT round(avg(word_count), 6) FROM tagged_pages) AS avg_length""")
def _(t):
    p = parsed(t)
    return retrieval.index_stats(retrieval.postings(p), pg.analyse_pages(p)).withColumn("avg_length", r6(F.col("avg_length")))


WORDS = (r"list_filter(list_transform(regexp_extract_all(coalesce({x}, ''), '[\p{L}\p{N}]+'), lambda w: lower(w)), "
         f"lambda w: NOT list_contains({sql_list(vocab.INDEX_STOP_WORDS)}, w))")
cte("index_texts", "SELECT page_id, unnest(['title', 'content', 'meta_description', 'url', 'phrases']) AS field, unnest([title, content, meta_description, url, replace(key_phrases, ';', ' ')]) AS text FROM tagged_pages")
cte("index_postings", f"""
SELECT term, page_id, field, length, count(*) AS tf FROM (
  SELECT page_id, field, CAST(len(terms) AS INT) AS length, unnest(terms) AS term FROM (SELECT page_id, field, {WORDS.replace('{x}', 'text')} AS terms FROM index_texts))
GROUP BY ALL""")
SCORED = f"""
d AS (SELECT field, term, count(*) AS df FROM p GROUP BY ALL),
s AS (SELECT field, count(*) AS docs, avg(length) AS avg_length FROM (SELECT DISTINCT page_id, field, length FROM p) GROUP BY field),
i AS (SELECT p.term, p.page_id, ln(1 + (s.docs - d.df + 0.5) / (d.df + 0.5)) * p.tf * {vocab.BM25_K1 + 1}::DOUBLE
    / (p.tf + {vocab.BM25_K1}::DOUBLE * (1 - {vocab.BM25_B} + {vocab.BM25_B}::DOUBLE * p.length / s.avg_length))
    * CASE WHEN p.field = 'title' THEN 2.0 ELSE 1.0 END::DOUBLE AS impact
  FROM p JOIN d USING (field, term) JOIN s USING (field)),
terms AS (SELECT query, unnest(list_distinct({WORDS.replace('{x}', 'query')})) AS term FROM searches),
scores AS (SELECT query, page_id, round(sum(impact), 6) AS score FROM terms JOIN i USING (term) GROUP BY ALL)
SELECT query, page_id, score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, page_id) AS INT) AS rank FROM scores) WHERE rank <= 10"""


@query("keyword_search", "WITH p AS (SELECT * FROM index_postings)," + SCORED)
def _(t):
    postings = stored(searchindex.postings(searchindex.with_phrases(parsed(t))))
    blocks = stored(searchindex.seal(searchindex.impacts(postings)))
    return searchindex.search(searches(t), blocks, 10).select("query", "page_id", "score", "rank")


# three segments: all pages, then every third again, then removals of every fifth; merged, and searched
@query("segmented_search", "WITH p AS (SELECT * FROM index_postings WHERE page_id % 5 <> 0)," + SCORED)
def _(t):
    path = shared_folder(t.spark, "segments")
    p = stored(parsed(t))
    stale = p.withColumn("title", F.when(F.col("page_id") % 3 == 0, F.lit("an old title")).otherwise(F.col("title")))
    searchindex.write_segment(stale, path, 0)
    searchindex.write_segment(p.where("page_id % 3 = 0"), path, 1)
    searchindex.write_tombstones(p.where("page_id % 5 = 0"), path, 2)
    kept = searchindex.merge_segments(t.spark, path, [0, 1], [2], 3)
    blocks = stored(searchindex.seal(searchindex.impacts(searchindex.live_postings(t.spark, path, kept))))
    return searchindex.search(searches(t), blocks, 10).select("query", "page_id", "score", "rank")


@query("intent_search", f"""
WITH asked AS (SELECT query, CASE length(query) % 3 WHEN 0 THEN 'learn' WHEN 1 THEN 'find_information' END AS goal,
    CASE WHEN length(query) % 2 = 0 THEN 'beginner' ELSE 'intermediate' END AS skill FROM searches),
terms AS (SELECT query, unnest(list_distinct({TERMS.replace('{x}', 'query')})) AS term FROM searches),
hits AS (SELECT query, page_id, sum(impact) AS s FROM terms JOIN impacts USING (term) WHERE field = 'title' GROUP BY ALL),
scores AS (
  SELECT query, page_id, round(CASE WHEN goal IS NULL THEN s ELSE s * (0.5 + 0.5 * (0.35::DOUBLE
    + 0.25 * CAST(contains('; ' || use_cases || ';', '; learning;') AS INT)
    + 0.15::DOUBLE * CASE WHEN (complexity, skill) IN (('simple', 'beginner'), ('moderate', 'intermediate')) THEN 1.0
      WHEN complexity = 'advanced' AND skill = 'beginner' THEN 0.3 ELSE 0.7 END::DOUBLE + 0.05::DOUBLE)) END, 6) AS score
  FROM hits JOIN asked USING (query) JOIN tagged_pages USING (page_id) WHERE goal IS NULL OR goal = primary_goal)
SELECT query, page_id, score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, page_id) AS INT) AS rank FROM scores) WHERE rank <= 10""")
def _(t):
    n = F.length("query")
    asked = searches(t).select(
        "query", F.col("query").alias("query_id"), F.when(n % 3 == 0, "learn").when(n % 3 == 1, "find_information").alias("goal"),
        F.when(n % 2 == 0, "beginner").otherwise("intermediate").alias("skill_level"), F.array(F.lit("learning")).alias("use_cases"),
        F.array().cast("array<struct<dimension:string,preference:string>>").alias("ethical_signals"),
        F.lit(None).cast("struct<horizon:string,recency:string,frequency:string>").alias("temporal"))
    p = parsed(t)
    docs = pg.analyse_pages(p).select("page_id", F.col("primary_goal").alias("doc_goal"), F.col("use_cases").alias("doc_use_cases"),
                                      F.col("complexity").alias("doc_complexity"), F.col("ethical_signals").alias("doc_ethical_signals"),
                                      F.lit(None).cast("string").alias("doc_recency"))
    return retrieval.intent_search(asked, retrieval.postings(p), docs, 10).select("query", "page_id", "score", "rank")


@query("topics_from_results", f"""
WITH terms AS (SELECT query, unnest(list_distinct({TERMS.replace('{x}', 'query')})) AS term FROM searches),
hits AS (SELECT DISTINCT query, page_id FROM terms JOIN impacts USING (term) WHERE field = 'title'),
words AS (SELECT query, unnest(list_concat(list_distinct({TOPIC_WORDS}), list_filter({sql_list(vocab.KEY_PHRASES)}, lambda p: contains(t, p)))) AS topic FROM hits JOIN page_texts USING (page_id)),
counted AS (SELECT query, topic, count(*) AS count FROM words GROUP BY ALL)
SELECT query AS query_id, topic, count, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY count DESC, topic) AS INT) AS rank FROM counted) WHERE rank <= 10""")
def _(t):
    p = parsed(t)
    docs = p.withColumn("text", pg.analysis_text(F.col("title"), F.col("content"), F.col("meta_description"))).select(
        "page_id", F.array_distinct(pg.topic_words(F.col("text"))).alias("topics"),
        pg.key_phrases(F.lower("text")).alias("key_phrases"))
    terms = searches(t).select(F.col("query").alias("query_id"), F.explode(F.array_distinct(retrieval.index_terms(F.col("query")))).alias("term"))
    titles = retrieval.postings(p, ("title",))
    hits = terms.join(titles.select("term", "page_id"), "term").select("query_id", "page_id").distinct()
    return retrieval.topics_from_results(hits.join(docs, "page_id"))


# ---------------------------------------------------------------- results of several backends
cte("results", """
SELECT p.page_id * 10 + b.i AS row_id, p.page_id % 25 AS query_id, b.name AS source, p.url || CASE WHEN b.i = 1 THEN '&utm_medium=x' ELSE '' END AS url,
  p.title || CASE b.i WHEN 1 THEN ' more' ELSE '' END AS title, p.content || repeat(' more', b.i) AS content,
  CASE WHEN p.page_id % 7 = 6 THEN NULL ELSE round((p.page_id * 37 + b.i * 11) % 100 / 10.0::DOUBLE, 1) END AS score
FROM parsed_pages p JOIN (SELECT unnest([0, 1, 2]) AS i, unnest(['go_crawler', 'searxng', 'custom_index']) AS name) b
ON p.page_id % 3 = b.i OR (p.page_id % 5 = 0 AND (p.page_id + 1) % 3 = b.i)""")


def results(t):
    """Pages as answers of three backends; one in five comes from two of them."""
    p = parsed(t)
    home = (p.page_id % 3).cast("int")
    extra = F.when(p.page_id % 5 == 0, ((p.page_id + 1) % 3).cast("int"))
    each = p.select("*", F.explode(F.array_compact(F.array(home, extra))).alias("i"))
    names = F.array(*[F.lit(x) for x in ("go_crawler", "searxng", "custom_index")])
    i = F.col("i")
    return each.select(
        (F.col("page_id") * 10 + i).alias("row_id"), (F.col("page_id") % 25).alias("query_id"), F.element_at(names, i + 1).alias("source"),
        F.concat("url", F.when(i == 1, "&utm_medium=x").otherwise("")).alias("url"),
        F.concat("title", F.when(i == 1, " more").otherwise("")).alias("title"), F.concat("content", F.expr("repeat(' more', i)")).alias("content"),
        F.when(F.col("page_id") % 7 != 6, F.round((F.col("page_id") * 37 + i * 11) % 100 / 10.0, 1)).alias("score"))


cte("normal_urls", f"""
SELECT row_id, url, CASE WHEN scheme <> '' THEN scheme || '://' ELSE '' END || loc ||
  CASE WHEN ends_with(path, '/') OR {" OR ".join(f"ends_with(path, '{e}')" for e in vocab.PAGE_EXTENSIONS)} THEN path ELSE path || '/' END ||
  CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS normal FROM (
  SELECT row_id, url, lower({part('url', 1)}) AS scheme, {part('url', 2)} AS loc, {part('url', 3)} AS path,
    list_filter(string_split({part('url', 4)}, '&'), lambda p: regexp_matches(p, '^[^=]+=.+$')
      AND NOT list_contains({sql_list(vocab.TRACKING_PARAMS)}, lower(split_part(p, '=', 1)))) AS kept FROM results)""")


@query("route_queries", """
SELECT query_id, route, unnest(CASE route WHEN 'both' THEN [{'backend': 'go_crawler', 'weight': 0.6::DOUBLE, 'quota': 9::INT}, {'backend': 'searxng', 'weight': 0.4::DOUBLE, 'quota': 6::INT}]
  WHEN 'hybrid' THEN [{'backend': 'go_crawler', 'weight': 0.5::DOUBLE, 'quota': 10::INT}, {'backend': 'searxng', 'weight': 0.5::DOUBLE, 'quota': 10::INT}]
  WHEN 'community' THEN [{'backend': 'searxng', 'weight': 1.0::DOUBLE, 'quota': 20::INT}] ELSE [{'backend': 'go_crawler', 'weight': 1.0::DOUBLE, 'quota': 20::INT}] END, recursive := true)
FROM (SELECT query_id, CASE WHEN goal = 'troubleshooting' THEN 'community' WHEN goal = 'comparison' THEN 'both' WHEN goal IN ('purchase', 'local_service') THEN 'structured'
  WHEN len(list_filter(signals, lambda s: starts_with(s, 'privacy/'))) > 0 THEN 'structured' ELSE 'hybrid' END AS route FROM request_intents)""")
def _(t):
    return merging.route_queries(intents(t))


cte("quotas", """
SELECT DISTINCT query_id, 'go_crawler' AS source, CASE WHEN query_id % 2 = 0 THEN 3 ELSE 2 END AS quota FROM results
UNION ALL SELECT DISTINCT query_id, 'searxng', 1 FROM results""")


@query("backend_quota", """
SELECT query_id, source, row_id, position FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC NULLS LAST, url) AS INT) AS position
  FROM results JOIN quotas USING (query_id, source)) WHERE position <= quota""")
def _(t):
    r = results(t)
    q = r.select("query_id").distinct()
    routes = q.select("query_id", F.lit("go_crawler").alias("backend"), F.when(F.col("query_id") % 2 == 0, 3).otherwise(2).alias("quota")).unionByName(
        q.select("query_id", F.lit("searxng").alias("backend"), F.lit(1).alias("quota")))
    return merging.apply_quota(r, routes).select("query_id", "source", "row_id", "position")


@query("normalise_url", "SELECT row_id, url, normal FROM normal_urls")
def _(t):
    return results(t).select("row_id", "url", normalise_url(F.col("url")).alias("normal"))


cte("merged", """
SELECT query_id, normal AS url, md5(normal) AS url_hash, arg_max(title, length(title) * 1000000 - row_id) AS title,
  arg_max(content, length(content) * 1000000 - row_id) AS content, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources,
  coalesce(max(score), 0.0) AS best_score, coalesce(avg(score), 0.0) AS avg_score, count(*) AS result_count
FROM results JOIN normal_urls USING (row_id) GROUP BY query_id, normal""")


@query("merge_results", "SELECT query_id, url, url_hash, title, md5(content) AS content_md5, sources, best_score, round(avg_score, 6) AS avg_score, result_count FROM merged")
def _(t):
    m = merging.merge_results(results(t))
    return m.select("query_id", "url", "url_hash", "title", F.md5("content").alias("content_md5"), F.array_join("sources", ",").alias("sources"),
                    "best_score", r6(F.col("avg_score")).alias("avg_score"), "result_count")


@query("normalise_scores", """
SELECT query_id, url, round(CASE WHEN hi > lo THEN (best_score - lo) / (hi - lo) WHEN best_score > 0 THEN 1 ELSE 0 END, 6) AS minmax_score,
  round(CASE WHEN n = 1 THEN greatest(0, least(1, best_score - mean)) WHEN sd > 0 THEN greatest(0, least(1, (best_score - mean) / sd)) ELSE 0 END, 6) AS zscore_score,
  round(1 / (1 + exp(mean - best_score)), 6) AS sigmoid_score
FROM (SELECT *, min(best_score) OVER w AS lo, max(best_score) OVER w AS hi, avg(best_score) OVER w AS mean, stddev_samp(best_score) OVER w AS sd,
  count(*) OVER w AS n FROM merged WINDOW w AS (PARTITION BY query_id))""")
def _(t):
    m = merging.merge_results(results(t)).select("query_id", "url", "best_score")
    for method in ("minmax", "zscore", "sigmoid"):
        m = merging.normalise_scores(m, method)
    return m.select("query_id", "url", *[r6(F.col(f"{x}_score")).alias(f"{x}_score") for x in ("minmax", "zscore", "sigmoid")])


@query("backend_distribution", """
SELECT source, count(*) AS results, round((SELECT count(*) FROM merged) / (SELECT count(*) FROM results), 6) AS aggregation_ratio FROM results GROUP BY source""")
def _(t):
    d = merging.backend_distribution(results(t), merging.merge_results(results(t)))
    return d.withColumn("aggregation_ratio", r6(F.col("aggregation_ratio")))


# documents of one source are the result list of one query; copies and near copies are in the data
cte("listed", """
SELECT hash_id AS query_id, doc_id AS row_id, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS w
FROM (SELECT *, source AS hash_id FROM documents)""")


@query("content_dedup", """
WITH RECURSIVE near AS MATERIALIZED (
  SELECT a.query_id, a.row_id, b.row_id AS earlier FROM listed a JOIN listed b ON a.query_id = b.query_id AND b.row_id < a.row_id
  WHERE len(a.w) > 0 AND len(b.w) > 0 AND least(len(a.w), len(b.w)) >= 0.9::DOUBLE * greatest(len(a.w), len(b.w))
    AND len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.9::DOUBLE),
ranked AS MATERIALIZED (SELECT row_id, row_number() OVER (ORDER BY row_id) AS n FROM listed),
links AS MATERIALIZED (SELECT r.n, list(e.earlier) FILTER (e.earlier IS NOT NULL) AS earlier FROM ranked r LEFT JOIN near e USING (row_id) GROUP BY r.n),
walk AS (
  SELECT 0::BIGINT AS n, []::BIGINT[] AS kept
  UNION ALL
  SELECT l.n, CASE WHEN l.earlier IS NOT NULL AND list_has_any(w.kept, l.earlier) THEN w.kept ELSE list_append(w.kept, r.row_id) END
  FROM walk w JOIN links l ON l.n = w.n + 1 JOIN ranked r ON r.n = l.n)
SELECT unnest(kept) AS row_id FROM walk WHERE n = (SELECT max(n) FROM ranked)""")
def _(t):
    d = t.table("documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("row_id"), F.col("text").alias("content"))
    return merging.content_dedup(d).select("row_id")


cte("vector_side", "SELECT page_id % 25 AS query_id, page_id FROM parsed_pages")


@query("combine_sources", """
SELECT query_id, tie, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, tie) AS rank FROM (
  SELECT query_id, source || '/' || row_id AS tie, coalesce(score, 0.0) * CASE source WHEN 'go_crawler' THEN 0.5 + 0.5 * (row_id % 10 / 10.0::DOUBLE)
    WHEN 'custom_index' THEN 0.5 + 0.5 * 0.8::DOUBLE ELSE 1.0 END AS s FROM results)""")
def _(t):
    r = results(t).select("query_id", F.concat_ws("/", "source", "row_id").alias("tie"), F.coalesce("score", F.lit(0.0)).alias("score"), "source", "row_id")
    of = lambda s: r.where(F.col("source") == s).drop("source")
    c = retrieval.combine_sources(of("go_crawler").withColumn("alignment", F.col("row_id") % 10 / 10.0), of("searxng"),
                                  of("custom_index").withColumn("vector_score", F.lit(0.8)))
    return c.select("query_id", "tie", r6(F.col("score")).alias("score"), "rank")


# ---------------------------------------------------------------- vectors
@query("embed_text", """
SELECT doc_id, round(list_sum(list_transform(range(384), lambda i: v[i + 1] * (i + 1))) / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS fingerprint,
  384::BIGINT AS dims FROM (
  SELECT doc_id, list_transform(range(384), lambda i: ((b[(i % 16) + 1] + 17 * i) % 100) / 100.0::DOUBLE) AS v FROM (
    SELECT doc_id, list_transform(range(16), lambda r: CAST('0x' || substr(md5(text), 2 * r + 1, 2) AS BIGINT)) AS b FROM documents))""")
def _(t):
    e = retrieval.embed_text(t.table("documents"))
    weighted = F.aggregate(F.zip_with("embedding", F.sequence(F.lit(1), F.lit(384)), lambda x, i: x * i), F.lit(0.0), lambda acc, x: acc + x)
    return e.select("doc_id", r6(weighted).alias("fingerprint"), F.size("embedding").cast("bigint").alias("dims"))


@query("vector_topk", """
SELECT query_id, vec_id, score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM (
    SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
    FROM embeddings a, embeddings b)) WHERE rank <= 5""")
def _(t):
    v = t.table("embeddings").select("vec_id", "embedding")
    return retrieval.vector_topk(v.withColumnRenamed("vec_id", "query_id"), v, 5).select("query_id", "vec_id", "score", "rank")


# the exact form over cells: the same rows as the block join, fewer products
@query("vector_topk_cells", """
SELECT query_id, vec_id, score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM (
    SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
    FROM embeddings a, embeddings b)) WHERE rank <= 5""")
def _(t):
    v = t.table("embeddings").select("vec_id", "embedding")
    return cells.cell_topk(v.withColumnRenamed("vec_id", "query_id"), cells.build_cells(v, 16), 5).select("query_id", "vec_id", "score", "rank")


# every third vector asks for its own label, every fifth for its own parity, the others for anything
@query("vector_topk_filtered", """
WITH v AS (SELECT vec_id, embedding, label, CAST(vec_id % 2 AS INT) AS half FROM embeddings),
q AS (SELECT vec_id AS query_id, embedding, CASE WHEN vec_id % 3 = 0 THEN label END AS label, CASE WHEN vec_id % 5 = 0 THEN half END AS half FROM v)
SELECT query_id, vec_id, score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM (
    SELECT q.query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
    FROM q JOIN v ON (q.label IS NULL OR q.label = v.label) AND (q.half IS NULL OR q.half = v.half))) WHERE rank <= 5""")
def _(t):
    v = t.table("embeddings").select("vec_id", "embedding", "label", (F.col("vec_id") % 2).cast("int").alias("half"))
    q = v.select(F.col("vec_id").alias("query_id"), "embedding", F.when(F.col("vec_id") % 3 == 0, F.col("label")).alias("label"),
                 F.when(F.col("vec_id") % 5 == 0, F.col("half")).alias("half"))
    return cells.filtered_topk(q, v, 5, ["label", "half"]).select("query_id", "vec_id", "score", "rank")


@query("tag_search", """
SELECT page_id, primary_goal, skill_level FROM tagged_pages WHERE primary_goal = 'learn' AND contains('; ' || use_cases || ';', '; learning;') ORDER BY page_id LIMIT 30""")
def _(t):
    d = pg.analyse_pages(parsed(t))
    return retrieval.tag_search(d, goal="learn", use_case="learning", limit=30).select("page_id", "primary_goal", "skill_level")


@query("vector_upsert", """
SELECT md5(url) AS vector_id, url, page_id, 'new' AS origin FROM pages WHERE page_id % 2 = 0
UNION ALL SELECT md5(url), url, page_id, 'old' FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0)""")
def _(t):
    p = t.table("pages").select("url", "page_id")
    current = p.withColumns({"origin": F.lit("old"), "version": F.lit(1)})
    # the same page twice: the newest version counts
    changes = p.where(F.col("page_id") % 2 == 0).select("url", "page_id", F.explode(F.array(*[F.struct(
        F.lit(o).alias("origin"), F.lit(v).alias("version")) for o, v in (("stale", 2), ("new", 3))])).alias("x")).select("url", "page_id", "x.*")
    return retrieval.vector_upsert(current, changes).select("vector_id", "url", "page_id", "origin")


@query("vector_delete", "SELECT url, page_id FROM pages WHERE url NOT IN (SELECT source_url FROM page_links WHERE anchor_text = 'The')")
def _(t):
    gone = pg.extract_links(t.table("pages")).where(F.col("anchor_text") == "The").select(F.col("source_url").alias("url"))
    return retrieval.vector_delete(t.table("pages").select("url", "page_id"), gone)
