"""Topic and seed queries: T1-T9, A14, WN10."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import vocab
from tidemark.functions.text import r6
from tidemark.functions.urls import part as spark_part
from tidemark.operators import graph, topics
from tidemark.plans.adapters import any_sub, count_sub, first_rule, lit, sql_list
from tidemark.plans.graph import queue, visited
from tidemark.plans.pages import part
from tidemark.plans.registry import cte, query
from tidemark.sources.testbed import AS_OF

KEYWORDS = (f"list_filter(list_distinct(list_filter(string_split_regex(t, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^[a-z0-9]{{2,}}$'))), "
            f"lambda w: NOT list_contains({sql_list(vocab.TOPIC_STOP_WORDS)}, w))")
cte("query_words", f"SELECT query_id, t, ts, {KEYWORDS} AS keywords FROM (SELECT *, lower(text) AS t FROM queries)")


@query("query_keywords", "SELECT query_id, array_to_string(list_sort(keywords), ' ') AS keywords FROM query_words")
def _(t):
    return t.queries().select("query_id", F.array_join(F.array_sort(topics.query_keywords(F.col("text"))), " ").alias("keywords"))


def category_score(c) -> str:
    name, keywords, patterns, _, _ = c
    return f"{count_sub('t', keywords)} * 3 + " + " + ".join(f"CAST(regexp_matches(t, {lit(p)}) AS INT) * 5" for p in patterns)


CATEGORY = ("(SELECT CASE WHEN m.s > 0 THEN m.v ELSE 'programming' END FROM (SELECT list_max([" + ", ".join(
    f"{{'s': {category_score(c)}, 'o': {-i}, 'v': {lit(c[0])}}}" for i, c in enumerate(vocab.TOPIC_CATEGORIES)) + "]) AS m))")


@query("categorise_query", f"SELECT query_id, {CATEGORY} AS category FROM query_words")
def _(t):
    return t.queries().select("query_id", topics.categorise_query(F.col("text")).alias("category"))


cte("trending", f"""
SELECT keyword, CAST(floor(score) AS BIGINT) AS frequency, score / (SELECT count(*) FROM query_words WHERE len(keywords) > 0 AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR) AS recency_score, score
FROM (SELECT keyword, round(sum(greatest(0.1::DOUBLE, 1 - age / 24)), 9) AS score FROM (
  SELECT unnest(keywords) AS keyword, date_diff('microsecond', ts, TIMESTAMP '{AS_OF}') / 3600000000.0::DOUBLE AS age FROM query_words
  WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR) GROUP BY keyword) ORDER BY score DESC, keyword LIMIT 50""")


@query("trending_keywords", "SELECT keyword, frequency, round(recency_score, 6) AS recency_score, round(score, 6) AS score FROM trending")
def _(t):
    return topics.trending_keywords(t.queries(), AS_OF).select("keyword", "frequency", r6(F.col("recency_score")).alias("recency_score"), r6(F.col("score")).alias("score"))


KEYWORD_CATEGORY = first_rule([(name, f"(keyword IN ({', '.join(lit(k) for k in ks)}) OR " + " OR ".join(f"regexp_matches(keyword, {lit(p)})" for p in ps) + ")")
                               for name, ks, ps, _, _ in vocab.TOPIC_CATEGORIES], "'programming'")
RELATED = "CASE category " + " ".join(f"WHEN '{n}' THEN {sql_list(rel[:2])}" for n, _, _, _, rel in vocab.TOPIC_CATEGORIES) + " END"
cte("candidate_topics", f"""
SELECT *, keyword || ' ' || unnest(list_concat({sql_list(vocab.TOPIC_SUFFIXES)}, {RELATED})) AS topic FROM (SELECT *, {KEYWORD_CATEGORY} AS category FROM trending)""")


@query("topic_candidates", "SELECT keyword, category, topic FROM candidate_topics")
def _(t):
    return topics.topic_candidates(topics.trending_keywords(t.queries(), AS_OF)).select("keyword", "category", "topic")


HITS = "CASE category " + " ".join(f"WHEN '{c[0]}' THEN {count_sub('lower(topic)', c[1])}" for c in vocab.TOPIC_CATEGORIES) + " END"
VALID = "CASE category " + " ".join(f"WHEN '{c[0]}' THEN {any_sub('lower(topic)', c[3])}" for c in vocab.TOPIC_CATEGORIES) + " END"
# RE2 has no back references: the repeated character is spelled out
REPEATED = "(" + " OR ".join(f"contains(topic, '{ch * 4}')" for ch in "abcdefghijklmnopqrstuvwxyz0123456789 ") + ")"
cte("confident_topics", f"""
SELECT *, {VALID} AS valid, least(1, ln(frequency + 1) / ln(10)) * 0.4::DOUBLE + recency_score * 0.3::DOUBLE
  + CASE WHEN {HITS} > 0 THEN least(1, 0.5 + {HITS} * 0.25) WHEN {VALID} THEN 0.7 ELSE 0.3 END::DOUBLE * 0.2::DOUBLE
  + greatest(0, 1 - CASE WHEN length(topic) < 5 THEN 0.3 ELSE 0 END::DOUBLE - CASE WHEN {REPEATED} THEN 0.4 ELSE 0 END::DOUBLE) * 0.1::DOUBLE AS confidence FROM candidate_topics""")


@query("topic_confidence", "SELECT keyword, topic, round(confidence, 6) AS confidence FROM confident_topics")
def _(t):
    c = topics.topic_confidence(topics.topic_candidates(topics.trending_keywords(t.queries(), AS_OF)))
    return c.select("keyword", "topic", r6(F.col("confidence")).alias("confidence"))


cte("known_topics", """
SELECT DISTINCT CASE WHEN conv_id % 2 = 0 THEN 'python' ELSE 'devops' END AS category, CASE WHEN conv_id % 2 = 0 THEN 'django tutorial' ELSE 'Examples docker' END AS topic
FROM conversations""")


@query("topic_expansion", """
SELECT category, topic, round(confidence, 6) AS confidence, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY score DESC, topic) AS INT) AS rank FROM confident_topics c
  WHERE frequency >= 2 AND confidence >= 0.45::DOUBLE AND valid AND NOT EXISTS (SELECT 1 FROM known_topics k WHERE k.category = c.category
    AND len(list_intersect(string_split(lower(k.topic), ' '), string_split(lower(c.topic), ' '))) / len(list_distinct(list_concat(string_split(lower(k.topic), ' '), string_split(lower(c.topic), ' ')))) >= 0.85::DOUBLE)
) WHERE rank <= 50""")
def _(t):
    even = F.col("conv_id") % 2 == 0
    known = t.table("conversations").select(F.when(even, "python").otherwise("devops").alias("category"),
                                            F.when(even, "django tutorial").otherwise("Examples docker").alias("topic")).distinct()
    e = topics.expand_topics(t.queries(), known, AS_OF, 0.45)
    return e.select("category", "topic", r6(F.col("confidence")).alias("confidence"), "rank")


@query("keyword_counts", """
SELECT keyword, count(*) AS count FROM (SELECT unnest(keywords) AS keyword FROM query_words) GROUP BY keyword ORDER BY count DESC, keyword LIMIT 1000""")
def _(t):
    return topics.keyword_counts(t.queries())


@query("category_counts", f"SELECT {CATEGORY} AS category, count(*) AS count FROM query_words WHERE len(keywords) > 0 GROUP BY ALL")
def _(t):
    return topics.category_counts(t.queries())


# pages as answers to topics, ten a topic
cte("seed_candidates", """
SELECT 'topic' || page_id // 10 AS topic, url, title, 'e' || page_id % 3 AS engine, page_id % 10 AS position, page_id % 6 AS n_engines,
  CASE WHEN page_id % 4 = 0 THEN '' ELSE title END AS content, CASE WHEN page_id % 5 = 0 THEN 'x.png' END AS thumbnail FROM parsed_pages""")
cte("scored_seeds", f"""
SELECT topic, url, title, engine, position, {part('url', 2)} AS domain, greatest(0, 1 - position / 20) * 0.4::DOUBLE + least(1, n_engines / 5) * 0.3::DOUBLE
  + CASE WHEN length(content) > 0 THEN 0.15::DOUBLE ELSE 0.0 END + CASE WHEN length(thumbnail) > 0 THEN 0.1::DOUBLE ELSE 0.0 END
  + CASE WHEN {any_sub(part('url', 2), vocab.AUTHORITATIVE_PATTERNS)} THEN 0.15::DOUBLE ELSE 0.0 END AS score FROM seed_candidates""")
cte("domain_firsts", """
SELECT * FROM scored_seeds WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY domain ORDER BY score DESC, topic, position, url) = 1""")
cte("seeds", """
SELECT * FROM (SELECT * FROM domain_firsts QUALIFY row_number() OVER (PARTITION BY topic ORDER BY position, url) <= 4)
QUALIFY row_number() OVER (PARTITION BY url ORDER BY score DESC, topic) = 1""")


def seed_candidates(t):
    from tidemark.operators.pages import html_to_page

    k = F.col("page_id")
    return html_to_page(t.table("pages")).select(
        F.concat(F.lit("topic"), F.expr("page_id div 10").cast("string")).alias("topic"), "url", "title", F.concat(F.lit("e"), (k % 3).cast("string")).alias("engine"),
        (k % 10).alias("position"), (k % 6).alias("n_engines"), F.when(k % 4 == 0, "").otherwise(F.col("title")).alias("content"),
        F.when(k % 5 == 0, "x.png").alias("thumbnail"))


@query("seed_url_score", "SELECT topic, url, position, round(score, 6) AS score FROM scored_seeds")
def _(t):
    return seed_candidates(t).select("topic", "url", "position", r6(topics.seed_score(
        F.col("position"), F.col("n_engines"), F.col("content"), F.col("thumbnail"), F.col("url"))).alias("score"))


@query("first_seen_per_domain", "SELECT domain, url, topic, round(score, 6) AS score FROM domain_firsts")
def _(t):
    c = seed_candidates(t)
    s = c.select("topic", "url", "title", "engine", "position", spark_part(F.col("url"), 2).alias("domain"), topics.seed_score(
        F.col("position"), F.col("n_engines"), F.col("content"), F.col("thumbnail"), F.col("url")).alias("score"))
    firsts = topics.first_seen_per_domain(s.where(F.col("score") >= 0.5))
    return firsts.select("domain", "url", "topic", r6(F.col("score")).alias("score"))


@query("discover_seeds", "SELECT topic, url, domain, position, round(score, 6) AS score FROM seeds")
def _(t):
    return topics.discover_seeds(seed_candidates(t), 4).select("topic", "url", "domain", "position", r6(F.col("score")).alias("score"))


@query("inject_seeds", """
SELECT * FROM (SELECT * FROM queue WHERE priority < 3) UNION ALL SELECT url, 8, 0, 'pending', TIMESTAMP '2024-02-01 00:00:00' FROM seeds
WHERE url NOT IN (SELECT url FROM visited) AND url NOT IN (SELECT url FROM queue WHERE priority < 3)""")
def _(t):
    seeds = topics.discover_seeds(seed_candidates(t), 4)
    return topics.inject_seeds(queue(t).where(F.col("priority") < 3), seeds, visited(t), 8, "2024-02-01 00:00:00")
