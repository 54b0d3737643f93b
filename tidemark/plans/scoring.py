"""Scoring queries: R1s-R8s, SK, U1-U5, M1-M6, J7, J9, J10, S9."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import vocab
from tidemark.functions.text import overlap_ratio, r6
from tidemark.functions.urls import bare_host
from tidemark.operators import filters, intent, matching, ranking, urls
from tidemark.operators import pages as pg
from tidemark.plans.adapters import any_sub, count_sub, first_rule, lit, pick, sql_list
from tidemark.plans.filtering import AD_OK, FAIR, V1, V2, targeted_ads, url_host
from tidemark.plans.intent import (ETHICS_SQL, FREQUENCY_SQL, GOAL_SQL, HORIZON_SQL, NEGATIVE_SQL, RECENCY_SQL, SKILL_SQL,
                                   USE_CASES_SQL, listed)
from tidemark.plans.pages import PAGE, part
from tidemark.plans.registry import cte, query
from tidemark.session import once
from tidemark.sources.testbed import AS_OF, RANK_AS_OF, pick as spark_pick





def vectors(source: str) -> str:
    """(x, v) of the distinct texts x of a source."""
    return (f"SELECT x, list_transform(range(384), lambda i: ((b[(i % 16) + 1] + 17 * i) % 100) / 100.0::DOUBLE) AS v FROM ("
            f"SELECT x, list_transform(range(16), lambda r: CAST('0x' || substr(md5(x), 2 * r + 1, 2) AS BIGINT)) AS b "
            f"FROM (SELECT DISTINCT x FROM ({source})))")


def unit(a: str, b: str) -> str:
    return f"((list_cosine_similarity({a}, {b}) + 1) / 2)"


cte("request_intents", f"""
SELECT query_id, text, t, {GOAL_SQL} AS goal, {USE_CASES_SQL} AS use_cases, {ETHICS_SQL} AS signals, {SKILL_SQL} AS skill_level,
  {HORIZON_SQL} AS horizon, {RECENCY_SQL} AS recency_wish, {FREQUENCY_SQL} AS frequency, {NEGATIVE_SQL} AS negatives
FROM (SELECT *, lower(text) AS t FROM requests)""")


def intents(t):
    """Requests with their intent columns, read off the texts where the join wants them: one file of requests is one task."""
    x = F.col("text")
    return t.requests().repartition("query_id").select(
        "query_id", "text", intent.constraints(x).alias("constraints"), intent.goal(x).alias("goal"),
        intent.use_cases(x).alias("use_cases"), intent.ethical_signals(x).alias("ethical_signals"),
        intent.skill_level(x).alias("skill_level"), intent.temporal(x).alias("temporal"),
        intent.negative_preferences(x).alias("negative_preferences"))


cte("text_vectors", vectors("SELECT text AS x FROM requests UNION ALL SELECT title || ' ' || description FROM candidates "
                            "UNION ALL SELECT lower(array_to_string(tags, ' ')) FROM candidates UNION ALL SELECT unnest("
                            + sql_list([u.replace("_", " ") for u in vocab.USE_CASES]) + ")"))
WORDS = "list_distinct(list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> ''))"


def words(x: str) -> str:
    return WORDS.replace("{x}", x)


def overlap(q: str, c: str) -> str:
    return f"(len(list_intersect({q}, {c})) / nullif(len({q}), 0))"


cte("case_similarity", """
SELECT u.x AS name, c.x AS tag_text, list_cosine_similarity(u.v, c.v) AS cos FROM text_vectors u, text_vectors c
WHERE u.x IN (""" + ", ".join(lit(u.replace("_", " ")) for u in vocab.USE_CASES) + """)
  AND c.x IN (SELECT DISTINCT lower(array_to_string(tags, ' ')) FROM candidates)""")


def case_total(profile: str) -> str:
    near = "(s.cos + 1) / 2 * 0.3::DOUBLE" if profile == "v1" else "CASE WHEN s.cos > 0.5 THEN s.cos * 0.3::DOUBLE ELSE 0 END"
    return (f"(SELECT id, query_id, sum(CASE WHEN contains(tag_text, name) THEN 0.5 ELSE {near} END) AS total "
            f"FROM (SELECT c.id, c.query_id, lower(array_to_string(c.tags, ' ')) AS tag_text, replace(unnest(i.use_cases), '_', ' ') AS name "
            f"FROM candidates c JOIN request_intents i USING (query_id)) JOIN case_similarity s USING (name, tag_text) GROUP BY ALL)")


DAYS = f"floor(date_diff('microsecond', CAST(recency AS TIMESTAMP), TIMESTAMP '{RANK_AS_OF}') / 86400000000.0::DOUBLE)"
OSS = "open-source_preferred"
EX_SKILL_V1 = """CASE WHEN complexity IS NULL THEN 0.5 WHEN skill_level = complexity THEN 1.0
  WHEN (skill_level = 'beginner' AND complexity = 'intermediate') OR (skill_level = 'intermediate' AND complexity IN ('beginner', 'advanced'))
    OR (skill_level = 'advanced' AND complexity IN ('intermediate', 'expert')) THEN 0.8 ELSE 0.2 END::DOUBLE"""
LEVEL = "CASE {x} WHEN 'beginner' THEN 0 WHEN 'intermediate' THEN 1 WHEN 'advanced' THEN 2 ELSE 3 END"
EX_SKILL_V2 = (f"CASE WHEN complexity IS NULL THEN 0.5 WHEN skill_level = complexity THEN 1.0 WHEN abs({LEVEL.replace('{x}', 'skill_level')} - "
               f"{LEVEL.replace('{x}', 'complexity')}) = 1 THEN 0.8 ELSE 0.3 END::DOUBLE")
SIGNAL_TOTAL = "coalesce(list_sum(list_transform(signals, lambda s: CASE WHEN starts_with(s, 'privacy/') THEN {p} WHEN starts_with(s, 'openness/') THEN {o} ELSE 0.0 END::DOUBLE)), 0.0)"
PRIVATE, OPEN = "CASE WHEN privacy_rating > 0.7::DOUBLE THEN 0.5 ELSE 0.0 END", "CASE WHEN opensource THEN 0.5 ELSE 0.0 END"
ETH_V1 = f"CASE WHEN len(signals) = 0 THEN 0.5 ELSE least(1.0, {SIGNAL_TOTAL.replace('{p}', PRIVATE).replace('{o}', OPEN)} / len(signals)) END"
ETH_V2 = "CASE WHEN len(signals) = 0 THEN 0.5 ELSE least(1.0, " + SIGNAL_TOTAL.replace(
    "{p}", f"({PRIVATE} + CASE WHEN {any_sub('lower(description)', vocab.PRIVACY_TEXT_WORDS)} THEN 0.2 ELSE 0.0 END)").replace(
    "{o}", f"({OPEN} + CASE WHEN {any_sub('lower(description)', vocab.OPEN_TEXT_WORDS)} THEN 0.2 ELSE 0.0 END)") + " / len(signals)) END"
TMP_V1 = """0.5::DOUBLE + CASE WHEN recency_wish = 'recent' AND days <= 30 THEN 0.2::DOUBLE WHEN recency_wish = 'recent' AND days <= 180 THEN 0.1::DOUBLE ELSE 0.0 END
  + CASE WHEN horizon = 'today' AND days <= 1 THEN 0.2::DOUBLE ELSE 0.0 END"""
TMP_V2 = """0.5::DOUBLE + CASE WHEN recency_wish = 'recent' AND days <= 30 THEN 0.3::DOUBLE WHEN recency_wish = 'recent' AND days <= 90 THEN 0.1::DOUBLE ELSE 0.0 END
  + CASE WHEN horizon = 'today' AND days <= 1 THEN 0.2::DOUBLE WHEN horizon = 'week' AND days <= 7 THEN 0.15::DOUBLE ELSE 0.0 END"""


def aligned_sql(profile: str) -> str:
    v1 = profile == "v1"
    w = ranking.WEIGHTS_V1 if v1 else ranking.WEIGHTS_V2
    case = ("CASE WHEN len(use_cases) = 0 THEN 0.5 WHEN len(tags) = 0 THEN 0.0 ELSE least(1.0, total / len(use_cases)) END" if v1 else
            "CASE WHEN len(use_cases) = 0 OR len(tags) = 0 THEN 0.5 ELSE least(1.0, total / len(use_cases)) END")
    q = "semantic_score" if v1 else f"semantic_score * 0.7::DOUBLE + {overlap(words('lower(text)'), words('lower(content)'))} * 0.8::DOUBLE * 0.3::DOUBLE"
    return f"""SELECT *, greatest(0, least(1, query_score * {w[0]}::DOUBLE + use_case_score * {w[1]}::DOUBLE + ethical_score * {w[2]}::DOUBLE
  + skill_score * {w[3]}::DOUBLE + temporal_score * {w[4]}::DOUBLE + quality_part * {w[5]}::DOUBLE)) AS alignment_score FROM (
  SELECT *, {q} AS query_score, {case} AS use_case_score, {ETH_V1 if v1 else ETH_V2} AS ethical_score, {EX_SKILL_V1 if v1 else EX_SKILL_V2} AS skill_score,
    least(1, {TMP_V1 if v1 else TMP_V2}) AS temporal_score, coalesce(nullif(quality_score, 0), 0.5) AS quality_part FROM (
    SELECT c.*, i.* EXCLUDE (query_id), r.constraints, c.title || ' ' || c.description AS content, coalesce(k.total, 0) AS total, {DAYS} AS days,
      {unit('a.v', 'b.v')} AS semantic_score
    FROM candidates c JOIN request_intents i USING (query_id) JOIN request_constraints r USING (query_id)
    JOIN text_vectors a ON a.x = i.text JOIN text_vectors b ON b.x = c.title || ' ' || c.description
    LEFT JOIN {case_total(profile)} k ON k.id = c.id AND k.query_id = c.query_id))"""


cte("aligned_v1", aligned_sql("v1"))
cte("aligned_v2", aligned_sql("v2"))


def scored(t, profile="v1"):
    return ranking.score(filters.request_join(intents(t), t.candidates()), RANK_AS_OF, profile)


@query("keyword_overlap", f"""
SELECT query_id, id, round(o, 6) AS overlap, round(o * 0.8::DOUBLE, 6) AS ranked_form, round(o * 0.5 + 0.3::DOUBLE, 6) AS url_form
FROM (SELECT query_id, id, {overlap(words('lower(text)'), words("lower(title || ' ' || description)"))} AS o FROM candidates JOIN requests USING (query_id))""")
def _(t):
    j = filters.request_join(t.requests(), t.candidates()).withColumn("content", F.concat_ws(" ", "title", "description"))
    q, c = F.col("text"), F.col("content")
    return j.select("query_id", "id", r6(overlap_ratio(q, c)).alias("overlap"), r6(ranking.keyword_score_v2(q, c)).alias("ranked_form"),
                    r6(ranking.keyword_score_url(q, c)).alias("url_form"))


@query("semantic_similarity", "SELECT query_id, id, round(semantic_score, 6) AS semantic_score FROM aligned_v1")
def _(t):
    return scored(t).select("query_id", "id", r6(F.col("semantic_score")).alias("semantic_score"))


for _name, _col in [("use_case_alignment", "use_case_score"), ("ethical_alignment", "ethical_score"),
                    ("skill_distance", "skill_score"), ("temporal_alignment", "temporal_score")]:
    query(_name, f"SELECT a.query_id, a.id, round(a.{_col}, 6) AS v1, round(b.{_col}, 6) AS v2 FROM aligned_v1 a JOIN aligned_v2 b USING (query_id, id)")(
        lambda t, col=_col: _both(t, col))


def _both(t, col):
    """A part score under both profiles, from one pass over the joined candidates."""
    rows = ranking.with_similarities(filters.request_join(intents(t), t.candidates()))
    first = ranking.score(rows, RANK_AS_OF, "v1").withColumnRenamed(col, "v1")
    second = ranking.score(first.select(*rows.columns, "v1"), RANK_AS_OF, "v2")
    return second.select("query_id", "id", r6(F.col("v1")).alias("v1"), r6(F.col(col)).alias("v2"))


@query("intent_alignment", """
SELECT a.query_id, a.id, round(a.alignment_score, 6) AS v1, round(b.alignment_score, 6) AS v2
FROM aligned_v1 a JOIN aligned_v2 b USING (query_id, id)""")
def _(t):
    return _both(t, "alignment_score")


@query("rank_results", f"""
SELECT query_id, id, round(alignment_score, 6) AS alignment_score,
  row_number() OVER (PARTITION BY query_id ORDER BY alignment_score DESC, id) AS rank FROM aligned_v1 WHERE {V1}""")
def _(t):
    r = ranking.rank_results(intents(t), t.candidates(), RANK_AS_OF, "v1", columns=[])
    return r.select("query_id", "id", r6(F.col("alignment_score")).alias("alignment_score"), "rank")


cte("candidate_vectors", "SELECT c.query_id, c.id, v FROM candidates c JOIN text_vectors ON x = title || ' ' || description")
cte("filtered_vectors", f"SELECT a.query_id, a.id, v FROM aligned_v2 a JOIN text_vectors ON x = a.content WHERE {V2}")


def dedup_sql(source: str) -> str:
    return f"""
WITH RECURSIVE numbered AS (
  SELECT query_id, id, v, row_number() OVER (PARTITION BY query_id ORDER BY id) AS n FROM {source}),
walk AS (
  SELECT query_id, n, [v] AS kept, [id] AS ids FROM numbered WHERE n = 1
  UNION ALL
  SELECT query_id, n, CASE WHEN dup THEN kept ELSE list_append(kept, v) END, CASE WHEN dup THEN ids ELSE list_append(ids, id) END
  FROM (SELECT x.query_id, x.n, x.v, x.id, w.kept, w.ids,
          len(list_filter(w.kept, lambda k: list_cosine_similarity(k, x.v) > 0.85::DOUBLE)) > 0 AS dup
        FROM walk w JOIN numbered x ON x.query_id = w.query_id AND x.n = w.n + 1)),
longest AS (SELECT query_id, arg_max(ids, n) AS ids FROM walk GROUP BY query_id),
finals AS (SELECT query_id, unnest(ids) AS id FROM longest)
"""


@query("embedding_dedup", dedup_sql("candidate_vectors") + "SELECT query_id, id FROM finals")
def _(t):
    c = t.candidates().select("query_id", "id", "title", "description")
    return ranking.drop_similar(c.dropDuplicates(["query_id", "id"]), columns=[]).select("query_id", "id")


@query("rank_results_v2", dedup_sql("filtered_vectors") + """
SELECT query_id, id, round(alignment_score, 6) AS alignment_score, row_number() OVER (PARTITION BY query_id ORDER BY alignment_score DESC, id) AS rank
FROM finals JOIN aligned_v2 USING (query_id, id)""")
def _(t):
    r = ranking.rank_results(intents(t), t.candidates(), RANK_AS_OF, "v2", columns=[])
    return r.select("query_id", "id", r6(F.col("alignment_score")).alias("alignment_score"), "rank")


# ---------------------------------------------------------------- URLs
def under(h: str, domains) -> str:
    return "(" + " OR ".join(f"{h} = '{d}' OR ends_with({h}, '.{d}')" for d in domains) + ")"


def facts_v1() -> str:
    def known(i, other):
        return "CASE " + " ".join(f"WHEN {under('h', [d])} THEN {v[i]}" for d, v in vocab.PRIVACY_DOMAINS_V1.items()) + f" ELSE {other} END"

    is_known = under("h", list(vocab.PRIVACY_DOMAINS_V1))
    big = f"(NOT {is_known} AND {under('h', vocab.BIG_TECH_V1)})"
    return f"""CAST({known(0, f'CASE WHEN {big} THEN 0.3 ELSE 0.5 END')} AS DOUBLE) AS privacy_score,
  CAST({known(1, f"CASE WHEN {big} THEN 3 WHEN {under('h', vocab.TRACKERS_V1)} THEN 1 ELSE 0 END")} AS INT) AS tracker_count,
  {known(3, 'false')} AS is_open_source, {known(4, 'false')} AS is_non_profit, {big} AS is_big_tech"""


AUTHORITY_SQL = "CAST(CASE " + " ".join(f"WHEN {under('h', [d])} THEN {v}" for d, v in vocab.AUTHORITY_DOMAINS.items()) + " ELSE 0.5 END AS DOUBLE)"


def title_case(x: str) -> str:
    return (f"array_to_string(list_transform(range(1, CAST(length({x}) AS BIGINT) + 1), lambda i: CASE WHEN i > 1 AND regexp_matches(substr({x}, i - 1, 1), '\\p{{L}}') "
            f"THEN lower(substr({x}, i, 1)) ELSE upper(substr({x}, i, 1)) END), '')")


LAST = f"regexp_extract(lower({part('url', 3)}), '([^/]+)/*$', 1)"
CLEAN = f"trim(regexp_replace(translate({LAST}, '-_', '  '), '\\b\\w\\b', '', 'g'))"
TYPE_V1 = first_rule([(k, any_sub("h || ' ' || path", ws)) for k, ws in vocab.CONTENT_TYPE_WORDS_V1], "'general'")
DESCRIBE = "CASE content_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.CONTENT_DESCRIPTION_V1.items()) + " END"
cte("analysed_urls", f"""
SELECT *, {DESCRIBE} || ' from ' || lower({part('url', 2)}) AS description, CASE WHEN clean = '' THEN h ELSE {title_case('clean')} END AS title FROM (
  SELECT query_id, url, h, path, {TYPE_V1} AS content_type, {CLEAN} AS clean, {facts_v1()}, {AUTHORITY_SQL} AS authority_score FROM (
    SELECT query_id, url, {url_host('url')} AS h, lower({part('url', 3)}) AS path FROM request_urls))""")
cte("analysed_urls_v2", f"""
SELECT query_id, url, h, CASE WHEN contains(h, '.') THEN {title_case("translate(split_part(h, '.', -2), '-_', '  ')")} ELSE h END AS title,
  'Web resource from ' || h AS description, {first_rule([(k, any_sub('lower(url)', ws)) for k, ws in vocab.CONTENT_TYPE_WORDS_V2], "'general'")} AS content_type,
  CAST(CASE WHEN h IN ({", ".join(lit(d) for d in vocab.PRIVACY_DOMAINS_V2)}) THEN 0.95 WHEN h IN ({", ".join(lit(d) for d in vocab.BIG_TECH_V2)}) THEN 0.3
    WHEN {under('h', vocab.PRIVACY_DOMAINS_V2)} THEN 0.9 WHEN {under('h', vocab.BIG_TECH_V2)} THEN 0.25
    WHEN {any_sub('h', vocab.TRACKERS_V2)} THEN 0.1 ELSE 0.5 END AS DOUBLE) AS privacy_score,
  CAST({count_sub('h', vocab.TRACKERS_V2)} AS INT) AS tracker_count, {any_sub('h', vocab.OPEN_SOURCE_V2)} AS is_open_source,
  {any_sub('h', vocab.NON_PROFIT_V2)} AS is_non_profit, {under('h', vocab.BIG_TECH_V2)} AS is_big_tech, starts_with(url, 'https') AS encryption_enabled
FROM (SELECT query_id, url, {url_host('url')} AS h FROM request_urls)""")
URL_COLS = ["query_id", "url", "domain", "title", "description", "content_type", "privacy_score", "tracker_count", "is_open_source",
            "is_non_profit", "is_big_tech"]


@query("url_analysis", f"SELECT {', '.join('h AS domain' if c == 'domain' else c for c in URL_COLS)} FROM analysed_urls")
def _(t):
    return urls.analyse_urls(t.request_urls()).select(*URL_COLS)


@query("url_analysis_v2", f"SELECT {', '.join('h AS domain' if c == 'domain' else c for c in URL_COLS)} FROM analysed_urls_v2")
def _(t):
    return urls.analyse_urls_v2(t.request_urls()).select(*URL_COLS)


@query("domain_suffix_lookup", """
SELECT h AS domain, privacy_score, tracker_count, is_open_source, is_big_tech, count(*) AS urls FROM analysed_urls GROUP BY ALL""")
def _(t):
    u = t.request_urls().select(bare_host(F.col("url")).alias("domain")).groupBy("domain").agg(F.count(F.lit(1)).alias("urls"))
    return urls.with_facts(u).select("domain", "privacy_score", "tracker_count", "is_open_source", "is_big_tech", "urls")


@query("domain_authority", "SELECT query_id, url, authority_score FROM analysed_urls")
def _(t):
    hosted = once(t.request_urls(), domain=bare_host(F.col("url")))
    return hosted.select("query_id", "url", urls.authority(F.col("domain")).alias("authority_score"))


QUALITY_SQL = """greatest(0, least(1, 0.6::DOUBLE + CASE WHEN privacy_score > 0.7::DOUBLE THEN 0.15::DOUBLE WHEN privacy_score > 0.5 THEN 0.05::DOUBLE ELSE 0.0 END
  + CASE WHEN tracker_count = 0 THEN 0.15::DOUBLE WHEN tracker_count <= 2 THEN 0.05::DOUBLE WHEN tracker_count > 5 THEN -0.15::DOUBLE ELSE 0.0 END))"""
HAS = "len(list_filter(signals, lambda s: starts_with(s, '{d}/')))"
ETHICS_URL = f"""least(1, 0.5::DOUBLE + CASE WHEN privacy_score > 0.7::DOUBLE THEN {HAS.replace('{d}', 'privacy')} * 0.2::DOUBLE ELSE 0.0 END
  + CASE WHEN is_open_source THEN {HAS.replace('{d}', 'openness')} * 0.2::DOUBLE + 0.15::DOUBLE ELSE 0.0 END + CASE WHEN is_non_profit THEN 0.1::DOUBLE ELSE 0.0 END)"""
ETHICS_V2 = """least(1, 0.5::DOUBLE + CASE WHEN is_open_source THEN 0.3::DOUBLE ELSE 0.0 END + CASE WHEN is_non_profit THEN 0.1::DOUBLE ELSE 0.0 END
  + CASE WHEN privacy_score > 0.7::DOUBLE THEN 0.1::DOUBLE ELSE 0.0 END)"""


@query("url_quality", f"SELECT query_id, url, round({QUALITY_SQL}, 6) AS quality FROM analysed_urls")
def _(t):
    a = urls.analyse_urls(t.request_urls())
    return a.select("query_id", "url", r6(urls.quality(F.col("encryption_enabled"), F.col("privacy_score"), F.col("tracker_count"))).alias("quality"))


@query("url_ethics", f"""
SELECT a.query_id, a.url, round({ETHICS_URL}, 6) AS v1, round(b.e2, 6) AS v2 FROM analysed_urls a JOIN request_intents i USING (query_id)
JOIN (SELECT query_id, url, {ETHICS_V2} AS e2 FROM analysed_urls_v2) b ON b.query_id = a.query_id AND b.url = a.url""")
def _(t):
    a = urls.analyse_urls(filters.request_join(intents(t).select("query_id", "ethical_signals"), t.request_urls()))
    two = once(a, **{f"{n}_v2": c for n, c in urls.facts_v2(F.col("domain")).items() if n in ("privacy_score", "is_open_source", "is_non_profit")})
    return two.select("query_id", "url", r6(urls.ethics(F.col("ethical_signals"), F.col("privacy_score"), F.col("is_open_source"), F.col("is_non_profit"))).alias("v1"),
                      r6(urls.ethics_v2(F.col("privacy_score_v2"), F.col("is_open_source_v2"), F.col("is_non_profit_v2"))).alias("v2"))


cte("url_vectors", vectors("SELECT text AS x FROM requests UNION ALL SELECT concat_ws(' ', title, description, content_type) FROM analysed_urls "
                           "UNION ALL SELECT concat_ws(' ', title, description, h) FROM analysed_urls_v2"))
PROVIDER_OK = "len(list_filter(constraints, lambda c: c.dimension = 'provider' AND len(list_filter(c.values, lambda v: contains(h, lower(v)))) > 0)) = 0"
NAMED = " OR ".join(
    f"(contains(h, '{d}') AND len(list_filter(negatives, lambda p: contains(replace(replace(lower(p), 'no ', ''), 'not ', ''), '{d.replace('.com', '').replace('.', ' ')}'))) > 0)"
    for d in vocab.BIG_TECH_V1)
cte("scored_urls", f"""
SELECT query_id, url, rel * 0.35::DOUBLE + privacy_score * 0.25 + q * 0.2::DOUBLE + e * 0.2::DOUBLE AS final_score FROM (
  SELECT u.query_id, u.url, u.privacy_score, {QUALITY_SQL} AS q, {ETHICS_URL} AS e, {unit('a.v', 'b.v')} AS rel
  FROM analysed_urls u JOIN request_intents i USING (query_id) JOIN request_constraints r USING (query_id)
  JOIN url_vectors a ON a.x = i.text JOIN url_vectors b ON b.x = concat_ws(' ', u.title, u.description, u.content_type)
  WHERE {PROVIDER_OK} AND NOT ({NAMED}) AND privacy_score >= 0.2::DOUBLE AND NOT is_big_tech)""")


@query("rank_urls", """
SELECT query_id, url, round(final_score, 6) AS final_score, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, url) AS rank FROM scored_urls""")
def _(t):
    r = urls.rank_urls(intents(t), t.request_urls(), "v1", 0.2, True, columns=[])
    return r.select("query_id", "url", r6(F.col("final_score")).alias("final_score"), "rank")


@query("rank_urls_counts", """
SELECT query_id, count(*) AS total_urls, count(*) - count(s.final_score) AS filtered_count
FROM request_urls LEFT JOIN scored_urls s USING (query_id, url) GROUP BY query_id""")
def _(t):
    return urls.ranked_counts(t.request_urls(), urls.rank_urls(intents(t), t.request_urls(), "v1", 0.2, True, columns=[]))


@query("rank_urls_v2", f"""
SELECT query_id, url, round(final_score, 6) AS final_score, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, url) AS rank FROM (
  SELECT query_id, url, (rel * 0.4::DOUBLE + p2 * 0.3::DOUBLE + q * 0.2::DOUBLE + e2 * 0.1::DOUBLE) / (0.4::DOUBLE + 0.3::DOUBLE + 0.2::DOUBLE + 0.1::DOUBLE) AS final_score FROM (
    SELECT *, CASE WHEN {HAS.replace('{d}', 'privacy')} > 0 THEN least(1, p1 * 1.1::DOUBLE) ELSE p1 END AS p2,
      CASE WHEN {HAS.replace('{d}', 'openness')} > 0 AND is_open_source THEN least(1, e * 1.2::DOUBLE) ELSE e END AS e2 FROM (
      SELECT u.*, i.signals, {ETHICS_V2} AS e, CASE WHEN encryption_enabled THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS q, {unit('a.v', 'b.v')} AS rel,
        CASE WHEN {any_sub('i.t', vocab.PRIVACY_QUERY_WORDS)} THEN least(1, privacy_score * 1.2::DOUBLE) ELSE privacy_score END AS p1
      FROM analysed_urls_v2 u JOIN request_intents i USING (query_id) JOIN url_vectors a ON a.x = i.text
      JOIN url_vectors b ON b.x = concat_ws(' ', u.title, u.description, u.h) WHERE privacy_score >= 0.28::DOUBLE)))""")
def _(t):
    r = urls.rank_urls(intents(t), t.request_urls(), "v2", 0.28, columns=[])
    return r.select("query_id", "url", r6(F.col("final_score")).alias("final_score"), "rank")


# ---------------------------------------------------------------- ads
AD_WORDS = "CASE goal " + " ".join(f"WHEN '{g}' THEN {count_sub('lower(content)', ws)}" for g, ws in vocab.AD_GOAL_WORDS.items()) + " ELSE 0 END"
TAG_HITS = "len(list_filter(signals, lambda s: len(list_filter({tags}, lambda g: contains(lower(g), split_part(s, '/', 1)) OR contains(lower(g), split_part(s, '/', 2)))) > 0))"


def tag_align(tags: str) -> str:
    return f"CASE WHEN len(signals) = 0 THEN 0.5 ELSE least(1.0, {TAG_HITS.replace('{tags}', tags)} * 0.5 / len(signals)) END"


cte("ad_vectors", vectors("SELECT text AS x FROM requests UNION ALL SELECT title || ' ' || description FROM ads UNION ALL SELECT lower(title || ' ' || description) FROM ads "
                          "UNION ALL SELECT replace(upper(unnest(" + sql_list(vocab.GOALS) + ")), '_', ' ')"))
cte("ad_flags", f"""
SELECT *, fits AND relevance > 0.3::DOUBLE AS relevant FROM (
  SELECT *, greatest(0, least(1, semantic * 0.4::DOUBLE + ethic * 0.3::DOUBLE + goal_score * 0.2::DOUBLE + quality_score * 0.1::DOUBLE)) AS relevance FROM (
    SELECT o.query_id, o.ad_id, d.quality_score, i.goal, i.use_cases, {FAIR} AS fair, {FAIR} AND {AD_OK} AS fits, {unit('a.v', 'b.v')} AS semantic,
      {tag_align('d.ethical_tags')} AS ethic,
      CASE WHEN goal IS NULL THEN 0.5 WHEN {AD_WORDS.replace('content', "d.title || ' ' || d.description")} > 0
        THEN least(1.0, {AD_WORDS.replace('content', "d.title || ' ' || d.description")} * 0.3::DOUBLE) ELSE {unit('g.v', 'l.v')} END AS goal_score
    FROM request_ads o JOIN targeted_ads d USING (ad_id) JOIN request_intents i USING (query_id) JOIN request_constraints r USING (query_id)
    JOIN ad_vectors a ON a.x = i.text JOIN ad_vectors b ON b.x = d.title || ' ' || d.description
    JOIN ad_vectors l ON l.x = lower(d.title || ' ' || d.description) LEFT JOIN ad_vectors g ON g.x = replace(upper(i.goal), '_', ' ')))""")
cte("matched_ads", """
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, ad_id) AS INT) AS rank FROM ad_flags WHERE relevant) WHERE rank <= 5""")


def offered_ads(t):
    return t.request_ads().join(targeted_ads(t), "ad_id")


@query("ad_relevance", "SELECT query_id, ad_id, round(relevance, 6) AS relevance FROM ad_flags")
def _(t):
    r = matching.ad_relevance(filters.request_join(intents(t), offered_ads(t)))
    return r.select("query_id", "ad_id", r6(F.col("relevance")).alias("relevance"))


@query("match_ads", "SELECT query_id, ad_id, round(relevance, 6) AS relevance, rank FROM matched_ads")
def _(t):
    m = matching.match_ads(intents(t), offered_ads(t))
    return m.select("query_id", "ad_id", r6(F.col("relevance")).alias("relevance"), "rank")


@query("match_ads_funnel", """
SELECT query_id, count(*) AS evaluated, count(*) FILTER (fair) AS passed_fairness, count(*) FILTER (fits) AS passed_constraints,
  count(*) FILTER (relevant) AS passed_relevance, count(*) - least(count(*) FILTER (relevant), 5) AS filtered FROM ad_flags GROUP BY query_id""")
def _(t):
    return matching.ad_funnel(intents(t), offered_ads(t))


@query("match_metric_append", f"""
SELECT query_id, ad_id, DATE '{AS_OF[:10]}' AS date, goal AS intent_goal, use_cases[1] AS intent_use_case, 1::BIGINT AS impression_count,
  0::BIGINT AS click_count, 0::BIGINT AS conversion_count, TIMESTAMP '{AS_OF}' + INTERVAL 30 DAY AS expires_at FROM matched_ads""")
def _(t):
    return matching.match_metrics(matching.match_ads(intents(t), offered_ads(t)), AS_OF)


@query("ad_compliance", f"""
SELECT ad_id, 'forbidden_targeting_dimension' AS type, d AS dimension, 'HIGH' AS severity FROM (
  SELECT ad_id, unnest(CASE WHEN t_provider IS NULL THEN ['platform', t_other] ELSE ['platform', 'provider', t_other] END) AS d FROM targeted_ads)
WHERE list_contains({sql_list(vocab.COMPLIANCE_FORBIDDEN_DIMENSIONS)}, lower(d))
UNION ALL SELECT ad_id, 'forbidden_forbidden_dimension', d, 'MEDIUM' FROM (SELECT ad_id, unnest(forbidden) AS d FROM targeted_ads)
WHERE list_contains({sql_list(vocab.COMPLIANCE_FORBIDDEN_DIMENSIONS)}, lower(d))""")
def _(t):
    return matching.ad_compliance(targeted_ads(t))


# ---------------------------------------------------------------- services
SERVICE_SETS = {
    "supported_goals": ["learn,find_information", "purchase", "troubleshooting,comparison", "navigation,local_service"],
    "primary_use_cases": ["learning", "comparison,market research", "troubleshooting guide", ""],
    "temporal_patterns": ["short_session,quick_completion", "long_session", "recurring_edit,real_time"],
    "ethical_alignment": ["privacy", "openness,open-source_preferred", "ethics"],
}
cte("services", "SELECT s_suppkey AS service_id, s_name AS name, " + ", ".join(
    f"list_filter(string_split({pick(v, 's_suppkey')}, ','), lambda x: x <> '') AS {k}" for k, v in SERVICE_SETS.items()) + " FROM supplier")


def request_services(t):
    s = t.table("supplier").select("s_suppkey", *[
        F.filter(F.split(spark_pick(v, F.col("s_suppkey")), ","), lambda x: x != "").alias(k) for k, v in SERVICE_SETS.items()])
    offered = t.table("lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("s_suppkey")).distinct()
    return offered.join(s, "s_suppkey").withColumnRenamed("s_suppkey", "service_id")


cte("service_vectors", vectors(
    "SELECT replace(unnest(" + sql_list(vocab.GOALS + vocab.USE_CASES) + "), '_', ' ') AS x UNION ALL "
    "SELECT replace(array_to_string(supported_goals, ' '), '_', ' ') FROM services UNION ALL SELECT array_to_string(primary_use_cases, ' ') FROM services"))
cte("service_cases", f"""
SELECT service_id, use_case, CASE WHEN len(list_filter(primary_use_cases, lambda c: contains(x, lower(c)) OR contains(lower(c), x))) > 0 THEN 1.0
  ELSE {unit('a.v', 'b.v')} END AS case_score
FROM (SELECT *, replace(use_case, '_', ' ') AS x FROM services, (SELECT unnest({sql_list(vocab.USE_CASES)}) AS use_case)) s
JOIN service_vectors a USING (x) JOIN service_vectors b ON b.x = array_to_string(primary_use_cases, ' ')""")
cte("case_totals", """
SELECT query_id, service_id, sum(case_score) AS total FROM (
  SELECT o.query_id, o.service_id, unnest(i.use_cases) AS use_case FROM offered_services o JOIN request_intents i USING (query_id))
JOIN service_cases USING (service_id, use_case) GROUP BY ALL""")
cte("offered_services", "SELECT DISTINCT l_orderkey AS query_id, l_suppkey AS service_id FROM lineitem")
HAS_P = "list_has_any(temporal_patterns, ['{a}', '{b}'])"


def has_p(a, b):
    return HAS_P.replace("{a}", a).replace("{b}", b)


@query("recommend_services", f"""
SELECT query_id, service_id, round(score, 6) AS service_score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, service_id) AS rank FROM (
  SELECT query_id, service_id, greatest(0, least(1, goal_score * 0.4::DOUBLE + case_score * 0.3::DOUBLE + temporal * 0.15::DOUBLE + ethic * 0.15::DOUBLE)) AS score FROM (
    SELECT o.query_id, o.service_id, CASE WHEN goal IS NULL THEN 0.5 WHEN list_contains(supported_goals, goal) THEN 1.0 ELSE {unit('g.v', 'sg.v')} END AS goal_score,
      CASE WHEN len(use_cases) = 0 THEN 0.5 WHEN len(primary_use_cases) = 0 THEN 0.0 ELSE least(1.0, k.total / len(use_cases)) END AS case_score,
      0.5::DOUBLE + CASE WHEN horizon = 'today' AND {has_p('short_session', 'quick_access')} THEN 0.2::DOUBLE
        WHEN horizon IN ('week', 'longterm') AND {has_p('long_session', 'extended_work')} THEN 0.2::DOUBLE ELSE 0.0 END
      + CASE WHEN frequency = 'recurring' AND {has_p('recurring_edit', 'regular_updates')} THEN 0.15::DOUBLE
        WHEN frequency = 'oneoff' AND {has_p('one_time_task', 'quick_completion')} THEN 0.15::DOUBLE ELSE 0.0 END
      + CASE WHEN recency_wish = 'recent' AND {has_p('real_time', 'live_updates')} THEN 0.1::DOUBLE ELSE 0.0 END AS temporal,
      {tag_align('s.ethical_alignment')} AS ethic
    FROM offered_services o JOIN services s USING (service_id) JOIN request_intents i USING (query_id)
    LEFT JOIN case_totals k ON k.query_id = o.query_id AND k.service_id = o.service_id
    LEFT JOIN service_vectors g ON g.x = replace(i.goal, '_', ' ') JOIN service_vectors sg ON sg.x = replace(array_to_string(supported_goals, ' '), '_', ' '))
) WHERE score > 0.1::DOUBLE""")
def _(t):
    r = matching.recommend_services(intents(t), request_services(t))
    return r.select("query_id", "service_id", r6(F.col("service_score")).alias("service_score"), "rank")


# ---------------------------------------------------------------- documents against queries
cte("document_intents", f"""
SELECT doc_id, {PAGE['page_goal'][1]} AS doc_goal, {PAGE['page_use_cases'][1]} AS doc_use_cases, {PAGE['page_complexity'][1]} AS doc_complexity,
  {PAGE['page_ethical_signals'][1]} AS doc_signals, CASE doc_id % 3 WHEN 0 THEN 'recent' WHEN 1 THEN 'evergreen' END AS doc_recency FROM phrased_documents""")
RELATED = "CASE goal " + " ".join(f"WHEN '{g}' THEN doc_goal IN ({', '.join(lit(r) for r in rs)})" for g, rs in vocab.RELATED_GOALS.items()) + " ELSE false END"


def document_intents(t):
    from tidemark.plans.pages import phrased

    x = F.col("t")
    return phrased(t).select(
        "doc_id", pg.page_goal(x).alias("doc_goal"), pg.page_use_cases(x).alias("doc_use_cases"), pg.page_complexity(x).alias("doc_complexity"),
        pg.page_ethical_signals(x).alias("doc_ethical_signals"),
        F.when(F.col("doc_id") % 3 == 0, "recent").when(F.col("doc_id") % 3 == 1, "evergreen").alias("doc_recency"))


@query("doc_query_alignment", f"""
SELECT query_id, doc_id, round(goal_m * 0.35::DOUBLE + case_m * 0.25 + level_m * 0.15::DOUBLE + ethic_m * 0.15::DOUBLE + temporal_m * 0.1::DOUBLE, 6) AS alignment FROM (
  SELECT query_id, doc_id, CASE WHEN doc_goal = goal THEN 1.0 WHEN {RELATED} THEN 0.6 ELSE 0.0 END::DOUBLE AS goal_m,
    CASE WHEN len(use_cases) > 0 THEN len(list_intersect(string_split(doc_use_cases, '; '), use_cases)) / len(use_cases) ELSE 0 END AS case_m,
    CASE WHEN (doc_complexity, skill_level) IN (('simple', 'beginner'), ('moderate', 'intermediate'), ('advanced', 'advanced')) THEN 1.0
      WHEN abs(CASE doc_complexity WHEN 'simple' THEN 0 WHEN 'moderate' THEN 1 ELSE 2 END - CASE skill_level WHEN 'beginner' THEN 0 WHEN 'intermediate' THEN 1 ELSE 2 END) = 1
      THEN 0.7 ELSE 0.3 END::DOUBLE AS level_m,
    CASE WHEN len(signals) > 0 THEN len(list_filter(signals, lambda s: contains('; ' || doc_signals, '; ' || split_part(s, '/', 1) || '/'))) / len(signals) ELSE 0 END AS ethic_m,
    CASE WHEN doc_recency = recency_wish THEN 1.0 ELSE 0.5 END AS temporal_m
  FROM document_intents JOIN request_intents ON query_id % (SELECT max(doc_id) + 1 FROM documents) = doc_id)""")
def _(t):
    # every request has a document, dealt in turn, and every document its requests
    last = t.table("documents").agg(F.max("doc_id")).first()[0]
    rows = document_intents(t).join(intents(t), F.col("doc_id") == F.pmod("query_id", F.lit((last or 0) + 1)))
    return matching.alignment(rows).select("query_id", "doc_id", r6(F.col("alignment")).alias("alignment"))


# ---------------------------------------------------------------- small pieces
@query("match_reasons", """
SELECT query_id, url, array_to_string(list_slice(list_concat(list_filter([
  CASE WHEN goal IS NOT NULL THEN 'Matches ' || goal || ' intent' END, CASE WHEN len(use_cases) > 0 THEN 'Suitable for ' || use_cases[1] END,
  CASE WHEN privacy_score > 0.8::DOUBLE THEN 'High privacy rating' WHEN privacy_score > 0.5 THEN 'Good privacy rating' END], lambda x: x IS NOT NULL),
  list_transform(signals, lambda s: 'Aligns with ' || split_part(s, '/', 1) || ' values')), 1, 3), '; ') AS reasons
FROM analysed_urls JOIN request_intents USING (query_id)""")
def _(t):
    a = urls.analyse_urls(filters.request_join(intents(t), t.request_urls()))
    reasons = ranking.match_reasons(F.col("goal"), F.col("use_cases"), F.col("privacy_score"), F.col("ethical_signals"))
    return a.select("query_id", "url", F.array_join(reasons, "; ").alias("reasons"))


@query("result_origin_lookup", """
SELECT s.query_id, s.url, round(s.final_score, 6) AS final_score, a.title, a.content_type
FROM scored_urls s LEFT JOIN analysed_urls a ON a.query_id = s.query_id AND a.url = s.url""")
def _(t):
    ranked = urls.rank_urls(intents(t), t.request_urls(), "v1", 0.2, True, columns=[]).select("query_id", "url", r6(F.col("final_score")).alias("final_score"))
    return ranking.origin(ranked, urls.analyse_urls(t.request_urls()).select("query_id", "url", "title", "content_type"))


@query("set_overlap_join", f"""
SELECT query_id, id, round(CASE WHEN len(l) = 0 OR len(r) = 0 THEN 0 ELSE len(list_intersect(l, r)) / len(list_distinct(list_concat(l, r))) END, 6) AS jaccard
FROM (SELECT c.query_id, c.id, {words('lower(c.description)')} AS l, {words('lower(q.text)')} AS r FROM candidates c JOIN requests q USING (query_id))""")
def _(t):
    left = t.candidates().select("query_id", "id", F.col("description").alias("lt"))
    right = t.requests().select("query_id", F.col("text").alias("rt"))
    return ranking.overlap_pairs(left, right, "query_id").select("query_id", "id", r6(F.col("jaccard")).alias("jaccard"))
