"""Page queries: D1-D15, P12, P18, P19."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import vocab
from tidemark.functions.text import r6
from tidemark.operators import pages as pg
from tidemark.plans.adapters import any_sub, count_sub, first_rule, lit, pick, sql_list
from tidemark.plans.intent import ethics, joined, listed, when_list
from tidemark.plans.registry import cte, query
from tidemark.sources import testbed as tb
from tidemark.sources.testbed import PHRASES


def unescape(expr: str) -> str:
    for entity, char in pg.ENTITIES:
        expr = f"replace({expr}, {lit(entity)}, {lit(char)})"
    return expr


cte("parsed_pages", f"""
SELECT page_id, url, {unescape("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
  trim(replace({unescape("regexp_replace(regexp_replace(CASE WHEN regexp_matches(html, '(?i)<body(\\s[^>]*)?>') THEN regexp_extract(html, '(?is)<body(?:\\s[^>]*)?>(.*?)(?:</body>|$)', 1) ELSE regexp_replace(html, '(?is)<title[^>]*>.*?</title>', '', 'g') END, '(?s)<!--.*?-->', '', 'g'), '<[^>]+>', '', 'g')")}, chr(10), ' ')) AS content,
  {unescape("regexp_extract(html, '(?is)<meta\\s+name=\"description\"\\s+content=\"([^\"]*)\"', 1)")} AS meta_description,
  length(html) AS content_length FROM pages""")
cte("page_texts", """
SELECT *, lower(text) AS t FROM (
  SELECT *, concat_ws(' ', nullif(title, ''), nullif(content, ''), nullif(meta_description, '')) AS text FROM parsed_pages)""")


@query("html_to_page", "SELECT page_id, url, title, md5(content) AS content_md5, length(content) AS content_chars, meta_description, content_length FROM parsed_pages")
def _(t):
    p = pg.html_to_page(t.table("pages"))
    return p.select("page_id", "url", "title", F.md5("content").alias("content_md5"),
                    F.length("content").cast("bigint").alias("content_chars"), "meta_description", "content_length")


LINK = """'(?is)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)[^>]*>(.*?)</a>'"""
cte("link_parts", f"""
SELECT page_id, url, CASE WHEN ord(quoted) IN (34, 39) THEN substr(quoted, 2, length(quoted) - 2) ELSE quoted END AS href, anchor FROM (
  SELECT page_id, url, unnest(regexp_extract_all(seen, {LINK}, 1)) AS quoted, unnest(regexp_extract_all(seen, {LINK}, 2)) AS anchor
  FROM (SELECT *, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script[^>]*>.*?</script>', '', 'g') AS seen FROM pages))""")
SPLIT = r"'^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$'"


def part(url: str, group: int) -> str:
    return f"regexp_extract({url}, {SPLIT}, {group})"


cte("page_links", f"""
SELECT source_page_id, source_url, target_url, anchor_text, 'dofollow' AS link_type FROM (
  SELECT page_id AS source_page_id, url AS source_url, trim({unescape("regexp_replace(anchor, '<[^>]+>', '', 'g')")}) AS anchor_text,
    array_to_string(list_transform(string_split(raw, ''), lambda c: CASE WHEN c = ' ' THEN '%20'
      WHEN ord(c) > 127 THEN url_encode(c) ELSE c END), '') AS target_url FROM (
    SELECT page_id, url, anchor, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h
      WHEN starts_with(h, '//') THEN {part('url', 1)} || ':' || h
      WHEN starts_with(h, '/') THEN {part('url', 1)} || '://' || {part('url', 2)} || h
      ELSE {part('url', 1)} || '://' || {part('url', 2)} || '/' || h END AS raw
    FROM (SELECT *, {unescape('href')} AS h FROM link_parts)))
WHERE lower({part('target_url', 2)}) <> '' AND NOT {any_sub(f"lower({part('target_url', 2)})", vocab.CRAWL_BLOCKED_DOMAINS)}
  AND NOT {any_sub('lower(target_url)', vocab.CRAWL_SKIP_PATTERNS)}""")


@query("extract_links", "SELECT * FROM page_links")
def _(t):
    return pg.extract_links(t.table("pages"))


@query("crawlable_url", f"""
SELECT source_page_id, target_url,
  NOT ({any_sub('lower(target_url)', vocab.SEED_SKIP_WORDS)} OR {" OR ".join(f"ends_with(lower(target_url), '{e}')" for e in vocab.SEED_SKIP_EXTENSIONS)}) AS seedable,
  {any_sub('target_url', vocab.KNOWN_DOMAINS)} AS known FROM page_links
UNION ALL SELECT query_id, url,
  NOT ({any_sub('lower(url)', vocab.SEED_SKIP_WORDS)} OR {" OR ".join(f"ends_with(lower(url), '{e}')" for e in vocab.SEED_SKIP_EXTENSIONS)}),
  {any_sub('url', vocab.KNOWN_DOMAINS)} FROM request_urls
  WHERE NOT {any_sub(f"lower({part('url', 2)})", vocab.CRAWL_BLOCKED_DOMAINS)} AND NOT {any_sub('lower(url)', vocab.CRAWL_SKIP_PATTERNS)}""")
def _(t):
    links = pg.extract_links(t.table("pages")).select("source_page_id", "target_url")
    urls = pg.crawlable_urls(t.request_urls(), "url").select(
        F.col("query_id").alias("source_page_id"), F.col("url").alias("target_url"))
    u = F.col("target_url")
    return links.unionByName(urls).select("source_page_id", "target_url", pg.crawlable_seed(u).alias("seedable"),
                                          pg.known_domain(u).alias("known"))


def hit(p: str) -> str:
    return f"regexp_matches(t, {lit(p)})"


def tally(patterns, order, default) -> str:
    scores = {v: " + ".join(f"CAST({hit(p)} AS INT)" for p, x in patterns if x == v) for v in order}
    structs = ", ".join(f"{{'s': {s}, 'o': {-i}, 'v': {lit(v)}}}" for i, (v, s) in enumerate(scores.items()))
    return f"(SELECT CASE WHEN m.s > 0 THEN m.v ELSE {lit(default)} END FROM (SELECT list_max([{structs}]) AS m))"


PAGE = {
    "page_goal": (pg.page_goal, tally(vocab.PAGE_GOAL_PATTERNS, vocab.PAGE_GOAL_ORDER, "learn")),
    "page_use_cases": (lambda t: listed(pg.page_use_cases(t)),
                       f"coalesce(nullif({joined(when_list([(lit(v), hit(p)) for p, v in vocab.PAGE_USE_CASE_PATTERNS]))}, ''), 'learning')"),
    "page_complexity": (pg.page_complexity, tally(vocab.PAGE_COMPLEXITY_PATTERNS, [v for _, v in vocab.PAGE_COMPLEXITY_PATTERNS], "moderate")),
    "page_result_type": (pg.page_result_type, tally(vocab.PAGE_RESULT_TYPE_PATTERNS, [v for _, v in vocab.PAGE_RESULT_TYPE_PATTERNS], "tutorial")),
    "page_ethical_signals": (lambda t: ethics(pg.page_ethical_signals(t)),
                             joined(when_list([(lit(f"{d}/{v}"), hit(p)) for p, d, v in vocab.PAGE_ETHICAL_PATTERNS]))),
    "page_skill_level": (pg.page_skill_level,
                         f"(SELECT CASE WHEN a > b THEN 'advanced' WHEN b > 0 THEN 'beginner' ELSE 'intermediate' END FROM "
                         f"(SELECT len(regexp_extract_all(t, {lit(vocab.PAGE_ADVANCED_PATTERN)})) AS a, "
                         f"len(regexp_extract_all(t, {lit(vocab.PAGE_BEGINNER_PATTERN)})) AS b))"),
    "key_phrases": (lambda t: listed(pg.key_phrases(t)), joined(when_list([(lit(p), f"contains(t, {lit(p)})") for p in vocab.KEY_PHRASES]))),
}
# the given prose seldom hits a keyword: documents get a leading phrase, pages are used as they are
cte("phrased_documents", f"SELECT doc_id, lower({pick(PHRASES, 'doc_id')} || ' ' || text) AS t FROM documents")


def phrased(t):
    return t.table("documents").select("doc_id", F.lower(F.concat_ws(" ", tb.pick(PHRASES, F.col("doc_id")), F.col("text"))).alias("t"))


for _name, (_column, _sql) in PAGE.items():
    query(_name, f"SELECT doc_id, {_sql} AS {_name} FROM phrased_documents")(
        lambda t, name=_name, column=_column: phrased(t).select("doc_id", column(F.col("t")).alias(name)))

TOPIC_WORDS = f"""list_filter(list_transform(string_split_regex(text, '\\s+'), lambda w: trim(lower(w), {lit(vocab.PAGE_TRIM_CHARS)})),
  lambda w: strlen(w) > 4 AND NOT list_contains({sql_list(vocab.PAGE_STOP_WORDS)}, w))"""
cte("page_topic_counts", f"""
SELECT page_id, topic, count(*) AS count FROM (SELECT page_id, unnest({TOPIC_WORDS}) AS topic FROM page_texts) GROUP BY ALL""")


def with_text(t):
    p = pg.html_to_page(t.table("pages"))
    return p.withColumn("text", pg.analysis_text(F.col("title"), F.col("content"), F.col("meta_description")))


@query("page_topics", """
SELECT page_id, topic, count, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY count DESC, topic) AS INT) AS rank FROM page_topic_counts) WHERE rank <= 10""")
def _(t):
    return pg.page_topics(with_text(t))


CONFIDENCE = """least(0.95::DOUBLE, 0.5::DOUBLE + 0.1::DOUBLE + CASE WHEN ethical_signals <> '' THEN 0.1::DOUBLE ELSE 0.0 END + 0.1::DOUBLE
  + CASE WHEN n_topics > 5 THEN 0.1::DOUBLE ELSE 0.0 END)"""
cte("tagged_pages", f"""
SELECT *, {CONFIDENCE} AS confidence FROM (
  SELECT page_id, title, url, content, meta_description, t, {PAGE['page_goal'][1]} AS primary_goal, {PAGE['page_use_cases'][1]} AS use_cases, {PAGE['page_complexity'][1]} AS complexity,
    {PAGE['page_result_type'][1]} AS result_type, {PAGE['page_ethical_signals'][1]} AS ethical_signals, {PAGE['page_skill_level'][1]} AS skill_level,
    {PAGE['key_phrases'][1]} AS key_phrases, len(list_distinct({TOPIC_WORDS})) AS n_topics,
    len(regexp_extract_all(content, '[A-Za-z]+')) AS word_count FROM page_texts)""")
cte("indexed_pages", """
SELECT *, least(1.0, 0.5::DOUBLE + CASE WHEN word_count > 1000 THEN 0.15::DOUBLE WHEN word_count > 500 THEN 0.1::DOUBLE WHEN word_count > 200 THEN 0.05::DOUBLE ELSE 0.0 END
  + CASE WHEN confidence > 0.8::DOUBLE THEN 0.15::DOUBLE WHEN confidence > 0.6::DOUBLE THEN 0.1::DOUBLE WHEN confidence > 0.4::DOUBLE THEN 0.05::DOUBLE ELSE 0.0 END
  + CASE WHEN ethical_signals <> '' THEN 0.05::DOUBLE ELSE 0.0 END) AS quality_score FROM tagged_pages""")


@query("extraction_confidence", "SELECT page_id, primary_goal, use_cases, round(confidence, 6) AS confidence FROM tagged_pages")
def _(t):
    a = pg.analyse_pages(pg.html_to_page(t.table("pages")))
    return a.select("page_id", "primary_goal", listed(F.col("use_cases")).alias("use_cases"), r6(F.col("confidence")).alias("confidence"))


@query("quality_score", "SELECT page_id, word_count, round(quality_score, 6) AS quality_score FROM indexed_pages")
def _(t):
    a = pg.analyse_pages(pg.html_to_page(t.table("pages")))
    return a.select("page_id", "word_count", r6(F.col("quality_score")).alias("quality_score"))


cte("page_terms", """
SELECT page_id, term, count(*) AS tf FROM (
  SELECT page_id, lower(unnest(regexp_extract_all(content, '[A-Za-z]+'))) AS term FROM parsed_pages) WHERE length(term) > 2 GROUP BY ALL""")


@query("term_frequencies", "SELECT * FROM page_terms")
def _(t):
    return pg.term_frequencies(pg.html_to_page(t.table("pages")))


cte("web_pages", rf"""
SELECT *, lower(text) AS t, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}_]+'),
  lambda w: regexp_matches(w, '^[a-z]{{3,}}$') AND NOT list_contains({sql_list(vocab.WEB_STOP_WORDS)}, w)) AS terms FROM (
  SELECT page_id, url, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title,
    trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages)""")
WEB_SCORES = ", ".join(f"{{'s': {count_sub('t', ws)}, 'o': {-i}, 'v': {lit(g)}}}" for i, (g, ws) in enumerate(vocab.WEB_GOAL_WORDS))


@query("web_page_intent", f"""
SELECT page_id, title, left(text, 200) AS description, goal AS primary_goal, array_to_string(cases, '; ') AS use_cases, result_type,
  CASE WHEN n < 500 OR average < 10 THEN 'simple' WHEN n > 2000 OR average > 25 THEN 'advanced' ELSE 'moderate' END AS complexity, skill_level,
  round(least(1.0, 0.5::DOUBLE + CASE WHEN goal <> 'find_information' THEN 0.15::DOUBLE ELSE 0.0 END
    + CASE WHEN len(cases) > 1 THEN 0.1::DOUBLE * least(len(cases), 3) ELSE 0.0 END
    + CASE WHEN len(list_distinct(terms)) >= 3 THEN 0.1::DOUBLE ELSE 0.0 END), 6) AS confidence
FROM (SELECT *, CASE WHEN s > 0 THEN n / s ELSE n END AS average FROM (
  SELECT *, (SELECT CASE WHEN m.s >= 2 THEN m.v ELSE 'find_information' END FROM (SELECT list_max([{WEB_SCORES}]) AS m)) AS goal,
    (SELECT CASE WHEN len(l) > 0 THEN l ELSE ['learning'] END FROM (SELECT {when_list([(lit(u), any_sub('t', ws)) for u, ws in vocab.WEB_USE_CASE_WORDS])} AS l)) AS cases,
    {first_rule([(r, any_sub('t', ws)) for r, ws in vocab.WEB_RESULT_TYPE_WORDS], "'answer'")} AS result_type,
    len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS n, len(regexp_extract_all(text, '[.!?]+')) AS s,
    CASE WHEN {count_sub('t', vocab.WEB_ADVANCED_WORDS)} > {count_sub('t', vocab.WEB_BEGINNER_WORDS)} THEN 'advanced'
      WHEN {count_sub('t', vocab.WEB_BEGINNER_WORDS)} > 0 THEN 'beginner' ELSE 'intermediate' END AS skill_level FROM web_pages))""")
def _(t):
    w = pg.web_page_intent(t.table("pages"))
    return w.select("page_id", "title", "description", "primary_goal", F.array_join("use_cases", "; ").alias("use_cases"),
                    "result_type", "complexity", "skill_level", r6(F.col("confidence")).alias("confidence"))


@query("web_page_topics", """
SELECT page_id, topic, count, rank FROM (
  SELECT page_id, topic, count(*) AS count, CAST(row_number() OVER (PARTITION BY page_id ORDER BY count(*) DESC, topic) AS INT) AS rank
  FROM (SELECT page_id, unnest(terms) AS topic FROM web_pages) GROUP BY page_id, topic) WHERE rank <= 5""")
def _(t):
    return pg.web_topics(pg.web_page_intent(t.table("pages")))


@query("simple_page_tags", f"""
SELECT page_id, {first_rule([(g, any_sub('x', ws)) for g, ws in vocab.TAG_GOAL_WORDS], "'learn'")} AS goal,
  {joined(when_list([(lit(w), f"contains(x, {lit(w)})") for w in vocab.TAG_TOPICS]))} AS topics
FROM (SELECT page_id, lower(concat_ws(' ', title, content)) AS x FROM parsed_pages)""")
def _(t):
    s = pg.simple_tags(pg.html_to_page(t.table("pages")))
    return s.select("page_id", "goal", listed(F.col("topics")).alias("topics"))


@query("snippet", """
SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS snippet FROM documents""")
def _(t):
    return t.table("documents").select("doc_id", pg.snippet(F.col("text")).alias("snippet"))


@query("sanitise_text", """
SELECT page_id, md5(trim(translate(html, '<>"'';', ''))) AS clean_md5 FROM pages""")
def _(t):
    return t.table("pages").select("page_id", F.md5(pg.sanitise_text(F.col("html"))).alias("clean_md5"))
