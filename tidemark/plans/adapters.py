"""The rules of sources/testbed.py as SQL, shared by the oracle texts."""

from __future__ import annotations

import re

from tidemark.plans.registry import cte
from tidemark.sources import testbed as tb


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(lit(i) for i in items) + "]"


def pick(items, index: str) -> str:
    return f"({sql_list(items)})[(({index}) % {len(items)}) + 1]"


def any_sub(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(w)})" for w in words) + ")"


def count_sub(text: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, {lit(w)}) AS INT)" for w in words) + ")"


def hit(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {lit(uni(pattern))})"


def uni(pattern: str) -> str:
    """RE2 has no Unicode word boundary; a leading/trailing one becomes an explicit class."""
    inner = re.fullmatch(r"\\b(.*)\\b", pattern, flags=re.S)
    if not inner or r"\b" in inner.group(1):
        return pattern
    return r"(?:^|[^\p{L}\p{N}_])(?:" + inner.group(1) + r")(?:$|[^\p{L}\p{N}_])"


def first_rule(rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {cond} THEN {lit(v)}" for v, cond in rules) + f" ELSE {default} END"


cte("ads", """
SELECT p_partkey AS ad_id, p_partkey % 10 AS advertiser_id, p_partkey % 25 AS ad_group_id, p_name AS title,
  p_type || ' ' || p_brand AS description, p_retailprice / 1000 AS bid_amount, p_size / 50.0::DOUBLE AS quality_score,
  CASE WHEN p_partkey % 11 = 0 THEN 'paused' ELSE 'active' END AS status,
  CASE WHEN p_partkey % 7 = 0 THEN 'pending' ELSE 'approved' END AS approval_status
FROM part""")
cte("ad_groups", """
SELECT CAST(n_nationkey AS BIGINT) AS ad_group_id, CAST(n_regionkey AS BIGINT) AS campaign_id, n_name AS group_name
FROM nation""")
cte("campaigns", """
SELECT CAST(r_regionkey AS BIGINT) AS campaign_id, r_name AS campaign_name, CAST(r_regionkey AS BIGINT) % 3 AS advertiser_id,
  r_regionkey * 200.0::DOUBLE + 100.0::DOUBLE AS budget,
  CASE WHEN r_regionkey = 4 THEN 'paused' ELSE 'active' END AS status,
  TIMESTAMP '2024-01-01 00:00:00' AS start_date,
  CASE WHEN r_regionkey <> 3 THEN TIMESTAMP '2024-01-25 00:00:00' END AS end_date
FROM region""")
cte("advertisers", "SELECT s_suppkey AS advertiser_id, s_name AS name FROM supplier")
cte("keyed_events", """
SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS ad_id
FROM events""")


def _tracked(kind: str, id_name: str) -> str:
    return f"""
SELECT event_id AS {id_name}, ad_id, CAST(user_id AS VARCHAR) AS session_id, ts,
  md5(CAST(user_id % 3 AS VARCHAR)) AS ip_hash,
  CASE WHEN ad_id % 7 <> 4 OR user_id % 2 <> 0 THEN md5(CAST(ad_id % 7 AS VARCHAR)) END AS user_agent_hash,
  {pick(tb.USER_AGENTS, 'ad_id')} AS user_agent,
  CASE user_id % 4 WHEN 0 THEN 390 WHEN 1 THEN 1920 WHEN 2 THEN 1280 END AS screen_width
FROM keyed_events WHERE event_type = '{kind}'"""


cte("clicks", _tracked("click", "click_id"))
cte("impressions", _tracked("view", "impression_id"))
cte("conversions", """
SELECT p.event_id AS conversion_id, c.click_id, 'purchase' AS conversion_type, p.value, p.ts,
  CASE WHEN p.event_id % 3 <> 0 THEN 'verified' ELSE 'pending' END AS status
FROM (SELECT *, CAST(user_id AS VARCHAR) AS session_id FROM keyed_events WHERE event_type = 'purchase') p
ASOF JOIN clicks c ON p.session_id = c.session_id AND p.ts > c.ts""")
cte("ad_metrics", """
SELECT d.ad_id, d.date, d.impression_count, d.click_count, d.conversion_count, d.revenue, d.created_at,
  CAST(d.date AS TIMESTAMP) + INTERVAL 20 DAY AS expires_at, d.impression_count * a.bid_amount AS spend,
  CASE WHEN d.impression_count > 0 THEN d.click_count / d.impression_count END AS ctr,
  CASE WHEN d.click_count > 0 THEN d.impression_count * a.bid_amount / d.click_count END AS cpc,
  CASE WHEN d.impression_count * a.bid_amount > 0 THEN d.revenue / (d.impression_count * a.bid_amount) END AS roas
FROM (
  SELECT ad_id, CAST(ts AS DATE) AS date, count(*) FILTER (event_type = 'view') AS impression_count,
    count(*) FILTER (event_type = 'click') AS click_count, count(*) FILTER (event_type = 'purchase') AS conversion_count,
    coalesce(sum(value) FILTER (event_type = 'purchase'), 0.0) AS revenue, max(ts) AS created_at
  FROM keyed_events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY ALL
) d JOIN ads a USING (ad_id)""")
cte("queries", f"""
SELECT conv_id * 1000 + turn AS query_id, {pick(tb.PHRASES, 'conv_id + turn')} || ' ' || text AS text,
  's' || CAST(conv_id AS VARCHAR) AS session_id, 'en-US' AS locale,
  TIMESTAMP '{tb.AS_OF}' - to_minutes(CAST((conv_id * 37 + turn * 11) % 1800 AS BIGINT)) AS ts
FROM conversations WHERE role = 'user'""")
cte("requests", f"""
SELECT o_orderkey AS query_id, {pick(tb.PHRASES, 'o_orderkey')} || ' ' || lower(o_orderpriority) AS text FROM orders""")
cte("candidates", f"""
SELECT l_orderkey AS query_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, p_name AS title,
  concat_ws(' ', lower(p_type), lower(p_brand), {pick(tb.PHRASES, 'l_suppkey')}) AS description,
  {pick(tb.PLATFORMS, 'l_suppkey')} AS platform,
  CASE WHEN l_partkey % 9 <> 0 THEN {pick(tb.PROVIDERS, 'l_partkey')} END AS provider,
  {pick(tb.LICENSES, 'CAST(l_quantity AS BIGINT)')} AS license,
  CASE WHEN l_linenumber <> 3 THEN l_extendedprice / 100 ELSE 0.0 END AS price,
  list_filter(string_split({pick(tb.TAG_SETS, 'l_linenumber')}, ','), lambda t: t <> '') AS tags,
  p_size / 50.0::DOUBLE AS quality_score,
  CASE WHEN l_suppkey % 13 <> 0 THEN strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') END AS recency,
  CASE l_returnflag WHEN 'A' THEN 'beginner' WHEN 'N' THEN 'intermediate' ELSE 'advanced' END AS complexity,
  l_discount * 10 AS privacy_rating, l_linestatus = 'O' AS opensource
FROM lineitem JOIN part ON l_partkey = p_partkey""")
cte("request_ads", "SELECT DISTINCT l_orderkey AS query_id, l_partkey AS ad_id FROM lineitem")
cte("request_urls", f"""
SELECT DISTINCT l_orderkey AS query_id,
  (CASE WHEN l_partkey % 4 = 0 THEN 'http://' ELSE 'https://' END) || {pick(tb.HOSTS, 'l_partkey')} ||
  {pick(["/docs/setup-guide", "/blog/post_2024", "/tool/converter", "/", "/download/file.zip", "/a/b-c"], 'l_suppkey')} AS url
FROM lineitem""")
