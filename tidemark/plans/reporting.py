"""Reporting queries: J1-J4, J8, A1-A6, WN4, WN5, S1, S2."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import r6
from tidemark.operators import attribution, reporting
from tidemark.plans import adapters  # noqa: F401  (table definitions)
from tidemark.plans.registry import cte, query
from tidemark.sources.tables import list_rows
from tidemark.sources.testbed import AS_OF

ROUNDED = {"avg_ctr", "avg_cpc", "cost", "avg_roas", "spend", "total_spend", "total_revenue", "roi", "roas", "cpa",
           "clv", "ctr", "cvr", "cpc", "revenue", "weight", "attributed_value", "current_value", "previous_value",
           "change_percent", "forecast", "bid_amount"}


def tidy(df):
    return df.select(*[r6(F.col(c)).alias(c) if c in ROUNDED else F.col(c) for c in df.columns])


def star(t):
    return t.ad_metrics(), t.ads(), t.ad_groups(), t.campaigns()


cte("fact_star", """
SELECT m.*, a.title, a.bid_amount, a.ad_group_id, g.campaign_id, c.campaign_name
FROM ad_metrics m JOIN ads a USING (ad_id) JOIN ad_groups g USING (ad_group_id) JOIN campaigns c USING (campaign_id)""")


@query("scan_tables", """
SELECT count(*) AS rows_seen, count(DISTINCT event_type) AS kinds, min(ts) AS first_ts, max(ts) AS last_ts FROM events""")
def _(t):
    return t.table("events").agg(F.count(F.lit(1)).alias("rows_seen"), F.count_distinct("event_type").alias("kinds"),
                                 F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("filtered_page", """
SELECT click_id, ad_id, session_id FROM clicks WHERE ad_id = 7 ORDER BY click_id LIMIT 20 OFFSET 3""")
def _(t):
    return list_rows(t.clicks(), {"ad_id": 7}, skip=3, limit=20, order=["click_id"]).select(
        "click_id", "ad_id", "session_id")


@query("ad_star_join", """
SELECT campaign_id, campaign_name, ad_group_id, ad_id, date, impression_count, click_count, round(spend, 6) AS spend
FROM fact_star""")
def _(t):
    m, a, g, c = star(t)
    return tidy(reporting.ad_star_join(m, a, g, c).select(
        "campaign_id", "campaign_name", "ad_group_id", "ad_id", "date", "impression_count", "click_count", "spend"))


@query("ads_of_campaign", """
SELECT ad_id, date, impression_count FROM ad_metrics
WHERE ad_id IN (SELECT ad_id FROM ads JOIN ad_groups USING (ad_group_id) WHERE campaign_id IN (1, 2))""")
def _(t):
    return reporting.facts_of_campaigns(t.ad_metrics(), t.ads(), t.ad_groups(), [1, 2]).select(
        "ad_id", "date", "impression_count")


@query("conversion_to_click", """
SELECT conversion_id, click_id, ad_id, date_diff('microsecond', c.ts, v.ts) AS lag_micros
FROM conversions v JOIN clicks c USING (click_id)""")
def _(t):
    joined = reporting.conversion_clicks(t.conversions(), t.clicks())
    return joined.select("conversion_id", "click_id", "ad_id",
                         F.timestamp_diff("MICROSECOND", F.col("click_ts"), F.col("ts")).alias("lag_micros"))


@query("campaign_performance", """
SELECT campaign_id, campaign_name, CAST(sum(impression_count) AS BIGINT) AS impressions,
  CAST(sum(click_count) AS BIGINT) AS clicks, CAST(sum(conversion_count) AS BIGINT) AS conversions,
  round(coalesce(avg(ctr), 0), 6) AS avg_ctr, round(coalesce(avg(cpc), 0), 6) AS avg_cpc,
  round(sum(impression_count * bid_amount), 6) AS cost, round(coalesce(avg(roas), 0), 6) AS avg_roas
FROM fact_star WHERE date BETWEEN DATE '2024-01-03' AND DATE '2024-01-28' GROUP BY ALL""")
def _(t):
    return tidy(reporting.campaign_performance(*star(t), start="2024-01-03", end="2024-01-28"))


@query("campaign_spend", """
SELECT campaign_id, round(sum(impression_count * bid_amount), 6) AS spend FROM fact_star GROUP BY ALL""")
def _(t):
    return tidy(reporting.campaign_spend(t.ad_metrics(), t.ads(), t.ad_groups()))


cte("budget_spend", "SELECT campaign_id, sum(impression_count * bid_amount) AS spend FROM fact_star GROUP BY ALL")


@query("budget_eligible_campaigns", """
SELECT c.campaign_id, c.campaign_name, c.budget, round(coalesce(s.spend, 0), 6) AS spend
FROM campaigns c LEFT JOIN budget_spend s USING (campaign_id)
WHERE c.status = 'active' AND coalesce(s.spend, 0) < c.budget""")
def _(t):
    spend = reporting.campaign_spend(t.ad_metrics(), t.ads(), t.ad_groups())
    return tidy(reporting.budget_eligible(t.campaigns(), spend).select("campaign_id", "campaign_name", "budget", "spend"))


@query("campaign_roi", f"""
WITH span AS (
  SELECT campaign_id, campaign_name, coalesce(start_date, TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS s,
    coalesce(end_date, TIMESTAMP '{AS_OF}') AS e FROM campaigns),
shown AS (
  SELECT campaign_id, sum(impression_count) AS impressions, sum(click_count) AS clicks,
    sum(conversion_count) AS conversions, sum(impression_count * bid_amount) AS spend
  FROM fact_star JOIN span USING (campaign_id) WHERE date BETWEEN CAST(s AS DATE) AND CAST(e AS DATE) GROUP BY ALL),
earned AS (
  SELECT g.campaign_id, sum(v.value) AS revenue
  FROM conversions v JOIN clicks k USING (click_id) JOIN ads a ON a.ad_id = k.ad_id JOIN ad_groups g USING (ad_group_id)
  JOIN span p ON p.campaign_id = g.campaign_id
  WHERE v.status = 'verified' AND k.ts BETWEEN p.s AND p.e GROUP BY ALL),
base AS (
  SELECT campaign_id, campaign_name, coalesce(spend, 0) AS sp, coalesce(revenue, 0) AS rv,
    CAST(coalesce(impressions, 0) AS BIGINT) AS impressions, CAST(coalesce(clicks, 0) AS BIGINT) AS clicks,
    CAST(coalesce(conversions, 0) AS BIGINT) AS conversions
  FROM span p LEFT JOIN shown USING (campaign_id) LEFT JOIN earned USING (campaign_id))
SELECT campaign_id, campaign_name, round(sp, 6) AS total_spend, round(rv, 6) AS total_revenue, impressions, clicks,
  conversions, round(CASE WHEN sp > 0 THEN (rv - sp) / sp * 100 ELSE 0 END, 6) AS roi,
  round(CASE WHEN sp > 0 THEN rv / sp ELSE 0 END, 6) AS roas,
  round(CASE WHEN conversions > 0 THEN sp / conversions ELSE 0 END, 6) AS cpa,
  round(CASE WHEN conversions > 0 THEN rv / conversions ELSE 0 END * 1.5, 6) AS clv,
  round(CASE WHEN impressions > 0 THEN clicks / impressions * 100 ELSE 0 END, 6) AS ctr,
  round(CASE WHEN clicks > 0 THEN conversions / clicks * 100 ELSE 0 END, 6) AS cvr
FROM base""")
def _(t):
    return tidy(reporting.campaign_roi(t.campaigns(), t.ads(), t.ad_groups(), t.ad_metrics(), t.clicks(),
                                       t.conversions(), AS_OF))


@query("daily_metrics", """
SELECT date, CAST(sum(impression_count) AS BIGINT) AS impressions, CAST(sum(click_count) AS BIGINT) AS clicks,
  CAST(sum(conversion_count) AS BIGINT) AS conversions,
  round(CASE WHEN sum(impression_count) > 0 THEN sum(click_count) / sum(impression_count) * 100 ELSE 0 END, 6) AS ctr,
  round(CASE WHEN sum(click_count) > 0 THEN sum(conversion_count) / sum(click_count) * 100 ELSE 0 END, 6) AS cvr
FROM ad_metrics WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-31' GROUP BY date""")
def _(t):
    return tidy(reporting.daily_metrics(t.ad_metrics(), "2024-01-05", "2024-01-31"))


@query("top_ads", """
SELECT ad_id, title, CAST(sum(impression_count) AS BIGINT) AS impressions, CAST(sum(click_count) AS BIGINT) AS clicks,
  CAST(sum(conversion_count) AS BIGINT) AS conversions,
  round(CASE WHEN sum(impression_count) > 0 THEN sum(click_count) / sum(impression_count) * 100 ELSE 0 END, 6) AS ctr,
  round(CASE WHEN sum(click_count) > 0 THEN sum(conversion_count) / sum(click_count) * 100 ELSE 0 END, 6) AS cvr
FROM ad_metrics JOIN ads USING (ad_id) GROUP BY ad_id, title ORDER BY ctr DESC, ad_id LIMIT 10""")
def _(t):
    return tidy(reporting.top_ads(t.ad_metrics(), t.ads()))


@query("live_metrics", """
SELECT CAST(coalesce(sum(impression_count), 0) AS BIGINT) AS impressions,
  CAST(coalesce(sum(click_count), 0) AS BIGINT) AS clicks, CAST(coalesce(sum(conversion_count), 0) AS BIGINT) AS conversions,
  (SELECT count(*) FROM campaigns WHERE status = 'active') AS active_campaigns,
  (SELECT count(DISTINCT session_id) FROM clicks WHERE ts >= TIMESTAMP '2024-01-30 18:00:00') AS live_users,
  round(CASE WHEN sum(impression_count) > 0 THEN sum(click_count) / sum(impression_count) * 100 ELSE 0 END, 2) AS ctr
FROM ad_metrics WHERE created_at >= TIMESTAMP '2024-01-30 18:00:00'""")
def _(t):
    return reporting.live_metrics(t.ad_metrics(), t.campaigns(), t.clicks(), "2024-01-30 19:00:00")


@query("trend", f"""
WITH daily AS (
  SELECT campaign_id, date, sum(click_count) AS v FROM fact_star
  WHERE date BETWEEN DATE '{AS_OF[:10]}' - 30 AND DATE '{AS_OF[:10]}' GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY date DESC) AS rn FROM daily),
halves AS (
  SELECT campaign_id, coalesce(avg(v) FILTER (date >= DATE '{AS_OF[:10]}' - 15), 0) AS cur,
    coalesce(avg(v) FILTER (date < DATE '{AS_OF[:10]}' - 15), 0) AS prev,
    max(v) FILTER (rn = 1) AS v1, max(v) FILTER (rn = 7) AS v7 FROM numbered GROUP BY ALL),
changed AS (
  SELECT *, CASE WHEN prev > 0 THEN (cur - prev) / prev * 100 WHEN cur > 0 THEN 100 ELSE 0 END AS ch FROM halves)
SELECT campaign_id, round(cur, 6) AS current_value, round(prev, 6) AS previous_value, round(ch, 6) AS change_percent,
  CASE WHEN ch > 5 THEN 'up' WHEN ch < -5 THEN 'down' ELSE 'stable' END AS direction,
  round(CAST(v1 + (v1 - v7) / 6 * 7 AS DOUBLE), 6) AS forecast FROM changed""")
def _(t):
    facts = t.ad_metrics().join(reporting.campaign_ads(t.ads(), t.ad_groups()).drop("bid_amount"), "ad_id")
    return tidy(reporting.trend(facts, "clicks", AS_OF))


cte("touches", """
SELECT v.conversion_id, v.ts AS conv_ts, v.value, t.ad_id, t.click_id, t.ts,
  row_number() OVER (PARTITION BY v.conversion_id ORDER BY t.ts, t.click_id) AS rn,
  count(*) OVER (PARTITION BY v.conversion_id) AS n
FROM conversions v JOIN clicks k USING (click_id) JOIN clicks t
  ON t.session_id = k.session_id AND t.ts >= v.ts - INTERVAL 30 DAY AND t.ts <= v.ts""")


@query("session_touchpoints", """
SELECT conversion_id, ad_id, count(*) AS touches FROM touches GROUP BY ALL""")
def _(t):
    return attribution.touch_sums(t.conversions(), t.clicks(), AS_OF).where(F.col("touches").isNotNull()).select(
        "conversion_id", "ad_id", "touches")


@query("attribution", """
WITH weighted AS (
  SELECT conversion_id, ad_id, value, n, rn, pow(0.5, date_diff('microsecond', ts, conv_ts) / 86400000000.0::DOUBLE / 7) AS d
  FROM touches),
per_ad AS (
  SELECT conversion_id, ad_id, any_value(value) AS value,
    CAST(max(CAST(rn = 1 AS INT)) AS DOUBLE) AS first_touch, CAST(max(CAST(rn = n AS INT)) AS DOUBLE) AS last_touch,
    count(*) / any_value(n) AS linear, sum(d) AS d,
    sum(CASE WHEN n = 1 THEN 1.0 WHEN n = 2 THEN 0.5
      ELSE CASE WHEN rn = 1 OR rn = n THEN 0.4 ELSE 0.2 / (n - 2) END END::DOUBLE) AS position_based
  FROM weighted GROUP BY conversion_id, ad_id),
named AS (
  SELECT conversion_id, ad_id, value, first_touch, last_touch, linear,
    d / sum(d) OVER (PARTITION BY conversion_id) AS time_decay, position_based FROM per_ad),
long AS (UNPIVOT named ON first_touch, last_touch, linear, time_decay, position_based INTO NAME model VALUE weight)
SELECT conversion_id, ad_id, model, round(weight, 6) AS weight, round(weight * value, 6) AS attributed_value FROM long""")
def _(t):
    return tidy(attribution.attribute(t.conversions(), t.clicks(), AS_OF))
