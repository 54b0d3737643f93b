"""Governance queries: C1-C6, A9-A11, A16, WN9. Sign-ups carry consents, errors and sign-ups the audit trail."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import vocab
from tidemark.functions.text import r6
from tidemark.operators import governance as gov
from tidemark.plans.adapters import pick
from tidemark.plans.registry import cte, query
from tidemark.sources.testbed import AS_OF, pick as spark_pick

RESOURCES = ["ad", "campaign", "consent"]
cte("consents", f"""
SELECT event_id AS id, CAST(user_id AS VARCHAR) AS user_id, {pick(vocab.CONSENT_TYPES, 'ad_id')} AS consent_type, event_id % 3 <> 0 AS granted,
  CASE WHEN ad_id % 4 <> 0 THEN ts + to_days(CAST(ad_id % 20 AS INTEGER)) END AS expires_at,
  CASE WHEN event_id % 11 = 0 THEN ts + INTERVAL 1 DAY END AS withdrawn_at, ts AS created_at FROM keyed_events WHERE event_type = 'signup'""")
cte("audit", f"""
SELECT event_id AS id, CAST(user_id AS VARCHAR) AS user_id, event_type, {pick(RESOURCES, 'ad_id')} AS resource_type, ad_id AS resource_id, ts
FROM keyed_events WHERE event_type IN ('signup', 'error')""")
cte("consent_now", f"""
SELECT *, CASE WHEN coalesce(expires_at < TIMESTAMP '{AS_OF}', false) THEN 'expired' WHEN withdrawn_at IS NOT NULL THEN 'withdrawn'
  WHEN granted THEN 'granted' ELSE 'denied' END AS status FROM consents
QUALIFY row_number() OVER (PARTITION BY user_id, consent_type ORDER BY created_at DESC, id DESC) = 1""")


def _base(t, kinds):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return t.table("events").where(F.col("event_type").isin(kinds)).withColumn("k", k)


def consents(t):
    k, e = F.col("k"), F.col("event_id")
    return _base(t, ["signup"]).select(
        e.alias("id"), F.col("user_id").cast("string").alias("user_id"), spark_pick(vocab.CONSENT_TYPES, k).alias("consent_type"),
        (e % 3 != 0).alias("granted"), F.when(k % 4 != 0, F.timestamp_add("DAY", k % 20, F.col("ts"))).alias("expires_at"),
        F.when(e % 11 == 0, F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("withdrawn_at"), F.col("ts").alias("created_at"))


def audit(t):
    return _base(t, ["signup", "error"]).select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("user_id"), "event_type",
        spark_pick(RESOURCES, F.col("k")).alias("resource_type"), F.col("k").alias("resource_id"), "ts")


@query("consent_latest", "SELECT user_id, consent_type, id, granted FROM consent_now")
def _(t):
    return gov.consent_latest(consents(t)).select("user_id", "consent_type", "id", "granted")


@query("consent_state", "SELECT user_id, consent_type, status = 'granted' AS is_granted, status FROM consent_now")
def _(t):
    return gov.consent_state(consents(t), AS_OF)


@query("apply_consent_filter", """
SELECT click_id, session_id AS user_id FROM clicks WHERE session_id IN (SELECT user_id FROM consent_now WHERE consent_type = 'advertising' AND status = 'granted')""")
def _(t):
    clicks = t.clicks().select("click_id", F.col("session_id").alias("user_id"))
    return gov.with_consent(clicks, consents(t), "advertising", AS_OF).select("click_id", "user_id")


@query("audit_query", """
SELECT id, user_id, resource_type, ts FROM audit WHERE event_type = 'error' AND resource_type = 'campaign' AND ts >= TIMESTAMP '2024-01-05' ORDER BY ts DESC, id DESC LIMIT 40 OFFSET 5""")
def _(t):
    q = gov.audit_query(audit(t), {"event_type": "error", "resource_type": "campaign", "user_id": None}, start="2024-01-05 00:00:00", limit=40, offset=5)
    return q.select("id", "user_id", "resource_type", "ts")


@query("audit_purge", "SELECT id, ts FROM audit WHERE ts >= TIMESTAMP '2024-03-31 12:00:00' - INTERVAL 90 DAY")
def _(t):
    return gov.audit_purge(audit(t), "2024-03-31 12:00:00").select("id", "ts")


@query("audit_stats", f"""
SELECT 'total' AS measure, count(*) AS count FROM audit UNION ALL SELECT 'type:' || event_type, count(*) FROM audit GROUP BY event_type
UNION ALL SELECT 'day:' || strftime(ts, '%Y-%m-%d'), count(*) FROM audit WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY ALL
UNION ALL SELECT 'last_24h', count(*) FROM audit WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY HAVING count(*) > 0""")
def _(t):
    return gov.audit_stats(audit(t), AS_OF)


@query("consent_summary", f"""
SELECT 'total' AS measure, count(*)::DOUBLE AS value FROM consents UNION ALL SELECT 'granted', count(*) FILTER (granted) FROM consents
UNION ALL SELECT 'denied', count(*) FILTER (NOT granted) FROM consents
UNION ALL SELECT 'compliance_rate', round(count(*) FILTER (granted) / greatest(count(*), 1) * 100, 6) FROM consents
UNION ALL SELECT 'type:' || c, (SELECT count(*) FROM consents WHERE consent_type = c) FROM (SELECT unnest([{", ".join(repr(c) for c in vocab.CONSENT_TYPES)}]) AS c)""")
def _(t):
    return gov.consent_summary(consents(t)).withColumn("value", r6(F.col("value")))


@query("compliance_report", f"""
SELECT *, CASE WHEN expired = 0 THEN 'high' ELSE 'medium' END AS level FROM (
  SELECT (SELECT count(*) FROM ads) AS ads, (SELECT count(*) FROM clicks) AS clicks, (SELECT count(*) FROM conversions) AS conversions,
    (SELECT count(*) FROM ad_metrics) AS metrics, (SELECT count(*) FROM ad_metrics WHERE expires_at < TIMESTAMP '{AS_OF}') AS expired)""")
def _(t):
    return gov.compliance_report(t.ads(), t.ad_metrics(), t.clicks(), t.conversions(), AS_OF)


@query("retention_policy", " UNION ALL ".join(f"""
SELECT 'click_tracking' AS data_type, '{k}' AS retention, TIMESTAMP '{AS_OF}' + to_hours({h}) AS deletion_date,
  (SELECT count(*) FROM clicks WHERE ts < TIMESTAMP '{AS_OF}' - to_hours({h})) AS affected""" for k, h in vocab.RETENTION_HOURS.items()))
def _(t):
    return gov.retention_policy(t.clicks(), "ts", AS_OF, "click_tracking")


@query("anonymise_user_rows", "SELECT id, sha256('pepper' || user_id) AS user_id, event_type FROM audit")
def _(t):
    return gov.anonymise_rows(audit(t), ["user_id"], "pepper").select("id", "user_id", "event_type")


@query("latency_summary", """
WITH sorted AS (SELECT event_type, list(value ORDER BY value) AS l, count(*) AS n, min(value) AS lo, max(value) AS hi, avg(value) AS mean,
  stddev_samp(value) AS sd, count(*) FILTER (value < 50) / count(*) AS okay FROM events GROUP BY event_type)
SELECT event_type, n AS count, lo AS min, hi AS max, round(mean, 6) AS mean, round(sd, 6) AS stdev, round(okay, 6) AS success_rate,
  round((l[(n - 1) // 2 + 1] + l[n // 2 + 1]) / 2, 6) AS median, l[least(floor(n * 0.95::DOUBLE), n - 1)::BIGINT + 1] AS p95,
  l[least(floor(n * 0.99::DOUBLE), n - 1)::BIGINT + 1] AS p99 FROM sorted""")
def _(t):
    s = gov.latency_summary(t.table("events"), "event_type", "value", 5.0, F.col("value") < 50)
    return s.select(*[r6(F.col(c)).alias(c) if c in ("mean", "stdev", "success_rate", "median") else c for c in s.columns])
