"""Fraud queries: WN1-WN3, A7, A8, F1-F11.

The default limits never fire on the given events, so the queries use wider windows; the defaults are
covered by tests.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.functions import vocab
from tidemark.functions.text import r6
from tidemark.functions.timing import DAY, HOUR
from tidemark.operators import fraud
from tidemark.plans.adapters import any_sub, lit
from tidemark.plans.registry import cte, query
from tidemark.sources.testbed import AS_OF

WIDE = tuple(replace(c, window=w) for c, w in zip(fraud.VELOCITY, (6 * HOUR, 2 * DAY, DAY, 3 * DAY)))
WIDE_IMPRESSIONS = (replace(fraud.IMPRESSION_VELOCITY[0], window=4 * DAY),)
AGENTS_WINDOW, TIMING_WINDOW = 12 * HOUR, 3 * HOUR

cte("velocity", """
SELECT click_id,
  count(*) OVER (PARTITION BY ip_hash ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS ip_minute,
  count(*) OVER (PARTITION BY ip_hash ORDER BY ts RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW) AS ip_hour,
  count(*) OVER (PARTITION BY session_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS session_minute,
  count(*) OVER (PARTITION BY ip_hash, ad_id ORDER BY ts RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND CURRENT ROW) AS ip_ad_day
FROM clicks""")
cte("agent_counts", """
SELECT click_id, count(DISTINCT user_agent_hash) OVER (
  PARTITION BY ip_hash ORDER BY ts RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW) AS user_agents
FROM clicks""")
cte("timing", """
SELECT click_id, len(g) + 1 AS recent_clicks, list_avg(g) AS mean_gap, list_var_pop(g) AS gap_variance FROM (
  SELECT click_id, list_transform(range(1, len(r)), lambda i: (epoch_us(r[i + 1]) - epoch_us(r[i])) / 1000000.0::DOUBLE) AS g
  FROM (SELECT click_id, list_slice(l, greatest(len(l) - 9, 1), len(l)) AS r FROM (
    SELECT click_id, list(ts) OVER (
      PARTITION BY ip_hash ORDER BY ts, click_id RANGE BETWEEN INTERVAL 3 HOUR PRECEDING AND CURRENT ROW) AS l FROM (
      SELECT * FROM clicks)))
  WHERE len(r) >= 3)""".replace("ORDER BY ts, click_id RANGE", "ORDER BY ts RANGE"))


def agent_signals(source: str) -> str:
    bot = "CASE " + " ".join(f"WHEN contains(lower(ua), {lit(p)}) THEN {lit(p)}" for p in vocab.BOT_PATTERNS) + " END"
    odd = "CASE " + " ".join(f"WHEN regexp_matches(ua, {lit(p)}) THEN {lit(p)}" for p in vocab.SUSPICIOUS_AGENTS) + " END"
    return f"""SELECT *, {bot} AS bot, {odd} AS odd FROM (
  SELECT *, coalesce(nullif(user_agent, ''), nullif(user_agent_hash, '')) AS ua FROM {source})"""


def sig(cond: str, kind: str, severity: str, confidence: float, reason: str) -> str:
    w = vocab.SEVERITY_WEIGHT[severity]
    return (f"CASE WHEN {cond} THEN {{'kind': '{kind}', 'severity': '{severity}', "
            f"'score': {confidence}::DOUBLE * {w}::DOUBLE, 'reason': {reason}}} END")


def velocity_sql(checks) -> list[str]:
    return [sig(f"{c.name} >= {c.limit}", c.kind, c.severity, c.confidence,
                f"{lit(c.reason)} || {c.name}" + (f" || ' (threshold: {c.limit})'" if c.show_limit else ""))
            for c in checks]


AGENT_SQL = [
    sig("ua IS NULL", "bot_traffic", "medium", 0.6, "'Missing user agent'"),
    sig("bot IS NOT NULL", "bot_traffic", "high", 0.95, "'Known bot user agent pattern detected: ' || bot"),
    sig("odd IS NOT NULL", "bot_traffic", "medium", 0.7, "'Suspicious user agent pattern: ' || odd"),
]
PROXY_SQL = sig("user_agents >= 5", "ip_anomaly", "medium", 0.7,
                "'Multiple user agents (' || user_agents || ') from same IP - possible proxy/VPN'")
TIMING_SQL = sig("gap_variance < 0.1 AND mean_gap < 1.0", "click_fraud", "high", 0.85,
                 "format('Machine-like click timing pattern detected (variance: {:.4f})', gap_variance)")
DEVICE_SQL = sig(
    f"nullif(user_agent, '') IS NOT NULL AND screen_width > 0 AND "
    f"{any_sub('lower(user_agent)', vocab.MOBILE_AGENT_WORDS)} <> (screen_width < 768)",
    "device_spoofing", "medium", 0.65, "'Device type mismatch between user agent and screen size'")


def judged(source: str, signals: list[str]) -> str:
    return f"""SELECT *, risk_score >= 0.7::DOUBLE AS is_fraudulent,
  CASE WHEN risk_score >= 0.7::DOUBLE THEN 'block_and_investigate' WHEN risk_score >= 0.5 THEN 'flag_for_review'
    WHEN risk_score >= 0.3::DOUBLE THEN 'monitor' ELSE 'allow' END AS recommended_action FROM (
  SELECT *, CASE WHEN len(signals) > 0 THEN
      least(list_max(list_transform(signals, lambda s: s.score)) + least(0.1::DOUBLE * (len(signals) - 1), 0.2::DOUBLE), 1.0)
    ELSE 0.0 END AS risk_score FROM (
    SELECT *, list_filter([{', '.join(signals)}], lambda s: s IS NOT NULL) AS signals FROM ({source})))"""


cte("judged_clicks", judged(agent_signals(
    "(SELECT * FROM clicks LEFT JOIN velocity USING (click_id) LEFT JOIN agent_counts USING (click_id) "
    "LEFT JOIN timing USING (click_id))"),
    [*velocity_sql(WIDE), *AGENT_SQL, PROXY_SQL, TIMING_SQL, DEVICE_SQL]))
VERDICT = """round(risk_score, 6) AS risk_score, is_fraudulent, recommended_action, CAST(len(signals) AS BIGINT) AS n_signals,
  coalesce(list_aggregate(list_transform(signals, lambda s: s.kind || '/' || s.severity || '/' || s.reason), 'string_agg', '; '), '') AS reasons"""


def verdict(df, key):
    shown = F.array_join(F.transform("signals", lambda s: F.concat_ws("/", s["kind"], s["severity"], s["reason"])), "; ")
    return df.select(key, r6(F.col("risk_score")).alias("risk_score"), "is_fraudulent", "recommended_action",
                     F.size("signals").cast("bigint").alias("n_signals"), shown.alias("reasons"))


def analysed(t):
    return fraud.analyse_clicks(t.clicks(), WIDE, AGENTS_WINDOW, TIMING_WINDOW)


@query("click_velocity", "SELECT * FROM velocity")
def _(t):
    return fraud.click_velocity(t.clicks(), "click_id", WIDE)


@query("machine_timing", """
SELECT click_id, recent_clicks, round(mean_gap, 4) AS mean_gap, round(gap_variance, 2) AS gap_variance FROM timing""")
def _(t):
    timed = fraud.machine_timing(t.clicks(), "click_id", TIMING_WINDOW)
    return timed.select("click_id", F.col("recent_clicks").cast("bigint").alias("recent_clicks"),
                        F.round("mean_gap", 4).alias("mean_gap"), F.round("gap_variance", 2).alias("gap_variance"))


@query("ip_user_agents", "SELECT * FROM agent_counts")
def _(t):
    return fraud.ip_user_agents(t.clicks(), "click_id", AGENTS_WINDOW)


@query("duplicate_conversions", """
SELECT conversion_id, click_id, count(*) OVER (PARTITION BY click_id) AS same_click FROM conversions""")
def _(t):
    return fraud.duplicate_conversions(t.conversions()).select("conversion_id", "click_id", "same_click")


cte("agent_verdicts", judged(agent_signals("clicks"), AGENT_SQL))
cte("device_verdicts", judged("SELECT * FROM clicks", [DEVICE_SQL]))
cte("proxy_verdicts", judged("SELECT * FROM agent_counts", [PROXY_SQL]))
cte("velocity_verdicts", judged("SELECT * FROM velocity", velocity_sql(WIDE)))


@query("bot_user_agent", f"SELECT click_id, {VERDICT} FROM agent_verdicts")
def _(t):
    return verdict(fraud.judge(t.clicks().withColumn("signals", fraud.bot_signals())), "click_id")


@query("device_mismatch", f"SELECT click_id, {VERDICT} FROM device_verdicts")
def _(t):
    return verdict(fraud.judge(t.clicks().withColumn("signals", fraud.device_signals())), "click_id")


@query("proxy_ip", f"SELECT click_id, {VERDICT} FROM proxy_verdicts")
def _(t):
    counts = fraud.ip_user_agents(t.clicks(), "click_id", AGENTS_WINDOW)
    return verdict(fraud.judge(counts.withColumn("signals", fraud.proxy_signals())), "click_id")


@query("velocity_signals", f"SELECT click_id, {VERDICT} FROM velocity_verdicts")
def _(t):
    counts = fraud.click_velocity(t.clicks(), "click_id", WIDE)
    return verdict(fraud.judge(counts.withColumn("signals", fraud.velocity_signals(WIDE))), "click_id")


@query("risk_score", """
SELECT recommended_action, CAST(len(signals) AS BIGINT) AS n_signals, round(risk_score, 6) AS risk_score, count(*) AS clicks
FROM agent_verdicts GROUP BY ALL""")
def _(t):
    judged_ = fraud.judge(t.clicks().withColumn("signals", fraud.bot_signals()))
    return judged_.groupBy("recommended_action", F.size("signals").cast("bigint").alias("n_signals"),
                           r6(F.col("risk_score")).alias("risk_score")).agg(F.count(F.lit(1)).alias("clicks"))


@query("recommended_action", "SELECT recommended_action, count(*) AS clicks FROM judged_clicks GROUP BY ALL")
def _(t):
    return analysed(t).groupBy("recommended_action").agg(F.count(F.lit(1)).alias("clicks"))


@query("click_analysis", f"SELECT click_id, {VERDICT} FROM judged_clicks")
def _(t):
    return verdict(analysed(t), "click_id")


cte("judged_conversions", judged("""
  SELECT v.*, count(*) OVER (PARTITION BY v.click_id) AS same_click,
    date_diff('microsecond', c.ts, v.ts) / 1000000.0::DOUBLE AS seconds FROM conversions v JOIN clicks c USING (click_id)""", [
    sig("seconds < 3600", "conversion_fraud", "high", 0.9, "format('Suspiciously fast conversion: {:.1f}s', seconds)"),
    sig("same_click > 1", "conversion_fraud", "high", 0.95, "'Multiple conversions (' || same_click || ') from same click'")]))


@query("conversion_timing", """
SELECT conversion_id, round(seconds, 3) AS seconds_to_conversion, seconds < 3600 AS too_fast FROM judged_conversions""")
def _(t):
    timed = fraud.analyse_conversions(t.conversions(), t.clicks(), 3600)
    return timed.select("conversion_id", F.round("seconds_to_conversion", 3).alias("seconds_to_conversion"),
                        (F.col("seconds_to_conversion") < 3600).alias("too_fast"))


@query("conversion_analysis", f"SELECT conversion_id, {VERDICT} FROM judged_conversions")
def _(t):
    return verdict(fraud.analyse_conversions(t.conversions(), t.clicks(), 3600), "conversion_id")


cte("judged_impressions", judged(agent_signals("""(SELECT *,
  count(*) OVER (PARTITION BY ip_hash ORDER BY ts RANGE BETWEEN INTERVAL 4 DAY PRECEDING AND CURRENT ROW) AS ip_minute
  FROM impressions)"""), [*velocity_sql(WIDE_IMPRESSIONS), *AGENT_SQL]))


@query("impression_analysis", f"SELECT impression_id, {VERDICT} FROM judged_impressions")
def _(t):
    return verdict(fraud.analyse_impressions(t.impressions(), WIDE_IMPRESSIONS), "impression_id")


@query("fraud_reports", """
SELECT click_id AS event_id, 'click' AS event_type, ad_id, s.reason AS reason, s.severity AS severity,
  'pending' AS review_status, s.kind AS fraud_type
FROM (SELECT click_id, ad_id, unnest(signals) AS s FROM judged_clicks WHERE is_fraudulent)""")
def _(t):
    return fraud.fraud_reports(analysed(t))


@query("fraud_scan_summary", f"""
WITH recent AS (SELECT * FROM judged_clicks WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 240 HOUR),
kinds AS (SELECT unnest(signals).kind AS kind FROM recent WHERE is_fraudulent)
SELECT 'total_analyzed' AS measure, count(*) AS count FROM recent
UNION ALL SELECT 'fraudulent', count(*) FILTER (is_fraudulent) FROM recent
UNION ALL SELECT 'high_risk', count(*) FILTER (risk_score >= 0.7::DOUBLE) FROM recent
UNION ALL SELECT 'medium_risk', count(*) FILTER (risk_score >= 0.5 AND risk_score < 0.7::DOUBLE) FROM recent
UNION ALL SELECT 'low_risk', count(*) FILTER (risk_score >= 0.3::DOUBLE AND risk_score < 0.5) FROM recent
UNION ALL SELECT 'reports', CAST(coalesce(sum(len(signals)) FILTER (is_fraudulent), 0) AS BIGINT) FROM recent
UNION ALL SELECT 'type:' || kind, count(*) FROM kinds GROUP BY kind""")
def _(t):
    return fraud.scan_summary(analysed(t), AS_OF, 240)
