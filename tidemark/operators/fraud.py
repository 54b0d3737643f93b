"""Click, conversion and impression fraud scoring (WN1-WN3, A7, A8, F1-F11).

Windows are anchored at each event's own time. Keys such as an IP can be very busy, so trailing counts
are differences of bucketed running sums (see ``operators/ordered.py``), never one window per IP.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import vocab
from tidemark.functions.text import contains_any, keep
from tidemark.functions.timing import DAY, HOUR, MINUTE, SECOND, at, micros
from tidemark.operators import ordered


@dataclass(frozen=True)
class Velocity:
    """One trailing check: keys, window in microseconds, limit, and the signal it raises."""

    name: str
    keys: tuple[str, ...]
    window: int
    limit: int
    kind: str
    severity: str
    confidence: float
    reason: str
    show_limit: bool = False

    def bucket(self) -> int:
        return max(self.window // 6, SECOND)


VELOCITY = (
    Velocity("ip_minute", ("ip_hash",), MINUTE, 5, "velocity_violation", "high", 0.9,
             "Excessive clicks per minute: ", True),
    Velocity("ip_hour", ("ip_hash",), HOUR, 30, "velocity_violation", "medium", 0.8,
             "Excessive clicks per hour: ", True),
    Velocity("session_minute", ("session_id",), MINUTE, 3, "click_fraud", "high", 0.85,
             "Excessive clicks per session per minute: "),
    Velocity("ip_ad_day", ("ip_hash", "ad_id"), DAY, 5, "click_fraud", "medium", 0.75,
             "Multiple clicks on same ad from same IP: "),
)
IMPRESSION_VELOCITY = (
    Velocity("ip_minute", ("ip_hash",), MINUTE, 100, "velocity_violation", "high", 0.9,
             "Excessive impressions per minute: ", True),
)
PROXY_AGENTS = 5  # fixed value
TIMING_CLICKS, TIMING_MIN = 10, 3  # fixed values
TIMING_VARIANCE, TIMING_MEAN = 0.1, 1.0  # fixed values, seconds
FAST_CONVERSION_SECONDS = 5  # fixed value
SIGNAL = "struct<kind:string,severity:string,confidence:double,reason:string>"


def signal(kind: str, severity: str, confidence: float, reason: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"),
                    F.lit(confidence).alias("confidence"), reason.alias("reason"))


def no_signals() -> Column:
    return F.array().cast(f"array<{SIGNAL}>")


def click_velocity(events: DataFrame, event_id: str, checks: tuple[Velocity, ...] = VELOCITY) -> DataFrame:
    """WN1: trailing counts per event. Events without an IP are not counted."""
    slim = events.where(F.col("ip_hash").isNotNull()).select(
        event_id, *sorted({k for c in checks for k in c.keys}), micros(F.col("ts")).alias("pos"))
    return ordered.trailing_counts(slim, event_id, "pos", [(c.name, c.keys, c.window, c.bucket()) for c in checks])


def velocity_signals(checks: tuple[Velocity, ...] = VELOCITY) -> Column:
    """signals of the counts that reach their limit."""
    rules = []
    for c in checks:
        reason = F.concat(F.lit(c.reason), F.col(c.name).cast("string"),
                          F.lit(f" (threshold: {c.limit})" if c.show_limit else ""))
        rules.append((signal(c.kind, c.severity, c.confidence, reason), F.col(c.name) >= c.limit))
    return keep(rules)


def agent() -> Column:
    """The user agent, else its hash; blank counts as missing."""
    return F.coalesce(F.nullif("user_agent", F.lit("")), F.nullif("user_agent_hash", F.lit("")))


def bot_signals() -> Column:
    """missing, known bot, or suspicious agent. A known bot reports the first pattern in the list."""
    ua = agent()
    pattern = None
    for p in vocab.BOT_PATTERNS:
        hit = F.lower(ua).contains(p)
        pattern = F.when(hit, p) if pattern is None else pattern.when(hit, p)
    odd = None
    for p in vocab.SUSPICIOUS_AGENTS:
        odd = F.when(ua.rlike(p), p) if odd is None else odd.when(ua.rlike(p), p)
    return keep([
        (signal("bot_traffic", "medium", 0.6, F.lit("Missing user agent")), ua.isNull()),
        (signal("bot_traffic", "high", 0.95, F.concat(F.lit("Known bot user agent pattern detected: "), pattern)),
         pattern.isNotNull()),
        (signal("bot_traffic", "medium", 0.7, F.concat(F.lit("Suspicious user agent pattern: "), odd)),
         odd.isNotNull()),
    ])


def ip_user_agents(events: DataFrame, event_id: str, window: int = HOUR) -> DataFrame:
    """Distinct agents of the IP in the trailing window, exact."""
    slim = events.select(event_id, "ip_hash", "user_agent_hash", micros(F.col("ts")).alias("pos"))
    return ordered.trailing_distinct(slim, event_id, "ip_hash", "user_agent_hash", "pos", window,
                                     max(window // 6, SECOND), "user_agents")


def proxy_signals() -> Column:
    """F2."""
    n = F.col("user_agents")
    reason = F.concat(F.lit("Multiple user agents ("), n.cast("string"), F.lit(") from same IP - possible proxy/VPN"))
    return keep([(signal("ip_anomaly", "medium", 0.7, reason), n >= PROXY_AGENTS)])


def machine_timing(events: DataFrame, event_id: str, window: int = 5 * SECOND) -> DataFrame:
    """WN2: mean and variance of the gaps between the newest (at most ten) clicks of the IP in the window.

    Windows run inside time slices as long as the window; each slice also sees the rows of the slice
    before it, so a busy IP is spread over as many tasks as it has slices.
    """
    slim = events.where(F.col("ip_hash").isNotNull()).select(event_id, "ip_hash", micros(F.col("ts")).alias("pos"))
    home = F.floor(F.col("pos") / F.lit(window))
    sliced = slim.select("*", F.explode(F.array(
        F.struct(home.alias("slice"), F.lit(True).alias("own")),
        F.struct((home + 1).alias("slice"), F.lit(False).alias("own")))).alias("s")).select(event_id, "ip_hash", "pos", "s.*")
    w = Window.partitionBy("ip_hash", "slice").orderBy("pos", event_id)
    recent = F.array_compact(F.array(F.col("pos"), *[F.lag("pos", i).over(w) for i in range(1, TIMING_CLICKS)]))
    near = sliced.withColumn("recent", recent).where(F.col("own")).withColumn(
        "recent", F.filter("recent", lambda p: p >= F.col("pos") - window))
    gaps = near.where(F.size("recent") >= TIMING_MIN).withColumn("gaps", F.transform(
        F.sequence(F.lit(1), F.size("recent") - 1),
        lambda i: (F.element_at("recent", i) - F.element_at("recent", i + 1)) / F.lit(float(SECOND))))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    mean = total(F.col("gaps")) / F.size("gaps")
    with_mean = gaps.withColumn("mean_gap", mean)
    return with_mean.select(
        event_id, F.size("recent").alias("recent_clicks"), "mean_gap",
        (total(F.transform("gaps", lambda g: (g - F.col("mean_gap")) * (g - F.col("mean_gap")))) / F.size("gaps"))
        .alias("gap_variance"))


def timing_signals(max_variance: float = TIMING_VARIANCE, max_mean: float = TIMING_MEAN) -> Column:
    reason = F.concat(F.lit("Machine-like click timing pattern detected (variance: "),
                      F.format_string("%.4f", F.col("gap_variance")), F.lit(")"))
    return keep([(signal("click_fraud", "high", 0.85, reason),
                  (F.col("gap_variance") < max_variance) & (F.col("mean_gap") < max_mean))])


def device_signals() -> Column:
    """mobile agent on a wide screen, or the reverse."""
    ua = F.nullif("user_agent", F.lit(""))
    mobile = contains_any(F.lower(ua), vocab.MOBILE_AGENT_WORDS)
    narrow = F.col("screen_width") < vocab.MOBILE_SCREEN_BELOW
    reason = F.lit("Device type mismatch between user agent and screen size")
    return keep([(signal("device_spoofing", "medium", 0.65, reason), (F.col("screen_width") > 0) & (mobile != narrow))])


def risk_score(signals: Column) -> Column:
    """strongest weighted signal plus a bonus for company, at most 1."""
    weights = F.create_map(*[x for k, v in vocab.SEVERITY_WEIGHT.items() for x in (F.lit(k), F.lit(v))])
    strongest = F.array_max(F.transform(signals, lambda s: s["confidence"] * F.coalesce(weights[s["severity"]], F.lit(0.5))))
    bonus = F.least(F.lit(0.1) * (F.size(signals) - 1), F.lit(0.2))
    return F.when(F.size(signals) > 0, F.least(strongest + bonus, F.lit(1.0))).otherwise(0.0)


def recommended_action(risk: Column) -> Column:
    """F7."""
    return (F.when(risk >= vocab.RISK_HIGH, "block_and_investigate").when(risk >= vocab.RISK_MEDIUM, "flag_for_review")
            .when(risk >= vocab.RISK_LOW, "monitor").otherwise("allow"))


def judge(rows: DataFrame) -> DataFrame:
    """Risk, verdict and action from a ``signals`` column."""
    return (rows.withColumn("risk_score", risk_score(F.col("signals")))
            .withColumn("is_fraudulent", F.col("risk_score") >= vocab.RISK_HIGH)
            .withColumn("recommended_action", recommended_action(F.col("risk_score"))))


def analyse_clicks(clicks: DataFrame, checks: tuple[Velocity, ...] = VELOCITY, agents_window: int = HOUR,
                   timing_window: int = 5 * SECOND) -> DataFrame:
    """F8: all click checks of every click."""
    base = clicks.join(click_velocity(clicks, "click_id", checks), "click_id", "left").join(
        ip_user_agents(clicks, "click_id", agents_window), "click_id", "left").join(
        machine_timing(clicks, "click_id", timing_window), "click_id", "left")
    signals = F.concat(velocity_signals(checks), bot_signals(), proxy_signals(), timing_signals(), device_signals())
    return judge(base.withColumn("signals", signals))


def duplicate_conversions(conversions: DataFrame) -> DataFrame:
    """WN3: conversions per click. Counted with partial aggregation and joined back."""
    per_click = conversions.where(F.col("click_id").isNotNull()).groupBy("click_id").agg(
        F.count(F.lit(1)).alias("same_click"))
    return conversions.join(per_click, "click_id", "left")


def analyse_conversions(conversions: DataFrame, clicks: DataFrame, fast_seconds: float = FAST_CONVERSION_SECONDS) -> DataFrame:
    """too fast after the click, or several for one click."""
    timed = duplicate_conversions(conversions).join(
        clicks.select("click_id", F.col("ts").alias("click_ts")), "click_id", "left")
    seconds = (micros(F.col("ts")) - micros(F.col("click_ts"))) / F.lit(float(SECOND))
    fast = F.concat(F.lit("Suspiciously fast conversion: "), F.format_string("%.1f", seconds), F.lit("s"))
    many = F.concat(F.lit("Multiple conversions ("), F.col("same_click").cast("string"), F.lit(") from same click"))
    return judge(timed.withColumn("seconds_to_conversion", seconds).withColumn("signals", keep([
        (signal("conversion_fraud", "high", 0.9, fast), seconds < fast_seconds),
        (signal("conversion_fraud", "high", 0.95, many), F.col("same_click") > 1)])))


def analyse_impressions(impressions: DataFrame, checks: tuple[Velocity, ...] = IMPRESSION_VELOCITY) -> DataFrame:
    """impressions per IP in the trailing window, and the agent checks."""
    base = impressions.join(click_velocity(impressions, "impression_id", checks), "impression_id", "left")
    return judge(base.withColumn("signals", F.concat(velocity_signals(checks), bot_signals())))


def fraud_reports(analysed: DataFrame) -> DataFrame:
    """one report row per signal of each fraudulent click."""
    return analysed.where(F.col("is_fraudulent")).select(
        F.col("click_id").alias("event_id"), F.lit("click").alias("event_type"), "ad_id",
        F.explode("signals").alias("s")).select(
        "event_id", "event_type", "ad_id", "s.reason", "s.severity", F.lit("pending").alias("review_status"),
        F.col("s.kind").alias("fraud_type"))


def scan_summary(analysed: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Counts over the clicks of the last hours, as (measure, count) rows."""
    recent = analysed.where(F.col("ts") >= at(as_of) - F.expr(f"INTERVAL {hours} HOURS"))
    risk, bad = F.col("risk_score"), F.col("is_fraudulent")
    totals = {
        "total_analyzed": F.count(F.lit(1)), "fraudulent": F.count_if(bad), "high_risk": F.count_if(risk >= vocab.RISK_HIGH),
        "medium_risk": F.count_if((risk >= vocab.RISK_MEDIUM) & (risk < vocab.RISK_HIGH)),
        "low_risk": F.count_if((risk >= vocab.RISK_LOW) & (risk < vocab.RISK_MEDIUM)),
        "reports": F.coalesce(F.sum(F.when(bad, F.size("signals"))), F.lit(0)),
    }
    one = recent.agg(*[c.cast("bigint").alias(n) for n, c in totals.items()])
    long = one.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("measure"), F.col(n).alias("count")) for n in totals])).alias("m")).select("m.*")
    kinds = (recent.where(bad).select(F.explode("signals").alias("s"))
             .groupBy(F.concat(F.lit("type:"), F.col("s.kind")).alias("measure")).agg(F.count(F.lit(1)).alias("count")))
    return long.unionByName(kinds)
