"""Consent, audit, retention and summaries (C1-C6, A9-A11, A16, WN9)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import vocab
from tidemark.functions.timing import at
from tidemark.operators import ordered

AUDIT_DAYS, AUDIT_LIMIT = 90, 100  # fixed values


def consent_latest(consents: DataFrame) -> DataFrame:
    """WN9: newest record per user and type."""
    return ordered.first_per_key(consents, ["user_id", "consent_type"], [F.col("created_at"), F.col("id")], largest=True)


def consent_state(consents: DataFrame, as_of: str) -> DataFrame:
    """The newest record decides; expired or withdrawn consent is not granted."""
    ended = F.coalesce(F.col("expires_at") < at(as_of), F.lit(False))
    gone = F.col("withdrawn_at").isNotNull()
    return consent_latest(consents).select(
        "user_id", "consent_type", (F.col("granted") & ~ended & ~gone).alias("is_granted"),
        F.when(ended, "expired").when(gone, "withdrawn").when(F.col("granted"), "granted").otherwise("denied").alias("status"))


def with_consent(events: DataFrame, consents: DataFrame, consent_type: str, as_of: str) -> DataFrame:
    """Events of users who consent."""
    users = consent_state(consents, as_of).where((F.col("consent_type") == consent_type) & F.col("is_granted")).select("user_id")
    return events.join(users, "user_id", "left_semi")


def audit_query(audit: DataFrame, filters: Mapping[str, object] | None = None, start: str | None = None, end: str | None = None,
                limit: int = AUDIT_LIMIT, offset: int = 0) -> DataFrame:
    """Newest first."""
    for column, value in (filters or {}).items():
        if value is not None:
            audit = audit.where(F.col(column) == value)
    if start is not None:
        audit = audit.where(F.col("ts") >= at(start))
    if end is not None:
        audit = audit.where(F.col("ts") <= at(end))
    return audit.orderBy(F.col("ts").desc(), F.col("id").desc()).offset(offset).limit(limit)


def audit_recent(audit: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Events of the last hours."""
    return audit.where(F.col("ts") >= at(as_of) - F.expr(f"INTERVAL {hours} HOURS"))


def audit_purge(audit: DataFrame, as_of: str, days: int = AUDIT_DAYS) -> DataFrame:
    """C4: what is kept."""
    return audit.where(F.col("ts") >= at(as_of) - F.expr(f"INTERVAL {days} DAYS"))


def audit_stats(audit: DataFrame, as_of: str) -> DataFrame:
    """Total, by type, by day of the last week, last day, as (measure, count) rows, from one pass:
    every event adds to the measures it belongs to before anything is shuffled."""
    week, day = (at(as_of) - F.expr(f"INTERVAL {d} DAYS") for d in (7, 1))
    measures = F.array_compact(F.array(
        F.lit("total"), F.concat(F.lit("type:"), "event_type"),
        F.when(F.col("ts") >= week, F.concat(F.lit("day:"), F.date_format("ts", "yyyy-MM-dd"))),
        F.when(F.col("ts") >= day, F.lit("last_24h"))))
    return audit.select(F.explode(measures).alias("measure")).groupBy("measure").agg(F.count(F.lit(1)).alias("count"))


def consent_summary(consents: DataFrame) -> DataFrame:
    """A10: totals, one row per type (also those without records), and the granted share in percent."""
    per_type = F.array(*[F.struct(F.lit(f"type:{c}").alias("measure"),
                                  F.count_if(F.col("consent_type") == c).cast("double").alias("value")) for c in vocab.CONSENT_TYPES])
    n, yes = F.count(F.lit(1)), F.count_if(F.col("granted"))
    head = F.array(*[F.struct(F.lit(k).alias("measure"), v.cast("double").alias("value")) for k, v in [
        ("total", n), ("granted", yes), ("denied", F.count_if(~F.col("granted"))),
        ("compliance_rate", yes / F.greatest(n, F.lit(1)) * 100)]])
    return consents.agg(F.concat(head, per_type).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def compliance_report(ads: DataFrame, metrics: DataFrame, clicks: DataFrame, conversions: DataFrame, as_of: str) -> DataFrame:
    """Row counts, expired facts and the level, one row."""
    counts = {"ads": ads, "clicks": clicks, "conversions": conversions}
    facts = metrics.agg(F.count(F.lit(1)).alias("metrics"), F.count_if(F.col("expires_at") < at(as_of)).alias("expired"))
    scalars = {n: df.agg(F.count(F.lit(1)).alias("n")).scalar().alias(n) for n, df in counts.items()}
    return facts.select(*scalars.values(), "metrics", "expired", F.when(F.col("expired") == 0, "high").otherwise("medium").alias("level"))


def retention_policy(df: DataFrame, ts: str, as_of: str, name: str) -> DataFrame:
    """Per retention class when data collected at as_of is deleted, and how many rows are past it now."""
    rows = F.array(*[F.struct(F.lit(k).alias("retention"), F.timestamp_add("HOUR", F.lit(h), at(as_of)).alias("deletion_date"),
                              F.count_if(F.col(ts) < F.timestamp_add("HOUR", F.lit(-h), at(as_of))).alias("affected"))
                     for k, h in vocab.RETENTION_HOURS.items()])
    return df.agg(rows.alias("rows")).select(F.explode("rows").alias("r")).select(F.lit(name).alias("data_type"), "r.*")


def anonymise_rows(df: DataFrame, columns: Sequence[str], salt: str) -> DataFrame:
    """Identifiers replaced by salted hashes."""
    return df.withColumns({c: F.sha2(F.concat(F.lit(salt), F.col(c).cast("string")), 256) for c in columns})


def latency_summary(df: DataFrame, group: str, value: str, width: float, ok=None) -> DataFrame:
    """Count, extremes, mean, median, deviation, p95, p99 and success rate of a numeric column.

    Percentiles are exact. Equal values fold first; the running count over them is a bucketed prefix sum
    (``width`` is the bucket size in units of the value), so one large group is not sorted by one task.
    """
    n = F.count(F.lit(1))
    base = df.groupBy(group).agg(n.alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"),
                                 F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev"),
                                 (F.count_if(F.lit(True) if ok is None else ok) / n).alias("success_rate"))
    df = df.where(F.col(value).isNotNull())  # a null is counted, but has no rank
    folded = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    running = ordered.prefix_sums(folded, [group], value, ["n"], F.lit(width)).join(df.groupBy(group).agg(n.alias("count")), group)
    v, cum, total = F.col(value), F.col("n"), F.col("count")
    at_index = lambda i: F.min(F.when(cum > i, v))
    q = running.groupBy(group).agg(
        at_index(F.floor((total - 1) / 2)).alias("m1"), at_index(F.floor(total / 2)).alias("m2"),
        at_index(F.least(F.floor(total * 0.95), total - 1)).alias("p95"), at_index(F.least(F.floor(total * 0.99), total - 1)).alias("p99"))
    return base.join(q, group).select(*base.columns, ((F.col("m1") + F.col("m2")) / 2).alias("median"), "p95", "p99")
