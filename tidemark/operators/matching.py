"""Ad matching and service recommendation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import hashing, vocab
from tidemark.functions.text import clamp, count_contains
from tidemark.functions.timing import at
from tidemark.operators import filters, ordered

AD_WEIGHTS = (0.40, 0.30, 0.20, 0.10)  # fixed values
AD_THRESHOLD, AD_TOP = 0.3, 5  # fixed values
SERVICE_WEIGHTS = (0.40, 0.30, 0.15, 0.15)  # fixed values
SERVICE_THRESHOLD = 0.1  # fixed value
ALIGN_WEIGHTS = (0.35, 0.25, 0.15, 0.15, 0.10)  # fixed values
METRIC_DAYS = 30  # fixed value


def similarity(a: Column, b: Column) -> Column:
    return (hashing.similarity(a, b) + 1) / 2


def tag_alignment(signals: Column, tags: Column) -> Column:
    """Half a point per signal that some tag names by dimension or preference, over the number of signals."""
    hits = F.size(F.filter(signals, lambda s: F.exists(tags, lambda t: F.contains(F.lower(t), F.lower(s["dimension"]))
                                                       | F.contains(F.lower(t), F.lower(s["preference"])))))
    return F.when(F.size(signals) == 0, 0.5).otherwise(F.least(F.lit(1.0), hits * 0.5 / F.size(signals)))


def ad_goal_score(goal: Column, content: Column) -> Column:
    low = F.lower(content)
    hits = None
    for g, ws in vocab.AD_GOAL_WORDS.items():
        hits = F.when(goal == g, count_contains(low, ws)) if hits is None else hits.when(goal == g, count_contains(low, ws))
    fallback = similarity(F.translate(F.upper(goal), "_", " "), low)
    return F.when(goal.isNull(), 0.5).when(hits > 0, F.least(F.lit(1.0), hits * 0.3)).otherwise(fallback)


def ad_relevance(rows: DataFrame) -> DataFrame:
    """M1: relevance of ads beside their request's text, goal and ethical_signals."""
    content = F.trim(F.concat_ws(" ", "title", "description"))
    semantic = F.when(F.col("text") == "", 0.5).when(content == "", 0.0).otherwise(similarity(F.col("text"), content))
    parts = rows.select("*", semantic.alias("semantic_score"), tag_alignment(F.col("ethical_signals"), F.col("ethical_tags")).alias("ethical_score"),
                        ad_goal_score(F.col("goal"), content).alias("goal_score"))
    w = AD_WEIGHTS
    return parts.withColumn("relevance", clamp(F.col("semantic_score") * w[0] + F.col("ethical_score") * w[1]
                                               + F.col("goal_score") * w[2] + F.col("quality_score") * w[3]))


def ad_stages(requests: DataFrame, offered: DataFrame, threshold: float = AD_THRESHOLD) -> DataFrame:
    """Offered ads with a flag per stage; a later flag implies the earlier ones."""
    rows = filters.request_join(requests, offered)
    fair = filters.ad_fair(F.col("forbidden_dimensions"))
    flagged = rows.select("*", fair.alias("fair"), (fair & filters.ad_constraints_ok(F.col("constraints"), F.col("targeting"))).alias("fits"))
    return ad_relevance(flagged).withColumn("relevant", F.col("fits") & (F.col("relevance") > threshold))


def match_ads(requests: DataFrame, offered: DataFrame, threshold: float = AD_THRESHOLD, k: int = AD_TOP) -> DataFrame:
    """M2: best k ads per request. Failing ads are filtered before any score is computed."""
    rows = filters.request_join(requests, offered)
    rows = rows.where(filters.ad_fair(F.col("forbidden_dimensions"))).where(
        filters.ad_constraints_ok(F.col("constraints"), F.col("targeting")))
    good = ad_relevance(rows).where(F.col("relevance") > threshold)
    return ordered.top_k(good, ["query_id"], [F.col("relevance").desc(), F.col("ad_id")], k)


def ad_funnel(requests: DataFrame, offered: DataFrame, threshold: float = AD_THRESHOLD, k: int = AD_TOP) -> DataFrame:
    """M2: how many ads pass each stage, per request."""
    flags = ad_stages(requests, offered, threshold)
    n = F.count_if(F.col("relevant"))
    return flags.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("evaluated"), F.count_if("fair").alias("passed_fairness"), F.count_if("fits").alias("passed_constraints"),
        n.alias("passed_relevance"), (F.count(F.lit(1)) - F.least(n, F.lit(k))).alias("filtered"))


def ad_compliance(ads: DataFrame) -> DataFrame:
    """M3: one row per violation: targeting on a forbidden key (HIGH), a forbidden declared dimension (MEDIUM)."""
    bad = lambda d: F.lower(d).isin(vocab.COMPLIANCE_FORBIDDEN_DIMENSIONS)
    kind = lambda t, s: lambda d: F.struct(F.lit(t).alias("type"), d.alias("dimension"), F.lit(s).alias("severity"))
    targeted = F.transform(F.filter(F.coalesce(F.map_keys("targeting"), F.array().cast("array<string>")), bad),
                           kind("forbidden_targeting_dimension", "HIGH"))
    declared = F.transform(F.filter("forbidden_dimensions", bad), kind("forbidden_forbidden_dimension", "MEDIUM"))
    return ads.select("ad_id", F.explode(F.concat(targeted, declared)).alias("v")).select("ad_id", "v.*")


def match_metrics(matched: DataFrame, as_of: str) -> DataFrame:
    """One fact row per matched ad, ready to append to the metrics table partitioned by date."""
    return matched.select(
        "query_id", "ad_id", at(as_of).cast("date").alias("date"), F.col("goal").alias("intent_goal"),
        F.get("use_cases", 0).alias("intent_use_case"), F.lit(1).cast("bigint").alias("impression_count"),
        F.lit(0).cast("bigint").alias("click_count"), F.lit(0).cast("bigint").alias("conversion_count"),
        (at(as_of) + F.expr(f"INTERVAL {METRIC_DAYS} DAYS")).alias("expires_at"))


# ---------------------------------------------------------------- services
def recommend_services(requests: DataFrame, offered: DataFrame) -> DataFrame:
    """M4: services above the threshold, numbered by score per request."""
    rows = filters.request_join(requests, offered)
    goal, goals = F.col("goal"), F.col("supported_goals")
    goal_score = F.when(goal.isNull(), 0.5).when(F.array_contains(goals, goal), 1.0).otherwise(
        similarity(F.translate(goal, "_", " "), F.translate(F.array_join(goals, " "), "_", " ")))
    cases = F.col("primary_use_cases")
    joined = F.array_join(cases, " ")
    total = F.lit(0.0)
    for u in vocab.USE_CASES:
        name = u.replace("_", " ")
        direct = _direct(cases, name)
        total = total + F.when(F.array_contains("use_cases", u), F.when(direct, 1.0).otherwise(similarity(F.lit(name), joined))).otherwise(0.0)
    case_score = F.when(F.size("use_cases") == 0, 0.5).when(F.size(cases) == 0, 0.0).otherwise(F.least(F.lit(1.0), total / F.size("use_cases")))
    has = lambda *ps: F.arrays_overlap("temporal_patterns", F.array(*[F.lit(p) for p in ps]))
    h, f, r = F.col("temporal.horizon"), F.col("temporal.frequency"), F.col("temporal.recency")
    temporal = (F.lit(0.5)
                + F.when((h == "today") & has("short_session", "quick_access"), 0.2)
                .when(h.isin("week", "longterm") & has("long_session", "extended_work"), 0.2).otherwise(0.0)
                + F.when((f == "recurring") & has("recurring_edit", "regular_updates"), 0.15)
                .when((f == "oneoff") & has("one_time_task", "quick_completion"), 0.15).otherwise(0.0)
                + F.when((r == "recent") & has("real_time", "live_updates"), 0.1).otherwise(0.0))
    w = SERVICE_WEIGHTS
    scored = rows.withColumn("service_score", clamp(
        goal_score * w[0] + case_score * w[1] + F.when(F.col("temporal").isNull(), 0.5).otherwise(clamp(temporal)) * w[2]
        + tag_alignment(F.col("ethical_signals"), F.col("ethical_alignment")) * w[3]))
    return ordered.ranked(scored.where(F.col("service_score") > SERVICE_THRESHOLD), ["query_id"], "service_score", "service_id")


def _direct(cases: Column, name: str) -> Column:
    return F.exists(cases, lambda c: F.lit(name).contains(F.lower(c)) | F.lower(c).contains(name))


# ---------------------------------------------------------------- documents against queries
def alignment(rows: DataFrame) -> DataFrame:
    """M5: how well a document's intent (doc_*) fits a query's intent (goal, use_cases, skill_level,
    ethical_signals, temporal)."""
    related = F.create_map(*[x for g, rs in vocab.RELATED_GOALS.items() for x in (F.lit(g), F.array(*[F.lit(r) for r in rs]))])
    goal, doc_goal = F.col("goal"), F.col("doc_goal")
    goal_match = F.when(doc_goal == goal, 1.0).when(F.array_contains(F.try_element_at(related, goal), doc_goal), 0.6).otherwise(0.0)
    asked = F.array_distinct("use_cases")
    case_match = F.when(F.size(asked) > 0, F.size(F.array_intersect("doc_use_cases", asked)) / F.size(asked)).otherwise(0.0)
    level = {"simple": 0, "moderate": 1, "advanced": 2}
    skill = {"beginner": 0, "intermediate": 1, "advanced": 2, "expert": 2}
    exact = {"simple": "beginner", "moderate": "intermediate", "advanced": "advanced"}
    as_map = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    diff = F.abs(F.try_element_at(as_map(level), F.col("doc_complexity")) - F.try_element_at(as_map(skill), F.col("skill_level")))
    level_match = F.when(F.try_element_at(as_map(exact), F.col("doc_complexity")) == F.col("skill_level"), 1.0).when(diff == 1, 0.7).otherwise(0.3)
    dims = F.array_distinct(F.transform("ethical_signals", lambda s: s["dimension"]))
    doc_dims = F.transform("doc_ethical_signals", lambda s: s["dimension"])
    ethic = F.when(F.size(dims) > 0, F.size(F.filter(doc_dims, lambda d: F.array_contains(dims, d))) / F.size(dims)).otherwise(0.0)
    temporal = (F.when(F.col("temporal").isNotNull() & F.col("doc_recency").isNotNull() & (F.col("temporal.recency") == F.col("doc_recency")), 1.0)
                .otherwise(0.5))
    w = ALIGN_WEIGHTS
    return rows.withColumn("alignment", F.when(doc_goal.isNull(), 0.5).otherwise(
        F.coalesce(goal_match, F.lit(0.0)) * w[0] + case_match * w[1] + level_match * w[2] + ethic * w[3] + temporal * w[4]))
