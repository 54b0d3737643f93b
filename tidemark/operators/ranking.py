"""Result ranking by intent (R1s-R8s, SK, J9, J10, M6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import hashing, vocab
from tidemark.functions.text import any_of, clamp, contains_any, jaccard, keep, overlap_ratio, word_set
from tidemark.functions.timing import at, days_between, parse_instant
from tidemark.operators import dedup, filters, ordered
from tidemark.session import once, stored

WEIGHTS_V1 = (0.30, 0.20, 0.15, 0.15, 0.10, 0.10)  # fixed values
WEIGHTS_V2 = (0.35, 0.20, 0.15, 0.15, 0.10, 0.05)  # fixed values
DEDUP_COSINE = 0.85  # fixed value
COMPATIBLE_SKILLS = {"beginner": ["intermediate"], "intermediate": ["beginner", "advanced"],
                     "advanced": ["intermediate", "expert"], "expert": []}  # fixed values


def keyword_score_v2(query: Column, content: Column) -> Column:
    """R1s, second profile."""
    return F.coalesce(overlap_ratio(query, content) * 0.8, F.lit(0.5))


def keyword_score_url(query: Column, content: Column) -> Column:
    """R1s, URL variant."""
    return F.when(F.trim(content) == "", 0.3).otherwise(F.coalesce(overlap_ratio(query, content) * 0.5 + 0.3, F.lit(0.5)))


def unit_cosine(a: Column, b: Column) -> Column:
    """R2s: cosine moved to 0-1."""
    return (hashing.cosine(a, b) + 1) / 2


def skill_score(declared: Column, complexity: Column, profile: str) -> Column:
    """SK: same level 1; close levels 0.8; else 0.2 (0.3 in the second profile); unknown 0.5."""
    levels = {s: i for i, s in enumerate(vocab.SKILL_LEVELS)}
    table = F.create_map(*[F.lit(x) for kv in levels.items() for x in kv])
    a, b = F.try_element_at(table, declared), F.try_element_at(table, complexity)
    if profile == "v2":
        close, far = F.abs(a - b) == 1, 0.3
    else:
        close, far = any_of((declared == d) & complexity.isin(cs) for d, cs in COMPATIBLE_SKILLS.items() if cs), 0.2
    return F.when(b.isNull(), 0.5).when(declared == complexity, 1.0).when(close, 0.8).otherwise(far)


def use_case_score(use_cases: Column, tags: Column, tag_text: Column, cosines: Column, profile: str) -> Column:
    """R3s: 0.5 per use case named in the tags, else a share of the similarity; mean, at most 1. ``cosines``: of the tags'
    text and each use case's name."""
    total = F.lit(0.0)
    for i, u in enumerate(vocab.USE_CASES):
        name = u.replace("_", " ")
        cos = F.get(cosines, F.lit(i))
        near = (cos + 1) / 2 * 0.3 if profile == "v1" else F.when(cos > 0.5, cos * 0.3).otherwise(0.0)
        total = total + F.when(F.array_contains(use_cases, u), F.when(tag_text.contains(name), 0.5).otherwise(near)).otherwise(0.0)
    mean = F.least(F.lit(1.0), total / F.size(use_cases))
    if profile == "v1":
        return F.when(F.size(use_cases) == 0, 0.5).when(F.size(tags) == 0, 0.0).otherwise(mean)
    return F.when((F.size(use_cases) == 0) | (F.size(tags) == 0), 0.5).otherwise(mean)


def ethical_score(signals: Column, profile: str) -> Column:
    """R4s."""
    private = F.when(F.col("privacy_rating") > 0.7, 0.5).otherwise(0.0)
    opened = F.when(F.col("opensource"), 0.5).otherwise(0.0)
    if profile == "v2":
        low = F.lower("description")
        private = private + F.when(contains_any(low, vocab.PRIVACY_TEXT_WORDS), 0.2).otherwise(0.0)
        opened = opened + F.when(contains_any(low, vocab.OPEN_TEXT_WORDS), 0.2).otherwise(0.0)
        opened_if = lambda s: opened
    else:
        opened_if = lambda s: F.when(s["preference"] == "open-source_preferred", opened).otherwise(0.0)
    total = F.aggregate(signals, F.lit(0.0), lambda acc, s: acc + F.when(s["dimension"] == "privacy", private).when(
        s["dimension"] == "openness", opened_if(s)).otherwise(0.0))
    return F.when(F.size(signals) == 0, 0.5).otherwise(F.least(F.lit(1.0), total / F.size(signals)))


def temporal_score(temporal: Column, recency: Column, as_of: str, profile: str) -> Column:
    """R5s."""
    days = days_between(at(as_of), parse_instant(recency))
    recent, horizon = temporal["recency"] == "recent", temporal["horizon"]
    if profile == "v2":
        fresh = F.when(recent & (days <= 30), 0.3).when(recent & (days <= 90), 0.1).otherwise(0.0)
        soon = F.when((horizon == "today") & (days <= 1), 0.2).when((horizon == "week") & (days <= 7), 0.15).otherwise(0.0)
    else:
        fresh = F.when(recent & (days <= 30), 0.2).when(recent & (days <= 180), 0.1).otherwise(0.0)
        soon = F.when((horizon == "today") & (days <= 1), 0.2).otherwise(0.0)
    return F.when(temporal.isNull(), 0.5).otherwise(clamp(F.lit(0.5) + fresh + soon))


def with_similarities(rows: DataFrame) -> DataFrame:
    """Rows with what both profiles compare: content and tags as texts, their cosines with the request and with every use case."""
    texts = once(rows, _content=F.trim(F.concat_ws(" ", "title", "description")), _tag_text=F.lower(F.array_join("tags", " ")))
    return texts.withColumns({"_cosine": hashing.similarity(F.col("text"), F.col("_content")),
                              "_case_cosines": hashing.similarities(F.col("_tag_text"), [u.replace("_", " ") for u in vocab.USE_CASES])})


def score(rows: DataFrame, as_of: str, profile: str = "v1") -> DataFrame:
    """R6s: part scores, alignment and reasons of candidates beside their request's intent columns
    (text, use_cases, ethical_signals, skill_level, temporal)."""
    staged = rows if "_cosine" in rows.columns else with_similarities(rows)
    cosine01 = (F.col("_cosine") + 1) / 2
    query = cosine01 if profile == "v1" else cosine01 * 0.7 + keyword_score_v2(F.col("text"), F.col("_content")) * 0.3
    parts = staged.select(
        *rows.columns, cosine01.alias("semantic_score"),
        F.when(F.col("text") == "", 0.5).when(F.col("_content") == "", 0.0).otherwise(query).alias("query_score"),
        use_case_score(F.col("use_cases"), F.col("tags"), F.col("_tag_text"), F.col("_case_cosines"), profile).alias("use_case_score"),
        ethical_score(F.col("ethical_signals"), profile).alias("ethical_score"),
        skill_score(F.col("skill_level"), F.col("complexity"), profile).alias("skill_score"),
        temporal_score(F.col("temporal"), F.col("recency"), as_of, profile).alias("temporal_score"),
        F.coalesce(F.nullif("quality_score", F.lit(0.0)), F.lit(0.5)).alias("quality_part"))
    names = ["query_score", "use_case_score", "ethical_score", "skill_score", "temporal_score", "quality_part"]
    total = F.lit(0.0)
    for n, w in zip(names, WEIGHTS_V1 if profile == "v1" else WEIGHTS_V2):
        total = total + F.col(n) * w
    return parts.withColumn("alignment_score", clamp(total)).withColumn("match_reasons", reasons(profile))


def reasons(profile: str) -> Column:
    tag_text = F.lower(F.array_join("tags", " "))
    signals, skill = F.col("ethical_signals"), F.col("skill_score")
    rules = [(F.lit("query-content-match"), F.col("semantic_score") > 0.3)] if profile == "v1" else [
        (F.lit("high-semantic-match"), F.col("semantic_score") > 0.5),
        (F.lit("semantic-match"), (F.col("semantic_score") > 0.3) & (F.col("semantic_score") <= 0.5))]
    for u in vocab.USE_CASES:
        rules.append((F.lit(f"use-case-{u}-match" if profile == "v1" else f"use-case-{u}-direct"),
                      F.array_contains("use_cases", u) & tag_text.contains(u.replace("_", " "))))
    dim = lambda d: F.exists(signals, lambda s: s["dimension"] == d)
    rules.append((F.lit("privacy-aligned"), dim("privacy") & (F.col("privacy_rating") > 0.7)))
    rules.append((F.lit("open-source-aligned"), dim("openness") & F.col("opensource")))
    prefix = {"v1": {1.0: "skill-level-match-", 0.8: "skill-level-compatible-", 0.2: "skill-level-mismatch-"},
              "v2": {1.0: "exact-skill-match-", 0.8: "adjacent-skill-level-"}}[profile]
    for value, text in prefix.items():
        rules.append((F.concat(F.lit(text), "complexity"), skill == value))
    return keep(rules)


def rank_results(requests: DataFrame, candidates: DataFrame, as_of: str, profile: str = "v1", columns: Sequence[str] | None = None) -> DataFrame:
    """R7s: hard filter, score, (second profile) drop near copies, number by score. ``columns``: what is wanted beside
    query_id, id, alignment_score and rank (None: everything)."""
    rows = filters.request_join(requests, candidates)
    if profile == "v1":
        rows = rows.where(filters.satisfies_v1(F.col("constraints"), as_of))
    else:
        rows = rows.where(filters.satisfies_v2(F.col("constraints"), ["platform", "provider", "license", "title", "complexity"]))
    scored = score(rows, as_of, profile)
    if profile == "v2":
        scored = drop_similar(scored, columns=None if columns is None else ["alignment_score", *columns])
    elif columns is not None:
        scored = scored.select("query_id", "id", "alignment_score", *columns)
    return ordered.ranked(scored, ["query_id"], "alignment_score", "id")


def drop_similar(rows: DataFrame, threshold: float = DEDUP_COSINE, columns: Sequence[str] | None = None) -> DataFrame:
    """R8s: within a request, in id order, drop what resembles an earlier kept result. ``columns``: what is wanted beside
    query_id and id (None: everything). The rows are stored, so that they are found and scored once."""
    wanted = [c for c in rows.columns if c not in ("query_id", "id")] if columns is None else columns
    staged = stored(rows.select("query_id", "id", *wanted, hashing.digest(F.concat_ws(" ", "title", "description")).alias("_digest")))
    return dedup.greedy_digests(staged, "query_id", "id", "_digest", threshold).select(*(rows.columns if columns is None else ["query_id", "id", *wanted]))


def origin(ranked: DataFrame, raw: DataFrame) -> DataFrame:
    """Ranked rows with the fields of their raw result; a row without one keeps nulls."""
    return ranked.join(raw, ["query_id", "url"], "left")


def overlap_pairs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Jaccard of the word sets of two tables of texts (columns lt and rt) joined on a key.

    Texts are shuffled and cut into words where they meet: an array of words takes some four times the room.
    """
    sets = once(left.join(right, key), lw=word_set(F.col("lt")), rw=word_set(F.col("rt")))
    return sets.withColumn("jaccard", jaccard(F.col("lw"), F.col("rw")))


def match_reasons(goal: Column, use_cases: Column, privacy: Column, signals: Column) -> Column:
    """M6: at most three reasons, in order."""
    ethical = F.transform(signals, lambda s: F.concat(F.lit("Aligns with "), s["dimension"], F.lit(" values")))
    lead = keep([
        (F.concat(F.lit("Matches "), goal, F.lit(" intent")), goal.isNotNull()),
        (F.concat(F.lit("Suitable for "), F.get(use_cases, 0)), F.size(use_cases) > 0),
        (F.lit("High privacy rating"), privacy > 0.8),
        (F.lit("Good privacy rating"), (privacy > 0.5) & (privacy <= 0.8))])
    return F.slice(F.concat(lead, ethical), 1, 3)


def merged_match_reasons(goal: Column, use_cases: Column, n_sources: Column) -> Column:
    """M6 for merged results."""
    return F.slice(keep([
        (F.concat(F.lit("Matches "), goal, F.lit(" intent")), goal.isNotNull()),
        (F.concat(F.lit("Found in "), n_sources.cast("string"), F.lit(" sources")), n_sources > 1),
        (F.concat(F.lit("Suitable for "), F.get(use_cases, 0)), F.size(use_cases) > 0)]), 1, 3)
