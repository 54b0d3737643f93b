"""Trending topics and seed discovery."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import vocab
from tidemark.functions.text import any_of, boundary, clamp, contains_any, count_contains, first_match, jaccard, matches, word_set
from tidemark.functions.timing import HOUR, at, micros
from tidemark.functions.urls import part
from tidemark.operators import graph, ordered

WINDOW_HOURS, TOP_KEYWORDS, KEEP_KEYWORDS = 24, 50, 1000  # fixed values
MIN_FREQUENCY, MIN_CONFIDENCE, DUPLICATE_JACCARD, MAX_PER_CATEGORY = 2, 0.6, 0.85, 50  # fixed values
MIN_SEED_SCORE = 0.5  # fixed value


def query_keywords(text: Column) -> Column:
    """Distinct words of two or more ASCII letters or digits that stand alone, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?<![\p{L}\p{N}_])[a-z0-9]{2,}(?![\p{L}\p{N}_])"), 0)
    return F.array_except(found, F.array(*[F.lit(w) for w in vocab.TOPIC_STOP_WORDS]))


def categorise_query(text: Column) -> Column:
    """Category with the highest score; ties go to the first declared; none gives the default."""
    low = F.lower(text)
    ranked = []
    for i, (name, keywords, patterns, _, _) in enumerate(vocab.TOPIC_CATEGORIES):
        score = count_contains(low, keywords) * 3
        for p in patterns:
            score = score + matches(low, p).cast("int") * 5
        ranked.append(F.struct(score.alias("s"), F.lit(-i).alias("o"), F.lit(name).alias("v")))
    best = F.greatest(*ranked)
    return F.when(best["s"] > 0, best["v"]).otherwise(vocab.TOPIC_DEFAULT_CATEGORY)


def categorise_keyword(keyword: Column) -> Column:
    """T2 for one keyword: first category that names it or matches it."""
    rules = [(name, keyword.isin(ks) | any_of(matches(F.lower(keyword), p) for p in ps)) for name, ks, ps, _, _ in vocab.TOPIC_CATEGORIES]
    return first_match(rules, vocab.TOPIC_DEFAULT_CATEGORY)


def trending_keywords(history: DataFrame, as_of: str, hours: int = WINDOW_HOURS, k: int = TOP_KEYWORDS) -> DataFrame:
    """Time-decayed keyword weights of the last hours; frequency is the whole part of the weight."""
    age = (micros(at(as_of)) - micros(F.col("ts"))) / F.lit(float(HOUR))
    recent = history.where(F.col("ts") >= at(as_of) - F.expr(f"INTERVAL {hours} HOURS")).select(
        query_keywords(F.col("text")).alias("keywords"), F.greatest(F.lit(0.1), F.lit(1.0) - age / hours).alias("weight"))
    total = recent.where(F.size("keywords") > 0).agg(F.count(F.lit(1)).alias("n")).scalar()
    weights = recent.select(F.explode("keywords").alias("keyword"), "weight").groupBy("keyword").agg(F.sum("weight").alias("score"))
    top = weights.withColumn("score", F.round("score", 9)).orderBy(F.col("score").desc(), "keyword").limit(k)
    return top.select("keyword", F.floor("score").alias("frequency"), (F.col("score") / total).alias("recency_score"), "score")


def topic_candidates(keywords: DataFrame) -> DataFrame:
    """T4: each keyword with four suffixes and two related topics of its category."""
    related = F.create_map(*[x for name, _, _, _, rel in vocab.TOPIC_CATEGORIES
                             for x in (F.lit(name), F.array(*[F.lit(r) for r in rel[:2]]))])
    cat = keywords.withColumn("category", categorise_keyword(F.col("keyword")))
    endings = F.concat(F.array(*[F.lit(s) for s in vocab.TOPIC_SUFFIXES]), related[F.col("category")])
    return cat.select("*", F.explode(F.transform(endings, lambda e: F.concat_ws(" ", "keyword", e))).alias("topic"))


def _by_category(build) -> Column:
    chain = None
    for c in vocab.TOPIC_CATEGORIES:
        cond = F.col("category") == c[0]
        chain = F.when(cond, build(c)) if chain is None else chain.when(cond, build(c))
    return chain


def topic_confidence(candidates: DataFrame) -> DataFrame:
    """T5."""
    topic = F.lower("topic")
    hits = _by_category(lambda c: count_contains(topic, c[1]))
    valid = _by_category(lambda c: contains_any(topic, c[3]))
    strength = F.when(hits > 0, F.least(F.lit(1.0), F.lit(0.5) + hits * 0.25)).when(valid, 0.7).otherwise(0.3)
    quality = (F.lit(1.0) - F.when(F.length("topic") < 5, 0.3).otherwise(0.0) - F.when(F.length("topic") > 100, 0.2).otherwise(0.0)
               - F.when(F.col("topic").rlike(r"""[!@#$%^&*()+=\[\]{};:'",.<>?\\|]"""), 0.3).otherwise(0.0)
               - F.when(F.col("topic").rlike(r"(.)\1{3,}"), 0.4).otherwise(0.0))
    frequency = F.least(F.lit(1.0), F.log(F.col("frequency") + 1.0) / F.lit(math.log(10)))
    return candidates.select("*", valid.alias("valid"), (frequency * 0.4 + F.col("recency_score") * 0.3 + strength * 0.2
                                                         + F.greatest(F.lit(0.0), quality) * 0.1).alias("confidence"))


def expand_topics(history: DataFrame, existing: DataFrame, as_of: str, min_confidence: float = MIN_CONFIDENCE,
                  keywords: int = TOP_KEYWORDS, per_category: int = MAX_PER_CATEGORY) -> DataFrame:
    """At most ``per_category`` new topics of each category, from the ``keywords`` strongest keywords. ``existing`` has category and topic; a candidate that shares most
    of its words with one of them is left out. Existing topics of a category are few (the cap below), so
    they join as one array per category."""
    trending = trending_keywords(history, as_of, k=keywords).where(F.col("frequency") >= MIN_FREQUENCY)
    scored = topic_confidence(topic_candidates(trending)).where((F.col("confidence") >= min_confidence) & F.col("valid"))
    known = existing.groupBy("category").agg(F.collect_list(word_set(F.col("topic"))).alias("known"))
    words = word_set(F.col("topic"))
    fresh = scored.join(known, "category", "left").where(
        ~F.coalesce(F.exists("known", lambda w: jaccard(words, w) >= DUPLICATE_JACCARD), F.lit(False)))
    named = fresh.where((F.length(F.trim("topic")) >= 3) & ~F.lower("topic").isin(vocab.TOPIC_STOP_WORDS))
    return ordered.top_k(named.drop("known"), ["category"], [F.col("score").desc(), F.col("topic")], per_category)


def keyword_counts(history: DataFrame, keep: int = KEEP_KEYWORDS) -> DataFrame:
    """Most frequent keywords."""
    return (history.select(F.explode(query_keywords(F.col("text"))).alias("keyword")).groupBy("keyword")
            .agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "keyword").limit(keep))


def category_counts(history: DataFrame) -> DataFrame:
    """Queries per category (queries without keywords do not count)."""
    return (history.where(F.size(query_keywords(F.col("text"))) > 0).groupBy(categorise_query(F.col("text")).alias("category"))
            .agg(F.count(F.lit(1)).alias("count")))


# ---------------------------------------------------------------- seeds
def seed_score(position: Column, n_engines: Column, content: Column, thumbnail: Column, url: Column) -> Column:
    """T7; position counts from 0."""
    return (F.greatest(F.lit(0.0), F.lit(1.0) - position / 20) * 0.4 + F.least(F.lit(1.0), n_engines / 5) * 0.3
            + F.when(F.length(content) > 0, 0.15).otherwise(0.0) + F.when(F.length(thumbnail) > 0, 0.1).otherwise(0.0)
            + F.when(contains_any(part(url, 2), vocab.AUTHORITATIVE_PATTERNS), 0.15).otherwise(0.0))


def first_seen_per_domain(scored: DataFrame) -> DataFrame:
    """WN10: best URL of each domain over all topics."""
    return ordered.first_per_key(scored, ["domain"], [-F.col("score"), F.col("topic"), F.col("position"), F.col("url")])


def discover_seeds(candidates: DataFrame, per_topic: int, min_score: float = MIN_SEED_SCORE,
                   look_ahead: int | None = None) -> DataFrame:
    """Good candidates, one per domain, at most ``per_topic`` per topic in result order. ``look_ahead``
    keeps that many results of a topic (none: all)."""
    scored = candidates.select("topic", "url", "title", "engine", "position", part(F.col("url"), 2).alias("domain"), seed_score(
        F.col("position"), F.col("n_engines"), F.col("content"), F.col("thumbnail"), F.col("url")).alias("score"))
    good = scored.where(F.col("score") >= min_score)
    if look_ahead is not None:
        good = good.where(F.col("position") < look_ahead)
    limited = ordered.top_k(first_seen_per_domain(good), ["topic"], [F.col("position"), F.col("url")], per_topic, "_n").drop("_n")
    return ordered.first_per_key(limited, ["url"], [-F.col("score"), F.col("topic")])


def inject_seeds(queue: DataFrame, seeds: DataFrame, visited: DataFrame, priority: int, scheduled_at: str) -> DataFrame:
    """T9."""
    return graph.frontier_add(queue, seeds, visited, priority, 0, scheduled_at)
