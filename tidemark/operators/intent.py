"""Query intent as columns over a table of texts (Q1-Q12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import vocab
from tidemark.functions.text import (all_matches, any_of, boundary, contains_any, count_matches, first_match, keep, matches, words)
from tidemark.functions.timing import at

CONSTRAINT = "array<struct<type:string,dimension:string,values:array<string>,hard:boolean>>"
INTENT_HOURS = 8  # fixed value
EXTRACTION_CONFIDENCE = 0.8  # fixed value


def constraint(kind: str, dimension: str, values: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.lit(dimension).alias("dimension"), values.alias("values"),
                    F.lit(True).alias("hard"))


def _strings(items: list[str]) -> Column:
    return F.array(*[F.lit(i) for i in items])


def _prices(t: Column, pattern: str, op: str) -> Column:
    amounts = all_matches(t, pattern, 1)
    return F.transform(F.array_distinct(amounts), lambda n: constraint("range", "price", F.array(F.concat(F.lit(op), n))))


def _each_once(t: Column, rules: list[tuple[str, str, str, list[str]]]) -> Column:
    """Constraints of (pattern, kind, dimension, values) whose pattern is found; rules of one constraint are one rule at the place of
    the first, which is far cheaper than to compare the constraints found."""
    found: dict[tuple, Column] = {}
    for p, kind, dim, values in rules:
        made = (kind, dim, *values)
        found[made] = found[made] | matches(t, p) if made in found else matches(t, p)
    return keep([(constraint(kind, dim, _strings(values)), hit) for (kind, dim, *values), hit in found.items()])


def constraints(text: Column, fix_license_polarity: bool = False) -> Column:
    """Q1: hard constraints in rule order, each once.

    "open source" is read as an exclusion of the open-source license, as the rules define it;
    ``fix_license_polarity`` turns that rule into an inclusion.
    """
    t = F.lower(text)
    platforms = [(p, "inclusion", "platform", [v]) for p, v in vocab.PLATFORM_PATTERNS]
    excluded = [(p, "inclusion" if fix_license_polarity and values == ["open-source"] else "exclusion", dim, values)
                for p, dim, values in vocab.EXCLUSION_PATTERNS]
    prices = [_prices(t, p, op) for p, op in vocab.PRICE_PATTERNS]
    features = [(p, "inclusion", "feature", [v]) for p, v in vocab.FEATURE_PATTERNS]
    return F.concat(_each_once(t, platforms), _each_once(t, excluded), *prices, _each_once(t, features))


def negative_preferences(text: Column) -> Column:
    """Q2."""
    t = F.lower(text)
    return keep([(F.lit(v), matches(t, p)) for p, v in vocab.NEGATIVE_PREFERENCE_PATTERNS])


def goal(text: Column) -> Column:
    """Q3: first goal with a hit, null without one."""
    t = F.lower(text)
    return first_match([(g, any_of(matches(t, p) for p in ps)) for g, ps in vocab.QUERY_GOAL_PATTERNS], None)


def skill_level(text: Column) -> Column:
    """Q4."""
    t = F.lower(text)
    beginner = count_matches(t, vocab.QUERY_BEGINNER_PATTERNS)
    advanced = count_matches(t, vocab.QUERY_ADVANCED_PATTERNS)
    return F.when(advanced > beginner, "advanced").when(beginner > 0, "beginner").otherwise("intermediate")


def lead_words(examples: list[str]) -> list[str]:
    """The words that are tested for a group of examples: the first three of each."""
    return sorted({w for e in examples for w in e.split()[:3]})


def use_cases(text: Column) -> Column:
    """Q5."""
    t = F.lower(text)
    return keep([(F.lit(u), contains_any(t, lead_words(ex))) for u, ex in vocab.QUERY_USE_CASE_EXAMPLES])


def ethical_signals(text: Column) -> Column:
    """Q6."""
    t = F.lower(text)
    return keep([(F.struct(F.lit(d).alias("dimension"), F.lit(p).alias("preference")), contains_any(t, lead_words(ex)))
                 for d, p, ex in vocab.QUERY_ETHICAL_EXAMPLES])


def result_type(text: Column) -> Column:
    """Q7."""
    t = F.lower(text)
    return first_match([(r, contains_any(t, ws)) for r, ws in vocab.QUERY_RESULT_TYPE_WORDS], "tool")


def complexity(text: Column) -> Column:
    """Q8."""
    return (F.when(F.size(words(text)) <= 5, "simple")
            .when(contains_any(F.lower(text), vocab.QUERY_COMPLEXITY_WORDS), "advanced").otherwise("moderate"))


def _by_words(text: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    return first_match([(v, contains_any(F.lower(text), ws)) for v, ws in rules], default)


def urgency(text: Column) -> Column:
    """Q9."""
    return _by_words(text, vocab.URGENCY_WORDS, "flexible")


def temporal(text: Column) -> Column:
    """Q10."""
    return F.struct(_by_words(text, vocab.HORIZON_WORDS, "flexible").alias("horizon"),
                    _by_words(text, vocab.RECENCY_WORDS, "evergreen").alias("recency"),
                    _by_words(text, vocab.FREQUENCY_WORDS, "exploratory").alias("frequency"))


def universal_intent(queries: DataFrame, as_of: str, text: str = "text") -> DataFrame:
    """Q11: the nested intent record of each query. The id is a hash of session and text, so that a
    second run gives the same ids."""
    t = F.col(text)
    base = queries.select(
        "*", constraints(t).alias("_constraints"), goal(t).alias("_goal"), negative_preferences(t).alias("_neg"))
    dims = F.concat(F.transform("_constraints", lambda c: c["dimension"]),
                    F.when(F.col("_goal").isNotNull(), F.array(F.lit("goal"))).otherwise(F.array().cast("array<string>")))
    return base.select(
        *queries.columns,
        F.concat_ws("_", "session_id", F.substring(F.sha2(F.concat_ws("\u0001", "session_id", text), 256), 1, 8)).alias("intent_id"),
        F.struct(t.alias("query"), F.col("_goal").alias("goal"), F.col("_constraints").alias("constraints"),
                 F.col("_neg").alias("negative_preferences"), urgency(t).alias("urgency"),
                 skill_level(t).alias("skill_level")).alias("declared"),
        F.struct(use_cases(t).alias("use_cases"), temporal(t).alias("temporal"), result_type(t).alias("result_type"),
                 complexity(t).alias("complexity"), ethical_signals(t).alias("ethical_signals")).alias("inferred"),
        dims.alias("extracted_dimensions"), F.lit(EXTRACTION_CONFIDENCE).alias("confidence"),
        (at(as_of) + F.expr(f"INTERVAL {INTENT_HOURS} HOURS")).alias("expires_at"))


def price_words(text: Column) -> Column:
    """Q12: (operator, amount) of the first price phrase, null without one."""
    t = F.lower(text)
    found = None
    for p, op in vocab.PRICE_WORD_PATTERNS:
        n = F.regexp_extract(t, boundary(p), 1)
        value = F.struct(F.lit(op).alias("op"), F.nullif(n, F.lit("")).cast("bigint").alias("amount"))
        found = F.when(n != "", value) if found is None else found.when(n != "", value)
    return found
