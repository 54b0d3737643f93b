"""Query intent queries: Q1-Q12, S14, P15-P17, P19."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import vocab
from tidemark.operators import intent
from tidemark.plans.adapters import any_sub, first_rule, hit, lit, sql_list
from tidemark.plans.registry import cte, query
from tidemark.sources.testbed import AS_OF

cte("lq", "SELECT query_id, session_id, text, lower(text) AS t FROM queries")


def when_list(pairs) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {v} END" for v, c in pairs) + "], lambda x: x IS NOT NULL)"


def joined(expr: str) -> str:
    return f"array_to_string(list_sort(list_distinct({expr})), '; ')"


def shown(c, typed=True):
    """Constraints as sorted text."""
    return F.array_join(F.array_sort(F.transform(c, lambda x: F.concat(
        x["type"], F.lit(":"), x["dimension"], F.lit("="), F.array_join(x["values"], "|")))), "; ")


CONSTRAINTS_SQL = "list_concat(" + when_list(
    [(lit(f"inclusion:platform={v}"), hit("t", p)) for p, v in vocab.PLATFORM_PATTERNS]
    + [(lit(f"exclusion:{d}={'|'.join(v)}"), hit("t", p)) for p, d, v in vocab.EXCLUSION_PATTERNS]
    + [(lit(f"inclusion:feature={v}"), hit("t", p)) for p, v in vocab.FEATURE_PATTERNS]) + ", " + ", ".join(
    f"list_transform(regexp_extract_all(t, {lit(p)}, 1), lambda n: 'range:price={op}' || n)"
    for p, op in vocab.PRICE_PATTERNS) + ")"
GOAL_SQL = first_rule([(g, "(" + " OR ".join(hit("t", p) for p in ps) + ")") for g, ps in vocab.QUERY_GOAL_PATTERNS], "NULL")
NEGATIVE_SQL = when_list([(lit(v), hit("t", p)) for p, v in vocab.NEGATIVE_PREFERENCE_PATTERNS])


def counted(patterns) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all(t, {lit(p)}))" for p in patterns) + ")"


SKILL_SQL = f"""CASE WHEN {counted(vocab.QUERY_ADVANCED_PATTERNS)} > {counted(vocab.QUERY_BEGINNER_PATTERNS)} THEN 'advanced'
  WHEN {counted(vocab.QUERY_BEGINNER_PATTERNS)} > 0 THEN 'beginner' ELSE 'intermediate' END"""
USE_CASES_SQL = when_list([(lit(u), any_sub("t", intent.lead_words(ex))) for u, ex in vocab.QUERY_USE_CASE_EXAMPLES])
ETHICS_SQL = when_list([(lit(f"{d}/{p}"), any_sub("t", intent.lead_words(ex))) for d, p, ex in vocab.QUERY_ETHICAL_EXAMPLES])


def by_words(rules, default) -> str:
    return first_rule([(v, any_sub("t", ws)) for v, ws in rules], lit(default))


RESULT_SQL = by_words(vocab.QUERY_RESULT_TYPE_WORDS, "tool")
COMPLEXITY_SQL = f"""CASE WHEN len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) <= 5 THEN 'simple'
  WHEN {any_sub('t', vocab.QUERY_COMPLEXITY_WORDS)} THEN 'advanced' ELSE 'moderate' END"""
URGENCY_SQL = by_words(vocab.URGENCY_WORDS, "flexible")
HORIZON_SQL = by_words(vocab.HORIZON_WORDS, "flexible")
RECENCY_SQL = by_words(vocab.RECENCY_WORDS, "evergreen")
FREQUENCY_SQL = by_words(vocab.FREQUENCY_WORDS, "exploratory")


def ethics(c):
    return F.array_join(F.array_sort(F.transform(c, lambda s: F.concat_ws("/", s["dimension"], s["preference"]))), "; ")


def listed(c):
    return F.array_join(F.array_sort(c), "; ")


SIMPLE = {
    "extract_constraints": (lambda t: shown(intent.constraints(t)), joined(CONSTRAINTS_SQL)),
    "negative_preferences": (lambda t: listed(intent.negative_preferences(t)), joined(NEGATIVE_SQL)),
    "goal": (intent.goal, GOAL_SQL),
    "skill_level": (intent.skill_level, SKILL_SQL),
    "use_cases": (lambda t: listed(intent.use_cases(t)), joined(USE_CASES_SQL)),
    "ethical_signals": (lambda t: ethics(intent.ethical_signals(t)), joined(ETHICS_SQL)),
    "result_type": (intent.result_type, RESULT_SQL),
    "complexity": (intent.complexity, COMPLEXITY_SQL),
    "urgency": (intent.urgency, URGENCY_SQL),
}
for _name, (_column, _sql) in SIMPLE.items():
    query(_name, f"SELECT query_id, {_sql} AS {_name} FROM lq")(
        lambda t, name=_name, column=_column: t.queries().select("query_id", column(F.col("text")).alias(name)))


@query("temporal_intent", f"""
SELECT query_id, {HORIZON_SQL} AS horizon, {RECENCY_SQL} AS recency, {FREQUENCY_SQL} AS frequency FROM lq""")
def _(t):
    return t.queries().select("query_id", intent.temporal(F.col("text")).alias("x")).select("query_id", "x.*")


@query("universal_intent", f"""
SELECT query_id, session_id || '_' || substr(sha256(session_id || chr(1) || text), 1, 8) AS intent_id, {GOAL_SQL} AS goal,
  {joined(CONSTRAINTS_SQL)} AS constraints, {URGENCY_SQL} AS urgency, {SKILL_SQL} AS skill_level,
  {joined(USE_CASES_SQL)} AS use_cases, {HORIZON_SQL} AS horizon, {RESULT_SQL} AS result_type,
  {COMPLEXITY_SQL} AS complexity, {joined(ETHICS_SQL)} AS ethical_signals,
  CAST(len(list_distinct({CONSTRAINTS_SQL})) + CASE WHEN {GOAL_SQL} IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_dimensions,
  0.8::DOUBLE AS confidence, TIMESTAMP '{AS_OF}' + INTERVAL 8 HOUR AS expires_at
FROM lq""")
def _(t):
    u = intent.universal_intent(t.queries(), AS_OF)
    return u.select("query_id", "intent_id", "declared.goal", shown(F.col("declared.constraints")).alias("constraints"),
                    "declared.urgency", "declared.skill_level", listed(F.col("inferred.use_cases")).alias("use_cases"),
                    "inferred.temporal.horizon", "inferred.result_type", "inferred.complexity",
                    ethics(F.col("inferred.ethical_signals")).alias("ethical_signals"),
                    F.size("extracted_dimensions").cast("bigint").alias("n_dimensions"), "confidence", "expires_at")


def _price_sql() -> str:
    picks = [f"WHEN regexp_extract(t, {lit(p)}, 1) <> '' THEN {{}}" for p, _ in vocab.PRICE_WORD_PATTERNS]
    ops = " ".join(w.format(lit(op)) for w, (_, op) in zip(picks, vocab.PRICE_WORD_PATTERNS))
    nums = " ".join(w.format(f"CAST(regexp_extract(t, {lit(p)}, 1) AS BIGINT)") for w, (p, _) in zip(picks, vocab.PRICE_WORD_PATTERNS))
    return f"CASE {ops} END AS op, CASE {nums} END AS amount"


@query("price_words", f"SELECT query_id, {_price_sql()} FROM lq")
def _(t):
    return t.queries().select("query_id", intent.price_words(F.col("text")).alias("x")).select("query_id", "x.*")
