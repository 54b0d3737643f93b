"""Filter queries: P1-P11, P14-P17, S14, J6, SK."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import vocab
from tidemark.functions.text import r6
from tidemark.functions.urls import bare_host
from tidemark.operators import filters, intent
from tidemark.operators import pages as pg
from tidemark.plans.adapters import any_sub, lit, pick, sql_list
from tidemark.plans.intent import CONSTRAINTS_SQL, NEGATIVE_SQL, shown
from tidemark.plans.pages import part
from tidemark.plans.registry import cte, query
from tidemark.session import once
from tidemark.sources import testbed as tb
from tidemark.sources.payloads import parse_intents
from tidemark.sources.testbed import AS_OF, RANK_AS_OF, pick as spark_pick

# constraints of requests as (type, dimension, values) parsed from their text form
cte("request_constraints", f"""
SELECT query_id, text, list_transform(list_distinct(c), lambda x: {{'type': split_part(x, ':', 1),
  'dimension': split_part(split_part(x, ':', 2), '=', 1), 'values': string_split(substr(x, instr(x, '=') + 1), '|')}}) AS constraints
FROM (SELECT query_id, text, {CONSTRAINTS_SQL} AS c FROM (SELECT *, lower(text) AS t FROM requests))""")


def member(column: str) -> str:
    return (f"CASE c.type WHEN 'inclusion' THEN coalesce(list_contains(c.values, {column}), false) "
            f"WHEN 'exclusion' THEN NOT coalesce(list_contains(c.values, {column}), false) ELSE true END")


PRICE_V1 = """price IS NULL OR price = 0 OR NOT coalesce(CASE regexp_extract({s}, '^([<>]=?)(\\d+)', 1)
  WHEN '<=' THEN price > n WHEN '>=' THEN price < n WHEN '<' THEN price >= n WHEN '>' THEN price <= n END, false)"""


def price_v1(s: str) -> str:
    n = f"CAST(nullif(regexp_extract({s}, '^([<>]=?)(\\d+)', 2), '') AS DOUBLE)"
    return "(" + PRICE_V1.replace("{s}", s).replace(" n ", f" {n} ").replace(" n END", f" {n} END") + ")"


V1 = f"""len(list_filter(constraints, lambda c: NOT CASE c.dimension WHEN 'platform' THEN {member('platform')}
  WHEN 'provider' THEN {member('provider')} WHEN 'license' THEN {member('license')}
  WHEN 'price' THEN {price_v1('c.values[1]')} ELSE true END)) = 0"""
V2 = """len(list_filter(constraints, lambda c: NOT CASE
  WHEN c.type = 'inclusion' THEN CASE c.dimension WHEN 'platform' THEN coalesce(list_contains(list_transform(c.values, lambda v: lower(v)), lower(platform)), false) ELSE false END
  WHEN c.type = 'exclusion' THEN CASE c.dimension WHEN 'provider' THEN provider IS NULL OR NOT list_contains(list_transform(c.values, lambda v: lower(v)), lower(provider))
    WHEN 'license' THEN NOT list_contains(list_transform(c.values, lambda v: lower(v)), lower(license)) ELSE true END
  WHEN c.dimension = 'price' THEN CASE WHEN starts_with(c.values[1], '<=') THEN price <= CAST(substr(c.values[1], 3) AS DOUBLE)
    ELSE price >= CAST(substr(c.values[1], 3) AS DOUBLE) END ELSE true END)) = 0"""


def constrained(t):
    r = t.requests().withColumn("constraints", intent.constraints(F.col("text")))
    return filters.request_join(r, t.candidates())


@query("query_candidate_join", "SELECT query_id, id, text FROM requests JOIN candidates USING (query_id)")
def _(t):
    return filters.request_join(t.requests(), t.candidates()).select("query_id", "id", "text")


@query("constraint_filter_v1", f"SELECT query_id, id FROM candidates JOIN request_constraints USING (query_id) WHERE {V1}")
def _(t):
    return constrained(t).where(filters.satisfies_v1(F.col("constraints"), RANK_AS_OF)).select("query_id", "id")


@query("constraint_filter_v2", f"SELECT query_id, id FROM candidates JOIN request_constraints USING (query_id) WHERE {V2}")
def _(t):
    cols = ["platform", "provider", "license", "title", "complexity"]
    return constrained(t).where(filters.satisfies_v2(F.col("constraints"), cols)).select("query_id", "id")


PRICES = ["<=300", ">=500", "<250", ">700", "100-400", "max 350.5", "min 420", "free", "anything"]


@query("price_range", f"""
SELECT query_id, id, spec, {price_v1('spec')} AS v1, CASE WHEN spec = 'free' THEN price = 0
  WHEN spec = '<=300' THEN price <= 300 WHEN spec = '>=500' THEN price >= 500 WHEN spec = '<250' THEN price < 250
  WHEN spec = '>700' THEN price > 700 WHEN spec = '100-400' THEN price BETWEEN 100 AND 400 WHEN spec = 'max 350.5' THEN price <= 350.5
  WHEN spec = 'min 420' THEN price >= 420 ELSE true END AS v2
FROM (SELECT *, {pick(PRICES, 'query_id')} AS spec FROM candidates)""")
def _(t):
    c = t.candidates().withColumn("spec", spark_pick(PRICES, F.col("query_id")))
    return c.select("query_id", "id", "spec", filters.price_v1(F.col("price"), F.col("spec")).alias("v1"),
                    filters.price_v2(F.col("price"), F.col("spec")).alias("v2"))


@query("format_filter", f"""
SELECT query_id, id, fmt, CASE WHEN query_id % 2 = 0 THEN fmt IS NOT NULL AND fmt IN ('pdf', 'text')
  ELSE fmt IS NULL OR fmt NOT IN ('pdf', 'text') END AS passes
FROM (SELECT *, list_filter(tags, lambda x: list_contains({sql_list(vocab.FORMAT_TAGS)}, lower(x)))[1] AS fmt FROM candidates)""")
def _(t):
    kind = F.when(F.col("query_id") % 2 == 0, "inclusion").otherwise("exclusion")
    fmt = filters.format_of(F.col("tags"))
    return t.candidates().select("query_id", "id", fmt.alias("fmt"),
                                 filters.format_ok(kind, F.array(F.lit("PDF"), F.lit("text")), fmt).alias("passes"))


RECENCIES = ["last_900_days", "this_year", "max_days_old=1500", "min_days_old=1500", "this_month", "evergreen"]


@query("recency_filter", f"""
SELECT query_id, id, spec, CASE WHEN recency IS NULL THEN kind <> 'inclusion' WHEN kind = 'exclusion' THEN NOT coalesce(inside, false)
  ELSE coalesce(inside, true) END AS passes FROM (
  SELECT *, CASE spec WHEN 'last_900_days' THEN days <= 900 WHEN 'this_year' THEN substr(recency, 1, 4) = '1999'
    WHEN 'max_days_old=1500' THEN days <= 1500 WHEN 'min_days_old=1500' THEN days >= 1500 WHEN 'this_month' THEN days <= 30 END AS inside FROM (
    SELECT *, {pick(RECENCIES, 'query_id')} AS spec, CASE WHEN query_id % 4 = 3 THEN 'exclusion' ELSE 'inclusion' END AS kind,
      floor(date_diff('microsecond', CAST(recency AS TIMESTAMP), TIMESTAMP '{RANK_AS_OF}') / 86400000000.0::DOUBLE) AS days FROM candidates))""")
def _(t):
    kind = F.when(F.col("query_id") % 4 == 3, "exclusion").otherwise("inclusion")
    spec = spark_pick(RECENCIES, F.col("query_id"))
    return t.candidates().select("query_id", "id", spec.alias("spec"),
                                 filters.recency_ok(kind, spec, F.col("recency"), RANK_AS_OF).alias("passes"))


# ---------------------------------------------------------------- URLs
def url_host(u: str) -> str:
    return f"regexp_replace(lower({part(u, 2)}), '^www\\.', '')"


def url_privacy_sql(h: str) -> str:
    known = " ".join(f"WHEN {h} = '{d}' OR ends_with({h}, '.{d}') THEN {v[0]}" for d, v in vocab.PRIVACY_DOMAINS_V1.items())
    big = " OR ".join(f"{h} = '{d}' OR ends_with({h}, '.{d}')" for d in vocab.BIG_TECH_V1)
    return f"CAST(CASE {known} WHEN {big} THEN 0.3 ELSE 0.5 END AS DOUBLE)"


cte("hosted_urls", f"SELECT query_id, url, h, {url_privacy_sql('h')} AS privacy FROM (SELECT *, {url_host('url')} AS h FROM request_urls)")


@query("url_constraint_filter", """
SELECT query_id, url FROM hosted_urls JOIN request_constraints USING (query_id)
WHERE len(list_filter(constraints, lambda c: c.dimension = 'provider' AND len(list_filter(c.values, lambda v: contains(h, lower(v)))) > 0)) = 0
  AND CASE WHEN query_id % 3 = 0 THEN privacy >= 0.7::DOUBLE WHEN query_id % 3 = 1 THEN privacy >= 0.5 ELSE true END""")
def _(t):
    from tidemark.operators.urls import with_facts

    level = F.when(F.col("query_id") % 3 == 0, "High").when(F.col("query_id") % 3 == 1, "medium").otherwise("any")
    extra = intent.constraint("inclusion", "privacy", F.array(level))
    r = t.requests().withColumn("constraints", F.array_append(intent.constraints(F.col("text")), extra))
    j = with_facts(once(filters.request_join(r, t.request_urls()), domain=bare_host(F.col("url"))))
    return j.where(filters.url_constraints_ok(F.col("constraints"), F.col("domain"), F.col("privacy_score"))).select("query_id", "url")


cte("stated_preferences", f"""
SELECT query_id, list_transform(CASE WHEN query_id % 5 = 0 THEN ['no google', 'no AWS amazon'] WHEN query_id % 5 = 1 THEN ['not facebook', 'no Apple']
  ELSE {NEGATIVE_SQL} END, lambda p: replace(replace(lower(p), 'no ', ''), 'not ', '')) AS prefs
FROM (SELECT *, lower(text) AS t FROM requests)""")
NAMED = " OR ".join(
    f"(contains(h, '{d}') AND len(list_filter(prefs, lambda p: contains(p, '{d.replace('.com', '').replace('.', ' ')}'))) > 0)" for d in vocab.BIG_TECH_V1)


@query("negative_preference_filter", f"SELECT query_id, url FROM hosted_urls JOIN stated_preferences USING (query_id) WHERE NOT ({NAMED})")
def _(t):
    strings = lambda *v: F.array(*[F.lit(x) for x in v])
    prefs = (F.when(F.col("query_id") % 5 == 0, strings("no google", "no AWS amazon"))
             .when(F.col("query_id") % 5 == 1, strings("not facebook", "no Apple")).otherwise(intent.negative_preferences(F.col("text"))))
    j = once(filters.request_join(t.requests().withColumn("prefs", prefs), t.request_urls()), domain=bare_host(F.col("url")))
    return j.where(filters.negative_preferences_ok(F.col("prefs"), F.col("domain"))).select("query_id", "url")


@query("privacy_result_filter", f"""
SELECT query_id, url, round(privacy, 6) AS privacy_score, row_number() OVER (PARTITION BY query_id ORDER BY privacy DESC, url) AS rank
FROM hosted_urls WHERE privacy >= 0.4::DOUBLE AND NOT {any_sub('h', vocab.RESULT_FILTER_BIG_TECH)}""")
def _(t):
    from tidemark.operators.urls import with_facts

    hosted = once(t.request_urls(), domain=bare_host(F.col("url")))
    u = with_facts(hosted).select("query_id", "url", "privacy_score")
    return filters.privacy_results(u, 0.4, True, "privacy_score").withColumn("privacy_score", r6(F.col("privacy_score")))


# ---------------------------------------------------------------- ads
cte("targeted_ads", f"""
SELECT *, CASE WHEN ad_id % 13 = 0 THEN ['age', 'Location'] WHEN ad_id % 17 = 0 THEN ['precise_location'] ELSE [] END AS forbidden,
  {pick(tb.PLATFORMS, 'ad_id')} AS t_platform, CASE WHEN ad_id % 4 <> 0 THEN {pick(tb.PROVIDERS, 'ad_id')} END AS t_provider,
  CASE WHEN ad_id % 19 = 0 THEN 'Age' WHEN ad_id % 23 = 0 THEN 'precise_location' ELSE 'license' END AS t_other,
  CASE ad_id % 3 WHEN 0 THEN ['privacy-first'] WHEN 1 THEN ['open-source', 'openness'] ELSE ['Sustainability', 'ethics'] END AS ethical_tags FROM ads""")


def targeted_ads(t):
    key = F.col("ad_id")
    a = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    other = F.when(key % 19 == 0, "Age").when(key % 23 == 0, "precise_location").otherwise("license")
    targeting = F.map_filter(F.map_from_arrays(
        F.array(F.lit("platform"), F.lit("provider"), other),
        F.array(F.array(spark_pick(tb.PLATFORMS, key)), F.when(key % 4 != 0, F.array(spark_pick(tb.PROVIDERS, key))), a("MIT"))),
        lambda k, v: v.isNotNull())
    return t.ads().select(
        "*", F.when(key % 13 == 0, a("age", "Location")).when(key % 17 == 0, a("precise_location")).otherwise(a()).alias("forbidden_dimensions"),
        targeting.alias("targeting"),
        F.when(key % 3 == 0, a("privacy-first")).when(key % 3 == 1, a("open-source", "openness"))
        .otherwise(a("Sustainability", "ethics")).alias("ethical_tags"))


FAIR = f"len(list_filter(forbidden, lambda d: list_contains({sql_list(vocab.AD_FORBIDDEN_DIMENSIONS)}, lower(d)))) = 0"
AD_TARGETS = """CASE c.dimension WHEN 'platform' THEN list_contains(c.values, t_platform)
  WHEN 'provider' THEN coalesce(list_contains(c.values, t_provider), false)
  WHEN 'license' THEN t_other = 'license' AND list_contains(c.values, 'MIT') ELSE false END"""
AD_OK = f"""len(list_filter(constraints, lambda c: NOT CASE c.type WHEN 'inclusion' THEN {AD_TARGETS}
  WHEN 'exclusion' THEN NOT {AD_TARGETS} ELSE true END)) = 0"""


@query("ad_fairness_filter", f"SELECT ad_id FROM targeted_ads WHERE {FAIR}")
def _(t):
    return targeted_ads(t).where(filters.ad_fair(F.col("forbidden_dimensions"))).select("ad_id")


@query("ad_constraint_filter", f"""
SELECT query_id, ad_id FROM request_ads JOIN targeted_ads USING (ad_id) JOIN request_constraints USING (query_id) WHERE {AD_OK}""")
def _(t):
    r = t.requests().withColumn("constraints", intent.constraints(F.col("text")))
    j = filters.request_join(r, t.request_ads().join(targeted_ads(t), "ad_id"))
    return j.where(filters.ad_constraints_ok(F.col("constraints"), F.col("targeting"))).select("query_id", "ad_id")


@query("ad_eligibility", """
SELECT a.ad_id, g.campaign_id FROM ads a JOIN ad_groups g USING (ad_group_id) JOIN campaigns c USING (campaign_id)
LEFT JOIN budget_spend s ON s.campaign_id = c.campaign_id
WHERE c.status = 'active' AND a.status = 'active' AND a.approval_status = 'approved' AND c.campaign_id IN (0, 1, 2, 3)
  AND coalesce(s.spend, 0) < c.budget""")
def _(t):
    e = filters.eligible_ads(t.ads(), t.ad_groups(), t.campaigns(), t.ad_metrics(), [0, 1, 2, 3])
    return e.select("ad_id", "campaign_id")


# ---------------------------------------------------------------- privacy projections and intents
@query("minimise_columns", "SELECT click_id, ip_hash, user_agent_hash FROM clicks")
def _(t):
    return filters.minimise(t.clicks(), "click_tracking", ["click_id"])


@query("sanitise_click_events", """
SELECT click_id, ad_id, substr(sha256(session_id), 1, 16) AS session_id, ip_hash FROM clicks""")
def _(t):
    c = t.clicks()
    raw = c.select(c.click_id, c.ad_id, c.session_id, c.ip_hash, c.user_agent, F.lit("x").alias("Email"))
    return filters.sanitise_columns(raw)


@query("sanitise_click_payload", """
SELECT click_id, substr(sha256(session_id), 1, 16) AS session, CAST(2 AS BIGINT) AS keys_left FROM clicks""")
def _(t):
    payload = F.create_map(F.lit("session_id"), F.col("session_id"), F.lit("User_Agent"), F.coalesce("user_agent", F.lit("")),
                           F.lit("ad"), F.col("ad_id").cast("string"), F.lit("email"), F.lit("a@b.c"))
    clean = t.clicks().select("click_id", filters.sanitise_payload(payload).alias("p"))
    return clean.select("click_id", F.col("p")["session_id"].alias("session"), F.size("p").cast("bigint").alias("keys_left"))


GOAL_FORMS = ["learn", "LEARN", "Find-Information", "bogus", "local_service"]
URGENCY_FORMS = ["soon", "SOON", "immediate"]
EXPIRY_FORMS = ["2024-01-31T05:00:00Z", "2024-01-30T23:59:59Z", "garbage", "", "2024-01-31T02:00:00+03:00", "2024-01-31T00:00:00"]
USE_FORMS = ["learning", "Market-Research", "nothing"]
JSON_PARTS = [
    '{"intentId":"i', "#id", '","context":{"sessionId":"', "#session", '","userId":"u1","product":"search"},"declared":{"query":"', "#phrase",
    '","goal":"', "#goal", '","constraints":[{"type":"inclusion","dimension":"platform","value":"Android"},'
    '{"type":"odd","dimension":"provider","value":["Google","Meta"],"hardFilter":false}],"urgency":"', "#urgency",
    '"},"inferred":{"useCases":["', "#use", '"],"temporalIntent":{"horizon":"week","recency":"bad"},"complexity":"advanced",'
    '"ethicalSignals":[{"dimension":"privacy","preference":"privacy-first"}]},"sessionFeedback":{"dwell":1.5},"expiresAt":"', "#expiry", '"}',
]


def intents_json(t):
    q = F.col("query_id")
    slots = {"#id": q.cast("string"), "#session": F.col("session_id"), "#phrase": spark_pick(tb.PHRASES, q),
             "#goal": spark_pick(GOAL_FORMS, q), "#urgency": spark_pick(URGENCY_FORMS, q), "#use": spark_pick(USE_FORMS, q),
             "#expiry": spark_pick(EXPIRY_FORMS, q)}
    return t.queries().select("query_id", F.concat(*[slots.get(p, F.lit(p)) for p in JSON_PARTS]).alias("payload"))


_SLOTS = {"#id": "query_id", "#session": "session_id", "#phrase": pick(tb.PHRASES, "query_id"), "#goal": pick(GOAL_FORMS, "query_id"),
          "#urgency": pick(URGENCY_FORMS, "query_id"), "#use": pick(USE_FORMS, "query_id"), "#expiry": pick(EXPIRY_FORMS, "query_id")}
cte("intents_json", "SELECT query_id, CAST(" + " || ".join(_SLOTS.get(p, lit(p)) for p in JSON_PARTS) + " AS VARCHAR) AS payload FROM queries")


@query("parse_intents", """
SELECT query_id, payload->>'$.intentId' AS intent_id, payload->>'$.declared.query' AS query,
  CASE lower(replace(replace(payload->>'$.declared.goal', '_', ''), '-', '')) WHEN 'learn' THEN 'learn' WHEN 'findinformation' THEN 'find_information'
    WHEN 'localservice' THEN 'local_service' END AS goal,
  CASE WHEN payload->>'$.declared.urgency' IN ('soon', 'immediate') THEN payload->>'$.declared.urgency' ELSE 'flexible' END AS urgency,
  'intermediate' AS skill_level, 'inclusion:platform=Android:true; ?:provider=Google|Meta:false' AS constraints,
  CASE lower(replace(payload->>'$.inferred.useCases[0]', '-', '')) WHEN 'learning' THEN 'learning' WHEN 'marketresearch' THEN 'market_research' ELSE '' END AS use_cases,
  'week/evergreen/flexible' AS temporal, payload->>'$.inferred.complexity' AS complexity FROM intents_json""")
def _(t):
    p = parse_intents(intents_json(t))
    shown_c = F.array_join(F.transform("declared.constraints", lambda c: F.concat_ws(
        ":", F.coalesce(c["type"], F.lit("?")), F.concat(c["dimension"], F.lit("="), F.array_join(c["values"], "|")), c["hard"].cast("string"))), "; ")
    return p.select("query_id", "intent_id", "declared.query", "declared.goal", "declared.urgency", "declared.skill_level",
                    shown_c.alias("constraints"), F.array_join("inferred.use_cases", "; ").alias("use_cases"),
                    F.concat_ws("/", "inferred.temporal.horizon", "inferred.temporal.recency", "inferred.temporal.frequency").alias("temporal"),
                    "inferred.complexity")


@query("anonymise_intents", """
SELECT query_id, 'product' AS context_keys, '2024-01-31T08:00:00Z' AS expires_at, true AS feedback_gone FROM intents_json""")
def _(t):
    a = filters.anonymise_intents(parse_intents(intents_json(t)), AS_OF)
    return a.select("query_id", F.array_join(F.array_sort(F.map_keys("context")), ",").alias("context_keys"), "expires_at",
                    F.col("session_feedback").isNull().alias("feedback_gone"))


@query("expired_intents", f"""
SELECT query_id, CASE payload->>'$.expiresAt' WHEN '' THEN true WHEN 'garbage' THEN true WHEN '2024-01-31T05:00:00Z' THEN false ELSE true END AS expired
FROM intents_json""")
def _(t):
    p = parse_intents(intents_json(t))
    return p.select("query_id", filters.expired(F.col("expires_at"), AS_OF).alias("expired"))


# ---------------------------------------------------------------- ranks
@query("rank_assign", """
SELECT query_id, id, price, row_number() OVER (PARTITION BY query_id ORDER BY price DESC, id) AS rank FROM (SELECT query_id % 3 AS query_id, id, price FROM candidates)""")
def _(t):
    from tidemark.operators import ordered

    c = t.candidates().select((F.col("query_id") % 3).alias("query_id"), "id", "price")
    return ordered.ranked(c, ["query_id"], "price", "id")


@query("topk_per_group", """
SELECT platform, id, price, rank FROM (SELECT platform, id, price, CAST(row_number() OVER (PARTITION BY platform ORDER BY price DESC, id) AS INT) AS rank FROM candidates) WHERE rank <= 5""")
def _(t):
    from tidemark.operators import ordered

    return ordered.top_k(t.candidates().select("platform", "id", "price"), ["platform"], [F.col("price").desc(), F.col("id")], 5)
