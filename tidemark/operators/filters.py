"""Constraint, privacy and fairness filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import vocab
from tidemark.functions.text import any_of, contains_any
from tidemark.functions.timing import at, days_between, parse_instant
from tidemark.functions.urls import host
from tidemark.operators import ordered, reporting
from tidemark.session import once

INTENT_HOURS = 8  # fixed value


def request_join(requests: DataFrame, offered: DataFrame, key: str = "query_id") -> DataFrame:
    """Each request with the candidates that came with it: an equi join on the request, one row per
    offered candidate. Nothing is paired beyond what was offered.

    Both sides grow with the traffic, so the join is a sort-merge join: it spills, adaptive execution
    splits a request that holds very many candidates, and the scoring that follows runs on the shuffled
    partitions instead of on however the input files happened to be cut.
    """
    return offered.join(requests.hint("merge"), key)


# ---------------------------------------------------------------- single constraints
def price_v1(price: Column, spec: Column) -> Column:
    """P3, first grammar: a comparison with a whole number; a missing or zero price passes."""
    op, limit = F.regexp_extract(spec, r"^([<>]=?)(\d+)", 1), F.nullif(
        F.regexp_extract(spec, r"^([<>]=?)(\d+)", 2), F.lit("")).cast("double")
    broken = (F.when(op == "<=", price > limit).when(op == ">=", price < limit).when(op == "<", price >= limit)
              .when(op == ">", price <= limit))
    return (price == 0) | ~F.coalesce(broken, F.lit(False)) | price.isNull()


def price_v2(price: Column, spec: Column) -> Column:
    """P3, second grammar: comparison, a-b, max n, min n, free; anything else passes."""
    s = F.trim(F.lower(spec))
    num = lambda p, g: F.nullif(F.regexp_extract(s, p, g), F.lit("")).cast("double")
    op, limit = F.regexp_extract(s, r"^([<>]=?)(\d+)", 1), num(r"^([<>]=?)(\d+)", 2)
    span = r"^(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)"
    most, least = num(r"^max\s*(\d+(?:\.\d+)?)", 1), num(r"^min\s*(\d+(?:\.\d+)?)", 1)
    return (F.when(s.isin("budget", "free", "0"), price == 0)
            .when(op == "<=", price <= limit).when(op == ">=", price >= limit).when(op == "<", price < limit)
            .when(op == ">", price > limit).when(num(span, 1).isNotNull(), price.between(num(span, 1), num(span, 2)))
            .when(most.isNotNull(), price <= most).when(least.isNotNull(), price >= least).otherwise(True))


def format_of(tags: Column, declared: Column | None = None) -> Column:
    """The declared format, else the first tag that names one."""
    from_tags = F.lower(F.try_element_at(F.filter(tags, lambda t: F.lower(t).isin(vocab.FORMAT_TAGS)), F.lit(1)))
    return from_tags if declared is None else F.coalesce(F.lower(declared), from_tags)


def format_ok(kind: Column, values: Column, fmt: Column) -> Column:
    """An unknown format fails an inclusion and passes everything else."""
    member = F.exists(values, lambda v: F.lower(v) == fmt)
    return F.when(fmt.isNull(), kind != "inclusion").when(kind == "inclusion", member).when(
        kind == "exclusion", ~member).otherwise(True)


def recency_ok(kind: Column, value: Column, recency: Column, as_of: str) -> Column:
    """P5: age classes of a date. An exclusion is the mirror of the class; a missing or unreadable date
    fails an inclusion and passes an exclusion."""
    when = parse_instant(recency)
    days = days_between(at(as_of), when)
    v = F.lower(value)
    n = F.nullif(F.regexp_extract(v, r"^last_(\d+)_days$", 1), F.lit("")).cast("int")
    most = F.nullif(F.regexp_extract(v, r"^max_days_old=(\d+)$", 1), F.lit("")).cast("int")
    least = F.nullif(F.regexp_extract(v, r"^min_days_old=(\d+)$", 1), F.lit("")).cast("int")
    inside = (F.when(n.isNotNull(), days <= n).when(v == "today", days <= 1).when(v == "this_week", days <= 7)
              .when(v == "this_month", days <= 30).when(v == "this_year", F.year(when) == F.year(at(as_of)))
              .when(most.isNotNull(), days <= most).when(least.isNotNull(), days >= least))
    return (F.when(when.isNull(), kind != "inclusion").when(kind == "exclusion", ~F.coalesce(inside, F.lit(False)))
            .otherwise(F.coalesce(inside, F.lit(True))))


def _member(kind: Column, values: Column, value: Column) -> Column:
    inside = F.coalesce(F.array_contains(values, value), F.lit(False))
    return F.when(kind == "inclusion", inside).when(kind == "exclusion", ~inside).otherwise(True)


def satisfies_v1(constraints: Column, as_of: str, declared_format: Column | None = None) -> Column:
    """All hard constraints, case-sensitive; unknown dimensions pass. Reads the candidate columns
    platform, provider, license, price, tags and recency."""
    tags, fmt = F.col("tags"), format_of(F.col("tags"), declared_format)

    def ok(c: Column) -> Column:
        kind, dim, values = c["type"], c["dimension"], c["values"]
        overlap = F.coalesce(F.arrays_overlap(values, tags), F.lit(False))
        return (F.when(~c["hard"], True)
                .when(dim == "platform", _member(kind, values, F.col("platform")))
                .when(dim == "provider", _member(kind, values, F.col("provider")))
                .when(dim == "license", _member(kind, values, F.col("license")))
                .when((dim == "price") & (kind == "range"), price_v1(F.col("price"), values[0]))
                .when(dim == "tags", F.when(kind == "inclusion", overlap).when(kind == "exclusion", ~overlap).otherwise(True))
                .when(dim == "format", format_ok(kind, values, fmt))
                .when(dim == "recency", recency_ok(kind, values[0], F.col("recency"), as_of))
                .otherwise(True))

    return F.forall(constraints, ok)


def satisfies_v2(constraints: Column, columns: list[str]) -> Column:
    """All hard constraints on any text column, ignoring case. A missing value (or column) fails an
    inclusion and passes an exclusion."""

    def ok(c: Column) -> Column:
        kind, dim, values = c["type"], c["dimension"], c["values"]
        value: Column | None = None
        for name in columns:
            value = F.when(dim == name, F.lower(F.col(name))) if value is None else value.when(dim == name, F.lower(F.col(name)))
        inside = F.coalesce(F.exists(values, lambda v: F.lower(v) == value), F.lit(False))
        price = F.col("price")
        return (F.when(~c["hard"], True).when(kind == "inclusion", value.isNotNull() & inside)
                .when(kind == "exclusion", value.isNull() | ~inside)
                .when((kind == "range") & (dim == "price") & price.isNotNull(), price_v2(price, values[0])).otherwise(True))

    return F.forall(constraints, ok)


def url_constraints_ok(constraints: Column, domain: Column, privacy: Column) -> Column:
    """Provider or domain as part of the host name; privacy high / medium as a least score."""

    def ok(c: Column) -> Column:
        kind, dim, values = c["type"], c["dimension"], c["values"]
        inside = F.exists(values, lambda v: F.contains(F.lower(domain), F.lower(v)))
        level = F.lower(values[0])
        low = F.when(level.contains("high"), privacy < 0.7).when(level.contains("medium"), privacy < 0.5).otherwise(False)
        return (F.when(~c["hard"], True)
                .when(dim.isin("domain", "provider") & (kind == "inclusion"), inside)
                .when(dim.isin("domain", "provider") & (kind == "exclusion"), ~inside)
                .when((dim == "privacy") & (kind == "inclusion"), ~low).otherwise(True))

    return F.forall(constraints, ok)


def negative_preferences_ok(preferences: Column, domain: Column) -> Column:
    """A preference that names a large platform drops that platform's domains."""
    clean = F.transform(preferences, lambda p: F.replace(F.replace(F.lower(p), F.lit("no "), F.lit("")), F.lit("not "), F.lit("")))
    named = [_named(clean, d.replace(".com", "").replace(".", " ")) & domain.contains(d) for d in vocab.BIG_TECH_V1]
    return ~any_of(named)


def _named(preferences: Column, name: str) -> Column:
    return F.exists(preferences, lambda p: p.contains(name))


def privacy_results(results: DataFrame, min_privacy: float | None, exclude_big_tech: bool, score: str = "score") -> DataFrame:
    """Drop low-privacy and large-platform results, then number what is left per query."""
    kept = results
    if min_privacy:
        p = F.col("privacy_score")
        kept = kept.where(p.isNull() | (p == 0) | (p >= min_privacy))
    if exclude_big_tech:
        kept = once(kept, _host=host(F.col("url"))).where(~contains_any(F.col("_host"), vocab.RESULT_FILTER_BIG_TECH)).drop("_host")
    return ordered.ranked(kept, ["query_id"], score, "url")


# ---------------------------------------------------------------- ads
def ad_fair(forbidden: Column) -> Column:
    """None of the ad's dimensions is forbidden."""
    return ~F.exists(forbidden, lambda d: F.lower(d).isin(vocab.AD_FORBIDDEN_DIMENSIONS))


def ad_constraints_ok(constraints: Column, targeting: Column) -> Column:
    """P10: inclusions need a targeted value, exclusions forbid one."""

    def ok(c: Column) -> Column:
        hit = F.coalesce(F.arrays_overlap(targeting[c["dimension"]], c["values"]), F.lit(False))
        return F.when(~c["hard"], True).when(c["type"] == "inclusion", hit).when(c["type"] == "exclusion", ~hit).otherwise(True)

    return F.forall(constraints, ok)


def eligible_ads(ads: DataFrame, ad_groups: DataFrame, campaigns: DataFrame, metrics: DataFrame,
                 campaign_ids: list[int] | None = None, budget: bool = True) -> DataFrame:
    """Active approved ads of active campaigns, of the wanted campaigns, with budget left.

    When no campaign has budget left the budget rule is skipped, as the service does.
    """
    active = campaigns.where(F.col("status") == "active").select("campaign_id", "budget", "status")
    if campaign_ids is not None:
        active = active.where(F.col("campaign_id").isin(campaign_ids))
    if budget:
        funded = reporting.budget_eligible(campaigns, reporting.campaign_spend(metrics, ads, ad_groups)).select("campaign_id")
        marked = active.join(funded.withColumn("funded", F.lit(True)), "campaign_id", "left")
        any_funded = funded.agg(F.count(F.lit(1)).alias("n")).scalar()
        active = marked.where(F.col("funded") | (any_funded == 0))
    good = ads.where((F.col("status") == "active") & (F.col("approval_status") == "approved"))
    return good.join(ad_groups, "ad_group_id").join(active.select("campaign_id"), "campaign_id")


# ---------------------------------------------------------------- privacy projections
def minimise(df: DataFrame, category: str, keys: list[str]) -> DataFrame:
    """Keys and the allowed columns of a category."""
    return df.select(*keys, *vocab.MINIMISATION_FIELDS[category])


def sanitise_payload(payload: Column) -> Column:
    """P15 over a map of strings: identifying keys dropped, session id hashed."""
    kept = F.map_filter(payload, lambda k, v: ~F.lower(k).isin(vocab.PII_FIELDS))
    return F.transform_values(kept, lambda k, v: F.when(F.lower(k) == "session_id", F.substring(F.sha2(v, 256), 1, 16)).otherwise(v))


def sanitise_columns(events: DataFrame) -> DataFrame:
    """P15 over columns."""
    kept = events.drop(*[c for c in events.columns if c.lower() in vocab.PII_FIELDS])
    if "session_id" in kept.columns:
        kept = kept.withColumn("session_id", F.substring(F.sha2(F.col("session_id").cast("string"), 256), 1, 16))
    return kept


def anonymise_intents(intents: DataFrame, as_of: str) -> DataFrame:
    """Session, user and feedback removed; expiry restarted."""
    context = F.map_filter("context", lambda k, v: ~k.isin("sessionId", "userId"))
    expires = F.date_format(at(as_of) + F.expr(f"INTERVAL {INTENT_HOURS} HOURS"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return intents.withColumns({
        "context": context, "expires_at": expires,
        "session_feedback": F.lit(None).cast(intents.schema["session_feedback"].dataType)})


def expired(expires_at: Column, as_of: str) -> Column:
    """Missing, unreadable or reached."""
    return F.coalesce(parse_instant(expires_at) <= at(as_of), F.lit(True))
