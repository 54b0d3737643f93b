"""URL facts and ranking."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import hashing, vocab
from tidemark.functions.text import clamp, contains_any, count_contains, first_match, quoted_alternation
from tidemark.functions.urls import bare_host, host, part
from tidemark.operators import filters, ordered
from tidemark.session import once


def _suffix(domains: Iterable[str]) -> str:
    """Pattern of a host that is one of the domains or below one. The leftmost match is the longest name."""
    return r"(?:^|\.)(" + quoted_alternation(domains) + r")\z"


def _known(table: dict, domain: Column) -> Column:
    """The longest name of a fixed table that is the domain or one of its parents; null if none is."""
    return F.nullif(F.regexp_extract(domain, _suffix(table), 1), F.lit(""))


def _value(table: dict, name: Column) -> Column:
    """Value of a name in a small fixed table, null if it is not there."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), name)


def _under(domains: list[str], domain: Column) -> Column:
    """Whether the domain is one of the domains or below one."""
    return domain.rlike(_suffix(domains))


def facts(domain: Column, name: Column | None = None) -> dict[str, Column]:
    """J7, first profile. The host is compared with the fixed domain tables, so there is no ends-with
    join. Known domains (``name``, if it is looked up already) keep their facts; others get defaults by tracker or
    platform."""
    name = _known(vocab.PRIVACY_DOMAINS_V1, domain) if name is None else name
    column = lambda i: _value({d: v[i] for d, v in vocab.PRIVACY_DOMAINS_V1.items()}, name)
    big = name.isNull() & _under(vocab.BIG_TECH_V1, domain)
    tracker = name.isNull() & _under(vocab.TRACKERS_V1, domain)
    return {
        "privacy_score": F.coalesce(column(0), F.when(big, 0.3).otherwise(0.5)),
        "tracker_count": F.coalesce(column(1), F.when(big, 3).when(tracker, 1).otherwise(0)),
        "kind": F.coalesce(column(2), F.lit("unknown")),
        "is_open_source": F.coalesce(column(3), F.lit(False)),
        "is_non_profit": F.coalesce(column(4), F.lit(False)), "is_big_tech": big}


def domain_facts(domain: Column) -> Column:
    """The facts of a domain as one structure."""
    return F.struct(*[c.alias(n) for n, c in facts(domain).items()])


def with_facts(rows: DataFrame) -> DataFrame:
    """Rows with the facts of their ``domain`` as columns."""
    found = once(rows, _known=_known(vocab.PRIVACY_DOMAINS_V1, F.col("domain")))
    return once(found, **facts(F.col("domain"), F.col("_known"))).drop("_known")


def facts_v2(domain: Column) -> dict[str, Column]:
    """J7, second profile."""
    exact = lambda ds: domain.isin(ds)
    score = (F.when(exact(vocab.PRIVACY_DOMAINS_V2), 0.95).when(exact(vocab.BIG_TECH_V2), 0.3)
             .when(_under(vocab.PRIVACY_DOMAINS_V2, domain), 0.9).when(_under(vocab.BIG_TECH_V2, domain), 0.25)
             .when(contains_any(domain, vocab.TRACKERS_V2), 0.1).otherwise(0.5))
    return {
        "privacy_score": score, "tracker_count": count_contains(domain, vocab.TRACKERS_V2),
        "is_open_source": contains_any(domain, vocab.OPEN_SOURCE_V2),
        "is_non_profit": contains_any(domain, vocab.NON_PROFIT_V2), "is_big_tech": _under(vocab.BIG_TECH_V2, domain)}


def authority(domain: Column) -> Column:
    """U4."""
    return F.coalesce(_value(vocab.AUTHORITY_DOMAINS, _known(vocab.AUTHORITY_DOMAINS, domain)), F.lit(vocab.AUTHORITY_DEFAULT))


def title_case(text: Column) -> Column:
    """Upper case after anything that is not a letter, lower case after a letter."""
    chars = F.split(text, "")
    any_script = F.array_join(F.transform(chars, lambda c, i: F.when(
        (i > 0) & F.coalesce(F.get(chars, i - 1).rlike(r"\p{L}"), F.lit(False)), F.lower(c)).otherwise(F.upper(c))), "")
    # ASCII text by whole words instead of characters: each part ends with the character that is no letter
    ascii_only = F.array_join(F.transform(F.split(text, r"(?<=[^A-Za-z])"), lambda w: F.initcap(w)), "")
    return F.when(text.rlike(r"[^\x00-\x7f]"), any_script).otherwise(ascii_only)


def content_type(both: Column) -> Column:
    """From domain and path, joined by a space."""
    return first_match([(k, contains_any(both, ws)) for k, ws in vocab.CONTENT_TYPE_WORDS_V1], "general")


def cleaned_path(path: Column) -> Column:
    """The last part of a path as words, without those of one character."""
    last = F.translate(F.regexp_extract(path, r"([^/]+)/*$", 1), "-_", "  ")
    return F.trim(F.regexp_replace(last, r"(?<![\p{L}\p{N}_])[\p{L}\p{N}_](?![\p{L}\p{N}_])", ""))


def analyse_urls(urls: DataFrame) -> DataFrame:
    """U1, first profile: domain, facts, content type, title, description and authority of each URL."""
    staged = once(urls, domain=bare_host(F.col("url")), _host=host(F.col("url")), _path=F.lower(part(F.col("url"), 3)))
    staged = once(with_facts(staged), _both=F.concat_ws(" ", "domain", "_path"), _title=cleaned_path(F.col("_path")))
    kinds = once(staged, content_type=content_type(F.col("_both")))
    label = F.create_map(*[F.lit(x) for kv in vocab.CONTENT_DESCRIPTION_V1.items() for x in kv])
    return kinds.select(
        *urls.columns, "domain", "content_type", F.when(F.col("_title") == "", F.col("domain")).otherwise(title_case(F.col("_title"))).alias("title"),
        F.concat(label[F.col("content_type")], F.lit(" from "), "_host").alias("description"),
        "privacy_score", "tracker_count", "is_open_source", "is_non_profit", "is_big_tech",
        F.lit(True).alias("encryption_enabled"), authority(F.col("domain")).alias("authority_score"))


def analyse_urls_v2(urls: DataFrame) -> DataFrame:
    """U1, second profile."""
    staged = once(urls, domain=bare_host(F.col("url")), _low=F.lower("url"))
    name = F.translate(F.substring_index(F.substring_index("domain", ".", -2), ".", 1), "-_", "  ")
    staged = once(staged, **facts_v2(F.col("domain")), _name=F.when(F.col("domain").contains("."), name))
    low = F.col("_low")
    return staged.select(
        *urls.columns, "domain", F.when(F.col("_name").isNotNull(), title_case(F.col("_name"))).otherwise(F.col("domain")).alias("title"),
        F.concat(F.lit("Web resource from "), "domain").alias("description"),
        first_match([(k, contains_any(low, ws)) for k, ws in vocab.CONTENT_TYPE_WORDS_V2], "general").alias("content_type"),
        "privacy_score", "tracker_count", "is_open_source", "is_non_profit", "is_big_tech",
        F.col("url").startswith("https").alias("encryption_enabled"))


def quality(encrypted: Column, privacy: Column, trackers: Column) -> Column:
    """U2."""
    return clamp(F.lit(0.5) + F.when(encrypted, 0.1).otherwise(0.0)
                 + F.when(privacy > 0.7, 0.15).when(privacy > 0.5, 0.05).otherwise(0.0)
                 + F.when(trackers == 0, 0.15).when(trackers <= 2, 0.05).when(trackers > 5, -0.15).otherwise(0.0))


def has_signal(signals: Column, dimension: str) -> Column:
    return F.exists(signals, lambda s: s["dimension"] == dimension)


def n_signals(signals: Column, dimension: str) -> Column:
    return F.size(F.filter(signals, lambda s: s["dimension"] == dimension))


def ethics(signals: Column, privacy: Column, open_source: Column, non_profit: Column, ads: Column | None = None) -> Column:
    """U3."""
    penalty = F.lit(0.0) if ads is None else F.when(ads == "ad_supported", 0.1).otherwise(0.0)
    return clamp(F.lit(0.5) + F.when(privacy > 0.7, n_signals(signals, "privacy") * F.lit(0.2)).otherwise(0.0)
                 + F.when(open_source, n_signals(signals, "openness") * F.lit(0.2) + F.lit(0.15)).otherwise(0.0)
                 + F.when(non_profit, 0.1).otherwise(0.0) - penalty)


def ethics_v2(privacy: Column, open_source: Column, non_profit: Column) -> Column:
    """U3, second profile."""
    return F.least(F.lit(1.0), F.lit(0.5) + F.when(open_source, 0.3).otherwise(0.0) + F.when(non_profit, 0.1).otherwise(0.0)
                   + F.when(privacy > 0.7, 0.1).otherwise(0.0))


def text_similarity(a: Column, b: Column) -> Column:
    return (hashing.similarity(a, b) + 1) / 2


def score_urls(rows: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Scores of analysed URLs beside ``text`` and ``ethical_signals`` of their request (first profile)."""
    w = weights or vocab.URL_WEIGHTS_V1
    content = F.concat_ws(" ", "title", "description", "content_type")
    scored = rows.select(
        "*", text_similarity(F.col("text"), content).alias("relevance_score"),
        quality(F.col("encryption_enabled"), F.col("privacy_score"), F.col("tracker_count")).alias("quality_score"),
        ethics(F.col("ethical_signals"), F.col("privacy_score"), F.col("is_open_source"), F.col("is_non_profit")).alias("ethics_score"))
    return scored.withColumn("final_score", F.col("relevance_score") * w["relevance"] + F.col("privacy_score") * w["privacy"]
                             + F.col("quality_score") * w["quality"] + F.col("ethics_score") * w["ethics"])


def score_urls_v2(rows: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Scores with intent boosts, normalised by the weight total (second profile)."""
    w = weights or vocab.URL_WEIGHTS_V2
    asks = contains_any(F.lower("text"), vocab.PRIVACY_QUERY_WORDS)
    boosted = F.when(asks, F.least(F.lit(1.0), F.col("privacy_score") * 1.2)).otherwise(F.col("privacy_score"))
    privacy = F.when(has_signal(F.col("ethical_signals"), "privacy"), F.least(F.lit(1.0), boosted * 1.1)).otherwise(boosted)
    base = ethics_v2(F.col("privacy_score"), F.col("is_open_source"), F.col("is_non_profit"))
    ethic = F.when(has_signal(F.col("ethical_signals"), "openness") & F.col("is_open_source"), F.least(F.lit(1.0), base * 1.2)).otherwise(base)
    content = F.concat_ws(" ", "title", "description", "domain")
    scored = rows.select("*", text_similarity(F.col("text"), content).alias("relevance_score"),
                         F.when(F.col("encryption_enabled"), 0.7).otherwise(0.3).alias("quality_score"),
                         ethic.alias("ethics_score"), privacy.alias("boosted_privacy"))
    total = F.col("relevance_score") * w["relevance"] + F.col("boosted_privacy") * w["privacy"] + F.col(
        "quality_score") * w["quality"] + F.col("ethics_score") * w["ethics"]
    return scored.withColumn("final_score", total / sum(w.values()))


def rank_urls(requests: DataFrame, urls: DataFrame, profile: str = "v1", min_privacy: float = 0.0, exclude_big_tech: bool = False,
              weights: dict[str, float] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Filter, score and number the URLs of each request. ``requests`` carries query_id, text,
    constraints, negative_preferences and ethical_signals. ``columns``: what is wanted beside query_id, url, final_score
    and rank (None: everything)."""
    rows = filters.request_join(requests, urls)
    if profile == "v2":
        rows = analyse_urls_v2(rows)
    else:
        rows = analyse_urls(rows)
        rows = rows.where(filters.url_constraints_ok(F.col("constraints"), F.col("domain"), F.col("privacy_score"))
                          & filters.negative_preferences_ok(F.col("negative_preferences"), F.col("domain")))
    rows = rows.where(F.col("privacy_score") >= min_privacy)
    if exclude_big_tech:
        rows = rows.where(~F.col("is_big_tech"))
    scored = score_urls_v2(rows, weights) if profile == "v2" else score_urls(rows, weights)
    if columns is not None:
        scored = scored.select("query_id", "url", "final_score", *columns)
    return ordered.ranked(scored, ["query_id"], "final_score", "url")


def ranked_counts(urls: DataFrame, ranked: DataFrame) -> DataFrame:
    """Offered and filtered-out URLs per request."""
    offered = urls.groupBy("query_id").agg(F.count(F.lit(1)).alias("total_urls"))
    kept = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("kept"))
    return offered.join(kept, "query_id", "left").select(
        "query_id", "total_urls", (F.col("total_urls") - F.coalesce("kept", F.lit(0))).alias("filtered_count"))
