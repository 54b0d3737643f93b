"""Campaign reporting, ROI, trends and live figures (J1, J2, J4, J8, A1-A6, WN5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import ratio
from tidemark.functions.timing import at

METRICS = ["impressions", "clicks", "conversions", "ctr", "cvr"]
REPEAT_RATE = 1.5  # fixed value
LOOKBACK_DAYS = 30  # fixed value
TREND_BAND = 5.0  # fixed value, percent
FORECAST_ROWS = 7  # fixed value


def per_ad(metrics: DataFrame, by: tuple[str, ...] = ("ad_id",)) -> DataFrame:
    """Fold the fact table to one row per ad before it meets any dimension, so that the joins move
    pre-aggregated rows. Averages are kept as sum and count."""
    return metrics.groupBy(*by).agg(
        F.sum("impression_count").alias("impressions"), F.sum("click_count").alias("clicks"),
        F.sum("conversion_count").alias("conversions"),
        *[x for m in ("ctr", "cpc", "roas") for x in (F.sum(m).alias(f"{m}_sum"), F.count(m).alias(f"{m}_n"))])


def ad_star_join(metrics: DataFrame, ads: DataFrame, ad_groups: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Fact -> ad -> group -> campaign. Inner equi joins; the planner broadcasts a dimension only
    when its measured size is below the session's limit."""
    return (metrics.join(ads, "ad_id").join(ad_groups, "ad_group_id")
            .join(campaigns.drop("advertiser_id", "status"), "campaign_id"))


def campaign_ads(ads: DataFrame, ad_groups: DataFrame) -> DataFrame:
    return ads.join(ad_groups, "ad_group_id").select("campaign_id", "ad_id", "bid_amount")


def facts_of_campaigns(facts: DataFrame, ads: DataFrame, ad_groups: DataFrame, campaign_ids: list[int]) -> DataFrame:
    """Facts of the ads of some campaigns, as a semi join (no id list on the driver)."""
    wanted = campaign_ads(ads, ad_groups).where(F.col("campaign_id").isin(campaign_ids)).select("ad_id")
    return facts.join(wanted, "ad_id", "left_semi")


def campaign_performance(metrics: DataFrame, ads: DataFrame, ad_groups: DataFrame, campaigns: DataFrame,
                         start: str | None = None, end: str | None = None) -> DataFrame:
    """A1. Cost is impressions x bid; ctr, cpc and roas are means over fact rows."""
    if start is not None:
        metrics = metrics.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        metrics = metrics.where(F.col("date") <= F.lit(end).cast("date"))
    star = (per_ad(metrics).join(campaign_ads(ads, ad_groups), "ad_id")
            .join(campaigns.select("campaign_id", "campaign_name"), "campaign_id"))
    mean = lambda m: F.coalesce(F.try_divide(F.sum(f"{m}_sum"), F.sum(f"{m}_n")), F.lit(0.0))
    return star.groupBy("campaign_id", "campaign_name").agg(
        F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"),
        F.sum("conversions").alias("conversions"), mean("ctr").alias("avg_ctr"), mean("cpc").alias("avg_cpc"),
        F.sum(F.col("impressions") * F.col("bid_amount")).alias("cost"), mean("roas").alias("avg_roas"))


def campaign_spend(metrics: DataFrame, ads: DataFrame, ad_groups: DataFrame) -> DataFrame:
    """Impressions x bid per campaign."""
    return (metrics.groupBy("ad_id").agg(F.sum("impression_count").alias("impressions"))
            .join(campaign_ads(ads, ad_groups), "ad_id").groupBy("campaign_id")
            .agg(F.sum(F.col("impressions") * F.col("bid_amount")).alias("spend")))


def budget_eligible(campaigns: DataFrame, spend: DataFrame) -> DataFrame:
    """Active campaigns that have spent less than their budget."""
    return (campaigns.where(F.col("status") == "active").join(spend, "campaign_id", "left")
            .withColumn("spend", F.coalesce("spend", F.lit(0.0))).where(F.col("spend") < F.col("budget")))


def conversion_clicks(conversions: DataFrame, clicks: DataFrame) -> DataFrame:
    """Each conversion with its click."""
    return conversions.join(
        clicks.select("click_id", "ad_id", "session_id", F.col("ts").alias("click_ts")), "click_id")


def campaign_roi(campaigns: DataFrame, ads: DataFrame, ad_groups: DataFrame, metrics: DataFrame, clicks: DataFrame,
                 conversions: DataFrame, as_of: str) -> DataFrame:
    """A2: spend, revenue of verified conversions, and the ratios on them, for each campaign's own dates.

    Facts are folded to (ad, date) and revenue to clicks first; the campaign dates are applied on these
    small tables. A campaign without ads keeps a row of zeros.
    """
    span = campaigns.select(
        "campaign_id", "campaign_name",
        F.coalesce("start_date", at(as_of) - F.expr(f"INTERVAL {LOOKBACK_DAYS} DAYS")).alias("start"),
        F.coalesce("end_date", at(as_of)).alias("end"))
    owned = campaign_ads(ads, ad_groups).join(span, "campaign_id")
    daily = per_ad(metrics, ("ad_id", "date")).join(owned, "ad_id").where(
        F.col("date").between(F.col("start").cast("date"), F.col("end").cast("date")))
    shown = daily.groupBy("campaign_id").agg(
        F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"),
        F.sum("conversions").alias("conversions"),
        F.sum(F.col("impressions") * F.col("bid_amount")).alias("total_spend"))
    paid = conversions.where(F.col("status") == "verified").groupBy("click_id").agg(F.sum("value").alias("value"))
    earned = (clicks.select("click_id", "ad_id", "ts").join(paid, "click_id").join(owned, "ad_id")
              .where(F.col("ts").between(F.col("start"), F.col("end")))
              .groupBy("campaign_id").agg(F.sum("value").alias("total_revenue")))
    whole = span.select("campaign_id", "campaign_name").join(shown, "campaign_id", "left").join(
        earned, "campaign_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    d = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    base = whole.select("campaign_id", "campaign_name", d("total_spend"), d("total_revenue"), n("impressions"),
                        n("clicks"), n("conversions"))
    spend, revenue = F.col("total_spend"), F.col("total_revenue")
    return base.select(
        "*", ratio(revenue - spend, spend, 100.0).alias("roi"), ratio(revenue, spend).alias("roas"),
        ratio(spend, F.col("conversions")).alias("cpa"),
        (ratio(revenue, F.col("conversions")) * REPEAT_RATE).alias("clv"),
        ratio(F.col("clicks"), F.col("impressions"), 100.0).alias("ctr"),
        ratio(F.col("conversions"), F.col("clicks"), 100.0).alias("cvr"))


def daily_metrics(metrics: DataFrame, start: str, end: str) -> DataFrame:
    """A3: sums and rates per day, both ends included."""
    return (metrics.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
            .groupBy("date").agg(F.sum("impression_count").alias("impressions"), F.sum("click_count").alias("clicks"),
                                 F.sum("conversion_count").alias("conversions"))
            .select("*", ratio(F.col("clicks"), F.col("impressions"), 100.0).alias("ctr"),
                    ratio(F.col("conversions"), F.col("clicks"), 100.0).alias("cvr")))


def _metric(name: str, default: str) -> str:
    return name.lower() if name.lower() in METRICS else default


def trend(facts: DataFrame, metric: str, as_of: str, days: int = 30, by: str = "campaign_id") -> DataFrame:
    """WN5: previous against current half of the period, and a linear forecast, per ``by``.

    Facts fold to one row per (by, day) first; a group then holds at most ``days`` + 1 rows.
    """
    metric = _metric(metric, "impressions")
    first, mid, last = (f"date_sub(date'{as_of[:10]}', {d})" for d in (days, days // 2, 0))
    daily = (facts.where(F.col("date").between(F.expr(first), F.expr(last))).groupBy(by, "date")
             .agg(F.sum("impression_count").alias("impressions"), F.sum("click_count").alias("clicks"),
                  F.sum("conversion_count").alias("conversions"))
             .select("*", ratio(F.col("clicks"), F.col("impressions"), 100.0).alias("ctr"),
                     ratio(F.col("conversions"), F.col("clicks"), 100.0).alias("cvr")))
    newest = Window.partitionBy(by).orderBy(F.col("date").desc())
    v, rn = F.col(metric).cast("double"), F.row_number().over(newest)
    halves = daily.select(by, "date", v.alias("v"), rn.alias("rn")).groupBy(by).agg(
        F.coalesce(F.avg(F.when(F.col("date") >= F.expr(mid), F.col("v"))), F.lit(0.0)).alias("current_value"),
        F.coalesce(F.avg(F.when(F.col("date") < F.expr(mid), F.col("v"))), F.lit(0.0)).alias("previous_value"),
        F.max(F.when(F.col("rn") == 1, F.col("v"))).alias("_v1"),
        F.max(F.when(F.col("rn") == FORECAST_ROWS, F.col("v"))).alias("_v7"))
    cur, prev = F.col("current_value"), F.col("previous_value")
    change = F.when(prev > 0, (cur - prev) / prev * 100.0).otherwise(F.when(cur > 0, 100.0).otherwise(0.0))
    return halves.select(
        by, "current_value", "previous_value", change.alias("change_percent"),
        F.when(change > TREND_BAND, "up").when(change < -TREND_BAND, "down").otherwise("stable").alias("direction"),
        (F.col("_v1") + (F.col("_v1") - F.col("_v7")) / (FORECAST_ROWS - 1) * 7).alias("forecast"))


def top_ads(metrics: DataFrame, ads: DataFrame, metric: str = "ctr", limit: int = 10) -> DataFrame:
    """A4: best ads by one metric."""
    metric = _metric(metric, "ctr")
    folded = metrics.groupBy("ad_id").agg(
        F.sum("impression_count").alias("impressions"), F.sum("click_count").alias("clicks"),
        F.sum("conversion_count").alias("conversions"))
    rated = folded.select("*", ratio(F.col("clicks"), F.col("impressions"), 100.0).alias("ctr"),
                          ratio(F.col("conversions"), F.col("clicks"), 100.0).alias("cvr"))
    return rated.join(ads.select("ad_id", "title"), "ad_id").orderBy(F.col(metric).desc(), "ad_id").limit(limit)


def live_metrics(metrics: DataFrame, campaigns: DataFrame, sessions: DataFrame, as_of: str) -> DataFrame:
    """A5: figures of the hour before as_of, active campaigns, and sessions seen in that hour."""
    since = at(as_of) - F.expr("INTERVAL 1 HOUR")
    sums = metrics.where(F.col("created_at") >= since).agg(
        F.coalesce(F.sum("impression_count"), F.lit(0)).alias("impressions"),
        F.coalesce(F.sum("click_count"), F.lit(0)).alias("clicks"),
        F.coalesce(F.sum("conversion_count"), F.lit(0)).alias("conversions"))
    active = campaigns.agg(F.count_if(F.col("status") == "active").alias("active_campaigns"))
    users = sessions.where(F.col("ts") >= since).agg(F.count_distinct("session_id").alias("live_users"))
    # three one-row frames, stacked and folded
    cols = ["impressions", "clicks", "conversions", "active_campaigns", "live_users"]
    stacked = (sums.unionByName(active, allowMissingColumns=True).unionByName(users, allowMissingColumns=True))
    one = stacked.agg(*[F.max(c).alias(c) for c in cols])
    return one.select("*", F.round(ratio(F.col("clicks"), F.col("impressions"), 100.0), 2).alias("ctr"))
