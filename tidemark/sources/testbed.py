"""Adapters that read the platform's tables out of the given test tables.

Every adapter is a deterministic projection or join of whole tables, so its size follows the data.
``plans/adapters.py`` holds the same rules as SQL for the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timing import DAY, micros
from tidemark.operators import ordered
from tidemark.sources.tables import load

AS_OF = "2024-01-31 00:00:00"
RANK_AS_OF = "1999-01-01 00:00:00"

USER_AGENTS = [
    "Mozilla/5.0 (X11; Linux x86_64) Firefox/121.0",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0) Mobile Safari",
    "Googlebot/2.1",
    "curl/8.4.0",
    "",
    "Mozilla/4.0",
    "Mozilla/5.0 (Windows NT 10.0) Chrome/120.0",
]
PHRASES = [
    "how to set up encrypted email on android no google",
    "compare best laptop for programming under 50000 rupees",
    "fix wifi not working on windows asap",
    "buy cheap phone over 200 dollars today",
    "best privacy focused search engine no big tech",
    "open source alternative to proprietary photo editor",
    "python django tutorial for beginners",
    "golang concurrency examples advanced performance configuration",
    "find coffee shop near me now",
    "directions to the train station every week",
    "what is end-to-end encryption explain for dummies",
    "docker kubernetes deployment error help",
    "secure email with offline storage and no ads",
    "latest react and typescript news this month",
    "rust webassembly performance guide",
    "once in a lifetime travel deal less than 900 usd",
    "sustainable and ethical clothing company",
    "career development skills course online",
    "verify account and check security settings",
    "historical archive of old maps",
    "data structure and algorithm practice",
    "privacy-first browser for linux with real-time sync",
    "avoid microsoft use ubuntu desktop",
    "weekly report template",
]
HOSTS = ["github.com", "docs.python.org", "en.wikipedia.org", "www.google.com", "mail.proton.me",
         "blog.example.com", "aws.amazon.com", "static.doubleclick.net", "dev.to", "news.example.org"]
PLATFORMS = ["Android", "iOS", "Windows", "macOS", "Linux", "Web"]
PROVIDERS = ["Google", "Microsoft", "Apple", "Proton", "Mozilla"]
LICENSES = ["proprietary", "open-source", "MIT"]
TAG_SETS = ["learning,pdf", "comparison,video", "troubleshooting,text", "privacy,open", "market research,doc", ""]
BACKENDS = ["go_crawler", "searxng", "custom_index"]


def pick(items: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(i) for i in items]), (index % len(items) + 1).cast("int"))


class Testbed:
    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def table(self, name: str) -> DataFrame:
        return load(self.spark, self.directory, name)

    # ---------------------------------------------------------------- advertising
    def ads(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.table("part").select(
            key.alias("ad_id"), (key % 10).alias("advertiser_id"), (key % 25).alias("ad_group_id"),
            F.col("p_name").alias("title"), F.concat_ws(" ", "p_type", "p_brand").alias("description"),
            (F.col("p_retailprice") / 1000).alias("bid_amount"), (F.col("p_size") / 50.0).alias("quality_score"),
            F.when(key % 11 == 0, "paused").otherwise("active").alias("status"),
            F.when(key % 7 == 0, "pending").otherwise("approved").alias("approval_status"))

    def ad_groups(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").cast("bigint").alias("ad_group_id"),
            F.col("n_regionkey").cast("bigint").alias("campaign_id"), F.col("n_name").alias("group_name"))

    def campaigns(self) -> DataFrame:
        key = F.col("r_regionkey").cast("bigint")
        return self.table("region").select(
            key.alias("campaign_id"), F.col("r_name").alias("campaign_name"), (key % 3).alias("advertiser_id"),
            (key * 200.0 + 100.0).alias("budget"),
            F.when(key == 4, "paused").otherwise("active").alias("status"),
            F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("start_date"),
            F.when(key != 3, F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")).alias("end_date"))

    def advertisers(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("advertiser_id"), F.col("s_name").alias("name"))

    def _events(self, kind: str) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("bigint")
        return self.table("events").where(F.col("event_type") == kind).select(
            "event_id", "ts", "user_id", "value", k.alias("ad_id"))

    def clicks(self) -> DataFrame:
        return self._tracked("click", "click_id")

    def impressions(self) -> DataFrame:
        return self._tracked("view", "impression_id")

    def _tracked(self, kind: str, id_name: str) -> DataFrame:
        agent = F.col("ad_id") % 7
        return self._events(kind).select(
            F.col("event_id").alias(id_name), "ad_id", F.col("user_id").cast("string").alias("session_id"), "ts",
            F.md5((F.col("user_id") % 3).cast("string")).alias("ip_hash"),
            F.when((agent != 4) | (F.col("user_id") % 2 != 0), F.md5(agent.cast("string"))).alias("user_agent_hash"),
            pick(USER_AGENTS, F.col("ad_id")).alias("user_agent"),
            F.when(F.col("user_id") % 4 == 0, 390).when(F.col("user_id") % 4 == 1, 1920)
            .when(F.col("user_id") % 4 == 2, 1280).alias("screen_width"))

    def conversions(self) -> DataFrame:
        """Purchases linked to the latest earlier click of the same user; purchases without one are left out."""
        purchases = self._events("purchase").select(
            F.col("event_id").alias("conversion_id"), F.col("user_id").cast("string").alias("session_id"), "ts",
            "value", F.when(F.col("event_id") % 3 != 0, "verified").otherwise("pending").alias("status"),
            micros(F.col("ts")).alias("_pos"))
        clicks = self.clicks().select("session_id", "click_id", micros(F.col("ts")).alias("_pos"))
        linked = ordered.asof_last(purchases, clicks, ["session_id"], "_pos", "click_id", DAY, True, "click_id")
        return linked.where(F.col("click_id").isNotNull()).select(
            "conversion_id", "click_id", F.lit("purchase").alias("conversion_type"), "value", "ts", "status")

    def ad_metrics(self) -> DataFrame:
        """One row per ad and day."""
        k = F.get_json_object("props", "$.k").cast("bigint")
        kind = F.col("event_type")
        daily = (self.table("events").where(kind.isin("view", "click", "purchase"))
                 .groupBy(k.alias("ad_id"), F.col("ts").cast("date").alias("date"))
                 .agg(F.count_if(kind == "view").alias("impression_count"),
                      F.count_if(kind == "click").alias("click_count"),
                      F.count_if(kind == "purchase").alias("conversion_count"),
                      F.coalesce(F.sum(F.when(kind == "purchase", F.col("value"))), F.lit(0.0)).alias("revenue"),
                      F.max("ts").alias("created_at")))
        spend = F.col("impression_count") * F.col("bid_amount")
        return daily.join(self.ads().select("ad_id", "bid_amount"), "ad_id").select(
            "ad_id", "date", "impression_count", "click_count", "conversion_count", "revenue", "created_at",
            (F.col("date").cast("timestamp_ntz") + F.expr("INTERVAL 20 DAYS")).alias("expires_at"),
            spend.alias("spend"),
            F.when(F.col("impression_count") > 0, F.col("click_count") / F.col("impression_count")).alias("ctr"),
            F.when(F.col("click_count") > 0, spend / F.col("click_count")).alias("cpc"),
            F.when(spend > 0, F.col("revenue") / spend).alias("roas"))

    # ---------------------------------------------------------------- text requests
    def queries(self) -> DataFrame:
        """User turns, each led by one plain English phrase (the given prose seldom hits a keyword)."""
        return self.table("conversations").where(F.col("role") == "user").select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
            F.concat(pick(PHRASES, F.col("conv_id") + F.col("turn")), F.lit(" "), F.col("text")).alias("text"),
            F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"),
            F.lit("en-US").alias("locale"),
            F.timestamp_add("MINUTE", -((F.col("conv_id") * 37 + F.col("turn") * 11) % 1800),
                            F.lit(AS_OF).cast("timestamp_ntz")).alias("ts"))

    def requests(self) -> DataFrame:
        """One request per order; its lines are the candidates that came with it."""
        return self.table("orders").select(
            F.col("o_orderkey").alias("query_id"),
            F.concat(pick(PHRASES, F.col("o_orderkey")), F.lit(" "), F.lower("o_orderpriority")).alias("text"))

    def candidates(self) -> DataFrame:
        part = self.table("part")
        lines = self.table("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
        tags = pick(TAG_SETS, F.col("l_linenumber"))
        return lines.select(
            F.col("l_orderkey").alias("query_id"),
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
            F.col("p_name").alias("title"),
            F.concat_ws(" ", F.lower("p_type"), F.lower("p_brand"), pick(PHRASES, F.col("l_suppkey"))).alias("description"),
            pick(PLATFORMS, F.col("l_suppkey")).alias("platform"),
            F.when(F.col("l_partkey") % 9 != 0, pick(PROVIDERS, F.col("l_partkey"))).alias("provider"),
            pick(LICENSES, F.col("l_quantity").cast("bigint")).alias("license"),
            F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice") / 100).otherwise(0.0).alias("price"),
            F.filter(F.split(tags, ","), lambda t: t != "").alias("tags"),
            (F.col("p_size") / 50.0).alias("quality_score"),
            F.when(F.col("l_suppkey") % 13 != 0, F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("recency"),
            F.when(F.col("l_returnflag") == "A", "beginner").when(F.col("l_returnflag") == "N", "intermediate")
            .otherwise("advanced").alias("complexity"),
            (F.col("l_discount") * 10).alias("privacy_rating"), (F.col("l_linestatus") == "O").alias("opensource"))

    def request_ads(self) -> DataFrame:
        """Ads offered with each request."""
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("ad_id")).distinct()

    def request_urls(self) -> DataFrame:
        """URLs offered with each request."""
        key = F.col("l_partkey")
        path = pick(["/docs/setup-guide", "/blog/post_2024", "/tool/converter", "/", "/download/file.zip", "/a/b-c"],
                    F.col("l_suppkey"))
        scheme = F.when(key % 4 == 0, "http://").otherwise("https://")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("query_id"), F.concat(scheme, pick(HOSTS, key), path).alias("url")).distinct()
