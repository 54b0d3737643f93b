"""JSON payloads: intents to typed records (S14) and the event envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import vocab

RAW_INTENT = """intentId STRING, context MAP<STRING,STRING>, expiresAt STRING,
 declared STRUCT<query:STRING,goal:STRING,constraints:ARRAY<STRUCT<type:STRING,dimension:STRING,value:STRING,hardFilter:BOOLEAN>>,
   negativePreferences:ARRAY<STRING>,urgency:STRING,budget:STRING,skillLevel:STRING>,
 inferred STRUCT<useCases:ARRAY<STRING>,temporalIntent:STRUCT<horizon:STRING,recency:STRING,frequency:STRING>,resultType:STRING,
   complexity:STRING,ethicalSignals:ARRAY<STRUCT<dimension:STRING,preference:STRING>>>,
 sessionFeedback STRUCT<clicked:ARRAY<STRING>,dwell:DOUBLE,reformulated:BOOLEAN,bounced:BOOLEAN>"""
ENVELOPE = "event_type STRING, timestamp STRING, data STRING"


def member(value: Column, allowed: list[str], default: str | None = None) -> Column:
    return F.when(value.isin(allowed), value).otherwise(F.lit(default))


def loose(value: Column, allowed: list[str]) -> Column:
    """An enumeration value, also matched without case, underscores and dashes; null otherwise."""
    plain = F.translate(F.lower(value), "_-", "")
    table = F.create_map(*[F.lit(x) for v in allowed for x in (v.replace("_", "").replace("-", ""), v)])
    return F.when(value.isin(allowed), value).otherwise(F.try_element_at(table, plain))


def parse_intents(df: DataFrame, column: str = "payload") -> DataFrame:
    """Typed intents; a value that is no member of its enumeration becomes the default or null."""
    raw = df.withColumn("_i", F.from_json(column, RAW_INTENT))
    d, n = F.col("_i.declared"), F.col("_i.inferred")

    def typed(c: Column) -> Column:
        v = F.coalesce(c["value"], F.lit(""))
        values = F.when(v.startswith("["), F.from_json(v, "array<string>")).otherwise(F.array(v))
        return F.struct(member(c["type"], vocab.CONSTRAINT_TYPES).alias("type"), F.coalesce(c["dimension"], F.lit("")).alias("dimension"),
                        values.alias("values"), F.coalesce(c["hardFilter"], F.lit(True)).alias("hard"))

    none = lambda t: F.array().cast(f"array<{t}>")
    temporal = n["temporalIntent"]
    return raw.select(
        *df.columns,
        F.coalesce("_i.intentId", F.lit("")).alias("intent_id"),
        F.coalesce("_i.context", F.create_map().cast("map<string,string>")).alias("context"),
        F.struct(
            d["query"].alias("query"), loose(d["goal"], vocab.GOALS).alias("goal"),
            F.coalesce(F.transform(d["constraints"], typed),
                       none("struct<type:string,dimension:string,values:array<string>,hard:boolean>")).alias("constraints"),
            F.coalesce(d["negativePreferences"], none("string")).alias("negative_preferences"),
            member(d["urgency"], vocab.URGENCIES, "flexible").alias("urgency"),
            member(d["skillLevel"], vocab.SKILL_LEVELS, "intermediate").alias("skill_level")).alias("declared"),
        F.struct(
            F.array_compact(F.transform(F.coalesce(n["useCases"], none("string")), lambda u: loose(u, vocab.USE_CASES))).alias("use_cases"),
            F.when(temporal.isNotNull(), F.struct(
                member(temporal["horizon"], vocab.HORIZONS, "flexible").alias("horizon"),
                member(temporal["recency"], vocab.RECENCIES, "evergreen").alias("recency"),
                member(temporal["frequency"], vocab.FREQUENCIES, "flexible").alias("frequency"))).alias("temporal"),
            member(n["resultType"], vocab.RESULT_TYPES).alias("result_type"),
            member(n["complexity"], vocab.COMPLEXITIES, "moderate").alias("complexity"),
            F.coalesce(F.transform(n["ethicalSignals"], lambda s: F.struct(
                member(s["dimension"], vocab.ETHICAL_DIMENSIONS).alias("dimension"),
                F.coalesce(s["preference"], F.lit("")).alias("preference"))),
                none("struct<dimension:string,preference:string>")).alias("ethical_signals")).alias("inferred"),
        F.col("_i.sessionFeedback").alias("session_feedback"),
        F.coalesce("_i.expiresAt", F.lit("")).alias("expires_at"))


def to_envelope(df: DataFrame, event_type: str, timestamp: Column) -> DataFrame:
    """One JSON envelope {event_type, timestamp, data} per row, as ``value``."""
    return df.select(F.to_json(F.struct(
        F.lit(event_type).alias("event_type"), F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.struct(*df.columns).alias("data"))).alias("value"))


def from_envelope(df: DataFrame, data_schema: str) -> DataFrame:
    """S3: envelope rows back to columns; unreadable rows are dropped."""
    schema = f"event_type STRING, timestamp STRING, data STRUCT<{data_schema}>"
    return df.select(F.from_json(F.col("value").cast("string"), schema).alias("e")).where(
        F.col("e.event_type").isNotNull()).select("e.event_type", "e.timestamp", "e.data.*")
