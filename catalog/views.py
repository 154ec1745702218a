"""The driver tables seen as recordings, spikes, words and code streams.

events     one recording per 4,000 events; `sample` counts inside it; the value in integer
           cents is a one-channel signal, or eight channels when eight events make a sample
purchase   the target's true spike times; click events are interferers by user_id % 3
orders     a second stream with its own words
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = 4000
CHANNELS = 8
KEYS = ["recording_id"]
# Small enough that the blocked operators really run over several blocks here.
BLOCK = 512
CHUNK = 128

# The same views as SQL.
EV = f"""ev as (
  select 'rec' || (event_id // {SPAN}) as recording_id, event_id % {SPAN} as sample,
         cast(round(value * 100) as bigint) as v, event_type, user_id, event_id
  from events)"""
MULTI = f"""{EV}, m as (
  select recording_id, sample // {CHANNELS} as sample, cast(sample % {CHANNELS} as int) as channel,
         v as value from ev)"""
TRUTH = "truth as (select recording_id, sample as t from ev where event_type = 'purchase')"
OTHERS = "others as (select recording_id, sample as t, user_id % 3 as unit_id from ev where event_type = 'click')"
UNITS = f"""spk as (
  select distinct recording_id, sample // {CHANNELS} as t, user_id % 50 as unit_id
  from ev where event_type in ('click', 'purchase'))"""


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    ev = read(spark, sf, "events")
    return ev.select(
        F.concat(F.lit("rec"), F.floor(F.col("event_id") / SPAN)).alias("recording_id"),
        (F.col("event_id") % SPAN).alias("sample"),
        F.round(F.col("value") * 100).cast("bigint").alias("v"),
        "event_type",
        "user_id",
        "event_id",
    )


def series(spark: SparkSession, sf: str) -> DataFrame:
    """One-channel score trace."""
    return events(spark, sf).select("recording_id", "sample", F.col("v").alias("score"))


def signal(spark: SparkSession, sf: str) -> DataFrame:
    """Eight-channel long rows."""
    return events(spark, sf).select(
        "recording_id",
        F.floor(F.col("sample") / CHANNELS).alias("sample"),
        (F.col("sample") % CHANNELS).cast("int").alias("channel"),
        F.col("v").alias("value"),
    )


def lengths(spark: SparkSession, sf: str) -> DataFrame:
    return (
        series(spark, sf)
        .groupBy("recording_id")
        .agg((F.max("sample") + 1).alias("n_samples"))
    )


def truth(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).where("event_type = 'purchase'").select(
        "recording_id", F.col("sample").alias("spike_time")
    )


def others(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).where("event_type = 'click'").select(
        "recording_id",
        F.col("sample").alias("spike_time"),
        (F.col("user_id") % 3).alias("unit_id"),
    )


def units(spark: SparkSession, sf: str) -> DataFrame:
    """Spikes of fifty units on the eight-channel signal's sample axis."""
    return (
        events(spark, sf)
        .where(F.col("event_type").isin("click", "purchase"))
        .select(
            "recording_id",
            F.floor(F.col("sample") / CHANNELS).alias("spike_time"),
            (F.col("user_id") % 50).alias("unit_id"),
        )
        .distinct()
    )
