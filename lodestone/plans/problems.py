"""Registered queries of the general data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.timestamps import parse_timestamp
from lodestone.operators.zones import normalise_timestamps, zone_evidence
from lodestone.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each memory whose timestamp denotes a moment, with that moment."""
    memories = table(spark, folder, "memories").select("memory_id", "timestamp", "channel", "created_at")
    found = normalise_timestamps(memories, table(spark, folder, "capture_channels"))
    return found.where(F.col("utc_micros").isNotNull()).select("memory_id", "utc_micros")


def p1_zone_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """For each channel, how many zoneless times each known history would misplace."""
    memories = table(spark, folder, "memories").select("timestamp", "channel", "created_at")
    order = table(spark, folder, "capture_channels").select("channel", "date_order")
    parsed = memories.join(order, "channel", "left").withColumn("p", parse_timestamp(F.col("timestamp"), F.col("date_order")))
    walls = parsed.where("p.offset_minutes is null and p.zone is null").select("channel", "p.wall_micros", F.unix_micros("created_at").alias("ingest_micros"))
    return zone_evidence(walls).select("channel", "zone", "rows", "violations", F.round("delay_minutes", 3).alias("delay_minutes"))


def p1_withheld(spark: SparkSession, folder: str) -> DataFrame:
    """For each channel, how many of the moments that its declared zone gives come out the same when no zone is declared."""
    memories = table(spark, folder, "memories").select("memory_id", "timestamp", "channel", "created_at")
    channels = table(spark, folder, "capture_channels")
    told = normalise_timestamps(memories, channels).where("zone_source = 'declared'").select("memory_id", "channel", "utc_micros")
    withheld = channels.withColumn("zone_name", F.lit(None).cast("string"))
    own = normalise_timestamps(memories, withheld).where("utc_micros is not null").select("memory_id", F.col("utc_micros").alias("estimated"))
    both = told.join(own, "memory_id", "left")
    return both.groupBy("channel").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("utc_micros") == F.col("estimated")).alias("agreeing"))


QUERIES = {"p1_found": p1_found, "p1_zone_evidence": p1_zone_evidence, "p1_withheld": p1_withheld}
