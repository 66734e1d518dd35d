"""The log as a stream: entries checked as they arrive and counted by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.operators.audit import entry_hash

SCHEMA = "seq long, prev_hash string, payload string, entry_hash string, ts timestamp"


def tail(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """New entries of a folder of JSON-lines files, with `intact`: whether an entry has its own hash."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return rows.withColumn("intact", F.coalesce(entry_hash(F.col("seq"), F.col("prev_hash"), F.col("payload")) == F.col("entry_hash"), F.lit(False)))


def outcome_counts(entries: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Entries by kind and window of time; later ones than the watermark allows are left out."""
    kind = F.get_json_object("payload", "$.kind")
    counted = entries.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), kind.alias("kind")).agg(F.count("*").alias("n"), F.count_if(~F.col("intact")).alias("broken"))
    return counted.select("w.start", "w.end", "kind", "n", "broken")
