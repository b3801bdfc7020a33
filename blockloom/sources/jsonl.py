"""Activity journals: segments of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockloom.operators.journal import parse_segments

# Fixed: the journal's columns.
SCHEMA = (
    "sequence long, timestamp_utc timestamp, disk_id string, run_id string, kind string, action string, level string, message string, "
    "object_id string, object_kind string, bytes long, generation long, wire_bytes long"
)


def read_segments(spark: SparkSession, path: str, newest: int = 16, schema: str = SCHEMA) -> DataFrame:
    """Good rows of the newest segments (by file name), with ``segment``; see parse_segments for what is skipped."""
    lines = spark.read.text(path).select("value", "_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    names = lines.select(F.col("file_name")).distinct().orderBy(F.desc("file_name")).limit(newest)
    kept = lines.join(F.broadcast(names), "file_name", "left_semi")  # at most ``newest`` names
    order = F.row_number().over(Window.partitionBy("file_name").orderBy("file_block_start", "at"))
    parsed = parse_segments(kept.select(F.col("file_name").alias("segment"), order.alias("line_no"), F.col("value").alias("line")), schema)
    return parsed.filter("ok").select("segment", "row.*")


def write_segments(df: DataFrame, path: str, rows_per_segment: int = 4096) -> None:
    """Rows as JSON lines in segments by sequence number; a segment is one file at most ``rows_per_segment`` long."""
    segment = F.floor(F.col("sequence") / rows_per_segment)
    out = df.withColumn("segment", F.lpad(segment.cast("string"), 12, "0"))
    out.repartition("segment").sortWithinPartitions("segment", "sequence").write.mode("append").partitionBy("segment").json(path)
