"""Findings over streams: the same stateless scan, and distinct findings under a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.detect import detect
from ..plans.catalog import CORE, Detector
from ..sources.files import decode


def file_stream(spark: SparkSession, folder: str, *, glob: str = "*", files_a_trigger: int = 1000) -> DataFrame:
    """New files of a folder as decoded documents."""
    raw = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_a_trigger)
        .load(folder)
    )
    return decode(raw)


def detect_stream(docs: DataFrame, detectors: Sequence[Detector] = CORE, *, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """Findings of every row as it comes: no state, append mode."""
    return detect(docs, detectors, id_col=id_col, text_col=text_col)


def windowed_counts(
    events: DataFrame, *, ts_col: str = "ts", key_col: str = "event_type", window: str = "1 hour", slide: str | None = None, late: str = "10 minutes"
) -> DataFrame:
    """(start, key, n): counts in tumbling windows, or sliding ones; state is dropped ``late`` behind."""
    rows = events.withWatermark(ts_col, late).groupBy(F.window(ts_col, window, slide), key_col).agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), key_col, "n")


def session_counts(events: DataFrame, *, ts_col: str = "ts", key_col: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, end, key, n): events of a key with less than ``gap`` between neighbours."""
    rows = events.withWatermark(ts_col, late).groupBy(F.session_window(ts_col, gap), key_col).agg(F.count("*").alias("n"))
    return rows.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key_col, "n")


def latest_before(left: DataFrame, right: DataFrame, *, key_col: str, ts_col: str, value_col: str) -> DataFrame:
    """The rows of ``left`` with ``value_col`` of the key's latest row of ``right`` at or before them.

    An as-of join as one sorted pass over the union of both, with no pairs made.
    Of rows of ``right`` at one time the greatest value counts; null where none is.
    """
    kept = [c for c in left.columns if c != value_col]
    told = left.select(*kept, F.lit(None).cast(right.schema[value_col].dataType).alias("__value"), F.lit(1).alias("__side"))
    other = right.select(
        *(F.col(c) if c in (key_col, ts_col) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in kept),
        F.col(value_col).alias("__value"), F.lit(0).alias("__side"),
    )
    order = Window.partitionBy(key_col).orderBy(ts_col, "__side", "__value").rowsBetween(Window.unboundedPreceding, 0)
    seen = told.unionByName(other).withColumn(value_col, F.last("__value", ignorenulls=True).over(order))
    return seen.where("__side = 1").select(*kept, value_col)


def run_to_table(rows: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> None:
    """Run a stream over all that is there, and leave its last state as a Parquet table."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def distinct_findings(
    docs: DataFrame, detectors: Sequence[Detector] = CORE, *, ts_col: str = "ts", id_col: str = "path", text_col: str = "text", within: str = "1 hour"
) -> DataFrame:
    """(ts, category, value), each finding once within the watermark, whatever its source."""
    keyed = docs.withColumn("__key", F.struct(F.col(ts_col).alias("ts"), F.col(id_col).alias("id")))
    found = detect(keyed, detectors, id_col="__key", text_col=text_col).select(F.col("id.ts").alias("ts"), "category", "value")
    return found.withWatermark("ts", within).dropDuplicatesWithinWatermark(["category", "value"])
