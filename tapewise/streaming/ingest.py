"""Structured Streaming: envelopes in, deduplicated tables and windows out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tapewise.operators import snapshots
from tapewise.sources import envelopes as wire


def lines(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Files of envelopes as they arrive in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def deduplicated(rows: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row a key within the watermark; state is bounded by ``delay``, not by a number of keys."""
    return rows.where(~F.col("malformed")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["key"])


def consensus_windows(rows: DataFrame, window: str = "300 seconds", delay: str = "10 minutes") -> DataFrame:
    """Entries and traders a coin and direction in tumbling windows."""
    w = F.window("ts", window)
    out = rows.withWatermark("ts", delay).groupBy(w, "coin", "direction").agg(F.size(F.collect_set("wallet")).cast("long").alias("wallets"), F.count("*").alias("entries"))
    return out.select(F.col("window.start").alias("start"), "coin", "direction", "wallets", "entries")


def session_segments(rows: DataFrame, gap_us: int = 45 * 60 * 1_000_000, delay: str = "10 minutes") -> DataFrame:
    """Segments of a trader's positions in a coin and direction, cut where more
    than ``gap_us`` lie between two: start, rows and hours of each.

    A late row within the watermark joins segments that it bridges; a segment is
    told once, when the watermark passes its gap. Rows without a time are skipped."""
    # a row at the very moment where a window ends still belongs to it
    w = F.session_window("ts", f"{gap_us} microseconds")
    seen = rows.where("ts IS NOT NULL").withWatermark("ts", delay)
    out = seen.groupBy(w, "trader_id", "coin", "direction").agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("last"))
    hours = F.floor((F.unix_micros("last") - F.unix_micros("start")) / 1e6) / 3600.0
    return out.select("trader_id", "coin", "direction", "start", "n", hours.alias("hours"))


def start_merge(rows: DataFrame, path: str, checkpoint: str, key: list[str], order: list[str]) -> StreamingQuery:
    """Fold each micro-batch into a versioned table by key, once whatever is
    repeated; late rows are merged too. Read it by ``snapshots.read``."""
    merge = lambda batch, number: snapshots.merge(batch.sparkSession, path, batch, key, order, number)
    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_quarantine(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Malformed records, to a table of their own."""
    return rows.where("malformed").writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fills_stream(spark: SparkSession, path: str) -> DataFrame:
    return wire.fills(wire.envelopes(lines(spark, path)))
