"""Order book files: one JSON array or JSON lines, levels as arrays of structs."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewise.sources import sinks

_LEVELS = "array<array<struct<px:string,sz:string,n:int>>>"
_DATA = f"struct<coin:string,time:bigint,levels:{_LEVELS}>"
_LINE = f"struct<time:string,raw:string,data:{_DATA},coin:string,levels:{_LEVELS}>"


def snapshots(lines: DataFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """(coin, ms, bids, asks) of every readable snapshot in ``value``, with the columns in ``keep``.

    A line may be a snapshot, an array of them, or hold one as a JSON string in
    ``raw``; other lines are skipped."""
    one = F.coalesce(F.from_json("value", f"array<{_LINE}>"), F.array(F.from_json("value", _LINE)))
    rows = lines.where(F.length(F.trim("value")) > 0).select(*keep, F.explode(one).alias("s"))
    inner = F.from_json("s.raw", f"struct<data:{_DATA}>")
    data = F.coalesce("s.data", inner["data"], F.struct(F.col("s.coin"), F.col("s.time").try_cast("bigint").alias("time"), F.col("s.levels")))
    rows = rows.select(*keep, data.alias("d")).where("d.levels IS NOT NULL AND d.coin IS NOT NULL")
    level = lambda i: F.transform(F.get("d.levels", i), lambda x: F.struct(x["px"].try_cast("double").alias("px"), x["sz"].try_cast("double").alias("sz"), x["n"].alias("n")))
    return rows.select(*keep, "d.coin", F.col("d.time").alias("ms"), level(0).alias("bids"), level(1).alias("asks"))


def metrics(book: DataFrame, depth: int = 5, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """Best prices, spread, mid and the sizes of the first levels; nulls where a side is empty."""

    def total(side: str) -> Column:
        return F.when(F.size(side) > 0, F.aggregate(F.slice(side, 1, depth), F.lit(0.0), lambda a, x: a + x["sz"]))

    bid, ask = F.try_element_at("bids", F.lit(1))["px"], F.try_element_at("asks", F.lit(1))["px"]
    mid = (bid + ask) / 2.0
    return book.select(*keep, "coin", "ms", bid.alias("best_bid"), ask.alias("best_ask"), (ask - bid).alias("spread"), mid.alias("mid"), F.when(mid > 0, (ask - bid) / mid * 1e4).alias("spread_bps"), total("bids").alias("bid_depth"), total("asks").alias("ask_depth"))


def plan(wanted: DataFrame, cached: DataFrame, available: DataFrame, cap_hours: int | None = 500, cap_bytes: int | None = None, used_bytes: int = 0) -> DataFrame:
    """(coin, hour, bytes, state): hours that hold fills and are ``cached``, to
    ``fetch``, or ``missing``; those beyond ``cap_hours`` or the bytes left of
    ``cap_bytes`` wait as ``later``, the earliest hours go first.

    ``available`` may tell a file's ``bytes``. The running sums go by hour: only
    the hours' totals, a row an hour, meet in one task."""
    keys = ["coin", "hour"]
    length = F.col("bytes") if "bytes" in available.columns else F.lit(0)
    files = available.groupBy(*keys).agg(F.max(length).cast("long").alias("bytes"), F.lit(True).alias("a"))
    rows = wanted.select(*keys).distinct().join(cached.select(*keys, F.lit(True).alias("c")).distinct(), keys, "left").join(files, keys, "left")
    state = F.when(F.col("c"), "cached").when(F.col("a"), "fetch").otherwise("missing")
    rows = rows.select(*keys, F.coalesce("bytes", F.lit(0)).alias("bytes"), state.alias("state"))
    if cap_hours is None and cap_bytes is None:
        return rows
    fetched = rows.where("state = 'fetch'")
    before = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    totals = fetched.groupBy("hour").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    totals = totals.select("hour", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"))
    own = Window.partitionBy("hour").orderBy("coin").rowsBetween(Window.unboundedPreceding, 0)
    at = fetched.withColumns({"n": F.count("*").over(own), "b": F.sum("bytes").over(own)}).join(totals, "hour")
    fits = (F.col("n0") + F.col("n") <= (cap_hours if cap_hours is not None else 2**62)) & (F.col("b0") + F.col("b") + used_bytes <= (cap_bytes if cap_bytes is not None else 2**62))
    taken = at.select(*keys, "bytes", F.when(fits, "fetch").otherwise("later").alias("state"))
    return taken.unionByName(rows.where("state <> 'fetch'"))


def preflight(planned: DataFrame, cap_bytes: int, used_bytes: int) -> tuple[bool, int]:
    """Whether all files that could be fetched fit the month's bytes, and their bytes."""
    need = planned.where("state IN ('fetch', 'later')").agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    return need <= 0 or used_bytes + need <= cap_bytes, need


def hour_of(us: str | Column) -> Column:
    """Start of the hour as text, so that it can name a file."""
    return F.date_format(F.timestamp_micros(us), "yyyyMMdd-HH")


def _name(root: str, coin: str, hour: str) -> str:
    return f"{root}/coin={quote(coin, safe='')}/{hour}.lz4"


def write_hours(lines: DataFrame, path: str) -> None:
    """An LZ4 file an hour and coin from rows (coin, hour, at, value), by ``at``.

    A file is streamed by one task, renamed into place when it is whole; a task
    that runs again writes the same file. Rows of a null coin or hour have no file."""
    rows = lines.where("coin IS NOT NULL AND hour IS NOT NULL").select("coin", "hour", "at", "value")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        name, out, draft = None, None, None
        written: list[str] = []

        def close() -> None:
            if out is not None:
                out.close()
                fs.move(draft, name)
                written.append(name)

        for batch in batches:
            for coin, hour, value in zip(*(batch.column(c).to_pylist() for c in ("coin", "hour", "value")), strict=True):
                wanted = _name(root, coin, hour)
                if wanted != name:
                    close()
                    name, draft = wanted, f"{wanted}.{uuid.uuid4().hex}.draft"
                    fs.create_dir(wanted.rsplit("/", 1)[0])
                    out = fs.open_output_stream(draft, compression="lz4")
                out.write((value or "").encode() + b"\n")
        close()
        yield pa.RecordBatch.from_pydict({"name": written}, pa.schema([("name", pa.string())]))

    done = rows.repartition("coin", "hour").sortWithinPartitions("coin", "hour", "at", "value").mapInArrow(write, "name string")
    done.write.format("noop").mode("overwrite").save()


def list_hours(spark: SparkSession, path: str) -> DataFrame:
    """(coin, hour, bytes, path) of the files there; their content isn't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.lz4").option("recursiveFileLookup", "true").load(path)
    coin = F.url_decode(F.regexp_replace(F.regexp_extract("path", "/coin=([^/]*)/[^/]*$", 1), r"\+", "%2B"))
    return files.select(coin.alias("coin"), F.regexp_extract("path", r"/([^/]*)\.lz4$", 1).alias("hour"), F.col("length").alias("bytes"), "path")


FETCHED = "coin string, hour string, value string, error string"


def fetch(files: DataFrame, path: str) -> DataFrame:
    """Lines of the given files (coin, hour) under ``path`` as (coin, hour, value, error); a file that can't be
    read to its end or holds no line gives one row with ``error`` and no lines.

    A file is decompressed twice, first to see that it is whole, so that memory is
    bounded by a line and not by a file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.string()) for c in ("coin", "hour", "value", "error")])

        def rows(coin: str, hour: str, values: list, error: str | None = None) -> pa.RecordBatch:
            n = len(values)
            return pa.RecordBatch.from_pydict({"coin": [coin] * n, "hour": [hour] * n, "value": values, "error": [error] * n}, schema)

        fs, root = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for r in batch.to_pylist():
                name = _name(root, r["coin"], r["hour"])
                try:
                    with fs.open_input_stream(name, compression="lz4") as f:
                        empty = not any(line.strip() for line in io.BufferedReader(f))
                except (OSError, pa.ArrowInvalid) as e:
                    yield rows(r["coin"], r["hour"], [None], f"{type(e).__name__}: {e}"[:200])
                    continue
                if empty:
                    yield rows(r["coin"], r["hour"], [None], "empty")
                    continue
                held: list[str] = []
                with fs.open_input_stream(name, compression="lz4") as f:
                    for line in io.BufferedReader(f):
                        held.append(line.decode("utf-8", "replace"))
                        if len(held) == 1000:
                            yield rows(r["coin"], r["hour"], held)
                            held = []
                yield rows(r["coin"], r["hour"], held)

    return files.select("coin", "hour").repartition("coin", "hour").mapInArrow(read, FETCHED)


METRICS = "coin string, hour string, ms bigint, best_bid double, best_ask double, spread double, mid double, spread_bps double, bid_depth double, ask_depth double"
HOURS = "coin string, hour string, error string"


def pull(wanted: DataFrame, files: str, cache: str, batch_id: str, cap_hours: int | None = 500, cap_bytes: int | None = None, used_bytes: int = 0) -> DataFrame:
    """Fetch what the plan allows into ``cache`` and return the plan.

    A pull is a batch of the cache (metrics, and its hours with the error of those
    in quarantine), which counts once its marker is written; a pull that died is
    made again. A file in quarantine is tried again by the next pull."""
    spark = wanted.sparkSession
    held = list_hours(spark, files)
    planned = plan(wanted, cached(spark, cache), held, cap_hours, cap_bytes, used_bytes)
    chosen = f"{cache}/_plans/{batch_id}"
    planned.write.mode("overwrite").parquet(chosen)  # the cache grows below, the plan stays
    planned = spark.read.schema(planned.schema).parquet(chosen)
    lines = f"{cache}/_lines/{batch_id}"
    fetch(planned.where("state = 'fetch'"), files).write.mode("overwrite").parquet(lines)
    lines = spark.read.schema(FETCHED).parquet(lines)
    book = metrics(snapshots(lines.where("error IS NULL").select("value", F.struct("coin", "hour").alias("_file")), keep=["_file"]), keep=["_file"])
    book = book.select("_file.coin", "_file.hour", *(c for c in book.columns if c not in ("coin", "_file")))
    hours = lines.groupBy("coin", "hour").agg(F.max("error").alias("error"))
    sinks.save_batch({"metrics": book, "hours": hours}, cache, batch_id)
    return planned


def cached(spark: SparkSession, cache: str) -> DataFrame:
    """Hours that complete pulls hold."""
    return sinks.read_batches(spark, cache, "hours", HOURS).where("error IS NULL").select("coin", "hour").distinct()
