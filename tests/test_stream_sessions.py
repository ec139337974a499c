"""Session segments in a stream against the batch query, whatever the order of arrival."""

import random

from pyspark.sql import functions as F

from tapewise.plans.dialect import view
from tapewise.plans.registry import QUERIES
from tapewise.streaming import ingest

SF = "/root/testdata/sf0.001"
SCHEMA = "trader_id long, coin string, direction string, ts timestamp"


def segments(spark, tmp_path, parts):
    folder = tmp_path / "in"
    folder.mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    for rows in parts:
        rows.coalesce(1).write.mode("append").parquet(str(folder))
        out = ingest.session_segments(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        out.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    return spark.read.schema("trader_id long, coin string, direction string, start timestamp, n long, hours double").parquet(str(tmp_path / "out"))


def test_segments_equal_the_batch_query(spark, tmp_path):
    rng = random.Random(5)
    # the given positions closer together, so that segments have several rows
    own = view(spark, SF, "positions_v").select(F.col("trader_id").cast("long").alias("trader_id"), "coin", "direction", "us")
    rows = [(r.trader_id % 5, r.coin, r.direction, r.us // 20) for r in own.collect()]
    rows.sort(key=lambda r: r[3] + rng.randrange(600_000_000))  # at most ten minutes out of order
    make = lambda part: spark.createDataFrame(part, "trader_id long, coin string, direction string, us long").select("trader_id", "coin", "direction", F.timestamp_micros("us").alias("ts"))
    end = max(r[3] for r in rows) + 10 * 3_600_000_000
    third = len(rows) // 3
    cuts = [rows[:third], rows[third : 2 * third], rows[2 * third :]]
    got = segments(spark, tmp_path, [*map(make, cuts), make([(-1, "end", "x", end)]), make([(-1, "end", "x", end + 1)])])
    by = {}
    for t, c, d, us in sorted(rows):
        by.setdefault((t, c, d), []).append(us)
    want = []
    for key, times in by.items():
        held = [times[0]]
        for a, b in zip(times, [*times[1:], None], strict=True):
            if b is None or b - a > 45 * 60_000_000:
                want.append((*key, held[0], len(held), (held[-1] - held[0]) // 1_000_000 / 3600))
                held = []
            held.append(b)
    shown = got.where("trader_id >= 0").select("trader_id", "coin", "direction", F.unix_micros("start").alias("start"), "n", "hours")
    assert sorted(map(tuple, shown.collect())) == sorted(want)
    assert any(n > 1 for *_, n, _ in want) and len(want) > 50


def test_a_row_at_the_gap_stays_and_one_after_it_starts_anew(spark, tmp_path):
    at = [0, 45 * 60_000_000, 90 * 60_000_000 + 1]
    rows = spark.createDataFrame([(1, "c", "long", us) for us in at] + [(1, "c", "long", None), (2, "c", "long", 10**12)], "trader_id long, coin string, direction string, us long")
    parts = [rows.select("trader_id", "coin", "direction", F.timestamp_micros("us").alias("ts"))]
    tick = spark.createDataFrame([(3, "c", "long", 2 * 10**12)], "trader_id long, coin string, direction string, us long").select("trader_id", "coin", "direction", F.timestamp_micros("us").alias("ts"))
    got = segments(spark, tmp_path, [*parts, tick])
    assert sorted((r.trader_id, r.n, r.hours) for r in got.collect()) == [(1, 1, 0.0), (1, 2, 0.75), (2, 1, 0.0)]


def test_the_batch_query_has_the_same_gap(spark):
    """The stream's rule is the query's: over the same rows both give as many segments."""
    batch = QUERIES["win_gap_sessionize"](spark, SF)
    rows = view(spark, SF, "positions_v").select("trader_id", "coin", "direction", F.timestamp_micros("us").alias("ts"))
    once = ingest.session_segments(rows)
    assert sorted((r.trader_id, r.coin, r.direction, r.n, r.hours) for r in once.collect()) == sorted((r.trader_id, r.coin, r.direction, r.n, r.hours) for r in batch.collect())
