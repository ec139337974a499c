"""Signal states in a stream against the batch rule."""

import random

import pytest
from pyspark.sql import functions as F

from tapewise.plans.dialect import view
from tapewise.streaming import lifecycle

SF = "/root/testdata/sf0.001"


@pytest.fixture
def rocks(spark):
    name, store = lifecycle.STATE_STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, store)
    yield spark
    spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run(spark, tmp_path, parts, schema):
    """The changes after all parts arrived, a micro-batch each."""
    folder = tmp_path / "in"
    folder.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        q = lifecycle.signal_states(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(lifecycle.SCHEMA).parquet(str(tmp_path / "out"))


SCHEMA = "signal_id long, kind string, horizon int, ts timestamp"


@pytest.mark.parametrize("seed", [1, 2])
def test_states_equal_the_batch_rule(rocks, tmp_path, seed):
    """Signals of ``events`` in another order within the watermark, in two arrivals."""
    signals = view(rocks, SF, "signals_v").select("signal_id", "window_end").orderBy("window_end").collect()
    rng = random.Random(seed)
    at = lambda us: rocks.sql(f"SELECT timestamp_micros({us})").first()[0]
    rows = [(r.signal_id, "signal", None, r.window_end) for r in signals]
    resolved = {r.signal_id for r in signals if r.signal_id % 3 == 0}
    rows += [(i, "outcome", h, us + h * 60_000_000 - 1) for (i, _, _, us) in list(rows) if i in resolved for h in (60, 240)]
    last = max(us for *_, us in rows)
    rows = sorted(rows, key=lambda r: r[3] + rng.randrange(600_000_000))  # at most ten minutes out of order
    rows = [(i, k, h, at(us)) for i, k, h, us in rows]
    cut = len(rows) // 2
    got = run(rocks, tmp_path, [rows[:cut], rows[cut:], [(-1, "tick", None, at(last))]], SCHEMA)
    mark = last - 600_000_000
    rule = F.when(F.col("signal_id").isin(list(resolved)) & (F.col("window_end") + 240 * 60_000_000 - 1 <= last), "resolved").when(F.col("window_end") + 240 * 60_000_000 <= mark, "expired").otherwise("active")
    want = view(rocks, SF, "signals_v").select("signal_id", rule.alias("status"))
    assert sorted(map(tuple, lifecycle.latest_status(got).collect())) == sorted(map(tuple, want.collect()))
    assert got.groupBy("signal_id", "status").count().where("count > 1").isEmpty()


def test_odd_rows(rocks, tmp_path):
    at = lambda m: rocks.sql(f"SELECT TIMESTAMP '2024-01-01 00:00:00' + INTERVAL {m} MINUTE").first()[0]
    first = [(1, "signal", None, at(0)), (1, "signal", None, at(0)), (None, "signal", None, at(0)), (2, "signal", None, None), (3, "outcome", 60, at(5)), (3, "signal", None, at(1)), (4, "outcome", 240, at(9)), (4, "signal", None, at(2)), (5, "outcome", 240, at(3))]
    got = run(rocks, tmp_path, [first, [(9, "tick", None, at(2000))], [(9, "tick", None, at(2001))], [(1, "signal", None, at(0))]], SCHEMA)
    assert sorted((r.signal_id, r.status) for r in got.collect()) == [(1, "active"), (1, "expired"), (3, "active"), (3, "expired"), (4, "active"), (4, "resolved")]
