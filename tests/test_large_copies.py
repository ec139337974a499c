"""What only odd rows or larger tables showed: each query against its SQL on a small made-up folder."""

import datetime as dt
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tapewise.functions import kernels as k
from tapewise.operators.spans import first_passage, span_stats
from tapewise.plans import copy_sim, reports
from tapewise.plans.registry import ORACLE_SQL, QUERIES

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
START = dt.datetime(2024, 1, 3)


def folder(spark, path, rows):
    """Events of (event_id, minutes, user_id, coin, value)."""
    events = [(i, START + dt.timedelta(minutes=m), u, e, float(v), '{"k": 1}') for i, m, u, e, v in rows]
    spark.createDataFrame(events, EVENTS).coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


def norm(row):
    return tuple(None if isinstance(v, float) and math.isnan(v) else v for v in row)


def both(spark, path, name):
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
    cur = con.execute(ORACLE_SQL[name])
    cols = [x[0] for x in cur.description]
    return sorted(map(norm, (tuple(r[c] for c in cols) for r in QUERIES[name](spark, path).collect())), key=repr), sorted(map(norm, cur.fetchall()), key=repr)


def test_a_day_of_no_notional(spark, tmp_path):
    rows = [(0, 0, 1, "view", 0.0), (3, 1500, 1, "view", 60.0), (4, 1, 2, "view", 0.0), (6, 1501, 2, "view", 40.0), (7, 2, 3, "view", 10.0), (9, 1502, 3, "view", 20.0)]
    mine, other = both(spark, folder(spark, tmp_path, rows), "agg_sharpe_daily_deploy")
    assert mine == other
    assert [r[1] is None for r in mine].count(True) == 2


def test_a_sale_without_a_later_price(spark, tmp_path):
    rows = [(0, 0, 1, "view", 10.0), (1, 5, 1, "view", 20.0), (2, 90, 1, "view", 30.0), (3, 100, 1, "view", 40.0)]
    mine, other = both(spark, folder(spark, tmp_path, rows), "jn_asof_forward_frame")
    assert mine == other
    assert dict(mine)[3] == 390_000.0


#: Eight prices each; as doubles, their sums make means just below halves of the last place.
HALF = {2: [31.22, 79.46, 23.31, 69.19, 32.83, 20.51, 30.45, 6.19], 4: [58.27, 54.21, 14.99, 39.0, 18.36, 14.14, 4.24, 16.48]}


@pytest.mark.parametrize(("name", "digits"), [("win_peer_percentile", 2), ("win_percentile_midrank", 2), ("win_rank_order", 4)])
def test_means_are_exact(spark, tmp_path, name, digits):
    mean = sum(round(v * 100) for v in HALF[digits]) / 800
    even = math.floor(mean * 10**digits + 0.5) / 10**digits
    rows = [(i, i, 1, "view", v) for i, v in enumerate(HALF[digits])] + [(20, 20, 0, "view", even), (21, 21, 2, "view", 1.0)]
    got = {r[0]: r[1] for r in QUERIES[name](spark, folder(spark, tmp_path, rows)).select("trader_id", "pct" if digits == 2 else "position").collect()}
    assert got == {"win_peer_percentile": {0: 100.0, 1: 100.0, 2: 33.333333}, "win_percentile_midrank": {0: 75.0, 1: 75.0, 2: 0.0}, "win_rank_order": {0: 1, 1: 2, 2: 3}}[name]


def test_rounding_is_that_of_duckdb(spark):
    rng = random.Random(3)
    xs = [1.005, 2.675, -1.005, 0.285, 1e305, -0.00005, float("inf")] + [rng.randrange(10**7) / 1e5 + 5e-5 for _ in range(500)] + [rng.randrange(10**9) * 1.953125 / 2 for _ in range(200)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    con = duckdb.connect()
    for n in (2, 4):
        mine = [r[0] for r in df.select(k.rounded("x", n)).collect()]
        assert mine == [con.execute(f"SELECT ROUND(?::DOUBLE, {n})", [x]).fetchone()[0] for x in xs]


def _walk(n, hours):
    rng = random.Random(5)
    return [(["a", "b"][i % 2], rng.randrange(hours * 3_600_000_000), float(rng.randrange(-3, 100))) for i in range(n)]


def test_spans_match_nested_loops(spark):
    """Spans that start and end on bounds, hold nothing, or hit at once, late or never."""
    rows = _walk(1500, 30)
    hour = 3_600_000_000
    spans = [(i, ["a", "b", "c"][i % 3], a, a + w * hour, up) for i, (a, w, up) in enumerate((random.Random(i).choice([0, i * hour // 4, 7 * hour, 29 * hour + 1]), 1 + i % 5, [50.0, 95.0, 98.5, 200.0][i % 4]) for i in range(60))]
    left = spark.createDataFrame(spans, "i int, k string, a long, b long, up double")
    right = spark.createDataFrame(rows, "k string, t long, v double")
    hit = lambda v: (v >= F.col("up")) | (v <= F.lit(-3.0))
    stats = {r["i"]: tuple(r)[1:] for r in span_stats(left, right, "k", "t", "a", "b", "v", ["i"]).collect()}
    found = {r["i"]: tuple(r)[1:] for r in first_passage(left, right, "k", "t", "a", "b", "v", hit, ["i"]).collect()}
    for i, key, a, b, up in spans:
        own = sorted((t, v) for x, t, v in rows if x == key and a <= t <= b)
        assert stats[i] == ((len(own), min(v for _, v in own), max(v for _, v in own), *own[-1]) if own else (0, None, None, None, None))
        first = [(t, v) for t, v in own if v >= up or v <= -3.0]
        assert found.get(i) == (first[0] if first else None)


@pytest.mark.parametrize("name", ["jn_range_window", "win_first_passage", "jn_client_hash_attach", "p_signal_outcomes", "p_strategy_replay"])
def test_spans_of_queries(spark, tmp_path, name):
    """One busy coin: the market's rows meet no signal one by one, but by buckets."""
    rng = random.Random(9)
    rows = [(i, i * 0.9 + rng.random() / 2, i % 7, "view" if i % 50 else "error", round(rng.expovariate(0.02), 2)) for i in range(1500)]
    mine, other = both(spark, folder(spark, tmp_path, rows), name)
    assert mine == other
    assert mine


def test_sums_beyond_doubles_as_text(spark):
    rows = [(1.5,), (float("inf"),), (float("-inf"),), (float("nan"),)]
    df = spark.createDataFrame(rows, "x double").select("x", reports._scientific(F.col("x")))
    assert [r[1] for r in df.collect()] == ["1.500000e+00", "inf", "-inf", "-nan"]


@pytest.mark.parametrize(("name", "scans"), [("p_slippage_models", 1), ("p_benchmarks", 3), ("p_copyability_advisory", 0)])
def test_the_tape_is_matched_once(spark, name, scans):
    """Trips for three models, for two simulations, or before ranks: one pass over the fills each."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.split("+- == Initial Plan ==")[0].count("lineitem.parquet") == scans


def test_folds_stream_over_batches(spark):
    """A wallet whose trips span several Arrow batches is folded in one go, in order."""
    rng = random.Random(2)
    rows = [(i % 3, rng.randrange(50), f"o{i}", f"c{i}", rng.random() * 1e4, rng.random() - 0.5 if i % 11 else None) for i in range(300)]
    schema = "trader_id long, exit_us long, open_key string, close_key string, notional double, ret double"
    df = spark.createDataFrame(rows, schema)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["trader_id"]: r.asDict() for r in copy_sim.simulate(df.fillna(0.0), copy_sim._dynamic, copy_sim.DYNAMIC, copy_sim._TRIP, copy_sim._TRIP_ORDER).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pdf = df.fillna(0.0).toPandas()
    for who, own in pdf.groupby("trader_id"):
        assert got[who] == {"trader_id": who, **copy_sim.fold_dynamic(own, copy_sim.CopyConfig())}


def test_back_at_the_peak_is_not_under_water(spark, tmp_path):
    """Gains that cancel out: as doubles, added one by one, they end just below the peak
    (in DuckDB that depends on where a trader's rows lie among others', so the answer is
    by hand). The other trader's equity stays below 0."""
    first = [195.2, 191.59]
    then = [63.36, 12.02, 35.57, 20.44, 26.08, 84.68, 4.5, 76.31, 46.88, 5.22, 90.26, 4.27, 19.57, 54.69, 88.07, 63.1, 49.38, 155.6]
    rows = [(i, i, 1, "view", v) for i, v in enumerate(first)] + [(10 + i, 1500 + i, 1, "view", v) for i, v in enumerate(then)]
    rows += [(100 + i, 1440 * i, 2, "click", v) for i, v in enumerate([-11950.0, 550.0, 1050.0, 60.0])]
    mine, other = both(spark, folder(spark, tmp_path, rows), "k_spec_pillars")
    assert mine[1] == other[1]
    assert mine[0][:4] == (1, 0, 2, 0)


def test_equity_without_a_decimal(spark, tmp_path):
    """A value that no decimal holds doesn't stop the query, and leaves earlier days as they were."""
    rows = [(i, 1440 * i, u, "view", v) for u, own in ((1, [60.0, math.nan, 70.0]), (2, [60.0, 1e19, 70.0])) for i, v in enumerate(own)]
    got = {r["trader_id"]: r["active_days"] for r in QUERIES["k_spec_pillars"](spark, folder(spark, tmp_path, rows)).collect()}
    assert got == {1: 3, 2: 3}


def test_market_rows_of_one_time(spark, tmp_path):
    """Forward the first event of a time counts, backward the last, as in DuckDB where it
    joins by sorting (but for few left rows and, now and then, between sorted blocks)."""
    rows = [(0, 0, 1, "view", 100.0), (1, 61, 1, "view", 110.0), (2, 61, 1, "view", 120.0), (3, 75, 1, "view", 130.0), (4, 75, 1, "view", 125.0), (5, 95, 1, "view", 90.0)]
    path = folder(spark, tmp_path, rows)
    got = lambda name, key, x: {r[key]: r[x] for r in QUERIES[name](spark, path).collect()}
    outcomes = {(r.signal_id, r.horizon): r.bps for r in QUERIES["p_signal_outcomes"](spark, path).collect()}
    assert outcomes[0, 60] == 1000.0
    assert got("jn_asof_forward", "event_id", "m_price")[0] == 110.0
    assert got("jn_asof_backward_lag", "event_id", "m_price")[5] == 125.0
    assert got("jn_asof_forward_frame", "event_id", "edge")[0] == 1000.0
