"""Copyability of wallets against the rules folded in plain Python, and against its SQL."""

import datetime as dt
import math
import random
import statistics
from collections import deque

import duckdb
import pytest

from tapewise.operators.fifo import residual_lots, round_trips
from tapewise.plans.dialect import view
from tapewise.plans.registry import ORACLE_SQL, QUERIES

LINES = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
FLAGS = {"open long": ("A", "F"), "close long": ("R", "F"), "open short": ("N", "O"), "close short": ("N", "F")}
#: Wallets: only opens, few exit days, no rate (trips far apart), one rate, ties, many trips.
UNSOLD, FEW, APART, ONCE, BUSY = 1, 2, 3, 4, (5, 6, 7)


def _tape():
    rng = random.Random(8)
    out = []

    def fill(wallet, day, what, size, price, coin=0):
        out.append((len(out), 1, coin, wallet, float(size), round(size * price, 2), 0.04, 0.06, *FLAGS[what], dt.datetime(1996, 1, 1) + dt.timedelta(days=day)))

    for wallet, days in ((UNSOLD, ()), (FEW, (3, 4, 5)), (APART, (40, 80, 120, 160)), (ONCE, (3, 4, 5, 6))):
        fill(wallet, 0, "open long", 10, 100.0)
        for i, day in enumerate(days):
            fill(wallet, day, "close long", 2, 120.0 - 15 * i)
        fill(wallet, 200, "open short", 3, 95.0)
    for wallet in BUSY:
        for _ in range(90):
            fill(wallet, rng.randrange(150), rng.choice([x for x in FLAGS for _ in range(2 if x.startswith("open") else 1)]), rng.randrange(1, 9), rng.uniform(80, 120), rng.randrange(3))
    return out


def _replay(fills):
    """Trips as (exit day, net, hours) and what the lots left over would gain."""
    key = lambda r: (r[10], f"{r[0]}-{r[1]}-{r[2]}-{int(r[4])}-{round(r[5] * 100)}")
    lots, trips, last = {}, [], {}
    for r in sorted(fills, key=key):
        size, price, day, fee, coin = r[4], r[5] / r[4], (r[10] - dt.datetime(1970, 1, 1)).days, r[5] * 0.00035, r[2] % 5
        last[coin] = price
        side = "long" if r[8] in "AR" else "short"
        own = lots.setdefault((coin, side), deque())
        if (r[8], r[9]) in (FLAGS["open long"], FLAGS["open short"]):
            own.append([size, price, day, fee, size])
            continue
        need, batch = size, []
        while need > 0 and own:
            lot = own[0]
            take = min(lot[0], need)
            gain = price * 0.9995 - lot[1] * 1.0005 if side == "long" else lot[1] * 0.9995 - price * 1.0005
            batch.append((day, gain * take - lot[3] * take / lot[4] - fee * take / size, (day - lot[2]) * 24.0))
            lot[0] -= take
            need -= take
            if not lot[0]:
                own.popleft()
        trips += batch if not need else []
    rest = sum(q * (last[coin] - px if side == "long" else px - last[coin]) for (coin, side), own in lots.items() for q, px, *_ in own)
    return trips, rest


def _stability(trips):
    if not trips:
        return 25.0
    days = sorted({d for d, _, _ in trips})
    if len(days) < 4:
        return 35.0
    rates = []
    for day in days:
        nets = [net for d, net, _ in trips if day - 30 <= d <= day]
        if len(nets) >= 4:
            rates.append(sum(x > 0 for x in nets) / len(nets))
    if len(rates) < 2:
        return max(20.0, 100 * (1 - (rates[0] if rates else 0.45)))
    return min(max(100 * (1 - statistics.pstdev(rates)), 0.0), 100.0)


def _timing(h):
    if h < 1:
        return 25 * h
    if h < 4:
        return 25 + 20 * (h - 1) / 3
    if h <= 48:
        return 92.0
    return max(25.0, 92 * (1 - (h - 48) / 120)) if h <= 168 else max(8.0, 25 * math.exp(-(h - 168) / 240))


def _wanted(rows):
    n, share, parts = {}, {}, {}
    for wallet in {r[3] for r in rows}:
        fills = [r for r in rows if r[3] == wallet]
        trips, rest = _replay(fills)
        net = sum(x for _, x, _ in trips)
        n[wallet] = len(fills)
        share[wallet] = round(net / (net + rest), 6) if abs(net + rest) > 1e-9 else 0.0
        parts[wallet] = _timing(statistics.mean(h for *_, h in trips) if trips else 12.0), _stability(trips)
    rank = lambda xs, w: 55.0 if len(xs) < 2 else 100 * sum(x <= xs[w] for x in xs.values()) / len(xs)
    out = {w: (rank(n, w), parts[w][0], rank(share, w), parts[w][1]) for w in n}
    return {w: (min(max(statistics.mean(x), 0.0), 100.0), *x) for w, x in out.items()}


COLUMNS = ["trader_id", "score", "frequency", "timing", "realized", "stability"]


def _write(spark, path, rows):
    spark.createDataFrame(rows, LINES).coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


@pytest.mark.parametrize("wallets", [(UNSOLD, FEW, APART, ONCE, *BUSY), (ONCE,)])
def test_the_whole_advisory(spark, tmp_path, wallets):
    rows = [r for r in _tape() if r[3] in wallets]
    path = _write(spark, tmp_path, rows)
    got = {r.trader_id: tuple(r)[1:] for r in QUERIES["p_copyability_advisory"](spark, path).select(COLUMNS).collect()}
    want = _wanted(rows)
    assert got == {w: pytest.approx(x, abs=6e-5) for w, x in want.items()}
    steady = {UNSOLD: 25.0, FEW: 35.0, APART: 55.0, ONCE: 50.0}
    assert {w: got[w][-1] for w in wallets if w in steady} == {w: x for w, x in steady.items() if w in wallets}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}/lineitem.parquet/*.parquet'")
    assert {r[0]: r[1:] for r in con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE_SQL['p_copyability_advisory']})").fetchall()} == got


def test_what_is_left_comes_with_the_trips(spark, tmp_path):
    fills = view(spark, _write(spark, tmp_path, _tape()), "tape_v")
    both = round_trips(fills, residual=True)
    left = {(r.trader_id, r.open_key): r.qty for r in both.where("exit_us IS NULL").collect()}
    assert left == {(r.trader_id, r.open_key): r.left for r in residual_lots(fills).collect()}
    assert left
    trips = lambda df: sorted((r.trader_id, r.open_key, r.close_key, r.qty) for r in df.collect())
    assert trips(both.where("exit_us IS NOT NULL")) == trips(round_trips(fills))
