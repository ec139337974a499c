import json

import pytest
from pyspark.sql import functions as F

from tapewise.operators import snapshots
from tapewise.sources import envelopes, lake, orderbook
from tapewise.streaming import ingest


def text(spark, rows):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "value string")


TRADES = {"channel": "trades", "data": [{"coin": "BTC", "side": "B", "px": "100.5", "sz": "2", "hash": "0x1", "time": 1_700_000_000_000, "tid": i, "users": ["0xA", "0xB"]} for i in (101, 102)]}
FILLS = {"channel": "userFills", "data": {"isSnapshot": True, "user": "0xAB", "fills": [{"coin": "ETH", "px": "10", "sz": "1", "side": "A", "time": 1_700_000_000_000, "dir": "Open Short", "closedPnl": "0", "hash": "0x2", "oid": 7, "fee": "0.1", "tid": t} for t in (1, 2)]}}


def test_records(spark):
    rows = [TRADES, FILLS, {"channel": "allMids", "data": {"mids": {"A": "1", "B": "2", "C": "3"}}}, {"channel": "activeAssetCtx", "data": {"coin": "BTC", "ctx": {"funding": "0.1", "openInterest": "5", "markPx": "9", "midPx": None}}}, {"channel": "user", "data": {"liquidation": {"lid": 991337, "liquidated_user": "0xC", "liquidated_ntl_pos": "5"}}}]
    env = envelopes.envelopes(text(spark, rows))
    ticks = envelopes.ticks(env).collect()
    assert {t.trade_id for t in ticks} == {101, 102} and ticks[0].buyer == "0xa" and ticks[0].side == "buy"
    fills = envelopes.fills(env).collect()
    assert {f.wallet for f in fills} == {"0xab"} and all(f.key.startswith("fill|0xab|") for f in fills)
    assert {(m.coin, m.price) for m in envelopes.market(env).collect()} == {("A", 1.0), ("B", 2.0), ("C", 3.0), ("BTC", 9.0)}
    assert [x.lid for x in envelopes.liquidations(env).collect()] == [991337]


def test_state_rows(spark):
    state = {"channel": "clearinghouseState", "data": {"user": "0xZ", "clearinghouseState": {"time": 1, "marginSummary": {"accountValue": "50"}, "assetPositions": [{"type": "x", "position": {"coin": "BTC", "szi": s, "entryPx": "1", "unrealizedPnl": "2.5", "leverage": {"type": "c", "value": 3}}} for s in ("-2", "4")]}}}
    env = envelopes.envelopes(text(spark, [state]))
    assert {(p.direction, p.size) for p in envelopes.positions(env).collect()} == {("short", 2.0), ("long", 4.0)}
    assert [(p.equity, p.unrealized_pnl) for p in envelopes.pnl(env).collect()] == [(50.0, 5.0)]


def test_replay_is_idempotent_and_counts_bad_lines(spark):
    bad = {"channel": "trades", "data": [{**TRADES["data"][0], "px": "oops"}]}
    row = envelopes.replay_counters(text(spark, [FILLS, FILLS, bad, "not json"])).first()
    assert (row.ingested, row.duplicates, row.malformed) == (2, 2, 2)


def test_books(spark):
    level = [[{"px": "9", "sz": "1", "n": 1}], [{"px": "11", "sz": "2", "n": 1}]]
    snap = {"data": {"coin": "BTC", "time": 5, "levels": level}}
    rows = [snap, [snap, snap], {"raw": json.dumps(snap)}, "broken", "", {"data": {"coin": "X", "time": 1, "levels": [[], []]}}]
    out = orderbook.metrics(orderbook.snapshots(text(spark, rows))).collect()
    assert sum(r.coin == "BTC" and r.spread == 2.0 and r.bid_depth == 1.0 for r in out) == 4
    assert [r.best_bid for r in out if r.coin == "X"] == [None]


def test_book_plan_caps_fetches(spark):
    hours = lambda xs: spark.createDataFrame([("BTC", h) for h in xs], "coin string, hour int")
    out = {r.hour: r.state for r in orderbook.plan(hours([1, 2, 3, 4]), hours([1]), hours([2, 3]), cap_hours=1).collect()}
    assert out == {1: "cached", 2: "fetch", 3: "later", 4: "missing"}


def test_lake_prunes_and_replaces_days(spark, tmp_path):
    df = spark.sql("SELECT id, timestamp'2024-01-30 12:00:00' + make_dt_interval(CAST(id AS INT)) AS ts FROM range(4)")
    path = str(tmp_path / "lake")
    lake.write_days(df, path)
    assert lake.read_days(spark, path, 2024, 1).count() == 2
    lake.write_days(df.where("id = 0"), path, mode="overwrite")
    assert spark.read.parquet(path).count() == 4
    with pytest.raises(ValueError, match="hash"):
        lake.require(df, "fills")


def test_stream_deduplicates_and_merges(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(FILLS) + "\n")
    rows = ingest.fills_stream(spark, str(tmp_path / "in"))
    out = str(tmp_path / "fills")
    q = ingest.start_merge(ingest.deduplicated(rows), out, str(tmp_path / "cp"), ["key"], ["ts"])
    q.awaitTermination(120)
    assert snapshots.read(spark, out).count() == 2


def test_stream_windows(spark, tmp_path):
    (tmp_path / "p").mkdir()
    spark.sql("SELECT timestamp_seconds(1700000000 + id * 60) AS ts, 'BTC' AS coin, 'long' AS direction, CAST(id % 3 AS STRING) AS wallet FROM range(20)").write.mode("overwrite").parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema("ts timestamp, coin string, direction string, wallet string").parquet(str(tmp_path / "p"))
    q = ingest.consensus_windows(stream).writeStream.outputMode("update").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").selectExpr("sum(entries)").first()[0] == 20


def test_stream_windows_count_wallets_exactly(spark, tmp_path):
    spark.sql("SELECT timestamp_seconds(1700000100) AS ts, 'BTC' AS coin, 'long' AS direction, concat('w', id % 5000) AS wallet FROM range(10000)").write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema("ts timestamp, coin string, direction string, wallet string").parquet(str(tmp_path / "p"))
    q = ingest.consensus_windows(stream).writeStream.outputMode("update").format("memory").queryName("exact").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.wallets, r.entries) for r in spark.table("exact").collect()] == [(5000, 10000)]


def test_pages_retry_and_drop_only_rows_of_earlier_pages():
    from tapewise.sources import rest

    waits, calls = [], []

    def fetch(start, end):
        calls.append(start)
        if len(calls) == 1:
            raise rest.Retryable
        rows = [{"hash": "a", "time": 1}, {"hash": "a", "time": 1}, {"hash": "b", "time": 2}] if start < 2 else [{"hash": "b", "time": 2}, {"hash": "c", "time": 3}]
        return rows

    got = [r["hash"] for r in rest.pages(fetch, 0, 9, 3, sleep=waits.append)]
    assert got == ["a", "a", "b", "c"] and waits == [1.0]
    with pytest.raises(rest.Retryable):
        rest.call(lambda: (_ for _ in ()).throw(rest.Retryable()), tries=2, sleep=waits.append)


def test_pages_pass_a_full_time_and_keep_rows_without_hash():
    from tapewise.sources import rest

    def paged(rows):
        return [r["n"] for r in rest.pages(lambda start, end: [r for r in rows if start <= r["time"] <= end][:3], 0, 99, 3)]

    row = lambda n, t, h: {"n": n, "time": t, "hash": h}
    assert paged([row(0, 1, "a"), row(1, 5, "b"), row(2, 5, "c"), row(3, 5, "d"), row(4, 9, "e")]) == [0, 1, 2, 3, 4]
    assert paged([row(0, 1, "a"), row(1, 1, "a"), row(2, 1, "a"), row(3, 2, "b")]) == [0, 1, 2, 3]
    assert paged([row(i, i // 2, None) for i in range(11)]) == list(range(11))


def test_posts_take_the_best_video(spark):
    from tapewise.sources import social

    media = [{"url": "i", "variants": [{"bitrate": b, "content_type": "video/mp4", "url": f"v{b}"} for b in (1, 9, 3)]}, {"url": "pic"}]
    rows = [[{"id": "1", "handle": "h", "text": "t", "created_at": "bad", "media": media}, {"handle": "none"}], [{"id": "1", "handle": "h"}]]
    got = social.posts(text(spark, rows).coalesce(1)).collect()
    assert len(got) == 1 and got[0].media in (["v9", "pic"], [])


def test_reports_and_batches(spark, tmp_path):
    from tapewise.sources import sinks

    df = spark.createDataFrame([("a", 1.5), (None, None)], "k string, v double")
    assert sinks.markdown(df).splitlines()[2:] == ["| a | 1.5000 |", "|  |  |"]
    sinks.save_batch({"runs": df}, str(tmp_path), "b1")
    assert spark.read.parquet(f"{tmp_path}/runs").count() == 2 and spark.read.parquet(f"{tmp_path}/_complete").count() == 1
    sinks.csv(df, f"{tmp_path}/csv")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/csv").count() == 2


def test_keys_of_one_pass_are_those_of_the_typed_rows(spark):
    position = lambda size: {"type": "oneWay", "position": {"coin": "ETH", "szi": size, "entryPx": "3.5", "unrealizedPnl": "1", "leverage": {"type": "cross", "value": 2.0}}}
    state = {"channel": "clearinghouseState", "data": {"user": "0xQ", "clearinghouseState": {"time": 7, "marginSummary": {"accountValue": "x"}, "assetPositions": [position("-2"), position("bad")]}}}
    lines = [TRADES, FILLS, state, {"channel": "clearinghouseState", "data": {"user": "0xR"}}, {"channel": "activeAssetCtx", "data": {"coin": "BTC", "ctx": {"markPx": "9", "openInterest": "4"}}}, {"channel": "allMids", "data": {"mids": {"A": "1", "B": "?"}}}, {"channel": "allMids", "data": {"C": "3"}}]
    lines += [{"channel": "user", "data": {"liquidation": {"lid": 5, "liquidated_ntl_pos": "1"}}}, {"channel": "user", "data": {"fills": []}}, {"channel": "elsewhere", "data": 1}, "not json"]
    env = envelopes.envelopes(text(spark, lines))
    got = sorted((r.key, r.malformed) for r in envelopes.record_keys(env).where("malformed IS NOT NULL").collect())
    want = []
    for name, of in envelopes.RECORDS.items():
        rows = of(env)
        key = rows.key if name != "pnl" else F.concat_ws("|", F.lit("pnl"), "wallet", rows.ts.cast("string"))
        want += [(r.key, r.malformed) for r in rows.select(key.alias("key"), "malformed").collect()]
    assert got == sorted(want) and len(got) > 10
    assert envelopes.record_keys(env).where("malformed IS NULL").count() == 2
