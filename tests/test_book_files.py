"""Hourly order-book files: plan, quota, quarantine and pulls that die."""

import json

import pytest

from tapewise.sources import orderbook, sinks


def snapshot(coin, ms, bid):
    level = lambda px: [{"px": str(px), "sz": "2", "n": 1}]
    return json.dumps({"data": {"coin": coin, "time": ms, "levels": [level(bid), level(bid + 1)]}})


def lines(spark, rows):
    return spark.createDataFrame(rows, "coin string, hour string, at long, value string")


def hours(spark, rows):
    return spark.createDataFrame(rows, "coin string, hour string")


@pytest.fixture
def files(spark, tmp_path):
    rows = [("A/é +", "20240101-00", i, snapshot("A", i, 10 + i)) for i in range(3)] + [("B", "20240101-00", 1, snapshot("B", 1, 5)), ("B", "20240101-01", 1, " "), ("B", "20240101-02", 1, "{bad"), ("B", "20240101-02", 2, snapshot("B", 9, 7)), (None, "20240101-00", 1, "x"), ("B", None, 1, "x")]
    path = f"file://{tmp_path}/files"
    orderbook.write_hours(lines(spark, rows), path)
    for hour, content in (("20240101-03", b"not lz4"), ("20240101-04", None)):
        folder = tmp_path / "files" / "coin=B"
        (folder / f"{hour}.lz4").write_bytes(content or (folder / "20240101-02.lz4").read_bytes()[:-20])
    return path


def test_what_is_there(spark, files, tmp_path):
    got = {(r.coin, r.hour): r.bytes for r in orderbook.list_hours(spark, files).collect()}
    assert set(got) == {("A/é +", "20240101-00"), *(("B", f"20240101-0{h}") for h in range(5))} and all(v > 0 for v in got.values())
    assert not list((tmp_path / "files").rglob("*.draft"))


def test_bad_files_give_no_lines(spark, files):
    got = orderbook.fetch(orderbook.list_hours(spark, files), files).collect()
    bad = {(r.coin, r.hour): r.error for r in got if r.error}
    assert set(bad) == {("B", "20240101-01"), ("B", "20240101-03"), ("B", "20240101-04")} and bad["B", "20240101-01"] == "empty"
    assert sorted((r.coin, r.hour) for r in got if not r.error) == [("A/é +", "20240101-00")] * 3 + [("B", "20240101-00")] + [("B", "20240101-02")] * 2


def test_pulls(spark, files, tmp_path, monkeypatch):
    cache = f"file://{tmp_path}/cache"
    wanted = hours(spark, [("A/é +", "20240101-00"), ("B", "20240101-00"), ("B", "20240101-02"), ("B", "20240101-03"), ("C", "20240101-00"), ("B", "20240101-00")])
    state = lambda p: {(r.coin[0], r.hour[-1]): r.state for r in p.collect()}
    assert state(orderbook.pull(wanted, files, cache, "1", cap_hours=1)) == {("A", "0"): "fetch", ("B", "0"): "later", ("B", "2"): "later", ("B", "3"): "later", ("C", "0"): "missing"}

    whole = sinks.save_batch

    def dies(tables, path, batch_id):
        whole({"metrics": tables["metrics"]}, path, batch_id)
        spark._jvm.java.io.File(f"{tmp_path}/cache/_complete/batch={batch_id}/_SUCCESS").delete()
        raise RuntimeError("lost")

    monkeypatch.setattr(sinks, "save_batch", dies)
    with pytest.raises(RuntimeError):
        orderbook.pull(wanted, files, cache, "2", cap_hours=None)
    monkeypatch.undo()
    assert sinks.complete_batches(spark, cache) == ["1"] and sinks.read_batches(spark, cache, "metrics", orderbook.METRICS).count() == 3
    assert state(orderbook.pull(wanted, files, cache, "2", cap_hours=None)) == {("A", "0"): "cached", ("B", "0"): "fetch", ("B", "2"): "fetch", ("B", "3"): "fetch", ("C", "0"): "missing"}
    held = sinks.read_batches(spark, cache, "metrics", orderbook.METRICS)
    assert sorted((r.coin[0], r.ms, r.best_bid, r.spread) for r in held.collect()) == [("A", 0, 10.0, 1.0), ("A", 1, 11.0, 1.0), ("A", 2, 12.0, 1.0), ("B", 1, 5.0, 1.0), ("B", 9, 7.0, 1.0)]
    assert state(orderbook.pull(wanted, files, cache, "3"))["B", "3"] == "fetch"  # in quarantine: tried again


def test_quota_is_a_running_sum(spark):
    rows = [(c, f"h{h}", 10 * h + (c == "b")) for h in range(1, 5) for c in "ab"]
    available = spark.createDataFrame(rows, "coin string, hour string, bytes long")
    wanted = available.unionAll(available)
    plan = lambda **k: orderbook.plan(wanted, hours(spark, [("a", "h2")]), available, **k)
    # bytes in order: a1 10, b1 11, (a2 cached), b2 21, a3 30, b3 31, ...
    got = {r.coin + r.hour[1]: r.state for r in plan(cap_hours=None, cap_bytes=100, used_bytes=28).collect()}
    assert sorted((k for k, v in got.items() if v == "fetch"), key=lambda k: k[::-1]) == ["a1", "b1", "b2", "a3"] and got["b3"] == "later" and got["a2"] == "cached"
    got = {r.coin + r.hour[1]: r.state for r in plan(cap_hours=2).collect()}
    assert sorted(k for k, v in got.items() if v == "fetch") == ["a1", "b1"]
    assert orderbook.preflight(plan(cap_hours=2), 184, 0) == (True, 184) and orderbook.preflight(plan(), 184, 1) == (False, 184)
    assert orderbook.preflight(plan().where("state = 'cached'"), 0, 5) == (True, 0)


def test_a_batch_saved_again_is_hidden_meanwhile(spark, tmp_path):
    df = spark.sql("SELECT 1 AS v")
    sinks.save_batch({"t": df}, str(tmp_path), "b1")
    sinks.save_batch({"t": df.unionAll(df)}, str(tmp_path), "b1")
    assert sinks.read_batches(spark, str(tmp_path), "t", "v int").count() == 2
    with pytest.raises(Exception):  # noqa: B017
        sinks.save_batch({"t": spark.sql("SELECT raise_error('x') AS v")}, str(tmp_path), "b1")
    assert sinks.read_batches(spark, str(tmp_path), "t", "v int").isEmpty() and sinks.complete_batches(spark, f"{tmp_path}/none") == []
