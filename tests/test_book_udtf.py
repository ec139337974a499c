"""Order-book lines through the table function."""

import json

from tapewise.sources import book_udtf, orderbook


def test_levels(spark):
    level = lambda px, sz="1": {"px": px, "sz": sz, "n": 2}
    book = lambda ms, *sides: {"coin": "A", "time": ms, "levels": sides}
    rows = [{"data": book(1, [level("10"), level("9")], [level("11", "bad")])}, [book(2, [], []), book(3, [], [level("5")])], {"raw": json.dumps({"data": book(4, [level("7")], [])})}, {"coin": "A"}, 5]
    lines = [json.dumps(r) for r in rows] + ["{bad", " ", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    book_udtf.register(spark)
    got = spark.sql("SELECT i, b.* FROM {df}, LATERAL book_levels(value) b", df=df).collect()
    good = sorted((r.ms, r.side or "", r.level or 0, r.px, r.sz) for r in got if r.error is None)
    assert good == [(1, "ask", 1, 11.0, None), (1, "bid", 1, 10.0, 1.0), (1, "bid", 2, 9.0, 1.0), (2, "", 0, None, None), (3, "ask", 1, 5.0, 1.0), (4, "bid", 1, 7.0, 1.0)]
    assert sorted((r.i, r.error) for r in got if r.error) == [(3, "KeyError"), (4, "AttributeError"), (5, "JSONDecodeError")]
    # the JVM's way gives the same best bids
    native = orderbook.metrics(orderbook.snapshots(df.select("value"))).collect()
    assert {r.ms: r.best_bid for r in native} == {1: 10.0, 2: None, 3: None, 4: 7.0}
    assert spark.sql("SELECT b.* FROM {df}, LATERAL book_levels(value) b", df=df.where("i < 0")).isEmpty()
