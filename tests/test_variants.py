"""Wire variants by one parse, with answers by hand."""

import json

from tapewise.sources import variants


def line(channel, data=None):
    return json.dumps({"channel": channel} | ({} if data is None else {"data": data}))


def test_every_variant(spark):
    trade = {"coin": "BTC", "side": "B", "px": "10.5", "sz": 2, "users": ["0xA", "0xB"]}
    rows = {
        "subscriptionResponse": [line("subscriptionResponse", {"method": "subscribe"})],
        "allMids": [line("allMids", {"mids": {"BTC": "1.5", "ETH": "x"}}), line("allMids", {"BTC": "2"})],
        "activeAssetCtx": [line("activeAssetCtx", {"coin": "SOL", "ctx": {"midPx": None, "markPx": "3"}})],
        "trades": [line("trades", [trade, trade | {"side": "A", "px": "oops"}]), line("trades", []), line("trades", None)],
        "userFills": [line("userFills", {"user": "0xC", "isSnapshot": True, "fills": [{"coin": "BTC", "side": "?", "px": 1, "sz": "1"}]})],
        "clearinghouseState": [line("clearinghouseState", {"user": "0xD", "clearinghouseState": {"marginSummary": {"accountValue": "9"}, "assetPositions": [{"position": {"coin": "BTC", "szi": "-2", "entryPx": "5"}}]}}), line("clearinghouseState", {"user": "0xE", "clearinghouseState": {}})],
        "user.liquidation": [line("user", {"liquidation": {"liquidated_user": "0xF", "liquidated_ntl_pos": "7"}})],
        "user.funding": [line("user", {"funding": {"coin": "BTC", "usdc": "-1"}})],
        "user.fills": [line("user", {"fills": []})],
        "user.nonUserCancel": [line("user", {"nonUserCancel": [{"coin": "BTC", "oid": 5}, {"coin": "ETH"}]})],
        "pong": [line("pong")],
        "error": [line("error", "slow down")],
        "unknown": [line("user", {"other": 1}), line("l2Book", {}), line("user", None)],
        "invalid": ["{broken", "", None, "[]", "7", json.dumps({"data": 1})],
    }
    df = spark.createDataFrame([(k, x) for k, xs in rows.items() for x in xs], "want string, value string")
    got = variants.parsed(df)
    assert got.where("want <> variant").collect() == []
    out = sorted((tuple(r) for r in variants.records(got).select("variant", "kind", "wallet", "coin", "side", "size", "price", "malformed").collect()), key=str)
    assert out == sorted(
        [
            ("allMids", "market", None, "BTC", None, None, 1.5, False),
            ("allMids", "market", None, "ETH", None, None, None, True),
            ("allMids", "market", None, "BTC", None, None, 2.0, False),
            ("activeAssetCtx", "market", None, "SOL", None, None, 3.0, False),
            ("trades", "trade", "0xa", "BTC", "buy", 2.0, 10.5, False),
            ("trades", "trade", "0xa", "BTC", "sell", 2.0, None, True),
            ("userFills", "fill", "0xc", "BTC", None, 1.0, 1.0, False),
            ("clearinghouseState", "pnl", "0xd", None, None, None, 9.0, False),
            ("clearinghouseState", "position", "0xd", "BTC", "short", 2.0, 5.0, False),
            ("clearinghouseState", "pnl", "0xe", None, None, None, None, True),
            ("user.liquidation", "liquidation", "0xf", None, None, None, 7.0, False),
            ("user.funding", "funding", None, "BTC", None, -1.0, None, False),
            ("user.nonUserCancel", "cancel", None, "BTC", None, None, None, False),
            ("user.nonUserCancel", "cancel", None, "ETH", None, None, None, True),
        ],
        key=str,
    )


def test_a_line_is_parsed_once(spark):
    df = spark.createDataFrame([("{}",)], "value string").repartition(1)
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = variants.records(variants.parsed(df))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)
    assert plan.lower().count("parsejson") == 1
