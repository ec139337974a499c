"""Newline-delimited wire envelopes ``{"channel": ..., "data": ...}`` to typed rows.

Numbers travel as strings and times as epoch milliseconds. A record with a
numeric field that doesn't parse is malformed and goes to the quarantine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TRADE = "array<struct<coin:string,side:string,px:string,sz:string,hash:string,time:bigint,tid:bigint,users:array<string>>>"
_FILLS = "struct<isSnapshot:boolean,user:string,fills:array<struct<coin:string,px:string,sz:string,side:string,time:bigint,startPosition:string,dir:string,closedPnl:string,hash:string,oid:bigint,crossed:boolean,fee:string,tid:bigint,feeToken:string>>>"
_STATE = "struct<user:string,time:bigint,clearinghouseState:struct<time:bigint,marginSummary:struct<accountValue:string>,assetPositions:array<struct<type:string,position:struct<coin:string,szi:string,entryPx:string,unrealizedPnl:string,leverage:struct<type:string,value:double>>>>>>"
_CTX = "struct<coin:string,ctx:struct<funding:string,openInterest:string,markPx:string,midPx:string>>"
_LIQ = "struct<liquidation:struct<lid:bigint,liquidator:string,liquidated_user:string,liquidated_ntl_pos:string,liquidated_account_value:string>>"
CHANNELS = ("trades", "userFills", "clearinghouseState", "activeAssetCtx", "allMids", "user")


def envelopes(lines: DataFrame) -> DataFrame:
    """``value`` lines as (channel, data, value); unreadable ones have no channel."""
    return lines.select("value", F.get_json_object("value", "$.channel").alias("channel"), F.get_json_object("value", "$.data").alias("data"))


def _num(x: Column) -> Column:
    return x.try_cast("double")


def _side(x: Column) -> Column:
    return F.when(x == "B", "buy").when(x == "A", "sell")


def _keep(rows: DataFrame, numbers: list[str]) -> DataFrame:
    bad = F.lit(False)
    for n in numbers:
        bad = bad | F.col(n).isNull()
    return rows.withColumn("malformed", bad)


def ticks(env: DataFrame) -> DataFrame:
    t = env.where(F.col("channel") == "trades").select(F.explode(F.from_json("data", _TRADE)).alias("t"))
    rows = t.select(F.concat_ws("|", F.lit("trade"), "t.coin", F.col("t.time").cast("string"), "t.hash", F.col("t.tid").cast("string")).alias("key"), "t.coin", _side(F.col("t.side")).alias("side"), _num(F.col("t.px")).alias("price"), _num(F.col("t.sz")).alias("size"), F.timestamp_millis("t.time").alias("ts"), F.col("t.tid").alias("trade_id"), F.lower(F.get("t.users", 0)).alias("buyer"), F.lower(F.get("t.users", 1)).alias("seller"))
    return _keep(rows, ["price", "size"])


def fills(env: DataFrame) -> DataFrame:
    t = env.where(F.col("channel") == "userFills").select(F.from_json("data", _FILLS).alias("d")).select(F.lower("d.user").alias("wallet"), F.explode("d.fills").alias("f"))
    key = F.concat_ws("|", F.lit("fill"), "wallet", "f.coin", "f.hash", F.col("f.tid").cast("string"), F.col("f.oid").cast("string"))
    rows = t.select(key.alias("key"), "wallet", "f.coin", _side(F.col("f.side")).alias("side"), _num(F.col("f.px")).alias("price"), _num(F.col("f.sz")).alias("size"), F.timestamp_millis("f.time").alias("ts"), F.col("f.dir").alias("fill_dir"), _num(F.col("f.closedPnl")).alias("closed_pnl_usd"), _num(F.col("f.fee")).alias("fee_usd"))
    return _keep(rows, ["price", "size"])


def positions(env: DataFrame) -> DataFrame:
    t = env.where(F.col("channel") == "clearinghouseState").select(F.from_json("data", _STATE).alias("d")).select(F.lower("d.user").alias("wallet"), F.timestamp_millis("d.clearinghouseState.time").alias("ts"), F.explode("d.clearinghouseState.assetPositions").alias("a"))
    size = _num(F.col("a.position.szi"))
    rows = t.select("wallet", "ts", "a.position.coin", F.when(size >= 0, "long").otherwise("short").alias("direction"), F.abs(size).alias("size"), _num(F.col("a.position.entryPx")).alias("entry_price"), F.col("a.position.leverage.value").alias("leverage"), _num(F.col("a.position.unrealizedPnl")).alias("unrealized_pnl"))
    rows = rows.withColumn("key", F.concat_ws("|", F.lit("position"), "wallet", "coin", "direction", F.col("size").cast("string"), F.col("entry_price").cast("string")))
    return _keep(rows, ["size"])


def pnl(env: DataFrame) -> DataFrame:
    """One row a state: account value and the sum of unrealised results."""
    t = env.where(F.col("channel") == "clearinghouseState").select(F.from_json("data", _STATE).alias("d"))
    total = F.aggregate("d.clearinghouseState.assetPositions", F.lit(0.0), lambda a, x: a + F.coalesce(_num(x["position"]["unrealizedPnl"]), F.lit(0.0)))
    rows = t.select(F.lower("d.user").alias("wallet"), F.timestamp_millis("d.clearinghouseState.time").alias("ts"), _num(F.col("d.clearinghouseState.marginSummary.accountValue")).alias("equity"), total.alias("unrealized_pnl"))
    return _keep(rows, ["equity"])


def market(env: DataFrame) -> DataFrame:
    """Prices: of one asset's context (mid, else mark) and of all mids, which
    come with or without a ``mids`` level. Keys hold values and no time."""
    a = env.where(F.col("channel") == "activeAssetCtx").select(F.from_json("data", _CTX).alias("d"))
    one = a.select("d.coin", _num(F.coalesce("d.ctx.midPx", "d.ctx.markPx")).alias("price"), _num(F.col("d.ctx.funding")).alias("funding_rate"), _num(F.col("d.ctx.openInterest")).alias("open_interest"))
    m = env.where(F.col("channel") == "allMids").select(F.coalesce(F.get_json_object("data", "$.mids"), F.col("data")).alias("j"))
    mids = m.select(F.explode(F.from_json("j", "map<string,string>")).alias("coin", "p")).select("coin", _num(F.col("p")).alias("price"), F.lit(None).cast("double").alias("funding_rate"), F.lit(None).cast("double").alias("open_interest"))
    rows = one.unionByName(mids).withColumn("key", F.concat_ws("|", F.lit("market"), "coin", F.col("price").cast("string"), F.col("open_interest").cast("string")))
    return _keep(rows, ["price"])


def liquidations(env: DataFrame) -> DataFrame:
    t = env.where(F.col("channel") == "user").select(F.from_json("data", _LIQ).alias("d")).where("d.liquidation IS NOT NULL")
    rows = t.select(F.concat_ws("|", F.lit("liquidation"), F.col("d.liquidation.lid").cast("string")).alias("key"), F.col("d.liquidation.lid").alias("lid"), F.lower("d.liquidation.liquidated_user").alias("wallet"), _num(F.col("d.liquidation.liquidated_ntl_pos")).alias("notional"))
    return _keep(rows, ["notional"])


RECORDS = {"ticks": ticks, "fills": fills, "positions": positions, "pnl": pnl, "market": market, "liquidations": liquidations}


def _keyed(head: str, parts: list[Column], *numbers: Column) -> Column:
    """struct(key, malformed) of one record, its key as the typed rows have it."""
    bad = F.lit(False)
    for n in numbers:
        bad = bad | n.isNull()
    return F.struct(F.concat_ws("|", F.lit(head), *(p.cast("string") for p in parts)).alias("key"), bad.alias("malformed"))


def _position_key(wallet: Column, p: Column) -> Column:
    size = _num(p["szi"])
    side = F.when(size >= 0, "long").otherwise("short")
    return _keyed("position", [wallet, p["coin"], side, F.abs(size), _num(p["entryPx"])], size)


def _price_key(coin: Column, price: Column, interest: Column) -> Column:
    return _keyed("market", [coin, price, interest], price)


def record_keys(env: DataFrame) -> DataFrame:
    """(key, malformed) of every record of every channel, in one pass: a line is
    parsed once, by its own channel. An unreadable line is a row of nulls."""
    channel, data = F.col("channel"), F.col("data")
    d = {"userFills": F.from_json(data, _FILLS), "clearinghouseState": F.from_json(data, _STATE), "activeAssetCtx": F.from_json(data, _CTX), "user": F.from_json(data, _LIQ)}
    fill, state, ctx, liq = d["userFills"], d["clearinghouseState"], d["activeAssetCtx"], d["user"]["liquidation"]
    wallet, inner, none = F.lower(state["user"]), state["clearinghouseState"], F.lit(None).cast("double")
    mids = F.from_json(F.coalesce(F.get_json_object(data, "$.mids"), data), "map<string,string>")
    unreadable = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("boolean").alias("malformed")))
    held = F.array(_keyed("pnl", [wallet, F.timestamp_millis(inner["time"])], _num(inner["marginSummary"]["accountValue"])))
    places = F.transform(inner["assetPositions"], lambda x: _position_key(wallet, x["position"]))
    rows = (
        F.when(channel == "trades", F.transform(F.from_json(data, _TRADE), lambda t: _keyed("trade", [t["coin"], t["time"], t["hash"], t["tid"]], _num(t["px"]), _num(t["sz"]))))
        .when(channel == "userFills", F.transform(fill["fills"], lambda f: _keyed("fill", [F.lower(fill["user"]), f["coin"], f["hash"], f["tid"], f["oid"]], _num(f["px"]), _num(f["sz"]))))
        .when(channel == "clearinghouseState", F.concat(held, F.coalesce(places, F.slice(held, 1, 0))))
        .when(channel == "activeAssetCtx", F.array(_price_key(ctx["coin"], _num(F.coalesce(ctx["ctx"]["midPx"], ctx["ctx"]["markPx"])), _num(ctx["ctx"]["openInterest"]))))
        .when(channel == "allMids", F.transform(F.map_entries(mids), lambda m: _price_key(m["key"], _num(m["value"]), none)))
        .when(channel == "user", F.when(liq.isNotNull(), F.array(_keyed("liquidation", [liq["lid"]], _num(liq["liquidated_ntl_pos"])))))
        .otherwise(unreadable)
    )
    return env.select(F.explode(rows).alias("r")).select("r.*")


def replay_counters(lines: DataFrame) -> DataFrame:
    """received, malformed, duplicates and ingested over all lines (one row)."""
    rows, bad = record_keys(envelopes(lines)), F.col("malformed")
    got = rows.agg(F.count("malformed").alias("received"), F.count_if(bad).alias("bad"), F.count_if(bad.isNull()).alias("unreadable"), F.count_if(~bad).alias("ok"), F.count_distinct(F.when(~bad, F.col("key"))).alias("ingested"))
    return got.select("received", (F.col("bad") + F.col("unreadable")).alias("malformed"), (F.col("ok") - F.col("ingested")).alias("duplicates"), "ingested")
