"""All wire variants by one parse of a line into VARIANT.

A line's payload is told apart by its channel and, for user events, by the field
it has; records are then extracted with their types and arrays exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Channels and user events of the wire format.
CHANNELS = ("subscriptionResponse", "allMids", "activeAssetCtx", "trades", "userFills", "clearinghouseState", "pong", "error")
USER_EVENTS = ("liquidation", "funding", "fills", "nonUserCancel")

_RECORD = "struct<kind:string,wallet:string,coin:string,side:string,size:double,price:double,malformed:boolean>"


def parsed(lines: DataFrame, value: str = "value") -> DataFrame:
    """``lines`` without ``value``, with ``v``, the line as a variant, null where
    it isn't JSON, and ``variant``, what kind of message it is:

    a channel of ``CHANNELS``, ``user.`` and the first of ``USER_EVENTS`` that it
    has, ``unknown`` for anything else, ``invalid`` where there is no channel."""
    v = F.try_parse_json(value)
    rows = lines.withColumn("v", v).drop(value)
    channel = F.try_variant_get("v", "$.channel", "string")
    user = F.lit("unknown")
    for event in reversed(USER_EVENTS):
        user = F.when(F.try_variant_get("v", f"$.data.{event}", "variant").isNotNull(), f"user.{event}").otherwise(user)
    kind = F.when(channel.isNull(), "invalid").when(channel == "user", user).when(channel.isin(*CHANNELS), channel).otherwise("unknown")
    return rows.withColumn("variant", kind)


def _get(path: str, kind: str) -> Column:
    return F.try_variant_get("v", path, kind)


def _number(x: Column, path: str) -> Column:
    """A number that travels as text or as a number."""
    return F.try_variant_get(x, path, "string").try_cast("double")


def _text(x: Column, path: str) -> Column:
    return F.try_variant_get(x, path, "string")


def _record(kind: str, wallet: Column, coin: Column, side: Column, size: Column, price: Column, *needed: Column) -> Column:
    bad = F.lit(False)
    for n in needed:
        bad = bad | n.isNull()
    values = (F.lit(kind), F.lower(wallet), coin, side, size, price, bad)
    return F.struct(*(x.alias(n) for x, n in zip(values, ("kind", "wallet", "coin", "side", "size", "price", "malformed"), strict=True)))


def _fill(kind: str, wallet: Column):
    def one(f: Column) -> Column:
        size, price = _number(f, "$.sz"), _number(f, "$.px")
        side = F.when(_text(f, "$.side") == "B", "buy").when(_text(f, "$.side") == "A", "sell")
        return _record(kind, wallet if kind == "fill" else _text(f, "$.users[0]"), _text(f, "$.coin"), side, size, price, size, price)

    return one


def _position(x: Column) -> Column:
    size = _number(x, "$.position.szi")
    return _record("position", _get("$.data.user", "string"), _text(x, "$.position.coin"), F.when(size >= 0, "long").otherwise("short"), F.abs(size), _number(x, "$.position.entryPx"), size)


def records(rows: DataFrame) -> DataFrame:
    """A row for each typed record of ``parsed`` rows, with their other columns:
    kind, wallet, coin, side, size, price and malformed (a needed number that
    doesn't parse). Messages without records give none, as do nulls for arrays."""
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    variant = F.col("variant")
    ctx = F.coalesce(_get("$.data.ctx.midPx", "string"), _get("$.data.ctx.markPx", "string")).try_cast("double")
    mids = F.coalesce(_get("$.data.mids", "map<string,string>"), _get("$.data", "map<string,string>"))
    mid = lambda m: _record("market", text, m["key"], text, none, m["value"].try_cast("double"), m["value"].try_cast("double"))
    equity, liquidated, funding = (_get(p, "string").try_cast("double") for p in ("$.data.clearinghouseState.marginSummary.accountValue", "$.data.liquidation.liquidated_ntl_pos", "$.data.funding.usdc"))
    state = F.array(_record("pnl", _get("$.data.user", "string"), text, text, none, equity, equity))
    places = F.coalesce(F.transform(_get("$.data.clearinghouseState.assetPositions", "array<variant>"), _position), F.array().cast(f"array<{_RECORD}>"))
    cancel = lambda x: _record("cancel", text, _text(x, "$.coin"), text, none, none, _text(x, "$.oid"))
    out = (
        F.when(variant == "trades", F.transform(_get("$.data", "array<variant>"), _fill("trade", text)))
        .when(variant == "userFills", F.transform(_get("$.data.fills", "array<variant>"), _fill("fill", _get("$.data.user", "string"))))
        .when(variant == "user.fills", F.transform(_get("$.data.fills", "array<variant>"), _fill("fill", text)))
        .when(variant == "clearinghouseState", F.concat(state, places))
        .when(variant == "activeAssetCtx", F.array(_record("market", text, _get("$.data.coin", "string"), text, none, ctx, ctx)))
        .when(variant == "allMids", F.transform(F.map_entries(mids), mid))
        .when(variant == "user.liquidation", F.array(_record("liquidation", _get("$.data.liquidation.liquidated_user", "string"), text, text, none, liquidated, liquidated)))
        .when(variant == "user.funding", F.array(_record("funding", text, _get("$.data.funding.coin", "string"), text, funding, none, funding)))
        .when(variant == "user.nonUserCancel", F.transform(_get("$.data.nonUserCancel", "array<variant>"), cancel))
    )
    return rows.withColumn("r", F.explode(out)).drop("v").select("*", "r.*").drop("r")
