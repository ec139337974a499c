"""Source operators as queries: wire text is made from the tables, then parsed."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewise.plans.dialect import duck, view
from tapewise.session import shared_path
from tapewise.sources import book_udtf, envelopes, lake, orderbook, rest, sinks, social, variants

QUERIES = {}
ORACLE_SQL = {}


def _trade_lines(s: SparkSession, d: str) -> DataFrame:
    px = F.when(F.col("event_id") % 50 == 0, "oops").otherwise(F.col("price").cast("string"))
    trade = F.struct("coin", F.when(F.col("side") == "buy", "B").otherwise("A").alias("side"), px.alias("px"), F.col("size").cast("string").alias("sz"), F.lit("0x1").alias("hash"), F.floor(F.col("us") / 1000).alias("time"), F.col("event_id").alias("tid"), F.array(F.lit("0xA"), F.lit("0xB")).alias("users"))
    return view(s, d, "fills_v").select(F.to_json(F.struct(F.lit("trades").alias("channel"), F.array(trade).alias("data"))).alias("value"))


def src_ndjson_replay(s, d):
    """Counters of a replay of every trade sent twice."""
    lines = _trade_lines(s, d)
    return envelopes.replay_counters(lines.unionAll(lines))


QUERIES["src_ndjson_replay"] = src_ndjson_replay
ORACLE_SQL["src_ndjson_replay"] = duck("SELECT 2 * COUNT(*) AS received, 2 * COUNT(*) FILTER (WHERE event_id % 50 = 0) AS malformed, COUNT(*) FILTER (WHERE event_id % 50 <> 0) AS duplicates, COUNT(*) FILTER (WHERE event_id % 50 <> 0) AS ingested FROM fills_v")
QUERIES["agg_ingest_counters"] = lambda s, d: envelopes.replay_counters(_trade_lines(s, d))
ORACLE_SQL["agg_ingest_counters"] = duck("SELECT COUNT(*) AS received, COUNT(*) FILTER (WHERE event_id % 50 = 0) AS malformed, CAST(0 AS BIGINT) AS duplicates, COUNT(*) FILTER (WHERE event_id % 50 <> 0) AS ingested FROM fills_v")


def src_l2_parse(s, d):
    """Snapshots from JSON lines, some of them unreadable or without asks."""
    book = orderbook.metrics(orderbook.snapshots(_book_lines(s, d)))
    return book.select(F.col("ms").alias("event_id"), "coin", F.round("spread", 6).alias("spread"), "bid_depth")


def src_l2_levels(s, d):
    """Levels of the same lines by a table function in SQL, unreadable lines told."""
    book_udtf.register(s)
    lines = _book_lines(s, d)
    return s.sql("SELECT l.coin AS of_coin, b.* FROM {lines} l, LATERAL book_levels(l.value) b", lines=lines).groupBy("of_coin", "side", "level", "error").agg(F.count("*").alias("n_rows"), F.round(F.avg("px"), 6).alias("px"), F.sum("ms").alias("ids"))


def _book_lines(s: SparkSession, d: str) -> DataFrame:
    level = lambda px: F.array(F.struct(px.cast("string").alias("px"), F.lit("2").alias("sz"), F.lit(1).alias("n")))
    data = F.struct("coin", F.col("event_id").alias("time"), F.array(level(F.col("bid")), F.when(F.col("event_id") % 14 == 0, F.slice(level(F.col("ask")), 1, 0)).otherwise(level(F.col("ask")))).alias("levels"))
    line = F.when(F.col("event_id") % 20 == 0, "{broken").otherwise(F.to_json(F.struct(data.alias("data"))))
    return view(s, d, "book_v").select("coin", "us", line.alias("value"))


QUERIES["src_l2_parse"] = src_l2_parse
ORACLE_SQL["src_l2_parse"] = duck("SELECT event_id, coin, CASE WHEN event_id % 14 <> 0 THEN ROUND(ask - bid, 6) END AS spread, 2e0 AS bid_depth FROM book_v WHERE event_id % 20 <> 0")


QUERIES["src_l2_levels"] = src_l2_levels
ORACLE_SQL["src_l2_levels"] = duck("""SELECT coin AS of_coin, CASE WHEN event_id % 20 <> 0 THEN side END AS side, CASE WHEN event_id % 20 <> 0 THEN CAST(1 AS INTEGER) END AS level, CASE WHEN event_id % 20 = 0 THEN 'JSONDecodeError' END AS error, COUNT(*) AS n_rows,
ROUND(AVG(CASE WHEN event_id % 20 <> 0 THEN CASE side WHEN 'bid' THEN bid ELSE ask END END), 6) AS px, CAST(SUM(CASE WHEN event_id % 20 <> 0 THEN event_id END) AS BIGINT) AS ids
FROM book_v, (VALUES ('bid'), ('ask')) t(side) WHERE (event_id % 20 <> 0 AND (side = 'bid' OR event_id % 14 <> 0)) OR (event_id % 20 = 0 AND side = 'bid') GROUP BY ALL""")


def src_rest_paginated(s, d):
    """A paged service read by four time ranges."""
    s.dataSource.register(rest.PagedSource)
    rows = s.read.format("paged_fills").option("opener", "tapewise.sources.rest:demo").option("start", "0").option("end", "9999").option("ranges", "4").option("page_rows", "50").load()
    return rows.select("hash", "time")


QUERIES["src_rest_paginated"] = src_rest_paginated
ORACLE_SQL["src_rest_paginated"] = "SELECT '0x' || lower(to_hex(t)) AS hash, CAST(t AS BIGINT) AS time FROM range(0, 10000, 10) r(t)"


def src_tweets_parse(s, d):
    post = F.struct(F.when(F.col("event_id") % 10 != 0, F.col("event_id").cast("string")).alias("id"), F.lit("h").alias("handle"), F.col("event_type").alias("text"), F.lit("Mon Jan 01 00:00:00 +0000 2024").alias("created_at"))
    return social.posts(view(s, d, "ev_v").select(F.to_json(F.array(post)).alias("value"))).select("id", "text", F.col("created_at").isNotNull().alias("dated"))


QUERIES["src_tweets_parse"] = src_tweets_parse
ORACLE_SQL["src_tweets_parse"] = duck("SELECT CAST(event_id AS STRING) AS id, event_type AS text, TRUE AS dated FROM ev_v WHERE event_id % 10 <> 0")


def sink_replace_children(s, d):
    held = view(s, d, "fills_v").select((F.col("event_id") % 50).alias("signal_id"), "trader_id")
    new = held.where("trader_id % 2 = 0").withColumn("trader_id", F.col("trader_id") + 1000)
    return sinks.replace_children(held, held.where("signal_id < 10").select("signal_id").distinct(), new, "signal_id")


QUERIES["sink_replace_children"] = sink_replace_children
ORACLE_SQL["sink_replace_children"] = duck("SELECT event_id % 50 AS signal_id, trader_id FROM fills_v WHERE event_id % 50 >= 10 UNION ALL SELECT event_id % 50, trader_id + 1000 FROM fills_v WHERE event_id % 50 < 10 AND trader_id % 2 = 0")


def set_union_limit1(s, d):
    held = view(s, d, "traders_v").where("trader_id < 100").select("wallet", "trader_id")
    return sinks.upsert_ids(held, view(s, d, "traders_v"), "wallet", "trader_id")


QUERIES["set_union_limit1"] = set_union_limit1
ORACLE_SQL["set_union_limit1"] = duck("SELECT wallet, trader_id FROM traders_v WHERE trader_id < 100 UNION ALL SELECT wallet, (SELECT MAX(trader_id) FROM traders_v WHERE trader_id < 100) + ROW_NUMBER() OVER (ORDER BY wallet) FROM traders_v WHERE trader_id >= 100")


def _wire_lines(s: SparkSession, d: str) -> DataFrame:
    """(event_id, value): an event as one of 14 kinds of message, by its id; some unreadable."""
    text = lambda x: F.col(x).cast("string") if isinstance(x, str) else x.cast("string")
    wallet, px, n = F.concat(F.lit("0xW"), text("user_id")), F.col("value").cast("string"), F.col("event_id") % 3
    bad_px = F.when(F.col("event_id") % 5 == 0, "oops").otherwise(px)
    fill = lambda i: F.struct(F.col("event_type").alias("coin"), F.when(i % 2 == 0, "B").otherwise("A").alias("side"), F.when(i == 0, bad_px).otherwise(px).alias("px"), (i + 1).cast("string").alias("sz"), i.alias("tid"), F.array(wallet).alias("users"))
    fills = F.transform(F.sequence(F.lit(0).cast("long"), n), fill)
    position = lambda i: F.struct(F.lit("oneWay").alias("type"), F.struct(F.col("event_type").alias("coin"), (F.lit(1.5) - i).cast("string").alias("szi"), px.alias("entryPx")).alias("position"))
    state = F.struct(F.struct(px.alias("accountValue")).alias("marginSummary"), F.transform(F.sequence(F.lit(0).cast("long"), n), position).alias("assetPositions"))
    line = lambda channel, data: F.to_json(F.struct(F.lit(channel).alias("channel"), data.alias("data")))
    one = lambda name, x: F.struct(x.alias(name))
    mids = F.struct(px.alias("btc"), F.lit("7.5").alias("eth"))
    made = [
        line("subscriptionResponse", F.struct(F.lit("subscribe").alias("method"))),
        line("allMids", one("mids", mids)),
        line("allMids", mids),
        line("activeAssetCtx", F.struct(F.col("event_type").alias("coin"), F.struct(px.alias("markPx")).alias("ctx"))),
        line("trades", fills),
        line("userFills", F.struct(wallet.alias("user"), fills.alias("fills"))),
        line("clearinghouseState", F.struct(wallet.alias("user"), state.alias("clearinghouseState"))),
        line("user", one("liquidation", F.struct(wallet.alias("liquidated_user"), px.alias("liquidated_ntl_pos")))),
        line("user", one("funding", F.struct(F.col("event_type").alias("coin"), px.alias("usdc")))),
        line("user", one("fills", fills)),
        line("user", one("nonUserCancel", F.transform(F.sequence(F.lit(0).cast("long"), n), lambda i: F.struct(F.col("event_type").alias("coin"), i.alias("oid"))))),
        F.lit('{"channel":"pong"}'),
        line("error", F.lit("rate limited")),
        line("user", one("other", F.lit(1))),
    ]
    value = F.lit("{broken")
    for i, m in enumerate(made):
        value = F.when((F.col("event_id") % 14 == i) & (F.col("event_id") % 101 != 0), m).otherwise(value)
    return view(s, d, "ev_v").select("event_id", value.alias("value"))


def norm_envelope(s, d):
    """What kind of message each line is, by one parse."""
    return variants.parsed(_wire_lines(s, d)).groupBy("variant").agg(F.count("*").alias("messages"), F.sum("event_id").alias("ids"))


def norm_records(s, d):
    """Every typed record of every line."""
    return variants.records(variants.parsed(_wire_lines(s, d))).select("event_id", "kind", "wallet", "coin", "side", "size", "price", "malformed")


QUERIES["norm_envelope"], QUERIES["norm_records"] = norm_envelope, norm_records
_VARIANT = "CASE WHEN event_id % 101 = 0 THEN 'invalid' ELSE ['subscriptionResponse','allMids','allMids','activeAssetCtx','trades','userFills','clearinghouseState','user.liquidation','user.funding','user.fills','user.nonUserCancel','pong','error','unknown'][event_id % 14 + 1] END"
ORACLE_SQL["norm_envelope"] = duck(f"SELECT {_VARIANT} AS variant, COUNT(*) AS messages, CAST(SUM(event_id) AS BIGINT) AS ids FROM ev_v GROUP BY ALL")
ORACLE_SQL["norm_records"] = duck("""WITH e AS (SELECT *, event_id % 14 AS k, '0xw' || CAST(user_id AS VARCHAR) AS w FROM ev_v WHERE event_id % 101 <> 0),
x AS (SELECT e.*, i FROM e, generate_series(0, 2) g(i) WHERE i <= event_id % 3)
SELECT event_id, CASE k WHEN 4 THEN 'trade' ELSE 'fill' END AS kind, CASE WHEN k <> 9 THEN w END AS wallet, event_type AS coin, CASE WHEN i % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, CAST(i + 1 AS DOUBLE) AS size, CASE WHEN i = 0 AND event_id % 5 = 0 THEN NULL ELSE value END AS price, i = 0 AND event_id % 5 = 0 AS malformed FROM x WHERE k IN (4, 5, 9)
UNION ALL SELECT event_id, 'position', w, event_type, CASE WHEN i < 2 THEN 'long' ELSE 'short' END, ABS(1.5e0 - i), value, FALSE FROM x WHERE k = 6
UNION ALL SELECT event_id, 'pnl', w, NULL, NULL, NULL, value, FALSE FROM e WHERE k = 6
UNION ALL SELECT event_id, 'market', NULL, c, NULL, NULL, CASE c WHEN 'btc' THEN value ELSE 7.5e0 END, FALSE FROM e, (VALUES ('btc'), ('eth')) t(c) WHERE k IN (1, 2)
UNION ALL SELECT event_id, 'market', NULL, event_type, NULL, NULL, value, FALSE FROM e WHERE k = 3
UNION ALL SELECT event_id, 'liquidation', w, NULL, NULL, NULL, value, FALSE FROM e WHERE k = 7
UNION ALL SELECT event_id, 'funding', NULL, event_type, NULL, value, NULL, FALSE FROM e WHERE k = 8
UNION ALL SELECT event_id, 'cancel', NULL, event_type, NULL, NULL, NULL, FALSE FROM x WHERE k = 10""".replace("i < 2", "1.5e0 - i >= 0"))


def _lake(s: SparkSession, d: str) -> DataFrame:
    """All fills as a lake by day."""
    path = shared_path(s, "lake")
    lake.write_days(view(s, d, "fills_v"), path)
    return s.read.parquet(path)


def src_parquet_lake_pruned(s, d):
    """Fills of three days of the lake; other folders aren't listed."""
    return lake.between_days(_lake(s, d), date(2024, 1, 10), date(2024, 1, 12)).select("event_id", "trader_id", "coin", "price", "day")


def src_parquet_lake_dynamic(s, d):
    """Fills of the days on which an error reached a value of 99: the days are
    found at run time and prune the lake's folders."""
    days = view(s, d, "ev_v").where("event_type = 'error' AND value >= 99").select(F.year("ts").alias("year"), F.month("ts").alias("month"), F.dayofmonth("ts").alias("day"))
    return lake.on_days(_lake(s, d), days).select("event_id", "trader_id", "coin", "price", "day")


def src_parquet_bundle(s, d):
    """Three wallets from a bundle of all of them."""
    path = shared_path(s, "bundle")
    fills = view(s, d, "fills_v").join(view(s, d, "traders_v").select("trader_id", "wallet"), "trader_id").withColumn("timestamp", F.col("ts"))
    lake.write_bundle(fills, path)
    return lake.read_bundle(s, path, "w3", "w5", "w8").select("trader_id", "event_key", "coin", "us", "price", "size")


QUERIES |= {f.__name__: f for f in (src_parquet_lake_pruned, src_parquet_lake_dynamic, src_parquet_bundle)}
ORACLE_SQL["src_parquet_lake_pruned"] = duck("SELECT event_id, trader_id, coin, price, CAST(DAY(ts) AS INTEGER) AS day FROM fills_v WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-13 00:00:00'")
ORACLE_SQL["src_parquet_lake_dynamic"] = duck("SELECT event_id, trader_id, coin, price, CAST(DAY(ts) AS INTEGER) AS day FROM fills_v WHERE CAST(ts AS DATE) IN (SELECT CAST(ts AS DATE) FROM ev_v WHERE event_type = 'error' AND value >= 99)")
ORACLE_SQL["src_parquet_bundle"] = duck("SELECT trader_id, event_key, coin, us, price, size FROM fills_v WHERE trader_id IN (3, 5, 8)")


def src_s3_orderbook(s, d):
    """Two pulls of hourly files: what the second plans, and what both hold.

    Hours 3 and 15 of a day have no file; the first pull wants the hours before noon."""
    files, cache = shared_path(s, "book-files"), shared_path(s, "book-cache")
    lines = _book_lines(s, d).withColumn("hour", orderbook.hour_of("us")).withColumn("at", F.col("us"))
    of_day = F.substring("hour", 10, 2).cast("int")
    orderbook.write_hours(lines.where(~of_day.isin(3, 15)), files)
    wanted = lines.select("coin", "hour")
    orderbook.pull(wanted.where(of_day < 12), files, cache, "1", cap_hours=None)
    planned = orderbook.pull(wanted, files, cache, "2", cap_hours=None)
    held = sinks.read_batches(s, cache, "metrics", orderbook.METRICS).groupBy("coin", "hour").agg(F.count("*").alias("snapshots"), F.round(F.avg("spread"), 6).alias("spread"))
    return planned.select("coin", "hour", "state").join(held, ["coin", "hour"], "left")


QUERIES["src_s3_orderbook"] = src_s3_orderbook
ORACLE_SQL["src_s3_orderbook"] = duck("""SELECT coin, strftime(ts, '%Y%m%d-%H') AS hour, CASE WHEN HOUR(ANY_VALUE(ts)) IN (3, 15) THEN 'missing' WHEN HOUR(ANY_VALUE(ts)) < 12 THEN 'cached' ELSE 'fetch' END AS state,
CASE WHEN HOUR(ANY_VALUE(ts)) NOT IN (3, 15) THEN NULLIF(COUNT(*) FILTER (WHERE event_id % 20 <> 0), 0) END AS snapshots, CASE WHEN HOUR(ANY_VALUE(ts)) NOT IN (3, 15) THEN ROUND(AVG(ask - bid) FILTER (WHERE event_id % 20 <> 0 AND event_id % 14 <> 0), 6) END AS spread FROM book_v GROUP BY ALL""")
