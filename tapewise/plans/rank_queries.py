"""Queries that number or rank all rows of a table, by ranges of their order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewise.functions import kernels as k
from tapewise.operators.ranks import By, midrank_percent, row_numbers, value_ranks
from tapewise.plans.dialect import spark

QUERIES = {}


def _numbered(name: str, rows: str, order: list[By], place: str, drop: tuple[str, ...] = ()) -> None:
    QUERIES[name] = lambda s, d: row_numbers(spark(rows)(s, d), order, place).drop(*drop)


def _means(digits: int) -> str:
    """Each trader's mean price: summed as decimals, so that what decides between two
    places isn't the order of adding doubles."""
    return f"SELECT trader_id, ROUND(CAST(SUM(CAST(price AS DECIMAL(28, 10))) AS DOUBLE) / COUNT(price), {digits}) AS v FROM fills_v GROUP BY trader_id"


_numbered("win_rank_order", _means(4), [By("v", True, False), By("trader_id")], "position", ("v",))
_numbered("srt_multi_key", "SELECT trader_id, behavior_tier, last_seen FROM traders_v", [By("behavior_tier", True, False), By("last_seen", True, False), By("trader_id")], "place", ("last_seen",))
_numbered("srt_case_rank", "SELECT trader_id, CASE wallet_status WHEN 'PROMOTED' THEN 0 WHEN 'WATCHLIST' THEN 1 WHEN 'DISCOVERED' THEN 2 ELSE 3 END AS k FROM traders_v", [By("k"), By("trader_id")], "place", ("k",))
_numbered("agg_backfill_priority", "SELECT t.wallet, f.n FROM traders_v t LEFT JOIN (SELECT trader_id, COUNT(*) AS n FROM fills_v WHERE coin = 'purchase' GROUP BY trader_id) f ON f.trader_id = t.trader_id WHERE t.wallet_status = 'PROMOTED'", [By("n"), By("wallet")], "priority")


def win_percentile_midrank(s, d):
    """Mean price among all traders, ties sharing their mean rank."""
    return midrank_percent(spark(_means(2))(s, d), "v").select("trader_id", k.rounded("pct", 6).alias("pct"))


def win_peer_percentile(s, d):
    """Share of traders whose mean price is no greater; 55 for a lone one."""
    share = F.when(F.col("total") < 2, 55.0).otherwise(100.0 * (F.col("below") + F.col("ties")) / F.col("total"))
    return value_ranks(spark(_means(2))(s, d), "v").select("trader_id", k.rounded(share, 6).alias("pct"))


QUERIES |= {f.__name__: f for f in (win_percentile_midrank, win_peer_percentile)}
