"""First-in-first-out lot matching on the axis of cumulative quantity.

Per tape (trader, coin, side), an open owns the stretch of the axis that ends at
the running total of opens, a matched close the one that ends at the running
total of closes less what found no inventory. The ends of both, in order, cut
the axis into pieces of one open and one close each: the trips. Totals are
decimals, so they neither drift nor depend on the order of summing. The work is
one shuffle and two sorts of the tape, whatever the quantities.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewise.functions.slippage import LinearBps, SlippageModel

TAPE = ["trader_id", "coin", "side"]
#: Quantities to 10 places; what is no larger than TOLERANCE is nothing.
QUANTITY = "decimal(26,10)"
TOLERANCE = Decimal("1e-9")


def _cumulative(fills: DataFrame) -> DataFrame:
    label = F.lower(F.trim("fill_dir"))
    known = fills.where(label.startswith("open") | label.startswith("close"))
    rows = known.withColumns({"side": F.when(label.contains("short"), "short").otherwise("long"), "is_open": label.startswith("open"), "q": F.col("size").cast(QUANTITY)})
    w = Window.partitionBy(*TAPE).orderBy("us", "event_key").rowsBetween(Window.unboundedPreceding, 0)
    none = F.lit(0).cast(QUANTITY)
    rows = rows.withColumns({"opened": F.sum(F.when(F.col("is_open"), F.col("q")).otherwise(none)).over(w), "closed": F.sum(F.when(F.col("is_open"), none).otherwise(F.col("q"))).over(w)})
    return rows.withColumn("lost", F.greatest(F.lit(0), F.max(F.col("closed") - F.col("opened")).over(w)))


def round_trips(fills: DataFrame, *, realized_only: bool = True, residual: bool = False) -> DataFrame:
    """Trips of ``fills`` (trader_id, coin, fill_dir, size, price, us,
    event_key, fee_usd, closed_pnl_usd).

    With ``realized_only`` a close that found too little inventory yields no
    trip, though it uses the lots up. With ``residual`` what is left of the lots
    comes from the same pass, as rows whose exit is null. Rows whose ``fill_dir`` is neither an open
    nor a close are skipped, as are sizes of 0. A tape is one task's, in order,
    without joining it to itself.
    """
    rows = _cumulative(fills)
    by = Window.partitionBy(*TAPE).orderBy("us", "event_key")
    rows = rows.withColumn("before", F.coalesce(F.lag("lost").over(by), F.lit(0)))
    gained = F.col("q") - (F.col("lost") - F.col("before"))  # the matched part of a close
    # keys and profits run apart from the rest of a leg, so that who doesn't read them doesn't carry them
    leg = {"": F.struct("us", "price", "size", F.col("fee_usd").alias("fee"), (F.col("lost") <= F.col("before") + TOLERANCE).alias("whole")), "_key": F.struct(F.col("event_key").alias("key")), "_pnl": F.struct(F.col("closed_pnl_usd").alias("pnl"))}
    ends = rows.where((F.when(F.col("is_open"), F.col("q")).otherwise(gained)) > TOLERANCE)
    own = {"o": F.col("is_open"), "c": ~F.col("is_open")}
    sides = [(f"{x}{n}", F.when(mine, part)) for x, mine in own.items() for n, part in leg.items()]
    ends = ends.select(*TAPE, F.when(F.col("is_open"), F.col("opened")).otherwise(F.col("closed") - F.col("lost")).alias("hi"), *(part.alias(n) for n, part in sides))
    # from the far end on: the nearest open and close that end here or later own what lies before
    back = Window.partitionBy(*TAPE).orderBy(F.desc("hi"))
    seen = back.rowsBetween(Window.unboundedPreceding, 0)
    cut = ends.withColumns({"lo": F.coalesce(F.lead("hi").over(back), F.lit(0)), **{n: F.last(n, ignorenulls=True).over(seen) for n, _ in sides}})
    pairs = cut.where((F.col("hi") - F.col("lo") > TOLERANCE) & F.col("o").isNotNull() & (F.lit(residual) | F.col("c").isNotNull())).withColumn("qty", (F.col("hi") - F.col("lo")).cast("double"))
    if realized_only:
        pairs = pairs.where("c IS NULL OR c.whole")
    part = lambda leg, x, of=None: F.col(of or leg)[x] * F.col("qty") / F.col(leg)["size"]
    return pairs.select(*TAPE, F.col("o_key.key").alias("open_key"), F.col("c_key.key").alias("close_key"), F.col("o.us").alias("entry_us"), F.col("c.us").alias("exit_us"), F.col("o.price").alias("entry_px"), F.col("c.price").alias("exit_px"), "qty", part("o", "fee").alias("fee_open"), part("c", "fee").alias("fee_close"), part("c", "pnl", "c_pnl").alias("closed_pnl"))


def residual_lots(fills: DataFrame) -> DataFrame:
    """What is left of each lot at the end of its tape."""
    rows = _cumulative(fills)
    used = rows.groupBy(*TAPE).agg(F.max(F.col("closed") - F.col("lost")).alias("matched"))
    left = rows.where("is_open").join(used, TAPE).withColumn("left", F.greatest(F.lit(0), F.col("opened") - F.greatest(F.col("opened") - F.col("q"), F.col("matched"))))
    return left.where(F.col("left") > TOLERANCE).select(*TAPE, F.col("event_key").alias("open_key"), "us", "price", F.col("left").cast("double").alias("left"))


def slipped(trips: DataFrame, model: SlippageModel | float) -> DataFrame:
    """``trips`` with ``net``: both legs at the prices of ``model`` (a number:
    that many basis points), less fees; ``ret`` against the entry notional
    before slippage; ``hold_hours``."""
    how = model if isinstance(model, SlippageModel) else LinearBps(model)
    entry, leave = how.round_trip(F.col("side"), F.col("entry_px"), F.col("exit_px"))
    net = F.when(F.col("side") == "long", leave - entry).otherwise(entry - leave) * F.col("qty") - F.col("fee_open") - F.col("fee_close")
    notional = F.col("qty") * F.col("entry_px")
    return trips.withColumn("net", net).withColumns({"ret": F.when(F.abs(notional) > 1e-12, F.col("net") / notional), "notional": F.abs(notional), "hold_hours": (F.col("exit_us") - F.col("entry_us")) / 3.6e9})
