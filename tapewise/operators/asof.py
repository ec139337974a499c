"""As-of joins as ordered passes over time buckets, without LATERAL subqueries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A day of microseconds.
BUCKET = 86_400_000_000


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str], *, direction: str = "backward", shift: int = 0, prefix: str = "asof_", width: int = BUCKET, tie: str | None = None) -> DataFrame:
    """``left`` with the columns ``values`` of the right row last at or before
    ``at + shift`` (``backward``), or first at or after it (``forward``), of the
    same ``key``.

    Both sides go into one stream per key and bucket of ``width``, ordered by
    time, right rows before left ones at equal times, so both directions include
    equal times and a hot key is as many tasks as it has buckets. A bucket
    without an earlier right row takes the one carried over from the buckets
    before, a row each. Of right rows at one time the greatest ``values`` count or,
    with a number ``tie`` that orders them, the nearest in the direction: its last
    backward, its first forward. Left rows without a match get nulls; null keys never match. The right row's
    time comes as ``prefix + at``.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction is backward or forward")
    sign = 1 if direction == "backward" else -1
    place = [(F.col(tie) * sign).alias("_tie")] if tie else []
    carried = F.struct(F.col(at).alias(at), *place, *(F.col(v).alias(v) for v in values))
    lrows = left.select(F.col(key).alias("_k"), (F.col(at) + F.lit(shift)).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"))
    rrows = right.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(0).alias("_side"), carried.alias("_r")).where(F.col("_k").isNotNull() & F.col("_t").isNotNull())
    rows = lrows.unionByName(rrows, allowMissingColumns=True).withColumns({"_o": F.col("_t") * sign, "_b": F.floor(F.col("_t") / width) * sign})
    # a row for each key and bucket: the last right row of all buckets before
    ends = rows.groupBy("_k", "_b").agg(F.max(F.when(F.col("_side") == 0, F.struct("_o", "_r"))).alias("_e"))
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("_k").alias("_ck"), F.col("_b").alias("_cb"), F.last("_e", ignorenulls=True).over(before)["_r"].alias("_c"))
    inside = Window.partitionBy("_k", "_b").orderBy("_o", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.withColumn("_m", F.last("_r", ignorenulls=True).over(inside)).where("_side = 1")
    both = both.join(ends, (F.col("_k") == F.col("_ck")) & F.col("_b").eqNullSafe(F.col("_cb")), "left").withColumn("_m", F.coalesce("_m", "_c"))
    names = [at, *values]
    return both.select("_l.*", *(F.col(f"_m.{v}").alias(f"{prefix}{v}") for v in names))


def asof_nearest(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str], prefix: str = "near_", tie: str | None = None) -> DataFrame:
    """The right row of least time distance; the earlier one of two equally near.
    ``tie`` as in ``asof_join``."""
    back = asof_join(left, right, key, at, values, prefix="_b_", tie=tie)
    both = asof_join(back, right, key, at, values, direction="forward", prefix="_f_", tie=tie)
    earlier = F.col(f"_f_{at}").isNull() | (F.col(at) - F.col(f"_b_{at}") <= F.col(f"_f_{at}") - F.col(at))
    pick: list[Column] = [F.when(F.col(f"_b_{at}").isNotNull() & earlier, F.col(f"_b_{v}")).otherwise(F.col(f"_f_{v}")).alias(f"{prefix}{v}") for v in [at, *values]]
    return both.select(*left.columns, *pick)


def range_join(left: DataFrame, right: DataFrame, key: str, at: str, start: str, end: str, width: int) -> DataFrame:
    """Inner join of left intervals [start, end] with right rows inside them.

    The time axis is cut into buckets of ``width``; an interval is copied to
    each bucket it touches, so the join is an equi-join on (key, bucket) and no
    key's rows meet all its intervals."""
    cuts = F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width)))
    spread = left.withColumn("_b", cuts)
    placed = right.withColumn("_b", F.floor(F.col(at) / width))
    joined = spread.alias("l").join(placed.alias("r"), [key, "_b"])
    return joined.where((F.col(f"r.{at}") >= F.col(start)) & (F.col(f"r.{at}") <= F.col(end))).drop("_b")
