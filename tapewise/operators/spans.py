"""Extremes over spans of time and first passages, without a row for each pair of a
span and a right row in it: spans meet whole buckets by their summaries, and right
rows themselves only at their ends and where a bucket holds the passage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of an hour and of a minute, in microseconds.
COARSE, FINE = 3_600_000_000, 60_000_000


def _bucket(x: str, width: int) -> Column:
    return F.floor(F.col(x) / width)


def span_stats(left: DataFrame, right: DataFrame, key: str, at: str, start: str, end: str, value: str, by: list[str], *, last: str | None = None, width: int = COARSE) -> DataFrame:
    """``by``, n, lo, hi, last_at and last: count, least and greatest ``value`` and the
    ``last`` (else ``value``) of the right rows of the same ``key`` in [start, end].

    ``by`` tells left rows apart; each gets a row, n being 0 and the rest null
    without right rows. Spans have to be as long as ``width`` or longer, so that
    the ends lie in different buckets: what a span holds is then the rest of its
    first bucket, the head of its last one, both running values of one ordered
    pass each, and the summaries of those between. Of rows at one time the
    greatest counts as the last."""
    held = F.struct(F.col("_t"), F.col("_w"))
    rows = right.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.col(value).alias("_v"), F.col(last or value).alias("_w")).where("_k IS NOT NULL AND _t IS NOT NULL")
    rows = rows.withColumns({"_n": F.lit(1).cast("long"), "_b": _bucket("_t", width)})
    ends = F.explode(F.array(F.struct(F.lit(True).alias("first"), F.col(start).alias("t")), F.struct(F.lit(False).alias("first"), F.col(end).alias("t"))))
    probes = left.select(F.col(key).alias("_k"), F.struct(*by).alias("_p"), ends.alias("_e")).select("_k", "_p", F.col("_e.first").alias("_first"), F.col("_e.t").alias("_t"))
    stream = rows.unionByName(probes.withColumn("_b", _bucket("_t", width)), allowMissingColumns=True)
    seen = lambda w: F.struct(F.sum("_n").over(w).alias("n"), F.min("_v").over(w).alias("lo"), F.max("_v").over(w).alias("hi"), F.max(F.when(F.col("_n") == 1, held)).over(w).alias("last"))
    part = Window.partitionBy("_k", "_b")
    stream = stream.withColumns({"_head": seen(part.orderBy("_t")), "_rest": seen(part.orderBy(F.desc("_t")))})
    edges = stream.where("_p IS NOT NULL").select("_p.*", F.when(F.col("_first"), F.col("_rest")).otherwise(F.col("_head")).alias("_s")).select(*by, "_s.*")
    whole = rows.groupBy("_k", "_b").agg(F.sum("_n").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.max(held).alias("last"))
    inner = left.select(*by, F.col(key).alias("_k"), (_bucket(start, width) + 1).alias("_x"), (_bucket(end, width) - 1).alias("_y")).where("_x <= _y")
    inner = inner.withColumn("_b", F.explode(F.sequence("_x", "_y"))).join(whole, ["_k", "_b"]).select(*by, "n", "lo", "hi", "last")
    out = edges.unionByName(inner).groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("last").alias("_last"))
    return out.select(*by, "n", "lo", "hi", F.col("_last._t").alias("last_at"), F.col("_last._w").alias("last"))


def first_passage(left: DataFrame, right: DataFrame, key: str, at: str, start: str, end: str, value: str, hit: Callable[[Column], Column], by: list[str], *, coarse: int = COARSE, fine: int = FINE) -> DataFrame:
    """``by``, hit_at and hit_value of the first right row of the same ``key`` in
    [start, end] for whose ``value`` ``hit`` holds; no row where there is none.

    ``hit`` may look at columns of ``left``. It has to hold for all values from some
    level up or from some level down, or both, so that a bucket holds a passage just
    when its least or greatest value is one. Of the buckets of a span only the
    first that it holds whole and the two at its ends can hold its first
    passage: first by hours, then by the minutes of those hours, then by rows.
    Of rows at one time the least value counts."""
    rows = right.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.col(value).alias("_v")).where("_k IS NOT NULL AND _t IS NOT NULL AND _v IS NOT NULL")
    rows = rows.withColumns({"_b": _bucket("_t", coarse), "_f": _bucket("_t", fine)})
    minutes = rows.groupBy("_k", "_b", "_f").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    hours = minutes.groupBy("_k", "_b").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    ask = left.withColumns({"_k": F.col(key), "_x": _bucket(start, coarse), "_y": _bucket(end, coarse), "_fx": _bucket(start, fine), "_fy": _bucket(end, fine)})
    possible = hit(F.col("_lo")) | hit(F.col("_hi"))

    def among(found: DataFrame, bucket: str, x: str, y: str) -> DataFrame:
        b = F.col(bucket)
        pick = [F.max(F.when(b == F.col(x), b)), F.min(F.when((b > F.col(x)) & (b < F.col(y)), b)), F.max(F.when(b == F.col(y), b))]
        few = found.groupBy(*ask.columns).agg(*(p.alias(f"_{i}") for i, p in enumerate(pick)))
        return few.select(*ask.columns, F.explode(F.array_distinct(F.array_compact(F.array("_0", "_1", "_2")))).alias(bucket))

    near = ask.withColumn("_b", F.explode(F.sequence("_x", "_y"))).join(hours, ["_k", "_b"]).where(possible)
    near = among(near, "_b", "_x", "_y").join(minutes, ["_k", "_b"]).where(possible & F.col("_f").between(F.col("_fx"), F.col("_fy")))
    near = among(near, "_f", "_fx", "_fy").join(rows.drop("_b"), ["_k", "_f"]).where(F.col("_t").between(F.col(start), F.col(end)) & hit(F.col("_v")))
    out = near.groupBy(*by).agg(F.min(F.struct("_t", "_v")).alias("_m"))
    return out.select(*by, F.col("_m._t").alias("hit_at"), F.col("_m._v").alias("hit_value"))
