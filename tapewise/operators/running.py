"""Running sums, products and extremes of a long order without one task for all of it.

Rows of a key are cut into buckets of their order (days, say). Each bucket runs by
itself; its last values, a row a bucket, run once more over the buckets and are
carried into the rows of later ones. All four functions are associative, so the
cut never changes a result but for the order in which doubles are added or
multiplied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewise.operators.tables import held

_FUNCTIONS = {
    "sum": (F.sum, lambda a, b: a + b),
    "product": (F.product, lambda a, b: a * b),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


def running(df: DataFrame, keys: list[str], bucket: str, order: list[str], columns: dict[str, tuple[str, Column]]) -> DataFrame:
    """``df`` with ``columns``: name to (sum, product, max or min, column), each over
    the rows of the same ``keys`` up to and with this one.

    ``bucket`` must grow with ``order`` (equal or greater from row to row) and
    ``order`` be without ties in a bucket. Null values count for nothing; where all
    so far are null the result is null. Null keys are a key like others. An empty
    table stays empty. Rows are shuffled once, by keys and bucket, and written as a
    table that the last values and the result are read from, so that ``df`` is
    computed once however often it runs on."""
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = held(df.withColumns({n: _FUNCTIONS[f][0](c).over(inside) for n, (f, c) in columns.items()}), "running")
    last = rows.groupBy(*keys, bucket).agg(*(F.max_by(n, F.struct(*order)).alias(n) for n in columns))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, bucket])), *(_FUNCTIONS[f][0](n).over(before).alias(f"_b_{n}") for n, (f, _) in columns.items()))
    same = F.lit(True)
    for i, k in enumerate([*keys, bucket]):
        same = same & rows[k].eqNullSafe(F.col(f"_k{i}"))
    out = rows.join(carry, same, "left")
    carried = {n: F.coalesce(_FUNCTIONS[f][1](F.col(f"_b_{n}"), F.col(n)), F.col(n), F.col(f"_b_{n}")) for n, (f, _) in columns.items()}
    return out.withColumns(carried).select(*df.columns, *columns)
