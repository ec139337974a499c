"""Places and ranks over all rows without one task for all of them.

A bounded random sample of the ordering values gives bounds; they cut the rows
into ranges, numbered each by itself, and the ranges' row counts, summed up, are
where each range's numbers start. The bounds decide the sizes of ranges alone,
never a result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges to cut into, and rows drawn for each to find their bounds.
RANGES, DRAWN = 64, 64


@dataclass(frozen=True)
class By:
    """A column to order by; nulls are first or last whatever the direction."""

    name: str
    descending: bool = False
    nulls_first: bool = True

    def sort(self) -> Column:
        c = F.col(self.name)
        if self.descending:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()

    def before(self, a: Column, b: Column) -> Column:
        """Whether value ``a`` comes before ``b``."""
        less = F.coalesce(a > b if self.descending else a < b, F.lit(False))
        null, other = (a, b) if self.nulls_first else (b, a)
        return less | (null.isNull() & other.isNotNull())


def _range_of(order: list[By], bounds: list) -> Column:
    """How many bounds come before a row: bounds are alike for all its ties."""
    if not bounds:
        return F.lit(0)

    def passed(b: Column) -> Column:
        out, same = F.lit(False), F.lit(True)
        for i, by in enumerate(order):
            held, own = b[f"b{i}"], F.col(by.name)
            out, same = out | (same & by.before(held, own)), same & held.eqNullSafe(own)
        return out

    return F.size(F.filter(F.array(*bounds), passed))


def _bounds(df: DataFrame, order: list[By], ranges: int) -> list[Column]:
    """At most ``ranges`` - 1 bounds from ``ranges`` * DRAWN rows drawn at random."""
    keys = df.select(*(b.name for b in order))
    drawn = keys.orderBy(F.rand(7)).limit(ranges * DRAWN).orderBy(*(b.sort() for b in order)).collect()
    types = [keys.schema[b.name].dataType for b in order]
    step = max(1, len(drawn) // ranges)
    cuts = drawn[step::step][: ranges - 1]
    return [F.struct(*(F.lit(v).cast(t).alias(f"b{i}") for i, (v, t) in enumerate(zip(row, types, strict=True)))) for row in cuts]


def _offsets(counts: list[tuple[int, int]]) -> Column:
    """What lies before each range, by its number."""
    starts, total = [], 0
    for part, n in sorted(counts):
        starts += [F.lit(part), F.lit(total).cast("long")]
        total += n
    return F.create_map(*starts)[F.col("_range")] if starts else F.lit(0).cast("long")


def row_numbers(df: DataFrame, order: list[By], name: str = "place", ranges: int = RANGES) -> DataFrame:
    """``df`` with ``name``: each row's number from 1 in ``order``.

    With an order that leaves no ties the numbers are determined; rows that tie
    in all its columns share a range and are numbered in any order there, so they
    should be few. ``df`` is read three times: for bounds, counts and numbers."""
    placed = df.withColumn("_range", _range_of(order, _bounds(df, order, ranges)))
    counts = [tuple(r) for r in placed.groupBy("_range").count().collect()]  # ``ranges`` at most
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*(b.sort() for b in order)))
    return placed.withColumn(name, _offsets(counts) + within).drop("_range")


def value_ranks(df: DataFrame, column: str, ranges: int = RANGES) -> DataFrame:
    """``df`` with ``below`` (rows of lesser values of ``column``), ``ties``
    (rows of its own, itself included) and ``total``. Nulls are the least value.

    Values are counted first, so one that very many rows share is one row in
    what is ordered. Rows get their value's ranks back by a join."""
    held = df.groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("ties"))
    by = [By("_v")]
    placed = held.withColumn("_range", _range_of(by, _bounds(held, by, ranges)))
    counts = [(r[0], r[1]) for r in placed.groupBy("_range").agg(F.sum("ties")).collect()]  # ``ranges`` at most
    before = Window.partitionBy("_range").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("below", _offsets(counts) + F.coalesce(F.sum("ties").over(before), F.lit(0))).drop("_range")
    total = F.lit(sum(n for _, n in counts)).cast("long")
    return df.join(ranked, df[column].eqNullSafe(F.col("_v"))).drop("_v").withColumn("total", total)


def midrank_percent(df: DataFrame, column: str, name: str = "pct", ranges: int = RANGES) -> DataFrame:
    """``df`` with the percentile of ``column`` among all rows, ties sharing their
    mean rank; 50 for a single row."""
    share = (F.col("below") + (F.col("ties") - 1) / 2) * 100 / F.nullif(F.col("total") - 1, F.lit(0))
    return value_ranks(df, column, ranges).withColumn(name, F.coalesce(share, F.lit(50.0))).drop("below", "ties", "total")
