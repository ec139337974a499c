"""Operator 13, how many intervals are open at once, by a sweep in chunks.

Starts and ends are summed by key and moment. A chunk is one key's moments of
one stretch of time; over its moments lie two lazy range-add segment trees, for
counts and for weights. What a chunk needs from the ones before it are a few
numbers a chunk, carried over in levels, so no key is ever one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewise.llm._common import materialize, release

#: Moments are multiples of so many seconds; a chunk spans so many, so it has 1,440 moments at most.
STEP, SPAN = 60, 86_400
#: Chunks of a key that one task carries over at a time.
FAN = 1024
#: A sale is open until so long after its first shipment.
OPEN_S = 7 * 86_400
UNKNOWN, ALL = -1, -2
_LOW = np.int64(-(1 << 62))


class RangeAddTree:
    """Segment tree over ``size`` points that adds values to whole ranges.

    A range's value stays as a lazy mark on the O(log size) nodes that cover it
    and is never pushed down. Calls take arrays and go level by level."""

    def __init__(self, size: int):
        self.size, self.leaves = size, 1 << max(size - 1, 0).bit_length()
        self.mark = np.zeros(2 * self.leaves, dtype=np.int64)
        self.top: np.ndarray | None = None

    def add(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> None:
        """Add each value to the points of its range [lo, hi)."""
        self.top = None
        wide = lo < hi
        lo, hi, value = lo[wide] + self.leaves, hi[wide] + self.leaves, value[wide]
        while len(lo):
            left, right = (lo & 1) == 1, (hi & 1) == 1
            np.add.at(self.mark, lo[left], value[left])
            np.add.at(self.mark, hi[right] - 1, value[right])
            lo, hi = (lo + left) >> 1, (hi - right) >> 1
            wide = lo < hi
            lo, hi, value = lo[wide], hi[wide], value[wide]

    def _maxima(self) -> np.ndarray:
        """The maximum below each node, its own mark included."""
        if self.top is None:
            self.top = self.mark.copy()
            self.top[self.leaves + self.size :] = _LOW
            level = self.leaves >> 1
            while level:
                below = self.top[2 * level : 4 * level]
                self.top[level : 2 * level] += np.maximum(below[::2], below[1::2])
                level >>= 1
        return self.top

    def values(self, at: np.ndarray) -> np.ndarray:
        """Values of points: the marks from leaf to root."""
        node, out = at + self.leaves, np.zeros(len(at), dtype=np.int64)
        while len(node) and node[0]:
            out += self.mark[node]
            node = node >> 1
        return out

    def prefix_max(self, at: np.ndarray) -> np.ndarray:
        """The largest value of the points up to each one, itself included."""
        top, node = self._maxima(), at + self.leaves
        out = self.mark[node].copy()
        while len(node) and node[0] > 1:
            right = (node & 1) == 1
            out[right] = np.maximum(out[right], top[node[right] - 1])
            node = node >> 1
            out += self.mark[node]
        return out

    def max(self) -> int:
        """The largest value of all points."""
        return int(self._maxima()[1])


def sweep_chunk(at: np.ndarray, dn: np.ndarray, dc: np.ndarray) -> dict[str, np.ndarray]:
    """A chunk's rows, all values counted from its own start. The last row, whose
    ``nxt`` is null, has the chunk's first moment and maxima too."""
    m = len(at)
    here, end = np.arange(m), np.full(m, m)
    count, cents = RangeAddTree(m), RangeAddTree(m)
    count.add(here, end, dn)
    cents.add(here, end, dc)
    last = here == m - 1
    only = lambda x: np.ma.array(np.full(m, x, dtype=np.int64), mask=~last)
    nxt = np.ma.array(np.append(at[1:], 0), mask=last)
    return {"at": at, "nxt": nxt, "n": count.values(here), "c": cents.values(here), "high": count.prefix_max(here), "first": only(at[0]), "top_n": only(count.max()), "top_c": only(cents.max())}


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(key, chunk, columns) of each chunk, from batches sorted by both."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        if not len(cols[0]):
            continue
        cuts = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1
        for a, b in zip([0, *cuts[:-1]], cuts, strict=False):
            yield cols[0][a], cols[1][a], [c[a:b] for c in cols[2:]]
        rest = [c[cuts[-1] if len(cuts) else 0 :] for c in cols]
    if rest is not None and len(rest[0]):
        yield rest[0][0], rest[1][0], rest[2:]


_ROWS = ("at", "nxt", "n", "c", "high", "first", "top_n", "top_c")


def _swept(changes: DataFrame, span: int) -> DataFrame:
    parts = int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, chunk, (at, dn, dc) in _chunks(batches):
            rows = sweep_chunk(at, dn, dc)
            same = [pa.array(np.full(len(at), x, dtype=np.int64)) for x in (key, chunk)]
            yield pa.RecordBatch.from_arrays([*same, *(pa.array(np.ma.getdata(rows[c]), pa.int64(), mask=np.ma.getmaskarray(rows[c])) for c in _ROWS)], names=["key", "chunk", *_ROWS])

    placed = changes.select("key", F.floor(F.col("at") / span).alias("chunk"), "at", "dn", "dc")
    dealt = placed.repartition(parts, "key", "chunk").sortWithinPartitions("key", "chunk", "at")
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in ("key", "chunk", *_ROWS)))


def _carried(chunks: DataFrame, fan: int = FAN) -> DataFrame:
    """``chunks`` (key, chunk, n, c, top_n, top_c, first) with what came before:
    ``base_n``, ``base_c``, ``base_high`` (null for none), and the moment ``then``
    that follows. ``fan`` chunks are carried in one group, groups by the level above."""
    lo, hi = chunks.agg(F.coalesce(F.min("chunk"), F.lit(0)), F.coalesce(F.max("chunk"), F.lit(0))).first()
    order = Window.partitionBy("key", "up").orderBy("chunk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"base_{x}": F.coalesce(F.sum(x).over(before), F.lit(0)) for x in ("n", "c")}
    own = chunks.withColumn("up", F.floor((F.col("chunk") - lo) / fan)).withColumns({**sums, "then": F.lead("first").over(order)})
    own = own.withColumn("base_high", F.max(F.col("base_n") + F.col("top_n")).over(before))
    if hi - lo < fan:
        return own.drop("up")
    above = own.groupBy("key", "up").agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.max(F.col("base_n") + F.col("top_n")).alias("top_n"), F.max(F.col("base_c") + F.col("top_c")).alias("top_c"), F.min("first").alias("first"))
    above = _carried(above.withColumnRenamed("up", "chunk"), fan).select("key", F.col("chunk").alias("up"), *(F.col(c).alias(f"up_{c}") for c in ("base_n", "base_c", "base_high", "then")))
    both = own.join(above, ["key", "up"])
    high = F.greatest(F.col("base_high") + F.col("up_base_n"), F.col("up_base_high"))
    moved = {"base_n": F.col("base_n") + F.col("up_base_n"), "base_c": F.col("base_c") + F.col("up_base_c"), "base_high": high, "then": F.coalesce("then", "up_then")}
    return both.select(*chunks.columns, *(v.alias(k) for k, v in moved.items()))


def concurrency(changes: DataFrame, span: int = SPAN, fan: int = FAN) -> DataFrame:
    """(key, from_s, to_s, n_open, open_cents, high_open, is_peak) of ``changes``
    (key long, at long, dn long, dc long: sums of what starts, less what ends).

    A row for each key and moment whose rows together change the count or the
    weight; ``to_s`` is the key's next such moment, null for the last. Rows of
    one key and moment are summed first. Null keys or moments take no part; a
    null change is none. An empty table gives no rows.
    """
    placed = changes.where("key IS NOT NULL AND at IS NOT NULL").groupBy("key", "at").agg(*(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("dn", "dc")))
    rows = materialize(_swept(placed.where("dn <> 0 OR dc <> 0"), span), "swept")
    chunks = materialize(rows.where("nxt IS NULL").select("key", "chunk", "n", "c", "top_n", "top_c", "first"), "chunks")
    carried = materialize(_carried(chunks, fan), "carried")
    peaks = carried.groupBy("key").agg(F.max(F.col("base_c") + F.col("top_c")).alias("peak"))
    base = carried.join(peaks, "key").select("key", "chunk", "base_n", "base_c", "base_high", "then", "peak")
    cents = F.col("base_c") + F.col("c")
    shown = {"from_s": F.col("at"), "to_s": F.coalesce("nxt", "then"), "n_open": F.col("base_n") + F.col("n"), "open_cents": cents, "high_open": F.greatest("base_high", F.col("base_n") + F.col("high")), "is_peak": cents == F.col("peak")}
    out = materialize(rows.join(base, ["key", "chunk"]).select("key", *(v.alias(k) for k, v in shown.items())), "concurrency")
    release(rows, chunks, carried)
    return out


def moment(df: DataFrame, name: str, step: int = STEP) -> Column:
    """UTC seconds since 1970 of a time column, rounded down to ``step``. Times
    without a zone are UTC, whatever the session's zone."""
    if df.schema[name].dataType.simpleString() == "timestamp_ntz":
        clock = F.hour(name) * 3600 + F.minute(name) * 60 + F.floor(F.second(name))
        seconds = F.datediff(F.to_date(name), F.lit("1970-01-01").cast("date")).cast("long") * 86_400 + clock
    else:
        seconds = F.unix_seconds(name)
    return seconds - F.pmod(seconds, F.lit(step))


def sale_changes(sales: DataFrame, lines: DataFrame, clients: DataFrame) -> DataFrame:
    """(key, at, dn, dc) of sales: open from their minute until seven days after
    the first shipment's minute, for the client's nation and for all.

    Each row of ``sales`` is a sale. A sale without a shipment, or with a null
    id, never ends; one with a null ``sold_at``, or whose end isn't after its
    start, takes no part. A null, NaN or infinite total weighs 0. A client of
    several rows has the least nation; none, or no such client, is -1. Changes
    are summed by client and moment before they are shuffled, so a client of
    very many sales costs no more than its moments.
    """
    ends = lines.where("sale_id IS NOT NULL AND shipped_at IS NOT NULL").groupBy("sale_id").agg(F.min("shipped_at").alias("shipped_at"))
    ends = ends.select("sale_id", (moment(ends, "shipped_at") + OPEN_S).alias("end"))
    known = F.when(F.abs("total") < 1e15, F.floor(100 * F.col("total") + 0.5))
    own = sales.where("sold_at IS NOT NULL").select("sale_id", "client_id", moment(sales, "sold_at").alias("start"), F.coalesce(known, F.lit(0)).cast("long").alias("cents"))
    whole = own.join(ends, "sale_id", "left").where("end IS NULL OR end > start")
    one = F.lit(1).cast("long")
    both = F.array(F.struct(F.col("start").alias("at"), one.alias("dn"), F.col("cents").alias("dc")), F.struct(F.col("end").alias("at"), (-one).alias("dn"), (-F.col("cents")).alias("dc")))
    moved = whole.select("client_id", F.explode(both).alias("x")).select("client_id", "x.*").where("at IS NOT NULL")
    moved = moved.groupBy("client_id", "at").agg(F.sum("dn").alias("dn"), F.sum("dc").alias("dc"))
    nation = clients.where("client_id IS NOT NULL").groupBy("client_id").agg(F.min("nation_id").alias("nation_id"))
    keys = F.array(F.coalesce("nation_id", F.lit(UNKNOWN)).cast("long"), F.lit(ALL).cast("long"))
    return moved.join(nation, "client_id", "left").select(F.explode(keys).alias("key"), "at", "dn", "dc")


def op13_peak_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open sales of each nation and of all, at every moment of a change."""
    sales, lines, clients = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("sales", "sale_lines", "clients"))
    out = concurrency(sale_changes(sales, lines, clients))
    return out.select(F.col("key").cast("int").alias("nation_id"), "from_s", "to_s", "n_open", "open_cents", "high_open", "is_peak")


OP13_SQL = f"""
WITH e AS (SELECT sale_id, CAST(floor(epoch(min(shipped_at)) / {STEP}) AS BIGINT) * {STEP} + {OPEN_S} AS e FROM sale_lines WHERE sale_id IS NOT NULL GROUP BY sale_id),
c AS (SELECT client_id, min(nation_id) AS nation_id FROM clients WHERE client_id IS NOT NULL GROUP BY client_id),
s AS (SELECT coalesce(c.nation_id, {UNKNOWN}) AS nation, CAST(floor(epoch(sold_at) / {STEP}) AS BIGINT) * {STEP} AS b, e.e,
             coalesce(CAST(floor(100 * total + 0.5) AS BIGINT), 0) AS cents
      FROM sales LEFT JOIN e USING (sale_id) LEFT JOIN c USING (client_id) WHERE sold_at IS NOT NULL),
ok AS (SELECT nation, b, e, cents FROM s WHERE e IS NULL OR e > b),
two AS (SELECT * FROM ok UNION ALL SELECT {ALL}, b, e, cents FROM ok),
x AS (SELECT nation, b AS t, 1 AS dn, cents AS dc FROM two UNION ALL SELECT nation, e, -1, -cents FROM two WHERE e IS NOT NULL),
m AS (SELECT nation, t, sum(dn) AS dn, sum(dc) AS dc FROM x GROUP BY nation, t HAVING sum(dn) <> 0 OR sum(dc) <> 0),
r AS (SELECT nation, t, lead(t) OVER (PARTITION BY nation ORDER BY t) AS u, sum(dn) OVER (PARTITION BY nation ORDER BY t) AS n, sum(dc) OVER (PARTITION BY nation ORDER BY t) AS c FROM m)
SELECT CAST(nation AS INTEGER) AS nation_id, t AS from_s, u AS to_s, CAST(n AS BIGINT) AS n_open, CAST(c AS BIGINT) AS open_cents,
       CAST(max(n) OVER (PARTITION BY nation ORDER BY t) AS BIGINT) AS high_open, c = max(c) OVER (PARTITION BY nation) AS is_peak
FROM r
"""
