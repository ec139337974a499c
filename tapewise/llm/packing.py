"""Operator 10, packing by minimum bin slack.

Only piece lengths decide the packing, and there are at most ``capacity``
different ones: the plan is made on the driver from a histogram of that bounded
size, then applied to all pieces by arithmetic on their rank in their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewise.llm import tokens
from tapewise.llm._common import documents, materialize

CAPACITY = 1024
END_ID = 0
PIECES = "{key}, start long, length long, ids_crc32 long, doc_tokens long"


def _slack(total: int, capacity: int) -> int:
    """Padding of a sequence of ``total`` ids: none at a power of two."""
    return 0 if total & (total - 1) == 0 else capacity - total


def best_fill(counts: dict[int, int], seed: int, capacity: int) -> dict[int, int]:
    """The multiset with at least one ``seed`` that leaves the least slack.

    Bounded subset-sum over the remaining lengths on a bitset of sums (an int);
    each length is split into binary groups of copies. The sets of reachable
    sums are kept and walked back for the counts.
    """
    left = dict(counts)
    left[seed] -= 1
    room = capacity - seed
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x, n in left.items() if n and x <= room), reverse=True):
        copies, size = min(left[length], room // length), 1
        while copies:
            take = min(size, copies)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            copies -= take
            size *= 2
        if reach >> room & 1:
            break
    sums = [s for s in range(room + 1) if reach >> s & 1]
    at = min(sums, key=lambda s: (_slack(seed + s, capacity), -s))
    chosen = {seed: 1}
    for length, take, before in reversed(steps):
        if not before >> at & 1:  # the sum needs this group
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(multiset of lengths, number of windows filled so) until no piece is left.

    The longest remaining piece opens each window; the fill found for it is
    repeated as long as the remaining counts allow, so the number of plans
    depends on the number of lengths, not on that of the pieces.
    """
    counts = {x: n for x, n in counts.items() if n}
    if any(x < 1 or x > capacity for x in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    out = []
    while counts:
        fill = best_fill(counts, max(counts), capacity)
        times = min(counts[x] // n for x, n in fill.items())
        for x, n in fill.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        out.append((fill, times))
    return out


def segments(plans: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, copies, first sequence, offset): pieces of
    a length with these ranks go to these sequences, ``copies`` in each."""
    used: dict[int, int] = {}
    out, base = [], 0
    for fill, times in plans:
        offset = 0
        for length in sorted(fill, reverse=True):
            n, lo = fill[length], used.get(length, 0)
            out.append((length, lo, lo + n * times, n, base, offset))
            used[length] = lo + n * times
            offset += n * length
        base += times
    return out


def ranked(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df`` (materialised) with ``rank``: gapless from 0 in each ``group``.

    One range partitioning by (group, order) numbers rows in place, so a group
    of any size spreads over partitions; only a row for each partition and group
    in it is summed up.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order)
    rows = materialize(rows.withColumn("_mid", F.monotonically_increasing_id()), "ranked").withColumn("_pid", F.shiftright("_mid", 33))
    parts = rows.groupBy("_pid", group).agg(F.count("*").alias("_n"), F.min("_mid").alias("_low"))
    before = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # partitions + groups rows at most, as partitions are ranges of the group
    parts = F.broadcast(parts.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    return rows.join(parts, ["_pid", group]).withColumn("rank", F.col("_first") + F.col("_mid") - F.col("_low")).drop("_mid", "_pid", "_low", "_first")


def cut(docs: DataFrame, doc: str, text: str, capacity: int = CAPACITY, path: str = tokens.DEFAULT) -> DataFrame:
    """Pieces of all documents: ids of the whole text and the end id, cut at
    every ``capacity`` ids. Ids stay on the executor that made them; a piece
    travels as start, length and checksum."""
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, start, length, crc, total = [], [], [], [], []
            for i, t in enumerate(batch.column(1)):
                ids = tokens.token_ids(t.as_py(), path)
                n, raw = len(ids) + 1, ids.tobytes() + END_ID.to_bytes(4, "little")
                for a in range(0, n, capacity):
                    b = min(a + capacity, n)
                    at.append(i)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                    total.append(n)
            cols = [batch.column(0).take(pa.array(at, pa.int64()))] + [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(doc, text).mapInArrow(run, PIECES.format(key=f"key {kind}"))


def pack(docs: DataFrame, doc: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str = tokens.DEFAULT) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset``.

    Each id of each document lies in exactly one piece and each sequence has at
    most ``capacity`` ids, gapless from offset 0. A null or empty text has the
    end id alone. Repeated rows are packed once each; null ids are kept. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = materialize(cut(docs, doc, text, capacity, path), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    segs = segments(plan(counts, capacity))
    table = spark.createDataFrame(segs or [(0, 0, 0, 1, 0, 0)], "length long, lo long, hi long, copies long, base long, off long")
    rows = ranked(pieces, "length", ["key", "start", "ids_crc32"])
    # a segment for each length in each plan: bounded by the capacity alone
    put = rows.join(F.broadcast(table), ["length"]).where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    seq = F.col("base") + F.floor(nth / F.col("copies")).cast("long")
    off = F.col("off") + (nth % F.col("copies")) * F.col("length")
    return put.select(F.col("key").alias(doc), "start", "length", "ids_crc32", "doc_tokens", seq.alias("sequence_id"), off.alias("offset"))


def op10_min_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 ids."""
    return pack(documents(spark, sf_dir).select("doc_id", "text"))
