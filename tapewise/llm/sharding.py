"""Operator 6, sharding: jump consistent hashing without a ring table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewise.llm._common import documents, materialize

_BITS = 48


def jump_shard(key: Column, n: int) -> Column:
    """Shard of ``key`` among ``n``: the last jump below ``n``.

    The k-th jump goes from b to floor((b + 1) / u_k), where u_k in (0, 1] comes
    from md5(key ':' k). The jumps depend on the key alone, so with ``n + 1``
    shards a key stays or moves to the new shard ``n``. Each jump gains at least
    one, so ``n`` steps always suffice. A null key counts as the empty string.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    name = F.coalesce(key.cast("string"), F.lit(""))

    def step(b: Column, k: Column) -> Column:
        hexes = F.substring(F.md5(F.concat(name, F.lit(":"), k.cast("string"))), 1, _BITS // 4)
        u = F.conv(hexes, 16, 10).cast("long") + 1
        # (b + 1) * 2^48 stays an exact long below 2^15 shards; larger counts use the double
        to = F.floor((b.jump + 1) * F.lit(float(1 << _BITS)) / u.cast("double"))
        at = F.when(to > n, F.lit(n)).otherwise(to).cast("long")
        return F.when(b.jump >= n, b).otherwise(F.struct(b.jump.alias("at"), at.alias("jump")))

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("jump"))
    # a key jumps about ln(n) times: the steps beyond ``few`` are gone through only for keys that need them
    few = min(n + 1, 40 + 4 * n.bit_length())
    first = F.aggregate(F.sequence(F.lit(1), F.lit(few)), begin, step)
    if few == n + 1:
        return first["at"].cast("int")
    more = lambda b: F.aggregate(F.sequence(F.lit(few + 1), F.lit(n + 1)), b, step, lambda x: x["at"])
    return F.element_at(F.transform(F.array(first), lambda b: F.when(b["jump"] >= n, b["at"]).otherwise(more(b)).cast("int")), 1)


def shard_rows(df: DataFrame, key: str, n_shards: int, *, tie: list[Column] | None = None, buckets: int = 1024) -> DataFrame:
    """``df`` with ``shard``, ``grown_shard`` (one more shard) and ``slot``, the
    gapless place in the shard.

    Slots come from ``buckets`` hash buckets a shard: a count for each bucket
    (``n_shards * buckets`` rows at most, so its broadcast is bounded by the
    parameters) gives the first slot, a window inside the bucket the rest. No
    task ever holds a whole shard. Rows that agree in key and ``tie`` are
    interchangeable. Null keys are one key; an empty input gives no rows.
    Columns of ``df`` named like the new ones are replaced.
    """
    tie = tie or []
    df = df.drop("shard", "grown_shard", "slot", "_bucket", "_first", "_in")
    spread = F.pmod(F.xxhash64(F.col(key), *tie), F.lit(buckets)).cast("int")
    put = df.withColumns({"shard": jump_shard(F.col(key), n_shards), "grown_shard": jump_shard(F.col(key), n_shards + 1), "_bucket": spread})
    put = materialize(put, "shards")
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = put.groupBy("shard", "_bucket").agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("shard", "_bucket").orderBy(F.col(key).asc_nulls_first(), *tie)
    ranked = put.withColumn("_in", F.row_number().over(inside) - 1)
    return ranked.join(F.broadcast(first), ["shard", "_bucket"]).withColumn("slot", (F.col("_first") + F.col("_in")).cast("long")).drop("_bucket", "_first", "_in")


def op6_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 16 shards by ``doc_id`` (law ``key``)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    out = shard_rows(rows, "doc_id", 16, tie=[F.col("text_crc32"), F.col("size")])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
