"""Parquet lake by event day, per-wallet bundles and schema contracts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Required columns of the lake's frames.
CONTRACTS = {
    "fills": ["timestamp", "coin", "side", "dir", "price", "size", "fee", "closed_pnl", "hash"],
    "user_funding": ["timestamp", "coin", "usdc", "szi", "funding_rate", "hash"],
    "ledger": ["timestamp", "ledger_type", "usdc", "fee", "hash"],
    "candles": ["timestamp", "open", "high", "low", "close", "volume"],
    "funding_history": ["timestamp", "coin", "funding_rate", "premium"],
}


def require(df: DataFrame, contract: str) -> DataFrame:
    """``df`` if it has the contract's columns, else an error that names what lacks."""
    lacking = [c for c in CONTRACTS[contract] if c not in df.columns]
    if lacking:
        raise ValueError(f"{contract} lacks {', '.join(lacking)}")
    return df


_DAY = ("year", "month", "day")


def write_days(df: DataFrame, path: str, at: str = "ts", mode: str = "append") -> None:
    """Write by the day of each row (not of a batch's first row); ``overwrite``
    replaces only the days that ``df`` holds. A large day is cut into several
    tasks and files. Rows without a time go to the partition of no day."""
    days = df.withColumns({"year": F.year(at), "month": F.month(at), "day": F.dayofmonth(at)})
    days.hint("rebalance", *_DAY).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*_DAY).parquet(path)


def read_days(spark: SparkSession, path: str, year: int | None = None, month: int | None = None, day: int | None = None) -> DataFrame:
    """The lake, with only the partitions of the given date parts."""
    df = spark.read.parquet(path)
    for name, value in zip(_DAY, (year, month, day), strict=True):
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def between_days(lake: DataFrame, first: date, last: date) -> DataFrame:
    """Rows of the days from ``first`` to ``last``, both included; only their
    partitions are listed and read."""
    return lake.where(F.make_date(*_DAY).between(F.lit(first), F.lit(last)))


def on_days(lake: DataFrame, days: DataFrame) -> DataFrame:
    """Rows of the days in ``days`` (year, month, day), which are found first and
    prune the partitions that are read. A day is one small row, so the distinct
    days are sent to every task."""
    return lake.join(F.broadcast(days.select(*_DAY).distinct()), list(_DAY), "left_semi")


def _part(parts: int, wallet: str | Column = "wallet") -> Column:
    return F.pmod(F.xxhash64(wallet), F.lit(parts))


def write_bundle(df: DataFrame, path: str, parts: int = 64) -> None:
    """Write by wallet: ``parts`` folders by the wallet's hash, in each rows by
    wallet and time, so that a wallet is found by folder and row group. The number
    of folders doesn't grow with that of wallets, and a large one is several tasks."""
    name = f"part_of_{parts}"
    rows = df.withColumn(name, _part(parts)).hint("rebalance", name).sortWithinPartitions(name, "wallet", "timestamp")
    rows.write.mode("overwrite").partitionBy(name).parquet(path)


def read_bundle(spark: SparkSession, path: str, *wallets: str) -> DataFrame:
    """Rows of the given wallets, from their folders only."""
    df = spark.read.parquet(path)
    name = next(c for c in df.columns if c.startswith("part_of_"))
    parts = int(name.removeprefix("part_of_"))
    # a literal's hash is folded before planning, so folders are pruned then
    kept = F.col(name).isin(*(_part(parts, F.lit(w)) for w in wallets))
    return df.where(kept & F.col("wallet").isin(*wallets)).drop(name)


def export_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
