"""Idempotent writes as DataFrame operations: what a table becomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert_coalesce(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` after ``new``: a new non-null value wins, else the old one stays."""
    values = [c for c in old.columns if c not in key]
    joined = old.alias("o").join(new.alias("n"), key, "full_outer")
    return joined.select(*key, *(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in values))


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` whose key ``old`` lacks, one for each key."""
    return new.join(old.select(*key), key, "left_anti").dropDuplicates(key)


def changed(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` that are new or differ in any column, nulls compared as values."""
    values = [c for c in new.columns if c not in key]
    held = old.select(*key, *(F.col(c).alias(f"_o_{c}") for c in values), F.lit(True).alias("_held"))
    differs = F.col("_held").isNull()
    for c in values:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return new.join(held, key, "left").where(differs).select(*new.columns)


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    w = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")

