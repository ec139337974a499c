"""Writers: parents with children, batches of runs, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewise.operators.snapshots import _fs


def replace_children(held: DataFrame, parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Child rows after each of ``parents`` had its children replaced."""
    kept = held.join(parents.select(key), key, "left_anti")
    return kept.unionByName(children.join(parents.select(key), key, "left_semi"))


def upsert_ids(held: DataFrame, wanted: DataFrame, name: str, ident: str) -> DataFrame:
    """(name, id) of all ``wanted`` names: the held id, else the next free ones by name."""
    from pyspark.sql import Window

    top = held.agg(F.coalesce(F.max(ident), F.lit(0)).alias("_top"))
    rows = wanted.select(name).distinct().join(held.select(name, ident), name, "left")
    new = rows.where(F.col(ident).isNull()).crossJoin(F.broadcast(top))
    given = new.select(name, (F.col("_top") + F.row_number().over(Window.orderBy(name))).alias(ident))
    return rows.where(F.col(ident).isNotNull()).unionByName(given)


def save_batch(tables: dict[str, DataFrame], path: str, batch_id: str) -> None:
    """Each table of a batch under ``batch_id``; a marker is written last, and
    ``read_batches`` takes only batches that have it. A batch that is saved again
    loses its marker first, so readers miss it until it is whole again."""
    spark = next(iter(tables.values())).sparkSession
    fs, make = _fs(spark, path)
    marker = make(f"{path}/_complete/batch={batch_id}")
    fs.delete(marker, True)
    for name, df in tables.items():
        df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
    spark.range(1).select(F.lit(batch_id).alias("batch_id")).write.parquet(marker.toString())


def complete_batches(spark: SparkSession, path: str) -> list[str]:
    """Ids of the batches whose marker is written, in order; one small entry a batch."""
    fs, make = _fs(spark, path)
    folder = make(f"{path}/_complete")
    if not fs.exists(folder):
        return []
    names = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("batch=")]
    return sorted(n.getName().removeprefix("batch=") for n in names if fs.exists(make(n, "_SUCCESS")))


def read_batches(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A table over all complete batches; folders of others aren't even listed."""
    ids = complete_batches(spark, path)
    schema = f"{schema}, batch_id string"
    return spark.read.schema(schema).parquet(*(f"{path}/{name}/batch={i}" for i in ids)) if ids else spark.createDataFrame([], schema)


def markdown(df: DataFrame, rows: int = 50) -> str:
    """A report table of at most ``rows`` rows."""
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join(map(cell, r)) + " |" for r in df.limit(rows).collect())])


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)
