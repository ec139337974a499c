"""Intermediate results as tables in the folder that all executors share."""

from __future__ import annotations

import atexit

from pyspark.sql import DataFrame

from tapewise.session import shared_path

#: Tables in use, with what deletes them even after the session is stopped.
_HELD: dict[str, tuple] = {}


def held(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read again: its lineage ends there, so what is read
    twice is computed once and a lost executor costs only its reading. The table
    goes when the driver ends."""
    spark = df.sparkSession
    path = shared_path(spark, f"tapewise-{label}")
    _HELD[path] = (spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for path, (jvm, conf) in _HELD.items():
        try:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        except Exception:  # noqa: BLE001, S112  the JVM may be gone at exit; its folder is the cluster's to clear
            continue
