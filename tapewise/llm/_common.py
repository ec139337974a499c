"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Separators of the ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` word rule.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Paths in use, with what deletes them even after the session is stopped.
_SCRATCH: dict[str, tuple] = {}
#: While a table is written: shuffle files go with the job, and Arrow batches are bounded in rows, as texts may be long.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "512"}


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, or a
    fresh temporary one where a local session sets none (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master or ""):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tapewise-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/tapewise-{label}-{uuid.uuid4().hex}"
    _SCRATCH[path] = (spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder, reread it.

    A lost executor costs only tasks that read this table again. The shuffle
    files behind the table go when it is written."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = {k: spark.conf.get(k) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``materialize``, once nothing reads them any more."""
    for df in tables:
        _delete(df._scratch)


def _delete(path: str) -> None:
    jvm, conf = _SCRATCH.pop(path)
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


@atexit.register
def _clean() -> None:
    for path in list(_SCRATCH):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001, S112  the JVM may be gone at exit; its folder is the cluster's to clear
            continue


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` where a text is pure ASCII."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, _UPPER, _UPPER.lower()))


def words(col: Column) -> Column:
    """Lower-cased words of a text; null and blank texts have none."""
    parts = F.split(ascii_lower(F.coalesce(col, F.lit(""))), SEPARATORS)
    return F.filter(parts, lambda w: w != "")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_key(text: Column) -> Column:
    """128-bit key of a text, null kept apart from empty."""
    return F.struct(F.xxhash64(text, F.lit(1)).alias("a"), F.xxhash64(text, F.lit(2), text).alias("b"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces, so that what a worker builds for one stays small."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
