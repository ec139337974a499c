"""A keyed Parquet table as versions: data first, then the manifest that names it.

Rows lie in buckets by the hash of their key. A merge writes the buckets that it
touches beside the old ones, then one manifest file, which is renamed into place.
A reader goes by the last manifest, so it sees the table before a merge or after
it; a merge that dies leaves nothing that a reader meets.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewise.operators.merge import latest

BUCKETS = 64
_BUCKET = "merge_bucket"


def _fs(spark: SparkSession, path: str):
    """(file system, path maker) of a folder."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def manifests(spark: SparkSession, path: str) -> list[int]:
    """Committed versions in order."""
    fs, make = _fs(spark, path)
    folder = make(f"{path}/manifests")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[: -len(".json")]) for n in names if n.endswith(".json") and n[: -len(".json")].isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The last manifest, or that of ``version``; None where nothing is committed."""
    held = manifests(spark, path)
    if version is None:
        version = held[-1] if held else None
    if version is None or version not in held:
        return None
    row = spark.read.option("wholetext", True).text(f"{path}/manifests/{version:020d}.json").first()
    return json.loads(row[0])


def _commit(spark: SparkSession, path: str, new: dict) -> None:
    fs, make = _fs(spark, path)
    name = f"{path}/manifests/{new['version']:020d}"
    draft, final = make(f"{name}.draft"), make(f"{name}.json")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(new).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        raise RuntimeError(f"version {new['version']} of {path} is another writer's")


def bucket_of(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def merge(spark: SparkSession, path: str, batch: DataFrame, key: list[str], order: list[str], batch_id: int | None = None, buckets: int = BUCKETS) -> int:
    """Fold ``batch`` into the table at ``path``, the latest row of each key by
    ``order`` staying; returns the version.

    Only buckets with keys of the batch are rewritten. A batch whose id isn't
    above the last one's was merged before and changes nothing, so a repeated
    micro-batch is harmless. The number of buckets is that of the first merge.
    Null keys are keys. An empty batch commits its id alone. One writer at a time."""
    now = manifest(spark, path) or {"version": 0, "batch": None, "buckets": buckets, "files": {}}
    if batch_id is not None and now["batch"] is not None and batch_id <= now["batch"]:
        return now["version"]
    version, n = now["version"] + 1, now["buckets"]
    rows = batch.withColumn(_BUCKET, bucket_of(key, n))
    touched = sorted(r[0] for r in rows.select(_BUCKET).distinct().collect())  # ``buckets`` at most
    files = dict(now["files"])
    if touched:
        held = [f"{path}/{files[str(b)]}" for b in touched if str(b) in files]
        whole = spark.read.parquet(*held).withColumn(_BUCKET, bucket_of(key, n)).unionByName(rows, allowMissingColumns=True) if held else rows
        latest(whole, key, order).repartition(_BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{path}/data/{version}")
        files |= {str(b): f"data/{version}/{_BUCKET}={b}" for b in touched}
    _commit(spark, path, {"version": version, "batch": now["batch"] if batch_id is None else batch_id, "buckets": n, "files": files})
    return version


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of its last version, or of ``version``."""
    now = manifest(spark, path, version)
    if now is None or not now["files"]:
        raise FileNotFoundError(f"{path} has no committed rows")
    return spark.read.parquet(*(f"{path}/{f}" for f in now["files"].values()))


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Drop all but the last ``keep`` versions, with the folders that only they name."""
    fs, make = _fs(spark, path)
    held = manifests(spark, path)
    old, kept = held[:-keep], held[-keep:]
    used = {f for v in kept for f in manifest(spark, path, v)["files"].values()}
    gone = {f for v in old for f in manifest(spark, path, v)["files"].values()} - used
    for v in old:  # manifests first: what they name is gone only when no reader can start on it
        fs.delete(make(f"{path}/manifests/{v:020d}.json"), False)
    for f in gone:
        fs.delete(make(f"{path}/{f}"), True)
