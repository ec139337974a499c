"""The lake by day and bundles by wallet: what is read, and what isn't."""

import datetime

from pyspark.sql import functions as F

from tapewise.plans.registry import QUERIES
from tapewise.sources import lake

SF = "/root/testdata/sf0.001"


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def folder_reads(df):
    """Folders of the files that a scan of ``df`` really opened."""
    return {r.f.rsplit("/", 2)[-2] for r in df.select(F.input_file_name().alias("f")).distinct().collect()}


def test_days_are_pruned_at_planning(spark, tmp_path):
    rows = spark.sql("SELECT id, IF(id = 0, NULL, TIMESTAMP_NTZ '2023-12-30 00:00:00' + MAKE_INTERVAL(0, 0, 0, 0, CAST(id AS INT))) AS ts FROM range(200)")
    lake.write_days(rows, str(tmp_path / "lake"))
    held = spark.read.parquet(str(tmp_path / "lake"))
    got = lake.between_days(held, datetime.date(2023, 12, 31), datetime.date(2024, 1, 1))
    assert sorted(r.id for r in got.collect()) == list(range(24, 72))
    assert folder_reads(got) == {"day=31", "day=1"} and "PartitionFilters: [" in plan(got) and "make_date" in plan(got)
    assert held.where("ts IS NULL").count() == 1 and held.count() == 200
    assert lake.between_days(held, datetime.date(2030, 1, 1), datetime.date(2030, 1, 2)).isEmpty()


def test_days_found_at_run_time_prune(spark, tmp_path):
    rows = spark.sql("SELECT id, TIMESTAMP_NTZ '2024-01-01 00:00:00' + MAKE_INTERVAL(0, 0, 0, CAST(id % 20 AS INT)) AS ts FROM range(400)")
    lake.write_days(rows, str(tmp_path / "lake"))
    spark.sql("SELECT 2024 AS year, 1 AS month, CAST(id + 1 AS INT) AS day, id AS v FROM range(20)").write.parquet(str(tmp_path / "days"))
    days = spark.read.parquet(str(tmp_path / "days")).where("v IN (3, 4)")
    got = lake.on_days(spark.read.parquet(str(tmp_path / "lake")), days.unionAll(days))
    assert sorted(r.id % 20 for r in got.collect()) == [3] * 20 + [4] * 20
    assert "dynamicpruning" in plan(got) and got.columns.count("day") == 1
    assert lake.on_days(spark.read.parquet(str(tmp_path / "lake")), days.where("v > 90")).isEmpty()


def test_overwrite_replaces_only_its_days(spark, tmp_path):
    at = lambda day, v: spark.sql(f"SELECT {v} AS v, TIMESTAMP_NTZ '2024-01-0{day} 05:00:00' AS ts")
    lake.write_days(at(1, 1).unionAll(at(2, 2)), str(tmp_path / "l"))
    lake.write_days(at(2, 3), str(tmp_path / "l"), mode="overwrite")
    assert sorted((r.day, r.v) for r in lake.read_days(spark, str(tmp_path / "l")).collect()) == [(1, 1), (2, 3)]


def test_a_wallet_is_read_from_its_folder_and_row_groups(spark, tmp_path):
    rows = spark.sql("SELECT concat('w', id % 300) AS wallet, id AS timestamp, CAST(NULL AS INT) AS note FROM range(3000) UNION ALL SELECT NULL, 1, 2")
    lake.write_bundle(rows, str(tmp_path / "b"), parts=16)
    got = lake.read_bundle(spark, str(tmp_path / "b"), "w7", "w9")
    assert sorted((r.wallet, r.timestamp) for r in got.collect()) == sorted((f"w{i % 300}", i) for i in range(3000) if i % 300 in (7, 9))
    assert got.columns == ["wallet", "timestamp", "note"] and len(folder_reads(got)) <= 2
    assert "PartitionFilters: [part_of_16" in plan(got) and "xxhash64" not in plan(got) and "In(wallet" in plan(got)
    assert lake.read_bundle(spark, str(tmp_path / "b"), "none").isEmpty()
    assert spark.read.parquet(str(tmp_path / "b")).count() == 3001


def test_queries_prune(spark):
    assert "make_date" in plan(QUERIES["src_parquet_lake_pruned"](spark, SF))
    assert "dynamicpruning" in plan(QUERIES["src_parquet_lake_dynamic"](spark, SF))
    assert "part_of_64" in plan(QUERIES["src_parquet_bundle"](spark, SF))
