"""Versioned merges: what readers see, whatever step a writer dies at."""

import random

import pytest

from tapewise.operators import snapshots

SCHEMA = "k long, at long, v string"


def table(spark, path, version=None):
    return {r.k: (r.at, r.v) for r in snapshots.read(spark, path, version).collect()}


def test_merges_keep_the_latest_row(spark, tmp_path):
    path, rng, want = str(tmp_path / "t"), random.Random(1), {}
    for batch in range(4):
        rows = [(rng.randrange(60) if rng.random() < 0.97 else None, batch * 1000 + i, f"{batch}-{i}") for i in range(40)]
        for k, at, v in rows:
            want[k] = max(want.get(k, (-1, "")), (at, v))
        assert snapshots.merge(spark, path, spark.createDataFrame(rows, SCHEMA), ["k"], ["at"], batch) == batch + 1
        assert table(spark, path) == want
    for again in (0, 3):  # a repeated micro-batch
        assert snapshots.merge(spark, path, spark.createDataFrame([(1, 10**6, "x")], SCHEMA), ["k"], ["at"], again) == 4
    assert table(spark, path) == want
    assert snapshots.merge(spark, path, spark.createDataFrame([], SCHEMA), ["k"], ["at"], 9) == 5 and table(spark, path) == want
    assert snapshots.read(spark, path).columns == ["k", "at", "v"]


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.merge(spark, path, spark.range(500).selectExpr("id AS k", "0L AS at", "'a' AS v"), ["k"], ["at"], buckets=8)
    before = snapshots.manifest(spark, path)
    snapshots.merge(spark, path, spark.createDataFrame([(7, 1, "b")], SCHEMA), ["k"], ["at"])
    after = snapshots.manifest(spark, path)
    changed = [b for b in after["files"] if after["files"][b] != before["files"][b]]
    assert len(before["files"]) == 8 and len(changed) == 1
    assert len([p for p in (tmp_path / "t" / "data" / "2").iterdir() if p.is_dir()]) == 1
    assert table(spark, path)[7] == (1, "b") and table(spark, path, 1)[7] == (0, "a")
    snapshots.vacuum(spark, path, keep=1)
    assert table(spark, path)[7] == (1, "b") and snapshots.manifests(spark, path) == [2]
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, path, 1)


@pytest.mark.parametrize("dies", ["before data", "in data", "after data", "in manifest", "after rename"])
@pytest.mark.parametrize("first", [True, False])
def test_a_writer_that_dies(spark, tmp_path, monkeypatch, dies, first):
    path, old = str(tmp_path / "t"), {}
    if not first:
        snapshots.merge(spark, path, spark.createDataFrame([(1, 1, "a"), (2, 1, "a")], SCHEMA), ["k"], ["at"], 0)
        old = table(spark, path)
    batch = spark.createDataFrame([(2, 2, "b"), (3, 2, "b")], SCHEMA)
    new = old | {2: (2, "b"), 3: (2, "b")}

    class Died(Exception):
        pass

    def die(*_, **__):
        raise Died

    commit, keep = snapshots._commit, snapshots.latest
    with monkeypatch.context() as m:
        if dies == "before data":
            m.setattr(snapshots, "bucket_of", die)
        elif dies == "in data":  # a task fails on one of the rows, others may be written
            m.setattr(snapshots, "latest", lambda *a: keep(*a).selectExpr("* EXCEPT (v)", "CASE WHEN k = 3 THEN CAST(raise_error('lost') AS STRING) ELSE v END AS v"))
        elif dies == "after data":
            m.setattr(snapshots, "_commit", die)
        elif dies == "after rename":
            m.setattr(snapshots, "_commit", lambda *a: (commit(*a), die()))
        else:

            def torn(spark, path, found):
                fs, make = snapshots._fs(spark, path)
                out = fs.create(make(f"{path}/manifests/{found['version']:020d}.draft"), True)
                out.write(bytearray(b'{"version":'))
                out.close()
                die()

            m.setattr(snapshots, "_commit", torn)
        with pytest.raises(Exception, match="" if dies != "in data" else "lost"):
            snapshots.merge(spark, path, batch, ["k"], ["at"], 1)
    if dies == "after rename":
        assert table(spark, path) == new
    elif first:
        with pytest.raises(FileNotFoundError):
            snapshots.read(spark, path)
    else:
        assert table(spark, path) == old
    snapshots.merge(spark, path, batch, ["k"], ["at"], 1)
    assert table(spark, path) == new and snapshots.manifest(spark, path)["batch"] == 1
