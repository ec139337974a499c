"""A recorded feed: reconnects, restarts from the checkpoint, and the audit of its streams."""

import time

import pytest
from pyspark.sql import functions as F

from tapewise.plans import sources_queries
from tapewise.sources import feed, variants
from tapewise.streaming import audit

SF = "/root/testdata/sf0.001"


def socket(lines, breaks):
    """Opens where the last connection broke; breaks before the given messages, once each."""
    at, left = [0], set(breaks)

    def connect():
        while at[0] < len(lines):
            if at[0] in left:
                left.remove(at[0])
                raise ConnectionError
            at[0] += 1
            yield lines[at[0] - 1]

    return connect


def test_reconnects_with_growing_waits(tmp_path):
    waits = []
    tries = iter([ConnectionError, TimeoutError, ConnectionError])

    def connect():
        for e in tries:
            raise e
        yield "a\n b"
        yield ""

    journal = feed.Journal(f"file://{tmp_path}/f", most=10)
    assert feed.record(connect, journal, sleep=waits.append) == 2 and waits == [1.0, 2.0, 4.0]
    assert list(feed._Reader(f"file://{tmp_path}/f", 0).read(feed.Segment(0))) == [(0, 0, "a\n b"), (0, 1, "")]

    def dead():
        raise ConnectionError
        yield

    with pytest.raises(ConnectionError):
        feed.record(dead, journal, tries=9, sleep=waits.append)
    assert max(waits) == feed.LAST_WAIT and waits[3:6] == [1.0, 2.0, 4.0]


def test_what_was_heard_before_a_break_is_written(tmp_path):
    path = f"file://{tmp_path}/f"
    lines = [str(i) for i in range(25)]
    assert feed.record(socket(lines, {3, 4, 20}), feed.Journal(path, most=10), sleep=lambda s: None) == 25
    own = feed._Reader(path, 0)
    got = [v for n in range(feed.next_segment(path)) for _, _, v in own.read(feed.Segment(n))]
    assert got == lines
    assert feed.Journal(path).number == feed.next_segment(path)  # another writer goes on behind


def stream(spark, path, tmp_path, fails=False):
    rows = feed.messages(spark, path)
    if fails:
        rows = rows.withColumn("value", F.when(F.col("line") >= 0, F.raise_error(F.lit("lost"))).cast("string"))
    out = rows.writeStream.queryName("feed").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
    out.trigger(availableNow=True).start().awaitTermination(120)


def test_a_restart_neither_loses_nor_repeats(spark, tmp_path):
    """Messages made from ``events``, heard in three parts; the second run fails in its batch."""
    path = f"file://{tmp_path}/f"
    made = [r.value for r in sources_queries._wire_lines(spark, SF).orderBy("event_id").collect()]
    third = len(made) // 3
    listener = audit.Audit(spark, f"file://{tmp_path}/audit")
    spark.streams.addListener(listener)
    try:
        feed.record(socket(made[:third], {7, 8}), feed.Journal(path, most=50), sleep=lambda s: None)
        stream(spark, path, tmp_path)
        feed.record(socket(made[third : 2 * third], {1}), feed.Journal(path, most=50), sleep=lambda s: None)
        with pytest.raises(Exception, match="lost"):
            stream(spark, path, tmp_path, fails=True)
        feed.record(socket(made[2 * third :], set()), feed.Journal(path, most=50), sleep=lambda s: None)
        stream(spark, path, tmp_path)
        stream(spark, path, tmp_path)
        for _ in range(100):  # events come a little after a query's end
            if audit.read(spark, f"file://{tmp_path}/audit").where("kind = 'end'").count() == 4:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("segment", "line")
    assert [r.value for r in got.collect()] == made
    of = lambda lines: sorted((r.variant, r["count"]) for r in variants.parsed(lines.select(F.lit(1).alias("event_id"), "value")).groupBy("variant").count().collect())
    assert of(got) == of(sources_queries._wire_lines(spark, SF))

    at = f"file://{tmp_path}/audit"
    before = sorted(map(str, audit.read(spark, at).collect()))
    seen = audit.runs(audit.read(spark, at)).collect()
    assert sorted(r.state for r in seen) == ["ended", "ended", "ended", "failed"] and len({r.query_id for r in seen}) == 1
    assert {r.name for r in seen} == {"feed"} and sum(r.rows for r in seen if r.state == "ended") == len(made)
    assert audit.read(spark, at).where("kind = 'end' AND error LIKE '%lost%'").count() == 1 and listener.lost == 0
    audit.compact(spark, at)
    assert not list((tmp_path / "audit").glob("*.json"))
    (tmp_path / "audit" / "again.json").write_text('{"kind": "start"}')
    assert sorted(map(str, audit.read(spark, at).where("run_id IS NOT NULL").collect())) == before


def test_an_audit_that_cannot_write_stops_nothing(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    listener = audit.Audit(spark, f"file://{tmp_path}/file/below")
    listener._write("x", {"kind": "start"})
    assert listener.lost == 1
