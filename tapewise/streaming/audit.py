"""What streams did, as a table: start, progress and end of every query.

Events come to the driver one by one, so each is a small JSON file, renamed into
place under a name that says which event it is; ``compact`` makes Parquet of them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tapewise.operators.snapshots import _fs

SCHEMA = "kind string, query_id string, run_id string, name string, batch_id bigint, at timestamp, rows bigint, rows_per_second double, state_rows bigint, late_rows bigint, watermark timestamp, sources string, error string"


class Audit(StreamingQueryListener):
    """A listener that writes to ``path``; an event that can't be written is
    counted in ``lost`` and never stops a query."""

    def __init__(self, spark: SparkSession, path: str):
        self.fs, self.make = _fs(spark, path)
        self.path, self.lost = path, 0

    def _write(self, name: str, row: dict) -> None:
        try:
            draft = self.make(f"{self.path}/.{uuid.uuid4().hex}")
            out = self.fs.create(draft, True)
            out.write(bytearray(json.dumps(row).encode()))
            out.close()
            if not self.fs.rename(draft, self.make(f"{self.path}/{name}.json")):
                self.fs.delete(draft, False)  # the event is there already
        except Exception:
            self.lost += 1

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._write(f"{event.runId}-start", {"kind": "start", "query_id": str(event.id), "run_id": str(event.runId), "name": event.name, "at": event.timestamp})

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        row = {"kind": "progress", "query_id": str(p.id), "run_id": str(p.runId), "name": p.name, "batch_id": p.batchId, "at": p.timestamp}
        row |= {"rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "watermark": p.eventTime.get("watermark")}
        row |= {"state_rows": sum(s.numRowsTotal for s in p.stateOperators), "late_rows": sum(s.numRowsDroppedByWatermark for s in p.stateOperators)}
        row["sources"] = json.dumps([{"description": s.description, "start": s.startOffset, "end": s.endOffset} for s in p.sources])
        self._write(f"{p.runId}-{p.batchId:012d}-{uuid.uuid4().hex[:8]}", row)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._write(f"{event.runId}-end", {"kind": "end", "query_id": str(event.id), "run_id": str(event.runId), "error": event.exception})


def read(spark: SparkSession, path: str) -> DataFrame:
    """All events, those compacted too, each once; ``at`` of an end is null."""
    new = spark.read.schema(SCHEMA).json(f"{path}/*.json")
    fs, make = _fs(spark, path)
    if fs.exists(make(f"{path}/compacted")):
        new = new.unionByName(spark.read.schema(SCHEMA).parquet(f"{path}/compacted"))
    return new.distinct()


def compact(spark: SparkSession, path: str) -> None:
    """Append the small files to Parquet, then delete them; a run that dies in
    between leaves some in both places, which ``read`` shows once."""
    fs, make = _fs(spark, path)
    names = [s.getPath() for s in fs.listStatus(make(path)) if s.getPath().getName().endswith(".json")]
    if not names:
        return
    spark.read.schema(SCHEMA).json([n.toString() for n in names]).coalesce(1).write.mode("append").parquet(f"{path}/compacted")
    for n in names:
        fs.delete(n, False)


def runs(events: DataFrame) -> DataFrame:
    """A row a run: batches, rows, the time of the first and last event, how it ended."""
    last = F.when(F.count_if(F.col("kind") == "end") == 0, "running").when(F.count("error") > 0, "failed").otherwise("ended")
    return events.groupBy("query_id", "run_id").agg(F.max("name").alias("name"), F.count_distinct(F.when(F.col("kind") == "progress", F.col("batch_id"))).alias("batches"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), last.alias("state"))
