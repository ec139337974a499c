"""A message feed recorded as numbered segments, and a Spark stream that reads them.

A socket can't be asked again, so ``record`` writes what it hears before anything
reads it; the stream's offsets are segment numbers, and a batch that is made again
reads the same segments.
"""

from __future__ import annotations

import io
import json
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Waits between two attempts to connect: doubled up to the last, reset by a message.
FIRST_WAIT, LAST_WAIT = 1.0, 60.0


def _name(root: str, number: int) -> str:
    return f"{root}/{number:012d}.jsonl"


def _is_there(fs: pafs.FileSystem, name: str) -> bool:
    return fs.get_file_info(name).type == pafs.FileType.File


def next_segment(path: str, start: int = 0) -> int:
    """The first number from ``start`` on that isn't written; asks only for what is new."""
    fs, root = pafs.FileSystem.from_uri(path)
    while _is_there(fs, _name(root, start)):
        start += 1
    return start


class Journal:
    """Appends messages to the feed at ``path`` in segments of ``most`` messages,
    each renamed into place when it is whole. One writer at a time; one that
    starts again goes on after the last whole segment."""

    def __init__(self, path: str, most: int = 1000, start: int = 0):
        self.fs, self.root = pafs.FileSystem.from_uri(path)
        self.fs.create_dir(self.root)
        self.most, self.held = most, []
        self.number = next_segment(path, start)

    def add(self, message: str) -> None:
        self.held.append(message)
        if len(self.held) >= self.most:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        draft = f"{self.root}/.{uuid.uuid4().hex}.draft"
        with self.fs.open_output_stream(draft) as out:
            for m in self.held:
                out.write(json.dumps(m).encode() + b"\n")
        self.fs.move(draft, _name(self.root, self.number))
        self.number, self.held = self.number + 1, []


def record(connect: Callable[[], Iterable[str]], journal: Journal, tries: int | None = None, sleep: Callable[[float], None] = time.sleep) -> int:
    """Write every message of the socket that ``connect`` opens and subscribes.

    A lost connection is opened again after a wait that doubles; what came before
    is written first. Ends when a connection ends by itself, or raises when
    ``tries`` attempts in a row brought nothing. Returns the messages heard."""
    heard, wait, failed = 0, FIRST_WAIT, 0
    while True:
        try:
            for message in connect():
                journal.add(message)
                heard, wait, failed = heard + 1, FIRST_WAIT, 0
            journal.flush()
            return heard
        except (ConnectionError, TimeoutError):
            journal.flush()
            failed += 1
            if tries is not None and failed >= tries:
                raise
            sleep(wait)
            wait = min(wait * 2, LAST_WAIT)


class Segment(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


class FeedSource(DataSource):
    """Options: ``path``; ``start``, the first segment to read (0)."""

    @classmethod
    def name(cls) -> str:
        return "message_feed"

    def schema(self) -> str:
        return "segment bigint, line int, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Reader(self.options["path"], int(self.options.get("start", 0)))


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str, start: int):
        self.path, self.start, self.known = path, start, start

    def initialOffset(self) -> dict:  # noqa: N802
        return {"segment": self.start}

    def latestOffset(self) -> dict:  # noqa: N802
        self.known = next_segment(self.path, self.known)
        return {"segment": self.known}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        self.known = max(self.known, end["segment"])
        return [Segment(n) for n in range(start["segment"], end["segment"])]

    def read(self, part: Segment) -> Iterator[tuple]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_stream(_name(root, part.number)) as f:
            for i, line in enumerate(io.BufferedReader(f)):
                yield part.number, i, json.loads(line)


def messages(spark: SparkSession, path: str, start: int = 0):
    """The feed as a stream of (segment, line, value)."""
    spark.dataSource.register(FeedSource)
    return spark.readStream.format("message_feed").option("path", path).option("start", str(start)).load()
