"""A paged REST service as a Spark data source, one partition a time range.

Pages advance by time; a row whose hash came on an earlier page is dropped, rows
of one page are kept as they are. Calls are spaced and retried with doubling
waits, inside the reader, so a lost task just reads its range again.
"""

from __future__ import annotations

import json
import time
from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Retryable(Exception):
    """An answer worth asking for again (busy or broken server)."""


def call(fetch: Callable[[], list[dict]], tries: int = 5, first_wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> list[dict]:
    for i in range(tries):
        try:
            return fetch()
        except Retryable:
            if i + 1 == tries:
                raise
            sleep(first_wait * 2**i)
    return []


def pages(fetch: Callable[[int, int], list[dict]], start: int, end: int, page_rows: int, gap: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """Rows of [start, end] by pages of at most ``page_rows``. A full page asks
    again from its last time, which may go on there; where that brings nothing
    new, from the next. Rows without a hash are told apart by their place among
    the equal rows of a time."""
    seen: set[str] = set()
    at, given = start, Counter()
    while at <= end:
        rows = call(lambda at=at: fetch(at, end), sleep=sleep)
        here: Counter[str] = Counter()
        fresh = []
        for r in rows:
            if r["hash"] is not None:
                if r["hash"] not in seen:
                    fresh.append(r)
                continue
            mark = json.dumps(r, sort_keys=True, default=str)
            here[mark] += 1
            if here[mark] > given[mark]:
                fresh.append(r)
        yield from fresh
        if len(rows) < page_rows:
            return
        seen |= {r["hash"] for r in rows if r["hash"] is not None}
        last = max(r["time"] for r in rows)
        if last < at:
            return
        at = last if fresh else last + 1
        # the page asked for next can only repeat rows of its first time
        given = Counter({m: n for m, n in (given | here).items() if json.loads(m)["time"] >= at})
        if gap:
            sleep(gap)


class Range(InputPartition):
    def __init__(self, start: int, end: int):
        super().__init__((start, end))
        self.start, self.end = start, end


class PagedSource(DataSource):
    """Options: ``opener`` (``module:function`` that gives fetch(start, end)),
    ``start``, ``end``, ``ranges``, ``page_rows``."""

    @classmethod
    def name(cls) -> str:
        return "paged_fills"

    def schema(self) -> str:
        return "hash string, time bigint, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self) -> list[Range]:
        start, end, n = (int(self.options.get(k, d)) for k, d in (("start", 0), ("end", 0), ("ranges", 1)))
        step = max(1, -(-(end - start + 1) // n))
        return [Range(a, min(a + step - 1, end)) for a in range(start, end + 1, step)]

    def read(self, part: Range) -> Iterator[tuple]:
        import importlib

        module, function = self.options["opener"].split(":")
        fetch = getattr(importlib.import_module(module), function)()
        for row in pages(fetch, part.start, part.end, int(self.options.get("page_rows", 2000))):
            yield row["hash"], row["time"], json.dumps(row)


def demo():
    """A service of its own: one row for every tenth millisecond."""
    return lambda start, end: [{"hash": f"0x{t:x}", "time": t} for t in range(-(-start // 10) * 10, end + 1, 10)][:50]
