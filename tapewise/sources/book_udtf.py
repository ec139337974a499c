"""Order-book lines as rows of levels for SQL: ``lines, LATERAL book_levels(value)``.

A line stands for itself, so the function takes no PARTITION BY: lines stay where
they are and a frequent coin is as many tasks as its lines are. For metrics alone
``orderbook.snapshots`` is faster, as it stays in the JVM.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

RETURNS = "coin string, ms bigint, side string, level int, px double, sz double, n int, error string"


def _number(x: object) -> float | None:
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


def _books(line: dict) -> dict:
    """The snapshot that a line is, or holds in ``data`` or as text in ``raw``."""
    if isinstance(line.get("raw"), str) and "data" not in line:
        line = json.loads(line["raw"])
    return line.get("data", line)


class BookLevels:
    """One row a level, from the best; one with side and level null for a snapshot
    without any, and one with ``error`` for a line that is no snapshot."""

    def eval(self, value: str | None) -> Iterator[tuple]:
        if value is None or not value.strip():
            return
        try:
            read = json.loads(value)
            rows = [r for one in (read if isinstance(read, list) else [read]) for r in self.levels(_books(one))]
        except (ValueError, TypeError, KeyError, AttributeError, OverflowError) as e:
            yield None, None, None, None, None, None, None, type(e).__name__
            return
        yield from rows

    @staticmethod
    def levels(book: dict) -> Iterator[tuple]:
        coin, ms, sides = str(book["coin"]), int(book["time"]), book["levels"]
        if not any(sides):
            yield coin, ms, None, None, None, None, None, None
        for side, held in zip(("bid", "ask"), sides, strict=False):
            for i, x in enumerate(held or (), 1):
                yield coin, ms, side, i, _number(x.get("px")), _number(x.get("sz")), x.get("n"), None


def register(spark: SparkSession) -> None:
    spark.udtf.register("book_levels", udtf(BookLevels, returnType=RETURNS))
