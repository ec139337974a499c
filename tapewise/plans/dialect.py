"""One query text for Spark SQL and for DuckDB.

``@table`` is a Parquet table of the data folder, a view's name stands for a
common table expression of ``views.VIEWS``; ``$us(x)`` is the microseconds since
the epoch of a naive timestamp and ``$json(x, key)`` a top-level JSON string.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapewise.plans.views import VIEWS

_SPARK = [
    (r"\$us\(([^()]*)\)", r"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', \1)"),
    (r"\$ts\(([^()]*)\)", r"timestampadd(MICROSECOND, \1, TIMESTAMP_NTZ'1970-01-01 00:00:00')"),
    (r"\$json\(([^(),]*), (\w+)\)", r"get_json_object(\1, '$.\2')"),
    (r"\$days\(([^()]*)\)", r"datediff(\1, DATE'1970-01-01')"),
    (r"\$list\(([^()]*)\)", r"array_join(transform(array_sort(collect_list(\1)), x -> cast(x as string)), ',')"),
    (r"\$try\(([^()]*)\)", r"try_cast(\1 AS DOUBLE)"),
]
_DUCK = [
    (r"\$us\(([^()]*)\)", r"epoch_us(\1)"),
    (r"\$ts\(([^()]*)\)", r"make_timestamp(\1)"),
    (r"\$json\(([^(),]*), (\w+)\)", r"json_extract_string(\1, '$.\2')"),
    (r"\$days\(([^()]*)\)", r"datediff('day', DATE '1970-01-01', \1)"),
    (r"\$list\(([^()]*)\)", r"string_agg(CAST(\1 AS STRING), ',' ORDER BY \1)"),
    (r"\$try\(([^()]*)\)", r"TRY_CAST(\1 AS DOUBLE)"),
]


def with_views(sql: str) -> str:
    """``sql`` headed by the views it names, in the order they need."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in sorted(set(re.findall(r"\b\w+_v\b", text))):
            if name in VIEWS and name not in order:
                visit(VIEWS[name])
                order.append(name)

    visit(sql)
    heads = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in order)
    body = sql.strip()
    if not heads:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {heads},\n{body[5:]}"
    return f"WITH {heads}\n{body}"


def _rounds(sql: str) -> str:
    """Every ROUND to places after the point as DuckDB has it: the double times ten
    to the places, to the nearest whole (halves away from zero), divided again.
    Spark's own rounds the shortest decimal that reads as the double, so the two
    part where a value lies next to a half."""
    found = re.search(r"\bROUND\(", sql)
    if not found:
        return sql
    start = at = found.end()
    depth, comma = 1, None
    while depth:
        depth += {"(": 1, ")": -1}.get(sql[at], 0)
        comma = at if sql[at] == "," and depth == 1 else comma
        at += 1
    if comma is None or int(sql[comma + 1 : at - 1]) < 1:
        return sql[:start] + _rounds(sql[start:])
    x, scale = _rounds(sql[start:comma]), f"1e{int(sql[comma + 1 : at - 1])}"
    return f"{sql[: found.start()]}(ROUND(({x}) * {scale}) / {scale}){_rounds(sql[at:])}"


def duck(sql: str) -> str:
    text = with_views(sql)
    for pattern, by in _DUCK:
        text = re.sub(pattern, by, text)
    return re.sub(r"@(\w+)", r"\1", text)


def spark(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    text = _rounds(with_views(sql))
    for pattern, by in _SPARK:
        text = re.sub(pattern, by, text)

    def run(session: SparkSession, sf_dir: str) -> DataFrame:
        return session.sql(re.sub(r"@(\w+)", rf"parquet.`{sf_dir}/\1.parquet`", text))

    return run


def view(session: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain view as a DataFrame."""
    return spark(f"SELECT * FROM {name}")(session, sf_dir)
