"""Timeline JSON to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VARIANTS = "array<struct<bitrate:int,content_type:string,url:string>>"
_POST = f"struct<id:string,handle:string,text:string,created_at:string,pinned:boolean,media:array<struct<url:string,variants:{_VARIANTS}>>>"


def posts(lines: DataFrame) -> DataFrame:
    """Posts of all timelines in ``value``, one row an id; those without an id
    are skipped. A video's address is its mp4 of the highest bitrate."""
    best = lambda v: F.array_max(F.transform(F.filter(v, lambda x: x["content_type"] == "video/mp4"), lambda x: F.struct(F.coalesce(x["bitrate"], F.lit(0)).alias("b"), x["url"].alias("u"))))["u"]
    p = lines.select(F.explode(F.from_json("value", f"array<{_POST}>")).alias("p")).where("p.id IS NOT NULL AND p.id <> ''")
    media = F.array_distinct(F.filter(F.transform(F.coalesce("p.media", F.array().cast(f"array<struct<url:string,variants:{_VARIANTS}>>")), lambda m: F.coalesce(best(m["variants"]), m["url"])), lambda u: u.isNotNull()))
    rows = p.select("p.id", "p.handle", "p.text", F.try_to_timestamp(F.regexp_replace("p.created_at", "^[A-Za-z]+ ", ""), F.lit("MMM dd HH:mm:ss Z yyyy")).alias("created_at"), F.coalesce("p.pinned", F.lit(False)).alias("pinned"), media.alias("media"), F.concat(F.lit("https://x.example/"), "p.handle", F.lit("/status/"), "p.id").alias("url"))
    return rows.dropDuplicates(["id"])
