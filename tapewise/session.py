"""A Spark session with the settings the library is written for."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def session(app: str = "tapewise", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins; ``conf`` (dots as ``__``) wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return builder.config(map=base | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share.

    That is ``spark.checkpoint.dir``; a local session that sets none gets a
    temporary folder, on a cluster it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master or ""):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tapewise-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{label}-{uuid.uuid4().hex}"
