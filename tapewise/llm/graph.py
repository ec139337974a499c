"""Connected components of a link table, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewise.llm._common import materialize, release


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node of ``links``: the least node reachable.

    Every round hooks each node to its neighbours' least label and then each
    label to its own label; both halve long paths, so rounds grow with the
    logarithm of the longest one. Each round is a written table that replaces
    the one before. Counts are combined before they are shuffled, so a node with
    very many links costs no more than its rows.
    """
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    both = materialize(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    label = held = materialize(both.groupBy("x").agg(F.least("x", F.min("y")).alias("comp")).select(F.col("x").alias("node"), "comp"), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("y"), "comp"), "y").groupBy("x").agg(F.min("comp").alias("near"))
        hooked = label.join(near, label.node == near.x, "left").select("node", F.col("comp").alias("old"), F.least("comp", F.coalesce("near", "comp")).alias("comp"))
        up = label.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        new = materialize(hooked.join(up, "comp", "left").select("node", "old", F.least("comp", F.coalesce("up", "comp")).alias("comp")), "labels")
        release(held)
        held, label = new, new.select("node", "comp")
        if new.where("old <> comp").isEmpty():
            release(both)
            label._scratch = new._scratch
            return label
