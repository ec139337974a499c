"""Operator 4, line dedup by range-partitioned hashes with secondary sort.

Only 128-bit line hashes with document and position travel; what comes back to
the documents is a compressed keep bitmap, never a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewise.llm._common import ascii_lower, documents, materialize, release

MIN_CHARS = 40
MIN_DOCS = 5
#: A key with more rows than the whole number of rows over this is handled as hot: there can be at most so many.
HOT_SHARE = 4096


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(" \t\n\x0b\f\r")))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, doc: str, text: str, min_chars: int) -> DataFrame:
    """(h1, h2, doc, t, pos) of every line whose key is long enough; t tells
    apart other texts under the same document id."""
    pos = F.posexplode(_lines(F.col(text))).alias("pos", "line")
    long = docs.where(F.length(text) >= min_chars).select(F.col(doc).alias("doc"), F.xxhash64(text).alias("t"), pos).where(F.length("line") >= min_chars)
    keyed = long.select("doc", "t", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key", F.length("key")).alias("h2"), "doc", "t", "pos")


def drop_bitmaps(docs: DataFrame, doc: str, text: str, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, t, dropped) for each document that loses lines; ``dropped`` is a
    run-length bitmap of line positions: (first, last) pairs, ascending.

    Keys that hold over one in ``HOT_SHARE`` of all line rows (so at most
    ``HOT_SHARE`` keys, a proven bound for their broadcast) are settled by a
    pre-combined count; their rows never meet. All other rows are
    range-partitioned by hash with secondary sort by document and position, and
    one pass over each sorted key keeps the first document's lines.
    """
    spark = docs.sparkSession
    rows = materialize(line_hashes(docs, doc, text, min_chars), "lines")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot_from = max(1000, rows.count() // HOT_SHARE)
    often = rows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") > hot_from).select("h1", "h2")
    hot_keys = materialize(often, "hot-lines")
    often = F.broadcast(hot_keys)
    held = rows.join(often, ["h1", "h2"]).groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one"))
    hot = held.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc").alias("keep")).where(F.col("docs") >= min_docs)
    lost_hot = rows.join(F.broadcast(hot), ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("keep"))).select("doc", "t", "pos")
    cold = rows.join(often, ["h1", "h2"], "left_anti").repartitionByRange(n, "h1", "h2").sortWithinPartitions("h1", "h2", F.desc("doc"), "pos")
    key = Window.partitionBy("h1", "h2")
    streamed = cold.withColumn("nth", F.dense_rank().over(key.orderBy(F.desc("doc")))).withColumn("docs", F.max("nth").over(key))
    lost_cold = streamed.where((F.col("docs") >= min_docs) & (F.col("nth") > 1)).select("doc", "t", "pos")
    lost = lost_hot.unionByName(lost_cold).groupBy("doc", "t").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    out = materialize(lost.select("doc", "t", _runs(F.col("at")).alias("dropped")), "bitmaps")
    release(rows, hot_keys)
    return out


def _runs(at: Column) -> Column:
    """Ascending positions as (first, last) runs."""
    n = F.size(at)
    order = F.sequence(F.lit(1), n)
    firsts = F.filter(order, lambda i: (i == 1) | (F.get(at, i - 1) != F.get(at, i - 2) + 1))
    lasts = F.filter(order, lambda i: (i == n) | (F.get(at, i) != F.get(at, i - 1) + 1))
    return F.zip_with(firsts, lasts, lambda a, b: F.struct(F.get(at, a - 1).alias("first"), F.get(at, b - 1).alias("last")))


def dedup_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped``.

    A line whose key has at least ``min_chars`` code points and is found in at
    least ``min_docs`` documents stays only in the largest document holding it,
    there at every place. A null text counts as one empty line. Rows of the same
    document id are one document for the counts and lose the same positions.
    A null document id is a document, smaller than any other. An empty table
    gives no rows. Columns with the names of the new ones are replaced.
    """
    docs = docs.drop("kept_text", "n_lines", "n_dropped", "_t", "_doc", "_dt", "_dropped", "_lines")
    lost = drop_bitmaps(docs, doc, text, min_chars, min_docs).toDF("_doc", "_dt", "_dropped")
    same = F.col(doc).eqNullSafe(F.col("_doc")) & (F.col("_t") == F.col("_dt"))
    # one plan at every size: documents move once, whether or not the bitmaps are few enough to broadcast
    joined = docs.withColumn("_t", F.xxhash64(text)).join(lost.hint("merge"), same, "left").withColumn("_lines", _lines(F.col(text)))
    runs = F.col("_dropped")
    kept = F.when(runs.isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(_kept(F.col("_lines"), runs), "\n"))
    new = {"kept_text": kept, "n_lines": F.size("_lines").cast("long"), "n_dropped": F.coalesce(_n_dropped(runs), F.lit(0)).cast("long")}
    return joined.withColumns(new).drop("_t", "_doc", "_dt", "_dropped", "_lines")


def _n_dropped(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"] + 1)


def _kept(lines: Column, runs: Column) -> Column:
    """Lines between the dropped runs."""
    n = F.size(runs)
    gaps = F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.struct(
            F.when(i == 0, F.lit(0)).otherwise(F.get(runs, i - 1)["last"] + 1).alias("first"),
            F.when(i == n, F.size(lines)).otherwise(F.get(runs, i)["first"]).alias("end"),
        ),
    )
    return F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["first"] + 1, g["end"] - g["first"])))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup of all whole documents; the kept text's SHA-256 per document."""
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


_KEY = "translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT r, doc_id, pos, line, {_KEY} AS key FROM l),
g AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
j AS (SELECT k.*, (g.key IS NOT NULL AND k.doc_id <> g.keep) AS lost FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM j GROUP BY r, doc_id
"""
