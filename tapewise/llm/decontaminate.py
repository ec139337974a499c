"""Operator 5, benchmark decontamination by winnowing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewise.llm._common import documents, materialize, release, words

WINDOW = 13
#: Winnowing: k-grams of K words, the least hash of every WINDOW - K + 1 in a row.
K = 7
#: Up to so many bytes the benchmark's side is broadcast; beyond, joins shuffle.
BROADCAST_BYTES = 32 << 20


def gram_hashes(ws: Column, k: int) -> Column:
    """Hash of every run of ``k`` words; empty for shorter texts."""
    n = F.size(ws) - k
    return F.when(n >= 0, F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.xxhash64(F.slice(ws, i, k)))).otherwise(F.array().cast("array<long>"))


def winnow(ws: Column, k: int, t: int) -> Column:
    """Distinct least hashes of every window of ``t - k + 1`` consecutive
    k-grams. Two texts that share ``t`` words in a row share a value."""
    w = t - k + 1
    hashes = gram_hashes(ws, k)
    if w == 1:
        return F.array_distinct(hashes)
    # a fold over the hashes with the last w of them would allocate as much; slices stay within the row
    pick = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (w - 1)), lambda i: F.array_min(F.slice(h, i, w)))
    return F.when(F.size(ws) >= t, F.array_distinct(F.element_at(F.transform(F.array(hashes), pick), 1))).otherwise(F.array().cast("array<long>"))


def _sized(df: DataFrame, text: str | None = None) -> DataFrame:
    """``df``, to be broadcast if its summed bytes allow it: 48 for a row's
    numbers, and its text."""
    each = F.lit(48) if text is None else 64 + F.octet_length(text)
    return F.broadcast(df) if (df.agg(F.sum(each)).first()[0] or 0) <= BROADCAST_BYTES else df


def _shared_marks(lengths: list[int], window: int, k: int) -> list[tuple[int, int, int]]:
    """(least length, k, window) of the fingerprints for these word counts: one
    winnowing for all from ``k`` up, as the least hashes of longer windows are
    among those of shorter ones; k-grams of their own for shorter items."""
    long = [n for n in lengths if n >= k]
    return ([(min(long), k, min(long))] if long else []) + [(n, n, n) for n in lengths if n < k]


def _placed(ws: Column, n: int) -> Column:
    """(at, len, h, g) of every run of ``n`` words: 128 bits of hash tell runs apart."""
    each = lambda i: F.struct((i - 1).alias("at"), F.lit(n).alias("len"), *_marks(F.slice(ws, i, n)))
    none = F.array().cast("array<struct<at:int,len:int,h:bigint,g:bigint>>")
    return F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), each)).otherwise(none)


def _marks(run: Column) -> tuple[Column, Column]:
    return F.xxhash64(run).alias("h"), F.xxhash64(F.lit(1), run).alias("g")


def contamination(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``n_items``, ``item_list``
    (item ids as sorted strings) and ``contaminated``.

    A window is ``window`` consecutive words of an item (a shorter item that has
    words is one window). Winnowed fingerprints of documents and items are
    joined; by the winnowing guarantee every document with an occurrence of a
    window shares a fingerprint. The hits are extended in the documents found:
    each run of words whose 128 bits of hash are a window's is one, and the union
    of the runs is counted. Words never leave their document; joins carry places
    and hashes. Items of fewer than ``k`` words have
    k-grams of their own length, so that the guarantee holds for them too.

    Null texts have no words and no hits. Repeated rows get equal results; rows
    with equal ids but other texts are separate. Empty tables work. Columns
    named like new ones are replaced.
    """
    new = ("n_words", "n_hit", "n_items", "item_list", "contaminated")
    docs = docs.drop(*new, "_t", "_d", "_dt")
    ident = docs.select(F.col(doc).alias("d"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    bench = materialize(items.select(F.col(item).cast("string").alias("item"), words(F.col(item_text)).alias("ws")).where(F.size("ws") > 0), "items")
    size = F.least(F.size("ws"), F.lit(window))
    runs = bench.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("ws") - size + 1), lambda i: F.slice(F.col("ws"), i, size))).alias("run"))
    runs = materialize(runs.select("item", F.size("run").alias("len"), *_marks(F.col("run"))).distinct(), "windows")
    lengths = sorted(r[0] for r in runs.select("len").distinct().collect())  # window values at most
    shapes = _shared_marks(lengths, window, k)
    # fingerprints of all shapes in one pass over each side
    fingerprints = lambda held: F.explode(F.array_distinct(F.flatten(F.array(*held))) if held else F.array().cast("array<long>")).alias("f")
    own = [F.when((F.size("ws") >= least) if kk == k else (F.size("ws") == least), winnow(F.col("ws"), kk, t)).otherwise(F.array().cast("array<long>")) for least, kk, t in shapes]
    marks = materialize(bench.select(fingerprints(own)).distinct(), "marks")
    seeds = ident.select("d", "t", words(F.col("text")).alias("ws")).select("d", "t", fingerprints([winnow(F.col("ws"), kk, t) for _, kk, t in shapes]))
    found = materialize(seeds.join(_sized(marks), "f", "left_semi").select("d", "t").distinct(), "seeds")
    match = F.col("d").eqNullSafe(F.col("fd")) & (F.col("t") == F.col("ft"))
    held = ident.join(_sized(found.toDF("fd", "ft")), match, "left_semi").dropDuplicates(["d", "t"])
    held = materialize(held.select("d", "t", words(F.col("text")).alias("ws")), "found")
    each = [_placed(F.col("ws"), n) for n in lengths]
    grams = held.select("d", "t", F.explode(F.flatten(F.array(*each)) if each else F.array().cast("array<struct<at:int,len:int,h:bigint,g:bigint>>")).alias("g")).select("d", "t", "g.*")
    every = materialize(grams.join(_sized(runs.select("h", "g", "len").distinct()), ["h", "g", "len"]).select("d", "t", "at", "len", "h", "g"), "spans")
    release(bench, marks, found, held)
    covered = every.groupBy("d", "t").agg(F.sort_array(F.collect_set(F.struct("at", (F.col("at") + F.col("len")).alias("end")))).alias("s"))
    covered = covered.select("d", "t", _union_length(F.col("s")).alias("n_hit"))
    per_item = every.select("d", "t", "h", "g", "len").distinct().join(_sized(runs, "item"), ["h", "g", "len"])
    per_item = per_item.groupBy("d", "t").agg(F.sort_array(F.collect_set("item")).alias("item_list"))
    result = materialize(_both(covered, per_item), "hits")
    release(runs, every)
    same = F.col(doc).eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_dt"))
    out = docs.withColumns({"_t": F.xxhash64(text), "n_words": F.size(words(F.col(text))).cast("long")}).join(result, same, "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "item_list": F.coalesce("item_list", none)})
    out = out.withColumns({"n_items": F.size("item_list").cast("long"), "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))})
    return out.drop("_t", "_d", "_dt")


def _both(covered: DataFrame, per_item: DataFrame) -> DataFrame:
    """One row per document found; ids may be null, so a union and a group."""
    none = F.lit(None)
    rows = covered.select("d", "t", "n_hit", none.cast("array<string>").alias("item_list")).unionByName(per_item.select("d", "t", none.cast("int").alias("n_hit"), "item_list"))
    return rows.groupBy("d", "t").agg(F.max("n_hit").alias("n_hit"), F.first("item_list", ignorenulls=True).alias("item_list")).toDF("_d", "_dt", "n_hit", "item_list")


def _union_length(spans: Column) -> Column:
    """Number of places in the union of [at, end) spans sorted by ``at``."""
    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["to"], s["at"]))).alias("n"), F.greatest(a["to"], s["end"]).alias("to"))
    return F.aggregate(spans, begin, step, lambda a: a["n"])


def op5_winnow_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all of ``benchmark``, by 13-word windows."""
    out = contamination(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("item_list", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(_LOWER)

OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
bw AS (SELECT item, least(len(ws), {WINDOW}) AS n, unnest(list_transform(range(len(ws) - least(len(ws), {WINDOW}) + 1), lambda i: ws[i + 1 : i + least(len(ws), {WINDOW})])) AS run FROM b WHERE len(ws) > 0),
u AS (SELECT DISTINCT n, run FROM bw),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, unnest(range(len(ws) - n + 1)) AS pos, unnest(list_transform(range(len(ws) - n + 1), lambda i: ws[i + 1 : i + n])) AS run FROM d, lens WHERE len(ws) >= n),
hit AS (SELECT dw.r, dw.pos, dw.n, dw.run FROM dw JOIN u ON dw.n = u.n AND dw.run = u.run),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(pos, pos + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT hit.r, bw.item FROM hit JOIN bw ON hit.n = bw.n AND hit.run = bw.run) GROUP BY r)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN its USING (r)
"""
