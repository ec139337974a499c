"""Operator 3, document fingerprints: threshold-scaled shingle sketches.

A sketch keeps every shingle hash below a fixed fraction of the hash space, so
its size follows the document's, the union of sketches is the sketch of the
union, and containment can be estimated between documents of any sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewise.llm._common import documents, materialize, words

SHINGLE = 5
#: One hash in SCALE is kept.
SCALE = 4
_SPACE = 1 << 32


def sketch(text: Column, k: int = SHINGLE, scale: int = SCALE) -> Column:
    """Ascending distinct 32-bit hashes below 2^32 / ``scale`` of all ``k``-word
    shingles. A text of fewer words is one shingle; one without words has an
    empty sketch. Equal texts have equal sketches."""
    ws = words(text)
    return F.element_at(F.transform(F.array(ws), lambda w: _kept(w, k, scale)), 1)


def whole_sketch(text: Column, k: int = SHINGLE, scale: int = SCALE) -> Column:
    """``sketch``, or the least hash alone where no hash is below the limit, so
    that only a text without words has an empty one. The least hash of a union
    is the least of its parts', so sketches can still be merged: a hash above the
    limit goes where the union has one below it, see ``merge_whole``."""
    ws = words(text)
    return F.element_at(F.transform(F.array(ws), lambda w: _least(_hashes(w, k), scale)), 1)


def _below(hashes: Column, scale: int) -> Column:
    return F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < _SPACE // scale)))


def _least(hashes: Column, scale: int) -> Column:
    def chosen(hs: Column) -> Column:
        low = F.filter(hs, lambda h: h < _SPACE // scale)
        return F.when(F.size(low) > 0, F.array_sort(F.array_distinct(low))).otherwise(F.slice(F.array_sort(hs), 1, 1))

    return F.element_at(F.transform(F.array(hashes), chosen), 1)


def merge_whole(sketches: Column, scale: int = SCALE) -> Column:
    """Whole sketch of the union of an array of whole sketches."""
    return _least(F.flatten(sketches), scale)


def _kept(ws: Column, k: int, scale: int) -> Column:
    return _below(_hashes(ws, k), scale)


def _hashes(ws: Column, k: int) -> Column:
    n = F.size(ws)
    length = F.least(n, F.lit(k))
    starts = F.when(n > 0, F.sequence(F.lit(1), n - length + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(ws, i, length)).bitwiseAND(F.lit(_SPACE - 1)))


def common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity; two empty sketches count as 0."""
    both = common(a, b)
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0)).cast("double")


def containment(a: Column, b: Column) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has; 0 for an empty one."""
    return F.when(F.size(a) > 0, common(a, b) / F.size(a)).otherwise(F.lit(0.0)).cast("double")


def merge(sketches: Column) -> Column:
    """Sketch of the union of an array of sketches."""
    return F.array_sort(F.array_distinct(F.flatten(sketches)))


def hexed(a: Column) -> Column:
    """A sketch as text: eight hex digits a hash, ascending."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 8, "0"))), "")


def with_next(docs: DataFrame, doc: str, text: str, max_spans: int = 16384, rows_a_span: int = 2000) -> DataFrame:
    """``docs`` with ``next_text``: the text of the next row by descending
    ``doc`` (equal ids by the text's hash, nulls last); the last row's next is
    the first one, a single row's next itself.

    Rows go once to id spans between approximate quantiles, ``max_spans`` at
    most, so what the driver and the plan hold of them is bounded. Inside a span
    a window looks one row ahead; the first row of the span below is put behind
    its last row, so no task needs more than its span.
    """
    t = F.xxhash64(text)
    n = docs.count()
    spans = max(1, min(max_spans, -(-n // rows_a_span)))
    cuts = docs.select(F.percentile_approx(doc, [i / spans for i in range(1, spans)], 8 * spans).alias("q")).first()["q"] if spans > 1 else []
    placed = docs.withColumns({"_span": _span(F.col(doc), sorted(set(cuts or []))), "_t": t, "_ghost": F.lit(0)})
    lead_of = placed.groupBy("_span").agg(F.max(F.struct(F.col(doc).alias("d"), F.col("_t").alias("t"))).alias("h"))
    order = Window.orderBy(F.desc("_span"))
    firsts = lead_of.select("_span", F.col("h.d").alias("_hd"), F.col("h.t").alias("_ht"))
    above = firsts.withColumn("_to", F.lag("_span").over(order))
    lowest = firsts.agg(F.min("_span").alias("_low"))
    above = F.broadcast(above.crossJoin(F.broadcast(lowest)).select(F.coalesce("_to", "_low").alias("_to"), "_hd", "_ht"))
    match = F.col(doc).eqNullSafe(F.col("_hd")) & (F.col("_t") == F.col("_ht"))
    ghosts = placed.join(above, match).dropDuplicates(["_to"]).withColumns({"_span": F.col("_to"), "_ghost": F.lit(1)}).select(placed.columns)
    inside = Window.partitionBy("_span").orderBy("_ghost", F.desc_nulls_last(doc), F.desc("_t"))
    ahead = placed.unionByName(ghosts).withColumn("next_text", F.lead(text).over(inside))
    return ahead.where(F.col("_ghost") == 0).drop("_span", "_t", "_ghost")


def _span(d: Column, cuts: list[int]) -> Column:
    """Number of ascending ``cuts`` below ``d``, looked up in two levels; -1 for null."""
    if not cuts:
        return F.when(d.isNull(), F.lit(-1)).otherwise(F.lit(0))
    step = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    block = F.size(F.filter(longs([b[-1] for b in blocks]), lambda c: c < d))
    fine = F.size(F.filter(F.get(F.array(*map(longs, blocks)), block), lambda c: c < d))
    return F.when(d.isNull(), F.lit(-1)).otherwise(block * step + F.when(block < len(blocks), fine).otherwise(0))


def op3_scaled_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of all whole documents and of their edited texts.

    ``near_*`` are Jaccard estimates; ``contained_*`` the share of this
    document's shingles found in the other text."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    rows = with_next(docs, "doc_id", "text").withColumn("edited", F.concat(F.left("text", n - half), F.left("next_text", half)))
    return likeness(rows)


def likeness(rows: DataFrame) -> DataFrame:
    """Sketches and estimates of rows with ``text``, ``edited`` and ``next_text``.

    Equal texts have likeness 1 whatever their sketches hold."""
    sketches = {"own": whole_sketch(F.col("text")), "new": whole_sketch(F.col("edited")), "next": whole_sketch(F.col("next_text"))}
    same = {f"same_{k}": F.col("text") == F.col(v) for k, v in (("new", "edited"), ("next", "next_text"))}
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), *(v.alias(k) for k, v in {**sketches, **same}.items()))
    found = {}
    for name, measure in (("near", jaccard), ("contained", containment)):
        for of, other in (("edited", "new"), ("next", "next")):
            found[f"{name}_{of}"] = F.when(F.col(f"same_{other}"), F.lit(1.0)).otherwise(measure(F.col("own"), F.col(other)))
    return rows.select("doc_id", "n_chars", "edited_sha256", hexed(F.col("own")).alias("fingerprint"), hexed(F.col("new")).alias("edited_fingerprint"), *(v.alias(k) for k, v in found.items()))
