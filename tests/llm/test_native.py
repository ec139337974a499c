"""Line dedup, decontamination, fingerprints and sharding against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tapewise.llm.decontaminate import contamination
from tapewise.llm.fingerprint import containment, hexed, jaccard, likeness, merge, merge_whole, sketch, whole_sketch, with_next
from tapewise.llm.line_dedup import dedup_lines
from tapewise.llm.sharding import jump_shard, shard_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return WORD.findall(lower(t))


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


LONG = "a shared line that is long enough to count, ÄÖ and more"


def lines_of(rows):
    held = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            key = lower(line.strip(" \t\n\x0b\f\r"))
            if len(key) >= 40:
                held[key].add(d)
    keep = {k: max((x for x in v if x is not None), default=None) for k, v in held.items() if len(v) >= 5}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if (k := lower(x.strip(" \t\n\x0b\f\r"))) not in keep or keep[k] == d]
        out.append((d, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


def test_line_dedup(spark):
    rng = random.Random(3)
    pool = [LONG, "  " + LONG.upper().replace("ÄÖ", "äö") + "\t", "short", "", LONG + " two", "é" * 40, "b" * 39]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 6)))) for i in range(40)]
    rows += [(None, LONG), (7, None), (8, ""), (40, LONG + "\n" + LONG), (40, LONG + "\n" + LONG), (41, "x" * 50_000 + "\n" + LONG)]
    got = dedup_lines(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got), key=repr) == lines_of(rows)


def test_line_dedup_hot_key(spark, monkeypatch):
    """Keys over the hot threshold go the other way to the same result."""
    from tapewise.llm import line_dedup

    monkeypatch.setattr(line_dedup, "HOT_SHARE", 1)
    monkeypatch.setattr(line_dedup, "max", lambda a, b: 10, raising=False)
    rows = [(i, LONG + "\n" + (LONG + " b") * (i % 3 == 0)) for i in range(30)]
    got = dedup_lines(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got), key=repr) == lines_of(rows)


def test_line_dedup_empty_and_clashing(spark):
    assert dedup_lines(frame(spark, [])).count() == 0
    rows = [(i, LONG, "mine", 5) for i in range(6)]
    got = dedup_lines(frame(spark, rows, SCHEMA + ", kept_text string, pos int")).collect()
    assert sorted(r.n_dropped for r in got) == [0, 1, 1, 1, 1, 1] and all(r.pos == 5 for r in got)


def overlap(rows, items, window=13):
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for i, x in items:
            q = words(x)
            n = min(len(q), window)
            for a in range(len(q) - n + 1) if q else ():
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == q[a : a + n]:
                        hit |= set(range(b, b + n))
                        found.add(str(i))
        out.append((d, len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_decontamination(spark):
    rng = random.Random(5)
    vocab = ["the", "a", "Of", "naïve", "x1", "to", "zz"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([3, 5, 12, 13, 14, 25, 40]))) for i in range(12)] + [(90, None), (91, ""), (92, "!?"), (93, text(13))]
    rows = [(i, text(rng.randrange(0, 60))) for i in range(25)]
    rows += [(100 + i, text(20) + ", " + (items[i][1] or "").upper() + ". " + text(15)) for i in range(12)]
    rows += [(None, items[3][1]), (200, None), (201, ""), (202, "the " * 300), (203, items[5][1]), (203, items[5][1]), (203, "other")]
    got = contamination(frame(spark, rows), frame(spark, items, "item_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.item_list), r.contaminated) for r in got), key=repr) == overlap(rows, items)


def test_decontamination_empty_sides(spark):
    docs, none = frame(spark, [(1, "a b c")]), frame(spark, [], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in contamination(docs, none).collect()] == [(3, 0, False)]
    assert contamination(frame(spark, []), frame(spark, [(1, "a b")], "item_id long, text string")).count() == 0
    clash = docs.withColumns({"n_hit": F.lit("mine"), "d": F.lit(1), "h": F.lit(2)})
    assert contamination(clash, frame(spark, [(1, "a b")], "item_id long, text string")).first().n_hit == 2


def kept(t, k=5, scale=4):
    w = words(t)
    n = min(k, len(w))
    out = set()
    for i in range(len(w) - n + 1) if w else ():
        h = 42
        for x in w[i : i + n]:
            h = xxhash.xxh64_intdigest(x.encode(), h)
        if (h & 0xFFFFFFFF) < (1 << 32) // scale:
            out.add(h & 0xFFFFFFFF)
    return out


def test_fingerprints(spark):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(n)) for n in (0, 1, 4, 5, 6, 200, 3000)] + [None, "  ", "É à é"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], SCHEMA).select("doc_id", "text", sketch(F.col("text")).alias("s"), hexed(sketch(F.col("text"))).alias("h"))
    for r in df.collect():
        want = sorted(kept(r.text))
        assert r.s == want and r.h == "".join(f"{x:08x}" for x in want)


def test_likeness_and_merge(spark):
    a, b = F.array(*(F.lit(i) for i in range(10))), F.array(*(F.lit(i) for i in range(5, 20)))
    none = F.array().cast("array<int>")
    r = spark.range(1).select(jaccard(a, b).alias("j"), containment(a, b).alias("c"), jaccard(none, none).alias("z"), containment(none, a).alias("e"), merge(F.array(a, b)).alias("m")).first()
    assert (r.j, r.c, r.z, r.e, r.m) == (5 / 20, 0.5, 0.0, 0.0, list(range(20)))


def test_short_texts_have_a_fingerprint(spark):
    texts = [f"short text number {i}" for i in range(20)] + ["one two three four five six seven", "", "é"]
    rows = [(i, t, t, t if i % 2 else "quite another text here") for i, t in enumerate(texts)]
    got = likeness(spark.createDataFrame(rows, SCHEMA + ", edited string, next_text string")).collect()
    prints = {r.fingerprint for r in got}
    assert len(prints) == len(texts) and sum(p == "" for p in prints) == 1
    for r, (_, t, _, after) in zip(sorted(got), rows, strict=True):
        assert r.near_edited == r.contained_edited == 1.0 and r.near_next == r.contained_next == float(t == after)
        every = sorted(kept(t, scale=1))
        assert r.fingerprint == "".join(f"{x:08x}" for x in sorted(kept(t)) or every[:1])
    parts = [whole_sketch(F.lit(t)) for t in texts]
    r = spark.range(1).select(merge_whole(F.array(*parts)).alias("m"), F.array(*parts).alias("p")).first()
    every = {h for p in r.p for h in p}
    assert r.m == sorted(h for h in every if h < (1 << 30))


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_next_document(spark, span):
    rng = random.Random(2)
    ids = rng.sample(range(10**6), 60)
    rows = [(i, f"text of {i}") for i in ids]
    got = {r.doc_id: r.next_text for r in with_next(frame(spark, rows), "doc_id", "text", rows_a_span=span).collect()}
    order = sorted(ids, reverse=True)
    assert got == {d: f"text of {order[(i + 1) % len(order)]}" for i, d in enumerate(order)}


def test_next_document_edges(spark):
    assert with_next(frame(spark, []), "doc_id", "text").count() == 0
    assert [r.next_text for r in with_next(frame(spark, [(1, "only")]), "doc_id", "text").collect()] == ["only"]
    got = with_next(frame(spark, [(2, "a"), (2, "a"), (None, "n"), (1, "b")]), "doc_id", "text", rows_a_span=1).collect()
    assert sorted((str(r.doc_id), r.next_text) for r in got) == [("1", "n"), ("2", "a"), ("2", "b"), ("None", "a")]


def brute_shard(key, n):
    b = j = 0
    k = 1
    while j < n:
        b = j
        u = int(hashlib.md5(f"{key}:{k}".encode()).hexdigest()[:12], 16) + 1
        j = int((b + 1) * float(1 << 48) // u)
        k += 1
    return b


def test_sharding(spark):
    rows = [(i, zlib.crc32(str(i).encode())) for i in range(3000)]
    out = shard_rows(frame(spark, rows, "doc_id long, c long"), "doc_id", 16, tie=[F.col("c")], buckets=8).collect()
    assert all(r.shard == brute_shard(r.doc_id, 16) and r.grown_shard == brute_shard(r.doc_id, 17) for r in out)
    assert all(r.shard == r.grown_shard or r.grown_shard == 16 for r in out)
    assert 3000 / 17 * 0.6 < sum(r.grown_shard == 16 for r in out) < 3000 / 17 * 1.5
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 16


def test_jumps_among_many_shards(spark):
    got = spark.range(300).select("id", jump_shard(F.col("id"), 5000).alias("a"), jump_shard(F.col("id"), 5001).alias("b")).collect()
    assert all(r.a == brute_shard(r.id, 5000) and r.b in (r.a, 5000) for r in got)


def test_sharding_edges(spark):
    rows = [(None, 1), (None, 1), (5, 2), (5, 2), (5, 3)]
    out = shard_rows(frame(spark, rows, "doc_id long, slot long"), "doc_id", 3).collect()
    assert len(out) == 5 and len({(r.shard, r.slot) for r in out}) == 5
    assert shard_rows(frame(spark, [], "doc_id long, c long"), "doc_id", 4).count() == 0
    assert spark.range(5).select(jump_shard(F.col("id"), 1).alias("s")).distinct().collect()[0].s == 0
    with pytest.raises(ValueError):
        jump_shard(F.col("id"), 0)
