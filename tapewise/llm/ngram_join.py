"""Operator 8, n-gram Jaccard join by parity sketches.

A document's shingle hashes are XORed into a bit sketch of 64-bit words. A
shingle changes one word, so two sketches differ in no more words than the
documents differ in shingles, and with d allowed differences and more than d
words some words agree (pigeonhole). Documents of a size band that agree in a
word are candidates; single-bit parity sketches prune them by their Hamming
distance, and whole shingle sets decide.

Links are gathered as forests: a set is compared with a leader, then only with
sets of other components, and of the candidates between two components one is
verified at a time. So copies are never expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewise.llm._common import documents, materialize, release
from tapewise.llm.graph import components

#: Growth of the size bands.
BAND = 2.0
#: Sketch words above the needed d + 1, as a share of it; a set's words of most shingles become its keys.
SPARE = 0.3
#: Bits of a parity sketch for each shingle, and the bounds of a sketch (powers of two).
BITS_EACH, BITS_LEAST, BITS_MOST = 8, 1024, 32_768
#: A key found so often among one in SAMPLE sets, and in over one in HOT_SHARE of their keys, is dealt to tasks in parts of
#: about PART sets. This balances load alone; what is compared doesn't depend on it.
SAMPLE, HOT_LEAST, HOT_SHARE, PART = 16, 48, 4096, 1024
#: Ids of so many sets are broadcast to pick their texts; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
_CHUNK = 1 << 20
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_WORD = np.array([not (b == 0x20 or 9 <= b <= 13) for b in range(256)])
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    place = rng.integers(0, 1 << 63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return rng.integers(0, 1 << 63, 256, dtype=np.uint64), place


def _hash_words(raw: bytes) -> np.ndarray:
    """A 64-bit hash of every word of ``raw``."""
    b = np.frombuffer(raw, dtype=np.uint8)
    inside = _WORD[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, sizes = edge[::2], edge[1::2] - edge[::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    byte, place = _tables()
    first = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    sums = np.add.reduceat(byte[b[inside]] * place[at & 0xFFFF], first)
    return _mix(sums ^ (sizes.astype(np.uint64) * _M1))


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words between ASCII white space, A-Z lower-cased; long
    texts go in pieces cut at white space."""
    raw = (text or "").encode("utf-8", "replace").translate(_LOWER)
    with np.errstate(over="ignore"):
        if len(raw) <= _CHUNK:
            return _hash_words(raw)
        parts, a = [], 0
        while a < len(raw):
            b = min(a + _CHUNK, len(raw))
            while b < len(raw) and _WORD[raw[b]]:
                b += 1
            parts.append(_hash_words(raw[a:b]))
            a = b
        return np.concatenate(parts)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Ascending distinct hashes of all ``k``-word shingles; of fewer words the
    whole sequence is one; none without words."""
    w = word_hashes(text)
    if not len(w):
        return w
    size = min(k, len(w))
    n = len(w) - size + 1
    with np.errstate(over="ignore"):
        s = np.full(n, size, dtype=np.uint64)
        for j in range(size):
            s = _mix(s * _M1 + w[j : j + n])
    return np.unique(s)


@cache
def bands(num: int, den: int, most: int = 1 << 33) -> list[tuple[int, int, int]]:
    """(least size, end, sketch words) of each band.

    Sets of up to ``end - 1`` elements with Jaccard of at least num / den differ
    in at most 2 (end - 1)(den - num) / (den + num) elements."""
    out, lo = [], 1
    while lo < most:
        end = max(lo + 1, int(lo * BAND))
        d = 2 * (end - 1) * (den - num) // (den + num)
        out.append((lo, end, d + 1 + int(SPARE * (d + 1)) if d else 0))
        lo = end
    return out


def sketch_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Join keys of a set: band, word number and word, for its own band and for
    the next one where a larger partner may be.

    A partner in the band has at most ``big`` elements, so at most d words
    differ. Words are ordered by how many shingles they hold, then by a hash of
    what they hold, alike in both sets: of the words that agree, the first is
    preceded by differing ones only, so it is among the first d + 1 of either."""
    n, out = len(s), []
    for i, (lo, end, m) in enumerate(bands(num, den)):
        if lo * num > n * den:
            break
        if end <= n or not m:  # with no difference allowed, equal sets are all
            continue
        big = min(end - 1, n * den // num)
        d = (n + big) * (den - num) // (den + num)
        with np.errstate(over="ignore"):
            where = (_mix(s + np.uint64(i)) % np.uint64(m)).astype(np.int64)
            held = np.bincount(where, minlength=m)
            order = np.argsort(where, kind="stable")
            words = np.zeros(m, dtype=np.uint64)
            full = np.flatnonzero(held)
            words[full] = np.bitwise_xor.reduceat(_mix(s[order] ^ _M3), (np.cumsum(held) - held)[full])
            keys = _mix(words + _mix(np.arange(m, dtype=np.uint64) * _M1 + np.uint64(i)))
        out.append(keys[np.lexsort((keys, -held))[: d + 1]])
    return np.concatenate(out).view(np.int64) if out else np.empty(0, dtype=np.int64)


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if not len(a) or not len(b) or min(len(a), len(b)) * den < max(len(a), len(b)) * num:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def _sketched(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc, n, h1, h2, keys, text): 128 bits identify the set; keys and text
    come with the first document of a set in each task."""
    kind = docs.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            size, marks, keys, texts = [], [], [], []
            for t in batch.column(1):
                text = t.as_py()
                s = shingle_set(text, k)
                with np.errstate(over="ignore"):
                    mark = tuple(int(_mix(s ^ m).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for m in (_M2, _M3))
                first = len(s) > 0 and mark not in seen
                if first:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(mark)
                size.append(len(s))
                marks.append(mark)
                keys.append(sketch_keys(s, num, den) if first else None)
                texts.append(text if first else None)
            cols = [batch.column(0), pa.array(size, pa.int64()), *(pa.array([m[i] for m in marks], pa.int64()) for i in (0, 1)), pa.array(keys, pa.list_(pa.int64())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc", "n", "h1", "h2", "keys", "text"])

    return docs.mapInArrow(run, f"doc {kind}, n long, h1 long, h2 long, keys array<long>, text string")


def _runs(batches: Iterator[pa.RecordBatch], width: int, parted: bool = False) -> Iterator[list[np.ndarray]]:
    """Columns of each block's rows, from batches sorted by the first column. A
    block of one row is passed over, unless ``parted`` and it is a part of the
    key in the second column."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        if not len(cols[0]):
            continue
        cuts = np.flatnonzero(np.diff(cols[0])) + 1
        last = cuts[-1] if len(cuts) else 0
        edges = np.concatenate(([0], cuts)) if len(cuts) else np.array([0])
        wanted = np.diff(edges) > 1
        if parted:
            wanted |= (cols[0] != cols[1])[edges[:-1]]
        for j in np.flatnonzero(wanted):
            yield [c[edges[j] : edges[j + 1]] for c in cols]
        rest = [c[last:] for c in cols]
    if rest is not None and (len(rest[0]) > 1 or parted and rest[0][0] != rest[1][0]):
        yield rest


def _dealt(sets: DataFrame) -> DataFrame:
    """(block, key, n, node) of all keys. The block is what one task compares:
    the key, or a part of the sets of a key that is found very often."""
    some = sets.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("rows"))
    least = max(HOT_LEAST, (some.agg(F.sum("rows")).first()[0] or 0) // HOT_SHARE)
    # HOT_SHARE rows at most, as each holds over so large a share
    hot = F.broadcast(some.where(F.col("rows") > least).select("key", F.ceil(F.col("rows") * SAMPLE / PART).cast("long").alias("parts")))
    part = F.xxhash64("key", F.pmod(F.xxhash64("node"), F.col("parts")))
    keys = sets.select("node", "n", F.explode("keys").alias("key")).join(hot, "key", "left")
    return keys.select(F.when(F.col("parts") > 1, part).otherwise(F.col("key")).alias("block"), "key", "n", "node")


def _stars(blocks: DataFrame, num: int, den: int) -> DataFrame:
    """(key, node, n, lead) of all keys that several sets share: each set with
    the least one before it in its block that is not too small. Linear in the rows.

    A key that isn't cut into parts is named by a hash of its sets: keys of the
    same sets bring the same pairs together, and their rows are equal."""
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = []
        rows = 0

        def flush():
            block, key, node, n, lead = (np.concatenate([o[i] for o in out]) for i in range(5))
            sizes = np.array([len(o[0]) for o in out])
            with np.errstate(over="ignore"):
                name = _mix(np.add.reduceat(_mix(node.view(np.uint64) + _M1), np.cumsum(sizes) - sizes) + _M2).view(np.int64)
            key = np.where(block == key, np.repeat(name, sizes), key)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (key, node, n, lead)], names=["key", "node", "n", "lead"])

        for block, key, n, node in _runs(batches, 4, parted=True):
            lead, a = np.empty_like(node), 0
            while a < len(node):
                b = int(np.searchsorted(n, n[a] * den // num, side="right"))
                lead[a:b] = node[a]
                a = b
            out.append([block, key, node, n, lead])
            rows += len(node)
            if rows > 50_000:
                yield flush()
                out, rows = [], 0
        if out:
            yield flush()

    return blocks.repartition(parts, "block").sortWithinPartitions("block", "n", "node").mapInArrow(run, "key long, node long, n long, lead long")


def _shared(blocks: DataFrame, ids: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of ``_stars`` by the ids of sets, of keys with the same sets
    once. Sets of much likeness share very many keys, and all but one go here."""
    stars = materialize(_stars(blocks, num, den), "stars")
    of = lambda x: ids.select(F.col("node").alias(x), F.col("id").alias(f"{x}_id"))
    named = stars.distinct().join(of("node"), "node").join(of("lead"), "lead")
    out = materialize(named.select("key", F.col("node_id").alias("node"), "n", F.col("lead_id").alias("lead")).distinct(), "shared")
    release(stars)
    return out


def parity_bits(s: np.ndarray) -> bytes:
    """A set's parity sketch: each shingle flips one bit. Two sketches of one
    size differ in no more bits than their sets differ in shingles; the halves
    of a sketch XORed are the sketch of half the size."""
    size = min(max(BITS_LEAST, 1 << (BITS_EACH * len(s) - 1).bit_length()), BITS_MOST)
    with np.errstate(over="ignore"):
        at = (_mix(s + _M1) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype(np.uint8)).tobytes()


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Parity sketches as rows of 64-bit words, all of the least size among them."""
    least = min(map(len, sketches))
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(b, dtype=np.uint64).reshape(-1, least // 8), axis=0) for b in sketches])


def _bits(texts: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [parity_bits(shingle_set(t.as_py(), k)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], names=["id", "bits"])

    return texts.select("id", "text").mapInArrow(run, "id long, bits binary")


def candidates(n: np.ndarray, comp: np.ndarray, sketch: np.ndarray, num: int, den: int, forest: bool, home: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(i, js): sets of one block, ascending by size ``n``, that lie in different
    components, not both away from ``home``, and that sizes and parity sketches
    allow to link. For a ``forest``, components with a candidate between them count as one from
    there on, so there are fewer pairs than sets."""
    ends, comp = np.searchsorted(n, n * den // num, side="right"), comp.copy()
    for i in range(len(n)):
        near = np.arange(i + 1, ends[i])
        near = near[comp[near] != comp[i]]
        if home is not None and not home[i]:
            near = near[home[near]]
        if not len(near):
            continue
        found = []
        for at in range(0, len(near), 4096):
            js = near[at : at + 4096]
            apart = np.bitwise_count(sketch[js] ^ sketch[i]).sum(axis=1, dtype=np.int64)
            found.append(js[apart * (den + num) <= (n[js] + n[i]) * (den - num)])
        js = np.concatenate(found)
        if forest and len(js):
            labels, first = np.unique(comp[js], return_index=True)
            js = js[first]
            comp[np.isin(comp, labels)] = comp[i]
        if len(js):
            yield i, js


def _cross(rows: DataFrame, num: int, den: int, forest: bool) -> DataFrame:
    """(a, b, key): ``candidates`` of all blocks; a pair that isn't one is never written."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, key, n, node, comp, home, bits in _runs(batches, 7):
            new = np.concatenate(([True], node[1:] != node[:-1]))
            key, n, node, comp, home = key[new], n[new], node[new], comp[new], home[new].astype(bool)
            for i, js in candidates(n, comp, _folded(list(bits[new])), num, den, forest, home):
                a, other = np.full(len(js), node[i]), node[js]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.minimum(a, other), np.maximum(a, other), key[js])], names=["a", "b", "key"])

    dealt = rows.repartition(parts, "block").sortWithinPartitions("block", "n", "id").select("block", "key", "n", "id", "comp", "home", "bits")
    return dealt.mapInArrow(run, "a long, b long, key long")


def _hub_first(pairs: DataFrame) -> DataFrame:
    """(hub, leaf, block) of the pairs: the hub is the set of more pairs. A block
    holds about PART pairs of one hub at most."""
    many = materialize(pairs.select(F.explode(F.array("a", "b")).alias("x")).groupBy("x").agg(F.count("*").alias("many")), "many")
    of = lambda x: many.select(F.col("x").alias(x), F.col("many").alias(f"m{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    first = F.col("ma") >= F.col("mb")
    hub, leaf, parts = (F.when(first, F.col(x)).otherwise(F.col(y)) for x, y in (("a", "b"), ("b", "a"), ("ma", "mb")))
    dealt = both.select(hub.alias("hub"), leaf.alias("leaf"), F.ceil(parts / PART).alias("parts"))
    out = materialize(dealt.select("hub", "leaf", F.xxhash64("hub", F.pmod(F.xxhash64("leaf"), "parts")).alias("block")), "hubs")
    release(many)
    return out


def _if_few(ids: DataFrame) -> DataFrame:
    """``ids``, to be broadcast where texts are joined, unless there are very many."""
    return F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids


def _verified(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs that link, on their whole shingle sets. A hub's text goes once
    to each of its blocks, a leaf's with each pair."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            block, hub, leaf = (batch.column(i).to_pylist() for i in range(3))
            keep = []
            for i, text in enumerate(batch.column(3)):
                s = shingle_set(text.as_py(), k)
                if leaf[i] is None:
                    at, own = (block[i], hub[i]), s
                elif (block[i], hub[i]) != at:
                    raise RuntimeError("a hub's text is missing")
                elif linked(own, s, num, den):
                    keep.append((min(hub[i], leaf[i]), max(hub[i], leaf[i])))
            yield pa.RecordBatch.from_arrays([pa.array([p[j] for p in keep], pa.int64()) for j in (0, 1)], names=["a", "b"])

    dealt = _hub_first(pairs)
    hubs = dealt.select(F.col("hub").alias("id"), "block", "hub", F.lit(None).cast("long").alias("leaf")).distinct()
    wanted = hubs.unionByName(dealt.select(F.col("leaf").alias("id"), "block", "hub", "leaf"))
    rows = texts.join(_if_few(wanted), "id").select("block", "hub", "leaf", "text").repartition(parts, "block").sortWithinPartitions("block", "hub", F.col("leaf").asc_nulls_first())
    out = materialize(rows.mapInArrow(run, "a long, b long"), "links")
    release(dealt)
    return out


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose sets aren't in one component yet."""
    of = lambda x: comp.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _open(shared: DataFrame, ids: DataFrame, comp: DataFrame) -> DataFrame:
    """(block, key, n, id, comp, home) of the keys whose sets lie in several components.

    A key of very many sets is cut into parts, a block each. A set is at home in
    its own part; sets outside the key's largest component go to every part as
    well, so that any two sets of different components meet where one is at home.
    Beside each set once, only those few are written again."""
    place = ids.join(comp, ids.id == comp.node, "left").select(ids.node, "id", F.coalesce("comp", "id").alias("comp"))
    placed = shared.select("key", "node", "n").join(place, "node").select("key", "n", "id", "comp")
    several = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("rows")).where("lo <> hi")
    rows = materialize(placed.join(several.select("key", F.ceil(F.col("rows") / PART).alias("parts")), "key"), "several")
    each = rows.where("parts > 1").groupBy("key", "comp").agg(F.count("*").alias("rows"))
    main = each.groupBy("key").agg(F.max_by("comp", F.struct("rows", "comp")).alias("main"))
    own = F.pmod(F.xxhash64("id"), F.col("parts"))
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    # main: a row for PART rows at most
    dealt = rows.join(F.broadcast(main), "key", "left").withColumn("own", own)
    dealt = dealt.withColumn("part", F.explode(F.when((F.col("parts") == 1) | (F.col("comp") == F.col("main")), F.array("own")).otherwise(every)))
    out = materialize(dealt.select(F.xxhash64("key", "part").alias("block"), "key", "n", "id", "comp", (F.col("part") == F.col("own")).alias("home")), "open")
    release(rows)
    return out


def _texts(sets: DataFrame, shared: DataFrame) -> DataFrame:
    """(id, text) of the sets that share a key."""
    held = materialize(shared.select(F.col("node").alias("id")).distinct(), "held")
    texts = materialize(sets.where(F.col("text").isNotNull()).select(F.col("node").alias("id"), "text").join(_if_few(held), "id", "left_semi"), "texts")
    release(held)
    return texts


def _links(sets: DataFrame, ids: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(node, comp): components of all sets that link. See ``jaccard_groups``."""
    shared = _shared(_dealt(sets.where(F.col("keys").isNotNull())), ids, num, den)
    texts = _texts(sets, shared)
    edges = materialize(shared.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), "edges")
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # one leader for each set first; of its other leaders only those of another component
    tested = [materialize(ordered(edges.groupBy("b").agg(F.min("a").alias("a"))).distinct(), "leaders")]
    links = [_verified(tested[0], texts, k, num, den)]
    every = lambda tables: reduce(DataFrame.unionByName, tables)
    comp = components(links[0])
    keys, bits, used = shared.select("key", "node", "n").distinct(), None, []
    # then forests of candidates between components, at last all that are left
    for step in ("leaders", "forest", "forest", "all"):
        if step == "leaders":
            pairs = _apart(ordered(edges).distinct(), comp)
        else:
            rows = _open(keys, ids, comp)
            # components only grow: what is open later was open before, and where sketches
            # allow no pair there will be none, so sketches are made once and such keys go
            bits = bits or materialize(_bits(texts.join(_if_few(rows.select("id").distinct()), "id", "left_semi"), k), "bits")
            met = materialize(_cross(rows.join(bits, "id"), num, den, step == "forest").distinct(), "met")
            used += [rows, met]
            keys = keys.join(met.select("key").distinct(), "key", "left_semi")
            pairs = met.select("a", "b").distinct()
        pairs = materialize(pairs.join(every(tested), ["a", "b"], "left_anti"), "pairs")
        new = _verified(pairs, texts, k, num, den)
        tested.append(pairs)
        if not new.isEmpty():
            links.append(new)
            release(comp)
            comp = components(every(links))
    release(shared, texts, edges, bits, *used, *tested, *links)
    return comp


def jaccard_groups(docs: DataFrame, doc: str = "doc_id", text: str = "text", k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc, n_shingles, component_id) for every row of ``docs``.

    Two documents link if den * |intersection| >= num * |union| of their sets of
    ``k``-word shingles; ``component_id`` is the least id reachable by links, its
    own included. Documents of equal sets are one node from the start: the rows
    of a set are numbered by the first of them, so numbers never clash.

    Each node is compared with one leader, then with the leaders of its other
    shared keys. After that only sets of different components that share a key
    are compared, by their parity sketches; two rounds verify a forest of the
    candidates, the last one all that are left, so that no link between
    different texts is lost. Very near sets that don't link have to be compared
    pair by pair in any case, but only pairs that sketches can't tell from links
    are written.

    Null and blank texts have no shingles and link with nothing. Repeated rows
    get equal results. A null id counts as greater than any other; a group of
    null ids alone has a null component. An empty table gives no rows.
    """
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    sets = materialize(_sketched(rows, k, num, den).withColumn("node", F.monotonically_increasing_id()), "sets")
    # node: the first row of a set in a task; id: the first of the set in all
    first = sets.where(F.col("keys").isNotNull()).groupBy("h1", "h2").agg(F.min("node").alias("id"))
    ids = materialize(sets.where(F.col("keys").isNotNull()).select("node", "h1", "h2").join(first, ["h1", "h2"]), "ids")
    comp = _links(sets, ids, k, num, den)
    named = ids.where("node = id").join(comp.withColumnRenamed("node", "id"), "id", "left").select("h1", "h2", F.coalesce("comp", "id").alias("comp"))
    rows = sets.select("doc", "n", "h1", "h2").join(named, ["h1", "h2"], "left")
    # blank rows have no set; the others of a component get its least id
    # (a table of its own, so that adaptive execution can split a large component in the join)
    least = materialize(rows.where("n > 0").groupBy("comp").agg(F.min("doc").alias("component_id")), "least")
    out = rows.join(least, "comp", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc"))
    out = materialize(out.select(F.col("doc").alias(doc), F.col("n").alias("n_shingles"), component.alias("component_id")), "groups")
    release(sets, ids, comp, least)
    return out


def op8_parity_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by 3-word shingles and Jaccard of at least 0.9."""
    return jaccard_groups(documents(spark, sf_dir), k=3, num=9, den=10)
