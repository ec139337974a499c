"""Operator 12, byte-level BPE by merge replay over all words of a slab.

The words of many documents are laid out once, byte after byte. An inverted
index leads from a merge's rank to the places where its pair of tokens stands;
merges are applied in rank order to all places at once, and only the pairs with
the touched neighbours are indexed anew. Decoding looks the ids' bytes up.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from functools import cache, cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from tapewise.llm._common import documents

DEFAULT = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Texts are replayed together up to so many bytes; a longer one goes alone.
SLAB_CHARS = 8 << 20
NO_MERGE = 1 << 62
#: ``\s`` of the pattern means Unicode white space, which for ``regex`` has a few controls more.
_PATTERN = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"(?!\S)", r"(?!\P{White_Space})")


@cache
def splitter():
    return regex.compile(_PATTERN)


class Merges:
    """Ranks of a tiktoken file and what may merge: two tokens whose bytes
    together are a token merge to it, the least rank first."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        find = self.ranks.get
        self.single = np.array([find(bytes([b]), -1) for b in range(256)])
        if -1 in self.single:
            raise ValueError(f"{path}: not every byte has an id")
        self.shift = max(self.ranks.values()).bit_length()
        halves = ((find(t[:i]), find(t[i:]), rank) for t, rank in self.ranks.items() for i in range(1, len(t)))
        pairs = np.array([(a << self.shift | b, rank) for a, b, rank in halves if a is not None and b is not None] or [(-1, -1)])
        self.keys, self.merged = pairs[np.argsort(pairs[:, 0])].T.copy()
        held: list[bytes | None] = [None] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            held[rank] = token
        #: Bytes of each id; null for an id that isn't given out.
        self.bytes = pa.array(held, pa.large_binary())

    @cached_property
    def pairs(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.merged.tolist(), strict=True))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks that pairs of tokens merge to, ``NO_MERGE`` for none."""
        key = (a << self.shift) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NO_MERGE)

    def alone(self, word: bytes) -> list[int]:
        """Ids of one word, merge by merge: the least rank, leftmost first."""
        if word in self.ranks:
            return [self.ranks[word]]
        token, last = self.single[list(word)].tolist(), len(word) - 1
        before, after = [-1, *range(last)], [*range(1, last + 1), -1]
        ready = [(r, i) for i in range(last) if (r := self.pairs.get(token[i] << self.shift | token[i + 1])) is not None]
        heapify(ready)
        while ready:
            rank, i = heappop(ready)
            j = after[i]
            if token[i] < 0 or j < 0 or self.pairs.get(token[i] << self.shift | token[j]) != rank:
                continue
            left, right = before[i], after[j]
            token[i], token[j], after[i] = rank, -1, right
            if right >= 0:
                before[right] = i
            for x, y in ((left, i), (i, right)):
                if x >= 0 and y >= 0 and (r := self.pairs.get(token[x] << self.shift | token[y])) is not None:
                    heappush(ready, (r, x))
        return [t for t in token if t >= 0]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids): how many ids each word has, and all of them.

        The index holds the places of each rank's pairs in all words; the least
        rank is merged at all its places at once, and the pairs with the touched
        neighbours go into the index. Of places that overlap the left one goes
        first. A word where a merge opens one of lower rank, which has to go
        before its other places, is merged alone."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths)
        starts, total = ends - lengths, int(lengths.sum())
        token = self.single[np.frombuffer(b"".join(words), dtype=np.uint8)]
        before, after = np.arange(-1, total - 1), np.arange(1, total + 1)
        before[starts], after[ends - 1] = -1, -1

        def settle(at: int, ids: list[int]) -> None:
            a, b = starts[at], ends[at]
            token[a : a + len(ids)], token[a + len(ids) : b], after[a:b] = ids, -1, -1

        for at, word in enumerate(words):  # a whole word that is a token is that token
            if (own := self.ranks.get(word)) is not None:
                settle(at, [own])
        places: dict[int, list[np.ndarray]] = {}
        ready: list[int] = []

        def index(rank: np.ndarray, at: np.ndarray) -> None:
            good = rank < NO_MERGE
            rank, at = rank[good], at[good]
            order = np.argsort(rank, kind="stable")
            rank, at = rank[order], at[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rank)], strict=True):
                if a < b:
                    r = int(rank[a])
                    if r in places:
                        places[r].append(at[a:b])
                    else:
                        places[r] = [at[a:b]]
                        heappush(ready, r)

        left = np.flatnonzero(after >= 0)
        index(self.rank(token[left], token[left + 1]), left)
        while ready:
            rank = heappop(ready)
            here = np.sort(np.concatenate(places.pop(rank)))
            here = here[np.concatenate(([True], here[1:] != here[:-1]))]
            # the index may hold places that another merge has taken
            here = here[(token[here] >= 0) & (after[here] >= 0)]
            here = here[self.rank(token[here], token[after[here]]) == rank]
            if not len(here):
                continue
            tied = np.concatenate(([False], after[here[:-1]] == here[1:]))
            if tied.any():
                n = np.arange(len(here))
                here = here[(n - np.maximum.accumulate(np.where(tied, 0, n))) % 2 == 0]
            j = after[here]
            l, r = before[here], after[j]
            lower = (l >= 0) & (self.rank(token[l], rank) < rank) | (r >= 0) & (self.rank(np.int64(rank), token[r]) < rank)
            if lower.any():
                odd = np.unique(np.searchsorted(ends, here[lower], side="right"))
                for at in odd.tolist():
                    settle(at, self.alone(words[at]))
                here = here[after[here] >= 0]
                j = after[here]
                r = after[j]
            token[here], token[j], after[here] = rank, -1, r
            before[r[r >= 0]] = here[r >= 0]
            l = before[here]
            l, right = l[l >= 0], here[r >= 0]
            at = np.concatenate((l, right))
            index(self.rank(token[at], token[after[at]]), at)
        kept = token >= 0
        sizes = np.add.reduceat(kept, starts) if len(words) else np.empty(0, dtype=np.int64)
        return sizes.astype(np.int64), token[kept]


@cache
def merges(path: str) -> Merges:
    return Merges(path)


def encode_texts(texts: list[str | None], path: str = DEFAULT) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids): all ids of the texts one after the other. Null and empty
    texts have none."""
    split = splitter().findall
    number: defaultdict[str, int] = defaultdict()
    number.default_factory = number.__len__
    used = [np.fromiter(map(number.__getitem__, split(t)), dtype=np.int64) if t else np.empty(0, dtype=np.int64) for t in texts]
    sizes, flat = merges(path).replay([w.encode("utf-8", "replace") for w in number])
    first = np.cumsum(sizes) - sizes
    places = np.concatenate(used) if used else np.empty(0, dtype=np.int64)
    took = sizes[places]
    done = np.concatenate(([0], np.cumsum(took)))
    out = flat[np.repeat(first[places] - done[:-1], took) + np.arange(int(done[-1]))]
    ends = np.cumsum([0, *map(len, used)])
    return done[ends], out


def _slabs(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about ``SLAB_CHARS`` bytes of text."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if i > at and held + n > SLAB_CHARS:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += int(n)
    if batch.num_rows > at:
        yield batch.slice(at)


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", path: str = DEFAULT) -> DataFrame:
    """``docs`` without ``text``, with ``ids`` (array of int): the ids that
    tiktoken's ``encode_ordinary`` gives for each whole text.

    Null and empty texts have an empty array. Repeated rows get equal results;
    an empty table gives none. A column named like ``ids`` is replaced. Nothing
    is shuffled; a task holds one slab of texts and its words at a time.
    """
    keep = [c for c in docs.columns if c not in (text, ids)]
    schema = StructType([*docs.select(*keep).schema.fields, StructField(ids, ArrayType(IntegerType()))])
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in _slabs(batch, n):
                offsets, flat = encode_texts(slab.column(n).to_pylist(), path)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*slab.columns[:n], lists], names=[*keep, ids])

    return docs.select(*keep, F.col(text)).mapInArrow(run, schema)


def decode(rows: DataFrame, ids: str = "ids", out: str = "bytes", path: str = DEFAULT) -> DataFrame:
    """``rows`` with ``out`` (binary): the bytes of the array of ids.

    A null array is no ids and gives empty bytes, as an empty one does; an id
    that the file doesn't give out is an error. A column named ``out`` is replaced."""
    keep = [c for c in rows.columns if c != out]
    schema = StructType([*rows.select(*keep).schema.fields, StructField(out, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = merges(path).bytes
        for batch in batches:
            column = batch.column(keep.index(ids))
            for at in range(0, batch.num_rows, 64):
                part = column.slice(at, 64)
                flat = part.flatten()
                found = table.take(flat)
                if found.null_count:
                    raise ValueError("an id without a token")
                sizes = pc.list_value_length(part).fill_null(0).to_numpy(zero_copy_only=False)
                ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
                marks = np.frombuffer(found.buffers()[1], dtype=np.int64, count=len(found) + 1, offset=8 * found.offset) if len(found) else np.zeros(1, dtype=np.int64)
                data = memoryview(found.buffers()[2] or b"")
                values = [bytes(data[marks[a] : marks[b]]) for a, b in zip(ends, ends[1:], strict=False)]
                same = [c.slice(at, 64) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*same, pa.array(values, pa.binary())], names=[*keep, out])

    return rows.select(*keep).mapInArrow(run, schema)


def op12_merge_replay_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by ``byte_bpe_multi_50k.tiktoken``, and back."""
    found = decode(encode(documents(spark, sf_dir).select("doc_id", "text")))
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
