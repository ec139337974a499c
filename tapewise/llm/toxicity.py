"""Operator 9, toxicity by compression distance.

Two zstandard dictionaries, one trained on toxic and one on ordinary text, share
a base, so that the lengths of a window compressed with either differ only by
what the labels tell apart. What a window gains from the toxic dictionary over
the ordinary one is its distance. Windows are single words and runs of eight
words; a document's distances, counted by size, go through a calibrated logistic
threshold.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tapewise.llm._common import documents

#: The bounded sample a model is fitted on: rows of either label, and code points of a row.
MAX_ROWS = 2000
MAX_CHARS = 40_000
BASE_BYTES = 65_536
#: Of either label's own part: bytes, words of a piece at most, documents that hold it at least, how many times its share in
#: this label's documents exceeds that in the other's, and what is added there to the count, as a share of the root of the documents.
OWN_BYTES, RUN, LEAST, RATIO, DOUBT = 32_768, 3, 4, 12, 0.02
#: Words of a phrase window, and from one to the next: every run of RUN words lies in one.
PHRASE, STRIDE = 8, 6
LEVEL = 3
_KEEP_WORDS = 300_000
_STEPS, _PHRASE_STEPS = range(1, 8), range(1, 13)
_FEATURES = 2 * (len(_STEPS) + len(_PHRASE_STEPS))
#: zstd looks for no match in its last bytes and stores very short inputs as they are: guards on both sides.
_HEAD, _FOOT = bytes([1, 2, 3, 4, 5, 6, 7, 8, 1, 3, 5, 7, 2, 4, 6, 8]), bytes([9, 10, 11, 12, 14, 15, 16, 17, 18, 19])
_SPLIT = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _words(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words of letters, digits and non-ASCII characters."""
    return _SPLIT.sub(b" ", (text or "").encode("utf-8", "replace").lower()).split()


def _trained(samples: list[bytes], size: int) -> bytes:
    """Content that zstandard's trainer picks, without its entropy tables;
    where there is too little to train on, the samples themselves."""
    try:
        raw = zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        raw = b""
    # the trained content is a run of pieces of the samples at the end
    lead = max((i for i in range(min(len(raw), 1024)) if raw[i] < 32), default=-1) + 1
    content = raw[lead:]
    return content if len(content) >= size // 8 else b"".join(dict.fromkeys(reversed(samples)))[-size:]


@dataclass
class Model:
    """The toxic and the ordinary dictionary, and the calibrated weights; picklable."""

    pair: tuple[bytes, bytes]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def __getstate__(self):
        return self.pair, self.mean, self.scale, self.weights

    def __setstate__(self, state):
        self.pair, self.mean, self.scale, self.weights = state

    def _open(self) -> None:
        def compressor(raw: bytes):
            d = zstandard.ZstdCompressionDict(raw + _HEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress

        self._toxic, self._plain = map(compressor, self.pair)
        self._known: dict[bytes, int] = {}

    def distance(self, words: bytes) -> int:
        """Bytes that the toxic dictionary saves over the ordinary one on a window."""
        window = _HEAD + b" " + words + b" " + _FOOT
        return len(self._plain(window)) - len(self._toxic(window))

    def _word_distance(self, word: bytes) -> int:
        got = self._known.get(word)
        if got is None:
            got = self.distance(word)
            if len(self._known) >= _KEEP_WORDS:
                self._known.clear()
            self._known[word] = got
        return got

    def features(self, text: str | None) -> list[float]:
        if not hasattr(self, "_known"):
            self._open()
        found = _words(text)
        phrases = [self.distance(b" ".join(found[i : i + PHRASE])) for i in range(0, max(1, len(found) - PHRASE + STRIDE), STRIDE)] if found else []
        out: list[float] = []
        for steps, counts in ((_STEPS, Counter(map(self._word_distance, found))), (_PHRASE_STEPS, Counter(phrases))):
            total = sum(counts.values()) + 20
            at_least = [sum(n for d, n in counts.items() if d >= k) for k in steps]
            out += [*np.log1p(at_least), *(c / total for c in at_least)]
        return out

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts], dtype=float).reshape(-1, _FEATURES)
        z = ((x - self.mean) / self.scale) @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    pen = np.full(x.shape[1], ridge)
    pen[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + pen * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pen), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _pieces(docs: list[list[bytes]]) -> tuple[dict[int, int], np.ndarray, np.ndarray]:
    """(number of groups, hashes, counts): in how many groups of near copies
    each run of up to ``RUN`` words stands. Documents of the same least word
    hash are one group, so that copied text doesn't look like a mark."""
    groups: dict[int, list[list[bytes]]] = {}
    for words in docs:
        groups.setdefault(min(map(zlib.crc32, words), default=0), []).append(words)
    held = [np.unique(np.concatenate([h for words in g for h in _run_hashes(words)])) for g in groups.values()]
    hashes, counts = np.unique(np.concatenate(held) if held else np.empty(0, np.uint64), return_counts=True)
    return max(1, len(groups)), hashes, counts


def _run_hashes(words: list[bytes]) -> list[np.ndarray]:
    """Hashes of all runs of 1, 2 .. ``RUN`` words."""
    ids = np.array([zlib.crc32(w) | zlib.crc32(w, 7) << 32 for w in words], dtype=np.uint64)
    out, h = [ids], ids
    with np.errstate(over="ignore"):
        for k in range(1, RUN):
            h = h[: max(0, len(ids) - k)] * np.uint64(0x9E3779B97F4A7C15) + ids[k:]
            out.append(h)
    return out


def _own_part(docs: list[list[bytes]], mine: tuple, other: tuple) -> bytes:
    """Contrastive dictionary content: of a label's own texts the runs of words
    that the other label's hardly hold, those in most documents last (nearest)."""
    (n, hashes, counts), (m, theirs, held) = mine, other
    at = np.minimum(np.searchsorted(theirs, hashes), max(0, len(theirs) - 1))
    in_other = np.where(theirs[at] == hashes, held[at], 0) if len(theirs) else np.zeros(len(hashes), int)
    good = (counts >= LEAST) & (counts / n > RATIO * (in_other + DOUBT * m**0.5) / m)
    often = dict(zip(hashes[good].tolist(), counts[good].tolist(), strict=True))
    found: dict[int, bytes] = {}
    for words in docs:
        for k, runs in enumerate(_run_hashes(words)):
            for i in np.flatnonzero(np.isin(runs, hashes[good])):
                found.setdefault(int(runs[i]), b" ".join(words[i : i + k + 1]))
    return b"".join(b" " + x for _, x in sorted((often[h], x) for h, x in found.items()))[-OWN_BYTES:] + b" " if found else b""


def _dictionaries(rows: list[tuple[str, int]]) -> tuple[bytes, bytes]:
    """Contents of the toxic and the ordinary dictionary, of equal size.

    The base is zstandard's training on ordinary text, the rest of either is
    trained in contrast to the other label, by the same rule."""
    docs: tuple[list, list] = ([], [])
    known_words: dict[bytes, bytes] = {}  # one object a word: the sample has millions
    for text, y in dict.fromkeys(rows):
        docs[y].append([known_words.setdefault(w, w) for w in _words(text)])
    plain = [b" " + b" ".join(w[i : i + PHRASE]) + b" " for w in docs[0] for i in range(0, len(w), PHRASE)]
    base = _trained(sorted(plain, key=zlib.crc32)[:80_000], BASE_BYTES) if plain else b""
    known = [_pieces(x) for x in docs]
    toxic, ordinary = _own_part(docs[1], known[1], known[0]), _own_part(docs[0], known[0], known[1])
    size = max(len(toxic), len(ordinary))
    return base + toxic.rjust(size, b"\0"), base + ordinary.rjust(size, b"\0")


def fit(rows: list[tuple[str, int]]) -> Model:
    """A model from (text, label) rows. Distances are calibrated on rows that
    the dictionaries weren't trained on: two halves take turns, then the
    dictionaries of all rows take the weights. Without toxic rows all scores
    are next to 0."""
    rows = sorted(rows, key=lambda r: zlib.crc32((r[0] or "").encode("utf-8", "replace")))
    half = lambda k: [r for r in rows if zlib.crc32((r[0] or "").encode("utf-8", "replace")) // 7 % 2 == k]
    x, y = [], []
    zero = np.zeros(_FEATURES)
    for k in (0, 1):
        m = Model(_dictionaries(half(k)), zero, zero + 1, np.zeros(len(zero) + 1))
        for text, label in half(1 - k):
            x.append(m.features(text))
            y.append(label)
    x, y = np.array(x, dtype=float).reshape(-1, len(zero)), np.array(y, dtype=float)
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (zero, zero + 1)
    weights = _logistic((x - mean) / scale, y) if len(x) else np.zeros(len(zero) + 1)
    if not any(y):
        weights[:] = 0
        weights[0] = -30  # nothing is known to be toxic
    return Model(_dictionaries(rows), mean, scale, weights)


def fold(doc: Column) -> Column:
    """crc32 of the id as text, mod 5; fold 0 is held out. A null id counts as empty."""
    return F.crc32(F.coalesce(doc.cast("string"), F.lit(""))) % 5


def training_sample(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> list[tuple[str, int]]:
    """At most ``max_rows`` ids of either label outside fold 0 and twice as many
    rows, chosen by hashes; texts over ``max_chars`` aren't used for fitting
    (all are scored)."""
    right = labels.where((fold(F.col(doc)) != 0) & F.col(label).isNotNull()).select(F.col(doc).alias("_id"), F.col(label).cast("int").alias("_y"))
    picked = [right.where(F.col("_y") == y).orderBy(F.xxhash64("_id", F.lit(5)), "_id").limit(max_rows) for y in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * max_rows rows at most
    fitting = docs.where(F.col(text).isNotNull() & (F.length(text) <= max_chars)).select(F.col(doc).alias("_id"), F.col(text).alias("_text"))
    # an id may stand on many rows: the same ones are taken however they are dealt
    rows = fitting.join(ids, "_id").select("_text", "_y").orderBy(F.xxhash64("_text"), "_text", "_y").limit(2 * max_rows).collect()
    return [(r["_text"], r["_y"]) for r in rows]


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) from the text alone.

    Whole texts are scored in Arrow batches. Null and empty texts have no
    windows and get the score of none. An empty table gives no rows; a column
    named ``score`` is replaced."""
    docs = docs.drop("score")
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = model.scores(t.as_py() for t in batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def toxicity_model(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(training_sample(docs, labels))


def op9_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model fitted outside fold 0."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model).withColumn("held_out", fold(F.col("doc_id")) == 0)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
