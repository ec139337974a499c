"""Operator 11, spelling variants by forward and backward word automata.

Two words one edit apart share one half of the longer one exactly. Words are
dealt by such halves; a task lays a minimal acyclic automaton over the words of
its halves, read forwards for front halves and backwards for back halves, whose
perfect hash numbers words. A word walks its half exactly and completes the rest
with one error. Halves of very many words are halved again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewise.llm._common import documents, materialize, release

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_RUN = "[A-Za-zÀ-ÿ]+"
#: In op11, what has a crc32 that this divides loses a letter.
TYPO = 97
LEAST_CHARS, LEAST_COUNT = 5, 3
#: A form is at least so many times as frequent.
RATIO = 2
#: A half of more words than this is halved again.
CROWD = 20_000
#: An automaton takes whole keys up to so many letters, or one key; searches go by so many words at once.
LAID, ASKED = 1_000_000, 8192
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, lengths): a row for each word, its code points plus 1, 0 after its end."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    width = int(lengths.max(initial=0))
    codes = np.zeros((len(words), width), dtype=np.uint32)
    if width:
        codes[np.arange(width) < lengths[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32) + np.uint32(1)
    return codes, lengths


class WordAutomaton:
    """The minimal acyclic automaton of distinct words in code-point order.

    States of the words' trie that accept the same endings are one state. An
    edge knows how many words come before those that pass it, so that the sum
    along a word's path is its number (0 for the first): a perfect hash."""

    def __init__(self, words: list[str]):
        codes, lengths = letters(words)
        n, width = codes.shape
        rows = np.arange(n)
        # first depth at which a word differs from the one before it
        other = np.ones((n, width + 1), dtype=bool)
        other[1:, :width] = codes[1:] != codes[:-1]
        apart = other.argmax(axis=1) if n else np.zeros(0, dtype=np.int64)
        apart[:1] = -1
        parent, letter, ending, depth_of = [], [], [], []
        state = np.zeros(n, dtype=np.int64)  # of each word at this depth
        total = 1
        parent.append(np.array([-1]))
        letter.append(np.array([0], dtype=np.uint32))
        ending.append(np.array([bool(n) and lengths[0] == 0]))
        depth_of.append((0, 1))
        for d in range(1, width + 1):
            long = rows[lengths >= d]
            new = apart[long] < d
            new[:1] = True
            place = np.cumsum(new) - 1
            first = long[new]
            parent.append(state[first])
            letter.append(codes[first, d - 1])
            end = np.zeros(len(first), dtype=bool)
            end[place[lengths[long] == d]] = True
            ending.append(end)
            state[long] = total + place
            depth_of.append((total, total + len(first)))
            total += len(first)
        up, by, final = (np.concatenate(x) for x in (parent, letter, ending))
        # what each state accepts, from the deepest up: a hash and the number of words
        below, sizes = np.where(final, _M1, np.uint64(1)), final.astype(np.int64)
        with np.errstate(over="ignore"):
            for a, b in reversed(depth_of[1:]):
                np.add.at(below, up[a:b], _mix(_mix(below[a:b]) ^ (by[a:b].astype(np.uint64) * _M1)))
                np.add.at(sizes, up[a:b], sizes[a:b])
        _, kept, state_of = np.unique(below, return_index=True, return_inverse=True)
        edges = np.flatnonzero(np.concatenate(([False], kept[state_of[up[1:]]] == up[1:])))  # those of the states that stay
        source = state_of[up[edges]]
        order = np.lexsort((by[edges], source))
        edges, source = edges[order], source[order]
        self.source, self.letter, self.target = source, by[edges], state_of[edges]
        self.final, self.root = final[kept], int(state_of[0])
        self.first = np.searchsorted(source, np.arange(len(kept) + 1))
        before = np.cumsum(sizes[edges]) - sizes[edges]
        start = self.first[source]
        self.skip = before - before[start] + self.final[source] if len(edges) else before
        self.key = (source.astype(np.int64) << 32) | self.letter

    def step(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which, edge): the states that have an edge of their letter."""
        if not len(self.key) or not len(state):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        wanted = (state << 32) | letter
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        which = np.flatnonzero(self.key[at] == wanted)
        return which, at[which]

    def fan(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which, edge): all edges of the states."""
        many = self.first[state + 1] - self.first[state]
        which = np.repeat(np.arange(len(state)), many)
        return which, np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first[state], many)

    def search(self, words: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, number): words of the automaton that word i, all of one length,
        becomes by one letter replaced or left out after its first ``exact[i]``."""
        codes, _ = letters(words)
        n, width = codes.shape
        asked, state, number = np.arange(n), np.full(n, self.root), np.zeros(n, dtype=np.int64)
        # those with their error behind them
        asked1, state1, number1 = (np.empty(0, dtype=np.int64) for _ in range(3))
        for d in range(width):
            letter = codes[:, d].astype(np.int64)
            which, edge = self.step(state1, letter[asked1])
            done = [(asked1[which], self.target[edge], number1[which] + self.skip[edge])]
            free = exact[asked] <= d
            # of a run of equal letters any one left out gives the same word
            new = free & ((exact[asked] == d) | (codes[asked, d] != codes[asked, max(d - 1, 0)]) | (d == 0))
            done.append((asked[new], state[new], number[new]))
            which, edge = self.fan(state[free])
            unlike = self.letter[edge] != letter[asked[free][which]]
            which, edge = which[unlike], edge[unlike]
            done.append((asked[free][which], self.target[edge], number[free][which] + self.skip[edge]))
            asked1, state1, number1 = (np.concatenate(x) for x in zip(*done, strict=True))
            which, edge = self.step(state, letter[asked])
            asked, state, number = asked[which], self.target[edge], number[which] + self.skip[edge]
        good = self.final[state1]
        return asked1[good], number1[good]


def _halves(word: Column, exact: Column, chars: Column) -> Column:
    """Readings of a word whose first ``exact`` letters are settled, ``chars`` in
    all: (way, chars of the asking word, reading, letters settled), once as a
    word that asks and once as one that is a letter shorter."""
    out = []
    for more in (0, 1):
        asks = chars + more
        front = F.floor((asks - exact) / 2).cast("int")
        out.append(F.struct(F.lit("f").alias("way"), asks.alias("asks"), word.alias("read"), (exact + front).alias("exact")))
        back = F.concat(F.substring(word, F.lit(1), exact), F.reverse(F.substring(word, exact + 1, chars - exact)))
        out.append(F.struct(F.lit("b").alias("way"), asks.alias("asks"), back.alias("read"), (asks - front).alias("exact")))
    return F.filter(F.array(*out), lambda x: x["exact"] <= chars)


def _key() -> Column:
    return F.xxhash64("way", "asks", "exact", F.substring("read", F.lit(1), F.col("exact")))


def _dealt(words: DataFrame, crowd: int) -> DataFrame:
    """(word, way, asks, read, exact, key): each word by its exact halves.

    Of a key of over ``crowd`` words all rows are halved again in what isn't
    settled yet, so that more of their letters have to agree."""
    chars = F.length("word").cast("int")
    rows = words.select("word", F.explode(_halves(F.col("word"), F.lit(0), chars)).alias("x")).select("word", "x.*").withColumn("key", _key())
    out = []
    while True:
        rows = materialize(rows, "halves")
        out.append(rows)
        crowded = materialize(rows.where(F.col("asks") - F.col("exact") > 1).groupBy("key").count().where(F.col("count") > crowd).select("key"), "crowded")
        if crowded.isEmpty():
            release(crowded)
            break
        out[-1] = rows.join(crowded, "key", "left_anti").select(rows.columns)
        again = rows.join(crowded, "key", "left_semi")
        # a word a letter shorter goes only with the words that ask, as before
        rows = again.select("word", F.col("way").alias("was"), F.col("asks").alias("for"), F.explode(_halves(F.col("read"), F.col("exact"), F.length("read").cast("int"))).alias("x"))
        rows = rows.where("for = x.asks").select("word", F.concat("was", F.col("x.way"), F.lit("-"), F.col("x.exact").cast("string")).alias("way"), "x.asks", "x.read", "x.exact").withColumn("key", _key())
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[str], np.ndarray, int]]:
    """(words, readings, exact, chars of an asking word) of whole keys of one way
    and length, from batches sorted by these."""
    held: list[list] = [[], [], []]
    last: tuple | None = None
    size = 0

    def block():
        return held[0], held[1], np.array(held[2], dtype=np.int64), last[1]

    for batch in batches:
        way, asks, key, word, read, exact = (c.to_pylist() for c in batch.columns)
        for i in range(batch.num_rows):
            now = (way[i], asks[i], key[i])
            if last is not None and now != last and (now[:2] != last[:2] or size >= LAID):
                yield block()
                held, size = [[], [], []], 0
            last, size = now, size + len(read[i])
            for to, x in zip(held, (word[i], read[i], exact[i]), strict=True):
                to.append(x)
    if held[0]:
        yield block()


def near_words(words: DataFrame, word: str = "word", crowd: int = CROWD) -> DataFrame:
    """(word, near): both ways round, all pairs of distinct ``words`` that differ
    by exactly one letter inserted, left out or replaced, each once.

    Null words have no partners; repeated words count as one; the empty word is
    near words of one letter. An empty table gives none. A task holds the words
    of some keys, ``crowd`` for one key that can still be halved.
    """
    spark = words.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = words.select(F.col(word).alias("word")).where("word IS NOT NULL").distinct()
    dealt = _dealt(distinct, crowd)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, reads, exact, asks in _blocks(batches):
            named = dict(zip(reads, own, strict=True))
            laid = sorted(named)
            automaton = WordAutomaton(laid)
            asking = [i for i, r in enumerate(reads) if len(r) == asks]
            for a in range(0, len(asking), ASKED):
                part = asking[a : a + ASKED]
                i, number = automaton.search([reads[j] for j in part], exact[part])
                both = [(own[part[x]], named[laid[y]]) for x, y in set(zip(i.tolist(), number.tolist(), strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in both], pa.string()) for k in (0, 1)], names=["a", "b"])

    placed = dealt.repartition(parts, "key").sortWithinPartitions("way", "asks", "key").select("way", "asks", "key", "word", "read", "exact")
    found = placed.mapInArrow(run, "a string, b string")
    each = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"))))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().select(each.alias("x")).select("x.*")


def variants(words: DataFrame, ratio: int = RATIO, crowd: int = CROWD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words`` (word, n).

    A word's form is its most frequent near word (of equals the least by code
    points), if that is at least ``ratio`` times as frequent; its root is the
    last of the forms that follow one another, itself if it has none. Counts of
    repeated words are summed, null words go, a null count is 0. An empty table
    gives no rows.
    """
    counted = materialize(words.where("word IS NOT NULL").groupBy("word").agg(F.sum(F.coalesce("n", F.lit(0))).cast("long").alias("n")), "words")
    near = near_words(counted, crowd=crowd).join(counted.withColumnRenamed("word", "near").withColumnRenamed("n", "near_n"), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    rows = counted.join(best, "word", "left")
    takes = F.col("n") * ratio <= -F.col("best.less")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n"))
    rows = materialize(rows, "forms")
    root = _roots(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    out = rows.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    out = materialize(out, "variants")
    release(counted, rows, root)
    return out


def _roots(held: DataFrame) -> DataFrame:
    """Follow the links (word, root) to the last: each round goes to where the
    link's end goes, so rounds grow with the logarithm of the longest way."""
    held = materialize(held, "roots")
    while True:
        further = held.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = materialize(held.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        release(held)
        held = new.select("word", "root")
        held._scratch = new._scratch
        if new.where("moved").isEmpty():
            return held


def runs(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, run): each run of letters of the texts, A-Z in lower case. Null texts have none."""
    run = F.explode(F.regexp_extract_all(F.translate(text, _UPPER, _UPPER.lower()), F.lit(_RUN), 0))
    return docs.select(F.col(doc).alias("doc"), run.alias("run"))


def with_typos(found: DataFrame, every: int = TYPO) -> DataFrame:
    """(run): of runs whose crc32 with their document's id is divided by
    ``every``, one letter is gone."""
    h = F.crc32(F.concat_ws(":", F.col("doc").cast("string"), F.col("run")).cast("binary"))
    at = F.pmod(h, F.length("run").cast("long")).cast("int")
    without = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return found.select(F.when(F.pmod(h, F.lit(every)) == 0, without).otherwise(F.col("run")).alias("run"))


def frequent(found: DataFrame, chars: int = LEAST_CHARS, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the runs of at least ``chars`` letters that occur ``count`` times."""
    return found.where(F.length("run") >= chars).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= count)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the frequent words of all documents."""
    return variants(frequent(with_typos(runs(documents(spark, sf_dir)))))
