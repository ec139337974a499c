"""Spelling variants against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tapewise.llm.spelling import WordAutomaton, near_words, op11_spelling_variants, runs, variants, with_typos


def is_near(a, b):
    """Exactly one letter inserted, left out or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    return sorted((a, b) for a, b in itertools.permutations(set(words), 2) if is_near(a, b))


def some_words(rng, n, letters="abé", most=9):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(most))) for _ in range(n)]


def test_automaton_numbers_its_words():
    rng = random.Random(1)
    for n in (0, 1, 2, 60, 400):
        words = sorted(set(some_words(rng, n)))
        a = WordAutomaton(words)
        for i, w in enumerate(words):
            state, number = np.array([a.root]), 0
            for c in w:
                which, edge = a.step(state, np.array([ord(c) + 1]))
                assert len(which) == 1
                number += a.skip[edge][0]
                state = a.target[edge]
            assert number == i and a.final[state][0]


def test_automaton_is_minimal():
    a = WordAutomaton(sorted(x + y for x in ("a", "b", "ca") for y in ("", "ing", "ings", "ed")))
    endings = {w: frozenset(x[len(w) :] for x in (x + y for x in ("a", "b", "ca") for y in ("", "ing", "ings", "ed")) if x.startswith(w)) for w in ("", "a", "b", "c", "ca", "ai", "ain", "aing", "aings", "ae")}
    assert len(a.final) == len(set(endings.values()))


def test_search_is_every_word_one_error_away():
    rng = random.Random(2)
    words = sorted(set(some_words(rng, 300, "abc", 7)))
    a = WordAutomaton(words)
    for length in (1, 2, 5, 6):
        asked = [w for w in words if len(w) == length]
        for exact in (0, length // 2, length):
            i, number = a.search(asked, np.full(len(asked), exact))
            got = {(asked[x], words[y]) for x, y in zip(i, number, strict=True)}
            assert got == {(u, v) for u in asked for v in words if is_near(u, v) and len(v) <= len(u) and (u[:exact] == v[:exact]) and any(u[:j] + u[j + 1 :] == v or (len(u) == len(v) and u[:j] + v[j] + u[j + 1 :] == v) for j in range(exact, length))}


@pytest.mark.parametrize("crowd", [20_000, 30, 3])
def test_near_words(spark, crowd):
    rng = random.Random(crowd)
    stem = "x" * 12
    words = [*some_words(rng, 250), *(stem + w for w in some_words(rng, 60)), *(w + stem for w in some_words(rng, 60)), *(stem + w + stem for w in some_words(rng, 40)), "", "a", "a\x00", "🙂b", "b"]
    df = spark.createDataFrame([(w,) for w in [*words, *words[:20], None]], "word string").repartition(3)
    assert sorted(map(tuple, near_words(df, crowd=crowd).collect())) == brute(words)
    assert near_words(df.limit(0), crowd=crowd).collect() == []


def test_very_long_words(spark):
    long = "ab" * 20_000
    words = [long, long[:7] + "z" + long[7:], long[:-3] + long[-2:], long[:30_000] + "q" + long[30_001:], long[2:]]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    assert sorted(map(tuple, near_words(df).collect())) == brute(words)


def expected(counts, ratio=2):
    out, form = {}, {}
    for w, n in counts.items():
        near = [v for v in counts if is_near(w, v)]
        best = min(near, key=lambda v: (-counts[v], v.encode()), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
        out[w] = [w, form[w], w, n, len(near), counts[best] if form[w] is not None else None]
    for w in counts:
        end = w
        while form[end] is not None:
            end = form[end]
        out[w][2] = end
    return sorted(map(tuple, out.values()))


def test_variants(spark):
    rng = random.Random(9)
    counts = Counter({w: rng.choice([1, 1, 2, 3, 4, 8, 16, 40, 90]) for w in some_words(rng, 300, "abcé", 6)})
    counts |= {"m" * k: 2**k for k in range(20)}  # a long chain of forms
    rows = [(w, n, "clash") for w, n in counts.items()]
    df = spark.createDataFrame([*rows, (None, 5, "")], "word string, n long, form string")
    assert sorted(map(tuple, variants(df).collect())) == expected(counts)
    assert variants(df.limit(0)).collect() == []
    twice = spark.createDataFrame([("abcde", 1, ""), ("abcde", 2, ""), ("abcdf", None, "")], "word string, n long, form string")
    assert sorted(map(tuple, variants(twice).collect())) == [("abcde", None, "abcde", 3, 1, None), ("abcdf", "abcde", "abcde", 0, 1, 3)]


def test_query_is_the_rule(spark, tmp_path):
    rng = random.Random(4)
    lexicon = ["hello", "Hallo", "HELLO", "straße", "élève", "ÉLÈVE", "wörter×", "common", "commons", "comon", "x", "abcd", *("lang" * 30 + c for c in "abc")]
    docs = [(i, " ".join(rng.choice(lexicon) for _ in range(60)) + f" {i}1a") for i in range(120)]
    docs += [(500, None), (501, ""), (None, "hello hello hello"), (502, "y" * 300_000), (7, docs[7][1])]
    spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, word string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    counts, changed = Counter(), 0
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode()) if doc is not None else zlib.crc32(run.encode())
            if h % 97 == 0:
                run, changed = run[: h % len(run)] + run[h % len(run) + 1 :], changed + 1
            counts[run] += 1
    assert changed > 20
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    assert sorted(map(tuple, op11_spelling_variants(spark, str(tmp_path)).collect())) == expected(counts)
    assert with_typos(runs(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
