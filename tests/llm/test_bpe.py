"""Merge replay against tiktoken, and the way back."""

import hashlib
import random

import pytest

from tapewise.llm import bpe


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.merges(bpe.DEFAULT).ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    kinds = [(32, 127), (160, 0x2FF), (0x370, 0x500), (0x4E00, 0x4F00), (0x1F300, 0x1F700), (9, 14), (0x2000, 0x2070), (0, 0x20)]
    mixed = ["".join(chr(rng.randrange(*rng.choice(kinds))) for _ in range(rng.randrange(1, 300))) for _ in range(150)]
    few = ["".join(rng.choice("abt hen'") for _ in range(400)) for _ in range(20)]
    return [None, "", " ", "a", "\n\n", "it's  we'LL\t\r\n x", "<|endoftext|>", "naïve Ωμέγα 中文 🙂👩‍👩‍👧", "a" * 5000, "ab" * 3000, " " * 3000, "\x1c\x1d\x85᠎​﻿ x", "é" * 50, *mixed, *few]


def test_ids_are_those_of_tiktoken(tiktoken_encoding):
    rows = texts()
    offsets, ids = bpe.encode_texts(rows)
    got = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)]
    assert got == [tiktoken_encoding.encode_ordinary(t or "") for t in rows]


def test_words_are_cut_as_tiktoken_cuts(tiktoken_encoding):
    """Every code point between letters, digits and spaces."""
    points = [c for c in range(0x3000) if not 0xD800 <= c < 0xE000] + [*range(0xFE00, 0x10000, 7), *range(0x1F000, 0x1FA00, 3)]
    for a in range(0, len(points), 512):
        text = "".join(f"a{chr(c)}1 {chr(c)}  {chr(c)}{chr(c)}. " for c in points[a : a + 512])
        _, ids = bpe.encode_texts([text])
        assert ids.tolist() == tiktoken_encoding.encode_ordinary(text)


def test_merges_of_lower_rank_go_first(tmp_path):
    """A file whose merges can give a lower rank than theirs, against each word by itself."""
    import base64

    rng = random.Random(2)
    tokens = [bytes([b]) for b in range(256)]
    seen = set(tokens)
    while len(tokens) < 256 + 60:
        t = bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6)))
        if t not in seen:
            seen.add(t)
            tokens.append(t)
    path = tmp_path / "x.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(tokens)))
    rank = {t: i for i, t in enumerate(tokens)}

    def alone(word):
        parts = [bytes([b]) for b in word]
        if word in rank:
            return [rank[word]]
        while True:
            found = [(rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank]
            if not found:
                return [rank[p] for p in parts]
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    words = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 40))) for _ in range(600)]
    m, want = bpe.Merges(str(path)), [alone(w) for w in words]
    sizes, ids = m.replay(words)
    assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert [m.alone(w) for w in words] == want


def test_encode_and_decode(spark, tiktoken_encoding, monkeypatch):
    rows = [(i, t, "clash", -1) for i, t in enumerate([*texts(), "word " * 200_000, "same", "same"])]
    rows.append((None, "no id", None, None))
    df = spark.createDataFrame(rows, "doc_id long, text string, bytes string, ids int").repartition(3)
    out = bpe.decode(bpe.encode(df)).collect()
    want = sorted(((i, tiktoken_encoding.encode_ordinary(t or "")) for i, t, _, _ in rows), key=str)
    assert sorted(((r["doc_id"], r["ids"]) for r in out), key=str) == want
    own = {i: t for i, t, _, _ in rows}
    assert all(bytes(r["bytes"]) == (own[r["doc_id"]] or "").encode() for r in out)
    assert out[0].asDict().keys() == {"doc_id", "ids", "bytes"}
    assert bpe.encode(df.limit(0)).collect() == []
    nulls = spark.createDataFrame([(None,), ([],), ([0, 1],)], "ids array<int>")
    assert sorted(bytes(r[0]) for r in bpe.decode(nulls).select("bytes").collect())[:2] == [b"", b""]


def test_query(spark, tmp_path):
    spark.createDataFrame([(1, "Hello world"), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in bpe.op12_merge_replay_bpe(spark, str(tmp_path)).collect()}
    offsets, ids = bpe.encode_texts(["Hello world"])
    assert got[1]["n_tokens"] == len(ids) and got[1]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got[1]["decoded_sha256"] == hashlib.sha256(b"Hello world").hexdigest()
    assert got[2]["n_tokens"] == 0 and got[2]["decoded_sha256"] == got[3]["ids_sha256"] == hashlib.sha256(b"").hexdigest()

