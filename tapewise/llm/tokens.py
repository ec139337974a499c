"""Token ids of whole texts, in Arrow batches on the executors.

Ids are those of the ``tokenizers`` file given (byte-level BPE). They are
computed by tiktoken from that file's own vocabulary, which is about five times
as fast here; ``tests/llm`` holds both against each other.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import public_tokenizers

DEFAULT = public_tokenizers.path("byte_bpe_50k.json")
#: The pre-tokenizer of byte-level BPE files.
_PATTERN = public_tokenizers.PATTERN


def _byte_of_char() -> dict[str, int]:
    """Byte-level files write printable bytes as themselves and the others as
    the characters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def encoder(path: str = DEFAULT):
    """Encoder of a byte-level BPE ``tokenizers`` file; one a worker process.

    Added tokens are cut out of a text before anything else, as the file asks."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    if spec.get("normalizer") or any(t.get(flag) for t in spec["added_tokens"] for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path}: normalizers and added tokens that depend on what is beside them aren't known here")
    to_byte = _byte_of_char()
    ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=added)


def token_ids(text: str | None, path: str = DEFAULT) -> np.ndarray:
    """Ids of a whole text as little-endian uint32, as ``tokenizers`` gives them
    from the file as loaded: the string of an added token is that token. Null
    and empty texts have no ids."""
    if not text:
        return np.empty(0, dtype="<u4")
    return encoder(path).encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


@cache
def vocabulary_size(path: str = DEFAULT) -> int:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1
