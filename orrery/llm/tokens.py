"""Byte-level BPE ids, by a vocabulary whose place is a parameter.

The ids are those of the JSON vocabulary under the ``tokenizers`` library; its rank file gives the same ids several
times faster, which ``tests/llm`` checks."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

RANKS = "byte_bpe_50k.tiktoken"
END_OF_TEXT = ("<|endoftext|>", 50256)


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict([END_OF_TEXT]))


def ids(path: str, text: str) -> np.ndarray:
    """uint32 ids; the end-of-text marker inside a text counts as its one id, as the JSON vocabulary has it."""
    return encoder(path).encode_to_numpy(text, allowed_special="all")
