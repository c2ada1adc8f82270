"""Public byte-level BPE vocabularies, loaded once a Python worker."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import tiktoken

#: Where the vocabulary is; a parameter of every operator that tokenizes.
VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: How text is split before merges; the published pattern of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def encoding(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})
