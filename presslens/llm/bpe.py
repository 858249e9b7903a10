"""The public byte-level BPE vocabulary, from a file outside the repository."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"

# Fixed value: how the vocabulary's words are split, as published with it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = r"\t-\r \x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same for Java, whose ``\s`` is ASCII only.
JAVA_PATTERN = PATTERN.replace(r"[^\s", rf"[^{WHITE}").replace(r"(?!\S)", rf"(?![^{WHITE}])").replace(r"\s+", rf"[{WHITE}]+")


@lru_cache(maxsize=4)
def ranks(path: str = TOKENIZERS, name: str = VOCABULARY) -> dict[bytes, int]:
    with open(os.path.join(path, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoding(path: str = TOKENIZERS, name: str = VOCABULARY):
    import tiktoken

    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks(path, name), special_tokens={})
