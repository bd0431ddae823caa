"""Byte-level BPE vocabularies in rank files; the folder is a parameter, none is shipped."""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from pathlib import Path

FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: How text is cut before merges; what the public rank files were made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path() -> str:
    return f"{FOLDER}/{VOCABULARY}"


@lru_cache(4)
def ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


@lru_cache(4)
def version(path: str) -> str:
    """Digest of the vocabulary and the pattern: two tokenizers that differ have different ones."""
    return hashlib.sha256(Path(path).read_bytes() + PATTERN.encode()).hexdigest()[:16]


@lru_cache(4)
def encoding(path: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})
