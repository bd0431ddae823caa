"""Vectorised word and byte n-gram hashing over Arrow string columns.

Everything here works on whole byte buffers with numpy: no Python object is
made for a word. Texts are processed in pieces of about a megabyte, cut where a
word ends, so the memory needed does not depend on the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    forth, back = np.full(n, _BASE), np.full(n, inverse)
    forth[0] = back[0] = 1
    return np.multiply.accumulate(forth), np.multiply.accumulate(back)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def buffers(texts: pa.Array, *, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n+1 offsets; null counts as ''."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    offs = np.frombuffer(off, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def _is_word(data: np.ndarray) -> np.ndarray:
    """True on bytes of letters and digits; general punctuation beyond ASCII is not."""
    word = _WORD[data]
    for lead, second, width in ((0xC2, None, 2), (0xE2, (0x80, 0x81), 3), (0xE3, (0x80,), 3)):
        at = np.flatnonzero(data[: len(data) - width + 1] == lead)
        if second is not None:
            at = at[np.isin(data[at + 1], second)]
        else:
            at = at[~np.isin(data[at + 1], (0xAA, 0xB5, 0xBA))]
        for k in range(width):
            word[at + k] = False
    return word


def words(data: np.ndarray, offs: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte) of each word; no word reaches over an offset.

    With prefixes, hash is a matrix: the word's, then that of its first k bytes for each k.
    """
    hashes, starts, ends = [], [], []
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + PIECE)
        if to < n:  # cut after the last byte that is no word's, or at a text's end
            tail = np.flatnonzero(~_WORD[data[at:to]])
            inner = offs[np.searchsorted(offs, to, "right") - 1]
            cut = max(at + int(tail[-1]) + 1 if len(tail) else 0, int(inner))
            while cut <= at:  # a word longer than a piece
                to = min(n, to + PIECE)
                tail = np.flatnonzero(~_WORD[data[at:to]])
                inner = offs[np.searchsorted(offs, to, "right") - 1]
                cut = max(at + int(tail[-1]) + 1 if len(tail) else 0, int(inner)) if to < n else n
            to = cut
            # a multi-byte mark is never cut: its bytes are >= 0x80, so count as a word's above
        piece = data[at:to]
        word = _is_word(piece)
        edge = offs[np.searchsorted(offs, at, "left") : np.searchsorted(offs, to, "left")] - at
        before = np.empty(len(piece), bool)
        before[0] = False
        before[1:] = word[:-1]
        before[edge] = False
        s = np.flatnonzero(word & ~before)
        after = np.empty(len(piece), bool)
        after[-1] = False
        after[:-1] = word[1:]
        after[edge[edge > 0] - 1] = False
        e = np.flatnonzero(word & ~after) + 1
        size = PIECE + 1 if len(piece) < PIECE else 1 << int(len(piece) + 1).bit_length()
        forth, back = _powers(size)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * forth[: len(piece)], out=sums[1:])
        first = back[s]
        own = [mix((sums[e] - sums[s]) * first)]
        own += [mix((sums[np.minimum(e, s + k)] - sums[s]) * first) for k in prefixes]
        hashes.append(np.stack(own, 1) if prefixes else own[0])
        starts.append(s + at)
        ends.append(e + at)
        at = to
    if not hashes:
        return np.zeros((0, 1 + len(prefixes)) if prefixes else 0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def row_slices(offs: np.ndarray, limit: int = 2 * PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes together, or of one row."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def word_slices(texts: pa.Array, *, lower: bool = True, limit: int = 2 * PIECE, prefixes: tuple[int, ...] = ()) -> Iterator[tuple]:
    """(first row, last row + 1, hashes, starts, ends, bounds, bytes, offsets) for ranges of rows.

    bounds[i]:bounds[i+1] are the words of the range's row i; starts and ends count from
    the range's first byte, and so do the offsets.
    """
    data, offs = buffers(texts, lower=lower)
    for lo, hi in row_slices(offs, limit):
        piece, own = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        h, s, e = words(piece, own, prefixes)
        yield lo, hi, h, s, e, np.searchsorted(s, own, "left"), piece, own


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on, for the first len-n+1 words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + h[k : len(h) - n + 1 + k])
    return out


def row_of(bounds: np.ndarray) -> np.ndarray:
    """For each word its row, from the bounds of word_slices."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
