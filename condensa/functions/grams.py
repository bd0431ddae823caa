"""Words and n-grams of many texts at once: words are numbers, equal runs of them are found by sorting."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

#: Signs of the texts that are looked at together; a longer text is by itself.
SIGNS = 1 << 20


def text_slices(texts: pa.Array, signs: int = SIGNS) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) for neighbours of at most so many signs together."""
    for a in range(0, len(texts), 128):
        held, size = [], 0
        for k, t in enumerate(texts.slice(a, 128).to_pylist()):
            if held and size + len(t or "") > signs:
                yield a + k - len(held), held
                held, size = [], 0
            held.append(t)
            size += len(t or "")
        yield min(a + 128, len(texts)) - len(held), held


def numbered(lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(the number of each word of all lists, the list it is in, the words by their numbers)."""
    number: defaultdict[str, int] = defaultdict()
    number.default_factory = number.__len__
    sizes = [len(x) for x in lists]
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(lists)), np.int64, sum(sizes))
    return ids, np.repeat(np.arange(len(lists)), sizes), list(number)


def distinct(code: np.ndarray) -> np.ndarray:
    """Each code once, in order."""
    own = np.sort(code)
    return own[np.concatenate([np.ones(min(len(own), 1), bool), own[1:] != own[:-1]])]


def ranked(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rank of each code among the distinct ones; of each distinct one, in order, the first place and how often it comes)."""
    if not len(code):
        return code, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(code)
    own = code[order]
    new = np.empty(len(own), bool)
    new[0] = True
    np.not_equal(own[1:], own[:-1], out=new[1:])
    start, rank = np.flatnonzero(new), np.empty(len(own), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, np.minimum.reduceat(order, start), np.diff(np.append(start, len(own)))


def room(part: np.ndarray) -> np.ndarray:
    """How many words there are from each word on to the end of its part. part: a number for each word, the same for neighbours of one part."""
    ends = np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)) if len(part) else np.zeros(0, np.int64)
    return np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(part))


def grams(ids: np.ndarray, left: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, first places, counts) of the distinct n-grams for each n up to most, in the order of their words' numbers. left: as by room."""
    at, rank = np.arange(len(ids)), ids
    wide = int(ids.max()) + 1 if len(ids) else 1
    for n in range(1, most + 1):
        if n > 1:
            keep = left[at] >= n
            at = at[keep]
            rank = rank[keep] * wide + ids[at + n - 1]
        rank, first, count = ranked(rank)
        yield n, at[first], count
