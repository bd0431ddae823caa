"""Measures of a (reference, summary) pair as columns."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .grams import grams, numbered, ranked, room, text_slices
from .text import length_of, strip

#: What the JVM's \s holds, so that both sides cut alike.
_TOKEN = r"[\p{L}\p{N}]+|[^ \t\n\x0b\f\r\p{L}\p{N}]"


def is_fully_extractive(summary: Column | str, reference: Column | str) -> Column:
    return F.contains(F.col(reference) if isinstance(reference, str) else reference, F.col(summary) if isinstance(summary, str) else summary)


def compression_ratio(summary: Column | str, reference: Column | str, metric: str = "char", *, strict: bool = True) -> Column:
    """Reference by summary length. An empty summary is an error, or null where not strict."""
    r, s = length_of(reference, metric), length_of(summary, metric)
    return r / s if strict else F.try_divide(r, s)


def is_summary_longer(summary: Column | str, reference: Column | str, metric: str = "char") -> Column:
    """Texts of equal length count as longer."""
    return length_of(reference, metric) <= length_of(summary, metric)


def is_too_short(text: Column | str, least: int, metric: str = "char") -> Column:
    return length_of(text, metric) < least


def is_either_empty(summary: Column | str, reference: Column | str) -> Column:
    return (strip(summary) == "") | (strip(reference) == "")


def is_identity(summary: Column | str, reference: Column | str, method: str = "exact") -> Column:
    if method != "exact":
        raise ValueError("texts are compared exactly")
    return (F.col(reference) if isinstance(reference, str) else reference).eqNullSafe(F.col(summary) if isinstance(summary, str) else summary)


def _finder():
    import regex

    return regex.compile(_TOKEN).findall


def gram_counts(parts: list[str], n: int) -> Counter:
    return Counter(zip(*(parts[k:] for k in range(n))))


def _overlap(summary: pd.Series, reference: pd.Series, n: pd.Series, lower: pd.Series) -> pd.DataFrame:
    find, out = _finder(), []
    for s, r, k, low in zip(summary, reference, n, lower):
        if s is None or r is None:
            out.append((None, None, None))
            continue
        a, b = (gram_counts(find(x.lower() if low else x), int(k)) for x in (s, r))
        out.append(((a & b).total(), a.total(), b.total()))
    return pd.DataFrame(out, columns=["hits", "n_summary", "n_reference"], dtype="Int64")


def gram_overlap(summary: Column | str, reference: Column | str, n: int = 2, *, lemmas: bool = False) -> Column:
    """struct(hits, n_summary, n_reference): n-grams as multisets.

    One narrow pass: the grams of a pair never leave its row, where a join of grams would
    shuffle them all. Arrow batches; nulls give nulls.
    """
    return F.pandas_udf(_overlap, "hits long, n_summary long, n_reference long")(summary, reference, F.lit(n), F.lit(lemmas))


def overlap_fraction(overlap: Column) -> Column:
    """Share of the summary's n-grams that the reference has; 0 where it has none."""
    return overlap["hits"] / F.greatest(overlap["n_summary"], F.lit(1))


def novel_fraction(overlap: Column) -> Column:
    return F.lit(1.0) - overlap_fraction(overlap)


def rouge(overlap: Column) -> Column:
    """struct(precision, recall, fmeasure) of the summary as prediction and the reference as target."""
    p, r = overlap_fraction(overlap), overlap["hits"] / F.greatest(overlap["n_reference"], F.lit(1))
    f = F.when(p + r > 0, 2 * p * r / F.when(p + r > 0, p + r)).otherwise(F.lit(0.0))
    return F.struct(p.alias("precision"), r.alias("recall"), f.alias("fmeasure"))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence by bit-parallel rows: a machine word advances 64 cells at a time."""
    if len(a) > len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole
    for x in b:
        if m := places.get(x):
            u = row & m
            row = (row + u | row - u) & whole
    return len(a) - row.bit_count()


def lcs_rows(a: list[str], b: list[str]) -> np.ndarray:
    """The table of lengths, (len(a)+1, len(b)+1), row by row."""
    table = np.zeros((len(a) + 1, len(b) + 1), np.int64)
    other = np.array(b, object)
    for i, x in enumerate(a, 1):
        match = np.append([0], table[i - 1, :-1] + (other == x)) if b else table[i - 1]
        table[i] = np.maximum.accumulate(np.maximum(table[i - 1], match))
    return table


def _lcs(summary: pd.Series, reference: pd.Series, lower: pd.Series) -> pd.DataFrame:
    find, out = _finder(), []
    for s, r, low in zip(summary, reference, lower):
        if s is None or r is None:
            out.append((None, None, None))
            continue
        a, b = (find(x.lower() if low else x) for x in (s, r))
        out.append((lcs_length(a, b), len(a), len(b)))
    return pd.DataFrame(out, columns=["lcs", "n_summary", "n_reference"], dtype="Int64")


def lcs(summary: Column | str, reference: Column | str, *, lemmas: bool = False) -> Column:
    """struct(lcs, n_summary, n_reference) of token sequences."""
    return F.pandas_udf(_lcs, "lcs long, n_summary long, n_reference long")(summary, reference, F.lit(lemmas))


def lcs_fraction(found: Column) -> Column:
    """Share of the summary's tokens; 0 if either side has none."""
    return found["lcs"] / F.greatest(found["n_summary"], F.lit(1))


def gram_repetitions(text: Column | str, n: int = 3) -> Column:
    """n-grams that come again within a text, and how often. Only those become strings, of some texts at a time."""

    @F.arrow_udf("array<struct<gram:string,again:long>>")
    def run(texts: pa.Array) -> pa.Array:
        find, parts, sizes = _finder(), [], [np.zeros(1, np.int64)]
        for _, some in text_slices(texts):
            ids, doc, words = numbered([find(t or "") for t in some])
            rank, _, _ = ranked(doc * len(words) + ids)
            *_, (_, at, count) = grams(rank, room(doc), n)
            at, count = at[count > 1], count[count > 1]
            found = sorted((d, tuple(words[w] for w in ids[i : i + n].tolist()), c - 1) for d, i, c in zip(doc[at].tolist(), at.tolist(), count.tolist()))
            parts.append(pa.StructArray.from_arrays([pa.array([" ".join(g) for _, g, _ in found], pa.string()), pa.array([c for _, _, c in found], pa.int64())], ["gram", "again"]))
            sizes.append(np.bincount(doc[at], minlength=len(some)))
        kind = pa.struct([("gram", pa.string()), ("again", pa.int64())])
        ends = pa.array(np.cumsum(np.concatenate(sizes)), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.concat_arrays(parts) if parts else pa.array([], kind), mask=texts.is_null())

    return run(F.col(text) if isinstance(text, str) else text)
