"""Which source sentence a summary's sentence comes from.

A row holds both sides as arrays of sentences, so that a document is aligned where it is:
the passes are narrow, in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pairs import _finder, gram_counts

ATTRIBUTES = ("precision", "recall", "fmeasure")
_MATCH = "array<struct<summary_pos:int,source_pos:int,sentence:string,metric:double,relative_position:double>>"


def _score(hits: int, target: int, prediction: int, attribute: str) -> float:
    p, r = hits / max(prediction, 1), hits / max(target, 1)
    if attribute == "precision":
        return p
    if attribute == "recall":
        return r
    return 2 * p * r / (p + r) if p + r else 0.0


def best_matches(targets: list[str], sources: list[str], n: int, attribute: str, exact_first: bool, find) -> list[dict]:
    """For each target the source of the highest score, the first of equals.

    Only sources that share a gram are scored, by an index of grams: all others score 0.
    """
    counts = [gram_counts(find(s), n) for s in sources]
    totals = [c.total() for c in counts]
    index: dict = {}
    for k, c in enumerate(counts):
        for g, m in c.items():
            index.setdefault(g, []).append((k, m))
    place = {}
    for k, s in enumerate(sources):
        place.setdefault(s, k)
    out = []
    for t, text in enumerate(targets):
        if exact_first and text in place:
            best, score = place[text], 1.0
        else:
            own = gram_counts(find(text), n)
            hits: dict[int, int] = {}
            for g, m in own.items():
                for k, c in index.get(g, ()):
                    hits[k] = hits.get(k, 0) + min(m, c)
            size, best, score = own.total(), 0, 0.0
            for k in sorted(hits):
                if (x := _score(hits[k], size, totals[k], attribute)) > score:
                    best, score = k, x
        out.append({"summary_pos": t, "source_pos": best, "sentence": sources[best], "metric": score, "relative_position": best / max(len(sources) - 1, 1)})
    return out


def _aligned(summary: Column, source: Column, n: int, attribute: str, exact_first: bool) -> Column:
    if attribute not in ATTRIBUTES:
        raise ValueError(f"attribute must be one of {ATTRIBUTES}")

    @F.pandas_udf(_MATCH)
    def match(a: pd.Series, b: pd.Series) -> pd.Series:
        find = _finder()
        return pd.Series([None if x is None or y is None else best_matches(list(x), list(y), n, attribute, exact_first, find) if len(y) else [] for x, y in zip(a, b)], dtype=object)

    return match(summary, source)


def rouge_matches(summary: Column, source: Column, *, n: int = 2, attribute: str = "recall") -> Column:
    """An array of matches, one for each summary sentence; without source sentences an empty one."""
    return _aligned(summary, source, n, attribute, False)


def closest_matches(summary: Column, source: Column, *, n: int = 2, attribute: str = "fmeasure") -> Column:
    """As rouge_matches, but a source sentence that is the same text comes first."""
    return _aligned(summary, source, n, attribute, True)


def greedy_matches(summary: Column, source: Column, *, n: int = 2, attribute: str = "fmeasure") -> Column:
    """Positions of source sentences in the order chosen: each time the one with which the chosen ones' joint text scores best; ends when none scores higher."""
    if attribute not in ATTRIBUTES:
        raise ValueError(f"attribute must be one of {ATTRIBUTES}")

    @F.pandas_udf("array<int>")
    def choose(a: pd.Series, b: pd.Series) -> pd.Series:
        find, out = _finder(), []
        for x, y in zip(a, b):
            if x is None or y is None:
                out.append(None)
                continue
            target = gram_counts(find(" ".join(x)), n)
            tokens, chosen, words, score = [find(s) for s in y], [], [], 0.0
            known = {w for g in target for w in g}  # over the seam with what was chosen, a first word may complete a gram
            left = [k for k, t in enumerate(tokens) if not target.keys().isdisjoint(gram_counts(t, n)) or (n > 1 and t and t[0] in known)]
            have = gram_counts(words, n)
            while left:
                best, gain = None, score
                for k in left:  # a candidate adds its own grams and those over the seam
                    new = have + gram_counts(words[len(words) - n + 1 :] + tokens[k] if n > 1 else tokens[k], n)
                    v = _score((new & target).total(), target.total(), new.total(), attribute)
                    if v > gain:
                        best, gain = k, v
                if best is None:
                    break
                words += tokens[best]
                chosen.append(best)
                left.remove(best)
                have, score = gram_counts(words, n), gain
            out.append(chosen)
        return pd.Series(out, dtype=object)

    return choose(summary, source)


def vector_matches(summary: DataFrame, source: DataFrame, *, doc: str, pos: str, vector: str) -> DataFrame:
    """(doc, summary_pos, source_pos, metric, relative_position) by cosine of given vectors, the first of equals; the position is by the count of sentences, not the last one's place.

    A document's vectors meet in one task, as two matrices.
    """
    kind = summary.schema[doc].dataType.simpleString()

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc", "summary_pos", "source_pos", "metric", "relative_position"]
        if not len(a) or not len(b):
            return pd.DataFrame(columns=columns)
        a, b = a.sort_values("pos"), b.sort_values("pos")
        x, y = (np.stack(v.to_numpy()).astype(np.float64) for v in (a["vector"], b["vector"]))
        x, y = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) for v in (x, y))
        sims = np.round(x @ y.T, 9)
        at = sims.argmax(1)
        return pd.DataFrame({"doc": a["doc"].to_numpy(), "summary_pos": a["pos"].to_numpy(), "source_pos": b["pos"].to_numpy()[at], "metric": sims[np.arange(len(a)), at], "relative_position": at / len(b)})

    own = [df.select(F.col(doc).alias("doc"), F.col(pos).cast("int").alias("pos"), F.col(vector).alias("vector")) for df in (summary, source)]
    return own[0].groupBy("doc").cogroup(own[1].groupBy("doc")).applyInPandas(best, f"doc {kind}, summary_pos int, source_pos int, metric double, relative_position double")


def in_source_order(matches: Column) -> Column:
    """Matches by relative position, those at the same one as they come in the summary."""
    return F.array_sort(matches, lambda a, b: F.when(a["relative_position"] < b["relative_position"], -1).when(a["relative_position"] > b["relative_position"], 1).otherwise(a["summary_pos"] - b["summary_pos"]))
