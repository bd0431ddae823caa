"""Scores over normalised, stemmed words, as published for German: ROUGE-1, -2 and -L with CISTEM stems."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .pairs import gram_counts, lcs_length

_FIELDS = [f"rouge{k}_{x}" for k in ("1", "2", "L") for x in ("precision", "recall", "fmeasure")]


@lru_cache(100_000)
def cistem(word: str) -> str:
    """German stems (Weissweiler and Fraser, 2017). A word with a capital, as nouns have, keeps a last t."""
    noun = word[:1].isupper()
    word = word.lower().replace("ü", "u").replace("ö", "o").replace("ä", "a").replace("ß", "ss")
    word = re.sub(r"^ge(.{4,})", r"\1", word)
    word = word.replace("sch", "$").replace("ei", "%").replace("ie", "&")
    word = re.sub(r"(.)\1", r"\1*", word)
    while len(word) > 3:
        if len(word) > 5:
            word, n = re.subn(r"e[mr]$", "", word)
            if n:
                continue
            word, n = re.subn(r"nd$", "", word)
            if n:
                continue
        word, n = re.subn(r"t$", "", word) if not noun else (word, 0)
        if n:
            continue
        word, n = re.subn(r"[esn]$", "", word)
        if not n:
            break
    word = re.sub(r"(.)\*", r"\1\1", word)
    return word.replace("%", "ei").replace("&", "ie").replace("$", "sch")


def scored_words(text: str, stems: bool = True) -> list[str]:
    """ASCII letters and digits in lower case, words of more than three of them stemmed."""
    return [cistem(w) if stems and len(w) > 3 else w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def _prf(hits: int, prediction: int, target: int) -> tuple[float, float, float]:
    p, r = hits / max(prediction, 1), hits / max(target, 1)
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def rouge_scores(prediction: Column | str, target: Column | str, *, stems: bool = True) -> Column:
    """struct of rouge1, rouge2 and rougeL with precision, recall and fmeasure each."""

    @F.pandas_udf(", ".join(f"{f} double" for f in _FIELDS))
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a, b):
            if x is None or y is None:
                out.append([None] * 9)
                continue
            x, y = scored_words(x, stems), scored_words(y, stems)
            row = []
            for n in (1, 2):
                p, t = gram_counts(x, n), gram_counts(y, n)
                row += _prf((p & t).total(), p.total(), t.total())
            out.append(row + list(_prf(lcs_length(x, y), len(x), len(y))))
        return pd.DataFrame(out, columns=_FIELDS, dtype="float64")

    return run(prediction, target)
