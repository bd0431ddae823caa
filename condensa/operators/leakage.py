"""Texts that come more than once within a split, or in two splits.

Texts are grouped by digest and length, 20 bytes each; only those that are found are looked
up, by a second pass whose other side are the digests found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cut
from ..sources.readers import SPLITS
from ..storage import written

_KEY = ["side", "digest", "length"]


def _sides(pairs: DataFrame, reference: str, summary: str, *, texts: bool = False) -> DataFrame:
    """(split, split_order, side, digest, length) in one pass over the pairs, with texts the text too. Null texts don't count."""
    side = lambda name, c: F.struct(F.lit(name).alias("side"), F.unhex(F.md5(c)).alias("digest"), F.length(c).alias("length"), *([F.col(c).alias("text")] if texts else []))
    return pairs.select("split", "split_order", F.inline(F.array(side("reference", reference), side("summary", summary)))).where("digest IS NOT NULL")


def _repeated(sides: DataFrame) -> DataFrame:
    return sides.groupBy("split", *_KEY).agg(F.count("*").alias("n")).where("n > 1")


def _leaked(sides: DataFrame) -> DataFrame:
    """(side, digest, length, first_split, second_split). One aggregation by text gathers its splits; a text has three at most, so no join is needed."""
    where = sides.groupBy(*_KEY).agg(F.collect_set("split_order").alias("at")).where(F.size("at") > 1)
    two = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(len(SPLITS)) for b in range(a + 1, len(SPLITS))])
    names = F.array(*[F.lit(s) for s in SPLITS])
    met = where.select(*_KEY, "at", F.inline(two)).where(F.array_contains("at", F.col("a")) & F.array_contains("at", F.col("b")))
    return met.select(*_KEY, names[F.col("a")].alias("first_split"), names[F.col("b")].alias("second_split"))


def _with_text(found: DataFrame, pairs: DataFrame, reference: str, summary: str) -> DataFrame:
    """found with its texts, of which one row each is kept before anything but digests is shuffled."""
    found = written(found, "repeats")
    texts = _sides(pairs, reference, summary, texts=True).join(found.select(_KEY).distinct(), _KEY, "left_semi")
    return found.join(texts.groupBy(_KEY).agg(F.first("text").alias("text")), _KEY)


def repeated_texts(pairs: DataFrame, *, reference: str = "reference", summary: str = "summary", cut_to: int | None = None) -> DataFrame:
    """(split, side, text, n) for texts with n > 1 rows of a split. Null texts don't count."""
    found = _with_text(_repeated(_sides(pairs, reference, summary)), pairs, reference, summary)
    return found.select("split", "side", cut("text", cut_to).alias("text"), "n")


def leaked_texts(pairs: DataFrame, *, reference: str = "reference", summary: str = "summary") -> DataFrame:
    """(side, first_split, second_split, text) for texts in both of two splits."""
    found = _with_text(_leaked(_sides(pairs, reference, summary)), pairs, reference, summary)
    return found.select("side", "first_split", "second_split", "text")


def leakage_counts(pairs: DataFrame, *, reference: str = "reference", summary: str = "summary") -> DataFrame:
    return _leaked(_sides(pairs, reference, summary)).groupBy("side", "first_split", "second_split").agg(F.count("*").alias("n"))


def duplicate_report(pairs: DataFrame, *, method: str = "exact", reference: str = "reference", summary: str = "summary") -> DataFrame:
    """(kind, side, first_split, second_split, n): distinct texts that repeat within a split or between two. No text is looked up."""
    if method != "exact":
        raise ValueError("texts are compared exactly")
    within = _repeated(_sides(pairs, reference, summary)).groupBy("side", "split").agg(F.count("*").alias("n"))
    within = within.select(F.lit("within").alias("kind"), "side", F.col("split").alias("first_split"), F.col("split").alias("second_split"), "n")
    between = leakage_counts(pairs, reference=reference, summary=summary)
    return within.unionByName(between.select(F.lit("between").alias("kind"), "side", "first_split", "second_split", "n"))
