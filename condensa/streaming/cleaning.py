"""The cascade over a stream of pairs.

Reasons that a row has by itself hold for a stream as they are. Duplicates of a pair are
dropped within a watermark, whose state is bounded by the delay. What the batch operator
does beyond that, keeping a row only if neither of its texts came before, has no key that
both texts share, so no state can be partitioned for it: run it over what a stream wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pairs as P
from ..operators.cleaning import REASONS, Cleaner


def stream_reasons(pairs: DataFrame, cleaner: Cleaner, *, reference: str = "reference", summary: str = "summary") -> DataFrame:
    """pairs with a column reason, of the reasons that need no other row. Null texts are empty ones."""
    r, s = F.coalesce(F.col(reference), F.lit("")), F.coalesce(F.col(summary), F.lit(""))
    out = pairs.withColumn("reason", cleaner.stateless_reason(r, s))
    if isinstance(cleaner.extractiveness, tuple):
        lo, hi = cleaner.extractiveness
        share = P.overlap_fraction(P.gram_overlap(s, r, cleaner.n))
        out = out.withColumn("reason", F.coalesce("reason", F.when((share < lo) | (share > hi), F.lit(REASONS[4]))))
    return out


def first_pairs(pairs: DataFrame, *, time: str, delay: str, reference: str = "reference", summary: str = "summary") -> DataFrame:
    """Each pair of texts once within the delay, told by the digest of both."""
    digest = F.md5(F.concat_ws("\x1f", F.md5(F.coalesce(F.col(reference), F.lit(""))), F.md5(F.coalesce(F.col(summary), F.lit("")))))
    return pairs.withColumn("__digest", digest).withWatermark(time, delay).dropDuplicatesWithinWatermark(["__digest"]).drop("__digest")


def windowed_breakdown(reasons: DataFrame, *, time: str, delay: str, window: str) -> DataFrame:
    """(start, end, reason, n) of tumbling windows; 'kept' stands for no reason. Rows later than the delay don't count."""
    reason = F.coalesce("reason", F.lit("kept")).alias("reason")
    counts = reasons.withWatermark(time, delay).groupBy(F.window(time, window), reason).agg(F.count("*").alias("n"))
    return counts.select("window.start", "window.end", "reason", "n")
