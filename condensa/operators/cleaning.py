"""Cleaning of paired corpora: an ordered cascade of filters, then greedy removal of duplicates.

The cascade is one expression, and each row gets the first reason that holds. Duplicates
are told as a scan of the rows in order would: a row stays unless an earlier row that
stayed has its reference or its summary. Seen as edges between texts, what stays is the
first maximal matching in order. It is found in rounds: a row that comes first in both
its groups stays for certain, and takes those that share a text with it along. Rows are a
key of 16 bytes for each text and their place; each round's remainder is a written table.
A round gathers the least place of each text by partial aggregates, so that a text which a
third of all rows share is no task's alone.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import pairs as P
from ..functions.text import LENGTH_METRICS, length_of
from ..sources.readers import SPLITS
from ..storage import written
from .components import components

REASONS = ("reference_too_short", "summary_too_short", "identity_sample", "compression_ratio", "extractiveness", "exact_duplicate", "both_duplicate", "reference_duplicate", "summary_duplicate")
DEDUP_METHODS = ("first", "test_first", "none")
#: Rounds run as joins of all rows. What is left are long chains, each of which depends on its beginning: they
#: are told apart as connected groups, and a task scans the keys of a group in order.
MAX_ROUNDS = 12


@dataclass(frozen=True)
class Cleaner:
    """Options of the cascade. extractiveness: None, 'fully', or the least and greatest share of the summary's n-grams."""

    min_length_summary: int = 0
    min_length_reference: int = 0
    length_metric: str = "char"
    min_compression_ratio: float = 1.0
    extractiveness: str | tuple[float, float] | None = None
    dedup: str = "test_first"
    n: int = 2

    def __post_init__(self) -> None:
        if self.dedup not in DEDUP_METHODS:
            raise ValueError(f"dedup must be one of {DEDUP_METHODS}")
        if self.length_metric not in LENGTH_METRICS:
            raise ValueError(f"length_metric must be one of {LENGTH_METRICS}")
        if self.min_length_summary < 0 or self.min_length_reference < 0 or self.min_compression_ratio < 0:
            raise ValueError("lengths and the ratio aren't negative")
        e = self.extractiveness
        if e is not None and e != "fully" and not (isinstance(e, tuple) and len(e) == 2 and all(isinstance(x, (int, float)) and 0 <= x <= 1 for x in e)):
            raise ValueError("extractiveness is None, 'fully' or two numbers from 0 to 1")
        if isinstance(e, tuple) and e[0] > e[1]:
            raise ValueError("the least extractiveness is greater than the greatest")
        if self.min_compression_ratio < 1:
            warnings.warn("a compression ratio below 1 keeps rows whose short text is longer than their reference", stacklevel=3)

    def stateless_reason(self, reference: Column, summary: Column) -> Column:
        """The first reason that a row has by itself, but for a range of extractiveness; null if none."""
        m = self.length_metric
        ratio = F.try_divide(length_of(reference, m), length_of(summary, m))
        out = (
            F.when(length_of(reference, m) < self.min_length_reference, F.lit(REASONS[0]))
            .when(length_of(summary, m) < self.min_length_summary, F.lit(REASONS[1]))
            .when(reference == summary, F.lit(REASONS[2]))
            .when(ratio.isNull() | (ratio < self.min_compression_ratio), F.lit(REASONS[3]))
        )
        return out.when(F.contains(reference, summary), F.lit(REASONS[4])) if self.extractiveness == "fully" else out

    def reasons(self, pairs: DataFrame, *, reference: str = "reference", summary: str = "summary", into: str = "reason") -> DataFrame:
        """pairs with a column of reasons, null for the rows that stay. Needs split_order and row_id.

        A null text is an empty one; a ratio by an empty summary is too small. Rows of one
        split with the same row_id are ordered by their texts. A column that is there already
        isn't overwritten: that is an error, give another name for the reasons.
        """
        if into in pairs.columns:
            raise ValueError(f"the pairs have a column {into}")
        r, s = F.coalesce(F.col(reference), F.lit("")), F.coalesce(F.col(summary), F.lit(""))
        told = pairs.withColumn(into, self.stateless_reason(r, s))
        if isinstance(self.extractiveness, tuple):
            lo, hi = self.extractiveness
            # The grams are only counted of rows that are still there: others come as nulls.
            alive = F.col(into).isNull()
            share = P.overlap_fraction(P.gram_overlap(F.when(alive, s), F.when(alive, r), self.n))
            told = told.withColumn("__share", share).withColumn(into, F.coalesce(into, F.when((F.col("__share") < lo) | (F.col("__share") > hi), F.lit(REASONS[4])))).drop("__share")
        if self.dedup == "none":
            return told
        order = F.col("split_order") if self.dedup == "first" else -F.col("split_order")
        key = lambda c: F.unhex(F.md5(c))
        # The last two make ties between equal places definite.
        place = F.struct(order.alias("a"), F.col("row_id").alias("b"), key(r).alias("c"), key(s).alias("d"))
        found = duplicates(told.where(F.col(into).isNull()).select(place.alias("place"), key(r).alias("r"), key(s).alias("s")))
        # Only rows with a reason meet the corpus again; where they are few enough, by a broadcast that the runtime chooses.
        named = found.groupBy("place").agg(F.min("why").alias("__why"), F.count("*").alias("__times")).where("__why IS NOT NULL OR __times > 1")
        named = written(named.withColumnRenamed("place", "__place"), "dedup-reasons")
        joined = told.withColumn("__place", F.when(F.col(into).isNull(), place)).join(named, "__place", "left")
        ends = lambda df: df.withColumn(into, F.coalesce(into, "__why")).drop("__place", "__why", "__times")
        if named.where("__times > 1").isEmpty():
            return ends(joined)
        # Of rows alike in place and texts, all but one are exact duplicates.
        again = F.row_number().over(Window.partitionBy("__place").orderBy("__place"))
        alike = joined.where("__times > 1").withColumn("__why", F.coalesce("__why", F.when(again > 1, F.lit("exact_duplicate"))))
        return ends(joined.where("coalesce(__times, 1) = 1").unionByName(alike))

    def clean(self, pairs: DataFrame, **columns: str) -> DataFrame:
        """The rows that stay, with all their columns."""
        return self.reasons(pairs, into="__reason", **columns).where("__reason IS NULL").drop("__reason")


def each_removed(reasons: DataFrame, call: Callable[[Row, str], None], *, reason: str = "reason") -> None:
    """Call a function with every row that has a reason, and the reason, where the rows are: what it prints is in the executors' logs."""

    def run(rows) -> None:
        for row in rows:
            call(row, row[reason])

    reasons.where(F.col(reason).isNotNull()).foreachPartition(run)


def removed_as_text(row: Row, reason: str, *, reference: str = "reference", summary: str = "summary", most: int = 100) -> str:
    """A line on a removed row, with the beginnings of its texts."""
    texts = ((row[c] or "")[:most].replace("\n", " ") for c in (summary, reference))
    return f"{reason} ({row['split']} {row['row_id']}): " + " <- ".join(texts)


def matching(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """The rows (place, r, s) that a scan by place keeps, as written tables. Only rows alike in all three share a place; of those one is kept."""
    left, kept = edges, []
    for _ in range(max_rounds):
        first_r = left.groupBy("r").agg(F.min(F.struct("place", "s")).alias("x")).select("x.place", "r", "x.s")
        first_s = left.groupBy("s").agg(F.min("place").alias("place")).select("place")
        stays = written(first_r.join(first_s, "place", "left_semi"), "dedup-stays")
        kept.append(stays)
        left = written(left.join(stays.select("r"), "r", "left_anti").join(stays.select("s"), "s", "left_anti").select("place", "r", "s"), "dedup-left")
        if left.isEmpty():
            break
    else:
        kept.append(written(_scanned(left), "dedup-scanned"))
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out


def _scanned(edges: DataFrame) -> DataFrame:
    """As matching, by a scan of each connected group of rows in order. Groups pass through a task one after another."""
    side = lambda c: F.concat(F.lit(c), F.col(c).cast("string" if edges.schema[c].dataType.typeName() != "binary" else "binary").cast("binary"))
    nodes = edges.select("place", "r", "s", side("r").alias("a"), side("s").alias("b"))
    groups = components(nodes.select("a", "b"))
    own = nodes.join(groups, nodes["a"] == groups["node"]).select(F.col("component").alias("grp"), "place", "r", "s")

    def scan(batches):
        now, refs, sums = None, set(), set()
        for rows in batches:
            keep = []
            for g, r, s in zip(rows["grp"], rows["r"], rows["s"]):
                if g != now:
                    now, refs, sums = g, set(), set()
                fresh = r not in refs and s not in sums
                keep.append(fresh)
                if fresh:
                    refs.add(r)
                    sums.add(s)
            yield rows[pd.Series(keep, index=rows.index, dtype=bool)][["place", "r", "s"]]

    return own.repartition("grp").sortWithinPartitions("grp", "place").mapInPandas(scan, edges.select("place", "r", "s").schema)


def duplicates(edges: DataFrame) -> DataFrame:
    """(place, why) for every row of edges: why is null for those that a scan by place keeps."""
    edges = written(edges, "dedup-edges")
    kept = matching(edges)
    of_r, of_s = kept.select("r", F.col("place").alias("kr")), kept.select("s", F.col("place").alias("ks"))
    rows = edges.join(of_r, "r", "left").join(of_s, "s", "left")
    kr, ks = (F.when(F.col(k) < F.col("place"), F.col(k)) for k in ("kr", "ks"))
    stays = F.coalesce(F.col("kr") == F.col("place"), F.lit(False))
    why = (
        F.when(stays, F.lit(None).cast("string"))
        .when(kr.isNotNull() & (kr == ks), F.lit("exact_duplicate"))
        .when(kr.isNotNull() & ks.isNotNull(), F.lit("both_duplicate"))
        .when(kr.isNotNull(), F.lit("reference_duplicate"))
        .otherwise(F.lit("summary_duplicate"))
    )
    return rows.select("place", why.alias("why"))


def breakdown(reasons: DataFrame) -> DataFrame:
    """(reason, train, validation, test) with a row for every reason, zeros included."""
    counts = reasons.where("reason IS NOT NULL").groupBy("reason").pivot("split", list(SPLITS)).count()
    every = reasons.sparkSession.createDataFrame([(r,) for r in REASONS], "reason string")
    return every.join(counts, "reason", "left").select("reason", *[F.coalesce(s, F.lit(0)).cast("long").alias(s) for s in SPLITS])


def share_kept(reasons: DataFrame) -> DataFrame:
    """(split, n_input, n_kept, percent, latex) of a cleaned corpus."""
    n, kept = F.count("*"), F.count_if(F.col("reason").isNull())
    out = reasons.groupBy("split").agg(n.alias("n_input"), kept.alias("n_kept"))
    percent = F.round(100.0 * F.col("n_kept") / F.col("n_input"), 2)
    return out.withColumn("percent", percent).withColumn("latex", F.concat(F.col("split"), F.lit(" & "), F.col("n_kept").cast("string"), F.lit(" \\\\")))


def valid_samples(pairs: DataFrame, *, reference: str = "reference", summary: str = "summary") -> DataFrame:
    """A row of counts: fully extractive, not shorter than the reference, empty, with several issues; median and 90th percentile of LCS shares of the rest.

    The subsequence is only looked for where the summary isn't a part of the reference. Shares
    count with six decimals, so that percentiles need a million counters at most.
    """
    r, s = F.coalesce(F.col(reference), F.lit("")), F.coalesce(F.col(summary), F.lit(""))
    told = pairs.select(P.is_fully_extractive(s, r).alias("e"), P.is_summary_longer(s, r).alias("l"), P.is_either_empty(s, r).alias("m"), s.alias("s"), r.alias("r"))
    share = P.lcs_fraction(P.lcs(F.when(~F.col("e"), F.col("s")), F.when(~F.col("e"), F.col("r"))))
    told = told.withColumn("share", F.round(share, 6))
    return told.agg(
        F.count("*").alias("n"), F.count_if("e").alias("extractive"), F.count_if("l").alias("longer"), F.count_if("m").alias("empty"),
        (F.count_if(F.col("e") & F.col("l")) + F.count_if(F.col("e") & F.col("m"))).alias("several"),
        F.round(F.percentile("share", 0.5), 6).alias("lcs_median"), F.round(F.percentile("share", 0.9), 6).alias("lcs_p90"),
    )
