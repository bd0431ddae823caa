"""Lengths, positions and shares of a corpus as small tables, ready to be drawn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import length_of


def summary_of(length: Column | str) -> list[Column]:
    length = F.col(length) if isinstance(length, str) else length
    return [F.round(F.avg(length), 6).alias("mean"), F.round(F.percentile(length, 0.5), 6).alias("median"), F.round(F.stddev_pop(length), 6).alias("std"), F.count(length).alias("n")]


def lengths(pairs: DataFrame, *, reference: str = "reference", summary: str = "summary", metric: str = "char") -> DataFrame:
    """(split, side, len); a pair is read once."""
    sides = F.array(F.struct(F.lit("reference").alias("side"), length_of(reference, metric).alias("len")), F.struct(F.lit("summary").alias("side"), length_of(summary, metric).alias("len")))
    return pairs.select("split", F.inline(sides))


def length_statistics(pairs: DataFrame, **options: str) -> DataFrame:
    """(split, side, mean, median, std, n) of every split and, as split 'aggregated', of all: one pass by grouping sets."""
    own = lengths(pairs, **options)
    grouped = own.groupingSets([["split", "side"], ["side"]], "split", "side").agg(*summary_of("len"), F.grouping("split").alias("g"))
    return grouped.select(F.when(F.col("g") == 1, F.lit("aggregated")).otherwise(F.col("split")).alias("split"), "side", "mean", "median", "std", "n")


def quartiles(lengths_: DataFrame, by: list[str], column: str = "len") -> DataFrame:
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = lengths_.groupBy(*by).agg(q.alias("q"), F.count("*").alias("n"))
    return out.select(*by, F.round(F.col("q")[0], 6).alias("q1"), F.round(F.col("q")[1], 6).alias("q2"), F.round(F.col("q")[2], 6).alias("q3"), "n")


def position_histogram(positions: DataFrame, bins: Column, column: str = "relative_position") -> DataFrame:
    """(bin, n, share) of values from 0 to 1, the right edge in the last bin. bins: how many, a column."""
    at = F.least(F.floor(F.col(column) * bins), bins - 1).cast("long")
    counts = positions.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def fixed_histogram(values: DataFrame, column: str, low: float, high: float, bins: int, by: tuple[str, ...] = (), clamp: bool = False) -> DataFrame:
    """(*by, bin, n) over [low, high], edges inclusive. Others are left out, or with clamp are in the first and last bin."""
    v = F.col(column)
    at = F.least(F.floor((v - low) * bins / (high - low)), F.lit(bins - 1)).cast("long")
    if clamp:
        return values.where(v.isNotNull()).groupBy(*by, F.greatest(at, F.lit(0).cast("long")).alias("bin")).agg(F.count("*").alias("n"))
    return values.where(v.between(low, high)).groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))


def clamped_histogram(values: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, n) up to the mean and two deviations; what is longer is in the last bin. The limit is one row, sent to all."""
    limit = values.agg((F.avg(column) + 2 * F.stddev_pop(column)).alias("__limit"))
    at = F.least(F.floor(F.col(column) * bins / F.greatest("__limit", F.lit(1e-9))), F.lit(bins - 1)).cast("long")
    return values.crossJoin(F.broadcast(limit)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
