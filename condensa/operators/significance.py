"""Tests by resampling, with draws that depend on (seed, resample, position) alone: the same on any cluster and in SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .draws import means, swaps


def draw(seed: int, resample: Column, pos: Column, below: Column) -> Column:
    """A number from 0 to below - 1."""
    text = F.concat(F.lit(f"{seed}:"), resample.cast("string"), F.lit(":"), pos.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % below


def _parted(rows: DataFrame) -> DataFrame:
    """Rows in as many parts as a shuffle has: numbered rows come in one, and each meets every resample."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (pos, gold, a, b) with n, their number. Positions run from 0."""
    return _parted(rows).crossJoin(F.broadcast(rows.agg(F.count("*").alias("n"))))


#: Rows that are sent to all tasks for drawn positions to be looked up, a few numbers each. More are met by a shuffle of the draws.
LOOKUP_ROWS = 200_000
#: Rows that a function of whole arrays takes, in each task that resamples them.
ARRAY_ROWS = 5_000_000


def _looked_up(rows: DataFrame) -> DataFrame:
    """rows, marked to be sent to all tasks if their number is within the bound."""
    return F.broadcast(rows) if rows.count() <= LOOKUP_ROWS else rows


def _right(system: Column, gold: Column) -> Column:
    return F.when(system == gold, 1.0).otherwise(0.0)


def accuracy(system: Column, gold: Column) -> Column:
    return F.avg(_right(system, gold))


def pearson(system: Column, gold: Column) -> Column:
    return F.corr(system.cast("double"), gold.cast("double"))


Scorer = Callable[[Column, Column], Column]


def bootstrap_scores(rows: DataFrame, score: Scorer, n_resamples: int, seed: int) -> DataFrame:
    """(resample, score_a, score_b). Accuracy is a mean of what rows have, see draws.means. Other scorers are functions of columns: their
    draws look up their rows where they are made, and only sums of each resample are shuffled."""
    spark = rows.sparkSession
    if score is accuracy:
        own = rows.select(F.lit("").alias("key"), "pos", _right(F.col("a"), F.col("gold")).alias("score_a"), _right(F.col("b"), F.col("gold")).alias("score_b"))
        return means(own, ["score_a", "score_b"], n_resamples=n_resamples, seed=seed).drop("key")
    numbered = _numbered(rows)
    places = numbered.select("pos", "n").crossJoin(spark.range(n_resamples).select(F.col("id").alias("resample")))
    drawn = places.select("resample", draw(seed, F.col("resample"), F.col("pos"), F.col("n")).alias("pos"))
    return drawn.join(_looked_up(rows), "pos").groupBy("resample").agg(score(F.col("a"), F.col("gold")).alias("score_a"), score(F.col("b"), F.col("gold")).alias("score_b"))


def paired_bootstrap(rows: DataFrame, score: Scorer = accuracy, *, n_resamples: int = 10_000, seed: int = 256) -> DataFrame:
    """One row (n_resamples, wins, ties, p): p is 1 less the share of resamples where a scores higher than b."""
    scores = bootstrap_scores(rows, score, n_resamples, seed)
    return scores.agg(F.count_if(F.round("score_a", 9) > F.round("score_b", 9)).alias("wins"), F.count_if(F.round("score_a", 9) == F.round("score_b", 9)).alias("ties")).select(
        F.lit(n_resamples).cast("long").alias("n_resamples"), "wins", "ties", F.round(F.lit(1.0) - F.col("wins") / n_resamples, 6).alias("p")
    )


def permutation(rows: DataFrame, score: Scorer = accuracy, *, n_resamples: int = 10_000, seed: int = 256) -> DataFrame:
    """One row (n_resamples, at_least, p): resamples where a and b, swapped by the toss of a coin at each place, differ as much as they do."""
    true = rows.agg(F.abs(score(F.col("a"), F.col("gold")) - score(F.col("b"), F.col("gold"))).alias("__true"))
    if score is accuracy:
        own = rows.select("pos", _right(F.col("a"), F.col("gold")).alias("a"), _right(F.col("b"), F.col("gold")).alias("b"))
        gaps = swaps(own, n_resamples=n_resamples, seed=seed).select(F.abs(F.col("a") / F.col("n") - F.col("b") / F.col("n")).alias("gap"))
    else:
        every = _parted(rows).crossJoin(rows.sparkSession.range(n_resamples).select(F.col("id").alias("resample")))
        swap = draw(seed, F.col("resample"), F.col("pos"), F.lit(2)) == 1
        tossed = every.select("resample", "gold", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))
        gaps = tossed.groupBy("resample").agg(F.abs(score(F.col("a"), F.col("gold")) - score(F.col("b"), F.col("gold"))).alias("gap"))
    found = gaps.crossJoin(F.broadcast(true))
    return found.agg(F.count_if(F.round("gap", 9) >= F.round("__true", 9)).alias("at_least")).select(
        F.lit(n_resamples).cast("long").alias("n_resamples"), "at_least", F.round((F.col("at_least") + 1) / (n_resamples + 1), 6).alias("p")
    )


def resample_with(rows: DataFrame, score: Callable[[np.ndarray, np.ndarray], float], *, n_resamples: int = 10_000, seed: int = 256) -> DataFrame:
    """As paired_bootstrap for any Python function of (system, gold): (resample, score_a, score_b), each task a share of the resamples.

    The function needs all rows at once: more than ARRAY_ROWS are an error.
    """
    if rows.count() > ARRAY_ROWS:
        raise ValueError(f"more than {ARRAY_ROWS} rows: use a scorer of columns")
    data = rows.orderBy("pos").toPandas()  # gold labels and two predictions, which the function needs as a whole
    gold, a, b = (data[c].to_numpy() for c in ("gold", "a", "b"))

    def run(batches):
        for batch in batches:
            out = []
            for r in batch["id"]:
                at = np.random.default_rng((seed, int(r))).integers(0, len(gold), len(gold))
                out.append((int(r), float(score(a[at], gold[at])), float(score(b[at], gold[at]))))
            yield pd.DataFrame(out, columns=["resample", "score_a", "score_b"])

    return rows.sparkSession.range(n_resamples).mapInPandas(run, "resample long, score_a double, score_b double")


def checked_rows(gold: list, a: list, b: list) -> None:
    if not len(gold) == len(a) == len(b):
        raise ValueError("labels and predictions differ in number")


def confidence(values: DataFrame, column: str, *, n_resamples: int = 2_000, seed: int = 256, by: str = "metric") -> DataFrame:
    """(by, low, mid, high): the 2.5th, 50th and 97.5th percentile of the means of resamples. values: (by, pos, column), pos from 0 within each.

    A resample's mean is of counts: how often each place is drawn, times its value.
    """
    own = means(values.select(F.col(by).alias("key"), "pos", column), [column], n_resamples=n_resamples, seed=seed)
    return _interval(own.select(F.col("key").cast(values.schema[by].dataType).alias(by), F.col(column).alias("m")), by)


def confidence_of(rows: DataFrame, columns: list[str], *, n_resamples: int = 2_000, seed: int = 256) -> DataFrame:
    """(metric, low, mid, high) as of confidence, for columns of the same rows (pos, *columns): each draw serves all of them."""
    own = means(rows.select(F.lit("").alias("key"), "pos", *columns), columns, n_resamples=n_resamples, seed=seed)
    return _interval(own.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("m")) for c in columns]))), "metric")


def _interval(means_: DataFrame, by: str) -> DataFrame:
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q")
    return means_.groupBy(by).agg(q).select(by, *[F.round(F.col("q")[i], 6).alias(name) for i, name in enumerate(("low", "mid", "high"))])


def keyword_scores(rows: DataFrame, *, gold: str, predicted: str, k: int) -> DataFrame:
    """One row (precision, recall, f1) in percent: means over rows of what the first k predictions share with the gold keywords, as sets."""
    p, g = F.array_distinct(F.slice(predicted, 1, k)), F.array_distinct(gold)
    hits = F.size(F.array_intersect(p, g))
    precision, recall = hits / F.greatest(F.size(p), F.lit(1)), hits / F.greatest(F.size(g), F.lit(1))
    f1 = F.when(hits > 0, 2 * precision * recall / F.when(hits > 0, precision + recall)).otherwise(0.0)
    return rows.agg(*[F.round(F.avg(x) * 100, 6).alias(n) for n, x in (("precision", precision), ("recall", recall), ("f1", f1))])
