"""Extractive baselines: leading sentences, and central ones by a random walk over their likeness."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import non_blank, sentences


def lead(parts: Column, k: Column | int = 3) -> Column:
    """The first k sentences that aren't blank, joined by spaces. No sentence at all is an error."""
    kept = non_blank(parts)
    k = F.lit(k) if isinstance(k, int) else k
    return F.when(F.size(parts) == 0, F.raise_error(F.lit("no sentences"))).otherwise(F.array_join(F.slice(kept, F.lit(1), k.cast("int")), " "))


def mean_ratio(pairs: DataFrame, *, reference: str = "reference", summary: str = "summary") -> DataFrame:
    """One row: the mean of sentences in a reference by those in its summary, of pairs that have both."""
    r, s = F.size(sentences(reference)), F.size(sentences(summary))
    return pairs.where((s > 0) & (r > 0)).agg(F.avg(r / s).alias("ratio"))


def dynamic_length(n_sentences: Column, ratio: Column, least: int = 0) -> Column:
    """Sentences by the mean ratio, halves to the even number."""
    return F.greatest(F.bround(n_sentences / ratio).cast("int"), F.lit(least))


def markov_matrix(weights: np.ndarray) -> np.ndarray:
    """Rows that sum to 1: shares, or softmax where some weight isn't positive."""
    if weights.ndim != 2 or weights.shape[0] != weights.shape[1]:
        raise ValueError("a square matrix")
    if weights.min() <= 0:
        e = np.exp(weights - weights.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)
    return weights / weights.sum(1, keepdims=True)


def _components(matrix: np.ndarray) -> list[np.ndarray]:
    linked = (matrix != 0) | (matrix != 0).T
    label, n = np.full(len(matrix), -1), 0
    for i in range(len(matrix)):
        if label[i] < 0:
            edge = np.zeros(len(matrix), bool)
            edge[i] = True
            while edge.any():
                label[edge] = n
                edge = linked[edge].any(0) & (label < 0)
            n += 1
    return [np.flatnonzero(label == k) for k in range(n)]


def stationary(matrix: np.ndarray, *, squaring: bool = True, normalised: bool = False, most: int = 10_000) -> np.ndarray:
    """Stationary distribution of each connected part, by powers that double each time."""
    out = np.zeros(len(matrix))
    for part in _components(matrix):
        step = matrix[np.ix_(part, part)].T
        v = np.full(len(part), 1 / len(part))
        for _ in range(most if len(part) > 1 else 0):
            new = step @ v
            if np.allclose(new, v):
                v = new
                break
            v = new
            if squaring:
                step = step @ step
        else:
            if len(part) > 1:
                raise ArithmeticError("no convergence")
        out[part] = v
    return out / len(matrix) if normalised else out


def centrality(similarity: np.ndarray, threshold: float | None = None) -> np.ndarray:
    if threshold is not None:
        if not 0 <= threshold < 1:
            raise ValueError("the threshold is at least 0 and less than 1")
        similarity = (similarity >= threshold).astype(float)
    return stationary(markov_matrix(similarity))


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


#: Cells of matrices that are held at a time.
CELLS = 4_000_000


class Given:
    """Sentences by vectors of unit length. kind and times: the vector of each sentence, and how many sentences have it."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors, self.n, self.width = vectors, len(vectors), max(len(vectors), 1)
        self.kind, self.times = np.arange(self.n), np.ones(self.n)

    def likeness(self, a: int, b: int) -> np.ndarray:
        return (self.vectors[a:b] @ self.vectors.T).astype(np.float64)

    alike = likeness


class WordCounts:
    """Sentences by counts of their words, scaled to unit length (no model is shipped); what isn't zero is kept, once for sentences of the same words.

    Words of many sentences are columns of a matrix, the others lists of the sentences that have them.
    """

    def __init__(self, parts: list[str], find) -> None:
        number: dict[str, int] = {}
        place: dict[tuple[int, ...], int] = {}
        self.kind = np.array([place.setdefault(tuple(number.setdefault(w.lower(), len(number)) for w in find(s)), len(place)) for s in parts], np.int64)
        rows, kinds = [Counter(key) for key in place], len(place)
        self.n, self.words, self.times = len(parts), len(number), np.bincount(self.kind, minlength=kinds).astype(np.float64)
        row = np.repeat(np.arange(kinds), [len(r) for r in rows])
        column = np.array([c for r in rows for c in r], np.int64)
        value = np.array([x for r in rows for x in r.values()], np.float64)
        value /= np.maximum(np.sqrt(np.bincount(row, value**2, kinds)), 1e-9)[row]
        frequency = np.bincount(column, minlength=self.words)
        often = np.argsort(-frequency, kind="stable")[: CELLS // max(kinds, 1)]
        often = often[frequency[often] * 6 > kinds]
        at = np.full(self.words, -1)
        at[often] = np.arange(len(often))
        there = at[column] >= 0
        self.often = np.zeros((kinds, len(often)))
        self.often[row[there], at[column[there]]] = value[there]
        self.row, self.column, self.value = row[~there], column[~there], value[~there]
        order = np.argsort(self.column, kind="stable")
        self.listed = self.row[order], self.value[order]
        self.frequency = np.bincount(self.column, minlength=self.words)
        self.first = np.cumsum(self.frequency) - self.frequency
        self.width = int(max(np.bincount(self.row, self.frequency[self.column], 1).max(), kinds, 1))

    def alike(self, a: int, b: int) -> np.ndarray:
        """Of the kinds from a to b to all kinds."""
        kinds = len(self.times)
        out = self.often[a:b] @ self.often.T
        lo, hi = np.searchsorted(self.row, (a, b))
        if lo < hi:
            n = self.frequency[self.column[lo:hi]]
            met = np.arange(n.sum()) + np.repeat(self.first[self.column[lo:hi]] - np.cumsum(n) + n, n)
            at = np.repeat((self.row[lo:hi] - a) * kinds, n) + self.listed[0][met]
            out += np.bincount(at, np.repeat(self.value[lo:hi], n) * self.listed[1][met], out.size).reshape(out.shape)
        return out

    def likeness(self, a: int, b: int) -> np.ndarray:
        return np.concatenate([self.alike(k, k + 1) for k in self.kind[a:b]])[:, self.kind]


def walk_centrality(sents: Given | WordCounts, threshold: float | None = None, *, cells: int = CELLS) -> np.ndarray:
    """As centrality of the matrix of likeness, without holding more than `cells` of it or walking.

    The walk goes by shares of weights that are the same there and back, so where it comes to rest
    a sentence's part is that of its row's weights, however slowly steps would come near: one pass
    over the rows. A long document takes the square of its different sentences in time, not in memory.
    """
    if threshold is not None and not 0 <= threshold < 1:
        raise ValueError("the threshold is at least 0 and less than 1")
    if sents.n < 2:
        return np.ones(sents.n)
    kinds = len(sents.times)
    step, least, plain, soft = max(1, cells // max(sents.width, kinds)), np.inf, np.empty(kinds), np.empty(kinds)
    for a in range(0, kinds, step):
        b = min(a + step, kinds)
        s = sents.alike(a, b)
        if threshold is not None:
            s = (np.round(s, 9) >= threshold).astype(np.float64)
        least = min(least, s.min())
        plain[a:b] = s @ sents.times
        soft[a:b] = np.exp(s, out=s) @ sents.times
    weight = (soft if least <= 0 else plain)[sents.kind]
    return weight / weight.sum()


def central_order(sents: Given | WordCounts, threshold: float | None = None) -> list[int]:
    scores = np.round(walk_centrality(sents, threshold), 9)
    return np.lexsort((np.arange(len(scores)), -scores)).tolist()


def vector_centrality(sentences_: DataFrame, *, doc: str, pos: str, vector: str, threshold: float | None = None) -> DataFrame:
    """(doc, pos, score): a row for each sentence of (doc, pos, vector), by a walk within its document. A document's vectors meet in one task."""
    kinds = [sentences_.schema[c].dataType.simpleString() for c in (doc, pos)]

    def run(own: pa.Table) -> pa.Table:
        v = np.stack(own.column("v").to_pylist()).astype(np.float64)
        return pa.table({"doc": own.column("doc"), "pos": own.column("pos"), "score": walk_centrality(Given(unit(v)), threshold)})

    own = sentences_.select(F.col(doc).alias("doc"), F.col(pos).alias("pos"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    found = own.groupBy("doc").applyInArrow(run, f"doc {kinds[0]}, pos {kinds[1]}, score double")
    return found.select(F.col("doc").alias(doc), F.col("pos").alias(pos), "score")


def lexrank(parts: Column, *, k: Column | int | None = None, max_length: int | None = None, threshold: float | None = None, vectors: Column | None = None) -> Column:
    """The most central sentences, the most central first: k of them, or as long as max_length signs aren't exceeded.

    One of the two must be given. A document's walk is over its sentences by themselves. vectors:
    one for each sentence, as given by an encoder; counts of words stand in for them.
    """
    if (k is None) == (max_length is None):
        raise ValueError("either k or max_length")

    @F.arrow_udf("string")
    def run(sents: pa.Array, count: pa.Array, given: pa.Array) -> pa.Array:
        import regex

        find, out = regex.compile(r"[\p{L}\p{N}]+").findall, []
        slices = ((x.slice(a, 128).to_pylist() for x in (sents, count, given)) for a in range(0, len(sents), 128))  # not a batch's sentences at once
        for s, n, own in chain.from_iterable(zip(*x) for x in slices):
            if s is None:
                out.append(None)
                continue
            order = central_order(WordCounts(s, find) if own is None else Given(unit(np.array(own, np.float64).reshape(len(s), -1))), threshold)
            if max_length is None:
                out.append(" ".join(s[i] for i in order[: int(n)]))
                continue
            text = ""
            for i in order:
                if len(text) + len(s[i]) > max_length:
                    break
                text += s[i] + " "
            out.append(text.strip(" "))
        return pa.array(out, pa.string())

    count = F.lit(k if isinstance(k, int) else 0) if k is None or isinstance(k, int) else k
    return run(parts, count, F.lit(None).cast("array<array<double>>") if vectors is None else vectors)


def shortest(docs: DataFrame, parts: Column, key: str, n: int = 10) -> DataFrame:
    """(key, n_sentences) of the n documents of fewest sentences."""
    return docs.select(key, F.size(parts).alias("n_sentences")).orderBy("n_sentences", key).limit(n)


def block_sums(attention: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc, out_sent, in_sent, weight, share, is_max) of token weights (doc, out_tok, in_tok, weight) added up by sentences.

    spans: (doc, side, sent, first, last) with side 'out' or 'in'. share is of an input
    sentence's sum over all outputs; is_max marks each input's strongest output, the first of equals.
    """
    from pyspark.sql import Window

    sides = {s: spans.where(F.col("side") == s).select("doc", F.col("sent").alias(f"{s}_sent"), F.col("first").alias(f"{s}_a"), F.col("last").alias(f"{s}_b")) for s in ("out", "in")}
    joined = attention.join(sides["out"], "doc").where("out_tok BETWEEN out_a AND out_b").join(sides["in"], "doc").where("in_tok BETWEEN in_a AND in_b")
    sums = joined.groupBy("doc", "out_sent", "in_sent").agg(F.sum("weight").alias("weight"))
    own = Window.partitionBy("doc", "in_sent")
    first = F.row_number().over(own.orderBy(F.desc("weight"), "out_sent"))
    return sums.withColumn("share", F.round(F.col("weight") / F.sum("weight").over(own), 6)).withColumn("is_max", first == 1)


def block_sums_by(spans: DataFrame, weigh: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """As block_sums, of whole-numbered weights that weigh(out_tok, in_tok) gives for a column and a row of positions.

    spans: (doc, sent, first, last), the same for both sides. A document is added up in one
    task, slice by slice, so that token pairs are neither held nor shuffled. Where an input's
    weights are all 0 its shares are null.
    """
    from pyspark.sql import Window

    kinds = {c: spans.schema[c].dataType.simpleString() for c in ("doc", "sent")}

    def run(own: pa.Table) -> pa.Table:
        own = own.sort_by("first")
        first, last = own.column("first").to_numpy(), own.column("last").to_numpy()
        tok = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
        starts, step = np.concatenate([[0], np.cumsum(last - first + 1)[:-1]]), max(1, 2_000_000 // len(tok))
        sums = np.zeros((len(first), len(first)), np.int64)
        for k, (a, b) in enumerate(zip(first, last)):
            for lo in range(a, b + 1, step):
                sums[k] += np.add.reduceat(weigh(np.arange(lo, min(lo + step, b + 1))[:, None], tok[None]).sum(0), starts)
        out, in_ = np.divmod(np.arange(sums.size), len(first))
        sent = own.column("sent")
        return pa.table({"doc": own.column("doc").take(pa.array(out)), "out_sent": sent.take(pa.array(out)), "in_sent": sent.take(pa.array(in_)), "weight": sums.ravel()})

    spark = spans.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # spans are few bytes for their work, and would be joined in one task
    own = spans.select("doc", "sent", F.col("first").cast("long"), F.col("last").cast("long")).repartition(parts, "doc")
    sums = own.groupBy("doc").applyInArrow(run, f"doc {kinds['doc']}, out_sent {kinds['sent']}, in_sent {kinds['sent']}, weight long")
    own = Window.partitionBy("doc", "in_sent")
    first = F.row_number().over(own.orderBy(F.desc("weight"), "out_sent"))
    return sums.withColumn("share", F.round(F.col("weight") / F.nullif(F.sum("weight").over(own), F.lit(0)), 6)).withColumn("is_max", first == 1)
