"""Language ID by hierarchical discrimination: first the family, then languages within it.

A text's features are the counts of its hashed groups of two to four bytes, in lower case,
with a space for whatever is no letter or digit. One linear support vector machine for
each pair of families votes for a family; then one for each pair of the family's languages
votes for the language. They are learned by dual coordinate descent on a bounded sample of
rows that carry a label; their weights have a fixed size and are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import spread
from ._arrow import PIECE, _is_word, buffers, row_slices
from ._shared import release, small_batches

FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance"}
#: At most so many labelled rows are used to fit: one of each of the ids with the least hashes in each language, as many of each as there are or fit.
MAX_TRAIN_ROWS = 6_000
BITS = 14
EPOCHS = 8
COST = 10.0
SIZES = (2, 3, 4)
UNKNOWN = "und"
#: A script is known if so large a share of a language's letters and digits is of it; a text of which less than half is
#: of known scripts is in no language of the model's.
SCRIPT_SHARE = 0.001

#: The kind of the row that tells which scripts are known.
SCRIPTS = " scripts"
#: Scripts by the first byte of a sign; all of Latin is one.
_SCRIPT = np.arange(256)
_SCRIPT[:0xCB] = 0


@dataclass(frozen=True)
class Model:
    """weights[:, k] is of pairs[k]: (kind, first, second), positive for the first. kind '' is of families."""

    pairs: list[tuple[str, str, str]]
    weights: np.ndarray
    languages: dict[str, list[str]]
    scripts: np.ndarray

    def tell(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(family, language, margin) for rows of scores; margin is the least score that the language won by.

        Of equal votes the larger sum of scores wins, of equal sums the name that comes first.
        """
        families = sorted(self.languages)
        n = len(scores)

        def vote(kind: str, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
            votes, sums, margin = np.zeros((n, len(names))), np.zeros((n, len(names))), np.full((n, len(names)), np.inf)
            for k, (of, a, b) in enumerate(self.pairs):
                if of == kind and a in names:
                    i, j, s = names.index(a), names.index(b), scores[:, k]
                    for x, v in ((i, s), (j, -s)):
                        votes[:, x] += v >= 0 if x == i else v > 0
                        sums[:, x] += v
                        margin[:, x] = np.minimum(margin[:, x], v)
            best = np.lexsort((-np.arange(len(names))[None].repeat(n, 0), sums, votes), axis=1)[:, -1]
            return best, margin[np.arange(n), best]

        family, margin = vote("", families)
        language = np.empty(n, object)
        for f, name in enumerate(families):
            at = np.flatnonzero(family == f)
            best, own = vote(name, self.languages[name])
            language[at] = np.array(self.languages[name], object)[best[at]]
            margin[at] = np.minimum(margin[at], own[at])
        return np.array(families, object)[family], language, margin


def _features(texts: pa.Array, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, rows counted from the first, buckets), with as many parts as memory asks for."""
    data, offs = buffers(texts, lower=True)
    for lo, hi in row_slices(offs, PIECE):
        begin, stop = int(offs[lo]), int(offs[hi])
        for a in range(begin, stop, 2 * PIECE):  # a long text in parts; each has the bytes that the last groups need
            b = min(a + 2 * PIECE, stop)
            piece = data[a : min(b + max(SIZES) - 1, stop)]
            row = np.searchsorted(offs[lo : hi + 1], np.arange(a, a + len(piece)), "right") - 1 if hi - lo > 1 else np.zeros(len(piece), np.int64)
            word = _is_word(piece)
            clean = np.where(word, piece, 32).astype(np.uint32)
            for n in SIZES:
                m = len(piece) - n + 1
                if m <= 0:
                    continue
                h, inner = np.full(m, n, np.uint32), row[:m] == row[n - 1 :]
                for k in range(n):
                    h = (h ^ clean[k : m + k]) * np.uint32(0x01000193)
                for k in range(1, n - 1):  # a space only at the ends
                    inner &= word[k : m + k]
                inner &= word[:m] | word[n - 1 :]
                at = np.flatnonzero(inner[: b - a])
                h = h[at]
                h ^= h >> np.uint32(15)
                yield lo, hi, row[at], ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int64)


def _script_counts(texts: pa.Array) -> np.ndarray:
    """For each text how many of its letters and digits are of each script."""
    data, offs = buffers(texts, lower=True)
    out = np.zeros((len(texts), 256), np.int64)
    for lo, hi in row_slices(offs, PIECE):
        for a in range(int(offs[lo]), int(offs[hi]), 2 * PIECE):
            piece = data[a : min(a + 2 * PIECE, int(offs[hi]))]
            at = np.flatnonzero(_is_word(piece) & (piece & 0xC0 != 0x80))
            row = np.searchsorted(offs[lo : hi + 1], at + a, "right") - 1
            out[lo:hi] += np.bincount(row * 256 + _SCRIPT[piece[at]], minlength=(hi - lo) * 256).reshape(-1, 256)
    return out


def _learn(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, bits: int, epochs: int = EPOCHS, cost: float = COST) -> np.ndarray:
    """Weights of one machine (squared hinge loss) over (buckets, values) of unit length and signs."""
    w, alpha, slack = np.zeros(1 << bits), np.zeros(len(rows)), 1 / (2 * cost)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            g = sign[i] * (w[at] @ x) - 1 + alpha[i] * slack
            new = max(alpha[i] - g / (1 + slack), 0.0)
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * sign[i] * x
                alpha[i] = new
    return w


def train(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", families: dict[str, str] | None = None, max_rows: int = MAX_TRAIN_ROWS, bits: int = BITS) -> Model:
    """Fit on at most max_rows rows that carry a language of a known family.

    Rows without an id, a text or such a language don't count; an id with several rows counts
    once, with the text of the least hash; texts count whole. A family with one language
    has no machine within it. Without any row the model says 'und' of every text.
    """
    families = families or FAMILIES
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isin(list(families)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    least = own.select("id", "lang").distinct().withColumn("place", place).where(F.col("place") <= max_rows)
    picked = least.orderBy("place", F.xxhash64("id"), "id", "lang").limit(max_rows).select("id").distinct()  # broadcast: max_rows numbers
    # Partial aggregates: however often an id comes, a task passes one of its rows on.
    rows = own.join(F.broadcast(picked), "id").groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "lang", "text")).alias("one")).select("id", F.col("one.text").alias("text"), F.col("one.lang").alias("lang"))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[int, np.ndarray] = {}
            for lo, _, row, bucket in _features(batch.column("text"), bits):
                cut = np.flatnonzero(np.diff(row, prepend=-1))
                for a, b in zip(cut, np.append(cut[1:], len(row))):
                    i = lo + int(row[a])
                    sums[i] = sums.get(i, 0) + np.bincount(bucket[a:b], minlength=1 << bits)
                    if len(sums) > 1:  # texts come one after another
                        yield from (packed(batch, j, sums.pop(j)) for j in [j for j in sums if j < lo])
            yield from (packed(batch, j, x) for j, x in sums.items())
        release()

    def packed(batch: pa.RecordBatch, i: int, x: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(x)
        value = (x[at] / np.sqrt((x[at] ** 2.0).sum())).astype(np.float32)
        scripts = _script_counts(batch.column("text").slice(i, 1))
        return pa.RecordBatch.from_arrays([batch.column("id").slice(i, 1).cast(pa.string()), batch.column("lang").slice(i, 1), *(pa.array([c.tobytes()], pa.binary()) for c in (at.astype(np.int32), value, scripts))], ["id", "lang", "at", "value", "scripts"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, langs, scripts = [], [], {}
        for b in batches:
            for name, counts in zip(b.column("lang").to_pylist(), b.column("scripts").to_pylist()):
                scripts[name] = scripts.get(name, 0) + np.frombuffer(counts, np.int64)
            langs += b.column("lang").to_pylist()
            seen += [(np.frombuffer(x, np.int32), np.frombuffer(y, np.float32)) for x, y in zip(b.column("at").to_pylist(), b.column("value").to_pylist())]
        there: dict[str, list[str]] = {}
        for name in sorted(set(langs)):
            there.setdefault(families[name], []).append(name)
        jobs = [("", a, b) for a, b in combinations(sorted(there), 2)] + [(f, a, b) for f, names in sorted(there.items()) for a, b in combinations(names, 2)]
        jobs += [(f, names[0], names[0]) for f, names in sorted(there.items()) if len(names) == 1]
        if there:
            known = np.any([c >= SCRIPT_SHARE * max(c.sum(), 1) for c in scripts.values()], axis=0) & (sum(scripts.values()) > 0)
            yield pa.RecordBatch.from_arrays([pa.array([SCRIPTS]), pa.array([""]), pa.array([""]), pa.array([known.astype(np.float32).tobytes()], pa.binary())], ["kind", "a", "b", "w"])
        for kind, a, b in jobs:
            own = [(i, 1 if x == a else -1) for i, n in enumerate(langs) if (x := families[n] if not kind else n) in (a, b)]
            w = _learn([seen[i] for i, _ in own], np.array([s for _, s in own]), bits) if a != b else np.zeros(1 << bits)
            yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([a]), pa.array([b]), pa.array([w.astype(np.float32).tobytes()], pa.binary())], ["kind", "a", "b", "w"])

    one = small_batches(rows).mapInArrow(featurise, "id string, lang string, at binary, value binary, scripts binary").repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", "lang", "at", "value")
    found = one.mapInArrow(learn, "kind string, a string, b string, w binary").collect()  # 64 kB for each pair of languages
    scripts = next((np.frombuffer(r.w, np.float32) > 0 for r in found if r.kind == SCRIPTS), np.zeros(256, bool))
    found = [r for r in found if r.kind != SCRIPTS]
    languages: dict[str, list[str]] = {}
    for r in found:
        for name in (r.a, r.b) if r.kind else ():
            if name not in languages.setdefault(r.kind, []):
                languages[r.kind].append(name)
    machines = [r for r in found if r.a != r.b]
    weights = np.stack([np.frombuffer(r.w, np.float32) for r in machines], 1) if machines else np.zeros((1 << bits, 0), np.float32)
    return Model([(r.kind, r.a, r.b) for r in machines], weights, {f: sorted(n) for f, n in languages.items()}, scripts)


def identify(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, family, language, margin) for every row, in one narrow pass.

    A text without a letter or digit, an empty and a null one are 'und' with margin 0, and so
    is one mostly in scripts that no language of the model has. A text in another language of
    a known script is told as one of the model's. Texts of any length are read whole. Rows
    repeat as they do in docs; ids may be null; other columns don't matter. An empty table
    gives no rows. Ties are as in Model.tell.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([own.schema["doc_id"], *T.StructType().add("family", "string").add("language", "string").add("margin", "double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        bits = int(m.weights.shape[0]).bit_length() - 1
        for batch in batches:
            n = len(batch)
            sums, count = np.zeros((n, m.weights.shape[1])), np.zeros(n)
            for lo, hi, row, bucket in _features(batch.column("text"), bits):
                count[lo:hi] += np.bincount(row, minlength=hi - lo)
                for k in range(m.weights.shape[1]):
                    sums[lo:hi, k] += np.bincount(row, m.weights[bucket, k], hi - lo)
            counts = _script_counts(batch.column("text"))
            known = (count > 0) & bool(m.languages) & (2 * counts[:, m.scripts].sum(1) >= counts.sum(1))
            family, language, margin = np.full(n, UNKNOWN, object), np.full(n, UNKNOWN, object), np.zeros(n)
            if known.any():
                f, g, x = m.tell(sums[known] / count[known, None])
                family[known], language[known], margin[known] = f, g, np.where(np.isinf(x), 0, x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(family, pa.string()), pa.array(language, pa.string()), pa.array(np.round(margin, 6))], ["doc_id", "family", "language", "margin"])

    return small_batches(own).mapInArrow(run, schema)


def op10_language(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return identify(docs, train(docs))
