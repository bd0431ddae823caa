"""Repeated passages by a distributed, sparse suffix array.

Every run of 50 words that two texts share has a suffix in the array that begins within it
at the same place in both: suffixes begin where the hash of eight words is the least among
43 neighbours, which depends on those 50 words only. So the array has one suffix for about
22 words and still misses no repeat. Splitters sampled from the suffixes' leading words cut
them into ranges of about equal size; a bucket sorts its suffixes by multikey quicksort
(four words at a time, only within what is still equal) and takes from its neighbours of
other texts how far each is shared to the right; the words before the suffix, which come
along, tell how far to the left. Leading words so common that they fill more than one
range are spread over those, and what such a bucket couldn't pair is compared across them.

Each text's result are its words that lie in runs of at least 50 that occur elsewhere too.
Words are compared by 16 bits of their hash: where the word next to a run agrees by chance,
once in 65,536 pairs, a stretch is a word longer; none is ever shorter or missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import placed, spread
from ._arrow import gram_hashes, mix, word_slices, words
from ._shared import marked, release, small_batches, write_marks, written

MIN_WORDS = 50
LEAD = 8
#: Bytes of suffixes that a bucket should hold, and the share of texts that splitters are taken from.
BUCKET_BYTES = 8_000_000
SAMPLE = 0.02
#: Rows of a part that a plain sort ends.
SMALL_PART = 32
#: Kinds of what a bucket gives: words that another row has too; a window of common leading words without a pair in the
#: bucket; the first of each that has; words that an earlier row has.
FOUND, ALONE, FIRST, LATER = 0, 1, 2, 3

_PLACE = np.uint64((1 << 26) - 1)
_ROLL = np.uint64(0x9E3779B97F4A7C15)


def suffix_starts(h: np.ndarray, bounds: np.ndarray, min_words: int = MIN_WORDS, lead: int = LEAD) -> np.ndarray:
    """Positions of the words where suffixes begin; h are word hashes, bounds those of the texts."""
    first = np.concatenate([np.arange(a, b - min_words + 1) for a, b in zip(bounds, bounds[1:])] or [np.zeros(0, np.int64)])
    if not len(first):
        return np.zeros(0, np.int64)
    grams = mix(gram_hashes(h, lead))
    # The rightmost of equal hashes is the least; a text's later words don't matter for that.
    least = (grams & ~_PLACE) | (_PLACE - np.arange(len(grams), dtype=np.uint64))
    width, span = 1, min_words - lead + 1
    while 2 * width <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    least = np.minimum(least[first], least[first + span - width])
    return np.unique((_PLACE - (least & _PLACE)).astype(np.int64))


def _contexts(h: np.ndarray, bounds: np.ndarray, at: np.ndarray, min_words: int, lead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For suffixes at: 16-bit words around each, how many of those before and from it are its text's."""
    before = min_words - lead
    row = np.searchsorted(bounds, at, "right") - 1
    left = np.minimum(at - bounds[row], before)
    right = np.minimum(bounds[row + 1] - at, min_words)
    words = (h >> np.uint64(48)).astype(np.uint16)
    around = at[:, None] + np.arange(-before, min_words)
    return words[np.clip(around, 0, len(words) - 1)], left.astype(np.uint8), right.astype(np.uint8)


def _leading(context: np.ndarray, min_words: int, lead: int) -> np.ndarray:
    """A number that orders suffixes by their leading words, a byte of each of the first eight."""
    own = (context[:, min_words - lead :][:, :8] >> 8).astype(np.int64)
    key = np.zeros(len(own), np.int64)
    for k in range(own.shape[1]):
        key = key << 8 | own[:, k]
    return key


def _suffixes(docs: DataFrame, id_field: T.StructField, min_words: int, lead: int, bucket: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(bucket, key, row, doc_id, pos, context) of the suffixes of docs; bucket is of key and row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, h, _, _, bounds, _, _ in word_slices(batch.column("text")):
                at = suffix_starts(h, bounds, min_words, lead)
                if not len(at):
                    continue
                context, left, right = _contexts(h, bounds, at, min_words, lead)
                row = np.searchsorted(bounds, at, "right") - 1
                own = pa.array(row + lo)
                raw = np.concatenate([context.view(np.uint8).reshape(len(at), -1), left[:, None], right[:, None]], 1)
                width = raw.shape[1]
                packed = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.arange(0, len(raw) * width + 1, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
                key, rows = _leading(context, min_words, lead), batch.column("row").take(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket(key, rows.to_numpy()).astype(np.int32)), pa.array(key), rows, batch.column("doc_id").take(own), pa.array((at - bounds[row]).astype(np.int32)), packed],
                    ["bucket", "key", "row", "doc_id", "pos", "context"],
                )
        release()

    return small_batches(docs).mapInArrow(run, T.StructType().add("bucket", "integer").add("key", "long").add("row", "long").add(id_field).add("pos", "integer").add("context", "binary"))


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of the rows of a matrix of 16-bit words by multikey quicksort (Bentley and Sedgewick, 1997).

    A digit is four words. Every part that isn't in order yet is split around a digit of its
    own into less, equal and greater; equal ones go on with the next digit. All parts are
    split at once. Parts of a few rows end in a plain sort, as usual.
    """
    n, width = words.shape
    padded = np.zeros((n, -(-width // 4) * 4), np.uint16)
    padded[:, :width] = words
    digits = padded.byteswap().view(np.dtype(">u8")).astype(np.uint64)  # the first word weighs most
    order = np.arange(n)
    at = np.arange(n)  # places in order that are still to be sorted; parts lie one after another
    start, size, depth = np.zeros(1, np.int64), np.array([n]), np.zeros(1, np.int64)  # of the parts, start within at
    while True:
        small = size <= SMALL_PART
        done = small | (depth == digits.shape[1])
        part = np.repeat(np.arange(len(size)), size)
        rest = np.flatnonzero((small & (depth < digits.shape[1]) & (size > 1))[part])
        if len(rest):
            rows, p = order[at[rest]], part[rest]
            keys = [np.where(depth[p] <= d, digits[rows, d], 0) for d in range(digits.shape[1] - 1, int(depth[p].min()) - 1, -1)]
            order[at[rest]] = rows[np.lexsort([*keys, p])]
        if done.all():
            return order
        keep = ~done[part]
        at, size, depth = at[keep], size[~done], depth[~done]
        start = np.cumsum(size) - size
        part = np.repeat(np.arange(len(size)), size)
        rows = order[at]
        own = digits[rows, depth[part]]
        three = np.sort(np.stack([own[start], own[start + size // 2], own[start + size - 1]]), 0)
        pivot = three[1][part]
        side = (own > pivot).astype(np.int64) + (own >= pivot)
        counts = np.bincount(part * 3 + side, minlength=3 * len(size))
        begin = np.cumsum(counts) - counts
        to = np.empty(len(rows), np.int64)
        for k in range(3):
            mine = side == k
            before = np.cumsum(mine) - mine  # rows of this side so far, those of earlier parts too
            to[mine] = (begin[part * 3 + k] + before - before[start][part])[mine]
        moved = np.empty_like(rows)
        moved[to] = rows
        order[at] = moved
        there = counts > 0
        size, depth = counts[there], (np.repeat(depth, 3) + np.tile([0, 1, 0], len(depth)))[there]


def _shared_right(words: np.ndarray, right: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each suffix the most words it shares with one of another row, from its neighbours in order."""
    order = multikey_order(words)
    n, width = words.shape
    common = np.zeros(n, np.int64)  # with the one before
    for a in range(1, n, 1 << 16):
        b = min(n, a + (1 << 16))
        x, y = order[a - 1 : b - 1], order[a:b]
        differ = words[x] != words[y]
        run = np.where(differ.any(1), differ.argmax(1), width)
        common[a:b] = np.minimum(run, np.minimum(right[x], right[y]))
    own = row[order]
    new = np.ones(n, bool)
    new[1:] = own[1:] != own[:-1]

    def to_other(common: np.ndarray, new: np.ndarray) -> np.ndarray:
        """The least of common since the last row other than one's own: it begins anew with each run of one row."""
        drop = np.cumsum(new) * (width + 1)
        return np.minimum.accumulate(common - drop) + drop

    down = to_other(common, new)
    up = to_other(np.append(common[1:], 0)[::-1], np.append(new[1:], True)[::-1])[::-1]
    out = np.empty(n, np.int64)
    out[order] = np.maximum(down, up)
    return out


def _windows(context: np.ndarray, min_words: int) -> np.ndarray:
    """Hash of the min_words words from each column on; all that a context has."""
    n, width = context.shape
    powers = np.multiply.accumulate(np.full(width, _ROLL))
    inverse = np.multiply.accumulate(np.full(width, np.uint64(pow(int(_ROLL), -1, 1 << 64))))
    sums = np.zeros((n, width + 1), np.uint64)
    np.cumsum((mix(context.astype(np.uint64) + np.uint64(1))) * powers, axis=1, out=sums[:, 1:])
    count = width - min_words + 1
    return mix((sums[:, min_words:] - sums[:, :count]) * inverse[:count])


def _bucket(row: np.ndarray, pos: np.ndarray, raw: np.ndarray, key: np.ndarray, split: np.ndarray, min_words: int, lead: int) -> tuple[np.ndarray, ...]:
    """(kind, hash, suffix, start, end) of what a bucket finds, see the kinds."""
    before = min_words - lead
    context, left, right = np.ascontiguousarray(raw[:, :-2]).view(np.uint16), raw[:, -2].astype(np.int64), raw[:, -1].astype(np.int64)
    common = _shared_right(context[:, before:], right, row)
    spread = np.isin(key, split)
    kept = np.flatnonzero((common >= lead) | spread)
    none = np.zeros(0, np.int64)
    if not len(kept):
        return none, none, none, none, none
    # A window that begins a words before its suffix has min_words - a to its right.
    shift = before - np.arange(before + 1)
    most = np.where(spread, min_words, common)[kept]
    valid = (shift <= left[kept, None]) & (min_words - shift <= np.minimum(right[kept], most)[:, None])
    s, c = (x.astype(np.int32) for x in np.nonzero(valid))
    h = _windows(context[kept], min_words)[s, c]
    order = np.lexsort((row[kept][s], h))
    sorted_h, rows = h[order], row[kept][s[order]]
    cut = np.flatnonzero(np.concatenate([[True], sorted_h[1:] != sorted_h[:-1]])) if len(h) else none
    times = np.diff(np.append(cut, len(h)))
    least = np.repeat(rows[cut], times)
    many = rows[cut] != rows[cut + times - 1]
    found, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    found[order], later[order] = np.repeat(many, times), rows != least
    start = pos[kept][s] - shift[c]

    def stretches(which: np.ndarray, kind: int) -> tuple[np.ndarray, ...]:
        """Neighbouring windows of one suffix make one span."""
        fs, fstart = s[which], start[which]
        first = np.concatenate([[True], (fs[1:] != fs[:-1]) | (fstart[1:] != fstart[:-1] + 1)]) if len(fs) else np.zeros(0, bool)
        last = np.append(first[1:], True) if len(fs) else first
        return np.full(first.sum(), kind), np.zeros(first.sum(), np.int64), kept[fs[first]], fstart[first], fstart[last] + min_words

    own = spread[kept][s]
    alone = own & ~found
    one = order[cut[many]]
    one = one[own[one]]
    out = [stretches(found, FOUND), stretches(later, LATER)]
    out.append((np.full(alone.sum(), ALONE), h[alone].view(np.int64), kept[s[alone]], start[alone], start[alone] + min_words))
    out.append((np.full(len(one), FIRST), h[one].view(np.int64), kept[s[one]], start[one], start[one] + min_words))
    return tuple(np.concatenate(x) for x in zip(*out))


def _compared(own: DataFrame, min_words: int, lead: int, bucket_bytes: int, later: bool) -> DataFrame:
    """(row, doc_id, start, end): runs of own (row, doc_id, text) that another row has too, or, if later, an earlier one."""
    spark, id_field = own.sparkSession, own.schema["doc_id"]
    sampled = written(_suffixes(own.sample(SAMPLE, 1), id_field, min_words, lead, lambda key, row: key * 0).select("key"), "suffix-sample")
    size = sampled.count() / SAMPLE * (2 * (2 * min_words - lead) + 40)
    buckets = max(spark.sparkContext.defaultParallelism, int(size // bucket_bytes) + 1)
    cuts = sampled.agg(F.percentile_approx("key", [k / buckets for k in range(1, buckets)], 100 * buckets)).first()[0] if buckets > 1 else []
    cuts = np.array(cuts or [], np.int64)
    same, times = np.unique(cuts, return_counts=True)
    split = same[times > 1]  # leading words that fill a range
    sent = spark.sparkContext.broadcast((cuts, split))  # a number or two for each bucket

    def place(key: np.ndarray, row: np.ndarray) -> np.ndarray:
        cuts, _ = sent.value
        lo, hi = np.searchsorted(cuts, key, "left"), np.searchsorted(cuts, key, "right")
        return np.where(hi - lo > 1, lo + 1 + (mix(row.astype(np.uint64)) % np.maximum(hi - lo, 1).astype(np.uint64)).astype(np.int64), hi)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, split = sent.value
        width = 2 * (2 * min_words - lead) + 2
        columns: dict[str, list] = {"row": [], "pos": [], "key": [], "raw": [], "doc_id": []}
        for batch in batches:
            if not len(batch):
                continue
            context = batch.column("context")
            first = np.frombuffer(context.buffers()[1], np.int32, 1, context.offset * 4)[0]
            columns["raw"].append(np.frombuffer(context.buffers()[2], np.uint8, len(batch) * width, first).reshape(len(batch), width))
            columns["doc_id"].append(batch.column("doc_id"))
            for c in ("row", "pos", "key"):
                columns[c].append(batch.column(c).to_numpy())
        if not columns["row"]:
            return
        ids = pa.chunked_array(columns.pop("doc_id"))
        row, pos, key, raw = (np.concatenate(columns.pop(c)) for c in ("row", "pos", "key", "raw"))
        kind, h, at, start, end = _bucket(row, pos.astype(np.int64), raw, key, split, min_words, lead)
        wanted = (kind != (FOUND if later else LATER))
        kind, h, at, start, end = (x[wanted] for x in (kind, h, at, start, end))
        yield from pa.table({
            "kind": pa.array(kind.astype(np.int32)), "hash": pa.array(h), "row": pa.array(row[at]), "doc_id": ids.take(pa.array(at)),
            "start": pa.array(start.astype(np.int32)), "end": pa.array(end.astype(np.int32)),
        }).to_batches(max_chunksize=50_000)
        del row, pos, key, raw, ids
        release()

    schema = T.StructType().add("kind", "integer").add("hash", "long").add("row", "long").add(id_field).add("start", "integer").add("end", "integer")
    found = written(_suffixes(own, id_field, min_words, lead, place).repartitionById(buckets, "bucket").drop("bucket").mapInArrow(compare, schema), "suffix-found")
    names = ["row", "doc_id", "start", "end"]
    spans = found.where(F.col("kind") == (LATER if later else FOUND)).select(names)
    if len(split):
        across = found.where(F.col("kind").isin(ALONE, FIRST))
        pairs = across.groupBy("hash").agg(F.min("row").alias("a"), F.max("row").alias("b")).where("a <> b").select("hash", "a")
        across = across.join(pairs, "hash").where("row <> a") if later else across.where(F.col("kind") == ALONE).join(pairs, "hash", "left_semi")
        spans = spans.unionByName(across.select(names))
    return spans


def _stretches(spans: DataFrame, min_words: int, joined: bool) -> DataFrame:
    """Spans of a row put together: where no run of min_words in them is left out, or, if joined, where they touch."""
    own_row = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(own_row.rowsBetween(Window.unboundedPreceding, -1))
    edge = reach if joined else reach - min_words + 1
    spans = spans.withColumn("new", (reach.isNull() | (F.col("start") > edge)).cast("int")).withColumn("part", F.sum("new").over(own_row))
    return spans.groupBy("row", "part").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start_word"), F.max("end").alias("end_word"))


def repeated_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, lead: int = LEAD, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, start_word, end_word) of every longest stretch of a text all of whose runs of min_words words occur in another row.

    Words are runs of letters and digits, in lower case, counted from 0; end_word is the
    first word after the stretch. Null, empty and shorter texts have none; longer ones are
    read whole. A row that comes twice is repeated by itself; ids may be null or repeat, each
    row counts by itself. Repeats within one text only don't count. An empty table gives no
    rows. Other columns don't matter.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    return _stretches(_compared(own, min_words, lead, bucket_bytes, False), min_words, False).select("doc_id", "start_word", "end_word")


def _without(text: str, spans: list[dict]) -> str:
    raw = text.encode()
    _, starts, ends = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    out, at = [], 0
    for a, b in sorted((x["start_word"], x["end_word"]) for x in spans):
        out.append(raw[at : starts[a]])
        at = int(starts[b]) if b < len(starts) else int(ends[-1])
    return b"".join([*out, raw[at:]]).decode()


def remove_repeats(docs: DataFrame, *, text: str = "text", min_words: int = MIN_WORDS, lead: int = LEAD, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs with every run of min_words words that occurs in several rows left in one of them; all rows and columns stay.

    The row that keeps a run is the first by a hash of its place in docs' files, so it is the
    same whatever the cluster. Of a word that lies in several runs, one that goes is enough. A
    text that is nothing but such runs becomes empty (or what punctuation it ends with).
    Null, empty and shorter texts stay as they are; a run twice in one row and no other stays.
    Only rows that lose words are shuffled.
    """
    docs, rows = placed(docs, "suffix-docs")
    own = rows.select(F.struct(F.xxhash64("__file").alias("f"), F.col("__at").alias("at")).alias("doc_id"), F.col(text).alias("text"), F.xxhash64("__file", "__at").alias("row"))
    spans = _stretches(_compared(own, min_words, lead, bucket_bytes, True), min_words, True)
    spans = written(spans.groupBy(F.col("doc_id.f").alias("__f"), F.col("doc_id.at").alias("__at")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("__spans")), "suffix-later")
    files = rows.select("__file").distinct().withColumn("__f", F.xxhash64("__file"))
    hit = marked(write_marks(spans.join(files, "__f").select("__file", "__at"), "suffix-marks"))

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([_without(t, x) for t, x in zip(texts.to_pylist(), spans.to_pylist())], pa.string())

    names = [F.col(f"`{c}`") for c in docs.columns]
    changed = small_batches(rows).where(hit).withColumn("__f", F.xxhash64("__file")).join(spans, ["__f", "__at"])
    changed = changed.select(*[cut(F.col(f"`{c}`"), F.col("__spans")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
    return rows.where(~hit).select(*names).unionByName(changed)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
