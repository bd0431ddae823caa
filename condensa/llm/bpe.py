"""Byte-level BPE by recursive queries in a DuckDB of each partition's worker.

Texts are cut into words by the vocabulary's pattern. The distinct words that a worker
hasn't met become rows (word, byte position, token, end); a recursive query joins
neighbours to the merge table, contracts each word's leftmost pair of least rank and goes
on with the words that changed, until none does. Decoding joins token rows to the
vocabulary in their order, and the column of pieces is the bytes of the texts one after
another. The pass over the texts is narrow: nothing is shuffled, and a worker's tables
are bounded.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import spread
from ._arrow import row_slices
from ._shared import release, small_batches
from ._tokenizer import PATTERN, default_path, ranks

#: Words a worker remembers; beyond that it forgets all but the half that it met most, and those it met once.
MEMORY_WORDS = 250_000
#: Rows that one recursive query may come to, a word of n bytes taking n(n + 1) / 2 at most, those that stay twice; ids
#: that one decoding query takes, and bytes of text handled at a time.
QUERY_CELLS = 4_000_000
DECODE_ROWS = 250_000
SLICE_BYTES = 2_000_000
#: Longer words (bytes) would take more rows than a query may have: they take the same contractions in the same order
#: from a heap. Positions have 16 bits in the query.
LONG_WORD = 2_000

#: A row knows its right neighbour and the rank of the pair they make, so a round looks up the two pairs that are new in a
#: word, and no others. Rank, position and end of a pair are one number, the least of which is the leftmost of least rank.
ENCODE = """
WITH RECURSIVE bpe(w, p, t, e, after, r, done) AS (
  SELECT w, p, t, e, after, rank, false FROM word_bytes LEFT JOIN merges ON pair = (t::BIGINT << 32 | after)
  UNION ALL
  SELECT w, p, t, e, after, CASE WHEN ask THEN rank ELSE r END, until IS NULL
  FROM (
    SELECT w, e, r, until, p = until OR e = least AS ask,
           CASE WHEN p = until THEN least ELSE p END AS p,
           CASE WHEN p = until THEN new ELSE t END AS t,
           CASE WHEN e = least THEN new ELSE after END AS after
    FROM bpe LEFT JOIN (
      SELECT w, (best >> 32)::INT AS new, (best >> 16 & 65535)::USMALLINT AS least, (best & 65535)::USMALLINT AS until
      FROM (SELECT w, min((r::BIGINT << 32) | (p::BIGINT << 16) | e) AS best FROM bpe WHERE r IS NOT NULL GROUP BY w) q) b USING (w)
    WHERE NOT done AND (until IS NULL OR p <> least)) q
  LEFT JOIN merges ON pair = CASE WHEN ask THEN t::BIGINT << 32 | after END
)
SELECT w, t FROM bpe WHERE done ORDER BY w, p
"""

DECODE = "SELECT piece FROM token_rows LEFT JOIN pieces USING (id) ORDER BY pos"


@lru_cache(2)
def _database(path: str):
    """A DuckDB in memory with the merge table and the vocabulary."""
    import duckdb

    vocabulary = ranks(path)
    pair, rank = [], []
    for token, r in vocabulary.items():
        for i in range(1, len(token)):
            a, b = vocabulary.get(token[:i]), vocabulary.get(token[i:])
            if a is not None and b is not None:
                pair.append(a << 32 | b)
                rank.append(r)
    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
    tables = {
        "merges": pa.table({"pair": pa.array(pair, pa.int64()), "rank": pa.array(rank, pa.int32())}),
        "pieces": pa.table({"id": pa.array(vocabulary.values(), pa.int32()), "piece": pa.array(vocabulary, pa.binary())}),
    }
    for name, rows in tables.items():
        con.register("rows_in", rows)
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM rows_in")
        con.unregister("rows_in")
    return con


def _table(con, query: str, name: str, rows: pa.Table) -> pa.Table:
    con.register(name, rows)
    try:
        return con.sql(query).to_arrow_table()
    finally:
        con.unregister(name)


def _by_heap(word: bytes, vocabulary: dict[bytes, int]) -> list[int]:
    """The same contractions for one long word: least rank first, leftmost of equals."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def push(p: int) -> None:
        if p >= 0 and end[p] < n and (r := vocabulary.get(word[p : end[end[p]]])) is not None:
            heapq.heappush(heap, (r, p, end[end[p]]))

    for p in range(n):
        push(p)
    while heap:
        r, p, to = heapq.heappop(heap)
        mid = end[p]
        if mid < 0 or mid >= n or end[mid] != to or vocabulary.get(word[p:to]) != r:
            continue  # one of the two has changed since
        end[p], end[mid] = to, -1
        if to < n:
            before[to] = p
        push(p)
        push(before[p])
    out, p = [], 0
    while p < n:
        out.append(vocabulary[word[p : end[p]]])
        p = end[p]
    return out


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _ranges(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n[i] numbers from starts[i] on, one range after another."""
    return np.arange(n.sum()) + np.repeat(starts - np.cumsum(n) + n, n)


class Codec:
    """Encodes and decodes with one vocabulary, remembering words it has met."""

    def __init__(self, path: str) -> None:
        import regex

        pattern = regex.compile(PATTERN)
        self.path, self.find, self.iterate = path, pattern.findall, pattern.finditer
        self.known, self.ids, self.starts = _Numbers(), np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.met = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keep the words met more than once, MEMORY_WORDS / 2 of those met most; counting begins anew."""
        most = np.argsort(-self.met, kind="stable")[: MEMORY_WORDS // 2]
        keep = np.sort(most[self.met[most] > 1])
        words, n = list(self.known), np.diff(self.starts)[keep]
        self.known = _Numbers((words[k], i) for i, k in enumerate(keep))
        self.ids, self.starts = self.ids[_ranges(self.starts[keep], n)], np.concatenate([[0], np.cumsum(n)])
        self.met = np.zeros(len(keep), np.int64)

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words one after another, and how many each has."""
        vocabulary = ranks(self.path)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        whole = np.fromiter((vocabulary.get(w, -1) for w in words), np.int64, len(words))
        counts, parts = np.ones(len(words), np.int64), []
        for i in np.flatnonzero((whole < 0) & (sizes > LONG_WORD)):
            parts.append((np.array([i]), np.array(_by_heap(words[i], vocabulary), np.int32)))
            counts[i] = len(parts[-1][1])
        asked = np.flatnonzero((whole < 0) & (sizes <= LONG_WORD))
        single = np.array([vocabulary[bytes([b])] for b in range(256)], np.int32)
        cells = np.concatenate([[0], np.cumsum(sizes[asked] * (sizes[asked] + 1) // 2)])
        for lo, hi in row_slices(cells, QUERY_CELLS):
            own = asked[lo:hi]
            n = sizes[own]
            end = np.cumsum(n)
            t = single[np.frombuffer(b"".join([words[i] for i in own]), np.uint8)]
            p = _ranges(np.zeros(len(n), np.int64), n)
            last = np.zeros(len(t), bool)
            last[end - 1] = True
            rows = pa.table({
                "w": pa.array(np.repeat(np.arange(len(own)), n), pa.int32()),
                "p": pa.array(p, pa.uint16()),
                "t": pa.array(t),
                "e": pa.array(p + 1, pa.uint16()),
                "after": pa.array(np.append(t[1:], 0), pa.int32(), mask=last),
            })
            got = _table(_database(self.path), ENCODE, "word_bytes", rows)
            counts[own] = np.bincount(got.column("w").to_numpy(), minlength=len(own))
            parts.append((own, got.column("t").to_numpy()))
        out = np.repeat(whole, counts).astype(np.int32)
        starts = np.cumsum(counts) - counts
        for own, t in parts:
            out[_ranges(starts[own], counts[own])] = t
        return out, counts

    def _numbered(self, text: str) -> np.ndarray:
        """The text's words by their numbers. The words of a long text aren't held all at once."""
        known = self.known
        if len(text) <= SLICE_BYTES:
            found = self.find(text)
            return np.fromiter(map(known.__getitem__, found), np.int32, len(found))
        return np.fromiter((known[m.group()] for m in self.iterate(text)), np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts one after another, and how many each has."""
        if len(self.known) > MEMORY_WORDS:
            self._forget()
        known, met = self.known, len(self.known)
        numbers = [self._numbered(t) for t in texts]
        pieces = np.fromiter(map(len, numbers), np.int64, len(numbers))
        if len(known) > met:
            new = [w.encode() for w in list(known)[met:]]
            ids, counts = self._encode_words(new)
            self.ids = np.concatenate([self.ids, ids])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
        at = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
        counted = np.bincount(at, minlength=len(known))
        counted[:met] += self.met
        self.met = counted
        n = np.diff(self.starts)[at]
        tokens = self.ids[_ranges(self.starts[at], n)]
        bounds = np.concatenate([[0], np.cumsum(pieces)])
        sums = np.concatenate([[0], np.cumsum(n)])[bounds]
        return tokens, np.diff(sums)

    def decode(self, tokens: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of ids laid end to end, counts[i] of them for each. Bytes that are no UTF-8 become U+FFFD.

        A query takes DECODE_ROWS ids at most, wherever a text ends: the bytes of a longer one are put together here.
        """
        out, ends = [[] for _ in counts], np.cumsum(counts)
        for a in range(0, len(tokens), DECODE_ROWS):
            own = tokens[a : a + DECODE_ROWS]
            rows = pa.table({"pos": pa.array(np.arange(len(own)), pa.int32()), "id": pa.array(own, pa.int32())})
            for got in _table(_database(self.path), DECODE, "token_rows", rows).column("piece").chunks:
                _, offs, data = got.buffers()
                offs = np.frombuffer(offs, np.int32, len(got) + 1, got.offset * 4)
                d = int(np.searchsorted(ends, a, "right"))  # the text that the chunk begins in
                to = int(np.searchsorted(ends, a + len(got), "left"))
                cut = offs[np.minimum(ends[d:to + 1] - a, len(got))]
                for k, (x, y) in enumerate(zip([offs[0], *cut], cut), d):
                    out[k].append(data[x:y])
                a += len(got)
        return [b"".join(x).decode("utf-8", "replace") for x in out]


@lru_cache(2)
def codec(path: str) -> Codec:
    """The worker's own; what it has met stays for its next partition."""
    return Codec(path)


def _sliced(lengths: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    return row_slices(np.concatenate([[0], np.cumsum(lengths)]), limit)


def _frame(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))


def _encoded(c: Codec, batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]]:
    """(ids, lists of tokens, tokens laid end to end, how many of each) for slices of a batch of (doc_id, text)."""
    texts = batch.column("text")
    sizes = np.array(pa.compute.fill_null(pa.compute.binary_length(texts), 0), np.int64)
    for a, b in _sliced(sizes, SLICE_BYTES):
        part = texts.slice(a, b - a)
        tokens, counts = c.encode(pa.compute.fill_null(part, "").to_pylist())
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32(), mask=np.append(np.array(part.is_null()), False))
        yield batch.column("doc_id").slice(a, b - a), pa.ListArray.from_arrays(offsets, pa.array(tokens)), tokens, counts


def _text_of(c: Codec, tokens: np.ndarray, counts: np.ndarray, lists: pa.Array) -> pa.Array:
    return pa.array(c.decode(tokens, counts), pa.string(), mask=np.array(lists.is_null()))


def encode(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(doc_id, tokens) for every row: [] for an empty text, null for a null one.

    Rows repeat as they do in docs, ids may be null, other columns don't matter. Texts of
    any length are encoded whole. An empty table gives an empty result.
    """
    path, own = tokenizer or default_path(), _frame(docs, doc_id, text)
    schema = T.StructType([own.schema["doc_id"], T.StructField("tokens", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, lists, _, _ in _encoded(codec(path), batch):
                yield pa.RecordBatch.from_arrays([ids, lists], ["doc_id", "tokens"])
        release()

    return small_batches(own).mapInArrow(run, schema)


def decode(tokens: DataFrame, *, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, tokens, decoded) of a frame of (doc_id, tokens). Null tokens decode to null; an unknown id is an error.

    Lists of any length are decoded whole, DECODE_ROWS ids at a time. An empty table gives an empty result.
    """
    path = tokenizer or default_path()
    own = tokens.select("doc_id", "tokens")
    schema = T.StructType([*own.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            sizes = np.array(pa.compute.fill_null(pa.compute.list_value_length(lists), 0), np.int64)
            for a, b in _sliced(sizes, SLICE_BYTES // 4):
                part = lists.slice(a, b - a)
                ids = np.array(part.flatten(), np.int32)
                if len(ids) and not 0 <= ids.min() <= ids.max() < len(ranks(path)):
                    raise ValueError("an id that the vocabulary doesn't have")
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), part, _text_of(codec(path), ids, sizes[a:b], part)], ["doc_id", "tokens", "decoded"])
        release()

    return small_batches(own).mapInArrow(run, schema)


def encode_decode(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(doc_id, tokens, decoded): what decode(encode(docs)) gives, by one worker for each task instead of two."""
    path, own = tokenizer or default_path(), _frame(docs, doc_id, text)
    schema = T.StructType([own.schema["doc_id"], T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, lists, tokens, counts in _encoded(codec(path), batch):
                yield pa.RecordBatch.from_arrays([ids, lists, _text_of(codec(path), tokens, counts, lists)], ["doc_id", "tokens", "decoded"])
        release()

    return small_batches(own).mapInArrow(run, schema)


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_decode(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
