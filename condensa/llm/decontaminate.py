"""Benchmark decontamination with one Aho-Corasick automaton.

A test item is its words in lower case. The automaton holds each item's words in blocks
of seven, laid end to end: a run of thirteen words shared with an item has a whole block
within it wherever it begins, so that blocks find every such run while the automaton is
no larger than the items. A hit is extended to both sides word by word; runs of thirteen
words or more, or of a whole shorter item, count. A text is scanned once; the words of
one that has a hit lead back to offsets in the text as it was.

Items of fewer than five words, such as answers, turn up by chance: they count where
another part of the same item, its question, is near, and where they are all of a text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..storage import spread
from ._shared import new_dir, release, small_batches, written

#: Words in a row that make a leak. Shorter items count when they are there as a whole.
MIN_RUN = 13
#: Items of fewer words count near another part of theirs only (or as a text's only words), within so many words.
MIN_ITEM, NEAR = 5, 100
#: Characters of items that one automaton holds; more items take more passes over the texts, none is left out.
AUTOMATON_CHARS = 8_000_000

_WORDS = re.compile(r"[^\W_]+")


def item_words(text: str | None) -> list[str]:
    return " ".join(_WORDS.findall(text or "")).lower().split(" ")


class Matcher:
    def __init__(self, items: list[tuple[object, str]], min_run: int = MIN_RUN, min_item: int = MIN_ITEM, near: int = NEAR) -> None:
        import ahocorasick

        self.min_run, self.near, block = min_run, near, max(1, (min_run + 1) // 2)
        self.items = [(i, w) for i, w in ((i, item_words(t)) for i, t in items) if w != [""]]
        blocks: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
        self.short: dict[object, list[int]] = defaultdict(list)
        self.whole: dict[str, list[int]] = defaultdict(list)
        for k, (i, w) in enumerate(self.items):
            if len(w) < min_item:
                self.short[i].append(k)
                self.whole[" " + " ".join(w) + " "].append(k)
                continue
            n = block if len(w) >= min_run else len(w)
            for j in range(0, len(w) - n + 1, n):
                blocks[" " + " ".join(w[j : j + n]) + " "].append((k, j, n))
        self.automaton = ahocorasick.Automaton()
        for b, at in blocks.items():
            self.automaton.add_word(b, at)
        if blocks:
            self.automaton.make_automaton()
        self.empty = not blocks

    def _answers(self, found: set[tuple[int, int, int]], words: list[str]) -> set[tuple[int, int, int]]:
        """Short parts of the items found, near what was found of them but not within it."""
        out = set()
        for k, a, b in found:
            for s in self.short.get(self.items[k][0], ()):
                w = self.items[s][1]
                places = [*range(max(0, a - self.near - len(w)), a - len(w) + 1), *range(b, min(len(words), b + self.near + len(w)) - len(w) + 1)]
                out |= {(s, p, p + len(w)) for p in places if words[p : p + len(w)] == w}
        return out

    def runs(self, text: str | None) -> list[tuple[object, int, int, int, int]]:
        """(item id, start, end, words in the run, words in the item), offsets in characters of text."""
        if not text:
            return []
        norm = " " + " ".join(_WORDS.findall(text)).lower() + " "
        hits = [] if self.empty else list(self.automaton.iter(norm))
        whole = self.whole.get(norm, ())
        if not hits and not whole:
            return []
        words = norm.split(" ")[1:-1]
        found, seen_to, last_end, at_word = {(k, 0, len(words)) for k in whole}, {}, 0, 0
        for end, places in hits:
            at_word += norm.count(" ", last_end, end)  # words that end before this block's last sign
            last_end = end
            for k, j, n in places:
                w = self.items[k][1]
                p = at_word - n
                if p < seen_to.get((k, p - j), -1):  # within a run already found
                    continue
                a = 0
                while a < j and a < p and words[p - a - 1] == w[j - a - 1]:
                    a += 1
                b = n
                while j + b < len(w) and p + b < len(words) and words[p + b] == w[j + b]:
                    b += 1
                seen_to[k, p - j] = p + b
                if a + b >= min(self.min_run, len(w)):
                    found.add((k, p - a, p + b))
        if not found:
            return []
        if self.short:
            found |= self._answers(found, words)
        spans = [m.span() for m in _WORDS.finditer(text)]
        return [(self.items[k][0], spans[a][0], spans[b - 1][1], b - a, len(self.items[k][1])) for k, a, b in sorted(found)]


@lru_cache(1)
def _matcher(folder: str, min_run: int, min_item: int, near: int) -> Matcher:
    """The worker's automaton of a table of items; it stays for the worker's next task."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    files = [f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet")]
    rows = ds.dataset(files, filesystem=store, format="parquet").to_table() if files else pa.table({"item": [], "text": []})
    return Matcher(sorted(zip(rows.column("item").to_pylist(), rows.column("text").to_pylist()), key=lambda x: (x[0] is not None, x[0], x[1])), min_run, min_item, near)


def _automata(benchmark: DataFrame, item_id: str, text: str, limit: int) -> list[str]:
    """Folders with the distinct items of an automaton each, which workers read by themselves: nothing comes to the driver.

    All parts of an item are in one. They are as many as it takes for limit characters each.
    """
    spark, path = benchmark.sparkSession, new_dir(benchmark.sparkSession, "leak-items")
    items = written(benchmark.where(F.col(text).isNotNull()).select(F.col(item_id).alias("item"), F.col(text).alias("text")).distinct(), "", path)
    parts = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // limit))
    if parts == 1:
        return [path]
    paths = [new_dir(spark, "leak-items") for _ in range(parts)]
    for k, p in enumerate(paths):
        written(items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == k), "", p)
    return paths


def short_items(benchmark: DataFrame, *, item_id: str = "item_id", item_text: str = "text", min_item: int = MIN_ITEM) -> DataFrame:
    """(item_id, text, alone): items of fewer than min_item words, which a longer text alone doesn't betray. alone: no
    other part of the item has more words, so that they are only found as all of a text."""
    words = F.regexp_count(item_text, F.lit(r"[\p{L}\p{N}]+"))
    own = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"), words.alias("n")).distinct()
    most = own.groupBy(F.col("item_id").alias("i")).agg(F.max("n").alias("most"))
    return own.where(F.col("n") < min_item).join(most, F.col("item_id").eqNullSafe(F.col("i"))).select("item_id", "text", (F.col("most") < min_item).alias("alone"))


def leaks(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_run: int = MIN_RUN, min_item: int = MIN_ITEM, near: int = NEAR, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """(doc_id, item_id, start, end, n_words, item_words) for every run of an item in a text.

    An item may have several rows, such as its question and its answer. Null and empty texts
    and items have no runs; ids of both sides may be null and of any type with an order. Rows
    that repeat give their runs each time, an item given twice the same counts once. Texts are
    scanned whole, whatever their length. Other columns don't matter. An empty table on either
    side gives no rows.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = [own.schema["doc_id"], T.StructField("item_id", benchmark.schema[item_id].dataType), *(T.StructField(c, T.LongType()) for c in ("start", "end", "n_words", "item_words"))]
    kinds = [to_arrow_type(f.dataType) for f in fields[1:]]
    out = docs.sparkSession.createDataFrame([], T.StructType(fields))
    for k, folder in enumerate(_automata(benchmark, item_id, item_text, automaton_chars)):

        def run(batches: Iterator[pa.RecordBatch], folder=folder) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = _matcher(folder, min_run, min_item, near)
                ids, rows = [], []
                for i, t in enumerate(batch.column("text")):
                    new = m.runs(t.as_py())
                    rows += new
                    ids += [i] * len(new)
                if rows:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids)), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], [f.name for f in fields])
            release()

        part = small_batches(own).mapInArrow(run, T.StructType(fields))
        out = out.unionByName(part) if k else part
    return out


def reject_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", min_run: int = MIN_RUN, min_item: int = MIN_ITEM, near: int = NEAR, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """The rows of docs without a run of any item, with all their columns. Odd rows are as in leaks: those without runs stay."""
    for folder in _automata(benchmark, item_id, item_text, automaton_chars):
        docs = small_batches(docs).where(~_leaked(text, folder, min_run, min_item, near))
    return docs


def _leaked(text: str, folder: str, min_run: int, min_item: int, near: int) -> Column:
    @F.arrow_udf("boolean")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            m = _matcher(folder, min_run, min_item, near)
            yield pa.array([bool(m.runs(t.as_py())) for t in texts], pa.bool_())

    return run(F.col(text))


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leaks(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
