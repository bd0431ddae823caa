"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

Every partition writes one file of token ids and one of its documents' offsets; prefix
sums over the partitions' totals give each file's base in the whole, so that a document
has a global token offset though no file was written by more than one task. A file is
named by the digest of what it holds and only then moved to its place: a task that runs
twice, or again after an executor was lost, leaves the same file or one nobody points to.
"""

from __future__ import annotations

import hashlib
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import spread
from ._shared import new_dir, small_batches
from ._tokenizer import default_path, encoding, ranks

#: For the id after the vocabulary's last.
NEXT_ID = -1


def write_tokens(docs: DataFrame, folder: str, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_of_text: int | None = NEXT_ID) -> DataFrame:
    """Write token files and index below folder (a URI that every executor reaches).

    Gives (doc_id, shard, position, token_start, n_tokens) for each row: the file, the row's
    place in it, and where its tokens begin in all files together, ordered by base. Ids fit 16
    bits if the vocabulary and the end mark do, otherwise 32. end_of_text ends every document:
    by default the id after the vocabulary's last, None for no mark; one that is a token is an
    error. A null text has no token, an empty one only the end mark; texts of any length are
    whole; rows may repeat and ids may be null. Other columns don't matter, whatever their
    names. Empty partitions write no file; an empty table gives an empty index.
    """
    from pyarrow import fs

    tokenizer = tokenizer or default_path()
    last = max(ranks(tokenizer).values())
    if end_of_text == NEXT_ID:
        end_of_text = last + 1
    elif end_of_text is not None and end_of_text in ranks(tokenizer).values():
        raise ValueError(f"{end_of_text} is a token of the vocabulary")
    width = "H" if max(last, end_of_text or 0) < 1 << 16 else "I"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, store, root = encoding(tokenizer), *fs.FileSystem.from_uri(folder)
        tmp, sha, out = f"{root}/.{uuid.uuid4().hex}", hashlib.sha256(), None
        ids, counts = [], []
        for batch in batches:
            ids.append(batch.column("__id"))
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(tmp)
            for t in batch.column("__text"):
                t = t.as_py()
                tokens = array(width, enc.encode_ordinary(t) if t else [])
                if t is not None and end_of_text is not None:
                    tokens.append(end_of_text)
                counts.append(len(tokens))
                piece = tokens.tobytes()
                sha.update(piece)
                out.write(piece)
        if out is None:
            return
        out.close()
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.uint64).tobytes()
        sha.update(offsets)
        part = TaskContext.get().partitionId()
        name = f"tokens-{part:06d}-{sha.hexdigest()[:16]}"
        with store.open_output_stream(f"{tmp}.off") as f:
            f.write(offsets)
        store.move(f"{tmp}.off", f"{root}/{name}.offsets.u64")
        store.move(tmp, f"{root}/{name}.u{16 if width == 'H' else 32}")
        at = 0
        for own in ids:
            n = len(own)
            yield pa.RecordBatch.from_arrays(
                [own, pa.array([part] * n, pa.int64()), pa.array([name] * n), pa.array(np.arange(at, at + n)), pa.array(np.array(counts[at : at + n], np.int64))],
                ["doc_id", "__part", "shard", "position", "n_tokens"],
            )
            at += n

    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    index = small_batches(docs).select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).mapInArrow(run, f"doc_id {kind}, __part long, shard string, position long, n_tokens long")
    index.write.parquet(f"{folder}/index")  # the pass over the texts happens here, once
    index = spark.read.schema(index.schema).parquet(f"{folder}/index")
    # One row for each partition: prefix sums over those are small whatever the corpus holds.
    totals = index.groupBy("__part", "shard").agg(F.sum("n_tokens").alias("__n"), F.count("*").alias("__docs"))
    before = Window.orderBy("__part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", "__n", "__docs", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("token_base"), F.coalesce(F.sum("__docs").over(before), F.lit(0)).alias("doc_base"))
    bases.write.parquet(f"{folder}/manifest")
    bases = spark.read.parquet(f"{folder}/manifest").select(F.col("shard").alias("__shard"), "token_base")
    within = Window.partitionBy("shard").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    joined = index.withColumn("__start", start).join(bases, F.col("shard") == F.col("__shard"))
    return joined.select("doc_id", "shard", "position", (F.col("__start") + F.col("token_base")).alias("token_start"), "n_tokens")


class TokenFiles:
    """Memory-mapped reader of a folder of write_tokens, on a mounted file system."""

    def __init__(self, folder: str) -> None:
        import pyarrow.parquet as pq

        self.root = folder.removeprefix("file://")
        rows = sorted(pq.read_table(f"{self.root}/manifest").to_pylist(), key=lambda r: r["token_base"] + r["doc_base"])
        self.shards = [r["shard"] for r in rows]
        self.doc_bases = np.array([r["doc_base"] for r in rows] + [sum(r["__docs"] for r in rows)], np.int64)
        self.token_bases = np.array([r["token_base"] for r in rows] + [sum(r["__n"] for r in rows)], np.int64)
        self._open = lru_cache(256)(self._map)

    def _map(self, shard: str) -> tuple[np.ndarray, np.ndarray]:
        import os

        path = f"{self.root}/{shard}"
        kind = np.uint16 if os.path.exists(f"{path}.u16") else np.uint32
        path_tokens = f"{path}.u{8 * np.dtype(kind).itemsize}"
        tokens = np.memmap(path_tokens, kind, "r") if os.path.getsize(path_tokens) else np.zeros(0, kind)
        return tokens, np.memmap(f"{path}.offsets.u64", np.uint64, "r")

    def __len__(self) -> int:
        return int(self.doc_bases[-1])

    def document(self, shard: str, position: int) -> np.ndarray:
        tokens, offsets = self._open(shard)
        return tokens[int(offsets[position]) : int(offsets[position + 1])]

    def __getitem__(self, i: int) -> np.ndarray:
        k = int(np.searchsorted(self.doc_bases, i, "right")) - 1
        return self.document(self.shards[k], i - int(self.doc_bases[k]))

    def tokens(self, start: int, n: int) -> np.ndarray:
        """n tokens from a global offset on, over as many files as hold them."""
        out = []
        while n > 0:
            k = int(np.searchsorted(self.token_bases, start, "right")) - 1
            if k >= len(self.shards):
                break
            piece = self._open(self.shards[k])[0][start - int(self.token_bases[k]) :][:n]
            out.append(piece)
            start, n = start + len(piece), n - len(piece)
        return np.concatenate(out) if out else np.zeros(0, np.uint16)


def op2_token_output(spark, sf_dir: str) -> DataFrame:
    return write_tokens(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), new_dir(spark, "token-files"))
