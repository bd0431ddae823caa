"""Token counts with a cache keyed by the digests of content and of tokenizer.

The content of a text, with its line ends made one kind and white space at its ends taken
off, is digested in the JVM together with the tokenizer's version. The digests, of 32 bytes
each, meet the stored counts; one row of each that has none is encoded, and what it gave is
appended to the cache. Only digests are shuffled: texts are encoded where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import placed, spread
from ._shared import marked, new_dir, release, small_batches, write_marks, written
from ._tokenizer import default_path, encoding, version

CACHE_SCHEMA = "digest binary, n_tokens long"


def normalised(text: str | Column) -> Column:
    """Content that counts: CR LF and CR become LF, white space at both ends goes."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"\A\s+|\s+\z", "")


def content_digest(text: str | Column, tokenizer: str) -> Column:
    return F.unhex(F.sha2(F.concat(F.lit(version(tokenizer) + "\0"), normalised(text)).cast("binary"), 256))


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The stored counts, none if the folder isn't there yet. A digest may be stored twice."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(folder)


def update_cache(docs: DataFrame, folder: str, *, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Encode the distinct contents of docs that the cache lacks and append their counts; gives the digests of docs.

    Digests meet the cache first. Of each that it lacks one row is marked, and only marked
    rows are encoded, where they are: a text never crosses the network, and with a cache that
    knows all no text goes to Python. Null texts are not counted. A job that fails leaves the
    cache as it was; a digest that two writers append twice has the same count both times.
    """
    return _updated(docs, folder, [], text, tokenizer or default_path()).select("digest")


def _updated(docs: DataFrame, folder: str, keep: list[Column], text: str, tokenizer: str) -> DataFrame:
    """Bring the cache up to date; the kept columns and the digest of each row."""
    docs, rows = placed(docs, "count-docs")
    own = written(rows.select("__file", "__at", *keep, content_digest(text, tokenizer).alias("digest")), "count-digests")
    cache = read_cache(docs.sparkSession, folder)
    first = own.where("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct("__file", "__at")).alias("first"))
    misses = written(first.join(cache.select("digest"), "digest", "left_anti").select("digest", "first.*"), "count-misses")
    if misses.isEmpty():
        return own

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizer)
        for batch in batches:
            n = [len(enc.encode_ordinary(t.as_py())) for t in batch.column("content")]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])
        release()

    new = rows.select("__file", "__at", F.col(text).alias("content")).where(marked(write_marks(misses, "count-marks")))
    new = small_batches(new).select(content_digest("content", tokenizer).alias("digest"), normalised("content").alias("content"))
    new.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(folder)
    return own


def token_counts(docs: DataFrame, folder: str, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) for every row, through the cache in folder, which is brought up to date.

    n_tokens is of the whole normalised content, however long: 0 for an empty text, null for a
    null one. Rows that repeat come as often as they are; ids may be null; other columns don't
    matter. An empty table gives no rows and leaves the cache as it is. Counts of other
    tokenizers in the same cache have other digests.
    """
    own = _updated(docs, folder, [F.col(doc_id).alias("doc_id")], text, tokenizer or default_path())
    counts = read_cache(docs.sparkSession, folder).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return own.join(counts, "digest", "left").select("doc_id", "n_tokens")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    """Every call starts its own cache, so all distinct texts are encoded; a production job names a lasting folder."""
    return token_counts(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), new_dir(spark, "token-counts"))
