"""Readers of paired corpora. Each gives rows with their columns as they are; splits() puts them together."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import in_order, written

SPLITS = ("train", "validation", "test")


def splits(train: DataFrame | None = None, validation: DataFrame | None = None, test: DataFrame | None = None, *, row_id: str) -> DataFrame:
    """One frame with split and split_order; row_id names the column that orders a split's rows.

    A split that isn't passed has no rows; without any there is nothing to do, an error.
    """
    passed = [(k, name, df) for k, (name, df) in enumerate(zip(SPLITS, (train, validation, test))) if df is not None]
    if not passed:
        raise ValueError("pass at least one split")
    return reduce(lambda a, b: a.unionByName(b), (df.withColumns({"split": F.lit(name), "split_order": F.lit(k), "row_id": F.col(row_id)}) for k, name, df in passed))


def split_by(df: DataFrame, split: Column, *, row_id: str) -> DataFrame:
    """As splits, for rows of one table whose split is an expression: one scan instead of three."""
    order = F.array_position(F.array(*[F.lit(s) for s in SPLITS]), F.col("split")) - 1
    return df.withColumn("split", split).withColumns({"split_order": order.cast("int"), "row_id": F.col(row_id)})


def jsonl_of_language(spark: SparkSession, path: str, schema: str | T.StructType, language: str = "deu", column: str = "language") -> DataFrame:
    """JSON lines of one language."""
    return spark.read.schema(schema).json(path).where(F.col(column) == language)


def nested_json(spark: SparkSession, path: str, sample: str) -> DataFrame:
    """{split: {id: sample}} in one document per file; sample is the DDL of a sample's columns. Ids are dropped.

    A document is one JSON object, which can't be read in parts: a file is a row, of 2 GB at most.
    """
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,map<string,struct<{sample}>>>").alias("all"))
    by_split = raw.select(F.explode("all").alias("split", "samples"))
    return by_split.select("split", F.explode("samples").alias("id", "sample")).select("split", "sample.*")


def json_folder(spark: SparkSession, folder: str, schema: str | T.StructType, lists: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows with their split, rows that no list names). A folder of one JSON per file; lists names, for each split, a file of file names.

    A file in two lists belongs to the first of them, in the order given.
    """
    docs = spark.read.schema(schema).option("multiLine", True).json(folder).select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file_name"))
    names = reduce(lambda a, b: a.unionByName(b), (
        spark.read.text(path).select(F.btrim("value", F.lit("\n ")).alias("file_name"), F.lit(k).alias("k"), F.lit(split).alias("split")) for k, (split, path) in enumerate(lists.items())
    ))
    first = names.groupBy("file_name").agg(F.min_by("split", "k").alias("split"))
    return docs.join(first, "file_name"), docs.join(first, "file_name", "left_anti")


def csv_pairs(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Comma-separated with a header; quoted fields hold line breaks and doubled quotes. A field without quotes and signs is null, '""' is the empty text."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    # By default the mark of a null is the empty text, and NUL escapes a quote.
    reader = reader.option("nullValue", uuid.uuid4().hex).option("charToEscapeQuoteEscaping", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Files as csv_pairs reads them, fields in quotes but for nulls: Spark's own writer quotes these too, so that they are empty texts."""
    if len(df.columns) < 2:
        raise ValueError("a line of one null is no row to a reader: two columns at least")
    quoted = lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", *[F.coalesce(quoted(F.col(c).cast("string")), F.lit("")) for c in df.columns])
    head = F.concat_ws(",", *[quoted(F.lit(c)) for c in df.columns])
    first = F.monotonically_increasing_id() % (1 << 33) == 0  # a task's first row, and a task writes a file
    df.select(F.concat(F.when(first, F.concat(head, F.lit("\n"))).otherwise(F.lit("")), line).alias("value")).write.option("maxRecordsPerFile", 0).text(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line): lines of text files, numbered from 0 through all of them in the order of their names.

    Files are read in blocks, and a block's lines are numbered where they are; what one task
    adds up is the number of lines of each block.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    raw = spark.read.option("lineSep", "\n").text(path).select(*place, F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    raw = written(raw, "lines")  # so that the numbers are those of one reading
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    blocks = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # The ids of a task are in a row.
    return raw.join(blocks, ["file", "block"]).select((F.col("base") + F.col("at") - F.col("first")).alias("pos"), "line")


def parallel_text(spark: SparkSession, source: str, target: str) -> DataFrame:
    """(pos, source, target) of two files, or folders of them, line by line, as far as both go."""
    side = lambda path, name: numbered_lines(spark, path).select("pos", F.btrim("line", F.lit("\n ")).alias(name))
    return side(source, "source").join(side(target, "target"), "pos")


def article_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, lines): text files of a sentence a line without blank lines and those that begin with '=' as they stand."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", "\n", -1).alias("lines"))
    kept = F.filter("lines", lambda x: (F.btrim(x) != "") & ~F.startswith(x, F.lit("=")))
    return raw.select("path", F.transform(kept, lambda x: F.btrim(x, F.lit("\n\t "))).alias("lines"))


def keyword_lines(spark: SparkSession, path: str) -> DataFrame:
    """(abstract, keywords): JSON lines whose keyword field is separated by semicolons."""
    return spark.read.schema("abstract string, keyword string").json(path).select("abstract", F.split("keyword", ";").alias("keywords"))


def sections(articles: DataFrame, *, article: str = "article") -> DataFrame:
    """A row for each (section_name, document, summary) of an article's three arrays; arrays of other lengths are an error."""
    a = F.col(article)
    same = (F.size(a["section_name"]) == F.size(a["document"])) & (F.size(a["document"]) == F.size(a["summary"]))
    zipped = F.when(same, F.arrays_zip(a["section_name"].alias("section_name"), a["document"].alias("document"), a["summary"].alias("summary"))).otherwise(F.raise_error(F.lit("an article's arrays differ in length")))
    rest = [c for c in articles.columns if c != article]
    return articles.select(*rest, F.posexplode(zipped).alias("section", "s")).select(*rest, "section", "s.*")


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, one object a row: a file can be split among readers, as one array can't."""
    df.write.json(path)


def single_document_names(df: DataFrame, *, order: str, text: str) -> DataFrame:
    """(name, text): zero-padded file names by position. Writing a file a row is left to the caller: few systems bear it."""
    rows = in_order(df.select(F.col(order).alias("order"), F.col(text).alias("text")), "order", name="names")
    digits = F.greatest(F.lit(6), F.length(F.col("pos").cast("string")))
    return rows.select(F.concat(F.lpad(F.col("pos").cast("string"), digits, F.lit("0")), F.lit(".txt")).alias("name"), "text")
