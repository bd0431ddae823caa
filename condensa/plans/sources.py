"""Queries of readers and writers: a table is written in the reader's format to the shared folder and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cleaning import Cleaner
from ..sources import readers as R
from ..sources.readers import split_by
from ..storage import new_dir
from .registry import SQL_PAIRS, SQL_TURNS, Query, document_pairs, documents, query, table, turn_pairs


@query(f"WITH {SQL_PAIRS} SELECT split, row_id, md5(reference) AS reference FROM pairs")
def scan_hf(spark, sf):
    return document_pairs(spark, sf).select("split", "row_id", F.md5("reference").alias("reference"))


@query("SELECT doc_id, md5(text) AS text FROM documents WHERE lang = 'de'")
def scan_jsonl_lang(spark, sf):
    path = new_dir(spark, "jsonl")
    documents(spark, sf).select("doc_id", F.col("lang").alias("language"), "text").write.json(path)
    return R.jsonl_of_language(spark, path, "doc_id long, language string, text string", "de").select("doc_id", F.md5("text").alias("text"))


_PART = "CASE item_id % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END"


def _items(spark, sf):
    part = F.when(F.col("item_id") % 4 == 0, "test").when(F.col("item_id") % 4 == 1, "validation").otherwise("train")
    return table(spark, sf, "benchmark").select("item_id", "text", part.alias("split"))


@query(f"SELECT {_PART} AS split, md5(text) AS reference, md5(lower(text)) AS summary FROM benchmark")
def scan_json_nested(spark, sf):
    path = new_dir(spark, "nested")
    sample = F.struct(F.col("text").alias("reference_text"), F.lower("text").alias("summary_text"))
    one = _items(spark, sf).groupBy("split").agg(F.map_from_entries(F.collect_list(F.struct(F.col("item_id").cast("string"), sample))).alias("m"))
    whole = one.agg(F.map_from_entries(F.collect_list(F.struct("split", "m"))).alias("m"))  # such a file is one document
    whole.select(F.to_json("m").alias("value")).coalesce(1).write.text(path)
    rows = R.nested_json(spark, path, "reference_text string, summary_text string")
    return rows.select("split", F.md5("reference_text").alias("reference"), F.md5("summary_text").alias("summary"))


@query("SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' WHEN 2 THEN 'train' ELSE 'unused' END AS split, md5(text) AS text FROM benchmark")
def scan_json_dir_split(spark, sf):
    """A file an item; three lists of file names, and items of none."""
    folder = new_dir(spark, "folder")
    items = table(spark, sf, "benchmark").select("item_id", "text")
    n = items.count()
    items.withColumn("k", F.col("item_id").cast("int") % n).repartitionById(n, "k").drop("k").write.json(folder)
    schema, lists = "item_id long, text string", {}
    named = spark.read.schema(schema).json(folder).select("item_id", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("value"))
    for k, split in ((2, "train"), (1, "validation"), (0, "test")):
        lists[split] = new_dir(spark, "list")
        named.where(F.col("item_id") % 4 == k).select("value").write.text(lists[split])
    found, unused = R.json_folder(spark, folder, schema, lists)
    both = found.select("item_id", "split", "text").unionByName(unused.select("item_id", F.lit("unused").alias("split"), "text"))
    return both.withColumn("text", F.md5("text"))


@query("SELECT doc_id, md5(text) AS text, md5(source) AS source FROM documents")
def scan_csv(spark, sf):
    path = new_dir(spark, "csv")
    R.write_csv(documents(spark, sf).select("doc_id", "text", "source"), path)
    return R.csv_pairs(spark, path, "doc_id long, text string, source string").select("doc_id", F.md5("text").alias("text"), F.md5("source").alias("source"))


@query("SELECT (row_number() OVER (ORDER BY item_id) - 1)::INT AS pos, md5(trim(replace(text, E'\\n', ' '), E'\\n ')) AS source, md5(trim(lower(replace(text, E'\\n', ' ')), E'\\n ')) AS target FROM benchmark")
def scan_parallel_text(spark, sf):
    line = F.replace("text", F.lit("\n"), F.lit(" "))
    paths = []
    for col in (line, F.lower(line)):
        paths.append(new_dir(spark, "parallel"))
        table(spark, sf, "benchmark").orderBy("item_id").select(col.alias("value")).coalesce(1).write.text(paths[-1])
    return R.parallel_text(spark, *paths).select("pos", F.md5("source").alias("source"), F.md5("target").alias("target"))


@query("SELECT md5(array_to_string(list_transform(list_filter(string_split(text, E'\\n'), lambda x: trim(x, ' ') <> '' AND NOT starts_with(x, '=')), lambda x: trim(x, E'\\n\\t ')), '|')) AS lines, count(*) AS n FROM (SELECT CASE WHEN item_id % 5 = 0 THEN E'= Head\\n\\n' || text ELSE text END AS text FROM benchmark) q GROUP BY 1")
def scan_text_lines(spark, sf):
    folder = new_dir(spark, "articles")
    items = table(spark, sf, "benchmark").select("item_id", F.when(F.col("item_id") % 5 == 0, F.concat(F.lit("= Head\n\n"), "text")).otherwise(F.col("text")).alias("value"))
    n = items.count()
    items.withColumn("k", F.col("item_id").cast("int") % n).repartitionById(n, "k").select("value").write.text(folder)
    return R.article_lines(spark, folder).groupBy(F.md5(F.array_join("lines", "|")).alias("lines")).agg(F.count("*").alias("n"))


@query("SELECT md5(text) AS abstract, len(string_split(replace(text, ' ', ';'), ';'))::BIGINT AS n_keywords, string_split(text, ' ')[1] AS first FROM benchmark")
def scan_keyword_lines(spark, sf):
    path = new_dir(spark, "keywords")
    table(spark, sf, "benchmark").select(F.col("text").alias("abstract"), F.replace("text", F.lit(" "), F.lit(";")).alias("keyword")).write.json(path)
    return R.keyword_lines(spark, path).select(F.md5("abstract").alias("abstract"), F.size("keywords").cast("long").alias("n_keywords"), F.col("keywords")[0].alias("first"))


@query(f"WITH {SQL_PAIRS} SELECT row_id, md5(summary) AS summary FROM pairs")
def sink_json_array(spark, sf):
    path = new_dir(spark, "json")
    R.write_json(document_pairs(spark, sf).select("row_id", "summary"), path)
    return spark.read.schema("row_id long, summary string").json(path).select("row_id", F.md5("summary").alias("summary"))


@query("SELECT lpad((row_number() OVER (ORDER BY item_id) - 1)::VARCHAR, 6, '0') || '.txt' AS name, md5(text) AS text FROM benchmark")
def sink_single_docs(spark, sf):
    return R.single_document_names(table(spark, sf, "benchmark"), order="item_id", text="text").withColumn("text", F.md5("text"))


@query("WITH l AS (SELECT lang, length(text) AS len FROM documents) SELECT lang, least(floor(len * 50 / 20000), 49)::BIGINT AS bin, count(*) AS n FROM l WHERE len IS NOT NULL GROUP BY ALL")
def sink_plot(spark, sf):
    """What a plot of lengths is drawn from; texts of more than 20,000 signs are in the last bin. Drawing is left to whoever has a plotting library."""
    from ..functions.text import length_of
    from ..operators.statistics import fixed_histogram

    return fixed_histogram(documents(spark, sf).select("lang", length_of("text").alias("len")), "len", 0, 20_000, 50, ("lang",), clamp=True)


#: Loaders by name; each gives pairs with their splits.
DATASETS: dict[str, Query] = {
    "documents": document_pairs,
    "turns": lambda spark, sf: split_by(turn_pairs(spark, sf).withColumn("id", F.col("conv_id") * 1000 + F.col("turn")), F.lit("train"), row_id="id"),
}
#: Cleaners by name; 'none' leaves a corpus as it is.
FILTERS: dict[str, Cleaner | None] = {"none": None, "short": Cleaner(min_length_summary=20, min_length_reference=50, min_compression_ratio=1.25, dedup="none"), "default": Cleaner(min_length_summary=20, min_length_reference=50, min_compression_ratio=1.25)}


def load(spark, sf: str, name: str, filtered: str = "none") -> DataFrame:
    """A corpus by name, cleaned by the filter of a name. Unknown names are errors."""
    if name not in DATASETS or filtered not in FILTERS:
        raise ValueError(f"one of {sorted(DATASETS)}, filtered by one of {sorted(FILTERS)}")
    pairs, cleaner = DATASETS[name](spark, sf), FILTERS[filtered]
    return pairs if cleaner is None else cleaner.clean(pairs)


@query(f"""WITH {SQL_PAIRS}, {SQL_TURNS}, every AS (SELECT 'documents' AS name, split, reference, summary FROM pairs UNION ALL SELECT 'turns', 'train', reference, summary FROM turns),
 kept AS (SELECT *, length(reference) >= 50 AND length(summary) >= 20 AND reference <> summary AND length(reference) / length(summary) >= 1.25 AS short FROM every)
 SELECT name, 'none' AS filtered, split, count(*) AS n FROM kept GROUP BY ALL UNION ALL SELECT name, 'short', split, count(*) FROM kept WHERE short GROUP BY ALL""")
def get_dataset(spark, sf):
    """Rows of every corpus as it is and filtered."""
    counts = [load(spark, sf, name, f).groupBy(F.lit(name).alias("name"), F.lit(f).alias("filtered"), "split").agg(F.count("*").alias("n")) for name in DATASETS for f in ("none", "short")]
    return reduce(DataFrame.unionByName, counts)
