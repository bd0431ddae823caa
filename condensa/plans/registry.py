"""Named queries and the SQL that states the same; the tables they take their pairs from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import first_sentence
from ..sources.readers import split_by
from ..storage import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its first sentence as its summary, in three splits by its id."""
    own = documents(spark, sf_dir).select("doc_id", F.col("text").alias("reference"), first_sentence("text").alias("summary"))
    part = F.col("doc_id") % 10
    return split_by(own, F.when(part == 0, "test").when(part == 1, "validation").otherwise("train"), row_id="doc_id")


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's turn with the assistant's answer to it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lead("text").over(w).alias("summary"), F.lead("role").over(w).alias("next"))
    return turns.where("role = 'user' AND next = 'assistant'").select("conv_id", "turn", F.col("text").alias("reference"), "summary")


#: The same in SQL, for lists of tokens and sentences of a column, and the two tables of pairs.
SQL_TOKENS = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]')".format
SQL_WORDS = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+')".format
SQL_SENTENCES = r"list_filter(list_transform(regexp_extract_all({0}, '[^.!?]+[.!?]*'), lambda x: trim(x, E'\n\t ')), lambda x: x <> '')".format
SQL_PAIRS = f"""pairs AS (SELECT doc_id, doc_id AS row_id, text AS reference, coalesce({SQL_SENTENCES('text')}[1], '') AS summary,
 CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split, CASE doc_id % 10 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS split_order FROM documents)"""
SQL_TURNS = """turns AS (SELECT conv_id, turn, text AS reference, nxt AS summary FROM (
 SELECT *, lead(text) OVER w AS nxt, lead(role) OVER w AS nrole FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) q WHERE role = 'user' AND nrole = 'assistant')"""


def sql_grams(source: str, key: str, text: str, n: int, lower: bool = False) -> str:
    """A query of (key, gram, c) for the n-grams of a text column."""
    tokens = SQL_TOKENS(f"lower({text})" if lower else text)
    gram = " || ' ' || ".join(f"t[i + {k}]" for k in range(n))
    return f"SELECT {key}, gram, count(*) AS c FROM (SELECT {key}, {gram} AS gram FROM (SELECT {key}, t, unnest(range(1, len(t) - {n - 2})) AS i FROM (SELECT {key}, {tokens} AS t FROM {source}) a) b) d GROUP BY ALL"


def sql_overlap(source: str, key: str, n: int) -> str:
    """CTEs s, r and o(key, hits, ns, nr) of a table with summary and reference."""
    return f"""s AS ({sql_grams(source, key, 'summary', n)}), r AS ({sql_grams(source, key, 'reference', n)}),
 h AS (SELECT {key}, sum(least(s.c, r.c)) AS hits FROM s JOIN r USING ({key}, gram) GROUP BY {key}),
 ns AS (SELECT {key}, sum(c) AS ns FROM s GROUP BY {key}), nr AS (SELECT {key}, sum(c) AS nr FROM r GROUP BY {key}),
 o AS (SELECT {key}, coalesce(hits, 0)::DOUBLE AS hits, greatest(coalesce(ns, 0), 1)::DOUBLE AS ns, greatest(coalesce(nr, 0), 1)::DOUBLE AS nr FROM (SELECT {key} FROM {source}) k LEFT JOIN h USING ({key}) LEFT JOIN ns USING ({key}) LEFT JOIN nr USING ({key}))"""


#: CTEs of a recursive query up to lcs(id, v, na, nb): the table of lengths row by row, of a table keyed(id, summary, reference).
SQL_LCS = f"""kt AS (SELECT id, {SQL_TOKENS('summary')} AS a, {SQL_TOKENS('reference')} AS b FROM keyed),
 ta AS (SELECT id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS t FROM kt), tb AS (SELECT id, unnest(range(1, len(b) + 1)) AS j, unnest(b) AS t FROM kt),
 dp(id, i, j, v) AS (SELECT id, 0::BIGINT, j, 0::BIGINT FROM tb UNION ALL
  SELECT id, i, j, max(c) OVER (PARTITION BY id ORDER BY j) FROM (
   SELECT d.id, d.i + 1 AS i, d.j, greatest(d.v, CASE WHEN tb.t = ta.t THEN coalesce(lag(d.v) OVER (PARTITION BY d.id ORDER BY d.j), 0) + 1 ELSE 0 END) AS c
   FROM dp d JOIN ta ON ta.id = d.id AND ta.i = d.i + 1 JOIN tb ON tb.id = d.id AND tb.j = d.j) q),
 lcs AS (SELECT kt.id, coalesce(max(v), 0)::BIGINT AS v, len(any_value(a))::BIGINT AS na, len(any_value(b))::BIGINT AS nb FROM kt LEFT JOIN dp ON dp.id = kt.id GROUP BY kt.id)"""
