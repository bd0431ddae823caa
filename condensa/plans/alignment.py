"""Queries of alignment: assistants' answers to users' turns, and embeddings to embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import sentences
from ..operators import alignment as A
from ..operators import statistics as T
from .registry import SQL_SENTENCES, SQL_TURNS, query, sql_grams, table, turn_pairs


def _sided(spark, sf):
    """Both sides of all turns as sentences. Where one has none, nothing is aligned."""
    return turn_pairs(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), sentences("summary").alias("summary"), sentences("reference").alias("source"))


def _sql(attribute: str, exact: bool) -> str:
    """CTEs up to best(id, tpos, spos, metric, n): n source sentences in the document."""
    score = {"recall": "hits / greatest(tn, 1)", "precision": "hits / greatest(sn, 1)", "fmeasure": "2.0 * hits / (tn + sn)"}[attribute]
    first = "coalesce(e.spos, m.spos, 0)" if exact else "coalesce(m.spos, 0)"
    value = "CASE WHEN e.spos IS NOT NULL THEN 1.0 ELSE coalesce(m.score, 0) END" if exact else "coalesce(m.score, 0)"
    return f"""WITH {SQL_TURNS}, k AS (SELECT conv_id * 1000 + turn AS id, {SQL_SENTENCES('summary')} AS ts, {SQL_SENTENCES('reference')} AS ss FROM turns),
 t AS (SELECT id, unnest(range(len(ts))) AS tpos, unnest(ts) AS s FROM k WHERE len(ss) > 0), c AS (SELECT id, unnest(range(len(ss))) AS spos, unnest(ss) AS s, len(ss) AS n FROM k WHERE len(ts) > 0),
 tg AS ({sql_grams('t', 'id, tpos', 's', 2)}), cg AS ({sql_grams('c', 'id, spos', 's', 2)}),
 tn AS (SELECT id, tpos, sum(c) AS tn FROM tg GROUP BY ALL), cn AS (SELECT id, spos, sum(c) AS sn FROM cg GROUP BY ALL),
 h AS (SELECT id, tpos, spos, sum(least(tg.c, cg.c))::DOUBLE AS hits FROM tg JOIN cg USING (id, gram) GROUP BY ALL),
 sc AS (SELECT id, tpos, spos, {score} AS score FROM h JOIN tn USING (id, tpos) JOIN cn USING (id, spos)),
 m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, tpos ORDER BY score DESC, spos) AS k FROM sc) q WHERE k = 1),
 e AS (SELECT t.id, tpos, min(c.spos) AS spos FROM t JOIN c ON c.id = t.id AND c.s = t.s GROUP BY ALL), n AS (SELECT id, max(n) AS n FROM c GROUP BY id),
 best AS (SELECT t.id, t.tpos, {first} AS spos, round({value}, 6) AS metric, n FROM t JOIN n USING (id) LEFT JOIN m ON m.id = t.id AND m.tpos = t.tpos LEFT JOIN e ON e.id = t.id AND e.tpos = t.tpos)"""


_OUT = " SELECT id, tpos::INT AS summary_pos, spos::INT AS source_pos, metric, round(spos / greatest(n - 1, 1), 6) AS relative_position FROM best"


def _rows(spark, sf, match, **options):
    found = _sided(spark, sf).select("id", F.inline(match(F.col("summary"), F.col("source"), **options)))
    return found.select("id", "summary_pos", "source_pos", F.round("metric", 6).alias("metric"), F.round("relative_position", 6).alias("relative_position"))


@query(_sql("recall", False) + _OUT)
def max_rouge_n_match(spark, sf):
    return _rows(spark, sf, A.rouge_matches, attribute="recall")


@query(_sql("fmeasure", True) + _OUT)
def find_closest_reference_matches(spark, sf):
    return _rows(spark, sf, A.closest_matches)


@query(_sql("precision", False) + _OUT)
def rouge_n_aligner(spark, sf):
    return _rows(spark, sf, A.rouge_matches, attribute="precision")


@query(_sql("fmeasure", False) + " SELECT id, summary_pos::INT AS summary_pos, rank::BIGINT AS rank FROM (SELECT id, tpos AS summary_pos, row_number() OVER (PARTITION BY id ORDER BY spos / greatest(n - 1, 1), tpos) - 1 AS rank FROM best) q")
def print_relevant_sentences(spark, sf):
    found = _sided(spark, sf).select("id", F.posexplode(A.in_source_order(A.rouge_matches(F.col("summary"), F.col("source"), attribute="fmeasure"))).alias("rank", "m"))
    return found.select("id", "m.summary_pos", F.col("rank").cast("long").alias("rank"))


@query()
def greedy_aligner(spark, sf):
    return _sided(spark, sf).select("id", A.greedy_matches(F.col("summary"), F.col("source")).alias("chosen"))


_COS = "list_dot_product(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)) / (sqrt(list_dot_product(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(a.embedding, lambda x: x::DOUBLE))) * sqrt(list_dot_product(list_transform(b.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE))))"


@query(f"""WITH v AS (SELECT *, vec_id // 20 AS doc FROM embeddings), n AS (SELECT doc, count(*) AS n FROM v WHERE vec_id % 20 >= 5 GROUP BY doc),
 p AS (SELECT a.doc, a.vec_id AS x, b.vec_id AS y, round({_COS}, 9) AS metric FROM v a JOIN v b ON a.doc = b.doc AND a.vec_id % 20 < 5 AND b.vec_id % 20 >= 5),
 k AS (SELECT *, row_number() OVER (PARTITION BY doc, x ORDER BY metric DESC, y) AS k FROM p)
 SELECT doc, (x % 20)::INT AS summary_pos, (y % 20 - 5)::INT AS source_pos, round(metric, 6) AS metric, round((y % 20 - 5) / n, 6) AS relative_position FROM k JOIN n USING (doc) WHERE k = 1""")
def sentence_transformer_aligner(spark, sf):
    """Twenty vectors in a row are a document: five of its summary, fifteen of its source."""
    own = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("doc"), (F.col("vec_id") % 20).alias("pos"), "embedding")
    found = A.vector_matches(own.where("pos < 5"), own.where("pos >= 5").withColumn("pos", F.col("pos") - 5), doc="doc", pos="pos", vector="embedding")
    return found.withColumns({"metric": F.round("metric", 6), "relative_position": F.round("relative_position", 6)})


@query(_sql("fmeasure", True) + ", w AS (SELECT least(100, max(n)) AS bins FROM best), p AS (SELECT least(floor(round(spos / greatest(n - 1, 1), 6) * bins), bins - 1)::BIGINT AS bin FROM best, w) SELECT bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM p GROUP BY bin")
def density_histogram(spark, sf):
    own = _sided(spark, sf)
    bins = own.agg(F.least(F.lit(100), F.max(F.when((F.size("summary") > 0) & (F.size("source") > 0), F.size("source")))).alias("bins"))
    found = own.select(F.explode(A.closest_matches(F.col("summary"), F.col("source"))).alias("m")).select(F.round("m.relative_position", 6).alias("relative_position"))
    return T.position_histogram(found.crossJoin(F.broadcast(bins)), F.col("bins"))
