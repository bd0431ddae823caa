"""Queries of cleaning, duplicates and leaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import leakage as L
from ..operators.cleaning import REASONS, Cleaner, breakdown, share_kept, valid_samples as report
from .registry import SQL_LCS, SQL_PAIRS, SQL_TURNS, document_pairs, query, sql_overlap, turn_pairs


def _sql_clean(order: str = "-split_order", ref: int = 50, summ: int = 20, ratio: float = 1.25, extractive: str = "FALSE") -> str:
    """CTEs up to told(split, row_id, reason): the cascade, then a scan of the rows that are left in order."""
    return f"""WITH RECURSIVE {SQL_PAIRS}, base AS (SELECT *, CASE WHEN length(reference) < {ref} THEN 'reference_too_short' WHEN length(summary) < {summ} THEN 'summary_too_short'
  WHEN reference = summary THEN 'identity_sample' WHEN length(summary) = 0 OR length(reference) / length(summary) < {ratio} THEN 'compression_ratio' WHEN {extractive} THEN 'extractiveness' END AS reason FROM pairs),
 o AS (SELECT row_number() OVER (ORDER BY {order}, row_id) AS i, split, row_id, md5(reference) AS r, md5(summary) AS s FROM base WHERE reason IS NULL),
 scan(i, split, row_id, reason, rs, ss, ps) AS (
  SELECT 0::BIGINT, ''::VARCHAR, 0::BIGINT, ''::VARCHAR, []::VARCHAR[], []::VARCHAR[], []::VARCHAR[]
  UNION ALL
  SELECT i, split, row_id, reason, CASE WHEN reason IS NULL THEN list_append(rs, r) ELSE rs END, CASE WHEN reason IS NULL THEN list_append(ss, s) ELSE ss END, CASE WHEN reason IS NULL THEN list_append(ps, r || s) ELSE ps END
  FROM (SELECT o.i, o.split, o.row_id, o.r, o.s, rs, ss, ps, CASE WHEN list_contains(ps, o.r || o.s) THEN 'exact_duplicate' WHEN list_contains(rs, o.r) AND list_contains(ss, o.s) THEN 'both_duplicate'
    WHEN list_contains(rs, o.r) THEN 'reference_duplicate' WHEN list_contains(ss, o.s) THEN 'summary_duplicate' END AS reason FROM scan JOIN o ON o.i = scan.i + 1) x),
 told AS (SELECT split, row_id, reason FROM scan WHERE i > 0 UNION ALL SELECT split, row_id, reason FROM base WHERE reason IS NOT NULL)"""


_PRESET = {"min_length_summary": 20, "min_length_reference": 50, "min_compression_ratio": 1.25}


@query(_sql_clean() + " SELECT split, row_id, coalesce(reason, '') AS reason FROM told")
def clean_dataset(spark, sf):
    return Cleaner(**_PRESET).reasons(document_pairs(spark, sf)).select("split", "row_id", F.coalesce("reason", F.lit("")).alias("reason"))


@query(_sql_clean("split_order") + " SELECT split, row_id, coalesce(reason, '') AS reason FROM told")
def clean_dataset_first(spark, sf):
    return Cleaner(**_PRESET, dedup="first").reasons(document_pairs(spark, sf)).select("split", "row_id", F.coalesce("reason", F.lit("")).alias("reason"))


@query(_sql_clean().split(",\n o AS")[0].replace("WITH RECURSIVE", "WITH") + " SELECT split, row_id, coalesce(reason, '') AS reason FROM base")
def clean_dataset_none(spark, sf):
    return Cleaner(**_PRESET, dedup="none").reasons(document_pairs(spark, sf)).select("split", "row_id", F.coalesce("reason", F.lit("")).alias("reason"))


@query(_sql_clean(extractive="contains(reference, summary)").split(",\n o AS")[0].replace("WITH RECURSIVE", "WITH") + " SELECT split, row_id, coalesce(reason, '') AS reason FROM base")
def clean_dataset_fully_extractive(spark, sf):
    return Cleaner(**_PRESET, dedup="none", extractiveness="fully").reasons(document_pairs(spark, sf)).select("split", "row_id", F.coalesce("reason", F.lit("")).alias("reason"))


@query(f"""WITH {SQL_TURNS}, keyed AS (SELECT conv_id * 1000 + turn AS id, * FROM turns), {sql_overlap('keyed', 'id', 2)}
 SELECT id, CASE WHEN reference = summary THEN 'identity_sample' WHEN length(summary) = 0 OR length(reference) / length(summary) < 0.2 THEN 'compression_ratio' WHEN hits / ns < 0.01 OR hits / ns > 0.9 THEN 'extractiveness' ELSE '' END AS reason FROM keyed JOIN o USING (id)""")
def clean_dataset_extractiveness_range(spark, sf):
    pairs = turn_pairs(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), F.lit(0).alias("split_order"), "reference", "summary")
    told = Cleaner(min_compression_ratio=0.2, dedup="none", extractiveness=(0.01, 0.9)).reasons(pairs)
    return told.select(F.col("row_id").alias("id"), F.coalesce("reason", F.lit("")).alias("reason"))


_REASON_ROWS = ", ".join(f"('{r}')" for r in REASONS)


@query(_sql_clean() + f" SELECT v.reason, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test FROM (VALUES {_REASON_ROWS}) v(reason) LEFT JOIN told USING (reason) GROUP BY v.reason")
def filter_breakdown(spark, sf):
    return breakdown(Cleaner(**_PRESET).reasons(document_pairs(spark, sf)))


@query(_sql_clean() + " SELECT split, count(*) AS n_input, count(*) FILTER (reason IS NULL) AS n_kept, round(100.0 * count(*) FILTER (reason IS NULL) / count(*), 2)::DOUBLE AS percent, split || ' & ' || count(*) FILTER (reason IS NULL) || ' \\\\' AS latex FROM told GROUP BY split")
def latex_row(spark, sf):
    return share_kept(Cleaner(**_PRESET).reasons(document_pairs(spark, sf)))


@query(f"""WITH RECURSIVE {SQL_TURNS}, keyed AS (SELECT conv_id * 1000 + turn AS id, * FROM turns), {SQL_LCS},
 t AS (SELECT contains(reference, summary) AS e, length(reference) <= length(summary) AS l, trim(summary, E'\\n\\t ') = '' OR trim(reference, E'\\n\\t ') = '' AS m, round(v / greatest(na, 1), 6) AS share FROM keyed JOIN lcs USING (id))
 SELECT count(*) AS n, count(*) FILTER (e) AS extractive, count(*) FILTER (l) AS longer, count(*) FILTER (m) AS empty, count(*) FILTER (e AND l) + count(*) FILTER (e AND m) AS several,
 round(quantile_cont(share, 0.5) FILTER (NOT e), 6) AS lcs_median, round(quantile_cont(share, 0.9) FILTER (NOT e), 6) AS lcs_p90 FROM t""")
def valid_samples(spark, sf):
    return report(turn_pairs(spark, sf))


_SIDES = f"WITH {SQL_PAIRS}, sides AS (SELECT split, split_order, 'reference' AS side, reference AS t FROM pairs UNION ALL SELECT split, split_order, 'summary', summary FROM pairs)"
_WITHIN = "SELECT split, side, t, count(*) AS n FROM sides GROUP BY ALL HAVING count(*) > 1"
_BETWEEN = "SELECT a.side, a.split AS first_split, b.split AS second_split, a.t FROM (SELECT DISTINCT * FROM sides) a JOIN (SELECT DISTINCT * FROM sides) b ON a.side = b.side AND a.t = b.t AND a.split_order < b.split_order"


@query(f"{_SIDES} SELECT split, side, md5(t) AS text, n FROM ({_WITHIN}) w")
def detect_intra_duplicates(spark, sf):
    return L.repeated_texts(document_pairs(spark, sf)).withColumn("text", F.md5("text"))


@query(f"{_SIDES} SELECT side, first_split, second_split, md5(t) AS text FROM ({_BETWEEN}) b")
def detect_leakage(spark, sf):
    return L.leaked_texts(document_pairs(spark, sf)).withColumn("text", F.md5("text"))


_REPORT = f"SELECT 'within' AS kind, side, split AS first_split, split AS second_split, count(*) AS n FROM ({_WITHIN}) w GROUP BY ALL UNION ALL SELECT 'between', side, first_split, second_split, count(*) FROM ({_BETWEEN}) b GROUP BY ALL"


@query(f"{_SIDES} {_REPORT}")
def detect_duplicates(spark, sf):
    return L.duplicate_report(document_pairs(spark, sf))


@query(f"{_SIDES} SELECT 'duplicates' AS operation, kind || ':' || side || ':' || first_split || ':' || second_split AS item, n FROM ({_REPORT}) r UNION ALL SELECT 'extractive', split, count(*) FILTER (contains(reference, summary)) FROM pairs GROUP BY split UNION ALL SELECT 'longer', split, count(*) FILTER (length(reference) <= length(summary)) FROM pairs GROUP BY split")
def analyze_dataset(spark, sf):
    """Duplicates and issues of every split, as rows of (operation, item, n)."""
    from ..functions.pairs import is_fully_extractive, is_summary_longer

    pairs = document_pairs(spark, sf)
    found = L.duplicate_report(pairs).select(F.lit("duplicates").alias("operation"), F.concat_ws(":", "kind", "side", "first_split", "second_split").alias("item"), "n")
    issues = pairs.groupBy("split").agg(F.count_if(is_fully_extractive("summary", "reference")).alias("extractive"), F.count_if(is_summary_longer("summary", "reference")).alias("longer"))
    return found.unionByName(issues.select(F.inline(F.array(*[F.struct(F.lit(c).alias("operation"), F.col("split").alias("item"), F.col(c).alias("n")) for c in ("extractive", "longer")]))))
