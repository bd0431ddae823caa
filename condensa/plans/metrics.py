"""Queries of pair measures, lengths and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pairs as P
from ..functions.stem import rouge_scores
from ..functions.text import index_tokens, length_of
from ..operators import significance as S
from ..operators import statistics as T
from ..operators.retrieval import keyphrases
from ..storage import in_order
from .registry import SQL_LCS, SQL_PAIRS, SQL_TOKENS, SQL_TURNS, document_pairs, documents, query, sql_overlap, table, turn_pairs

_KEYED = "keyed AS (SELECT conv_id * 1000 + turn AS id, * FROM turns)"


def _keyed(spark, sf):
    return turn_pairs(spark, sf).withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))


@query(f"WITH {SQL_PAIRS} SELECT row_id, contains(reference, summary) AS extractive FROM pairs")
def is_fully_extractive(spark, sf):
    return document_pairs(spark, sf).select("row_id", P.is_fully_extractive("summary", "reference").alias("extractive"))


@query(f"WITH {SQL_TURNS} SELECT conv_id, turn, round(length(reference) / nullif(length(summary), 0), 6) AS ratio FROM turns")
def compression_ratio(spark, sf):
    return turn_pairs(spark, sf).select("conv_id", "turn", F.round(P.compression_ratio("summary", "reference", strict=False), 6).alias("ratio"))


@query(f"WITH {SQL_TURNS} SELECT conv_id, turn, length(reference) <= length(summary) AS longer FROM turns")
def is_summary_longer(spark, sf):
    return turn_pairs(spark, sf).select("conv_id", "turn", P.is_summary_longer("summary", "reference").alias("longer"))


@query("SELECT doc_id, length(text) < 500 AS short_char, len(string_split(text, ' ')) < 80 AS short_words FROM documents")
def is_text_too_short(spark, sf):
    return documents(spark, sf).select("doc_id", P.is_too_short("text", 500).alias("short_char"), P.is_too_short("text", 80, "whitespace").alias("short_words"))


@query(f"WITH {SQL_PAIRS} SELECT row_id, trim(summary, E'\\n\\t ') = '' OR trim(reference, E'\\n\\t ') = '' AS empty FROM pairs")
def is_either_empty(spark, sf):
    return document_pairs(spark, sf).select("row_id", P.is_either_empty("summary", "reference").alias("empty"))


@query(f"WITH {SQL_PAIRS} SELECT row_id, summary = reference AS identity FROM pairs")
def is_identity(spark, sf):
    return document_pairs(spark, sf).select("row_id", P.is_identity("summary", "reference").alias("identity"))


@query(f"WITH {SQL_TURNS}, {_KEYED}, {sql_overlap('keyed', 'id', 2)} SELECT id, round(hits / ns, 6) AS share FROM o")
def ngram_overlap_fraction(spark, sf):
    return _keyed(spark, sf).select("id", F.round(P.overlap_fraction(P.gram_overlap("summary", "reference")), 6).alias("share"))


@query(f"WITH {SQL_TURNS}, {_KEYED}, {sql_overlap('keyed', 'id', 2)} SELECT id, round(1 - hits / ns, 6) AS share FROM o")
def novel_ngrams_fraction(spark, sf):
    return _keyed(spark, sf).select("id", F.round(P.novel_fraction(P.gram_overlap("summary", "reference")), 6).alias("share"))


def _sql_rouge(n: int) -> str:
    return f"WITH {SQL_TURNS}, {_KEYED}, {sql_overlap('keyed', 'id', n)} SELECT id, round(hits / ns, 6) AS precision, round(hits / nr, 6) AS recall, round(CASE WHEN hits > 0 THEN 2 * (hits / ns) * (hits / nr) / (hits / ns + hits / nr) ELSE 0 END, 6) AS fmeasure FROM o"


def _rouge(spark, sf, n: int):
    scored = _keyed(spark, sf).select("id", P.rouge(P.gram_overlap("summary", "reference", n)).alias("r"))
    return scored.select("id", *[F.round(f"r.{x}", 6).alias(x) for x in ("precision", "recall", "fmeasure")])


@query(_sql_rouge(1))
def rouge_1_score(spark, sf):
    return _rouge(spark, sf, 1)


@query(_sql_rouge(2))
def rouge_n_score(spark, sf):
    return _rouge(spark, sf, 2)


@query(f"WITH RECURSIVE {SQL_TURNS}, {_KEYED}, {SQL_LCS} SELECT id, round(v / greatest(na, 1), 6) AS share FROM lcs")
def lcs_overlap_fraction(spark, sf):
    return _keyed(spark, sf).select("id", F.round(P.lcs_fraction(P.lcs("summary", "reference")), 6).alias("share"))


@query(f"WITH RECURSIVE {SQL_TURNS}, {_KEYED}, {SQL_LCS} SELECT id, v AS lcs, (na + 1) * (nb + 1) AS cells FROM lcs")
def lcs_table(spark, sf):
    """The length that stands in the table's corner, and the table's size."""
    found = _keyed(spark, sf).select("id", P.lcs("summary", "reference").alias("f"))
    return found.select("id", "f.lcs", ((F.col("f.n_summary") + 1) * (F.col("f.n_reference") + 1)).alias("cells"))


@query(f"SELECT doc_id, gram, (count(*) - 1)::BIGINT AS again FROM (SELECT doc_id, t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] AS gram FROM (SELECT doc_id, t, unnest(range(1, len(t) - 1)) AS i FROM (SELECT doc_id, {SQL_TOKENS('text')} AS t FROM documents) a) b) c GROUP BY doc_id, gram HAVING count(*) > 1")
def count_ngram_repetitions(spark, sf):
    return documents(spark, sf).select("doc_id", F.inline(P.gram_repetitions("text", 3)))


@query()
def rouge_corpus(spark, sf):
    """Means of nine scores over all pairs, and how many there are."""
    from ..functions.stem import _FIELDS

    scored = turn_pairs(spark, sf).select(rouge_scores("summary", "reference").alias("r")).select("r.*")
    return scored.agg(*[F.round(F.avg(f), 6).alias(f) for f in _FIELDS], F.count("*").alias("n"))


_DRAW = "('0x' || substr(md5('{seed}:' || resample::VARCHAR || ':' || pos::VARCHAR), 1, 8))::BIGINT".format


@query(f"""WITH v AS (SELECT 'len_' || split AS metric, row_number() OVER (PARTITION BY split ORDER BY conv_id, turn) - 1 AS pos, x FROM (
  SELECT role AS split, conv_id, turn, length(text) AS x FROM conversations) q), n AS (SELECT metric, count(*) AS n FROM v GROUP BY metric),
 d AS (SELECT v.metric, resample, {_DRAW(seed=256)} % n AS pos FROM v JOIN n USING (metric), (SELECT unnest(range(2000)) AS resample) r),
 m AS (SELECT d.metric, resample, avg(x) AS m FROM d JOIN v ON v.metric = d.metric AND v.pos = d.pos GROUP BY d.metric, resample)
 SELECT metric, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.5), 6) AS mid, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY metric""")
def bootstrap_aggregate(spark, sf):
    rows = in_order(table(spark, sf, "conversations").where("role IS NOT NULL").select("role", "conv_id", "turn", length_of("text").alias("x")), "role", "conv_id", "turn", name="lengths")
    first = rows.groupBy("role").agg(F.min("pos").alias("first"))
    values = rows.join(F.broadcast(first), "role").select(F.concat(F.lit("len_"), "role").alias("metric"), (F.col("pos") - F.col("first")).alias("pos"), "x")
    return S.confidence(values, "x")


@query()
def bootstrap_rouge(spark, sf):
    """The nine ROUGE scores of all pairs, 2,000 resamples."""
    from ..functions.stem import _FIELDS

    scored = turn_pairs(spark, sf).select("conv_id", "turn", rouge_scores("summary", "reference").alias("r"))
    return S.confidence_of(in_order(scored.select("conv_id", "turn", "r.*"), "conv_id", "turn", name="rouge").drop("conv_id", "turn"), list(_FIELDS))


@query()
def keyword_prf_at_k(spark, sf):
    """Ten keyphrases of each whole text against all words of it."""
    own = documents(spark, sf).select("doc_id", F.array_distinct(index_tokens(F.lower("text"))).alias("g"), F.transform(keyphrases("text", top=10), lambda x: x["phrase"]).alias("p"))
    return S.keyword_scores(own, gold="g", predicted="p", k=10)


_STATS = "round(avg(len), 6) AS mean, round(quantile_cont(len, 0.5), 6)::DOUBLE AS median, round(stddev_pop(len), 6) AS std, count(*) AS n"
_LENGTHS = f"WITH {SQL_PAIRS}, l AS (SELECT split, 'reference' AS side, length(reference) AS len FROM pairs UNION ALL SELECT split, 'summary', length(summary) FROM pairs)"


@query(f"{_LENGTHS} SELECT coalesce(split, 'aggregated') AS split, side, {_STATS} FROM l GROUP BY GROUPING SETS ((split, side), (side))")
def length_statistics(spark, sf):
    return T.length_statistics(document_pairs(spark, sf))


@query(f"{_LENGTHS} SELECT split, side, {_STATS} FROM l GROUP BY split, side")
def length_statistics_by_split(spark, sf):
    return T.length_statistics(document_pairs(spark, sf)).where("split <> 'aggregated'")


@query(f"{_LENGTHS} SELECT 'aggregated' AS split, side, {_STATS} FROM l GROUP BY side")
def length_statistics_aggregated(spark, sf):
    return T.length_statistics(document_pairs(spark, sf)).where("split = 'aggregated'")


@query(f"SELECT round(avg(len), 6) AS mean, round(quantile_cont(len, 0.5), 6)::DOUBLE AS median, round(stddev_pop(len), 6) AS std, count(*) AS n FROM (SELECT len({SQL_TOKENS('text')}) AS len FROM documents) q")
def length_stats(spark, sf):
    return documents(spark, sf).select(length_of("text", "token").alias("len")).agg(*T.summary_of("len"))


@query("""WITH l AS (SELECT lang, length(text) AS len FROM documents), u AS (SELECT lang, 'all' AS kind, len FROM l UNION ALL SELECT lang, 'short', len FROM l WHERE len <= 10000)
 SELECT lang, kind, round(quantile_cont(len, 0.25), 6)::DOUBLE AS q1, round(quantile_cont(len, 0.5), 6)::DOUBLE AS q2, round(quantile_cont(len, 0.75), 6)::DOUBLE AS q3, count(*) AS n FROM u GROUP BY lang, kind""")
def violin_quartiles(spark, sf):
    own = documents(spark, sf).select("lang", length_of("text").alias("len"))
    kinds = F.when(F.col("len") <= 10000, F.array(F.lit("all"), F.lit("short"))).otherwise(F.array(F.lit("all")))
    return T.quartiles(own.select("lang", "len", F.explode(kinds).alias("kind")), ["lang", "kind"])


@query("""WITH l AS (SELECT length(text) AS len FROM documents), m AS (SELECT greatest(avg(len) + 2 * stddev_pop(len), 1e-9) AS top FROM l)
 SELECT least(floor(len * 20 / top), 19)::BIGINT AS bin, count(*) AS n FROM l, m GROUP BY ALL""")
def plot_lengths_histogram(spark, sf):
    return T.clamped_histogram(documents(spark, sf).select(length_of("text").alias("len")), "len")


@query(f"""WITH {SQL_TURNS}, {_KEYED}, {sql_overlap('keyed', 'id', 2)}, f AS (SELECT CASE WHEN hits > 0 THEN 2 * (hits / ns) * (hits / nr) / (hits / ns + hits / nr) ELSE 0 END AS f, length(reference) <= 500 AS short FROM o JOIN keyed USING (id))
 SELECT short, least(floor(round(f, 6) * 20), 19)::BIGINT AS bin, count(*) AS n FROM f GROUP BY ALL""")
def rouge_score_histogram(spark, sf):
    scored = _keyed(spark, sf).select((F.length("reference") <= 500).alias("short"), F.round(P.rouge(P.gram_overlap("summary", "reference"))["fmeasure"], 6).alias("f"))
    return T.fixed_histogram(scored, "f", 0, 1, 20, ("short",))


_RANDOM = "('0x' || substr(md5('{0}:' || doc_id::VARCHAR), 1, 8))::BIGINT".format
_VOTES = f"votes AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, quality AS gold, CASE WHEN {_RANDOM('a')} % 10 < 8 THEN quality ELSE 1 - quality END AS a, CASE WHEN {_RANDOM('b')} % 10 < 7 THEN quality ELSE 1 - quality END AS b FROM labels)"


def _votes(spark, sf):
    """Quality labels as gold, and two systems that are right about 8 and 7 times in 10."""
    noise = lambda x: F.conv(F.substring(F.md5(F.concat(F.lit(f"{x}:"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("long") % 10
    guess = lambda x, k: F.when(noise(x) < k, F.col("quality")).otherwise(1 - F.col("quality"))
    return in_order(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("gold"), guess("a", 8).alias("a"), guess("b", 7).alias("b")), "doc_id", name="votes").drop("doc_id")


@query(f"""WITH {_VOTES}, d AS (SELECT resample, {_DRAW(seed=256)} % (SELECT count(*) FROM votes) AS pos FROM votes, (SELECT unnest(range(10000)) AS resample) r),
 s AS (SELECT resample, round(avg((a = gold)::INT), 9) AS x, round(avg((b = gold)::INT), 9) AS y FROM d JOIN votes USING (pos) GROUP BY resample)
 SELECT 10000::BIGINT AS n_resamples, count(*) FILTER (x > y) AS wins, count(*) FILTER (x = y) AS ties, round(1 - count(*) FILTER (x > y) / 10000, 6) AS p FROM s""")
def paired_bootstrap_test(spark, sf):
    return S.paired_bootstrap(_votes(spark, sf))


@query(f"""WITH {_VOTES}, t AS (SELECT abs(avg((a = gold)::INT) - avg((b = gold)::INT)) AS gap FROM votes),
 w AS (SELECT resample, gold, CASE WHEN {_DRAW(seed=256)} % 2 = 1 THEN b ELSE a END AS a, CASE WHEN {_DRAW(seed=256)} % 2 = 1 THEN a ELSE b END AS b FROM votes, (SELECT unnest(range(10000)) AS resample) r),
 s AS (SELECT resample, abs(avg((a = gold)::INT) - avg((b = gold)::INT)) AS gap FROM w GROUP BY resample)
 SELECT 10000::BIGINT AS n_resamples, count(*) FILTER (round(s.gap, 9) >= round(t.gap, 9)) AS at_least, round((count(*) FILTER (round(s.gap, 9) >= round(t.gap, 9)) + 1) / 10001, 6) AS p FROM s, t""")
def permutation_test(spark, sf):
    return S.permutation(_votes(spark, sf))
