"""Queries of the document model, index, retrieval, topic digests and baselines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import index_tokens, sentences
from ..operators import baselines as B
from ..operators import documents as D
from ..operators import retrieval as R
from .registry import SQL_PAIRS, SQL_SENTENCES, SQL_WORDS, document_pairs, documents, query, table

_ROWS = f"rows AS (SELECT doc_id, unnest(range(len(l))) AS sent_id, unnest(l) AS s FROM (SELECT doc_id, {SQL_SENTENCES('text')} AS l FROM documents) q)"
_POST = f"WITH {_ROWS}, post AS (SELECT doc_id, term, sent_id, count(*) AS tf FROM (SELECT doc_id, sent_id, unnest({SQL_WORDS('s')}) AS term FROM rows) q GROUP BY ALL)"


@query(f"{_POST} SELECT doc_id, term, sent_id::INT AS sent_id, tf FROM post")
def index_term_freq(spark, sf):
    return R.postings(R.sentence_rows(documents(spark, sf)))


@query(f"{_POST} SELECT doc_id, count(*) AS n_postings, count(DISTINCT term) AS n_terms, sum(tf)::BIGINT AS n_tokens FROM post GROUP BY doc_id")
def build_index(spark, sf):
    return documents(spark, sf).select("doc_id", R.index_size("text").alias("x")).where("x.n_tokens > 0").select("doc_id", "x.*")


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({SQL_WORDS('lower(text)')}) AS term FROM documents) q GROUP BY term")
def document_frequency(spark, sf):
    return R.document_frequency(documents(spark, sf))


_QUERY = "the of the thing la"


@query(f"""{_POST}, q(term, w, p) AS (VALUES ('the', 2, 0), ('of', 1, 1), ('thing', 1, 3), ('la', 1, 4)), h AS (SELECT doc_id, sent_id, sum(tf * w)::BIGINT AS score, min(p) AS p FROM post JOIN q USING (term) GROUP BY ALL)
 SELECT doc_id, rank::INT AS rank, sent_id::INT AS sent_id, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, p, sent_id) AS rank FROM h) z WHERE rank <= 3""")
def frequency_retrieve(spark, sf):
    return R.frequency_retrieve(documents(spark, sf), _QUERY)


@query("""WITH d AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(list_transform(v.embedding, lambda x: x::DOUBLE), list_transform(q.embedding, lambda x: x::DOUBLE)), 6) AS score FROM embeddings q, embeddings v),
 k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM d) SELECT query_id, rank::INT AS rank, vec_id, score FROM k WHERE rank <= 3""")
def dpr_retrieve(spark, sf):
    """Every embedding is a query."""
    return R.dense_retrieve_all(table(spark, sf, "embeddings"))


#: A document's first words as its topics: three, or as many as it has.
_TOPICS = f"SELECT doc_id, {SQL_WORDS('text')}[1:3] AS t FROM documents"


def _with_topics(spark, sf):
    return documents(spark, sf).select("doc_id", "text", F.slice(index_tokens("text"), 1, 3).alias("t"))


@query(f"SELECT doc_id, t[1:2] AS topics FROM ({_TOPICS}) q")
def oracle_extract(spark, sf):
    """Two topics of those given; documents of fewer words give as many."""
    return _with_topics(spark, sf).select("doc_id", F.when(F.size("t") >= 2, R.given_topics(F.col("t"), 2)).otherwise(F.col("t")).alias("topics"))


def _digest_sql(most: str, out: str) -> str:
    return f"""{_POST}, t AS (SELECT doc_id, unnest(range(len(t))) AS topic, unnest(t) AS term, len(t) AS n FROM ({_TOPICS}) z), h AS (SELECT doc_id, topic, n, sent_id, tf AS score FROM post JOIN t USING (doc_id, term)),
 c AS (SELECT DISTINCT doc_id, sent_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, topic ORDER BY score DESC, sent_id) AS k FROM h) y WHERE k <= {most})
 SELECT doc_id, {out} AS summary FROM c JOIN rows USING (doc_id, sent_id) GROUP BY doc_id"""


@query(_digest_sql("3", "md5(string_agg(s, E'\\n' ORDER BY sent_id))"))
def summarize(spark, sf):
    return R.topic_summary(_with_topics(spark, sf), "t").select("doc_id", F.md5("summary").alias("summary"))


@query(_digest_sql("15 // n + 1", "left(string_agg(s, E'\\n' ORDER BY sent_id), 15)"))
def summarize_max_length(spark, sf):
    return R.topic_summary(_with_topics(spark, sf), "t", max_chars=15)


@query()
def summarize_by_keyphrases(spark, sf):
    """The whole way from a text to its digest: its own keyphrases as topics."""
    return R.Summarizer("keyphrases", "frequency").summarize(documents(spark, sf))


@query()
def yake_extract(spark, sf):
    return documents(spark, sf).select("doc_id", R.keyphrases("text", top=5).alias("phrases"))


@query(f"""WITH w AS (SELECT doc_id, {SQL_WORDS('lower(text)')} AS l FROM documents), g AS (SELECT doc_id, n, p, array_to_string(l[p + 1:p + n], ' ') AS phrase
  FROM (SELECT doc_id, l, n, unnest(range(0, len(l) - n + 1)) AS p FROM w, (VALUES (1), (2), (3)) v(n)) q WHERE length(l[p + 1]) > 2 AND length(l[p + n]) > 2),
 f AS (SELECT doc_id, phrase, max(n) AS words, min(p) AS first, count(*) AS tf FROM g GROUP BY doc_id, phrase HAVING count(*) >= 2 AND min(p) < 400),
 df AS (SELECT phrase, count(*) AS df FROM f GROUP BY phrase), b AS (SELECT doc_id, least(3.0, count(*) / (greatest(count(*) FILTER (words > 1), 1) * 2.3)) AS boost FROM f GROUP BY doc_id), total AS (SELECT count(*) AS n FROM documents),
 s AS (SELECT doc_id, phrase, first, round(tf * CASE WHEN words = 1 THEN ln(n / df) / ln(2) ELSE ln(n) / ln(2) * boost END, 6) AS score FROM f JOIN df USING (phrase) JOIN b USING (doc_id), total)
 SELECT doc_id, rank::INT AS rank, phrase, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, first, phrase) AS rank FROM s) q WHERE rank <= 10""")
def kpminer(spark, sf):
    return R.position_weighted_keyphrases(documents(spark, sf))


_SENTS = f"SELECT doc_id, {SQL_SENTENCES('text')} AS l FROM documents"


@query(f"SELECT doc_id, CASE WHEN len(l) > 0 THEN md5(array_to_string(l[1:3], ' ')) END AS lead FROM ({_SENTS}) q")
def lead_3(spark, sf):
    """Null for documents without a sentence."""
    own = documents(spark, sf).select("doc_id", sentences("text").alias("l"))
    return own.select("doc_id", F.when(F.size("l") > 0, F.md5(B.lead(F.when(F.size("l") > 0, F.col("l")), 3))).alias("lead"))


@query(f"SELECT doc_id, CASE WHEN len(l) > 0 THEN md5(array_to_string(l[1:5], ' ')) END AS lead FROM ({_SENTS}) q")
def lead_k(spark, sf):
    """Null for documents without a sentence."""
    own = documents(spark, sf).select("doc_id", sentences("text").alias("l"))
    return own.select("doc_id", F.when(F.size("l") > 0, F.md5(B.lead(F.when(F.size("l") > 0, F.col("l")), 5))).alias("lead"))


_TURNS = f"""t AS (SELECT conv_id, turn, {SQL_SENTENCES('text')} AS l, {SQL_SENTENCES('nxt')} AS m FROM (SELECT *, lead(text) OVER w AS nxt, lead(role) OVER w AS nrole FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) q WHERE role = 'user' AND nrole = 'assistant'),
 r AS (SELECT avg(len(l) / len(m)) AS ratio FROM t WHERE len(l) > 0 AND len(m) > 0)"""


@query(f"WITH {_TURNS} SELECT conv_id, turn, round_even(len(l) / ratio, 0)::INT AS k, md5(array_to_string(l[1:round_even(len(l) / ratio, 0)::INT], ' ')) AS lead FROM t, r WHERE len(l) > 0")
def lead_k_dynamic(spark, sf):
    from .registry import turn_pairs

    pairs = turn_pairs(spark, sf)
    own = pairs.select("conv_id", "turn", sentences("reference").alias("l")).where(F.size("l") > 0).crossJoin(F.broadcast(B.mean_ratio(pairs)))
    k = B.dynamic_length(F.size("l"), F.col("ratio"))
    return own.select("conv_id", "turn", k.alias("k"), F.md5(B.lead(F.col("l"), k)).alias("lead"))


@query(f"WITH {_TURNS} SELECT round(ratio, 6) AS ratio FROM r")
def avg_compression_ratio(spark, sf):
    from .registry import turn_pairs

    return B.mean_ratio(turn_pairs(spark, sf)).select(F.round("ratio", 6).alias("ratio"))


@query()
def lexrank_st(spark, sf):
    return documents(spark, sf).select("doc_id", B.lexrank(sentences("text"), k=3).alias("summary"))


@query()
def lexrank_max_length(spark, sf):
    return documents(spark, sf).select("doc_id", B.lexrank(sentences("text"), max_length=200).alias("summary"))


@query()
def lexrank_dynamic(spark, sf):
    pairs = document_pairs(spark, sf)
    own = pairs.select("doc_id", sentences("reference").alias("l")).crossJoin(F.broadcast(B.mean_ratio(pairs)))
    return own.select("doc_id", B.lexrank(F.col("l"), k=B.dynamic_length(F.size("l"), F.col("ratio"), 1)).alias("summary"))


#: Twenty vectors in a row are a document's sentences; a random walk goes by softmax of their cosines, here in steps that converge.
_WALK = """WITH RECURSIVE e AS (SELECT vec_id, vec_id // 20 AS doc, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, doc, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-9)) AS v FROM e),
 s AS (SELECT a.doc, a.vec_id AS i, b.vec_id AS j, exp({0}) AS w FROM u a JOIN u b ON a.doc = b.doc),
 p AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM s), n AS (SELECT doc, count(*) AS n FROM u GROUP BY doc),
 walk(step, i, x) AS (SELECT 0, vec_id, 1.0::DOUBLE / n FROM u JOIN n USING (doc) UNION ALL SELECT step + 1, p.j, sum(p.w * x) FROM walk JOIN p ON p.i = walk.i WHERE step < 40 GROUP BY step + 1, p.j),
 c AS (SELECT u.doc, i AS vec_id, round(x, 6) AS score FROM walk JOIN u ON u.vec_id = walk.i WHERE step = 40)""".format


def _central(spark, sf, threshold=None):
    own = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("doc"), F.col("vec_id").alias("pos"), "embedding")
    return B.vector_centrality(own, doc="doc", pos="pos", vector="embedding", threshold=threshold).select("doc", F.col("pos").alias("vec_id"), F.round("score", 6).alias("score"))


@query(_WALK("list_dot_product(a.v, b.v)") + " SELECT doc, vec_id, score FROM c")
def degree_centrality_scores(spark, sf):
    return _central(spark, sf)


@query(_WALK("CASE WHEN round(list_dot_product(a.v, b.v), 9) >= 0.1 THEN 1.0 ELSE 0.0 END") + " SELECT doc, vec_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, vec_id) AS rank FROM c) q WHERE rank <= 3")
def top_k_centrality(spark, sf):
    rank = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("score"), "vec_id"))
    return _central(spark, sf, 0.1).withColumn("rank", rank).where(F.col("rank") <= 3).select("doc", "vec_id", "rank")


@query(f"SELECT doc_id, len(l)::INT AS n_sentences FROM ({_SENTS}) q ORDER BY len(l), doc_id LIMIT 10")
def shortest_articles(spark, sf):
    return B.shortest(documents(spark, sf), sentences("text"), "doc_id")


_LINES = "lines AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS s FROM (SELECT doc_id, string_split(replace(text, 'The ', '= '), E'\\n') AS l FROM documents) q)"


def _lines(spark, sf):
    """Lines of the documents, those that begin with 'The ' as headings."""
    return documents(spark, sf).select("doc_id", F.split(F.replace("text", F.lit("The "), F.lit("= ")), "\n", -1).alias("l"))


@query(f"WITH {_LINES} SELECT doc_id, md5(coalesce(string_agg(s, '|' ORDER BY pos) FILTER (NOT starts_with(s, '=') AND trim(s, E'\\n ') <> ''), '')) AS sentences FROM lines GROUP BY doc_id")
def document_sentences(spark, sf):
    return _lines(spark, sf).select("doc_id", F.md5(F.array_join(D.document_sentences(F.col("l")), "|")).alias("sentences"))


@query(f"""WITH {_LINES}, g AS (SELECT *, starts_with(s, '=') OR trim(s, E'\\n ') = '' AS b FROM lines), k AS (SELECT *, sum(b::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM g)
 SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS paragraph, md5(string_agg(s, '|' ORDER BY pos)) AS sentences FROM k WHERE NOT b GROUP BY doc_id, k""")
def paragraph_segmentation(spark, sf):
    rows = _lines(spark, sf).select("doc_id", F.posexplode(D.paragraphs("l")).alias("paragraph", "s"))
    return rows.select("doc_id", "paragraph", F.md5(F.array_join("s", "|")).alias("sentences"))


@query(f"SELECT doc_id, len(l)::BIGINT AS n_sentences, md5(lower(array_to_string(list_transform(l, lambda x: array_to_string(regexp_extract_all(x, '[\\p{{L}}\\p{{N}}]+|[^\\s\\p{{L}}\\p{{N}}]'), ' ')), '|'))) AS lemmas FROM ({_SENTS}) q")
def sentence_object(spark, sf):
    own = documents(spark, sf).select("doc_id", D.sentence_objects(sentences("text")).alias("o"))
    return own.select("doc_id", F.size("o").cast("long").alias("n_sentences"), F.md5(F.array_join(F.transform("o", lambda x: F.array_join(x["lemmas"], " ")), "|")).alias("lemmas"))


@query("SELECT doc_id, len(list_filter(string_split(text, E'\\n'), lambda x: NOT starts_with(x, '=') AND trim(x, E'\\n ') <> ''))::BIGINT AS n FROM documents")
def custom_splitting_fn(spark, sf):
    by_line = lambda c: F.split(F.col(c) if isinstance(c, str) else c, "\n", -1)
    return documents(spark, sf).select("doc_id", F.size(D.document("text", by_line)["sentences"]).cast("long").alias("n"))


@query(f"""WITH t AS (SELECT conv_id AS doc, turn AS sent, {SQL_WORDS('text')} AS w FROM conversations), k AS (SELECT doc, sent, len(w) AS n, coalesce(sum(len(w)) OVER (PARTITION BY doc ORDER BY sent ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM t),
 tok AS (SELECT doc, sent, a + i AS tok FROM (SELECT doc, sent, a, unnest(range(n)) AS i FROM k) q),
 s AS (SELECT x.doc, x.sent AS out_sent, y.sent AS in_sent, sum((x.tok * 7 + y.tok * 3) % 11)::BIGINT AS weight FROM tok x JOIN tok y ON x.doc = y.doc GROUP BY ALL)
 SELECT doc, out_sent, in_sent, weight, round(weight / nullif(sum(weight) OVER (PARTITION BY doc, in_sent), 0), 6) AS share, row_number() OVER (PARTITION BY doc, in_sent ORDER BY weight DESC, out_sent) = 1 AS is_max FROM s""")
def attention_block_sum(spark, sf):
    """All words of each turn attend to each other by the same weights."""
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("sent"), F.size(index_tokens("text")).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("doc").orderBy("sent").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = turns.withColumn("first", before).where("n > 0")
    return B.block_sums_by(spans.select("doc", "sent", "first", (F.col("first") + F.col("n") - 1).alias("last")), lambda x, y: (x * 7 + y * 3) % 11)


@query(f"WITH {SQL_PAIRS} SELECT split, count(*) AS n, min(row_id) AS first, max(row_id) AS last FROM pairs GROUP BY split")
def split_registry(spark, sf):
    return document_pairs(spark, sf).groupBy("split").agg(F.count("*").alias("n"), F.min("row_id").alias("first"), F.max("row_id").alias("last"))
