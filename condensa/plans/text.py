"""Queries of scalar text functions over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from .registry import SQL_SENTENCES, SQL_TOKENS, SQL_WORDS, documents, query, table


@query("SELECT doc_id, length(text)::BIGINT AS n FROM documents")
def len_char(spark, sf):
    return documents(spark, sf).select("doc_id", X.length_of("text", "char").cast("long").alias("n"))


@query("SELECT doc_id, len(string_split(text, ' '))::BIGINT AS n FROM documents")
def len_whitespace(spark, sf):
    return documents(spark, sf).select("doc_id", X.length_of("text", "whitespace").cast("long").alias("n"))


@query(f"SELECT doc_id, len({SQL_TOKENS('text')})::BIGINT AS n FROM documents")
def len_token(spark, sf):
    return documents(spark, sf).select("doc_id", X.length_of("text", "token").cast("long").alias("n"))


@query(f"SELECT doc_id, md5(array_to_string({SQL_TOKENS('text')}, ' ')) AS tokens FROM documents")
def tokenize(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(F.array_join(X.tokens("text"), " ")).alias("tokens"))


@query(f"SELECT doc_id, md5(array_to_string({SQL_WORDS('text')}, ' ')) AS tokens FROM documents")
def tokenize_index(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(F.array_join(X.index_tokens("text"), " ")).alias("tokens"))


@query(f"SELECT doc_id, md5(lower(array_to_string({SQL_TOKENS('text')}, ' '))) AS lemmas FROM documents")
def lemmatize(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(F.array_join(X.lemmas("text"), " ")).alias("lemmas"))


_S = f"sents AS (SELECT doc_id, pos, s FROM (SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS pos FROM (SELECT doc_id, {SQL_SENTENCES('text')} AS l FROM documents) a) b)"


@query(f"WITH {_S} SELECT doc_id, pos::BIGINT AS pos, md5(s) AS sentence FROM sents")
def sentence_split(spark, sf):
    return documents(spark, sf).select("doc_id", F.posexplode(X.sentences("text")).alias("pos", "s")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("s").alias("sentence"))


_BAD = "(s LIKE '%;' OR NOT regexp_matches(right(s, 1), '[:.?!\"'']') OR len(string_split(s, ' ')) < 3 OR length(s) < 10)"


@query(f"""WITH {_S}, t AS (SELECT doc_id, pos, trim(s, E'\\n ') AS s FROM sents),
 g AS (SELECT doc_id, pos, s, coalesce(sum(CASE WHEN {_BAD} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM t)
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS pos, md5(CASE WHEN count(*) > 1 OR bool_or({_BAD}) THEN trim(string_agg(s, ' ' ORDER BY pos), ' ') ELSE min(s) END) AS sentence FROM g GROUP BY doc_id, k""")
def better_sentence_split(spark, sf):
    rows = documents(spark, sf).select("doc_id", F.posexplode(X.merged_sentences(X.sentences("text"))).alias("pos", "s"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("s").alias("sentence"))


_L = f"(SELECT doc_id, {SQL_SENTENCES('text')} AS l FROM documents) q"


@query(f"SELECT doc_id, len(list_filter(l, lambda s: NOT regexp_matches(right(s, 1), '[:.?!\"'']')))::BIGINT AS n FROM {_L}")
def no_period_symbol(spark, sf):
    return documents(spark, sf).select("doc_id", F.size(F.filter(X.sentences("text"), X.lacks_ending)).cast("long").alias("n"))


@query(f"SELECT doc_id, len(list_filter(l, lambda s: regexp_matches(s, '[0-9]\\.$')))::BIGINT AS n FROM {_L}")
def year_like_sentence_end(spark, sf):
    return documents(spark, sf).select("doc_id", F.size(F.filter(X.sentences("text"), X.ends_in_digit_period)).cast("long").alias("n"))


@query("SELECT doc_id, 'de' AS text_lang, lang FROM documents")
def detect_language(spark, sf):
    from ..operators.documents import document

    return documents(spark, sf).select("doc_id", document("text")["text_lang"].alias("text_lang"), "lang")


@query("SELECT doc_id, CASE WHEN lower(split_part(lang, '-', 1)) IN ('en', 'de') THEN lower(split_part(lang, '-', 1)) END AS lang, lower(split_part(lang, '-', 1)) IN ('en', 'de') AS known FROM documents")
def normalize_lang(spark, sf):
    docs = documents(spark, sf)
    return docs.select("doc_id", F.when(X.is_known_language("lang"), X.normal_language("lang")).alias("lang"), X.is_known_language("lang").alias("known"))


@query("SELECT doc_id, md5(trim(text, E'\\n\\t ')) AS a, md5(trim(text, E'\\n ')) AS b, md5(trim(text, E'\\n= ')) AS c FROM documents", name="strip")
def strip_variants(spark, sf):
    return documents(spark, sf).select("doc_id", *[F.md5(X.strip("text", s)).alias(n) for n, s in (("a", "\n\t "), ("b", "\n "), ("c", "\n= "))])


@query("SELECT doc_id, md5(replace(text, chr(160), ' ')) AS text FROM documents")
def replace_nbsp(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(X.plain_spaces("text")).alias("text"))


@query("SELECT doc_id, md5(replace(text, E'\\n', ' ')) AS text FROM documents")
def newline_to_space(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(X.one_line("text")).alias("text"))


@query("SELECT doc_id, md5(array_to_string(l, E'\\n')) AS plain, md5(array_to_string(list_filter(list_transform(l, lambda x: trim(x, E'\\n= ')), lambda x: x <> ''), E'\\n')) AS stripped FROM (SELECT doc_id, string_split(text, '.') AS l FROM documents) q")
def fuse_sentences(spark, sf):
    parts = F.split("text", r"\.", -1)
    return documents(spark, sf).select("doc_id", F.md5(X.fused(parts)).alias("plain"), F.md5(X.fused(parts, "\n= ")).alias("stripped"))


_LEGAL = f"SELECT doc_id, l, [CASE WHEN doc_id % 3 <> 1 THEN l[1:1] ELSE [] END, CASE WHEN doc_id % 3 <> 0 THEN l[2:3] ELSE [] END] AS g FROM (SELECT doc_id, {SQL_SENTENCES('text')} AS l FROM documents) q"


def _legal(spark, sf):
    """Documents as court decisions: the first lines are principles, by thirds in one list, the other or both."""
    own = documents(spark, sf).select("doc_id", X.sentences("text").alias("l"))
    none = F.array().cast("array<string>")
    first, second = F.when(F.col("doc_id") % 3 != 1, F.slice("l", 1, 1)).otherwise(none), F.when(F.col("doc_id") % 3 != 0, F.slice("l", 2, 2)).otherwise(none)
    return own.select("doc_id", "l", F.array(first, second).alias("g"))


def _part():
    return F.when(F.size(F.flatten("g")) > 0, X.principle_part(F.col("g"))).otherwise(F.lit("none"))


@query(f"SELECT doc_id, md5(array_to_string(l[1:2], E'\\n') || E'\\n' || array_to_string(l[3:], E'\\n')) AS reference, md5(array_to_string(list_transform(flatten(g), lambda x: x || E'\\n'), '')) AS summary FROM ({_LEGAL}) z")
def construct_legal_sample(spark, sf):
    facts, reasoning = F.slice("l", 1, 2), F.slice("l", F.lit(3), F.size("l") + 1)
    return _legal(spark, sf).select("doc_id", F.md5(X.legal_reference(facts, reasoning)).alias("reference"), F.md5(X.legal_summary(F.col("g"))).alias("summary"))


@query(f"SELECT doc_id, CASE WHEN len(g[1]) > 0 AND len(g[2]) > 0 THEN 'both' WHEN len(g[1]) > 0 THEN 'first' WHEN len(g[2]) > 0 THEN 'second' ELSE 'none' END AS part FROM ({_LEGAL}) z")
def guiding_portion(spark, sf):
    """'none' for a document too short to have a principle, which alone would be an error."""
    return _legal(spark, sf).select("doc_id", _part().alias("part"))


@query(f"SELECT part, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS percent FROM (SELECT CASE WHEN len(g[1]) > 0 AND len(g[2]) > 0 THEN 'both' WHEN len(g[1]) > 0 THEN 'first' WHEN len(g[2]) > 0 THEN 'second' ELSE 'none' END AS part FROM ({_LEGAL}) z) y GROUP BY part")
def guiding_split_counts(spark, sf):
    from pyspark.sql import Window

    counts = _legal(spark, sf).groupBy(_part().alias("part")).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query(f"SELECT doc_id, unnest(range(len(l)))::BIGINT AS section, md5(unnest(l)) AS document, md5(lower(unnest(l))) AS summary FROM (SELECT doc_id, {SQL_SENTENCES('text')} AS l FROM documents) q")
def expand_sections(spark, sf):
    from ..sources.readers import sections

    s = X.sentences("text")
    article = F.struct(F.transform(s, lambda x: F.lit("")).alias("section_name"), s.alias("document"), F.transform(s, F.lower).alias("summary"))
    rows = sections(documents(spark, sf).select("doc_id", article.alias("article")))
    return rows.select("doc_id", F.col("section").cast("long").alias("section"), F.md5("document").alias("document"), F.md5("summary").alias("summary"))


@query("SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) q WHERE ch <> '' GROUP BY ch")
def char_occurrences(spark, sf):
    return X.sign_counts(documents(spark, sf))


@query(f"SELECT doc_id, len(t)::BIGINT AS n_tokens, greatest(len(t) - 1, 0)::BIGINT AS n_grams, md5(coalesce(array_to_string(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]), '|'), '')) AS grams FROM (SELECT doc_id, {SQL_TOKENS('text')} AS t FROM documents) q")
def ngrams(spark, sf):
    t = documents(spark, sf).select("doc_id", X.tokens("text").alias("t"))
    g = X.ngrams(F.col("t"), 2)
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(g).cast("long").alias("n_grams"), F.md5(F.array_join(g, "|")).alias("grams"))


@query("SELECT doc_id, left(text, 40) AS text FROM documents")
def print_cutoff(spark, sf):
    return documents(spark, sf).select("doc_id", X.cut("text", 40).alias("text"))


@query("SELECT lang, count(DISTINCT source) AS n_sources, count(DISTINCT md5(text)) AS n_texts FROM documents GROUP BY lang")
def distinct_texts(spark, sf):
    return documents(spark, sf).groupBy("lang").agg(F.count_distinct("source").alias("n_sources"), F.count_distinct(F.md5("text")).alias("n_texts"))


@query("SELECT page_id, length(html)::BIGINT AS n FROM pages")
def page_lengths(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.length_of("html").cast("long").alias("n"))
