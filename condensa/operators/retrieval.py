"""Index, keyphrases, retrieval and topic digests, for all documents of a table at once. What one document holds stays in its row."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grams import distinct, grams, numbered, ranked, room, text_slices
from ..functions.pairs import _finder
from ..functions.text import SENTENCE, WORD, cut, index_tokens, sentences
from ..storage import written


def sentence_rows(docs: DataFrame, *, doc: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """(doc, sent_id, sentence). text: a string, split here, or an array of sentences."""
    col = F.col(text) if isinstance(text, str) else text
    kind = docs.select(col.alias("t")).schema["t"].dataType.typeName()
    if kind not in ("string", "array"):
        raise NotImplementedError("a text or an array of sentences")
    return docs.select(doc, F.posexplode(sentences(col) if kind == "string" else col).alias("sent_id", "sentence"))


def term_counts(sentence: Column | str) -> Column:
    """array<struct(term, tf)> of a sentence, by first occurrence."""

    @F.arrow_udf("array<struct<term:string,tf:long>>")
    def run(texts: pa.Array) -> pa.Array:
        import regex

        find = regex.compile(r"[\p{L}\p{N}]+").findall
        counts = [None if t is None else Counter(find(t)) for t in texts.to_pylist()]
        return pa.array([None if c is None else [{"term": t, "tf": n} for t, n in c.items()] for c in counts], pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())])))

    return run(F.col(sentence) if isinstance(sentence, str) else sentence)


def postings(rows: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """(doc, term, sent_id, tf) of sentences (doc, sent_id, sentence): counted where they are, nothing is shuffled."""
    return rows.select(doc, "sent_id", F.inline(term_counts("sentence"))).select(doc, "term", "sent_id", "tf")


def index_size(text: Column | str) -> Column:
    """struct(n_postings, n_terms, n_tokens) of a text's index."""
    parts = F.transform(_sentences(text), index_tokens)
    n = F.aggregate(F.transform(parts, lambda t: F.size(F.array_distinct(t))), F.lit(0), lambda x, y: x + y)
    every = F.flatten(parts)
    return F.struct(n.cast("long").alias("n_postings"), F.size(F.array_distinct(every)).cast("long").alias("n_terms"), F.size(every).cast("long").alias("n_tokens"))


def _sentences(text: Column | str, kind: str = "string") -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return sentences(text) if kind == "string" else text


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is reckoned once, however often then and its lambdas name it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _best_sentences(parts: Column, words: Column, most: Column) -> Column:
    """Of lists of words, one a sentence: array<struct(less, first, sent_id)> of the most that have words, in order of rank.

    less is the score with its sign changed: how often a sentence has the words, one named
    twice counts twice. Equal scores: whoever has an earlier word, then the earlier sentence.
    """

    def scored(tokens: Column, at: Column) -> Column:
        counts = F.transform(words, lambda w, k: F.struct(F.size(F.filter(tokens, lambda t: t == w)).alias("n"), k.alias("k")))
        less = -F.aggregate(counts, F.lit(0).cast("long"), lambda x, c: x + c["n"])
        return F.struct(less.alias("less"), F.array_min(F.transform(F.filter(counts, lambda c: c["n"] > 0), lambda c: c["k"])).alias("first"), at.alias("sent_id"))

    hits = F.filter(F.transform(parts, scored), lambda x: x["less"] < 0)
    return F.slice(F.array_sort(hits), F.lit(1), most.cast("int"))


def document_frequency(docs: DataFrame, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, df); a document's terms are made distinct before the shuffle."""
    return docs.select(F.explode(F.array_distinct(index_tokens(F.lower(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def frequency_retrieve(docs: DataFrame, query: str, *, doc: str = "doc_id", text: str = "text", limit: int = 3, strict: bool = False) -> DataFrame:
    """(doc, rank, sent_id, score): sentences with the most of the query's terms, a term counted as often as the query has it.

    Equal scores: whoever has the query's earlier term, then the earlier sentence. A term
    that a document lacks adds nothing; strict leaves out documents that lack one. text: a
    string, split here, or an array of sentences. A narrow pass.
    """
    import regex

    terms = regex.findall(r"[\p{L}\p{N}]+", query)
    if limit <= 0 or not terms:
        raise ValueError("a query with words and a positive limit")
    words = F.array(*[F.lit(t) for t in terms])

    def found(parts: Column) -> Column:
        best = _best_sentences(parts, words, F.lit(limit))
        return F.when(F.size(F.array_except(words, F.flatten(parts))) == 0, best).otherwise(F.slice(best, 1, 0)) if strict else best

    parts = F.transform(_sentences(text, docs.schema[text].dataType.typeName()), index_tokens)
    rows = docs.select(doc, F.posexplode(_let(parts, found)).alias("k", "x"))
    return rows.select(doc, (F.col("k") + 1).alias("rank"), F.col("x.sent_id").alias("sent_id"), (-F.col("x.less")).alias("score"))


def dense_retrieve(vectors: DataFrame, query: list[float], *, key: str = "vec_id", vector: str = "embedding", limit: int = 3) -> DataFrame:
    """(key, score) of the limit largest dot products, the best last; equal ones by key. Each task keeps its own best only."""
    if limit <= 0:
        raise ValueError("a positive limit")
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(F.col(vector), q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, b: a + b)
    return vectors.select(key, F.round(dot, 6).alias("score")).orderBy(F.desc("score"), key).limit(limit).orderBy("score", F.desc(key))


def dense_retrieve_all(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", limit: int = 3, tile: int = 4096) -> DataFrame:
    """(query_id, rank, key, score): every row's vector as a query, with the limit largest dot products over all rows, its own too, the best at rank 1; equal ones by key.

    Rows are written once, in files of about `tile` rows; a task meets some of a file's rows with every file in
    turn and keeps what is among their best. Work, and what is read from the shared folder, grow with
    the square of the rows; memory doesn't, and what is shuffled are the rows and their best. Rows without a vector don't count.
    """
    from pyarrow import fs
    from pyarrow import parquet as pq

    if limit <= 0:
        raise ValueError("a positive limit")
    spark = vectors.sparkSession
    own = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    rows = written(own.repartition(max(1, math.ceil(own.count() / tile))), "vectors")
    files = sorted(rows.inputFiles())
    shares = min(math.ceil(4 * spark.sparkContext.defaultParallelism / max(len(files), 1)), math.ceil(tile / 256))
    tasks = spark.range(0, len(files) * shares, 1, max(1, len(files) * shares))

    def read(file: str) -> tuple[pa.Array, np.ndarray]:
        store, path = fs.FileSystem.from_uri(file)
        with store.open_input_file(path) as f:
            table = pq.read_table(f, columns=["id", "v"])
        v = table.column("v").combine_chunks()
        return table.column("id").combine_chunks(), v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1 if len(v) else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                asked, q = read(files[k // shares])
                asked, q = asked.take(pa.array(np.arange(len(asked))[k % shares :: shares])), q[k % shares :: shares]
                if not len(q):
                    continue
                ids, x, y, score, least, met = [asked.slice(0, 0)], np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.full(len(q), -np.inf), 0
                for file in files:
                    more, d = read(file)
                    if not len(d):
                        continue
                    found = [(x, y, score)]
                    for a in range(0, len(q), 256):
                        s = q[a : a + 256] @ d.T
                        low = least[a : a + 256]
                        if np.isinf(low).any() and limit < s.shape[1]:  # nothing to go by yet
                            low = np.maximum(low, np.partition(s, -limit, 1)[:, -limit] - 2e-6)
                        i, j = np.nonzero(s >= low[:, None])
                        found.append((a + i, met + j, s[i, j]))
                    x, y, score = (np.concatenate(c) for c in zip(*found))
                    order = np.lexsort((-score, x))
                    x, y, score = x[order], y[order], score[order]
                    last = np.searchsorted(x, np.arange(len(q))) + limit - 1
                    full = last < np.searchsorted(x, np.arange(len(q)), "right")
                    least[full] = score[last[full]] - 2e-6  # whatever may round to as much as the last that counts
                    keep = score >= least[x]
                    x, y, score = x[keep], y[keep], score[keep]
                    at, y = np.unique(y, return_inverse=True)
                    ids = [pa.concat_arrays([*ids, more]).take(pa.array(at))]
                    met = len(at)
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(x)), ids[0].take(pa.array(y)), pa.array(score)], ["query_id", "id", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    scored = tasks.mapInArrow(run, f"query_id {kind}, id {kind}, score double").withColumn("score", F.round("score", 6))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "rank", F.col("id").alias(key), "score")


def given_topics(topics: Column, n: int) -> Column:
    """The first n of topics that are given; fewer are an error."""
    return F.when(F.size(topics) >= n, F.slice(topics, 1, n)).otherwise(F.raise_error(F.lit("fewer topics than asked for")))


def _digest(parts: Column, chosen: Column, max_chars: int | None, max_sentences: int | None) -> Column:
    """Sentences of the chosen numbers as lines in the text's order."""
    kept = F.transform(F.array_sort(F.array_distinct(chosen)), lambda k: F.get(parts, k))
    if max_sentences is not None:
        kept = F.slice(kept, 1, max_sentences)
    return cut(F.array_join(kept, "\n"), max_chars)


def topic_summary(docs: DataFrame, topics: str, *, doc: str = "doc_id", text: str = "text", limit: int = 3, max_chars: int | None = None, max_sentences: int | None = None) -> DataFrame:
    """(doc, summary): for each topic of a row's array the sentences that have most of its words, together in the text's order, as lines.

    With max_chars, the limit for a topic is max_chars over the number of topics, plus 1, and
    the summary is cut after max_chars signs. Rows without a topic or a hit have no row. A
    document is summarised in its row: nothing is shuffled, and topics that are a function of
    the text are found once.
    """
    if max_chars is not None and max_chars <= 0:
        raise ValueError("max_chars is positive")
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, split = regex.compile(WORD).findall, regex.compile(SENTENCE).findall
        for batch in batches:
            at, out = [], []
            for a in range(0, len(batch), 128):
                rows = zip(*(batch.column(c).slice(a, 128).to_pylist() for c in ("text", "topics")))
                for k, (t, asked) in enumerate(rows, a):
                    if t is None or not asked or None in asked:
                        continue
                    parts = [y for x in split(t) if (y := x.strip("\n\t "))] if isinstance(t, str) else t
                    most = limit if max_chars is None else max_chars // len(asked) + 1
                    if chosen := _topic_sentences(parts, [find(x) for x in asked], most, find):
                        at.append(k)
                        out.append("\n".join(parts[i] for i in chosen[:max_sentences])[:max_chars])
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(at, pa.int64())), pa.array(out, pa.string())], [doc, "summary"])

    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"), F.col(topics).alias("topics"))
    return rows.mapInArrow(run, f"`{doc}` {kind}, summary string")


def _topic_sentences(parts: list[str | None], topics: list[list[str]], most: int, find) -> list[int]:
    """Numbers, in order, of the sentences that rank among the most for some topic's words, as by _best_sentences."""
    asked = {w for words in topics for w in words}
    there: dict[str, dict[int, int]] = {w: {} for w in asked}
    for k, s in enumerate(parts):
        own = find(s) if s is not None else []
        for w in asked.intersection(own):
            there[w][k] = own.count(w)
    chosen: set[int] = set()
    for words in topics:
        score, first = Counter(), {}
        for j, w in enumerate(words):
            for k, c in there[w].items():
                score[k] += c
                first.setdefault(k, j)
        chosen.update(heapq.nsmallest(most, score, key=lambda k: (-score[k], first[k], k)))
    return sorted(chosen)


Encoder = Callable[[list[str]], np.ndarray]


def encoded(text: Column | str, encoder: Encoder, *, batch: int = 32) -> Column:
    """array<float> of texts by any function of a list of at most `batch` texts to their vectors; null for null. None is shipped."""

    @F.arrow_udf("array<float>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(_vectors(texts.to_pylist(), encoder, batch), pa.list_(pa.float32()))

    return run(F.col(text) if isinstance(text, str) else text)


def _vectors(texts: list[str | None], encoder: Encoder, batch: int) -> list[np.ndarray | None]:
    out: list[np.ndarray | None] = [None] * len(texts)
    there = [i for i, t in enumerate(texts) if t is not None]
    for a in range(0, len(there), batch):
        for i, v in zip(there[a : a + batch], encoder([texts[i] for i in there[a : a + batch]])):
            out[i] = np.asarray(v, np.float32)
    return out


def dense_topic_sentences(parts: Column, topics: Column, encoder: Encoder, *, limit: Column | int = 3, batch: int = 32) -> Column:
    """array<int>: for each topic the numbers of the sentences whose vectors have the largest dot products with the topic's, the earlier of equals."""

    @F.arrow_udf("array<int>")
    def run(sents: pa.Array, asked: pa.Array, most: pa.Array) -> pa.Array:
        out = []
        for s, t, k in zip(sents.to_pylist(), asked.to_pylist(), most.to_pylist()):
            if not s or not t:
                out.append([])
                continue
            v = _vectors([*s, *t], encoder, batch)
            scores = np.round(np.stack(v[len(s) :]).astype(float) @ np.stack(v[: len(s)]).astype(float).T, 6)
            out.append([int(i) for row in scores for i in np.lexsort((np.arange(len(s)), -row))[:k]])
        return pa.array(out, pa.list_(pa.int32()))

    return run(parts, topics, F.lit(limit).cast("int") if isinstance(limit, int) else limit.cast("int"))


#: Topics of a text by name: functions of (text, how many) to an array of strings.
EXTRACTORS: dict[str, Callable[[Column, int], Column]] = {"keyphrases": lambda text, n: F.transform(keyphrases(text, top=n), lambda x: x["phrase"])}
RETRIEVERS = ("frequency", "dense")


@dataclass(frozen=True)
class Summarizer:
    """Topics of a text, then the sentences that a retriever finds for each, in the text's order.

    extractor: a name of EXTRACTORS, a function of (text, n) as those, or an array column of
    given topics, of which n are taken. retriever: 'frequency' counts words, 'dense' compares
    vectors of the encoder.
    """

    extractor: str | Column | Callable[[Column, int], Column] = "keyphrases"
    retriever: str = "frequency"
    n_topics: int = 5
    encoder: Encoder | None = None

    def __post_init__(self) -> None:
        if isinstance(self.extractor, str) and self.extractor not in EXTRACTORS:
            raise ValueError(f"extractor must be one of {sorted(EXTRACTORS)}, a function or a column")
        if self.retriever not in RETRIEVERS:
            raise ValueError(f"retriever must be one of {RETRIEVERS}")
        if (self.retriever == "dense") != (self.encoder is not None):
            raise ValueError("an encoder belongs to the dense retriever, and only to it")

    def topics(self, text: Column) -> Column:
        if isinstance(self.extractor, Column):
            return given_topics(self.extractor, self.n_topics)
        return (EXTRACTORS[self.extractor] if isinstance(self.extractor, str) else self.extractor)(text, self.n_topics)

    def summarize(self, docs: DataFrame, *, doc: str = "doc_id", text: str = "text", limit: int = 3, max_chars: int | None = None, max_sentences: int | None = None) -> DataFrame:
        """(doc, summary), see topic_summary. Texts without a topic have no row."""
        own = docs.select(F.col(doc).alias(doc), F.col(text).alias("__text"), self.topics(F.col(text)).alias("__topics"))
        if self.retriever == "frequency":
            return topic_summary(own, "__topics", doc=doc, text="__text", limit=limit, max_chars=max_chars, max_sentences=max_sentences)
        if max_chars is not None and max_chars <= 0:
            raise ValueError("max_chars is positive")
        n = F.size("__topics")
        most = F.floor(F.lit(max_chars) / F.when(n > 0, n)) + 1 if max_chars is not None else F.lit(limit)
        rows = own.where(n > 0).select(doc, _sentences("__text").alias("__parts"), "__topics", most.alias("__most"))
        rows = rows.withColumn("__at", dense_topic_sentences(F.col("__parts"), F.col("__topics"), self.encoder, limit=F.col("__most")))
        return rows.where(F.size("__at") > 0).select(doc, _digest(F.col("__parts"), F.col("__at"), max_chars, max_sentences).alias("summary"))


def keyphrase_scores(text: str, top: int, max_ngram: int, find=None, split=None) -> list[tuple[str, float]]:
    """As keyphrases_of, for one text."""
    return keyphrases_of([text], top, max_ngram)[0]


def keyphrases_of(texts: list[str], top: int, max_ngram: int = 3) -> list[list[tuple[str, float]]]:
    """Statistical keyphrases (Campos et al., 2020): lower is better.

    A word's weight is of its casing, place, frequency, company and spread over sentences; a
    phrase's is the product of its words' by how often it comes. Words of fewer than three
    letters begin and end no phrase. All texts are counted together; only what may be among
    the best is scored one by one, so that its score has the rounding of plain floats.
    """
    import regex

    find = regex.compile(r"[\p{L}\p{N}]+|[.!?]+").findall
    raw, doc, words = numbered([find(t) for t in texts])
    # A run of full stops ends a sentence, but for one that begins the text; what follows the last is one unless blank.
    stop = np.array([w[0] in ".!?" for w in words], bool)[raw]
    ended, stops = np.cumsum(stop) - stop, np.bincount(doc, stop, len(texts)).astype(np.int64)
    lead = np.array([t[:1] in (".", "!", "?") for t in texts], np.int64)
    n_parts = stops - lead + [bool(t[max(t.rfind("."), t.rfind("!"), t.rfind("?")) + 1 :].strip()) for t in texts]
    part = (ended - (np.cumsum(stops) - stops + lead)[doc])[~stop]
    raw, doc = raw[~stop], doc[~stop]
    low, _, terms = numbered([[w.lower() for w in words]])
    upper, capital = np.array([w.isupper() and len(w) > 1 for w in words], bool)[raw], np.array([w[:1].isupper() for w in words], bool)[raw]
    long, low = np.array([len(t) > 2 for t in terms], bool), low[raw]
    if not len(low):
        return [[] for _ in texts]

    rank, first, tf = ranked(doc * len(terms) + low)  # a number for each word of each text, in the order of the texts
    n, own, width = len(first), doc[first], int(part.max()) + 1
    left = room(doc * width + part)
    inner = np.empty(len(low), bool)
    inner[0], inner[1:] = False, left[:-1] > 1
    cased = np.bincount(rank, upper | (inner & capital), n).astype(np.int64)
    places = distinct(rank * width + part)
    spread = np.bincount(places // width, minlength=n)
    start, places = np.cumsum(spread) - spread, places % width
    middle = (places[start + (spread - 1) // 2] + places[start + spread // 2]) / 2
    after = np.flatnonzero(inner)
    pairs = distinct(rank[after] * n + rank[after - 1])
    company = [(np.bincount(pairs // n, minlength=n), np.bincount(rank[after], minlength=n)), (np.bincount(pairs % n, minlength=n), np.bincount(rank[after - 1], minlength=n))]
    bounds, valid = np.searchsorted(own, np.arange(len(texts) + 1)), long[low[first]]
    usual, top_tf = np.ones(len(texts)), np.ones(len(texts), np.int64)
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
        counts = tf[a:b][valid[a:b]]
        if len(counts):
            mean = int(counts.sum()) / len(counts)
            usual[k], top_tf[k] = mean + math.sqrt(sum(((counts - mean) ** 2).tolist()) / len(counts)), tf[a:b].max()

    def weigh(log, cased, tf, middle, usual, top_tf, spread, n_parts, *company):
        casing, place, frequency = cased / (1 + log(tf)), log(log(3 + middle)), tf / usual
        near = 1 + (company[0] / company[1] + company[2] / company[3]) * tf / top_tf
        return place * near / (casing + frequency / near + spread / n_parts / near)

    features = [cased, tf, middle, usual[own], top_tf[own], spread, n_parts[own], company[0][0], np.maximum(company[0][1], 1), company[1][0], np.maximum(company[1][1], 1)]
    weight = weigh(np.log, *features)
    found = []
    for size, at, count in grams(rank, left, max_ngram):
        keep = long[low[at]] & long[low[at + size - 1]]
        at, count = at[keep], count[keep]
        ws = [weight[rank[at + k]] for k in range(size)]
        found.append((at, count, math.prod(ws) / (count * (1 + sum(ws))), np.searchsorted(doc[at], np.arange(len(texts) + 1))))
    likely: list[list[tuple[int, int, int]]] = []
    for k in range(len(texts)):
        scores = [score[b[k] : b[k + 1]] for _, _, score, b in found]
        every = np.concatenate(scores)
        most = (np.partition(every, top - 1)[top - 1] * (1 + 1e-9) + 2e-9) if len(every) > top else np.inf  # whatever may round to as little as the last that counts
        likely.append([])
        for size, (score, (at, count, _, b)) in enumerate(zip(scores, found), 1):
            x = np.flatnonzero(score <= most) + b[k]
            likely[-1] += [(i, size, c) for i, c in zip(at[x].tolist(), count[x].tolist())]
    need = sorted({t for own in likely for i, size, _ in own for t in rank[i : i + size].tolist()})
    exact = {t: weigh(math.log, *f) for t, *f in zip(need, *(f[need].tolist() for f in features))}
    out = []
    for own in likely:
        scored = []
        for i, size, c in own:
            ws = [exact[t] for t in rank[i : i + size].tolist()]
            scored.append((round(math.prod(ws) / (c * (1 + sum(ws))), 9), " ".join(terms[j] for j in low[i : i + size].tolist())))
        out.append([(p, s) for s, p in sorted(scored)[:top]])
    return out


def keyphrases(text: Column | str, *, top: int = 5, max_ngram: int = 3) -> Column:
    """array<struct(phrase, score)>, the best first. A narrow pass over some texts at a time."""

    @F.arrow_udf("array<struct<phrase:string,score:double>>")
    def run(texts: pa.Array) -> pa.Array:
        found = []
        for _, some in text_slices(texts):
            own = iter(keyphrases_of([t for t in some if t is not None], top, max_ngram))
            found += [None if t is None else next(own) for t in some]
        rows = [x for own in found for x in own or ()]
        flat = pa.StructArray.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([s for _, s in rows], pa.float64())], ["phrase", "score"])
        sizes = np.cumsum([0, *(len(own or ()) for own in found)])
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat, mask=pa.array([own is None for own in found], pa.bool_()))

    return run(F.col(text) if isinstance(text, str) else text)


def position_weighted_keyphrases(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", top: int = 10, least: int = 2, cutoff: int = 400, max_ngram: int = 3, alpha: float = 2.3, sigma: float = 3.0) -> DataFrame:
    """(doc, rank, phrase, score): phrases seen at least `least` times and first within `cutoff` words, by tf idf, with a boost for longer ones.

    That a phrase which first comes after 400 words is none is part of the published method
    (El-Beltagy and Rafea, 2009); whole texts are counted.
    """
    kind = docs.schema[doc].dataType.simpleString()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder()
        for batch in batches:
            for row, some in text_slices(batch.column("text")):
                ids, doc, words = numbered([find(t or "") for t in some])
                keep = np.array([w[0].isalnum() for w in words], bool)[ids]
                low, _, terms = numbered([[w.lower() for w in words]])
                low, doc, long = low[ids[keep]], doc[keep], np.array([len(t) > 2 for t in terms], bool)
                rank, start = ranked(doc * len(terms) + low)[0], np.searchsorted(doc, np.arange(len(some)))
                for n, at, count in grams(rank, room(doc), max_ngram):
                    first = at - start[doc[at]]
                    keep = long[low[at]] & long[low[at + n - 1]] & (count >= least) & (first < cutoff)
                    at, count, first = at[keep], count[keep], first[keep]
                    phrases = [" ".join(terms[j] for j in low[i : i + n].tolist()) for i in at.tolist()]
                    own = [batch.column("doc").take(pa.array(row + doc[at])), pa.array(phrases, pa.string()), pa.array(np.full(len(at), n), pa.int32()), pa.array(first, pa.int32()), pa.array(count, pa.int64())]
                    yield pa.RecordBatch.from_arrays(own, ["doc", "phrase", "words", "first", "tf"])

    found = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).mapInArrow(spread, f"doc {kind}, phrase string, words int, first int, tf long")
    found = written(found, "phrases")  # a pass over the texts in Python, whose rows are used three times
    total = docs.agg(F.count("*").alias("__total"))
    df = found.groupBy("phrase").agg(F.count("*").alias("df"))
    boost = found.groupBy("doc").agg(F.least(F.lit(sigma), F.count("*") / (F.greatest(F.count_if(F.col("words") > 1), F.lit(1)) * alpha)).alias("boost"))
    scored = found.join(df, "phrase").join(boost, "doc").crossJoin(F.broadcast(total))
    idf = F.when(F.col("words") == 1, F.log2(F.col("__total") / F.col("df"))).otherwise(F.log2(F.col("__total")) * 1.0)
    score = F.round(F.col("tf") * idf * F.when(F.col("words") > 1, F.col("boost")).otherwise(F.lit(1.0)), 6)
    rank = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("score"), "first", "phrase"))
    return scored.withColumn("score", score).withColumn("rank", rank).where(F.col("rank") <= top).select(F.col("doc").alias(doc), "rank", "phrase", "score")
