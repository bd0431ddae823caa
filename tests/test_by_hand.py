"""Queries that SQL doesn't state, against brute force over the smallest tables or a fixture."""

import math
import os
import re

import numpy as np
import pytest

from condensa.queries import QUERIES

DATA = "/root/testdata/sf0.001"

needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def sentences_of(text):
    return [x for x in (s.strip("\n\t ") for s in re.findall(r"[^.!?]+[.!?]*", text)) if x]


def letters(text):
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", text)


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def turns(spark):
    rows = sorted((r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect())
    return [(a[0], a[1], a[3], b[3]) for a, b in zip(rows, rows[1:]) if a[0] == b[0] and a[2] == "user" and b[2] == "assistant"]


def central(parts):
    """Order by the walk's eigenvector, from the matrix as a whole."""
    if not parts:
        return []
    words = sorted({w.lower() for s in parts for w in letters(s)})
    counts = np.array([[[w.lower() for w in letters(s)].count(x) for x in words] or [0] for s in parts], float)
    v = counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)
    s = v @ v.T
    p = np.exp(s) / np.exp(s).sum(1, keepdims=True) if s.min() <= 0 else s / s.sum(1, keepdims=True)
    values, vectors = np.linalg.eig(p.T)
    x = np.real(vectors[:, np.argmax(np.real(values))])
    return list(x / x.sum())


@needs_tables
def test_central_sentences(spark, documents):
    got = {r.doc_id: r.summary for r in QUERIES["lexrank_st"](spark, DATA).collect()}
    most = {r.doc_id: r.summary for r in QUERIES["lexrank_max_length"](spark, DATA).collect()}
    assert set(got) == set(most) == set(documents)
    few = [d for d, t in documents.items() if len(sentences_of(t)) <= 40]
    assert len(few) > 50
    for d in few:
        parts = sentences_of(documents[d])
        scores = central(parts)
        order = sorted(range(len(parts)), key=lambda i: (-round(scores[i], 7), i))
        clear = len({round(x, 7) for x in scores}) == len(scores)
        if clear:
            assert got[d] == " ".join(parts[i] for i in order[:3])
            text = ""
            for i in order:
                if len(text) + len(parts[i]) > 200:
                    break
                text += parts[i] + " "
            assert most[d] == text.strip(" ")


@needs_tables
def test_central_sentences_by_the_mean_ratio(spark, documents):
    first = {d: (sentences_of(t) or [""])[0] for d, t in documents.items()}
    ratio = np.mean([len(sentences_of(t)) / len(sentences_of(first[d])) for d, t in documents.items() if sentences_of(t) and sentences_of(first[d])])
    for r in QUERIES["lexrank_dynamic"](spark, DATA).collect():
        parts = sentences_of(documents[r.doc_id])
        k = max(1, round(len(parts) / ratio))
        scores = central(parts) if len(parts) <= 40 else None
        if scores and len({round(x, 7) for x in scores}) == len(scores):
            order = sorted(range(len(parts)), key=lambda i: -scores[i])
            assert r.summary == " ".join(parts[i] for i in order[:k])


@pytest.mark.parametrize("n", [1, 2, 7, 60])
@pytest.mark.parametrize("threshold", [None, 0.2])
def test_a_walk_in_slices_is_that_of_the_matrix(n, threshold):
    from condensa.operators import baselines as B

    v = B.unit(np.random.default_rng(n).random((n, 5)) - 0.3)
    want = B.centrality(v @ v.T, threshold)
    for cells in (1, 3 * n, 10**6):
        assert np.allclose(B.walk_centrality(B.Given(v), threshold, cells=cells), want, atol=1e-6)


@pytest.mark.parametrize("cells", [1, 40, 10**6])
def test_counts_of_words_are_vectors(cells):
    from condensa.operators import baselines as B

    rng = np.random.default_rng(3)
    parts = [" ".join(rng.choice(list("abcdefg"), rng.integers(0, 9))) for _ in range(30)] + ["", "A a b"]
    words = B.WordCounts(parts, letters)
    counts = np.array([[p.lower().split().count(x) for x in "abcdefg"] for p in parts], float)
    v = counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)
    assert np.allclose(words.likeness(0, 32), v @ v.T) and np.allclose(words.likeness(5, 9), v[5:9] @ v.T)
    assert np.allclose(B.walk_centrality(words, cells=cells), B.walk_centrality(B.Given(v)), atol=1e-9)
    assert B.central_order(B.WordCounts([], letters)) == [] and B.central_order(B.WordCounts([""], letters)) == [0]


def test_vectors_may_be_given(spark):
    from pyspark.sql import functions as F

    from condensa.operators import baselines as B

    parts, v = ["a", "b", "c"], [[1.0, 0.1], [1.0, 0.0], [0.0, 1.0]]
    df = spark.createDataFrame([(parts, v), (parts, None), (None, None)], "s array<string>, v array<array<double>>")
    rows = [r[0] for r in df.select(B.lexrank(F.col("s"), k=2, vectors=F.col("v"))).collect()]
    x = B.unit(np.array(v))
    want = np.argsort(-B.centrality(x @ x.T), kind="stable")[:2]
    assert rows == [" ".join(parts[i] for i in want), "a b", None]


def phrases_by_hand(text, top, longest=3):
    parts = [letters(s) for s in re.findall(r"[^.!?]+[.!?]*", text) if s.strip()]
    every = [w.lower() for p in parts for w in p]
    distinct = list(dict.fromkeys(every))
    long_ones = [every.count(t) for t in distinct if len(t) > 2]
    if not long_ones:
        return []
    mean, most = sum(long_ones) / len(long_ones), max(every.count(t) for t in distinct)
    std = math.sqrt(sum((c - mean) ** 2 for c in long_ones) / len(long_ones))
    weight = {}
    for t in distinct:
        n = every.count(t)
        at = [k for k, p in enumerate(parts) if t in [w.lower() for w in p]]
        upper = sum(w.lower() == t and ((w.isupper() and len(w) > 1) or (i > 0 and w[0].isupper())) for p in parts for i, w in enumerate(p))
        left = [p[i - 1].lower() for p in parts for i, w in enumerate(p) if i and w.lower() == t]
        right = [p[i + 1].lower() for p in parts for i, w in enumerate(p) if i + 1 < len(p) and w.lower() == t]
        place, casing, frequency = math.log(math.log(3 + np.median(at))), upper / (1 + math.log(n)), n / (mean + std)
        company = 1 + (len(set(left)) / max(len(left), 1) + len(set(right)) / max(len(right), 1)) * n / most
        weight[t] = place * company / (casing + frequency / company + len(at) / len(parts) / company)
    counts = {}
    for p in parts:
        for n in range(1, longest + 1):
            for i in range(len(p) - n + 1):
                g = tuple(w.lower() for w in p[i : i + n])
                if len(g[0]) > 2 and len(g[-1]) > 2:
                    counts[g] = counts.get(g, 0) + 1
    scored = sorted((round(math.prod(weight[t] for t in g) / (c * (1 + sum(weight[t] for t in g))), 9), " ".join(g)) for g, c in counts.items())
    return scored[:top]


TEXTS = [
    "Suffix arrays sort suffixes. A suffix array is compact. Suffix arrays help search! NATO and Rome met in Rome. The rain fell", "", "a b. c", "One word only: harbour harbour HARBOUR. Old harbour, new Harbour walls.",
    "Boats lay tied. Boats sank. Gulls slept on boats all night, all night long. Nobody saw the boats",
]


def test_keyphrases_by_hand(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in QUERIES["yake_extract"](spark, str(tmp_path)).collect():
        assert [(p.score, p.phrase) for p in r.phrases] == [(pytest.approx(s, abs=2e-9), p) for s, p in phrases_by_hand(TEXTS[r.doc_id], 5)]


def digest_by_hand(text, topics, limit=3):
    parts, chosen = sentences_of(text), set()
    for t in topics:
        words = letters(t)
        score = [sum(letters(s).count(w) for w in words) for s in parts]
        first = [min((k for k, w in enumerate(words) if w in letters(s)), default=99) for s in parts]
        chosen |= set(sorted((i for i in range(len(parts)) if score[i]), key=lambda i: (-score[i], first[i], i))[:limit])
    return "\n".join(parts[i] for i in sorted(chosen))


def test_digests_by_keyphrases(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.summary for r in QUERIES["summarize_by_keyphrases"](spark, str(tmp_path)).collect()}
    want = {i: digest_by_hand(t, [p for _, p in phrases_by_hand(t, 5)]) for i, t in enumerate(TEXTS)}
    assert got == {i: x for i, x in want.items() if x}


def test_summarizers_by_name_function_and_column(spark):
    from pyspark.sql import functions as F

    from condensa.operators.retrieval import Summarizer, encoded

    text = "The cat sat. The dog ran after the cat. Birds sing."
    df = spark.createDataFrame([(1, text, ["Birds", "dog"]), (2, None, ["x"]), (3, text, [])], "doc_id long, text string, t array<string>")
    one = lambda s, **o: {r.doc_id: r.summary for r in s.summarize(df.where(o.pop("only", "doc_id = 1")), **o).collect()}
    assert one(Summarizer(F.col("t"), n_topics=2)) == {1: "The dog ran after the cat.\nBirds sing."}
    assert one(Summarizer(lambda text, n: F.array(F.lit("cat"))), limit=1) == {1: "The cat sat."}
    assert one(Summarizer(lambda text, n: F.col("t")), only="doc_id > 0") == {1: "The dog ran after the cat.\nBirds sing."}
    sizes = []

    def encoder(texts):
        assert len(texts) <= 32
        return np.array([[t.count("cat"), t.count("ir") + t.count("Bird"), 1] for t in texts])

    assert one(Summarizer(F.col("t"), "dense", 1, encoder), limit=1) == {1: "Birds sing."}
    assert one(Summarizer(F.col("t"), "dense", 2, encoder), max_chars=9) == {1: "The cat s"}
    v = spark.createDataFrame([(i, f"cat {i}") for i in range(100)] + [(100, None)], "i long, s string").select(encoded("s", encoder).alias("v")).collect()
    assert [r.v for r in v] == [[1.0, 0.0, 1.0]] * 100 + [None] and not sizes
    for bad in (dict(extractor="none"), dict(retriever="none"), dict(retriever="dense"), dict(encoder=encoder)):
        with pytest.raises(ValueError):
            Summarizer(**bad)
    with pytest.raises(ValueError):
        Summarizer().summarize(df, max_chars=0)
    with pytest.raises(ValueError):
        Summarizer(F.col("t"), "dense", 1, encoder).summarize(df, max_chars=0)


@needs_tables
def test_greedy_choice(spark):
    """Each time the sentence with which the joint text of those chosen scores best, all candidates tried."""
    def grams(parts):
        import regex

        t = regex.findall(r"[\p{L}\p{N}]+|[^ \t\n\x0b\f\r\p{L}\p{N}]", " ".join(parts))
        return list(zip(t, t[1:]))

    def f(parts, target):
        own = grams(parts)
        hits = sum(min(own.count(g), target.count(g)) for g in set(own))
        p, r = hits / max(len(own), 1), hits / max(len(target), 1)
        return 2 * p * r / (p + r) if p + r else 0.0

    got = {r.id: r.chosen for r in QUERIES["greedy_aligner"](spark, DATA).collect()}
    n = 0
    for conv, turn, user, answer in turns(spark):
        source, summary = sentences_of(user), sentences_of(answer)
        if not source or not summary or len(source) > 12:
            continue
        target, chosen, score = grams(summary), [], 0.0
        while True:
            tried = [(f([source[i] for i in [*chosen, k]], target), -k) for k in range(len(source)) if k not in chosen]
            if not tried or max(tried)[0] <= score:
                break
            score, k = max(tried)
            chosen.append(-k)
        assert got[conv * 1000 + turn] == chosen
        n += len(chosen) > 0
    assert n > 5
