import numpy as np
import pytest
from pyspark.sql import functions as F

from condensa.functions.text import sentences
from condensa.operators import alignment as A
from condensa.operators import baselines as B
from condensa.operators import documents as D
from condensa.operators import retrieval as R
from condensa.operators import significance as S
from condensa.operators import statistics as T

REF = ["Ein längerer Inhalt.", "Er besteht aus mehreren Tests.", "Das ist ein Test."]


def aligned(spark, summary, source, match, **options):
    df = spark.createDataFrame([(summary, source)], "a array<string>, b array<string>")
    return df.select(match(F.col("a"), F.col("b"), **options).alias("m")).first()["m"]


def test_exact_match_comes_first(spark):
    assert [m.relative_position for m in aligned(spark, ["Das ist ein Test."], REF, A.closest_matches)] == [1.0]
    assert [m.relative_position for m in aligned(spark, ["Das ist ein Test."], REF[2:], A.closest_matches)] == [0.0]


def test_best_rouge_match(spark):
    (m,) = aligned(spark, ["Er besteht aus mehreren merkwürdigen Tests"], REF, A.rouge_matches)
    assert (m.sentence, m.relative_position) == (REF[1], 0.5) and m.metric == pytest.approx(0.6)


def test_no_shared_gram_is_the_first_sentence_and_no_source_nothing(spark):
    (m,) = aligned(spark, ["Ganz etwas anderes"], REF, A.rouge_matches)
    assert (m.source_pos, m.metric) == (0, 0.0)
    assert aligned(spark, ["x"], [], A.rouge_matches) == []
    assert aligned(spark, None, REF, A.rouge_matches) is None
    with pytest.raises(ValueError):
        A.rouge_matches(F.col("a"), F.col("b"), attribute="f2")


def test_larger_n_is_used_on_both_sides(spark):
    (m,) = aligned(spark, [REF[1]], REF, A.rouge_matches, n=3)
    assert m.source_pos == 1 and m.metric == 1.0


def test_greedy_takes_what_adds(spark):
    source = ["Something else entirely here.", "the red fox", "jumps over the dog"]
    assert aligned(spark, ["the red fox jumps over the dog"], source, A.greedy_matches) == [2, 1]
    assert aligned(spark, ["nothing shared"], source, A.greedy_matches) == []


def test_vectors(spark):
    a = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.0, 1.0])], "d long, p int, v array<double>")
    b = spark.createDataFrame([(1, 0, [0.0, 2.0]), (1, 1, [3.0, 0.0]), (1, 2, [5.0, 0.0])], "d long, p int, v array<double>")
    (r,) = A.vector_matches(a, b, doc="d", pos="p", vector="v").collect()
    assert (r.doc, r.source_pos, r.metric) == (1, 1, 1.0) and r.relative_position == pytest.approx(1 / 3)


S5 = ["Rain fell on the old harbour.", "Boats lay tied to the harbour wall.", "The wall is older than the boats.", "Gulls slept on the boats all night.", "Nobody saw the rain stop."]


@pytest.mark.parametrize("k", [2, 3, 4, 9])
def test_lead(spark, k):
    df = spark.createDataFrame([(S5,)], "s array<string>")
    assert df.select(B.lead(F.col("s"), k)).first()[0] == " ".join(S5[:k])
    with pytest.raises(Exception, match="no sentences"):
        df.select(B.lead(F.array().cast("array<string>"), k)).collect()


def test_lexrank(spark):
    df = spark.createDataFrame([(S5,), ([],), (None,), (["One."],)], "s array<string>")
    out = [r[0] for r in df.select(B.lexrank(F.col("s"), k=2)).collect()]
    assert len(out[0].split(". ")) == 2 and set(out[0].split(". ")) <= {x for t in S5 for x in (t, t[:-1])} and out[1] == "" and out[2] is None and out[3] == "One."
    assert all(len(r[0]) <= 60 for r in df.where("s IS NOT NULL").select(B.lexrank(F.col("s"), max_length=60)).collect())
    with pytest.raises(ValueError):
        B.lexrank(F.col("s"))


def test_stationary_distribution_is_one():
    rng = np.random.default_rng(0)
    m = B.markov_matrix(rng.random((6, 6)) + 0.1)
    v = B.stationary(m)
    assert np.allclose(v @ m, v) and v.sum() == pytest.approx(1)
    block = np.zeros((4, 4))
    block[:2, :2] = block[2:, 2:] = 0.5
    assert np.allclose(B.stationary(block), 0.5)


def test_index_and_retrieval(spark):
    docs = spark.createDataFrame([(1, "The cat sat. The dog ran after the cat. Birds sing."), (2, "Nothing here.")], "doc_id long, text string")
    rows = R.sentence_rows(docs)
    assert {(r.term, r.sent_id, r.tf) for r in R.postings(rows).where("doc_id = 1 AND term IN ('The', 'cat')").collect()} == {("The", 0, 1), ("The", 1, 1), ("cat", 0, 1), ("cat", 1, 1)}
    assert [(r["rank"], r.sent_id, r.score) for r in R.frequency_retrieve(docs, "cat dog").collect()] == [(1, 1, 2), (2, 0, 1)]
    assert [r.sent_id for r in R.frequency_retrieve(docs, "dog Birds cat cat", limit=2).collect()] == [1, 0]
    assert R.frequency_retrieve(docs, "cat unheard", strict=True).count() == 0 and R.frequency_retrieve(docs, "cat dog", strict=True).count() == 2
    for query, limit in (("", 3), ("cat", 0)):
        with pytest.raises(ValueError):
            R.frequency_retrieve(docs, query, limit=limit)
    for plan in (R.frequency_retrieve(docs, "cat dog"), R.topic_summary(docs.withColumn("t", F.array(F.lit("dog"))), "t"), R.postings(rows)):
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    own = docs.withColumn("t", F.array(F.lit("Birds"), F.lit("dog")))
    assert R.topic_summary(own, "t").first().summary == "The dog ran after the cat.\nBirds sing."
    assert R.topic_summary(own, "t", max_chars=7).first().summary == "The dog"
    assert R.topic_summary(own, "t", max_sentences=1).first().summary == "The dog ran after the cat."


def test_topics_given(spark):
    df = spark.createDataFrame([(["a", "b"],)], "t array<string>")
    assert df.select(R.given_topics(F.col("t"), 1)).first()[0] == ["a"]
    with pytest.raises(Exception, match="fewer"):
        df.select(R.given_topics(F.col("t"), 3)).collect()


def test_keyphrases(spark):
    text = "Suffix arrays sort suffixes. A suffix array is compact. Suffix arrays help search."
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    out = [r[1] for r in df.select("doc_id", R.keyphrases("text", top=3)).orderBy("doc_id").collect()]
    assert "suffix" in out[0][0].phrase and out[1] == [] and out[2] is None
    assert R.position_weighted_keyphrases(df).where("doc_id = 1").orderBy("rank").first().phrase.startswith("suffix")


def test_dense_retrieval_has_the_best_last(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in R.dense_retrieve(df, [1.0, 0.0], limit=2).collect()] == [3, 4]


@pytest.mark.parametrize("tile", [7, 4096])
def test_dense_retrieval_of_every_row(spark, tile):
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (40, 4)).astype(float)  # with ties
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(40, None)], "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in R.dense_retrieve_all(df, tile=tile).collect()}
    s = v @ v.T
    assert got == {(i, k + 1): (int(j), s[i, j]) for i in range(40) for k, j in enumerate(np.lexsort((np.arange(40), -s[i]))[:3])}
    assert R.dense_retrieve_all(df.limit(0)).count() == 0 and R.dense_retrieve_all(df.where("vec_id < 2"), tile=1).count() == 4


def test_paragraphs(spark):
    lines = ["= Title", "a", "b", "", "c", "= Next", "= Third", "d"]
    df = spark.createDataFrame([(lines,)], "l array<string>")
    got = lambda **o: df.select(D.paragraphs("l", **o).alias("p")).first().p
    assert spark.createDataFrame([([],), (["", "="],), (None,)], "l array<string>").select(D.paragraphs("l").alias("p")).collect() == [([],), ([],), (None,)]
    assert got() == [["a", "b"], ["c"], ["d"]]
    assert got(closed_only=True) == [["a", "b"], ["c"]]


def test_document(spark):
    df = spark.createDataFrame([("Dies sind zwei kurze Sätze. Mehr steht in diesem Text nicht drin.",)], "t string")
    d = df.select(D.document("t").alias("d")).first().d
    assert len(d.sentences) == 2 and d.text_lang == "de" and d.sentences[0].lemmas[0] == "dies"


def votes(spark, n=64, same=False):
    rng = np.random.default_rng(54)
    gold, a, b = rng.integers(0, 5, n), rng.integers(0, 4, n), rng.integers(0, 4, n)
    return spark.createDataFrame([(i, int(g), int(x), int(x if same else y)) for i, (g, x, y) in enumerate(zip(gold, a, b))], "pos long, gold int, a int, b int")


@pytest.mark.parametrize("score", [S.accuracy, S.pearson])
def test_significance(spark, score):
    for same in (False, True):
        boot, perm = S.paired_bootstrap(votes(spark, same=same), score, n_resamples=100).first(), S.permutation(votes(spark, same=same), score, n_resamples=100).first()
        assert 0 <= boot.p <= 1 and 1 / 101 <= perm.p + 1e-6 <= 1 + 1e-6
        if same:
            assert boot.p == 1 and perm.p == 1


def test_any_scorer_and_lengths(spark):
    assert S.resample_with(votes(spark), lambda s, g: (s == g).mean(), n_resamples=20).count() == 20
    with pytest.raises(ValueError):
        S.checked_rows([1], [1, 2], [1])


def test_all_words_of_long_turns_attend(spark, tmp_path):
    from condensa.queries import QUERIES

    turns = [(1, 0, "a " * 300), (1, 1, "!"), (1, 2, "b " * 9), (1, 3, "c " * 40), (2, 0, "one")]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.doc, r.out_sent, r.in_sent): r for r in QUERIES["attention_block_sum"](spark, str(tmp_path)).collect()}
    spans = {0: range(300), 2: range(300, 309), 3: range(309, 349)}
    want = {(1, x, y): sum((i * 7 + j * 3) % 11 for i in spans[x] for j in spans[y]) for x in spans for y in spans}
    assert {k: r.weight for k, r in got.items()} == want | {(2, 0, 0): 0} and got[2, 0, 0].share is None
    for y in spans:
        of = {x: want[1, x, y] for x in spans}
        assert [x for x in spans if got[1, x, y].is_max] == [max(of, key=of.get)]
        assert all(got[1, x, y].share == pytest.approx(w / sum(of.values()), abs=1e-6) for x, w in of.items())


def test_histogram_has_its_right_edge(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.0,)], "relative_position double")
    assert {(r.bin, r.n) for r in T.position_histogram(df, F.lit(4)).collect()} == {(0, 1), (2, 1), (3, 2)}


def test_sentences_of_nothing(spark):
    assert spark.createDataFrame([("",), (None,)], "t string").select(sentences("t").alias("s")).collect()[0].s == []
