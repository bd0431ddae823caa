import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from condensa.functions import pairs as P
from condensa.functions.stem import cistem, rouge_scores

words = st.lists(st.sampled_from("abcd"), max_size=30)


def lcs_by_table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t


@given(words, words)
@settings(max_examples=200, deadline=None)
def test_lcs_is_that_of_the_table(a, b):
    table = lcs_by_table(a, b)
    assert P.lcs_length(a, b) == table[-1][-1]
    assert P.lcs_rows(a, b).tolist() == table


def pair(spark, summary, reference, build):
    return spark.createDataFrame([(summary, reference)], "s string, r string").select(build(F.col("s"), F.col("r")).alias("o")).first()["o"]


def test_extractive(spark):
    ref = "Hier steht ein längerer Text. Dies ist eine Zusammenfassung."
    assert pair(spark, "Dies ist eine Zusammenfassung.", ref, P.is_fully_extractive) is True
    assert pair(spark, "Dies ist keine Zusammenfassung.", ref, P.is_fully_extractive) is False
    assert pair(spark, "", ref, P.is_fully_extractive) is True


def test_longer_and_ratio(spark):
    assert pair(spark, "A slightly longer text.", "A short text.", P.is_summary_longer) is True
    assert pair(spark, "ab", "abcd", P.compression_ratio) == 2.0
    with pytest.raises(Exception):
        pair(spark, "", "abcd", P.compression_ratio)
    assert pair(spark, "", "abcd", lambda s, r: P.compression_ratio(s, r, strict=False)) is None


@pytest.mark.parametrize("n", [1, 2, 3])
def test_overlap_against_counters(spark, n):
    rng = random.Random(n)
    rows = [(i, " ".join(rng.choices("abcde", k=rng.randint(0, 12))), " ".join(rng.choices("abcde", k=rng.randint(0, 30)))) for i in range(60)] + [(99, None, "a")]
    out = {r.i: r.o for r in spark.createDataFrame(rows, "i int, s string, r string").select("i", P.gram_overlap("s", "r", n).alias("o")).collect()}
    for i, s, r in rows[:-1]:
        a, b = (Counter(zip(*(x.split()[k:] for k in range(n)))) for x in (s, r))
        assert tuple(out[i]) == ((a & b).total(), a.total(), b.total())
    assert tuple(out[99]) == (None, None, None)


def test_overlap_and_novelty_add_up_and_without_grams_are_0_and_1(spark):
    assert pair(spark, "x", "a b", lambda s, r: P.overlap_fraction(P.gram_overlap(s, r))) == 0.0
    assert pair(spark, "x", "a b", lambda s, r: P.novel_fraction(P.gram_overlap(s, r))) == 1.0


def test_rouge_of_the_known_pair(spark):
    r = pair(spark, "Er besteht aus mehreren Tests.", "Er besteht aus mehreren merkwürdigen Tests", lambda s, r: P.rouge(P.gram_overlap(s, r)))
    assert r["recall"] == pytest.approx(0.6)


def test_repetitions(spark):
    rows = spark.createDataFrame([("a b c a b c a b c",), (None,), ("",)], "t string").select(P.gram_repetitions("t").alias("o")).collect()
    assert {(x.gram, x.again) for x in rows[0].o} == {("a b c", 2), ("b c a", 1), ("c a b", 1)}
    assert rows[1].o is None and rows[2].o == []


def test_stems():
    assert cistem("Speicherbehältern") == "speicherbehalt"
    assert cistem("Grenzpostens") == "grenzpost"
    assert cistem("Ausgefeiltere") == "ausgefeilt"
    assert cistem("speicherbehältern") == "speicherbehal"


def test_rouge_l_and_identity(spark):
    o = pair(spark, "Der Hund schläft tief", "Der Hund schläft tief", rouge_scores)
    assert o["rouge1_fmeasure"] == o["rouge2_fmeasure"] == o["rougeL_fmeasure"] == 1.0


def test_rouge_is_resampled_two_thousand_times(spark, tmp_path):
    from hashlib import md5

    import numpy as np

    from condensa.functions.stem import _FIELDS, rouge_scores
    from condensa.queries import QUERIES

    said = ["der alte Hafen im Regen", "Regen im Hafen", "Boote liegen am Kai", "am Kai liegen viele Boote", "nichts davon", "ganz anderes"]
    spark.createDataFrame([(i // 2, i % 2, ("user", "assistant")[i % 2], t) for i, t in enumerate(said)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.metric: (r.low, r.mid, r.high) for r in QUERIES["bootstrap_rouge"](spark, str(tmp_path)).collect()}
    rows = [r.r for r in spark.createDataFrame(list(zip([0, 1, 2], said[1::2], said[::2])), "i int, s string, r string").orderBy("i").select(rouge_scores("s", "r").alias("r")).collect()]
    drawn = np.array([[int(md5(f"256:{k}:{p}".encode()).hexdigest()[:8], 16) % 3 for p in range(3)] for k in range(2000)])
    for f in _FIELDS:
        assert got.pop(f) == pytest.approx(np.quantile(np.array([r[f] for r in rows])[drawn].mean(1), [0.025, 0.5, 0.975]), abs=2e-6)
    assert not got


@pytest.mark.parametrize("name", ["paired_bootstrap_test", "permutation_test"])
def test_tests_have_ten_thousand_resamples(spark, tmp_path, name):
    from condensa.queries import QUERIES

    spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert QUERIES[name](spark, str(tmp_path)).first().n_resamples == 10_000


@pytest.mark.parametrize("bound", [0, 200_000])
def test_draws_meet_rows_in_either_way(spark, bound, monkeypatch):
    from condensa.operators import significance as S

    rows = spark.createDataFrame([(i, i % 3, (i * 7) % 3, (i * 5) % 4 % 3) for i in range(40)], "pos long, gold int, a int, b int")
    want = sorted(map(tuple, S.bootstrap_scores(rows, S.accuracy, 50, 1).collect()))
    monkeypatch.setattr(S, "LOOKUP_ROWS", bound)
    assert sorted(map(tuple, S.bootstrap_scores(rows, S.accuracy, 50, 1).collect())) == want
    monkeypatch.setattr(S, "ARRAY_ROWS", 39)
    with pytest.raises(ValueError, match="39"):
        S.resample_with(rows, lambda s, g: 0.0)


def test_corpus_scores_by_hand(spark, tmp_path):
    """Nine scores from lists of stems, with the table of subsequences in full."""
    from condensa.functions.stem import cistem
    from condensa.queries import QUERIES

    said = ["Der alte Hafen im Regen, im Hafen", "Regen im alten Hafen", "Boote liegen am Kai und am Kai", "am Kai liegen viele Boote am Kai", "", "ganz anderes", "Wörter mit Zahlen 12 und 12345", "12 Zahlen"]
    spark.createDataFrame([(i // 2, i % 2, ("user", "assistant")[i % 2], t) for i, t in enumerate(said)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")

    def words(t):
        out, w = [], ""
        for c in t.lower() + " ":
            if c in "abcdefghijklmnopqrstuvwxyz0123456789":
                w += c
            elif w:
                out.append(cistem(w) if len(w) > 3 else w)
                w = ""
        return out

    def lcs(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    rows = []
    for target, prediction in zip(said[::2], said[1::2]):
        t, p, row = words(target), words(prediction), {}
        for name, hits, n, m in [(f"rouge{k}", sum(min([p[i : i + k] for i in range(len(p) - k + 1)].count(g), [t[i : i + k] for i in range(len(t) - k + 1)].count(g)) for g in {tuple(p[i : i + k]) for i in range(len(p) - k + 1)} for g in [list(g)]), len(p) - k + 1, len(t) - k + 1) for k in (1, 2)] + [("rougeL", lcs(t, p), len(p), len(t))]:
            pr, re = hits / max(n, 1), hits / max(m, 1)
            row |= {f"{name}_precision": pr, f"{name}_recall": re, f"{name}_fmeasure": 2 * pr * re / (pr + re) if pr + re else 0.0}
        rows.append(row)
    got = QUERIES["rouge_corpus"](spark, str(tmp_path)).first()
    assert got.n == 4
    for f in rows[0]:
        assert got[f] == pytest.approx(sum(r[f] for r in rows) / 4, abs=1e-6)
