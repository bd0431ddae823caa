"""Steps that held at small sizes only: what made them fail, in small."""

import regex

letters = regex.compile(r"[\p{L}\p{N}]+").findall


def test_groups_that_barely_touch_have_a_walk():
    """Steps of the walk come near its end too slowly where two groups of sentences share one word of hundreds."""
    from condensa.operators import baselines as B

    parts = [f"the {' '.join(f'w{i // 2}x{k}' for k in range(200))}" + f" y{i}" * i for i in range(4)]
    x = B.walk_centrality(B.WordCounts(parts, letters))
    s = B.WordCounts(parts, letters).likeness(0, 4)
    p = s / s.sum(1, keepdims=True)
    assert abs(x @ p - x).max() < 1e-12 and abs(x.sum() - 1) < 1e-12


def test_equal_sentences_are_held_once():
    from condensa.operators import baselines as B

    words = B.WordCounts(["A b.", "c", "a B"] * 2_000, letters)
    assert len(words.times) == 2 and words.often.size + len(words.value) < 10
    assert len({round(v, 12) for v in B.walk_centrality(words)}) == 2


def test_csv_keeps_nulls_empty_texts_and_nul(spark, tmp_path):
    from condensa.sources import readers as R

    rows = [(1, "", "a"), (2, None, ""), (None, 'a\0"', None), (4, '"', '\r\n"",'), (5, " x ", "\\")]
    R.write_csv(spark.createDataFrame(rows, "i long, s string, t string").repartition(2), str(tmp_path / "csv"))
    assert sorted(map(tuple, R.csv_pairs(spark, str(tmp_path / "csv"), "i long, s string, t string").collect()), key=str) == sorted(rows, key=str)


def test_keyphrases_of_many_texts_are_those_of_each(spark):
    """Texts are counted together, each document's words by themselves; a plan finds the topics of a digest once."""
    import pyarrow as pa

    from condensa.functions.grams import text_slices
    from condensa.operators.retrieval import Summarizer, keyphrases_of

    texts = ["Suffix arrays sort suffixes. NATO and Rome met", "", "...Rome! Old Rome. . . ", ". a b", "?Foo BAR baz. İstanbul İ ß. Foo", " \n", "Suffix arrays sort suffixes. NATO and Rome met"] * 40
    together = keyphrases_of(texts, 5)
    assert together == [keyphrases_of([t], 5)[0] for t in texts[:7]] * 40 and together[0] and not together[1]
    for signs in (1, 100, 10**6):
        parts = list(text_slices(pa.array([*texts, None]), signs))
        assert [t for _, own in parts for t in own] == [*texts, None] and [a for a, _ in parts] == [sum(len(own) for _, own in parts[:k]) for k in range(len(parts))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plan = Summarizer().summarize(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_draws_of_many_positions_are_those_of_md5(spark, monkeypatch):
    """Digests of blocks against hashlib, values in several files, counts of one file's rows at a time, nulls and infinity."""
    from hashlib import md5

    import numpy as np
    import pytest

    from condensa.operators import draws as D

    pos = np.array([0, 7, 9, 10, 99, 12345, 99999, 10**9])
    for prefix in ("", "2", "256:1:", "-7:9999:", "x" * 45, "x" * 60):
        want = [int(md5(f"{prefix}{p}".encode()).hexdigest()[:8], 16) for p in pos]
        assert D.Positions(pos).numbers(prefix).tolist() == want and D.Positions(pos).below(prefix, 7).tolist() == [x % 7 for x in want]
    x = {"a": [1.5, None, 3.0, float("inf"), 2.0, 8.0, 1.0], "b": [4.0, 2.0], "c": [None]}
    df = spark.createDataFrame([(k, i, v, 1.0) for k, own in x.items() for i, v in enumerate(own)], "key string, pos long, v double, w double")
    want = {}
    for k, own in x.items():
        for r in range(9):
            drawn = [own[int(md5(f"5:{r}:{p}".encode()).hexdigest()[:8], 16) % len(own)] for p in range(len(own))]
            drawn = [v for v in drawn if v is not None]
            want[k, r] = (pytest.approx(sum(drawn) / len(drawn)) if drawn else None, 1.0)
    for segment, counts, block in ((1 << 18, 1 << 24, 1 << 14), (2, 4, 3)):
        monkeypatch.setattr(D, "SEGMENT", segment), monkeypatch.setattr(D, "COUNTS", counts), monkeypatch.setattr(D, "BLOCK", block)
        assert {(r.key, r.resample): (r.v, r.w) for r in D.means(df, ["v", "w"], n_resamples=9, seed=5).collect()} == want


def test_coins_are_tossed_where_they_matter(spark, monkeypatch):
    from hashlib import md5

    from condensa.operators import draws as D

    a, b = [1, 0, 1, 1, 0, 0, 1, 0, 1], [1, 1, 0, 1, 0, 1, 0, 0, 0]
    coin = lambda r, p: int(md5(f"5:{r}:{p}".encode()).hexdigest()[:8], 16) % 2
    want = {r: (9, *(sum(y[p] if coin(r, p) else x[p] for p in range(9)) for x, y in ((a, b), (b, a)))) for r in range(20)}
    df = spark.createDataFrame([(p, float(x), float(y)) for p, (x, y) in enumerate(zip(a, b))], "pos long, a double, b double")
    for segment in (1 << 18, 4):
        monkeypatch.setattr(D, "SEGMENT", segment)
        assert {r.resample: (r.n, r.a, r.b) for r in D.swaps(df, n_resamples=20, seed=5).collect()} == want


def test_draws_are_not_shuffled(spark):
    from condensa.operators import significance as S

    rows = spark.createDataFrame([(i, i % 3, (i * 7) % 3, (i * 5) % 4 % 3) for i in range(40)], "pos long, gold int, a int, b int")
    plan = S.bootstrap_scores(rows, S.accuracy, 50, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(resample" not in plan and "MapInArrow" in plan


def test_vectors_are_shuffled_once_whatever_the_tiles(spark):
    """Every row's best of all tiles, with ties, and no copy of a vector for each tile in the plan."""
    import numpy as np

    from condensa.operators import retrieval as R

    v = np.random.default_rng(1).integers(-1, 2, (90, 3)).astype(float)
    df = spark.createDataFrame([(f"k{i:02}", x.tolist()) for i, x in enumerate(v)], "vec_id string, embedding array<float>")
    out = R.dense_retrieve_all(df, tile=11, limit=5)
    assert "Generate explode" not in out._jdf.queryExecution().executedPlan().toString()
    s = v @ v.T
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in out.collect()}
    assert got == {(f"k{i:02}", k + 1): (f"k{j:02}", s[i, j]) for i in range(90) for k, j in enumerate(np.lexsort((np.arange(90), -s[i]))[:5])}


def test_grams_of_many_texts_are_those_of_each(spark):
    """Repetitions and positioned phrases, counted together and by hand; texts lie next to each other in a slice."""
    from collections import Counter

    from condensa.functions import pairs as P
    from condensa.operators import retrieval as R

    texts = ["the old wall. the old wall, the old wall", None, "", "wall the old", "Wall the OLD wall the old harbour _ wall", "a b a b a b a", "x"] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    find = regex.compile(r"[\p{L}\p{N}]+|[^ \t\n\x0b\f\r\p{L}\p{N}]").findall
    for n in (1, 3, 5):
        for r in df.select("doc_id", P.gram_repetitions("text", n).alias("g")).collect():
            t = None if texts[r.doc_id] is None else find(texts[r.doc_id])
            want = None if t is None else [(" ".join(g), c - 1) for g, c in sorted(Counter(zip(*(t[k:] for k in range(n)))).items()) if c > 1]
            assert (None if r.g is None else [tuple(x) for x in r.g]) == want
    phrases = {}
    for r in R.position_weighted_keyphrases(df, least=1, cutoff=4, top=100).collect():
        phrases.setdefault(r.doc_id, set()).add(r.phrase)
    for i, t in enumerate(texts):
        w = letters((t or "").lower())
        want = {" ".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1) if len(w[k]) > 2 and len(w[k + n - 1]) > 2 and k < 4}
        assert phrases.get(i, set()) == want
