import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cases import empty, odd
from condensa.llm import suffix_dedup as S
from condensa.llm._arrow import word_slices

V = ["".join(c) for c in zip("abcdefgh" * 90, "ijklmnopq" * 80, "rstuvwxyzab" * 66, "cdefg" * 144)]


def corpus(seed=3, n=200):
    rng = random.Random(seed)
    passages = [" ".join(rng.choice(V) for _ in range(k)) for k in (49, 50, 51, 60, 200, 75)]
    text = lambda k: " ".join(rng.choice(V) for _ in range(rng.randint(0, k)))
    rows = [(i, f"{text(120)} {passages[i % 6]} {text(120)}") for i in range(n)]
    rows += [(1000 + i, f"{passages[4]} {V[i]}") for i in range(150)]
    return rows + [(2000, "x " * 500), (2001, "x " * 70 + "y"), (2002, f"{passages[0]} {passages[0]} q"), (2003, " ".join(V[:60]) + " . " + " ".join(V[:60]))]


def spans(rows, min_words=50):
    """All runs of 16-bit words that another row has, joined where their beginnings follow each other."""
    words = []
    for _, _, h, _, _, b, _, _ in word_slices(pa.array([t for _, t in rows])):
        words += [tuple((h[x:y] >> np.uint64(48)).tolist()) for x, y in zip(b, b[1:])]
    seen = defaultdict(set)
    for i, w in enumerate(words):
        for k in range(len(w) - min_words + 1):
            seen[w[k : k + min_words]].add(i)
    out = []
    for i, w in enumerate(words):
        start = None
        for k in range(len(w) - min_words + 2):
            hit = k + min_words <= len(w) and len(seen[w[k : k + min_words]]) > 1
            if hit and start is None:
                start = k
            if not hit and start is not None:
                out.append((rows[i][0], start, k + min_words - 1))
                start = None
    return sorted(out)


@pytest.mark.parametrize("bucket_bytes", [16_000_000, 20_000])
def test_every_repeat_and_nothing_else(spark, bucket_bytes, monkeypatch):
    monkeypatch.setattr(S, "SAMPLE", 0.5)  # few rows: enough of them that common leading words are split among buckets
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in S.repeated_spans(df, bucket_bytes=bucket_bytes).collect())
    assert got == spans(rows)


def kept_by_hand(rows, places, min_words=50):
    """Texts as lists of words without those in a run (of 16-bit words) that a row before, in the order of places, has."""
    order = sorted(range(len(rows)), key=lambda i: places[i])
    seen, out, texts = {}, [None] * len(rows), []
    for _, _, h, _, _, b, _, _ in word_slices(pa.array([t for _, t in rows])):
        texts += [tuple((h[x:y] >> np.uint64(48)).tolist()) for x, y in zip(b, b[1:])]
    for i in order:
        for k in range(len(texts[i]) - min_words + 1):
            seen.setdefault(texts[i][k : k + min_words], i)
    for i, w in enumerate(texts):
        gone = {x for k in range(len(w) - min_words + 1) if seen[w[k : k + min_words]] != i for x in range(k, k + min_words)}
        out[i] = [x for k, x in enumerate(rows[i][1].split()) if k not in gone]
    return out


@pytest.mark.parametrize("bucket_bytes", [16_000_000, 20_000])
def test_runs_stay_in_one_row(spark, bucket_bytes, monkeypatch, tmp_path):
    monkeypatch.setattr(S, "SAMPLE", 0.5)
    rows = [(i, t.replace(".", "")) for i, t in corpus(7, 120)]
    rows = [r for r in rows if r[0] != 2002]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs")
    own = {r.doc_id: r.p for r in df.selectExpr("doc_id", "xxhash64(_metadata.file_path, _metadata.row_index) AS p").collect()}
    want = kept_by_hand(rows, [own[i] for i, _ in rows])
    out = S.remove_repeats(df, bucket_bytes=bucket_bytes)
    assert out.columns == df.columns
    got = {r.doc_id: r.text.split() for r in out.collect()}
    assert got == {i: w for (i, _), w in zip(rows, want)} and len(got) == len(rows)
    assert S.repeated_spans(out).count() < S.repeated_spans(df).count() / 10


def test_removal_of_odd_rows(spark):
    df = odd(spark)
    assert sorted(map(str, S.remove_repeats(df).collect())) == sorted(map(str, df.collect()))
    twice = df.unionByName(df.where("doc_id = 905"))
    texts = [r.text for r in S.remove_repeats(twice).where("doc_id = 905").collect()]
    assert sorted(map(len, texts)) == [0 + len(" ") * 1, 200_000]
    assert S.remove_repeats(empty(spark)).collect() == []


def test_a_true_repeat_is_inside_a_span(spark):
    rows = corpus(4, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = defaultdict(list)
    for d, a, b in S.repeated_spans(df).collect():
        got[d].append((a, b))
    split = {i: t.split() for i, t in rows if "." not in t}
    seen = defaultdict(set)
    for i, w in split.items():
        for k in range(len(w) - 49):
            seen[tuple(w[k : k + 50])].add(i)
    for i, w in split.items():
        for k in range(len(w) - 49):
            if len(seen[tuple(w[k : k + 50])]) > 1:
                assert any(a <= k and k + 50 <= b for a, b in got[i])


@given(st.lists(st.lists(st.integers(0, 2), min_size=9, max_size=9), max_size=60))
@settings(max_examples=100, deadline=None)
def test_multikey_order(rows):
    m = np.array(rows, np.uint16).reshape(-1, 9)
    if len(m):
        assert [tuple(r) for r in m[S.multikey_order(m)].tolist()] == sorted(map(tuple, rows))


@pytest.mark.parametrize("high", [2, 3, 60_000])
@pytest.mark.parametrize("n", [1, 31, 33, 5_000])
def test_multikey_order_of_many(n, high):
    m = np.random.default_rng(n).integers(0, high, (n, 50)).astype(np.uint16)
    m[n // 2 :] = m[: n - n // 2]
    order = S.multikey_order(m)
    assert sorted(order.tolist()) == list(range(n)) and (m[order] == m[np.lexsort(m.T[::-1])]).all()


@given(st.lists(st.integers(0, 3), min_size=50, max_size=200), st.integers(0, 30), st.integers(0, 30))
@settings(max_examples=100, deadline=None)
def test_shared_runs_share_a_suffix(run, before, after):
    rng = np.random.default_rng(len(run) + before)
    code = np.array(run, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    texts = [np.concatenate([rng.integers(0, 2**63, k, dtype=np.uint64), code, rng.integers(0, 2**63, after, dtype=np.uint64)]) for k in (before, before + 3)]
    starts = []
    for k, t in zip((before, before + 3), texts):
        at = S.suffix_starts(t, np.array([0, len(t)]))
        starts.append({int(x) - k for x in at if k <= x <= k + 42})
    assert starts[0] & starts[1]


def test_odd_rows_and_empty(spark):
    df = odd(spark)
    assert S.repeated_spans(df).collect() == []
    twice = df.unionByName(df.where("doc_id = 905"))
    assert {tuple(r) for r in S.repeated_spans(twice).collect()} == {(905, 0, 40_000)}
    assert S.repeated_spans(empty(spark)).collect() == []
