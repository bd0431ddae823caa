import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import by_hand
from cases import empty, odd
from condensa.llm._arrow import word_slices
from condensa.llm.toxicity import STEMS, Model, _doc_features, _scores, fit, reject, score, train

DATA = "/root/testdata/sf0.1"


def ftrl_by_hand(rows, bits, epochs, alpha=1.0, beta=1.0, l1=3.0, l2=1.0):
    z, n, bias = [0.0] * ((1 << bits) + 1), [0.0] * ((1 << bits) + 1), 1 << bits

    def w(i):
        held = 0.0 if i == bias else l1
        return 0.0 if abs(z[i]) <= held else -(z[i] - math.copysign(held, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for at, y in rows:
            at = [*at, bias]
            ws = [w(i) for i in at]
            g = 1 / (1 + math.exp(-sum(ws))) - y
            for i, wi in zip(at, ws):
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * wi
                n[i] += g * g
    return [w(i) for i in range(bias + 1)]


def test_fit_is_ftrl():
    rng = random.Random(1)
    rows = [(np.array(sorted(rng.sample(range(64), 9))), rng.randint(0, 1)) for _ in range(120)]
    m = fit(rows, bits=6, epochs=3)
    want = ftrl_by_hand([(a.tolist(), y) for a, y in rows], 6, 3)
    assert np.allclose(np.append(m.dense(), m.bias), want, atol=1e-5)
    assert len(m.buckets) < 64  # L1 keeps weights at zero


def test_features_and_scores_by_hand(spark):
    docs, labels = small(spark)
    model = train(docs, labels, bits=16)
    texts = ["you stupid clown", "a calm and kind day", "", "worthless", "x", "Stupid \u00dcber clown, kind \u65e5\u672c", "you you you stupid you"]
    rows = score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in rows:
        p, toxic = by_hand.toxicity(texts[r.doc_id], model)
        assert r.toxicity == pytest.approx(p, abs=2e-6) and r.toxic == toxic
    assert any(r.toxic for r in rows) and not all(r.toxic for r in rows)
    for t in texts:
        for _, _, h, _, _, b, _, _ in word_slices(pa.array([t]), prefixes=STEMS):
            assert set(_doc_features(h[b[0] : b[1]], 16).tolist()) == by_hand.toxic_buckets(t, 16)


def test_rows_not_ids_are_bounded(spark):
    docs = [(1, f"you stupid clown {i}") for i in range(200)] + [(2, "a calm day"), (3, "kind words"), (4, "stupid")]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1)], "doc_id long, toxic int")
    least = docs.where("doc_id = 1").orderBy(F.xxhash64("text")).limit(1)
    a, b = train(docs, labels), train(least.unionByName(docs.where("doc_id > 1")), labels)
    assert a.bias == b.bias and (a.buckets == b.buckets).all() and (a.weights == b.weights).all()
    assert train(docs, labels, max_rows=1).bias == -35.0  # one row is one class


def test_a_score_at_the_threshold_is_toxic(spark):
    docs, labels = small(spark)
    model = train(docs, labels)
    exact = float(_scores(pa.array(["you stupid worthless clown"]), model, model.dense())[0][0])
    for threshold, toxic in ((exact, True), (np.nextafter(exact, 1), False)):
        assert score(docs.where("doc_id = 1"), model, threshold=threshold).first().toxic == toxic


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = train(docs, labels.where("doc_id % 2 = 0"))
    rows = score(docs, model).withColumnRenamed("toxic", "told").join(labels.where("doc_id % 2 = 1"), "doc_id").selectExpr("told", "toxic AS gold").collect()
    good, bad = [r.told for r in rows if r.gold], [r.told for r in rows if not r.gold]
    assert sum(good) / len(good) >= 0.8 and sum(bad) / len(bad) <= 0.05


def small(spark):
    docs = [(i, "you stupid worthless clown" if i % 2 else "a calm and kind day") for i in range(40)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    return docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS toxic")


def test_reject_keeps_columns_and_clean_rows(spark):
    docs, labels = small(spark)
    model = train(docs, labels)
    assert {r.doc_id % 2 for r in reject(docs, model).collect()} == {0}
    df = odd(spark)
    out = reject(df, model)
    assert out.columns == df.columns and out.count() == df.count()
    assert score(df, model).count() == df.count()
    long = "a calm and kind day " * 100_000 + "you stupid worthless clown " * 3
    assert score(spark.createDataFrame([(1, long)], "doc_id long, text string"), model).first().toxicity > score(docs.where("doc_id = 0"), model).first().toxicity


def test_nothing_to_learn_from(spark):
    docs, labels = small(spark)
    for own in (labels.where("false"), labels.where("toxic = 1"), labels.selectExpr("doc_id", "cast(null AS int) AS toxic")):
        assert not any(r.toxic for r in score(docs, train(docs, own)).collect())
    assert score(empty(spark), train(docs, labels)).collect() == []


def test_labels_twice_and_model_size(spark):
    docs, labels = small(spark)
    assert isinstance(train(docs, labels.unionByName(labels)), Model)
    a, b = train(docs, labels), train(docs.repartition(3), labels.repartition(2))
    assert (a.buckets == b.buckets).all() and (a.weights == b.weights).all()
