import math
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import empty, odd
from condensa.llm._arrow import _is_word
from condensa.llm.language import MAX_TRAIN_ROWS, Model, identify, train

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = train(docs.where("doc_id % 2 = 0"))
    rows = identify(docs.where("doc_id % 2 = 1"), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.language == r.lang for r in rows) / len(rows) >= 0.95
    assert all(r.family == {"en": "germanic", "de": "germanic", "fr": "romance", "es": "romance"}[r.language] for r in rows)


def small(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, "le chat et le chien", "fr"), (4, "el gato y el perro", "es"), (5, "of the and to", "en"), (6, "quien es el que", "es")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_odd_rows(spark):
    model = train(small(spark))
    out = identify(odd(spark), model).collect()
    assert len(out) == odd(spark).count()
    told = {r.doc_id: (r.family, r.language, r.margin) for r in out}
    for blank in (901, 902, 903, 904):
        assert told[blank] == ("und", "und", 0.0)
    assert told[905][1] in ("en", "de", "fr", "es")


def by_hand(model, text):
    """(family, language, margin) of one text, byte by byte."""
    raw = text.lower().encode()
    word = [bool(w) for w in _is_word(np.frombuffer(raw, np.uint8))]
    signs, counts = [b if w else 32 for b, w in zip(raw, word)], Counter()
    bits = model.weights.shape[0].bit_length() - 1
    for n in (2, 3, 4):
        for i in range(len(raw) - n + 1):
            if all(word[i + 1 : i + n - 1]) and (word[i] or word[i + n - 1]):
                h = n
                for b in signs[i : i + n]:
                    h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
                h ^= h >> 15
                counts[(h * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - bits)] += 1
    total = sum(counts.values())
    score = {p: sum(c * float(model.weights[b, k]) for b, c in counts.items()) / total for k, p in enumerate(model.pairs)}

    def winner(kind, names):
        best = []
        for name in names:
            own = [s if a == name else -s for (of, a, b), s in score.items() if of == kind and name in (a, b)]
            best.append((sum(s > 0 for s in own), sum(own), min(own, default=math.inf), name))
        top = max(best, key=lambda x: x[:2])
        return top[3], top[2]

    family, m = winner("", sorted(model.languages))
    language, own = winner(family, model.languages[family])
    return family, language, min(m, own)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_against_text_by_text(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = train(docs)
    told = {r.doc_id: r for r in identify(docs, model).collect()}
    for r in docs.where("doc_id % 7 = 0").collect():
        family, language, margin = by_hand(model, r.text)
        assert (told[r.doc_id].family, told[r.doc_id].language) == (family, language) and abs(told[r.doc_id].margin - margin) < 1e-4


def test_scripts_that_no_language_has(spark):
    docs = spark.createDataFrame([(1, "\u0442\u0435\u043a\u0441\u0442 \u0438 \u0435\u0449\u0451"), (2, "\u65e5\u672c\u8a9e the cat"), (3, "the cat and \u65e5"), (4, "das \u00df\u0153 und der Hund")], "doc_id long, text string")
    assert [r.language == "und" for r in identify(docs, train(small(spark))).orderBy("doc_id").collect()] == [True, False, False, False]


def test_equal_votes():
    pairs = [("", "f", "g"), ("f", "a", "b"), ("f", "a", "c"), ("f", "b", "c"), ("g", "d", "d")]
    m = Model(pairs[:4], np.zeros((2, 4)), {"f": ["a", "b", "c"], "g": ["d"]}, np.ones(256, bool))
    # a beats b, b beats c, c beats a: the sum of scores decides; with all at zero the first name.
    family, language, margin = m.tell(np.array([[1.0, 1, -2, 1], [1, 1, -1, 1], [0, 0, 0, 0]]))
    assert family.tolist() == ["f"] * 3 and language.tolist() == ["c", "a", "a"] and margin.tolist() == [-1, -1, 0]


def test_rows_not_ids_are_bounded(spark):
    rows = [(1, f"the cat and the dog {i}", "en") for i in range(200)] + [(2, "el gato y el perro", "es"), (3, "der Hund und die Katze", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    a, b = train(docs, max_rows=3), train(docs.repartition(2), max_rows=3)
    assert (a.weights == b.weights).all() and a.languages == {"germanic": ["de", "en"], "romance": ["es"]}
    least = docs.where("doc_id = 1").orderBy(F.xxhash64("text")).limit(1)
    assert (train(least.unionByName(docs.where("doc_id > 1"))).weights == a.weights).all()


def test_long_texts_are_read_whole(spark):
    model = train(small(spark))
    text = "the cat and the dog " * 10 + "el gato y el perro que es " * 200_000
    assert identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first().language == "es"


def test_nothing_to_learn_from(spark):
    model = train(empty(spark))
    assert identify(small(spark), model).select("language").distinct().collect()[0][0] == "und"
    assert identify(empty(spark), model).collect() == []
    only = train(small(spark).where("lang = 'en'"))
    assert {r.language for r in identify(small(spark), only).collect()} == {"en"}


def test_the_bound_holds(spark):
    assert MAX_TRAIN_ROWS < 10_000
    a, b = train(small(spark), max_rows=4), train(small(spark).repartition(3), max_rows=4)
    assert a.pairs == b.pairs and (a.weights == b.weights).all()


def test_rare_languages_are_learned(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(200)] + [(i, "el gato y el perro", "es") for i in (200, 201)] + [(202, "der Hund und die Katze", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    told = {r.doc_id: r.language for r in identify(docs, train(docs, max_rows=6)).collect()}
    assert told == {r[0]: r[2] for r in rows}
