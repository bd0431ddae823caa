import random

import pytest

from cases import empty, odd
from condensa.llm.decontaminate import MIN_ITEM, MIN_RUN, Matcher, item_words, leaks, reject_leaks, short_items

V = [f"w{i}" for i in range(30)]


def runs_by_hand(items, text, min_run=MIN_RUN, min_item=MIN_ITEM):
    """Longest runs on each diagonal of words against words."""
    own, out = item_words(text), set()
    if not text or own == [""]:
        return out
    for i, t in items:
        w = item_words(t)
        if len(w) < min_item and w != own:  # a short one counts as all of a text
            continue
        for shift in range(-len(w), len(own)):
            k = 0
            while k < len(w):
                n = 0
                while k + n < len(w) and 0 <= shift + k + n < len(own) and own[shift + k + n] == w[k + n]:
                    n += 1
                if n >= min(min_run, len(w)):
                    out.add((i, shift + k, n))
                k += n + 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_every_run(seed):
    rng = random.Random(seed)
    vocabulary = V[: 3 + 9 * (seed % 3)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 40)))) for i in range(12)]
    m = Matcher(items)
    for _ in range(60):
        words = rng.choices(vocabulary, k=rng.randint(0, 30))
        i = rng.randrange(12)
        w = items[i][1].split()
        a = rng.randint(0, len(w))
        words[len(words) // 2 : len(words) // 2] = w[a : a + rng.randint(0, 30)]
        text = ", ".join(words)
        starts = {}
        pos = 0
        for k, x in enumerate(words):
            starts[pos] = k
            pos += len(x) + 2
        got = {(item, starts[s], n) for item, s, _, n, _ in m.runs(text)}
        assert got == runs_by_hand(items, text)


def test_offsets_are_of_the_original():
    text = "Intro:  THE Quick, brown -- fox\njumps OVER it; end"
    (run,) = Matcher([(7, "the quick brown fox jumps over it")]).runs(text)
    assert text[run[1] : run[2]] == "THE Quick, brown -- fox\njumps OVER it" and run[0] == 7 and run[3:] == (7, 7)


def test_rows(spark):
    item = " ".join(f"t{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (1, item), (2, "too short"), (None, None), (3, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, "clean"), (3, " ".join(item.split()[:13])), (4, " ".join(item.split()[:12])), (5, None)], "doc_id long, text string")
    for chars in (16_000_000, 5):
        assert sorted((r.doc_id, r.item_id, r.n_words) for r in leaks(docs, bench, automaton_chars=chars).collect()) == [(1, 1, 20), (3, 1, 13)]
        assert sorted(r.doc_id for r in reject_leaks(docs, bench, automaton_chars=chars).collect()) == [2, 4, 5]


QUESTION = " ".join(f"q{i}" for i in range(15))


def test_short_answers_count_near_their_question(spark):
    bench = spark.createDataFrame([(1, QUESTION), (1, "Forty-two"), (2, "forty two"), (3, "four words stand alone")], "item_id long, text string")
    far = " ".join(["x"] * 150)
    texts = [f"{QUESTION}? It is forty two.", f"forty two {far}", f"{QUESTION} {far} forty two", "Forty, two!", "so four words stand alone here", "Four words: stand alone", f"forty two -- {QUESTION}"]
    got = leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench).collect()
    found = sorted((r.doc_id, r.item_id, texts[r.doc_id][r.start : r.end].lower()) for r in got)
    assert found == sorted([(0, 1, QUESTION), (0, 1, "forty two"), (2, 1, QUESTION), (3, 1, "forty, two"), (3, 2, "forty, two"), (5, 3, "four words: stand alone"), (6, 1, QUESTION), (6, 1, "forty two")])
    kept = reject_leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4]
    assert sorted((r.item_id, r.alone) for r in short_items(bench).collect()) == [(1, False), (2, True), (3, True)]


@pytest.mark.parametrize("kind", ["int", "string", "long", "smallint", "date"])
def test_ids_of_other_types(spark, kind):
    value = {"string": "'a'", "date": "date'2020-01-02'"}.get(kind, "7")
    bench = spark.sql(f"SELECT cast({value} AS {kind}) AS item_id, '{QUESTION}' AS text UNION ALL SELECT null, '{QUESTION} end'")
    docs = spark.sql(f"SELECT cast({value} AS {kind}) AS doc_id, 'so {QUESTION} end' AS text")
    out = leaks(docs, bench)
    assert [out.schema[c].dataType for c in ("doc_id", "item_id")] == [docs.schema["doc_id"].dataType, bench.schema["item_id"].dataType]
    one = docs.first().doc_id
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(one, None, 3, 3 + len(QUESTION) + 4, 16, 16), (one, one, 3, 3 + len(QUESTION), 15, 15)], key=str)


def test_long_texts(spark):
    text = "some words " * 200_000 + QUESTION + " more" * 200_000
    bench = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    assert [tuple(r) for r in leaks(spark.createDataFrame([(5, text)], "doc_id long, text string"), bench).collect()] == [(5, 1, 2_200_000, 2_200_000 + len(QUESTION), 15, 15)]


def test_odd_rows(spark):
    df = odd(spark)
    bench = df.selectExpr("doc_id AS item_id", "text").where("doc_id = 907")
    assert sorted(r.doc_id for r in leaks(df, bench).collect()) == [907, 907]
    out = reject_leaks(df, bench)
    assert out.columns == df.columns and out.count() == df.count() - 2
    none = bench.where("false")
    assert leaks(df, none).collect() == [] and reject_leaks(df, none).count() == df.count()
    assert leaks(empty(spark), bench).collect() == []
