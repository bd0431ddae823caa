import pytest
from pyspark.sql import functions as F

from condensa.functions import text as X


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(build(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize("value,metric,n", [("", "whitespace", 1), (" a ", "whitespace", 3), ("", "char", 0), ("Ab. c!", "token", 4), (None, "char", None)])
def test_lengths(spark, value, metric, n):
    assert one(spark, value, lambda c: X.length_of(c, metric)) == n


def test_unknown_metric():
    with pytest.raises(ValueError):
        X.length_of("a", "pages")


def test_tokens_keep_signs_and_index_tokens_do_not(spark):
    text = "Hildebrand und Söhne Co. K.G."
    assert one(spark, text, X.tokens) == ["Hildebrand", "und", "Söhne", "Co", ".", "K", ".", "G", "."]
    assert one(spark, text, X.index_tokens) == ["Hildebrand", "und", "Söhne", "Co", "K", "G"]


def test_sentences_are_stripped_and_blank_ones_left_out(spark):
    assert one(spark, "Eins. \n Zwei!\n\t\n", X.sentences) == ["Eins.", "Zwei!"]


def merged_by_scan(parts):
    out, held = [], []
    for s in parts:
        s = s.strip("\n ")
        bad = s.endswith(";") or s[-1:] not in tuple(X.ENDINGS) or len(s.split(" ")) < 3 or len(s) < 10
        held.append(s)
        if not bad:
            out.append(" ".join(held).strip(" ") if len(held) > 1 else s)
            held = []
    return out + ([" ".join(held).strip(" ")] if held else [])


@pytest.mark.parametrize("parts", [[], ["Das ist ein ganzer Satz."], ["Er kam;", "sah und siegte am Ende."], ["Am 3.", "Mai kam er nach Hause zurück.", "Und"], ["a", "b", "c"], ["Ja.", "Nein, das ist es nicht!", "So ist es eben nun mal."]])
def test_fragments_join_the_next_sentence(spark, parts):
    assert one(spark, parts, X.merged_sentences, "array<string>") == merged_by_scan(parts)


def test_digit_endings_only_count_when_asked_for(spark):
    parts = ["Das geschah im Jahr 1999.", "Danach war alles anders als vorher."]
    assert len(one(spark, parts, X.merged_sentences, "array<string>")) == 2
    assert len(one(spark, parts, lambda c: X.merged_sentences(c, digit_endings=True), "array<string>")) == 1


@pytest.mark.parametrize("parts,n,grams", [(["a", "b", "c"], 2, ["a b", "b c"]), (["a"], 2, []), ([], 3, []), (["a", "b", "a"], 1, ["a", "b", "a"])])
def test_ngrams(spark, parts, n, grams):
    assert one(spark, parts, lambda c: X.ngrams(c, n), "array<string>") == grams


def test_languages(spark):
    assert one(spark, "DE-at", X.normal_language) == "de"
    with pytest.raises(Exception, match="unknown language"):
        one(spark, "fr", X.normal_language)


def test_strings_of_loaders(spark):
    assert one(spark, "a b", X.plain_spaces) == "a b"
    assert one(spark, "a\nb", X.one_line) == "a b"
    assert one(spark, ["= H =", " ", "x"], lambda c: X.fused(c, "\n= "), "array<string>") == "H\nx"
    assert one(spark, [["a", "b"], ["c"]], X.legal_summary, "array<array<string>>") == "a\nb\nc\n"
    assert one(spark, [["a"], []], X.principle_part, "array<array<string>>") == "first"
    for bad in ([[], []], [["a"]]):
        with pytest.raises(Exception, match="."):
            one(spark, bad, X.principle_part, "array<array<string>>")


@pytest.mark.parametrize("text", ["", " ", "a", " . b", "...", "\n\nOne! Two", "  x", "No end", "A?! B.", ".\n", "\t\nlast"])
def test_first_sentence_is_the_first_of_all(spark, text):
    assert one(spark, text, X.first_sentence) == (one(spark, text, X.sentences) or [""])[0]


def test_keywords_of_all_of_a_text_count(spark, tmp_path):
    import regex

    from condensa.operators.retrieval import keyphrase_scores
    from condensa.queries import QUERIES

    find, split = regex.compile(r"[\p{L}\p{N}]+").findall, regex.compile(r"[^.!?]+[.!?]*").findall
    head = "Rain fell on the old harbour wall. " * 10
    texts, scores = [head + tail for tail in ("", "Zebra crossings confuse zebras, a zebra said. Lions sleep. " * 5, "Other words stand here. " * 9)], []
    for name, some in (("all", texts), ("head", [head] * 3)):
        spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        scores.append(QUERIES["keyword_prf_at_k"](spark, f"{tmp_path}/{name}").first())
        p, g = [{x for x, _ in keyphrase_scores(t, 10, 3, find, split)} for t in some], [set(find(t.lower())) for t in some]
        each = [(len(a & b) / len(a), len(a & b) / len(b)) for a, b in zip(p, g)]
        assert scores[-1].precision == pytest.approx(100 * sum(x for x, _ in each) / 3, abs=1e-5) and scores[-1].recall == pytest.approx(100 * sum(y for _, y in each) / 3, abs=1e-5)
    assert scores[0] != scores[1]  # what stands after token 60 counts


def test_given_lemmatizers(spark):
    df = spark.createDataFrame([("Die Boote lagen.",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(X.lemmas("t")).collect()] == [["die", "boote", "lagen", "."], None, []]
    look = X.dictionary_lemmas({"Boote": "Boot", "lagen": "liegen"})
    assert [r[0] for r in df.select(X.lemmas("t", look)).collect()] == [["die", "Boot", "liegen", "."], None, []]


def test_signs_are_counted_before_they_are_shuffled(spark):
    from collections import Counter

    texts = ["abca", "", None, "\U0001f600a\n", "x" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    assert {r.ch: r.n for r in X.sign_counts(df).collect()} == dict(Counter("".join(t or "" for t in texts)))
