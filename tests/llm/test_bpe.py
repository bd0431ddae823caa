import random

import pytest

from cases import ODD, empty, odd
from condensa.llm._tokenizer import default_path, encoding, ranks
from condensa.llm.bpe import LONG_WORD, Codec, _by_heap, decode, encode, encode_decode


def texts():
    rng = random.Random(1)
    signs = "abcdefgh     éßñ漢字\n\t!?0123456789'\U0001f600"
    return ["", " ", "it's we'll", "a" * 1000, "ab" * 400 + " " + "!" * 900] + ["".join(rng.choices(signs, k=rng.randint(0, 300))) for _ in range(300)]


def test_ids_are_the_public_encoder_s(monkeypatch):
    monkeypatch.setattr("condensa.llm.bpe.QUERY_CELLS", 2_000)
    enc, c, t = encoding(default_path()), Codec(default_path()), texts()
    ids, counts = c.encode(t)
    at = 0
    for x, n in zip(t, counts):
        assert ids[at : at + n].tolist() == enc.encode_ordinary(x)
        at += n
    assert c.decode(ids, counts) == t


def test_heap_and_queries_agree():
    c, rng = Codec(default_path()), random.Random(2)
    words = ["".join(rng.choices("aeinrst", k=rng.randint(2, 300))).encode() for _ in range(60)]
    words += [("".join(rng.choices("aeinrst", k=k))).encode() for k in (LONG_WORD - 1, LONG_WORD, LONG_WORD + 1)]
    ids, counts = c._encode_words(words)
    assert ids.tolist() == [x for w in words for x in ([ranks(default_path())[w]] if w in ranks(default_path()) else _by_heap(w, ranks(default_path())))]


def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr("condensa.llm.bpe.MEMORY_WORDS", 50)
    c, enc = Codec(default_path()), encoding(default_path())
    for _ in range(3):
        for t in texts()[5:60]:
            assert c.encode([t])[0].tolist() == enc.encode_ordinary(t)


def test_words_met_often_stay_when_memory_is_full(monkeypatch):
    """Of 40 new words a text and 20 that all texts have, the 20 are encoded once."""
    monkeypatch.setattr("condensa.llm.bpe.MEMORY_WORDS", 90)
    c, enc, asked = Codec(default_path()), encoding(default_path()), []
    encode_words = c._encode_words
    monkeypatch.setattr(c, "_encode_words", lambda words: asked.extend(words) or encode_words(words))
    rng = random.Random(5)
    often = [" " + "".join(rng.choices("aeinrst", k=12)) for _ in range(20)]
    for _ in range(10):
        text = "".join(often + [" " + "".join(rng.choices("aeinrst", k=12)) for _ in range(40)])
        assert c.encode([text])[0].tolist() == enc.encode_ordinary(text)
        assert len(c.known) <= 150
    assert len(asked) == 10 * 40 + 20 and [asked.count(w.encode()) for w in often] == [1] * 20


def test_rows_and_round_trip(spark):
    out = decode(encode(odd(spark))).collect()
    assert sorted(repr((r.doc_id, r.decoded)) for r in out) == sorted(repr((d, t)) for d, t, *_ in ODD)
    assert [r.tokens for r in out if r.doc_id == 901] == [None] and [r.tokens for r in out if r.doc_id == 902] == [[]]


def test_bytes_that_are_no_text_and_unknown_ids(spark):
    one = ranks(default_path())[b"\xff"]
    frame = spark.createDataFrame([(1, [one]), (2, None), (3, [])], "doc_id long, tokens array<int>")
    assert [r.decoded for r in decode(frame).orderBy("doc_id").collect()] == ["�", None, ""]
    with pytest.raises(Exception, match="doesn't have"):
        decode(spark.createDataFrame([(1, [999_999])], "doc_id long, tokens array<int>")).collect()


def test_empty(spark):
    assert decode(encode(empty(spark))).collect() == []


def test_one_pass_is_the_two(spark):
    df = odd(spark)
    assert sorted(map(repr, encode_decode(df).collect())) == sorted(map(repr, decode(encode(df)).collect()))
    assert encode_decode(empty(spark)).collect() == []


def test_long_texts_decode_in_pieces(spark, monkeypatch):
    """12 MB in one row; pieces end within letters of several bytes."""
    text = "a few words \u00e9\u6f22\U0001f600 and 12 more!" * 350_000
    (row,) = encode_decode(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.decoded == text and row.tokens[:9] == encoding(default_path()).encode_ordinary(text[:60])[:9]
    monkeypatch.setattr("condensa.llm.bpe.DECODE_ROWS", 3)
    c = Codec(default_path())
    t = texts()[:60]
    assert c.decode(*c.encode(t)) == t


def test_many_long_words_fit_a_query_s_memory():
    """3 MB of words of several hundred bytes, which take the square of their length in rows."""
    rng, c, enc = random.Random(4), Codec(default_path()), encoding(default_path())
    text = " ".join("".join(rng.choices("aeinrst", k=390)) for _ in range(400))
    assert c.encode([text])[0].tolist() == enc.encode_ordinary(text)
