import numpy as np
import pytest

from cases import ODD, empty, odd
from condensa.llm._shared import new_dir
from condensa.llm._tokenizer import default_path, encoding
from condensa.llm.token_counts import read_cache, token_counts, update_cache
from condensa.llm.token_files import TokenFiles, write_tokens


@pytest.mark.parametrize("parts", [1, 3, 20])
def test_files_give_every_document_back(spark, parts):
    folder = new_dir(spark, "t")
    df = odd(spark).repartition(parts)
    index = write_tokens(df, folder).collect()
    files, enc = TokenFiles(folder), encoding(default_path())
    want = sorted([] if t is None else [*enc.encode_ordinary(t), 50256] for _, t, *_ in ODD)
    assert sorted(files[i].tolist() for i in range(len(files))) == want
    assert sorted(files.document(r.shard, r.position).tolist() for r in index) == want
    whole = np.concatenate([files[i] for i in range(len(files))])
    for r in index:
        assert files.tokens(r.token_start, r.n_tokens).tolist() == files.document(r.shard, r.position).tolist()
        assert whole[r.token_start : r.token_start + r.n_tokens].tolist() == files.document(r.shard, r.position).tolist()
    assert sum(r.n_tokens for r in index) == len(whole)


def test_no_rows(spark):
    folder = new_dir(spark, "t")
    assert write_tokens(empty(spark), folder).collect() == [] and len(TokenFiles(folder)) == 0


def test_counts_are_those_of_the_content(spark):
    enc = encoding(default_path())
    out = token_counts(odd(spark), new_dir(spark, "c")).collect()
    strip = lambda t: t.replace("\r\n", "\n").strip(" \t\n\x0b\f\r")
    want = [(d, None if t is None else len(enc.encode_ordinary(strip(t)))) for d, t, *_ in ODD]
    assert sorted(map(repr, ((r.doc_id, r.n_tokens) for r in out))) == sorted(map(repr, want))


def test_cache_holds_each_content_once_and_is_used(spark):
    folder = new_dir(spark, "c")
    df = spark.createDataFrame([(1, "a b c"), (2, " a b c\n"), (3, "a b c d")], "doc_id long, text string")
    assert {(r.doc_id, r.n_tokens) for r in token_counts(df, folder).collect()} == {(1, 3), (2, 3), (3, 4)}
    assert read_cache(spark, folder).count() == 2
    token_counts(df, folder)
    assert read_cache(spark, folder).count() == 2
    more = spark.createDataFrame([(4, "a b c"), (5, "new text")], "doc_id long, text string")
    assert token_counts(more, folder).count() == 2 and read_cache(spark, folder).count() == 3


def test_stored_counts_are_believed(spark):
    from condensa.llm.token_counts import content_digest

    folder = new_dir(spark, "c")
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    df.select(content_digest("text", default_path()).alias("digest")).selectExpr("digest", "cast(77 AS long) AS n_tokens").write.parquet(folder)
    assert token_counts(df, folder).first().n_tokens == 77


def test_no_rows_to_count(spark):
    assert token_counts(empty(spark), new_dir(spark, "c")).collect() == []


def small_vocabulary(path, tokens):
    import base64

    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    return str(path)


def test_the_end_mark_is_no_token(spark, tmp_path):
    other = small_vocabulary(tmp_path / "v", [bytes([b]) for b in range(256)] + [b"ab"])
    df = spark.createDataFrame([(1, "abc"), (2, ""), (3, None)], "doc_id long, text string")
    folder = new_dir(spark, "t")
    rows = {r.doc_id: r for r in write_tokens(df, folder, tokenizer=other).collect()}
    files = TokenFiles(folder)
    assert {d: files.document(r.shard, r.position).tolist() for d, r in rows.items()} == {1: [256, 99, 257], 2: [257], 3: []}
    with pytest.raises(ValueError, match="is a token"):
        write_tokens(df, new_dir(spark, "t"), tokenizer=other, end_of_text=256)
    bare = new_dir(spark, "t")
    write_tokens(df, bare, tokenizer=other, end_of_text=None).collect()
    assert sorted(TokenFiles(bare)[i].tolist() for i in range(3)) == [[], [], [256, 99]]


def test_tokenizers_and_long_texts_in_one_cache(spark, tmp_path):
    folder, other = new_dir(spark, "c"), small_vocabulary(tmp_path / "v", [bytes([b]) for b in range(256)])
    df = spark.createDataFrame([(1, "a b c"), (2, "long words " * 100_000)], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts(df, folder, tokenizer=other).collect()} == {1: 5, 2: 1_099_999}
    enc = encoding(default_path())
    assert {r.doc_id: r.n_tokens for r in token_counts(df, folder).collect()} == {1: 3, 2: len(enc.encode_ordinary(("long words " * 100_000).strip()))}
    assert read_cache(spark, folder).count() == 4


def test_a_warm_cache_moves_digests_only(spark, tmp_path):
    """No plan of a second call shuffles a text or calls Python."""
    spark.createDataFrame([(i, f"text {i} " * 50) for i in range(200)], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs, folder = spark.read.parquet(f"{tmp_path}/docs"), new_dir(spark, "c")
    token_counts(docs, folder).count()
    before = len(spark.read.parquet(folder).inputFiles())
    plan = token_counts(docs, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "text" not in plan
    assert len(spark.read.parquet(folder).inputFiles()) == before
    assert update_cache(docs, folder).columns == ["digest"]
