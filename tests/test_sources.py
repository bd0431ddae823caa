import json
import os

import pytest

from condensa.sources import readers as R


def test_splits(spark):
    df = spark.createDataFrame([(1, "a")], "id long, text string")
    out = R.splits(train=df, test=df, row_id="id").orderBy("split_order").collect()
    assert [(r.split, r.split_order, r.row_id, r.text) for r in out] == [("train", 0, 1, "a"), ("test", 2, 1, "a")]
    with pytest.raises(ValueError):
        R.splits(row_id="id")


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps({"language": lang, "text": t}) for lang, t in (("deu", "x"), ("eng", "y"))))
    assert [r.text for r in R.jsonl_of_language(spark, str(tmp_path), "language string, text string").collect()] == ["x"]


def test_nested(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"train": {"1": {"r": "a\nb"}, "2": {"r": "c"}}, "test": {"3": {"r": "d"}}}, indent=1))
    assert {tuple(r) for r in R.nested_json(spark, str(tmp_path), "r string").collect()} == {("train", "a\nb"), ("train", "c"), ("test", "d")}


def test_folder_with_lists(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    for k in range(4):
        (tmp_path / "docs" / f"{k}.json").write_text(json.dumps({"id": k}, indent=1))
    (tmp_path / "train.txt").write_text("0.json \n1.json\n0.json\n")
    (tmp_path / "test.txt").write_text("1.json\n2.json")
    found, unused = R.json_folder(spark, str(tmp_path / "docs"), "id long", {"train": str(tmp_path / "train.txt"), "test": str(tmp_path / "test.txt")})
    assert {(r.id, r.split) for r in found.collect()} == {(0, "train"), (1, "train"), (2, "test")}
    assert [r.id for r in unused.collect()] == [3]


def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('source,summary\n"a ""b""\nc",d\n')
    assert [tuple(r) for r in R.csv_pairs(spark, str(tmp_path / "a.csv")).collect()] == [('a "b"\nc', "d")]


def test_parallel_text_ends_with_the_shorter(spark, tmp_path):
    (tmp_path / "s").write_text(" a\nb\nc\n")
    (tmp_path / "t").write_text("x\ny \n")
    out = R.parallel_text(spark, str(tmp_path / "s"), str(tmp_path / "t")).orderBy("pos").collect()
    assert [(r.source, r.target) for r in out] == [("a", "x"), ("b", "y")]


def test_article_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("= Head\n\n first \n  \n = kept\n")
    assert R.article_lines(spark, str(tmp_path / "a.txt")).first().lines == ["first", "= kept"]


def test_keywords_and_names(spark, tmp_path):
    (tmp_path / "k.jsonl").write_text(json.dumps({"abstract": "t", "keyword": "a;b c"}))
    assert R.keyword_lines(spark, str(tmp_path / "k.jsonl")).first().keywords == ["a", "b c"]
    df = spark.createDataFrame([(5, "x"), (3, "y")], "id long, text string")
    assert [tuple(r) for r in R.single_document_names(df, order="id", text="text").collect()] == [("000000.txt", "y"), ("000001.txt", "x")]


def test_sections(spark):
    kind = "article struct<section_name:array<string>,document:array<string>,summary:array<string>>, url string"
    rows = R.sections(spark.createDataFrame([((["n"], ["d"], ["s"]), "u")], kind)).collect()
    assert [(r.url, r.section_name, r.document, r.summary) for r in rows] == [("u", "n", "d", "s")]
    with pytest.raises(Exception, match="differ in length"):
        R.sections(spark.createDataFrame([((["n"], ["d"], []), "u")], kind)).collect()


def test_long_documents_are_in_the_last_bin(spark, tmp_path):
    from condensa.queries import QUERIES

    spark.createDataFrame([("en", "x" * n) for n in (0, 399, 400, 20_000, 20_001, 150_000)] + [("de", None)], "lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r.lang, r.bin): r.n for r in QUERIES["sink_plot"](spark, str(tmp_path)).collect()} == {("en", 0): 2, ("en", 1): 1, ("en", 49): 3}


def test_corpora_and_filters_by_name(spark):
    from condensa.plans.sources import load

    data = "/root/testdata/sf0.001"
    if os.path.isdir(data):
        assert load(spark, data, "documents", "default").count() < load(spark, data, "documents", "short").count() < load(spark, data, "documents").count()
    for bad in (("nothing", "none"), ("documents", "nothing")):
        with pytest.raises(ValueError):
            load(spark, data, *bad)
