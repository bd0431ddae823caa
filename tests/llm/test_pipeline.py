import importlib.util
import os
import shutil

import by_hand
import pytest
from cases import empty, odd

DATA = "/root/testdata/sf0.001"
KEY = "a key of the tests"

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None or not os.path.isdir(DATA), reason="no pipeline or tables")


@pytest.fixture
def key(spark):
    from condensa.llm.pii import KEY_SETTING

    spark.conf.set(KEY_SETTING, KEY)
    yield KEY.encode()
    spark.conf.unset(KEY_SETTING)


def grams(text, n=13):
    import re

    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def test_stages_by_hand(spark, key):
    """Each stage from its description: features and signatures as plain numbers, all pairs, all windows, the public encoder."""
    import corpus_pipeline as C
    from condensa.llm import pii
    from condensa.llm._tokenizer import default_path, encoding
    from condensa.llm.toxicity import train

    assert [n for n, _ in C.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "bpe"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    left = [(d, t) for d, t in rows if not by_hand.toxicity(t, model)[1]]
    assert 0 < len(left) < len(rows)
    gone = {x for g in by_hand.near_groups(left) for x in g if x != min(g)}
    assert gone
    left = [r for r in left if r[0] not in gone]
    items = set().union(*(grams(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()))
    left = [(d, t) for d, t in left if not grams(t) & items]
    want = {d: pii.pseudonymise_text(t, key)[0] for d, t in left}
    enc, out = encoding(default_path()), C.run(spark, DATA)
    got = {r.doc_id: (r.tokens, r.decoded) for r in out.collect()}
    assert out.count() == len(want) and got == {d: (enc.encode_ordinary(t), t) for d, t in want.items()}


def test_columns_stay_until_the_last_stage(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40).cache()
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.count() <= 40
    assert C.STAGES[-1][1](spark, docs, DATA).count() == 40


def folder(tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        shutil.copy(f"{DATA}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    return str(tmp_path)


def test_odd_rows_run_through(spark, key, tmp_path):
    import corpus_pipeline as C

    df = odd(spark)
    out = {(r.doc_id, r.decoded): r.tokens for r in C.run(spark, folder(tmp_path, df)).collect()}
    rows = {(r.doc_id, r.text) for r in df.collect()}  # one of the two that are alike
    assert set(out) == rows and out[901, None] is None and out[902, ""] == []


def test_an_empty_table_runs_through(spark, key, tmp_path):
    import corpus_pipeline as C

    assert C.run(spark, folder(tmp_path, empty(spark))).collect() == []


def test_only_the_result_stays(spark, key, tmp_path):
    import corpus_pipeline as C
    from condensa.storage import shared_dir

    there = lambda: set(os.listdir(shared_dir(spark).removeprefix("file://").removeprefix("file:")))
    before = there()
    out = C.run(spark, folder(tmp_path, odd(spark)))
    new = there() - before
    assert len(new) == 1 and new.pop().startswith("pipeline-bpe") and out.count() > 0
