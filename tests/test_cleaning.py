import random

import pytest
from pyspark.sql import functions as F

from condensa.operators.cleaning import REASONS, Cleaner, breakdown, duplicates, each_removed, matching, removed_as_text
from condensa.operators.leakage import duplicate_report, leaked_texts, repeated_texts

SPLITS = ("train", "validation", "test")


def frame(spark, **splits):
    rows = [(s, SPLITS.index(s), i, r, t) for s, pairs in splits.items() for i, (r, t) in enumerate(pairs)]
    return spark.createDataFrame(rows, "split string, split_order int, row_id long, reference string, summary string")


def kept(cleaner, df):
    return sorted((r.split, r.row_id) for r in cleaner.clean(df).collect())


@pytest.mark.parametrize("pair,options,n", [
    (("This is a test.", "Summary text."), dict(min_length_summary=5, min_length_reference=15), 1),
    (("This is a.", "Summary text."), dict(min_length_summary=5, min_length_reference=15), 0),
    (("This is a test.", "Summ"), dict(min_length_summary=5, min_length_reference=15), 0),
    (("This is a test.", "This is a test."), {}, 0),
    (("This is a.", "This is a test."), {}, 0),
    (("This is a test.", "This is a"), dict(extractiveness=(0.0, 0.9)), 0),
    ((None, "x"), {}, 0),
    (("abc", None), {}, 0),
])
def test_single_rows(spark, pair, options, n):
    assert len(kept(Cleaner(**options), frame(spark, train=[pair]))) == n


def test_a_removed_row_does_not_block(spark):
    df = frame(spark, train=[("This is a test.", "Summary text."), ("This is a test.", "Summary."), ("This is a.", "Summary.")])
    assert kept(Cleaner(dedup="first"), df) == [("train", 0), ("train", 2)]


def test_order_of_splits(spark):
    df = frame(spark, train=[("This is a test.", "Summary text.")], test=[("This is a test sentence.", "Summary text.")])
    assert kept(Cleaner(dedup="test_first"), df) == [("test", 0)]
    assert kept(Cleaner(dedup="first"), df) == [("train", 0)]
    assert len(kept(Cleaner(dedup="none"), df)) == 2


@pytest.mark.parametrize("edges,why", [
    ([(1, 1), (2, 1), (2, 2), (3, 2), (3, 3)], [None, "summary_duplicate", None, "summary_duplicate", None]),
    ([(1, 1), (2, 2), (1, 2)], [None, None, "both_duplicate"]),
    ([(1, 1), (1, 1)], [None, "exact_duplicate"]),
    ([(1, 1), (2, 1), (2, 2)], [None, "summary_duplicate", None]),
    ([(1, 1), (1, 2)], [None, "reference_duplicate"]),
])
def test_reasons(spark, edges, why):
    df = frame(spark, train=[(f"reference number {r} is long enough", f"summary {s}") for r, s in edges])
    assert [r.reason for r in Cleaner(dedup="first").reasons(df).orderBy("row_id").collect()] == why


def scan(edges):
    refs, sums, pairs, out = set(), set(), set(), {}
    for p, r, s in sorted(edges):
        out[p] = "exact_duplicate" if (r, s) in pairs else "both_duplicate" if r in refs and s in sums else "reference_duplicate" if r in refs else "summary_duplicate" if s in sums else None
        if out[p] is None:
            refs.add(r)
            sums.add(s)
            pairs.add((r, s))
    return out


@pytest.mark.parametrize("seed,n,keys", [(1, 300, 60), (2, 300, 400), (3, 60, 5)])
def test_rounds_are_a_scan(spark, seed, n, keys):
    rng = random.Random(seed)
    edges = [(i, rng.randrange(keys), rng.randrange(keys)) for i in range(n)]
    got = {r.place: r.why for r in duplicates(spark.createDataFrame(edges, "place long, r long, s long")).collect()}
    assert got == scan(edges)


def test_long_chains_end_in_a_scan(spark):
    edges = [(i, (i + 1) // 2, i // 2) for i in range(120)]
    got = {r.place: r.why for r in duplicates(spark.createDataFrame(edges, "place long, r long, s long")).collect()}
    assert got == scan(edges)


@pytest.mark.parametrize("rounds", [1, 2])
@pytest.mark.parametrize("seed,n,keys", [(1, 300, 60), (2, 300, 400), (4, 200, 90)])
def test_what_rounds_leave_is_scanned_by_groups(spark, seed, n, keys, rounds):
    rng = random.Random(seed)
    edges = [(i, rng.randrange(keys), rng.randrange(keys)) for i in range(n)]
    df = spark.createDataFrame(edges, "place long, r long, s long").dropDuplicates(["r", "s"])
    rows = sorted(map(tuple, df.collect()))
    want = {p for p, why in scan(rows).items() if why is None}
    assert {r.place for r in matching(df, max_rounds=rounds).collect()} == want


def test_no_window_and_no_single_task(spark):
    """The corpus meets the few rows with a reason; it is neither windowed nor sorted as a whole in one task."""
    df = frame(spark, train=[(f"reference text number {i % 7}", f"summary {i % 5}") for i in range(40)])
    plan = Cleaner(dedup="first").reasons(df)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_columns_named_as_the_result_s(spark):
    df = frame(spark, train=[("a reference text", "summary"), ("a reference text", "other")]).withColumn("reason", F.lit("mine"))
    out = Cleaner(dedup="first").clean(df)
    assert out.columns == df.columns and [r.reason for r in out.collect()] == ["mine"]
    with pytest.raises(ValueError, match="reason"):
        Cleaner().reasons(df)
    assert Cleaner(dedup="first").reasons(df, into="why").where("why IS NOT NULL").count() == 1


def test_a_function_is_called_with_every_removed_row(spark, tmp_path):
    df = frame(spark, train=[("a reference text", "summary"), ("a reference text", "other"), ("x", "longer than x")])

    def note(row, reason, folder=str(tmp_path)):
        with open(f"{folder}/{row.row_id}", "w") as f:
            f.write(removed_as_text(row, reason))

    each_removed(Cleaner(dedup="first").reasons(df), note)
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == {"1": "reference_duplicate (train 1): other <- a reference text", "2": "compression_ratio (train 2): longer than x <- x"}


def test_a_low_ratio_is_warned_of():
    with pytest.warns(UserWarning, match="ratio"):
        Cleaner(min_compression_ratio=0.5)


def test_rows_alike_in_everything_keep_one(spark):
    df = frame(spark, train=[("a reference text", "summary")])
    told = Cleaner(dedup="first").reasons(df.unionByName(df).unionByName(df)).collect()
    assert sorted(str(r.reason) for r in told) == ["None", "exact_duplicate", "exact_duplicate"]


def test_breakdown_adds_up(spark):
    df = frame(spark, train=[("abcdef", "ab"), ("abcdef", "ab"), ("x", "xyz")], test=[("abcdef", "q")]).withColumn("reason_", F.lit(1))
    told = Cleaner().reasons(df)
    rows = breakdown(told).collect()
    assert {r.reason for r in rows} == set(REASONS)
    assert sum(r.train + r.validation + r.test for r in rows) + told.where("reason IS NULL").count() == 4
    assert "reason_" in told.columns


def test_empty_corpus(spark):
    assert Cleaner().reasons(frame(spark, train=[("a", "b")]).where("false")).collect() == []


@pytest.mark.parametrize("bad", [dict(dedup="last"), dict(length_metric="page"), dict(min_compression_ratio=-1), dict(min_length_summary=-1), dict(extractiveness=(0, 2)), dict(extractiveness="half"), dict(extractiveness=(0.9, 0.1))])
def test_bad_options(bad):
    with pytest.raises(ValueError):
        Cleaner(**bad)


def test_repeats_and_leaks(spark):
    df = frame(spark, train=[("a", "s"), ("a", "t"), (None, "u")], validation=[("a", "t")], test=[("b", "s")])
    assert {tuple(r) for r in repeated_texts(df).collect()} == {("train", "reference", "a", 2)}
    assert {tuple(r) for r in leaked_texts(df).collect()} == {("reference", "train", "validation", "a"), ("summary", "train", "validation", "t"), ("summary", "train", "test", "s")}
    assert duplicate_report(df).count() == 4
    with pytest.raises(ValueError):
        duplicate_report(df, method="fuzzy")
