import os

import pytest
from pyspark.sql import functions as F

from condensa import storage as S
from condensa.sources.readers import numbered_lines


def listed(spark):
    return set(os.listdir(S.shared_dir(spark).removeprefix("file://").removeprefix("file:")))


def test_scratch_tables_are_deleted_and_others_stay(spark):
    before, df = listed(spark), spark.range(5).toDF("id")
    with S.scratch(spark):
        S.written(df, "inside")
        with S.scratch(spark):
            S.written(df, "further-inside")
        assert len(listed(spark) - before) == 1
        with pytest.raises(ZeroDivisionError), S.scratch(spark):
            S.written(df, "gone-too")
            1 / 0
    assert listed(spark) == before
    out = S.written(df, "stays")
    assert len(listed(spark) - before) == 1 and out.count() == 5


def test_rows_of_files_have_a_place_without_a_copy(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 AS __x").repartition(3).write.parquet(f"{tmp_path}/t")
    before = listed(spark)
    df, rows = S.placed(spark.read.parquet(f"{tmp_path}/t").where("id > 9"), "p")
    assert listed(spark) == before and rows.columns == ["id", "__x", "__file", "__at"]
    places = {r["id"]: (r["__file"], r["__at"]) for r in rows.collect()}
    assert len(set(places.values())) == 90 == df.count()
    assert places == {r["id"]: (r["__file"], r["__at"]) for r in rows.repartition(2).collect()}


def test_other_frames_are_written_once(spark):
    before = listed(spark)
    df, rows = S.placed(spark.range(20).selectExpr("id", "rand() AS x"), "p")
    assert len(listed(spark) - before) == 1
    assert sorted(map(str, rows.collect())) == sorted(map(str, rows.collect())) and df.columns == ["id", "x"]
    assert S.placed(spark.range(0).toDF("id"), "p")[1].count() == 0


@pytest.mark.parametrize("make", [
    lambda df: df.select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")), lambda df: df.limit(7), lambda df: df.where(F.rand() < 0.5), lambda df: df.union(df), lambda df: df.join(df, "id"), lambda df: df.groupBy("id").count(),
])
def test_several_or_other_rows_of_a_file_s_row_have_places_of_their_own(spark, tmp_path, make):
    spark.range(50).toDF("id").repartition(2).write.parquet(f"{tmp_path}/t")
    df, rows = S.placed(make(spark.read.parquet(f"{tmp_path}/t")), "p")
    first = sorted((r["__file"], r["__at"], r["id"]) for r in rows.collect())
    assert len({x[:2] for x in first}) == len(first) == df.count() and first == sorted((r["__file"], r["__at"], r["id"]) for r in rows.collect())


def test_other_formats_are_written_once(spark, tmp_path):
    spark.range(9).toDF("id").write.json(f"{tmp_path}/t")
    rows = S.placed(spark.read.schema("id long").json(f"{tmp_path}/t"), "p")[1]
    assert len({(r["__file"], r["__at"]) for r in rows.collect()}) == 9


def test_small_tables_are_spread_only_if_asked_for(spark):
    df = spark.range(10).coalesce(1)
    assert S.spread(df) is df
    spark.conf.set(S.PARTITIONS, "3")
    try:
        assert S.spread(df).rdd.getNumPartitions() == 3
    finally:
        spark.conf.unset(S.PARTITIONS)


def test_numbers_in_order(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k").repartition(5)
    assert {(r.k, r.pos) for r in S.in_order(df, "k").collect()} == {(k, k) for k in range(1000)}
    assert {(r.k, r.pos) for r in S.in_order(df, F.desc("k")).collect()} == {(k, 999 - k) for k in range(1000)}
    assert S.in_order(df.limit(0), "k").collect() == []


@pytest.mark.parametrize("block", ["100", "128m"])
def test_lines_of_files_in_blocks(spark, tmp_path, block):
    want = []
    for name in ("b", "a", "c"):
        lines = [f"{name} line {i}" for i in range(57)] + ["", " blank \r"]
        (tmp_path / f"{name}.txt").write_text("\n".join(lines) + ("\n" if name != "c" else ""))
    for name in "abc":
        want += [f"{name} line {i}" for i in range(57)] + ["", " blank \r"]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        assert [(r.pos, r.line) for r in numbered_lines(spark, str(tmp_path)).orderBy("pos").collect()] == list(enumerate(want))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
