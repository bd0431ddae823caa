import json

from condensa.operators.cleaning import Cleaner
from condensa.streaming.cleaning import first_pairs, stream_reasons, windowed_breakdown

SCHEMA = "at timestamp, reference string, summary string"
ROWS = [
    ("2024-01-01 00:00:01", "a reference of some length", "summary"),
    ("2024-01-01 00:00:02", "a reference of some length", "summary"),
    ("2024-01-01 00:00:03", "short", "s"),
    ("2024-01-01 00:11:00", "another reference text", "another reference text"),
    ("2024-01-01 00:12:00", None, None),
]


def source(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(json.dumps(dict(zip(("at", "reference", "summary"), r))) for r in ROWS))
    return spark.readStream.schema(SCHEMA).json(str(folder))


def drained(df, spark, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_reasons(spark, tmp_path):
    rows = drained(stream_reasons(source(spark, tmp_path), Cleaner(min_length_reference=10)), spark, tmp_path, "reasons")
    assert [r.reason for r in sorted(rows, key=lambda r: r["at"])] == [None, None, "reference_too_short", "identity_sample", "reference_too_short"]


def test_range_of_extractiveness(spark, tmp_path):
    rows = drained(stream_reasons(source(spark, tmp_path), Cleaner(extractiveness=(0.5, 0.9))), spark, tmp_path, "ranged")
    assert sum(r.reason == "extractiveness" for r in rows) == 3


def test_pairs_come_once(spark, tmp_path):
    rows = drained(first_pairs(source(spark, tmp_path), time="at", delay="1 hour"), spark, tmp_path, "once")
    assert len(rows) == 4


def test_windows(spark, tmp_path):
    told = stream_reasons(source(spark, tmp_path), Cleaner(min_length_reference=10))
    rows = drained(windowed_breakdown(told, time="at", delay="1 minute", window="10 minutes"), spark, tmp_path, "windows", "complete")
    assert {(r.start.minute, r.reason, r.n) for r in rows} == {(0, "kept", 2), (0, "reference_too_short", 1), (10, "identity_sample", 1), (10, "reference_too_short", 1)}
