import math
import random

import numpy as np
import pyarrow as pa
import pytest

import by_hand
from cases import empty, odd
from condensa.llm._graph import components
from condensa.llm.simhash import chunk_shares, chunk_width, close_pairs, close_signatures, close_windows, deduplicate, near_duplicates, signatures

V = [f"w{i}q" for i in range(4000)]


def corpus(seed=1):
    rng, rows = random.Random(seed), []
    for i in range(60):
        base = rng.choices(V, k=rng.randint(30, 300))
        rows.append((i, " ".join(base)))
        for k in range(i % 4):
            new = list(base)
            for _ in range(max(1, len(base) // 40)):
                new[rng.randrange(len(new))] = rng.choice(V)
            rows.append((100 + 10 * i + k, " ".join(new if k else base)))
    return rows


def groups(rows, radius):
    sigs = [np.frombuffer(s, np.uint64) for s in signatures(pa.array([t for _, t in rows]))]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if np.bitwise_count(sigs[i] ^ sigs[j]).sum() <= radius:
                up[max(root(i), root(j))] = min(root(i), root(j))
    out = {}
    for i in range(len(rows)):
        out.setdefault(root(i), []).append(rows[i][0])
    return [g for g in out.values() if len(g) > 1]


@pytest.mark.parametrize("radius,tile", [(50, 8192), (50, 7), (0, 16), (110, 16)])
def test_groups_are_those_of_all_pairs(spark, radius, tile):
    rows = corpus()
    want = {(x, min(g)) for g in groups(rows, radius) for x in g}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in near_duplicates(df, radius=radius, tile=tile).collect()} == want


def test_copies_and_near_copies_are_found_and_others_left(spark):
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in deduplicate(df).collect()}
    assert kept == set(range(60))


def test_signatures_by_hand():
    rng = random.Random(9)
    texts = ["", "one", "One, one; ONE", "\u00c4rger \u65e5\u672c\u8a9e d\u00e9j\u00e0", "a b a b a", *(" ".join(rng.choices(V, k=k)) for k in (2, 33, 300, 700))]
    got = signatures(pa.array(texts))
    assert got[0] is None and [int.from_bytes(s, "big") for s in got[1:]] == [by_hand.signature(t) for t in texts[1:]]


def test_groups_by_hand(spark):
    rows = corpus(8)[:70]
    want = {(x, min(g)) for g in by_hand.near_groups(rows) for x in g}
    assert {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_many_tiles_and_blocks(spark, monkeypatch):
    """More tiles than a block holds: every pair of tiles is met once, whatever the blocks."""
    monkeypatch.setattr("condensa.llm.simhash.TASK_TILES", 3)
    rows = corpus(2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(x, min(g)) for g in groups(rows, 50) for x in g}
    assert {tuple(r) for r in near_duplicates(df, tile=9).collect()} == want


def test_rows_of_files_aren_t_copied_or_shuffled(spark, tmp_path):
    """What deduplicate gives is a scan of docs' files with a look at marks: no join, no exchange, no second table."""
    spark.createDataFrame(corpus(3), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/docs")
    out = deduplicate(spark.read.parquet(f"{tmp_path}/docs"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and f"{tmp_path}/docs" in plan
    assert {r.doc_id for r in out.collect()} == set(range(60))


def test_long_texts_are_signed_whole(spark):
    text = "some words here " * 300_000
    rows = [(1, text + "the end is this"), (2, "the end is this")]
    assert near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), radius=0).count() == 0
    a, b = signatures(pa.array([text + "and x y z", text]))
    assert a != b


@pytest.mark.parametrize("same", [True, False])
def test_close_pairs(same):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, (50, 4), dtype=np.uint64)
    b = a if same else np.concatenate([a[:20] ^ np.uint64(3), rng.integers(0, 2**63, (10, 4), dtype=np.uint64)])
    got = {(int(x), int(y)) for xs, ys in close_pairs(a, b, 100, same=same) for x, y in zip(xs, ys)}
    want = {(i, j) for i in range(len(a)) for j in range(len(b)) if np.bitwise_count(a[i] ^ b[j]).sum() <= 100 and (not same or i < j)}
    assert got == want


def test_odd_rows(spark):
    df = odd(spark)
    assert {tuple(r) for r in near_duplicates(df).collect()} == {(907, 907)}
    out = deduplicate(df)
    assert out.columns == df.columns and out.count() == df.count() - 1


def test_empty(spark):
    assert near_duplicates(empty(spark)).collect() == [] and deduplicate(empty(spark)).collect() == []


def test_thousands_of_copies_are_one_group(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "'the same words again and again in every row' AS text")
    assert deduplicate(df).collect()[0].doc_id == 0 and deduplicate(df).count() == 1


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(None, 1), (5, 5)]
    up = list(range(500))
    for a, b in edges:
        if a is not None:
            x, y = a, b
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            up[max(x, y)] = min(x, y)

    def root(x):
        return x if up[x] == x else root(up[x])

    nodes = {x for e in edges if e[0] is not None and e[0] != e[1] for x in e}
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, root(x)) for x in nodes}


@pytest.mark.parametrize("radius,width,bits", [(50, 11, 19), (50, 8, 5), (50, 16, 4), (0, 9, 5), (3, 8, 4), (110, 20, 6)])
def test_groups_by_chunks_are_those_of_all_pairs(spark, monkeypatch, radius, width, bits):
    """In pieces that are full, so that keys have several, and of several first bits."""
    monkeypatch.setattr("condensa.llm.simhash.chunk_width", lambda n, radius: width)
    monkeypatch.setattr("condensa.llm.simhash.PIECE_BITS", bits)
    rows = corpus(4)
    want = {(x, min(g)) for g in groups(rows, radius) for x in g}
    assert {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), radius=radius).collect()} == want


def test_many_signatures_aren_t_all_compared(spark):
    """Each pair in the radius is given once, wherever its bits are, and none beyond; few pairs are looked at."""
    rng = np.random.default_rng(5)
    n, radius = 50_000, 50
    sigs = rng.integers(0, 256, (n, 32), dtype=np.uint8)
    order, want = rng.permutation(n), set()
    for k in range(600):
        a, b = order[2 * k : 2 * k + 2]
        bits = np.unpackbits(sigs[a])
        at = rng.choice(256, 50 + k % 2, replace=False) if k % 3 else np.arange(k % 5, 256, 5)[: 50 + k % 2]
        bits[at] ^= 1
        sigs[b] = np.packbits(bits)
        if k % 2 == 0:
            want.add(frozenset((sigs[a].tobytes(), sigs[b].tobytes())))
    df = spark.createDataFrame([(bytearray(s.tobytes()),) for s in sigs], "sig binary").repartition(4)
    got = [frozenset((bytes(r.a), bytes(r.b))) for r in close_signatures(df, radius=radius).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    for n in (50_000, 3_000_000, 15_000_000):
        width = chunk_width(n, radius)
        met = sum(sum(math.comb(width, k) for k in range(t + 1)) for t in chunk_shares(radius, width)) / 2**width
        assert met < (0.6 if n == 50_000 else 0.1)


@pytest.mark.parametrize("same", [True, False])
def test_close_windows(same):
    rng = np.random.default_rng(6)
    a = np.sort(rng.integers(0, 2**62, 400, dtype=np.uint64) | np.uint64(1 << 63))
    b = a if same else np.sort(np.concatenate([a[:40] ^ np.uint64(1 << 50), rng.integers(0, 2**62, 200, dtype=np.uint64) | np.uint64(1 << 63)]) ^ np.uint64(1 << 62))
    got = [(int(x), int(y)) for xs, ys in close_windows(a, b, same=same, width=10, head=2, share=3, limit=20) for x, y in zip(xs, ys)]
    window = np.uint64((1 << 64) - 16)
    near = lambda x, y: np.bitwise_count((x ^ y) >> np.uint64(54)) <= 3 and np.bitwise_count((x ^ y) & window) <= 20
    assert sorted(got) == [(i, j) for i in range(len(a)) for j in range(len(b)) if near(a[i], b[j]) and (not same or i < j)] and got


def test_a_dense_group_by_chunks(spark, monkeypatch):
    """A thousand near copies of one text, all within the radius of each other, are one group."""
    monkeypatch.setattr("condensa.llm.simhash.chunk_width", lambda n, radius: 12)
    rng = np.random.default_rng(7)
    bits = np.repeat(rng.integers(0, 2, (1, 256), dtype=np.uint8), 1000, 0)
    for row in bits:
        row[rng.choice(256, 6, replace=False)] ^= 1
    df = spark.createDataFrame([(bytearray(s.tobytes()),) for s in np.packbits(bits, axis=1)], "sig binary").distinct()
    found = components(close_signatures(df))
    assert found.count() == df.count() and found.select("component").distinct().count() == 1
