"""SimHash near-duplicates by exact comparison.

A text's features are its distinct words and pairs of neighbours; each votes with 256
hashed bits, and the majority is the signature. Equal signatures collapse first, so that
thousands of copies cost one comparison. A task gives back no more pairs than join what it
found, so a group of n near copies costs n pairs, not n². Groups are connected components.

Few distinct signatures, or a wide radius: all pairs. Sorted by population count, they are
written as tiles of fixed size to the shared folder; every tile meets itself and the half of
the others that follow it in a circle, so that each pair is compared once and tasks are
alike. Two tiles are skipped if their population counts differ by more than the radius,
which is exact: the distance is never less than that difference.

Many: by chunks. The bits are a ring of chunks, and the radius plus one is shared out among
them. Where a pair's distance is in the radius, the chunks' distances less their shares add
up to less than nothing, so by the cycle lemma there is a chunk from which on every partial
sum is negative: that chunk differs in fewer bits than its share, and so does the window of
64 bits that it begins. A pair is only met where its chunks are that close, only looked at
further where the window is, and only given by one such chunk. No pair in the radius is lost.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import placed, spread
from ._arrow import gram_hashes, mix, word_slices
from ._graph import components
from ._shared import marked, new_dir, small_batches, write_marks, written

BITS = 256
#: Bits that may differ. Texts with one word in twenty replaced differ by about 40, texts of one language by 100.
RADIUS = 50
#: Signatures of a tile, and pairs of tiles of a task.
TILE = 8192
TASK_TILES = 64
#: A piece, of which two are in memory at once, has at most 2 ** PIECE_BITS signatures of 32 bytes.
PIECE_BITS = 19
#: Pairs whose windows are compared in one step.
STEP_PAIRS = 1 << 17

_SALTS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], np.uint64)


def _majority(features: np.ndarray) -> bytes:
    votes = np.zeros(BITS, np.int64)
    for a in range(0, len(features), 8160):
        bits = np.unpackbits(mix(features[a : a + 8160, None] ^ _SALTS).view(np.uint8), axis=1)
        for k in range(0, len(bits), 255):  # sums that fit a byte
            votes += bits[k : k + 255].sum(0, dtype=np.uint8)
    return np.packbits(votes * 2 > len(features)).tobytes()


def signatures(texts: pa.Array) -> list[bytes | None]:
    """A signature for each text; None for one that is null or only white space.

    A text without words has the digest of its stripped self, so that only copies meet.
    """
    out: list[bytes | None] = []
    for _, _, h, _, _, bounds, piece, offs in word_slices(texts):
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            if b > a:
                own = h[a:b]
                out.append(_majority(np.unique(np.concatenate([own, gram_hashes(own, 2)]))))
            else:
                rest = piece[offs[k] : offs[k + 1]].tobytes().decode().strip()
                out.append(hashlib.blake2b(rest.encode(), digest_size=BITS // 8).digest() if rest else None)
    return out


def _as_words(sigs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sigs.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, *, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a and of b at most radius bits apart; of one tile with itself, each pair once.

    The last quarter of the bits is only looked at where the others don't rule a pair out.
    """
    columns = [np.ascontiguousarray(b[:, k]) for k in range(b.shape[1])]
    lead = 3 * len(columns) // 4
    for i in range(0, len(a), 16):
        rows = a[i : i + 16]
        d = np.bitwise_count(rows[:, :1] ^ columns[0])
        for k in range(1, lead):
            d += np.bitwise_count(rows[:, k : k + 1] ^ columns[k])
        at = np.flatnonzero(d <= radius)
        if not len(at):
            continue
        x, y = np.divmod(at, len(b))
        if same:
            own = x + i < y
            at, x, y = at[own], x[own], y[own]
        total = d.ravel()[at].astype(np.int64)
        for k in range(lead, len(columns)):
            total += np.bitwise_count(rows[x, k] ^ columns[k][y])
        hit = total <= radius
        if hit.any():
            yield x[hit] + i, y[hit]


class _Forest:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _put(store, root: str, raw: bytes) -> str:
    """Write a file and give its name. A task that runs again leaves the same file."""
    name = f"{hashlib.sha256(raw).hexdigest()[:32]}.sig"
    tmp = f"{root}/.{uuid.uuid4().hex}"
    store.create_dir(root, recursive=True)
    with store.open_output_stream(tmp) as f:
        f.write(raw)
    store.move(tmp, f"{root}/{name}")
    return name


def _tiles(distinct: DataFrame, folder: str, tile: int) -> DataFrame:
    """Write the signatures (sig, in an order) as tiles: (name, n, low, high), the last two the least and greatest population count."""
    from pyarrow import fs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        held: list[np.ndarray] = []
        rows: list[tuple[str, int, int, int]] = []

        def put(words: np.ndarray) -> None:
            pops = np.bitwise_count(words).sum(1)
            rows.append((_put(store, root, words.tobytes()), len(words), int(pops.min()), int(pops.max())))

        for batch in batches:
            held.append(_as_words(batch.column("sig")))
            if sum(map(len, held)) >= tile:
                whole = np.concatenate(held)
                for k in range(0, len(whole) - tile + 1, tile):
                    put(whole[k : k + tile])
                held = [whole[len(whole) // tile * tile :]]
        if held and sum(map(len, held)):
            put(np.concatenate(held))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["name", "n", "low", "high"])

    return written(distinct.mapInArrow(run, "name string, n long, low long, high long"), "simhash-tiles")


def chunk_shares(radius: int, width: int) -> list[int]:
    """For each chunk of width bits the number of bits that may differ, -1 for none: these plus one add up to the radius plus one."""
    m = BITS // width
    return [(k + 1) * (radius + 1) // m - k * (radius + 1) // m - 1 for k in range(m)]


def _head_bits(n: int, width: int) -> int:
    return min(width, max(0, (n - 1).bit_length() - PIECE_BITS))


def chunk_width(n: int, radius: int) -> int:
    """The width of chunks by which n signatures are compared with the least work; 0 where all pairs are less.

    Rough nanoseconds of a core: 4 a pair of signatures, 1 a pair of windows, 60,000 a bucket
    that is met in each two pieces, and a tenth of a second for a chunk's tasks.
    """
    pairs = n * n / 2

    def work(width: int) -> float:
        shares = [t for t in chunk_shares(radius, width) if t >= 0]
        met = sum(comb(width, k) for t in shares for k in range(t + 1)) / 2**width
        return met * pairs + len(shares) * (6e4 * min(n, 2**width) * 2 ** max(0, _head_bits(n, width) - 1) + 1e8)

    best = min(range(8, 21), key=work)
    return best if work(best) < 4 * pairs else 0


def _turned(bits: np.ndarray, k: int, width: int) -> np.ndarray:
    """Rows of bits from chunk k on, round the ring; bits beyond the last whole chunk stay at the end."""
    whole = BITS // width * width
    return np.concatenate([bits[:, k * width : whole], bits[:, : k * width], bits[:, whole:]], 1)


def _owner(bits: np.ndarray, shares: list[int], width: int) -> np.ndarray:
    """For rows of differing bits, in the order of chunks, the one chunk that gives the pair."""
    over = bits[:, : len(shares) * width].reshape(len(bits), len(shares), width).sum(2, dtype=np.int64) - (np.array(shares) + 1)
    before = np.cumsum(over, 1) - over
    return before.shape[1] - 1 - before[:, ::-1].argmax(1)  # the last of the greatest


def close_windows(a: np.ndarray, b: np.ndarray, *, same: bool, width: int, head: int, share: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a and of b, sorted words, whose first width bits differ in at most share and whose whole chunks in at most limit.

    The first head bits are one value in all of a and one in all of b. Of a with itself, each pair once.
    """
    if not len(a) or not len(b):
        return
    low = width - head
    chunk_a, chunk_b = ((x >> np.uint64(64 - width)).astype(np.int64) for x in (a, b))
    rest = share - int(np.bitwise_count((chunk_a[0] ^ chunk_b[0]) >> low))
    masks = np.flatnonzero(np.bitwise_count(np.arange(1 << low, dtype=np.uint32)) <= rest) if rest >= 0 else []
    if not len(masks):
        return
    starts = np.searchsorted(chunk_b, (chunk_b[0] >> low << low) + np.arange((1 << low) + 1))
    window = np.uint64((1 << 64) - (1 << 64 - 64 // width * width))
    a, b = a & window, b & window
    edges = np.flatnonzero(np.diff(chunk_a, prepend=-1))
    for begin, end in zip(edges.tolist(), [*edges[1:].tolist(), len(a)]):
        value = int(chunk_a[begin]) & (1 << low) - 1
        met = masks ^ value
        if same:
            met = met[met >= value]
        first = starts[met]
        count = starts[met + 1] - first
        total = int(count.sum())
        if not total:
            continue
        index = np.repeat(first - np.cumsum(count) + count, count) + np.arange(total)
        seen = b[index]
        step = max(1, STEP_PAIRS // total)
        for i in range(begin, end, step):
            hit = np.flatnonzero(np.bitwise_count(a[i : min(end, i + step), None] ^ seen) <= limit)
            if len(hit):
                x, y = np.divmod(hit, total)
                x, y = x + i, index[y]
                if same:
                    x, y = x[x < y], y[x < y]
                yield x, y


def _pieces(distinct: DataFrame, folder: str, width: int, head: int, shares: list[int]) -> DataFrame:
    """Write the signatures once for each chunk, turned so that it comes first, as sorted pieces: (chunk, head, name)."""
    from pyarrow import fs

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []

        def out() -> Iterator[pa.RecordBatch]:
            raw = np.frombuffer(b"".join(s for x in held for s in x.to_pylist()), np.uint8).reshape(-1, BITS // 8)
            bits = np.unpackbits(raw, axis=1)
            for k, share in enumerate(shares):
                if share >= 0:
                    turned = np.packbits(_turned(bits, k, width), axis=1)
                    heads = (np.ascontiguousarray(turned[:, :4]).view(">u4")[:, 0] >> np.uint32(32 - head)).astype(np.int64) if head else np.zeros(len(turned), np.int64)
                    order = np.argsort(heads, kind="stable")
                    found, at = np.unique(heads[order], return_index=True)
                    parts = [turned[own].tobytes() for own in np.split(order, at[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), pa.int32()), pa.array(found, pa.int32()), pa.array(parts, pa.binary())], ["chunk", "head", "sigs"])

        for batch in batches:
            held.append(batch.column("sig"))
            if sum(map(len, held)) >= 1 << 15:
                yield from out()
                held = []
        if sum(map(len, held)):
            yield from out()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        now, held = None, []

        def put(most: int) -> Iterator[pa.RecordBatch]:
            raw = np.frombuffer(b"".join(held), np.uint8).reshape(-1, BITS // 8)
            held.clear()
            for i in range(0, len(raw), most):
                own = raw[i : i + most]
                name = _put(store, root, own[np.argsort(np.ascontiguousarray(own[:, :8]).view(">u8")[:, 0].astype(np.uint64))].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([name])], ["chunk", "head", "name"])

        for batch in batches:
            for row in batch.to_pylist():
                if (key := (row["chunk"], row["head"])) != now or sum(map(len, held)) * 8 // BITS >= 1 << PIECE_BITS:
                    yield from put(1 << PIECE_BITS)
                    now = key
                held.append(row["sigs"])
        yield from put(1 << PIECE_BITS)

    parts = small_batches(distinct).mapInArrow(cut, "chunk int, head int, sigs binary").repartition("chunk", "head").sortWithinPartitions("chunk", "head")
    return written(parts.mapInArrow(keep, "chunk int, head int, name string"), "simhash-pieces")


def _close_by_chunks(distinct: DataFrame, n: int, radius: int, width: int) -> DataFrame:
    """close_signatures by chunks of width bits: a task is two pieces of one chunk's order whose first bits are close enough."""
    from pyarrow import fs

    spark = distinct.sparkSession
    folder = new_dir(spark, "simhash-chunks")
    shares, head = chunk_shares(radius, width), _head_bits(n, width)
    m, ring = len(shares), [*shares, *shares]
    pieces = _pieces(distinct, folder, width, head, shares)
    a, b = (pieces.select("chunk", F.col("head").alias(f"head_{x}"), F.col("name").alias(x)) for x in "ab")
    share = F.element_at(F.array(*map(F.lit, shares)), F.col("chunk") + 1)
    work = a.join(b, "chunk").where("(head_a, a) <= (head_b, b)").where(F.bit_count(F.col("head_a").bitwiseXOR(F.col("head_b"))) <= share)
    # A row for two pieces of up to half a million signatures each: one task numbers them.
    work = written(work.select("chunk", "a", "b", (F.row_number().over(Window.orderBy("head_a", "head_b", "a", "b", "chunk")) - 1).alias("k")), "simhash-numbers")
    tasks = min(work.count(), 10_000)
    if not tasks:
        return spark.createDataFrame([], "a binary, b binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)

        def load(name: str) -> np.ndarray:
            with store.open_input_stream(f"{root}/{name}") as f:
                return np.frombuffer(f.read(), ">u8").reshape(-1, BITS // 64).astype(np.uint64)

        def original(rows: np.ndarray, chunk: int) -> np.ndarray:
            return _turned(np.unpackbits(rows.astype(">u8").view(np.uint8).reshape(-1, BITS // 8), axis=1), (m - chunk) % m, width)

        for task in (t for batch in batches for t in batch.to_pylist()):
            k, same = task["chunk"], task["a"] == task["b"]
            left = load(task["a"])
            right = left if same else load(task["b"])
            shift, forest, new = 0 if same else len(left), _Forest(), 0
            label = np.arange(len(left) + (0 if same else len(right)))
            limit = sum(t + 1 for t in ring[k : k + 64 // width]) - 1
            for xs, ys in close_windows(np.ascontiguousarray(left[:, 0]), np.ascontiguousarray(right[:, 0]), same=same, width=width, head=head, share=shares[k], limit=limit):
                for i in range(0, len(xs), 1 << 14):
                    x, y = xs[i : i + (1 << 14)], ys[i : i + (1 << 14)]
                    apart = label[x] != label[y + shift]  # the others are joined already
                    x, y = x[apart], y[apart]
                    differ = left[x] ^ right[y]
                    close = np.bitwise_count(differ).sum(1, dtype=np.int64) <= radius
                    x, y, differ = x[close], y[close], differ[close]
                    own = _owner(original(differ, k), shares, width) == k
                    x, y = x[own], y[own]
                    joined = [j for j, (p, q) in enumerate(zip(x.tolist(), (y + shift).tolist())) if forest.join(p, q)]
                    if joined:
                        pair = [pa.array([s.tobytes() for s in np.packbits(original(rows, k), axis=1)], pa.binary()) for rows in (left[x[joined]], right[y[joined]])]
                        yield pa.RecordBatch.from_arrays(pair, ["a", "b"])
                        new += len(joined)
                    if new and len(apart) > 1000:
                        for node in list(forest.up):
                            label[node] = forest.root(node)
                        new = 0

    return work.repartitionById(tasks, (F.col("k") % tasks).cast("int")).mapInArrow(run, "a binary, b binary")


def close_signatures(distinct: DataFrame, *, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b) pairs of signatures that join all that are within the radius of each other into their groups.

    Where they are many, by chunks; else by tiles. The tiles are numbered and put into blocks of TASK_TILES; a task is a tile and a block, so
    that the driver has nothing to hold but how many there are.
    """
    from pyarrow import fs

    spark = distinct.sparkSession
    count = distinct.count()
    if width := chunk_width(count, radius):
        return _close_by_chunks(distinct, count, radius, width)
    folder = new_dir(spark, "simhash-sigs")
    order = distinct.withColumn("pop", F.expr(" + ".join(f"bit_count(cast(conv(hex(substring(sig, {k}, 7)), 16, 10) as bigint))" for k in range(1, BITS // 8 + 1, 7))))
    order = written(order, "simhash-distinct").repartitionByRange("pop", "sig").sortWithinPartitions("pop", "sig").select("sig")
    tiles = _tiles(order, folder, tile)
    # A row for each tile of thousands of signatures: one task numbers them.
    tiles = written(tiles.withColumn("i", F.row_number().over(Window.orderBy("low", "high", "name")) - 1).withColumn("block", F.floor(F.col("i") / TASK_TILES).cast("int")), "simhash-numbers")
    n = tiles.count()
    if not n:
        return spark.createDataFrame([], "a binary, b binary")
    blocks = -(-n // TASK_TILES)
    members = tiles.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("i", "name", "low", "high"))).alias("others"), F.min("low").alias("lowest"), F.max("high").alias("highest"))  # TASK_TILES each
    own = tiles.select("i", "name", "low", "high", F.explode(F.sequence(F.col("block"), F.lit(blocks - 1))).alias("block"))
    work = own.join(members, "block").where(F.greatest("low", "lowest") - F.least("high", "highest") <= radius)
    q = F.floor(F.col("i") / TASK_TILES)  # tasks are numbered one by one, so that each is a partition
    before = TASK_TILES * (q * blocks - F.floor(q * (q - 1) / 2)) + (F.col("i") - TASK_TILES * q) * (blocks - q)
    work = work.select((before + F.col("block") - q).cast("int").alias("k"), "i", "name", "low", "high", "others")
    last = (n - 1) // TASK_TILES
    tasks = TASK_TILES * (last * blocks - last * (last - 1) // 2) + (n - TASK_TILES * last) * (blocks - last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)

        def load(name: str) -> np.ndarray:
            with store.open_input_stream(f"{root}/{name}") as f:
                return np.frombuffer(f.read(), np.uint64).reshape(-1, BITS // 64)

        for batch in batches:
            for task in batch.to_pylist():
                own, forest, left, right, i = load(task["name"]), _Forest(), [], [], task["i"]
                for o in task["others"]:
                    j = o["i"]
                    if j < i or max(o["low"] - task["high"], task["low"] - o["high"]) > radius:
                        continue
                    other = own if i == j else load(o["name"])
                    for xs, ys in close_pairs(own, other, radius, same=i == j):
                        for x, y in zip(xs.tolist(), ys.tolist()):
                            if forest.join(i << 32 | x, j << 32 | y):
                                left.append(own[x].tobytes())
                                right.append(other[y].tobytes())
                if left:
                    yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    return work.repartitionById(tasks, "k").mapInArrow(run, "a binary, b binary")


def _signed(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The kept columns and sig, for rows that have one."""
    own = docs.select(*keep, F.col(text).alias("__text"))
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = pa.array(signatures(batch.column(at)), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], sigs], [*batch.schema.names[:at], "sig"])

    return small_batches(own).mapInArrow(run, T.StructType([*own.schema.fields[:at], T.StructField("sig", T.BinaryType())]))


def _groups(signed: DataFrame, radius: int, tile: int) -> DataFrame:
    """(sig, grp) of every signature that has company: another in the radius, or a second row."""
    distinct = written(signed.where("sig IS NOT NULL").groupBy("sig").agg(F.count("*").alias("rows")), "simhash-counts")
    pairs = written(close_signatures(distinct.select("sig"), radius=radius, tile=tile), "simhash-pairs")
    found = components(pairs)
    alone = distinct.where("rows > 1").join(found.select(F.col("node").alias("sig")), "sig", "left_anti")
    return found.select(F.col("node").alias("sig"), F.col("component").alias("grp")).unionByName(alone.select("sig", F.col("sig").alias("grp")))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(doc_id, group_id) of every row that has a near copy; group_id is the least doc_id of its group.

    Texts within the radius of each other are in one group, and so is whoever is in reach
    through others. Null and blank texts are in none; a text of any length is signed whole,
    in pieces. Rows that repeat are copies of each other. Ids may be null: group_id is null only where the whole group's are. Other
    columns don't matter. An empty table gives an empty result.
    """
    signed = written(_signed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", ["doc_id"]), "simhash")
    rows = written(signed.join(_groups(signed, radius, tile), "sig").select("doc_id", "grp"), "simhash-rows")
    least = rows.groupBy("grp").agg(F.min("doc_id").alias("group_id"))
    return rows.join(least, "grp").select("doc_id", "group_id")


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """docs with one row of each group, the one with the least doc_id; all columns stay.

    Of rows that repeat one stays; ids that are null come last. Null and blank texts stay;
    a text of any length is signed whole, in pieces. An empty table stays empty. Rows are
    told apart by their place in docs' files: the texts are neither copied nor shuffled, and
    those to go are looked up file by file.
    """
    docs, rows = placed(docs, "simhash-docs")
    signed = written(_signed(rows.select("__file", "__at", F.col(doc_id).alias("id"), F.col(text).alias("text")), "text", ["__file", "__at", "id"]), "simhash")
    grouped = written(signed.join(_groups(signed, radius, tile), "sig").select("__file", "__at", "id", "grp"), "simhash-rows")
    first = grouped.groupBy("grp").agg(F.min(F.struct(F.col("id").isNull(), "id", "__file", "__at")).alias("first")).select("first.__file", "first.__at")
    losers = write_marks(grouped.select("__file", "__at").join(first, ["__file", "__at"], "left_anti"), "simhash-losers")
    return rows.where(~marked(losers)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
