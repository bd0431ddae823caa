"""Draws of many positions at a time, the same numbers as significance.draw gives, and values in files that tasks look them up in."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import new_dir

_SINES = [int(abs(math.sin(k + 1)) * 2**32) for k in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_PLACES = [*range(16), *((5 * k + 1) % 16 for k in range(16)), *((3 * k + 5) % 16 for k in range(16)), *(7 * k % 16 for k in range(16))]
_BEGIN = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)

#: Positions whose digests are reckoned together, so that the arrays stay in a core's cache.
BLOCK = 16_384
#: Rows in a file of values.
SEGMENT = 1 << 18
#: Cells of the counts that a task holds at a time: of several resamples, or of one over so many rows and then the next.
COUNTS = 1 << 24


class Positions:
    """Some positions as the ends of messages."""

    def __init__(self, pos: np.ndarray) -> None:
        self.pos = pos
        digits = max(len(str(int(pos.max()))), len(str(int(pos.min()))))
        self.signs = pos.astype(f"S{digits}").view(np.uint8).reshape(len(pos), digits)
        self.size = (self.signs != 0).sum(1)
        self.by_offset: dict[int, list[np.ndarray]] = {}

    def words(self, offset: int) -> list[np.ndarray]:
        """The digits and the bit that ends a message as words of four bytes, from the offset in the first on."""
        if offset not in self.by_offset:
            n, digits = self.signs.shape
            cells = np.zeros((n, (offset + digits + 4) // 4 * 4), np.uint8)
            cells[:, offset : offset + digits] = self.signs
            cells[np.arange(n), offset + self.size] = 0x80
            self.by_offset[offset] = list(np.ascontiguousarray(cells.view("<u4").T))
        return self.by_offset[offset]

    def numbers(self, prefix: str) -> np.ndarray:
        """The first four bytes of md5(prefix + position) as numbers.

        The sums of all messages go step by step together. The last three of the 64 steps don't touch these bytes.
        """
        raw = prefix.encode()
        if len(raw) + self.signs.shape[1] > 55:  # more than one block
            return np.array([int(hashlib.md5(raw + str(p).encode()).hexdigest()[:8], 16) for p in self.pos.tolist()], np.uint32)
        whole, offset = divmod(len(raw), 4)
        message: dict[int, int | np.ndarray] = {k: int.from_bytes(raw[4 * k : 4 * k + 4], "little") for k in range(whole)}
        own = self.words(offset)
        message[whole] = own[0] | np.uint32(int.from_bytes(raw[4 * whole :], "little"))
        message |= {whole + k: w for k, w in enumerate(own[1:], 1)}
        alike = self.size[0] == self.size[-1] == self.signs.shape[1]
        message[14] = 8 * (len(raw) + int(self.size[0])) if alike and (self.size == self.size[0]).all() else (8 * (len(raw) + self.size)).astype(np.uint32)
        a, b, c, d = (np.full(len(self.pos), x, np.uint32) for x in _BEGIN)
        f, g = np.empty_like(a), np.empty_like(a)
        for k in range(61):
            if k < 16:
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
            elif k < 32:
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
            elif k < 48:
                np.bitwise_xor(b, c, out=f)
                f ^= d
            else:
                np.invert(d, out=f)
                f |= b
                f ^= c
            f += a
            m = message.get(_PLACES[k], 0)
            if isinstance(m, np.ndarray):
                f += m
                m = 0
            f += np.uint32((_SINES[k] + m) & 0xFFFFFFFF)
            np.left_shift(f, np.uint32(_TURNS[k]), out=g)
            f >>= np.uint32(32 - _TURNS[k])
            f |= g
            f += b
            a, b, c, d, f = d, f, b, c, a
        return (b + np.uint32(_BEGIN[0])).astype("<u4").view(">u4").astype(np.uint32)

    def below(self, prefix: str, n: int) -> np.ndarray:
        """Of the numbers what is left by n."""
        x = self.numbers(prefix)
        return x if n >> 32 else x - x // np.uint32(n) * np.uint32(n)


def _name(key: str, part: int) -> str:
    return f"{hashlib.sha256(key.encode()).hexdigest()[:40]}-{part}"


def stored(rows: DataFrame, columns: list[str]) -> tuple[str, DataFrame]:
    """(a folder, (key, n)): for each key and SEGMENT positions a file of a matrix of doubles, a column's values and after them where there are any.

    rows: (key, pos, *columns). Each task that resamples reads the files: values are moved once.
    """
    from pyarrow import fs

    folder = new_dir(rows.sparkSession, "values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        now, held = None, []

        def put() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            at = table.column("pos").to_numpy() - now[1] * SEGMENT
            cells = np.zeros((at.max() + 1, 2 * len(columns)))
            for k, c in enumerate(columns):
                cells[at, k] = table.column(c).fill_null(0).to_numpy()
                cells[at, len(columns) + k] = table.column(c).is_valid().to_numpy(zero_copy_only=False)
            tmp = f"{root}/.{uuid.uuid4().hex}"
            store.create_dir(root, recursive=True)
            with store.open_output_stream(tmp) as f:
                f.write(cells.tobytes())
            store.move(tmp, f"{root}/{_name(*now)}")  # a task that runs again leaves the same file
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([len(at)], pa.int64())], ["key", "n"])

        for batch in batches:
            key, part = batch.column("key").to_pylist(), batch.column("part").to_numpy()
            cut = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1] or part[i] != part[i - 1]), len(key)]
            for a, b in zip(cut, cut[1:]):
                if a < b:
                    if held and (key[a], int(part[a])) != now:
                        yield put()
                        held = []
                    now = (key[a], int(part[a]))
                    held.append(batch.slice(a, b - a))
        if held:
            yield put()

    parts = rows.select(F.col("key").cast("string").alias("key"), F.col("pos").cast("long").alias("pos"), (F.col("pos") / SEGMENT).cast("long").alias("part"), *[F.col(c).cast("double").alias(c) for c in columns])
    parts = parts.repartition("key", "part").sortWithinPartitions("key", "part")
    index = f"{folder}/index"
    parts.mapInArrow(run, "key string, n long").write.parquet(index)
    return folder, rows.sparkSession.read.schema("key string, n long").parquet(index).groupBy("key").agg(F.sum("n").alias("n"))


def _chunks(rows: DataFrame, n_resamples: int) -> DataFrame:
    """(r, upto): shares of the resamples, one a task."""
    spark = rows.sparkSession
    tasks = 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    step = math.ceil(n_resamples / min(n_resamples, tasks))
    return spark.range(0, n_resamples, step, math.ceil(n_resamples / step)).select(F.col("id").alias("r"), F.least(F.col("id") + step, F.lit(n_resamples)).alias("upto"))


def means(rows: DataFrame, columns: list[str], *, n_resamples: int, seed: int) -> DataFrame:
    """(key, resample, *columns): means over as many draws from a key's positions as there are. rows: (key, pos, *columns), pos from 0 within each key.

    A resample is how often each row is drawn, times its values. A task has a share of the resamples and no rows but those of
    a file; work is the rows times the resamples, in digests, and only means leave the task.
    """
    from pyarrow import fs

    folder, sizes = stored(rows.where("key IS NOT NULL"), columns)

    def summed(key: str, n: int, a: int, b: int) -> np.ndarray:
        """Of the resamples from a to b: the values' sums and how many values there are, in rows of at most COUNTS."""
        store, root = fs.FileSystem.from_uri(folder)
        sums, parts, one = np.zeros((b - a, 2 * len(columns))), math.ceil(n / SEGMENT), np.int32(1)  # of the counts' type, else it is added 25 times as slowly
        for lo in range(0, parts, max(1, COUNTS // SEGMENT)):
            first, last = lo * SEGMENT, min(n, (lo + max(1, COUNTS // SEGMENT)) * SEGMENT)
            counts = np.zeros((b - a, last - first), np.int32)
            for p in range(0, n, BLOCK):
                block = Positions(np.arange(p, min(n, p + BLOCK)))
                for r in range(a, b):
                    at = block.below(f"{seed}:{r}:", n)
                    np.add.at(counts[r - a], at if last - first == n else at[(at >= first) & (at < last)] - first, one)
            for part in range(lo, math.ceil(last / SEGMENT)):
                with store.open_input_stream(f"{root}/{_name(key, part)}") as f:
                    cells = np.frombuffer(f.read()).reshape(-1, 2 * len(columns))
                at = part * SEGMENT - first
                for k in range(b - a):
                    drawn = counts[k, at : at + len(cells)].astype(np.float64)
                    there = drawn > 0 if not np.isfinite(cells).all() else slice(None)
                    sums[k] += drawn[there] @ cells[there]
        return sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                step = max(1, COUNTS // x["n"])
                for a in range(x["r"], x["upto"], step):
                    b = min(a + step, x["upto"])
                    total, there = np.hsplit(summed(x["key"], x["n"], a, b), 2)
                    with np.errstate(invalid="ignore"):
                        of = [pa.array(t / m, mask=m == 0) for t, m in zip(total.T, there.T)]
                    yield pa.RecordBatch.from_arrays([pa.array([x["key"]] * (b - a)), pa.array(range(a, b), pa.int64()), *of], ["key", "resample", *columns])

    shares = _chunks(rows, n_resamples).crossJoin(F.broadcast(sizes))
    return shares.mapInArrow(run, ", ".join(["key string, resample long", *(f"`{c}` double" for c in columns)]))


def swaps(rows: DataFrame, *, n_resamples: int, seed: int) -> DataFrame:
    """(resample, n, a, b): the rows' number and the sums of a and b, which are 0 or 1, where the coin of a position says whether they are swapped. rows: (pos, a, b).

    Where a and b are the same both sums have it whatever the coin says, so the other positions' coins alone are tossed.
    """
    from pyarrow import fs

    folder, sizes = stored(rows.select(F.lit("").alias("key"), "pos", "a", "b"), ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for x in batch.to_pylist():
                first, both, differ = np.zeros(x["upto"] - x["r"], np.int64), 0, 0
                for part in range(math.ceil(x["n"] / SEGMENT)):
                    with store.open_input_stream(f"{root}/{_name('', part)}") as f:
                        cells = np.frombuffer(f.read()).reshape(-1, 4)
                    a, b = cells[:, 0] == 1, cells[:, 1] == 1
                    both += int((a & b).sum())
                    at = np.flatnonzero(a != b)
                    differ += len(at)
                    for p in range(0, len(at), BLOCK):
                        block, own = Positions(at[p : p + BLOCK] + part * SEGMENT), a[at[p : p + BLOCK]]
                        for k in range(len(first)):
                            first[k] += np.count_nonzero(own ^ (block.numbers(f"{seed}:{x['r'] + k}:") & np.uint32(1)).astype(bool))
                n = np.full(len(first), x["n"])
                yield pa.RecordBatch.from_arrays([pa.array(range(x["r"], x["upto"]), pa.int64()), *map(pa.array, (n, first + both, differ - first + both))], ["resample", "n", "a", "b"])

    shares = _chunks(rows, n_resamples).crossJoin(F.broadcast(sizes))
    return shares.mapInArrow(run, "resample long, n long, a long, b long")
