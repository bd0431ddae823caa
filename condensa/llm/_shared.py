"""What the operators need of the session, and marks that single out rows of a table without moving it."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import new_dir, placed, scratch, shared_dir, written  # noqa: F401 (the operators' names for them)

#: Rows and bytes of an Arrow batch. Batches of texts by the defaults take hundreds of MB in each worker.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches of at most BATCH_ROWS rows and BATCH_BYTES bytes.

    A plan takes these settings when it runs, so they stay with the session; smaller ones are kept.
    """
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(name).lower()
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(name, str(most))
    return df


def release() -> None:
    """Give what a task freed back to the system: workers stay for the next task, whatever this one needed."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every system's library has it
        pass


#: A mark file covers 2 ** SEGMENT rows of its source file, so that none grows beyond 32 MB.
SEGMENT = 22


def _mark_name(file: str, part: int) -> str:
    return f"{hashlib.sha256(file.encode()).hexdigest()[:40]}-{part}"


def write_marks(rows: DataFrame, name: str) -> str:
    """A folder with files of sorted row numbers for the source files of rows (__file, __at), to be read by marked.

    A row's mark needs eight bytes; the rows themselves, with their texts, aren't moved.
    """
    from pyarrow import fs

    folder = new_dir(rows.sparkSession, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        now, held = None, []

        def put() -> pa.RecordBatch:
            at = np.unique(np.concatenate(held))
            tmp = f"{root}/.{uuid.uuid4().hex}"
            store.create_dir(root, recursive=True)
            with store.open_output_stream(tmp) as f:
                f.write(at.tobytes())
            store.move(tmp, f"{root}/{_mark_name(*now)}")  # a task that runs again leaves the same file
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([len(at)], pa.int64())], ["file", "n"])

        for batch in batches:
            keys, at = list(zip(batch.column("__file").to_pylist(), batch.column("part").to_pylist())), batch.column("__at").to_numpy()
            cut = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cut, cut[1:]):  # a file's rows come one after another
                if a < b:
                    if keys[a] != now and held:
                        yield put()
                        held = []
                    now = keys[a]
                    held.append(at[a:b].copy())
        if held:
            yield put()

    parts = small_batches(rows).select("__file", F.shiftright("__at", SEGMENT).alias("part"), "__at").repartition("__file", "part").sortWithinPartitions("__file", "part")
    parts.mapInArrow(run, "file string, n long").write.parquet(f"{folder}/index")
    return folder


def marked(folder: str) -> Column:
    """Whether a row of a placed table is among those of write_marks. Only its two numbers go to Python."""
    seen: dict[tuple[str, int], np.ndarray] = {}

    def of(file: str, part: int) -> np.ndarray:
        from pyarrow import fs

        if (file, part) not in seen:
            store, root = fs.FileSystem.from_uri(folder)
            path = f"{root}/{_mark_name(file, part)}"
            there = store.get_file_info(path).type != fs.FileType.NotFound
            if len(seen) > 3:
                seen.clear()
            with store.open_input_stream(path) if there else pa.BufferReader(b"") as f:
                seen[file, part] = np.frombuffer(f.read(), np.int64)
        return seen[file, part]

    @F.pandas_udf("boolean")
    def run(file: pd.Series, at: pd.Series) -> pd.Series:
        out, numbers = np.zeros(len(at), bool), at.to_numpy()
        part = numbers >> SEGMENT
        for name in file.unique():
            for k in np.unique(part[(file == name).to_numpy()]):
                own = np.flatnonzero((file == name).to_numpy() & (part == k))
                marks = of(name, int(k))
                if len(marks):
                    place = np.searchsorted(marks, numbers[own])
                    out[own] = marks[np.minimum(place, len(marks) - 1)] == numbers[own]
        return pd.Series(out)

    return run(F.col("__file"), F.col("__at"))
