"""Media columns: motion-JPEG AVI files to timed clips.

A file's RIFF index (idx1, or the OpenDML ix chunks; the movie list itself where there is
none) gives its frames, each of which is a whole JPEG. Frames are decoded to grey, their
histograms compared with the frame's before, and a shot begins where the difference
stands out from those around it, so that lively and calm passages each have their own
threshold. The pass is narrow; of a decoded frame only 32 numbers are kept.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import spread
from ._shared import small_batches
from .mjpeg import decode_planes, encode_grey

BINS = 32
#: A cut's difference (0 to 1) is at least FLOOR and TIMES the median of REACH differences to both sides.
FLOOR, TIMES, REACH = 0.25, 3.0, 6
#: Histograms are compared by how many bins their mass moves (a light flicker is none); so many on average count as 1.
FULL_MOVE = 6.0
#: Bytes of files handled at a time.
SLICE_BYTES = 4_000_000

CLIP_SCHEMA = "clip long, first_frame long, n_frames long, start_ms double, end_ms double, width int, height int"


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(four-letter name, first byte, size) of the chunks in a range; a size beyond it is cut."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        yield name, at + 8, min(size, end - at - 8)
        at += 8 + size + (size & 1)


def parse_avi(data: bytes | None) -> tuple[list[bytes], float, int, int] | None:
    """(frames of the first motion-JPEG stream, seconds of a frame, width, height); None if there is no such stream.

    A frame of no bytes repeats the one before, as players have it.
    """
    if not data or len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        return None
    stream, number, seconds, width, height = None, -1, 0.0, 0, 0
    super_index: list[tuple[int, int]] = []
    movies: list[tuple[int, int]] = []
    index: tuple[int, int] | None = None
    for riff, at, size in _chunks(data, 0, len(data)):
        if riff != b"RIFF":
            continue
        for name, a, n in _chunks(data, at + 4, at + size):
            kind = data[a : a + 4] if name == b"LIST" else b""
            if kind == b"movi":
                movies.append((a, a + n))
            elif name == b"idx1":
                index = (a, n)
            elif kind == b"hdrl":
                for sub, b, m in _chunks(data, a + 4, a + n):
                    if sub == b"avih" and m >= 40:
                        micro = struct.unpack_from("<I", data, b)[0]
                        seconds = seconds or micro / 1e6
                        width, height = struct.unpack_from("<II", data, b + 32)
                    elif sub == b"LIST" and data[b : b + 4] == b"strl":
                        number += 1
                        own = {x: (c, k) for x, c, k in _chunks(data, b + 4, b + m)}
                        c, k = own.get(b"strh", (0, 0))
                        if stream is not None or k < 28 or data[c : c + 4] != b"vids":
                            continue
                        f, fk = own.get(b"strf", (0, 0))
                        compression = data[f + 16 : f + 20] if fk >= 20 else b""
                        if b"MJPG" not in (data[c + 4 : c + 8].upper(), compression.upper()):
                            continue
                        stream = number
                        scale, rate = struct.unpack_from("<II", data, c + 20)
                        seconds = scale / rate if scale and rate else seconds
                        if fk >= 12:
                            width, height = abs(struct.unpack_from("<i", data, f + 4)[0]), abs(struct.unpack_from("<i", data, f + 8)[0])
                        if b"indx" in own and own[b"indx"][1] >= 24:
                            c, k = own[b"indx"]
                            used = struct.unpack_from("<I", data, c + 4)[0]
                            if data[c + 3] == 0:
                                super_index = [struct.unpack_from("<QI", data, c + 24 + 16 * i) for i in range(min(used, (k - 24) // 16))]
    if stream is None or not movies:
        return None
    ours = (b"%02ddc" % stream, b"%02ddb" % stream)
    places: list[tuple[int, int]] = []
    for where, _ in super_index:
        if where + 32 <= len(data) and data[where : where + 2] == b"ix":
            used, base = struct.unpack_from("<I", data, where + 12)[0], struct.unpack_from("<Q", data, where + 20)[0]
            for i in range(min(used, (len(data) - where - 32) // 8)):
                off, n = struct.unpack_from("<II", data, where + 32 + 8 * i)
                places.append((base + off, n & 0x7FFFFFFF))
    if not places and index is not None:
        entries = [(off, n) for name, _, off, n in struct.iter_unpack("<4sIII", data[index[0] : index[0] + index[1] // 16 * 16]) if name in ours]
        # Offsets count from the word 'movi', or from the file's beginning.
        base = next((b for b in (movies[0][0], 0) if entries and data[b + entries[0][0] : b + entries[0][0] + 4] in ours), None)
        if base is not None:
            places = [(base + off + 8, n) for off, n in entries]
    if not places:
        def walk(a: int, b: int) -> None:
            for name, at, n in _chunks(data, a, b):
                if name in ours:
                    places.append((at, n))
                elif name == b"LIST":
                    walk(at + 4, at + n)

        for a, b in movies:
            walk(a + 4, b)
    frames = []
    for at, n in places:
        frame = data[at : at + n]
        frames.append(frame if frame or not frames else frames[-1])
    return frames, seconds or 1 / 25, width, height


def _decoded(frames: list[bytes]) -> np.ndarray:
    """Shares of BINS grey levels for each frame; -1 for one that can't be decoded."""
    out = np.full((len(frames), BINS), -1.0)
    for places, planes, good, head in decode_planes(frames):
        pixels = planes[0][:, : head.height, : head.width]
        n = len(places)
        key = (pixels >> 3).reshape(n, -1).astype(np.int64) + np.arange(n)[:, None] * BINS
        hist = np.bincount(key.ravel(), minlength=n * BINS).reshape(n, BINS) / (head.height * head.width)
        at = np.array(places)
        out[at[good]] = hist[good]
    return out


def _filled(out: np.ndarray, first: np.ndarray) -> np.ndarray:
    """first: the frames that begin a film."""
    at = np.arange(len(out))
    last = np.maximum.accumulate(np.where(out[:, 0] >= 0, at, -1))
    return np.where((last >= np.maximum.accumulate(np.where(np.isin(at, first), at, 0)))[:, None], out[last], 0.0)


def histograms(frames: list[bytes]) -> np.ndarray:
    """Shares of BINS grey levels for each frame; a frame that can't be decoded has its predecessor's, zeros if there is none."""
    return _filled(_decoded(frames), np.zeros(1, np.int64))


def _shots(hist: np.ndarray, first: np.ndarray, floor: float = FLOOR, times: float = TIMES, reach: int = REACH) -> np.ndarray:
    """Frames that begin a shot of films that come one after another; first: the frames that begin a film."""
    d = np.full(len(hist), np.inf)
    d[1:] = np.minimum(np.abs(np.diff(hist.cumsum(1), axis=0)).sum(1) / FULL_MOVE, 1)
    d[first] = np.inf
    # Films are laid apart, since what lies beyond their ends sorts last.
    place = np.arange(len(hist)) + reach * np.repeat(np.arange(1, len(first) + 1), np.diff(first, append=len(hist)))
    apart = np.full(len(hist) + reach * (len(first) + 1), np.inf)
    apart[place] = d
    own = np.flatnonzero(d < np.inf)
    around = apart[place[own][:, None] + [*range(-reach, 0), *range(1, reach + 1)]]
    around.sort(1)
    count, row = np.isfinite(around).sum(1), np.arange(len(own))
    middle = np.where(count > 0, (around[row, np.maximum(count - 1, 0) // 2] + around[row, count // 2]) / 2, 0)
    return np.sort(np.concatenate([first, own[d[own] >= np.maximum(floor, times * middle)]]))


def cuts(hist: np.ndarray, *, floor: float = FLOOR, times: float = TIMES, reach: int = REACH) -> np.ndarray:
    """Frames that begin a shot, the first among them."""
    return _shots(hist, np.zeros(min(1, len(hist)), np.int64), floor, times, reach)


def clips(media: DataFrame, *, key: str = "page_id", column: str = "media") -> DataFrame:
    """(key, clip, first_frame, n_frames, start_ms, end_ms, width, height): a row for each shot, clips counted from 0.

    Null, empty and foreign bytes, and files without a frame that can be decoded, give no
    rows. Damaged frames belong to the shot before, and so do progressive ones, which aren't
    motion JPEG. A difference that equals the threshold is a cut. A film is read whole, by one
    task, however long. Keys may repeat or be null, each row is a file of its own; other
    columns don't matter. A key named as a column of the result comes back as <key>_key. An
    empty table gives no rows.
    """
    fields = T._parse_datatype_string(CLIP_SCHEMA).fields
    name = f"{key}_key" if key in {f.name for f in fields} else key
    own = media.select(F.col(key).alias(name), F.col(column).cast("binary").alias("__media"))
    schema = T.StructType([own.schema[name], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, n = 0, len(batch)
            while lo < n:
                files, frames, size = [], [], 0
                while lo < n and size < SLICE_BYTES:
                    data = batch.column(1)[lo].as_py()
                    if (found := parse_avi(data)) and found[0]:
                        files.append((lo, len(frames), len(found[0]), *found[1:]))
                        frames += found[0]
                        size += len(data)
                    lo += 1
                hist, rows, at = _decoded(frames), [], []
                begin = np.array([f[1] for f in files], np.int64)
                starts = _shots(_filled(hist, begin), begin)
                shots = np.searchsorted(starts, np.append(begin, len(frames))).tolist()
                whole = np.append(0, np.cumsum(hist[:, 0] >= 0))
                starts = starts.tolist()
                for (row, first, count, seconds, width, height), lo_shot, hi_shot in zip(files, shots, shots[1:]):
                    if whole[first] == whole[first + count]:
                        continue
                    own = [a - first for a in starts[lo_shot:hi_shot]]
                    rows += [(c, a, b - a, round(a * seconds * 1000, 3), round(b * seconds * 1000, 3), width, height) for c, (a, b) in enumerate(zip(own, [*own[1:], count]))]
                    at += [row] * len(own)
                if rows:
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), _clip_types())]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *columns], schema.names)

    return small_batches(own).mapInArrow(run, schema)


def _clip_types() -> list[pa.Field]:
    return [pa.field("", t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int32())]


_LENGTH = struct.Struct("<I").pack


def make_avi(frames: list[bytes], *, width: int, height: int, scale: int = 1, rate: int = 10) -> bytes:
    """A motion-JPEG AVI with an idx1 index."""
    def chunk(name: bytes, body: bytes) -> bytes:
        return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)

    avih = struct.pack("<10I16x", 1_000_000 * scale // rate, 0, 0, 0x10, len(frames), 0, 1, 0, width, height)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, scale, rate, 0, len(frames), 0, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    strl = chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    parts = [b"00dc%b%b%b" % (_LENGTH(len(f)), f, b"\0" * (len(f) & 1)) for f in frames]
    index = np.zeros(len(frames), [("name", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")])
    index["name"], index["flags"], index["size"] = b"00dc", 0x10, [len(f) for f in frames]
    sizes = np.array([len(p) for p in parts], np.int64)
    index["at"] = 4 + np.cumsum(sizes) - sizes
    body = b"AVI " + chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + strl) + chunk(b"LIST", b"movi" + b"".join(parts)) + chunk(b"idx1", index.tobytes())
    return b"RIFF" + struct.pack("<I", len(body)) + body


_PARAGRAPH = re.compile(rb"<p\b")
SIDE, SHOT_FRAMES = 16, 3
_BLANK = bytes(SIDE**2)


def _levels(n: int) -> np.ndarray:
    """Levels of grey of a film's first n shots."""
    return (24 + (200 * (np.arange(n) * 0.6180339887 % 1)).astype(np.int64)).astype(np.uint8)


def _pictures(raw: bytes, rows: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Frames of shots, from their bytes filled up to whole pictures, how many each has, and their levels of grey."""
    texture = np.zeros((len(rows), SIDE**2), np.uint8)
    some = np.flatnonzero(rows)
    if len(some):
        own = np.frombuffer(raw, np.uint8).reshape(-1, SIDE**2)
        first = np.cumsum(rows) - rows
        texture[some] = np.add.reduceat(own, first[some], axis=0, dtype=np.uint64) % 17
    texture += levels[:, None]
    return (texture[:, None] + np.arange(SHOT_FRAMES, dtype=np.uint8)[:, None]).reshape(-1, SIDE, SIDE)


def render_pages(pages: DataFrame, *, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, media): each page as a film, since the tables hold no media. The whole text of html is shown.

    What stands before the first <p and then each paragraph is a shot of three frames of 16 x 16
    pixels: the sum of its bytes over the places of the picture as texture, on a level of
    grey that is far from the shot's before. A null page is null.
    """
    own = pages.select(F.col(page_id).alias("page_id"), F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 100):
                part, pieces, rows, levels, counts = batch.slice(lo, 100), [], [], [], []
                for text in part.column("html"):
                    raw = b"" if (t := text.as_py()) is None else t.encode()
                    at = [0, *(m.start() for m in _PARAGRAPH.finditer(raw) if m.start()), len(raw)]
                    for a, b in zip(at, at[1:]):
                        pieces += (raw[a:b], _BLANK[: (a - b) % SIDE**2])
                        rows.append(-(-(b - a) // SIDE**2))
                    levels.append(_levels(len(at) - 1))
                    counts.append((len(at) - 1) * SHOT_FRAMES if text.is_valid else None)
                jpegs = encode_grey(_pictures(b"".join(pieces), np.array(rows), np.concatenate(levels)))
                films, at = [], 0
                for n in counts:
                    films.append(None if n is None else make_avi(jpegs[at : at + n], width=SIDE, height=SIDE))
                    at += n if n is not None else SHOT_FRAMES
                yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(films, pa.binary())], ["page_id", "media"])

    return small_batches(own).mapInArrow(run, T.StructType([own.schema["page_id"], T.StructField("media", T.BinaryType())]))


def op9_media(spark, sf_dir: str) -> DataFrame:
    return clips(render_pages(spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))))
