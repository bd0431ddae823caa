import struct
import tracemalloc

import numpy as np
import pytest

from condensa.llm.media import _shots, clips, cuts, histograms, make_avi, parse_avi, render_pages
from condensa.llm.mjpeg import STANDARD, ZIGZAG, decode_jpeg, encode_grey, parse_header, split_frame


def pictures(n=5, h=24, w=32, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 256, (n, h // 8, w // 8)).repeat(8, 1).repeat(8, 2) * 0.7 + rng.integers(0, 70, (n, h, w))).astype(np.uint8)


def slow_decode(jpeg):
    """A grey frame bit by bit, from the standard."""
    raw, scan = split_frame(jpeg)
    head = parse_header(raw)
    quant, dc, ac = head.parts[0][2:5]

    def tree(table):
        out, code, at = {}, 0, 0
        for n, count in enumerate(table[0], 1):
            for _ in range(count):
                out[n, code] = table[1][at]
                code, at = code + 1, at + 1
            code <<= 1
        return out

    bits = "".join(f"{b:08b}" for b in scan[:-2].replace(b"\xff\x00", b"\xff"))
    at, last = 0, 0
    out = np.zeros((head.height, head.width))

    def symbol(t):
        nonlocal at
        n, code = 0, 0
        while True:
            code, n, at = code << 1 | int(bits[at]), n + 1, at + 1
            if (n, code) in t:
                return t[n, code]

    def value(size):
        nonlocal at
        v = int(bits[at : at + size] or "0", 2)
        at += size
        return v if not size or v >> (size - 1) else v - (1 << size) + 1

    cos = lambda x, u: np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5)
    base = np.array([[cos(x, u) for u in range(8)] for x in range(8)])
    td, ta = tree(dc), tree(ac)
    for y in range(0, head.height, 8):
        for x in range(0, head.width, 8):
            z = np.zeros(64)
            last += value(symbol(td))
            z[0], k = last, 1
            while k < 64:
                s = symbol(ta)
                if s == 0:
                    break
                k += s >> 4
                if s & 15:
                    z[k] = value(s & 15)
                k += 1
            block = np.zeros(64)
            block[ZIGZAG] = z * np.array(quant)
            out[y : y + 8, x : x + 8] = base @ block.reshape(8, 8) @ base.T + 128
    return np.clip(np.rint(out), 0, 255)


@pytest.mark.parametrize("quantiser", [1, 6, 40])
@pytest.mark.parametrize("tables", [False, True])
def test_decoder_against_the_slow_one(quantiser, tables):
    frames = pictures()
    for jpeg, frame in zip(encode_grey(frames, quantiser=quantiser, tables=tables), frames):
        got = decode_jpeg(jpeg).astype(int)
        assert np.abs(got - slow_decode(jpeg)).max() <= 1
        assert np.abs(got - frame).mean() <= quantiser / 2


def colour_jpeg(restart):
    """16 x 16, 4:2:0, each component of one level, by hand: (dc difference, then end of block) for Y Y Y Y Cb Cr."""
    def code(table, symbol):
        c, at = 0, 0
        for n, count in enumerate(table[0], 1):
            for _ in range(count):
                if table[1][at] == symbol:
                    return f"{c:0{n}b}"
                c, at = c + 1, at + 1
            c <<= 1

    def dc(table, v):
        size = abs(v).bit_length()
        return code(table, size) + (f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if size else "")

    def unit(y, cb, cr):
        out = "".join(dc(STANDARD[0, 0], v) + code(STANDARD[1, 0], 0) for v in y)
        return out + "".join(dc(STANDARD[0, 1], v) + code(STANDARD[1, 1], 0) for v in (cb, cr))

    units = [unit((20, 0, 0, 0), 10, -10), unit((20, 0, 0, 0) if restart else (0, 0, 0, 0), 10 if restart else 0, -10 if restart else 0)]
    pack = lambda s: int(s + "1" * (-len(s) % 8), 2).to_bytes(-(-len(s) // 8), "big").replace(b"\xff", b"\xff\x00")
    scan = pack(units[0]) + b"\xff\xd0" + pack(units[1]) if restart else pack("".join(units))
    head = b"\xff\xd8\xff\xdb\x00\x43\x00" + bytes([16]) * 64
    if restart:
        head += b"\xff\xdd\x00\x04\x00\x01"
    head += b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, 16, 32, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    return head + b"\xff\xda\x00\x0c\x03\x01\x00\x02\x11\x03\x11\x00\x3f\x00" + scan + b"\xff\xd9"


@pytest.mark.parametrize("restart", [False, True])
def test_colour_and_restarts(restart):
    out = decode_jpeg(colour_jpeg(restart)).astype(int)
    y, cb, cr = 128 + 20 * 16 / 8, 10 * 16 / 8, -10 * 16 / 8
    want = [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]
    assert out.shape == (16, 32, 3) and np.abs(out - want).max() <= 1


@pytest.mark.parametrize("bad", [b"", b"\xff\xd8", b"no jpeg", encode_grey(pictures(1))[0][:90], encode_grey(pictures(1))[0][:150]])
def test_broken_frames_are_none(bad):
    assert decode_jpeg(bad) is None


def test_work_of_an_encoder_is_by_coefficients():
    """Codes are put together in words: what a frame of 16 x 16 needs doesn't grow to arrays with an element for each bit (33 KB a frame)."""
    frames = (np.random.default_rng(5).integers(0, 17, (2000, 16, 16)) + 100).astype(np.uint8)
    encode_grey(frames[:1])  # tables are kept
    tracemalloc.start()
    try:
        encode_grey(frames)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak / len(frames) < 20_000


def test_long_runs_of_zeros():
    z = np.zeros((63, 64))
    z[np.arange(63), np.arange(1, 64)] = 40
    blocks = np.zeros((63, 64))
    blocks[:, ZIGZAG] = z
    cos = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for u in range(8)] for x in range(8)])
    frames = np.rint(cos @ blocks.reshape(-1, 8, 8) @ cos.T + 128).astype(np.uint8)
    for jpeg in encode_grey(frames):
        assert np.abs(decode_jpeg(jpeg).astype(int) - slow_decode(jpeg)).max() <= 1


def test_a_frame_broken_at_its_end_is_told_itself():
    """Not the one that is decoded after it."""
    jpegs = encode_grey(pictures(6))
    hurt = [*jpegs[:2], jpegs[2][:-12] + b"\xff\xd9", *jpegs[3:]]
    assert decode_jpeg(hurt[2]) is None
    want = histograms(jpegs)
    want[2] = want[1]
    assert (histograms(hurt) == want).all()


def test_parse(tmp_path):
    jpegs = encode_grey(pictures())
    data = make_avi(jpegs, width=32, height=24, scale=1, rate=25)
    frames, seconds, width, height = parse_avi(data)
    assert frames == jpegs and (seconds, width, height) == (0.04, 32, 24)
    assert parse_avi(data[: data.index(b"idx1")])[0] == jpegs  # no index: the movie list
    k = data.index(b"idx1") + 8
    absolute = bytearray(data)
    movi = data.index(b"movi")
    for i in range(len(jpegs)):
        off = struct.unpack_from("<I", data, k + 16 * i + 8)[0]
        struct.pack_into("<I", absolute, k + 16 * i + 8, off + movi)
    assert parse_avi(bytes(absolute))[0] == jpegs


@pytest.mark.parametrize("bad", [None, b"", b"RIFF", b"RIFF\x04\x00\x00\x00WAVE", b"RIFF\xff\xff\xff\xffAVI LIST", bytes(100)])
def test_foreign_bytes(bad):
    assert parse_avi(bad) is None


def test_cuts_stand_out():
    rng = np.random.default_rng(1)
    levels = [40, 200, 90, 220]
    frames = np.concatenate([np.clip(lv + rng.integers(-12, 12, (7, 16, 16)), 0, 255) for lv in levels]).astype(np.uint8)
    assert cuts(histograms(encode_grey(frames))).tolist() == [0, 7, 14, 21]
    assert cuts(histograms(encode_grey(frames[:7]))).tolist() == [0] and cuts(np.zeros((0, 32))).tolist() == []


def test_films_side_by_side_are_cut_like_each_alone():
    rng = np.random.default_rng(2)
    films = [rng.dirichlet(np.full(32, 0.2), n)[np.sort(rng.integers(0, n, n))] for n in (1, 2, 3, 9, 40, 1)]
    first = np.cumsum([0, *map(len, films[:-1])])
    assert _shots(np.concatenate(films), first).tolist() == [a + x for a, f in zip(first, films) for x in cuts(f)]


def test_clips_of_rows(spark):
    frames = np.concatenate([np.full((4, 16, 16), v) for v in (30, 200, 90)]).astype(np.uint8)
    jpegs = encode_grey(frames)
    film = make_avi(jpegs, width=16, height=16)
    hurt = make_avi([*jpegs[:5], b"broken", *jpegs[6:]], width=16, height=16)
    rows = [(1, film, 0), (1, film, 0), (None, film, 0), (2, None, 0), (3, b"", 0), (4, b"other", 0), (5, hurt, 0), (6, make_avi([], width=8, height=8), 0), (7, make_avi([b"x"], width=8, height=8), 0)]
    out = clips(spark.createDataFrame(rows, "page_id long, media binary, clip int")).collect()
    one = [(0, 0, 4, 0.0, 400.0), (1, 4, 4, 400.0, 800.0), (2, 8, 4, 800.0, 1200.0)]
    assert sorted(((r.page_id or 0), r.clip, r.first_frame, r.n_frames, r.start_ms, r.end_ms) for r in out) == sorted((p, *x) for p in (0, 1, 1, 5) for x in one)


def test_pages_have_a_shot_for_each_paragraph(spark):
    pages = [(1, "<h1>x</h1>" + "".join(f"<p>text {i}</p>" for i in range(9))), (2, "no paragraph"), (3, ""), (4, None)]
    out = clips(render_pages(spark.createDataFrame(pages, "page_id long, html string"))).groupBy("page_id").count().collect()
    assert {(r.page_id, r["count"]) for r in out} == {(1, 10), (2, 1), (3, 1)}


def test_progressive_frames_count_as_damaged(spark):
    jpegs = encode_grey(np.concatenate([np.full((4, 16, 16), v) for v in (30, 200)]).astype(np.uint8))
    progressive = [j.replace(b"\xff\xc0", b"\xff\xc2") for j in jpegs]
    rows = [(1, make_avi([*jpegs[:6], *progressive[6:]], width=16, height=16)), (2, make_avi(progressive, width=16, height=16))]
    out = clips(spark.createDataFrame(rows, "page_id long, media binary")).collect()
    assert sorted((r.page_id, r.first_frame, r.n_frames) for r in out) == [(1, 0, 4), (1, 4, 4)]


def test_a_long_film(spark):
    levels = np.repeat(np.tile([30, 200, 90, 220], 300), 5)
    film = make_avi(encode_grey(np.broadcast_to(levels[:, None, None], (6000, 16, 16)).astype(np.uint8)), width=16, height=16, rate=25)
    out = clips(spark.createDataFrame([(1, film)], "page_id long, media binary")).orderBy("clip").collect()
    assert [(r.first_frame, r.n_frames, r.start_ms) for r in out] == [(5 * k, 5, 200.0 * k) for k in range(1200)]


@pytest.mark.parametrize("key", ["clip", "width", "start_ms"])
def test_keys_named_as_the_result_s_columns(spark, key):
    film = make_avi(encode_grey(np.full((2, 16, 16), 9, np.uint8)), width=16, height=16)
    out = clips(spark.createDataFrame([("a", film)], f"{key} string, media binary"), key=key)
    assert out.columns[0] == f"{key}_key" and [r[0] for r in out.collect()] == ["a"] and len(set(out.columns)) == 8


def test_empty(spark):
    assert clips(spark.createDataFrame([], "page_id long, media binary")).collect() == []
