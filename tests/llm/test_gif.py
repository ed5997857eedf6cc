import random
import struct

import numpy as np
import pytest

from lodestream.llm import gif


def lzw_encode(samples: bytes, size: int) -> bytes:
    """A plain variable-width encoder, as other writers use."""
    clear, end = 1 << size, (1 << size) + 1
    out, bits, have = bytearray(), 0, 0
    width, table = size + 1, {}

    def put(code):
        nonlocal bits, have
        bits |= code << have
        have += width
        while have >= 8:
            out.append(bits & 255)
            bits >>= 8
            have -= 8

    def fresh():
        return {bytes([i]): i for i in range(clear)}

    put(clear)
    table, nxt, word = fresh(), end + 1, b""
    for s in samples:
        c = bytes([s])
        if word + c in table:
            word += c
            continue
        put(table[word])
        if nxt < 4096:
            table[word + c] = nxt
            if nxt == 1 << width and width < 12:
                width += 1
            nxt += 1
        else:
            put(clear)
            table, nxt, width = fresh(), end + 1, size + 1
        word = c
    if word:
        put(table[word])
        if nxt == 1 << width and width < 12:
            width += 1
    put(end)
    if have:
        out.append(bits & 255)
    return bytes(out)


@pytest.mark.parametrize("size,n,symbols", [(8, 1, 256), (8, 5000, 256), (8, 60000, 3), (2, 4000, 4), (4, 30000, 16), (8, 120000, 256)])
def test_lzw_streams_of_other_writers(size, n, symbols):
    data = bytes(random.Random(n).choices(range(symbols), k=n))
    assert gif.lzw(lzw_encode(data, size), size, n).tobytes() == data


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 253, 254, 255, 256, 1000, 65535 * 64 + 1])
def test_payload_round_trip(n):
    text = bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8))
    payload = gif.payload_of(text)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload[:n] == text and not any(payload[n:])
    assert len(payload) - n < 64 or n == 0
    got = list(gif.frames(gif.write(payload), compose=False))
    assert b"".join(f.indices.tobytes() for f in got) == payload
    assert sum(gif.histogram(f).sum() for f in got) == len(payload)


def frame(index, left=0, top=0, dispose=0, transparent=None, delay=5, interlace=False, palette=None):
    h, w = index.shape
    flags = dispose << 2 | (transparent is not None)
    data = index[gif._interlaced(h)] if interlace else index
    local = 0x80 | 1 if palette is not None else 0
    return (
        b"\x21\xf9\x04" + struct.pack("<BHBB", flags, delay, transparent or 0, 0) + b"\x2c" + struct.pack("<HHHHB", left, top, w, h, (0x40 if interlace else 0) | local)
        + (bytes(palette) if palette is not None else b"") + b"\x02" + gif._blocks(lzw_encode(data.astype(np.uint8).tobytes(), 2))
    )


def test_disposal_transparency_palettes_interlace():
    shared = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    local = [9, 9, 9, 8, 8, 8, 7, 7, 7, 6, 6, 6]
    rng = np.random.default_rng(1)
    one, two = rng.integers(1, 4, (9, 4)), rng.integers(0, 4, (3, 3))
    raw = b"GIF89a" + struct.pack("<HHBBB", 4, 9, 0x80 | 1, 0, 0) + shared
    raw += frame(one, interlace=True) + frame(two, 1, 2, dispose=2, transparent=0) + frame(two, 0, 0, dispose=3, palette=local) + frame(two[:1], 0, 8, delay=7) + b"\x3b"
    a, b, c, d = gif.frames(raw)
    pal = np.frombuffer(shared, np.uint8).reshape(-1, 3)
    assert (a.indices == one).all() and (a.canvas[..., :3] == pal[one]).all()
    seen = pal[one].copy()
    seen[2:5, 1:4][two != 0] = pal[two[two != 0]]
    assert (b.canvas[..., :3] == seen).all()
    after = a.canvas.copy()
    after = np.where(np.zeros_like(after, bool), after, b.canvas)
    after[2:5, 1:4] = 0  # disposal to background
    drawn = after.copy()
    drawn[0:3, 0:3, :3], drawn[0:3, 0:3, 3] = np.array(local, np.uint8).reshape(-1, 3)[two], 255
    assert (c.canvas == drawn).all()
    last = after.copy()  # the third frame is taken back
    last[8, 0:3, :3], last[8, 0:3, 3] = pal[two[0]], 255
    assert (d.canvas == last).all() and d.delay_ms == 70 and a.delay_ms == 50


def test_broken_files():
    good = gif.write(gif.payload_of(b"abc" * 100))
    for bad in (b"", b"PNG", good[:-20], good[: len(good) // 2]):
        with pytest.raises((ValueError, IndexError, struct.error)):
            list(gif.frames(bad, compose=False))


def test_described_counts_what_is_seen(spark):
    shared = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    raw = b"GIF89a" + struct.pack("<HHBBB", 4, 2, 0x80 | 1, 0, 0) + shared
    raw += frame(np.ones((2, 4), int)) + frame(np.array([[2, 0]]), 1, 0, dispose=2, transparent=0) + frame(np.array([[3]]), 0, 1, delay=7) + b"\x3b"
    got = gif.described(spark.createDataFrame([(1, bytearray(raw))], "doc_id long, media binary"), ["doc_id"]).first()
    red, green, blue = 48, 12, 3
    seen = [{i: n for i, n in enumerate(f["histogram"]) if n} for f in got["frames"]]
    assert seen == [{red: 8}, {red: 7, green: 1}, {red: 5, blue: 1}] and [f["delay_ms"] for f in got["frames"]] == [50, 50, 70]
