"""Media columns: GIF files written, decoded and described.

``store`` keeps a payload of bytes without loss as the samples of a GIF animation: 64 samples a row, one
byte each, with the grey palette, frames of at most ``FRAME_ROWS`` rows that are cleared away before the next.
Its LZW stream has growing codes and a clear code wherever the table of 4,096 is full.

``frames`` decodes any GIF: the LZW code stream (of other writers too: full tables, early or missing clear
codes, interlacing), palettes (global or local), transparency and disposal, into timed
frames on the canvas, with a colour histogram each. Between two clear codes a code's width depends on its number
alone, so the codes of a stretch are read together; a code's bytes then are a copy of bytes before it.

Both run in Spark tasks, row by row, and nothing is shuffled.

Defined results: a null text is an empty payload of 64 zero bytes; equal texts give equal files; a
file that is cut short or is no GIF gives no frames and an error text, and so does one whose canvas has more
than ``MAX_PIXELS``; repeated rows are treated alike; an empty table gives an empty table; kept columns pass
through unchanged.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textvec as tv

WIDTH, FRAME_ROWS, MAX_PIXELS = 64, 1024, 1 << 26
BINS = 4  # for each of red, green, blue
FULL, MAX_BITS = 4096, 12  # entries of a full table, bits of the longest codes


# --- code streams ---


@functools.cache
def _widths(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each code after a clear code, and the bits before it. The second code and each later one add an entry."""
    k = np.arange(FULL)
    entries = (1 << size) + 2 + np.maximum(k - 1, 0)
    bits = np.minimum(np.maximum(np.floor(np.log2(entries)).astype(np.int64) + 1, size + 1), MAX_BITS)
    return bits, np.cumsum(bits) - bits


def _packed(codes: np.ndarray, bits: np.ndarray) -> bytes:
    """Codes of these many bits each, the lowest bit first."""
    at = np.cumsum(bits) - bits
    n = int(at[-1] + bits[-1])
    out = np.zeros(-(-n // 8) + 4, np.uint8)
    value = codes.astype(np.uint32) << (at & 7).astype(np.uint32)  # at most 19 bits: three bytes
    first = at >> 3
    for k in range(3):
        # bits of neighbouring codes do not overlap, so that adding them up is joining them
        out += np.bincount(first + k, weights=(value >> np.uint32(8 * k)) & np.uint32(255), minlength=len(out)).astype(np.uint8)
    return out[: -(-n // 8)].tobytes()


def lzw_encode(samples: bytes) -> bytes:
    """A code stream of 8 bits a sample."""
    clear = 256
    widths, _ = _widths(8)
    # codes stand 8 bits higher here, so that a key is a code and a sample; begins: where the stretches after clear codes begin
    codes, begins = [clear << 8], [0]
    table: dict[int, int] = {}
    put, add, made = codes.append, table.setdefault, (clear + 2) << 8
    now = samples[0] << 8
    for b in samples[1:]:
        code = add(now | b, made)
        if code != made:
            now = code
            continue
        put(now)
        now = b << 8
        if made < FULL << 8:
            made += 256
        else:
            begins.append(len(codes))
            put(clear << 8)
            table.clear()
            made = (clear + 2) << 8
    put(now)
    put((clear + 1) << 8)
    # a clear code counts as the last one of the stretch before it
    k = np.arange(len(codes)) - np.repeat(begins, np.diff([*begins, len(codes)])) - 1
    again = np.array(begins[1:], np.int64)
    k[again] = k[again - 1] + 1
    k[0] = 0
    return _packed(np.array(codes, np.uint32) >> np.uint32(8), widths[k])


def _stretch(codes: np.ndarray, size: int) -> np.ndarray:
    """Samples of the codes between two clear codes, all at once.

    The entry that code i adds is its bytes and the byte after them, so a code stands for a copy of earlier
    output, and where that copy comes from is followed back to single samples in a few doublings.
    """
    n, base = len(codes), (1 << size) + 2
    entry = codes.astype(np.int64) - base
    i = np.arange(n)
    copy = entry >= 0
    if (entry >= i).any():
        raise ValueError("code beyond the table")
    # bytes of each code: steps to a code that is a sample, and one
    back, length = np.where(copy, entry, i), np.where(copy, 1, 0)
    while (length[back] > 0).any():
        length, back = length + length[back], back[back]
    length += 1
    begin = np.cumsum(length) - length
    source = np.arange(int(begin[-1] + length[-1]))
    k = np.flatnonzero(copy)
    own = tv.gather(source, begin[k], length[k])
    source[own] -= np.repeat(begin[k] - begin[entry[k]], length[k])
    literal = np.zeros(len(source), np.uint8)
    literal[begin[~copy]] = codes[~copy]
    while True:
        further = source[source]
        if (further == source).all():
            return literal[source]
        source = further


def lzw(data: bytes, size: int, most: int) -> np.ndarray:
    """Decode a code stream with ``size`` bits a sample; about ``most`` samples are wanted."""
    clear, end = 1 << size, (1 << size) + 1
    widths, before = _widths(size)
    pad = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    bits, at, parts, total = 8 * len(data), 0, [], 0
    while total < most:
        # codes up to the next clear code; after a full table all have the greatest width
        codes, n, found = [], 0, np.zeros(0, np.int64)
        while not len(found):
            k = np.arange(n, n + FULL)
            w = widths[np.minimum(k, FULL - 1)]
            offset = at + before[np.minimum(k, FULL - 1)] + MAX_BITS * np.maximum(k - FULL + 1, 0)
            held = int(np.searchsorted(offset + w, bits, side="right"))
            first, shift = offset[:held] >> 3, (offset[:held] & 7).astype(np.uint32)
            got = (pad[first] | pad[first + 1] << np.uint32(8) | pad[first + 2] << np.uint32(16)) >> shift & ((1 << w[:held]) - 1).astype(np.uint32)
            found = np.flatnonzero((got == clear) | (got == end))[:1]
            codes.append(got[: found[0]] if len(found) else got)
            if held < FULL:
                break
            n += FULL
        if codes := [c for c in codes if len(c)]:
            parts.append(_stretch(np.concatenate(codes), size))
            total += len(parts[-1])
        if not len(found) or got[found[0]] == end:
            break
        at = int(offset[found[0]] + w[found[0]])
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8)


# --- writing ---


def _blocks(data: bytes) -> bytes:
    """In sub-blocks of at most 255 bytes, with the empty one at the end."""
    n = len(data)
    whole = n // 255
    a = np.empty((whole, 256), np.uint8)
    a[:, 0] = 255
    a[:, 1:] = np.frombuffer(data, np.uint8, whole * 255).reshape(-1, 255)
    rest = data[whole * 255 :]
    return a.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def payload_of(text: bytes) -> bytes:
    return text + bytes(-len(text) % WIDTH if text else WIDTH)


def write(payload: bytes) -> bytes:
    rows = len(payload) // WIDTH
    parts = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, FRAME_ROWS), 0xF7, 0, 0), np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()]
    for a in range(0, rows, FRAME_ROWS):
        z = min(rows, a + FRAME_ROWS)
        # 100 ms, then back to the background
        parts += [b"\x21\xf9\x04", struct.pack("<BHBB", 2 << 2, 10, 0, 0), b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, z - a, 0), b"\x08", _blocks(lzw_encode(payload[a * WIDTH : z * WIDTH]))]
    return b"".join(parts) + b"\x3b"


# --- reading ---


class Frame(NamedTuple):
    delay_ms: int
    left: int
    top: int
    indices: np.ndarray  # rows x columns of palette indices, as stored
    palette: np.ndarray  # entries x 3
    transparent: int  # -1 if none
    canvas: np.ndarray  # rows x columns x 4 after this frame


def _sub_blocks(raw: bytes, at: int) -> tuple[bytes, int]:
    start, n = at, len(raw)
    # many full blocks in a row are taken at once
    k = 0
    buf = np.frombuffer(raw, np.uint8)
    if at < n and raw[at] == 255:
        lead = buf[at::256]
        other = np.flatnonzero(lead != 255)
        k = int(other[0]) if len(other) else len(lead)
        while k and start + 256 * k > n:
            k -= 1
    parts = [buf[start : start + 256 * k].reshape(-1, 256)[:, 1:].tobytes()] if k else []
    at = start + 256 * k
    while True:
        size = raw[at]
        at += 1
        if not size:
            return b"".join(parts), at
        if at + size > n:
            raise ValueError("cut short")
        parts.append(raw[at : at + size])
        at += size


def _interlaced(rows: int) -> np.ndarray:
    return np.concatenate([np.arange(a, rows, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])


def frames(raw: bytes, compose: bool = True) -> Iterator[Frame]:
    """Decode a GIF. Without compose, the canvas is an empty array where the frame is all that is seen (opaque, and as large)."""
    if raw[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", raw, 6)
    at, shared = 13, np.zeros((0, 3), np.uint8)
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared = np.frombuffer(raw, np.uint8, 3 * n, at).reshape(-1, 3)
        at += 3 * n
    if width * height > MAX_PIXELS:
        raise ValueError("canvas too large")
    empty = np.zeros((0, 0, 4), np.uint8)
    # what is on the canvas: colours, or None (nothing), or a frame that covers it (indices, colours of the palette)
    canvas = None

    def painted(on) -> np.ndarray:
        if on is None:
            return np.zeros((height, width, 4), np.uint8)
        return on[1][on[0]] if isinstance(on, tuple) else on.copy()

    dispose, delay, transparent = 0, 0, -1
    while at < len(raw):
        kind = raw[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = raw[at]
            body, at = _sub_blocks(raw, at + 1)
            if label == 0xF9 and len(body) >= 4:
                f, d, t = struct.unpack_from("<BHB", body)
                dispose, delay, transparent = (f >> 2) & 7, 10 * d, t if f & 1 else -1
            continue
        if kind != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h, f = struct.unpack_from("<HHHHB", raw, at)
        at += 9
        palette = shared
        if f & 0x80:
            n = 2 << (f & 7)
            palette = np.frombuffer(raw, np.uint8, 3 * n, at).reshape(-1, 3)
            at += 3 * n
        size = raw[at]
        data, at = _sub_blocks(raw, at + 1)
        got = lzw(data, size, w * h)
        if len(got) < w * h:
            raise ValueError("too few samples")
        index = got[: w * h].reshape(h, w)
        if f & 0x40:
            sorted_rows = np.empty_like(index)
            sorted_rows[_interlaced(h)] = index
            index = sorted_rows
        before = canvas
        y, x = slice(top, min(top + h, height)), slice(left, min(left + w, width))
        colours = np.zeros((256, 4), np.uint8)
        colours[: len(palette), :3], colours[:, 3] = palette, 255
        if (top, left, h, w) == (0, 0, height, width) and not (index == transparent).any():
            canvas = index, colours
            yield Frame(delay, left, top, index, palette, transparent, painted(canvas) if compose else empty)
        else:
            canvas = painted(canvas)
            seen = index[: max(y.stop - y.start, 0), : max(x.stop - x.start, 0)]
            drawn = seen != transparent
            canvas[y, x][drawn] = colours[seen[drawn]]
            yield Frame(delay, left, top, index, palette, transparent, canvas)
        if dispose == 2:
            if (top, left) == (0, 0) and h >= height and w >= width:
                canvas = None
            else:
                canvas = painted(canvas)
                canvas[y, x] = 0
        elif dispose == 3:
            canvas = before
        dispose, delay, transparent = 0, 0, -1


def histogram(f: Frame) -> np.ndarray:
    """Pixels of the canvas in each of BINS**3 cells of the colour cube, transparent ones left out."""
    # without a canvas the frame is what is seen
    if f.canvas.size:
        c = (f.canvas[f.canvas[..., 3] > 0][:, :3].astype(np.int64) * BINS) >> 8
        return np.bincount((c[:, 0] * BINS + c[:, 1]) * BINS + c[:, 2], minlength=BINS**3).astype(np.int64)
    used = np.bincount(f.indices.ravel(), minlength=256)[:256]
    p = np.zeros((256, 3), np.int64)
    p[: len(f.palette)] = f.palette
    cell = (p * BINS) >> 8
    return np.bincount((cell[:, 0] * BINS + cell[:, 1]) * BINS + cell[:, 2], weights=used, minlength=BINS**3).astype(np.int64)


# --- as columns ---


def store(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs, n_bytes of the text and its GIF file: media."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_bytes", "media")]
    source = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    @tv.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in tv.slices(batches):
            b = tv.from_arrow(rb.column("text"))
            media = [write(payload_of(tv.text_of(b, i))) for i in range(rb.num_rows)]
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in keep), pa.array(np.diff(b.offs)), pa.array(media, pa.binary())], names=[*keep, "n_bytes", "media"])

    return source.mapInArrow(run, schema)


FRAME = T.StructType([T.StructField(c, T.IntegerType()) for c in ("delay_ms", "left", "top", "width", "height")] + [T.StructField("histogram", T.ArrayType(T.LongType()))])
DESCRIBED = T.StructType(
    [
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("frames", T.ArrayType(FRAME)),
        T.StructField("feature", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def described(media: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns; from the stored bytes read back: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, frames, feature, error."""
    schema = T.StructType([media.schema[c] for c in keep] + DESCRIBED.fields)
    names = DESCRIBED.names

    def one(raw: bytes | None) -> tuple:
        if raw is None:
            return (None,) * 7 + ("no media",)
        timed, parts, total = [], [], np.zeros(BINS**3, np.int64)
        try:
            for f in frames(raw, compose=False):
                h = histogram(f)
                total += h
                parts.append(f.indices.tobytes())
                timed.append({"delay_ms": f.delay_ms, "left": f.left, "top": f.top, "width": f.indices.shape[1], "height": f.indices.shape[0], "histogram": h.tolist()})
        except (ValueError, IndexError, struct.error) as e:
            return None, None, None, len(raw), hashlib.sha256(raw).hexdigest(), [], None, str(e)
        payload = b"".join(parts)
        feature = ",".join(f"{i}:{c}" for i, c in enumerate(total.tolist()) if c)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(raw), hashlib.sha256(raw).hexdigest(), timed, feature, None

    @tv.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            rows = [one(m.as_py()) for m in rb.column("media")]
            cols = [pa.array([r[i] for r in rows], rb_type) for i, rb_type in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in keep), *cols], names=[*keep, *names])

    frame = pa.struct([("delay_ms", pa.int32()), ("left", pa.int32()), ("top", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("histogram", pa.list_(pa.int64()))])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(frame), pa.string(), pa.string()]
    return media.select(*keep, "media").mapInArrow(run, schema)
