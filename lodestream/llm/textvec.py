"""Whole batches of texts as numpy arrays: words, lines, pretokens and their hashes.

Everything here works on one Arrow batch inside a task. Nulls count as empty texts.
"""

from __future__ import annotations

import ctypes
import functools
import unicodedata
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_M = np.uint64


class Batch(NamedTuple):
    buf: np.ndarray  # uint8, UTF-8 of all texts
    offs: np.ndarray  # int64, len = texts + 1


class Spans(NamedTuple):
    start: np.ndarray  # first byte
    end: np.ndarray  # one past the last byte
    doc: np.ndarray  # row of the batch


def from_arrow(col: pa.Array | pa.ChunkedArray) -> Batch:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    if col.null_count:
        col = col.fill_null(b"")
    n = len(col)
    if n == 0:
        return Batch(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return Batch(buf, offs - offs[0])


def from_texts(texts) -> Batch:
    return from_arrow(pa.array([None if t is None else t for t in texts], pa.large_string()))


def text_of(b: Batch, i: int) -> bytes:
    return b.buf[b.offs[i] : b.offs[i + 1]].tobytes()


@functools.cache
def _space() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[0x20, 9, 10, 11, 12, 13]] = True
    return t


def words(b: Batch) -> Spans:
    """Maximal runs of bytes other than 0x20 and 0x09-0x0D, never across two texts."""
    n = len(b.buf)
    if not n:
        z = np.zeros(0, np.int64)
        return Spans(z, z, z)
    w = ~_space()[b.buf]
    first = w.copy()
    first[1:] &= ~w[:-1]
    cuts = b.offs[(b.offs > 0) & (b.offs < n)]
    first[cuts] = w[cuts]
    start = np.flatnonzero(first)
    last = w.copy()
    last[:-1] &= ~w[1:]
    last[cuts - 1] = w[cuts - 1]
    end = np.flatnonzero(last) + 1
    return Spans(start, end, rows_at(b, start))


def rows_at(b: Batch, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(b.offs, at, side="right") - 1


def counts(doc: np.ndarray, n: int, weight=None) -> np.ndarray:
    """Per text: how many entries, or the sum of their integer weights."""
    if weight is None:
        return np.bincount(doc, minlength=n).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(weight, dtype=np.int64)])
    edge = np.searchsorted(doc, np.arange(n + 1))
    return total[edge[1:]] - total[edge[:-1]]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> _M(30)
    h *= _M(0xBF58476D1CE4E5B9)
    h ^= h >> _M(27)
    h *= _M(0x94D049BB133111EB)
    h ^= h >> _M(31)
    return h


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _eights(buf: np.ndarray) -> np.ndarray:
    """The buffer as numbers of 8 bytes, with room behind its end."""
    pad = np.zeros((len(buf) // 8 + 2) * 8, np.uint8)
    pad[: len(buf)] = buf
    return pad.view("<u8")


def _block(eights: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a number; only the first ``left`` of them count."""
    word, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
    x = eights[word] >> shift
    # two shifts, as one by 64 places would have no effect
    x |= (eights[word + 1] << _M(1)) << (_M(63) - shift)
    return x & _MASKS[np.minimum(left, 8)]


def _further(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of more than 8 bytes, and their blocks after the first: span, first of each, number in the span, place, bytes left."""
    long = np.flatnonzero(size > 8)
    more = (size[long] - 1) >> 3
    first = np.cumsum(more) - more
    k = np.arange(int(more.sum())) - np.repeat(first, more) + 1
    return long, first, k, np.repeat(start[long], more) + 8 * k, np.repeat(size[long], more) - 8 * k


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes; equal bytes, equal hash, wherever they lie."""
    return span_keys(buf, start, end)[0]


def span_keys(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each span of bytes, and its first 8 bytes as a number.

    Blocks of 8 bytes go through a non-linear finaliser each, together with their number, before they are
    added up, so that no pattern of bytes cancels out.
    """
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    eights, size = _eights(buf), end - start
    with np.errstate(over="ignore"):
        head = _block(eights, start, size)
        h = mix(head + size.astype(np.uint64) * _M(0xD6E8FEB86659FD93))
        long, first, k, at, left = _further(start, size)
        if len(long):
            part = mix(mix(_block(eights, at, left)) + k.astype(np.uint64) * _M(0x9E3779B97F4A7C15))
            h[long] = mix(h[long] + np.add.reduceat(part, first))
    return h, head


def same_bytes(buf: np.ndarray, start: np.ndarray, other: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether buf from each start on and other from each begin on have the same ``size`` bytes."""
    if not len(start):
        return np.zeros(0, bool)
    a = _eights(buf)
    b = a if other is buf else _eights(other)
    out = _block(a, start, size) == _block(b, begin, size)
    long, first, k, at, left = _further(start, size)
    if len(long):
        there = at - np.repeat((start - begin)[long], (size[long] - 1) >> 3)
        out[long] &= np.logical_and.reduceat(_block(a, at, left) == _block(b, there, left), first)
    return out


def distinct_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each different run of bytes, one span that has it, and which one each span has. Bytes are compared, not only hashes."""
    h, first, where = np.unique(span_hash(buf, start, end), return_index=True, return_inverse=True)
    rep, size = first[where], end - start
    odd = np.flatnonzero((size != size[rep]) | ~same_bytes(buf, start, buf, start[rep], size))
    if len(odd):
        # of runs that share a hash, all but one get entries of their own
        known: dict[bytes, int] = {}
        where = where.copy()
        for i in odd.tolist():
            where[i] = len(first) + known.setdefault(buf[start[i] : end[i]].tobytes(), len(known))
        extra = np.array([odd[np.flatnonzero(where[odd] == len(first) + k)[0]] for k in range(len(known))], np.int64)
        h, first = np.concatenate([h, span_hash(buf, start[extra], end[extra])]), np.concatenate([first, extra])
    return h, first, where


def ngram_hash(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of n words inside one text, and the window's first word's index."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(doc[:m] == doc[n - 1 :])
    acc = np.zeros(len(first), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            acc = acc * _M(0x5851F42D4C957F2D) + h[first + k]
    return mix(acc), first


@functools.cache
def char_classes() -> np.ndarray:
    """For each code point: 1 letter, 2 number, 3 white space, 0 others."""
    t = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            t[c] = 1
        elif k == "N":
            t[c] = 2
    # fixed values: the White_Space property
    for a, z in ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        t[a : z + 1] = 3
    return t


# fixed values: the endings that the public pattern splits off
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


@functools.cache
def _byte_classes() -> np.ndarray:
    t = char_classes()[:256].copy()
    t[128:] = 1
    return t


def _latin(buf: np.ndarray) -> bool:
    """Whether all characters beyond ASCII are in U+00C0-U+024F and letters."""
    at = np.flatnonzero(buf >= 0xC0)
    if not len(at):
        return True
    first, second = buf[at], buf[at + 1]
    return bool(((first >= 0xC3) & ((first < 0xC9) | ((first == 0xC9) & (second < 0x90))) & ~((first == 0xC3) & ((second == 0x97) | (second == 0xB7)))).all())


def pretokens(b: Batch) -> Spans:
    """The matches of the public byte-level pattern, in order, as byte spans.

    The pattern's alternatives (contraction, optional blank and a run of one class, white space)
    become run boundaries: a white-space run before other text gives its last character away, to
    the next run if it is a blank and to a token of its own otherwise.
    """
    n = len(b.buf)
    if not n:
        z = np.zeros(0, np.int64)
        return Spans(z, z, z)
    if _latin(b.buf):
        # every character beyond ASCII is a letter: bytes will do in place of characters
        lead, code, kind = None, b.buf, _byte_classes()[b.buf]
    else:
        lead = np.flatnonzero((b.buf & 0xC0) != 0x80)
        code = np.frombuffer(b.buf.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = char_classes()[code]
    m = len(code)
    opens = np.zeros(m + 1, bool)  # first character of a text
    opens[b.offs if lead is None else np.searchsorted(lead, b.offs)] = True
    begin = np.empty(m, bool)
    begin[0] = True
    begin[1:] = kind[1:] != kind[:-1]
    begin |= opens[:-1]
    run = np.flatnonzero(begin)
    stop = np.append(run[1:], m)
    rk = kind[run]
    cut = begin.copy()
    followed = (rk == 3) & (~opens[stop])  # more text after this white space
    r, s = run[followed], stop[followed]
    blank = code[s - 1] == 32
    cut[s - 1] = True  # the last white space leaves its run
    cut[s[blank]] = False  # a blank joins what follows
    # contractions: an apostrophe alone in its run, at a token's start, before a lower-case ending
    q = run[(rk == 0) & (stop - run == 1) & (code[run] == 39)]
    q = q[cut[q] & (q + 1 < m)]
    q = q[~opens[q + 1]]
    if len(q):
        pad = np.append(code, [0, 0])
        joined = np.append(opens, [True, True])
        c1, c2 = pad[q + 1], np.where(joined[q + 2], 0, pad[q + 2])
        size = np.zeros(len(q), np.int64)
        for e in reversed(CONTRACTIONS):
            hit = (c1 == e[0]) & ((c2 == e[1]) if len(e) == 2 else True)
            size[hit] = len(e)
        q, size = q[size > 0], size[size > 0]
        cut[q + 1] = False
        after = q + 1 + size
        after = after[after < m]
        # the rest of the letters begins anew; a blank already there stays with what follows
        inside = (kind[after] == 1) & ~opens[after]
        cut[after[inside]] = True
    tok = np.flatnonzero(cut)
    start = tok if lead is None else lead[tok]
    end = np.append(start[1:], n)
    return Spans(start, end, rows_at(b, start))


def guarded(docs: DataFrame, used: tuple[str, ...]) -> tuple[DataFrame, list]:
    """docs with every column but the used ones under a name that no operator has, and the selection that gives the old names back."""
    names = [c if c in used else f"_guarded_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns)]


def lean(work):
    """A function for mapInArrow that gives memory back to the system when its task ends: idle Python workers stay small."""

    @functools.wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + sizes[i]] for all i, end to end."""
    total = int(sizes.sum())
    if not total:
        return flat[:0]
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    return flat[at + np.arange(total)]


SLICE_BYTES = 1 << 21


def slices(batches, column: str = "text", most: int = SLICE_BYTES):
    """Cut record batches so that one slice holds about ``most`` bytes of text (one row at least): bounds a task's memory."""
    for rb in batches:
        col = rb.column(column)
        sizes = np.diff(from_arrow(col).offs)
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), rb.num_rows]
        for a, z in zip(cuts[:-1], cuts[1:]):
            if z > a:
                yield rb.slice(a, z - a)
