"""Byte-level BPE encoding and decoding.

Encoding: texts are split by the public pattern. Words that come again are counted first, and the most
frequent ones (at most ``MAX_HOT``, a documented bound) are encoded once and broadcast as a dictionary.
Then each task cuts its rows into chunks and hands over the chunk's other distinct words as byte arrays.
In both places Spark higher-order functions fold the ranked merges over the distinct words' byte arrays.
The fold holds one number for each part of a word: the rank of the pair that begins there, its place
and its id. So the least number is the pair of least rank, the leftmost on a tie; it is joined, and two
new neighbours are looked up. Words of more than ``LONG`` bytes are folded in blocks: a step then looks at
the blocks' least numbers and at one block, and a merge at a block's edge first joins it to its neighbours.
The rank map is a literal of the plan: for each pair of ids whose bytes together are a token, the
token's rank, laid out as two hashed arrays so that a look-up reads at most two places. Last, the
words' ids go back to their places in the texts. Texts are never shuffled, and a lost task is redone
alone. Which words are in the dictionary changes the cost and never the result; words are told apart by
their bytes, also where their hashes agree.

Decoding concatenates the ids' binary pieces, also by higher-order functions.

Defined results: a null text is an empty text and has no ids; repeated rows are encoded alike; an
empty table gives an empty table; kept columns pass through unchanged, whatever their names (the ids'
column replaces one of its own name); a decoded id that the vocabulary lacks gives null. A word may be as
long as a text: 200,000 letters without a blank take about half a minute, and more grow faster than in proportion.
"""

from __future__ import annotations

import base64
import functools
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import most_frequent, settle, stored
from . import textvec as tv

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CHUNK_BYTES, MAX_HOT, LONG, COUNTED = 1 << 21, 1 << 19, 256, 1 << 20
NONE = SHIFT = 65536  # ids and ranks are below; as a rank: no token
FREE = (1 << 48) - 1  # the key of no pair
PLACE, RANK = 16, 46  # bits below a part's place, and below the rank of its pair


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of fixed size, read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def pair_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Two arrays of key * SHIFT + rank (or FREE), key = left * SHIFT + right, at key modulo the array's size."""
    rank = ranks(path)
    pairs = {rank[t[:i]] * SHIFT + rank[t[i:]]: r for t, r in rank.items() for i in range(1, len(t)) if t[:i] in rank and t[i:] in rank}
    size = [s | 1 for s in (int(len(pairs) * 1.3) + 7, int(len(pairs) * 1.3) + 1234)]
    while True:
        tables = [np.full(s, FREE, np.int64) for s in size]
        for key, r in pairs.items():
            entry, side = key * SHIFT + r, 0
            for _ in range(500):
                at = (entry // SHIFT) % size[side]
                entry, tables[side][at] = int(tables[side][at]), entry
                if entry == FREE:
                    break
                side = 1 - side
            else:
                break
        else:
            return tables[0], tables[1]
        size = [s + 998 for s in size]


def _merge(word: bytes, rank: dict[bytes, int]) -> list[bytes]:
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: rank.get(parts[i] + parts[i + 1], NONE))
        if parts[best] + parts[best + 1] not in rank:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


@functools.cache
def unreachable(path: str) -> list[bytes]:
    """Tokens that merges alone never form; as whole words they still are one token."""
    rank = ranks(path)
    return [t for t in rank if len(t) > 1 and len(_merge(t, rank)) > 1]


def _literal(values, kind: str) -> Column:
    """A list as one literal: constant folding turns the parsed text into it."""
    return F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), f"array<{kind}>")


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rank_map(path: str) -> Column:
    """Struct of bytes' ids and the pair table as literals.

    Six of ten places are free. Those hold 0 here, which keeps the text short that the driver handles in many copies: 0 is
    no key's entry but that of key 0, which looks at place 0 only, and there FREE stays.
    """
    rank = ranks(path)
    entries = lambda t: _literal(np.where((t == FREE) & (np.arange(len(t)) > 0), 0, t).tolist(), "bigint")
    one, two = map(entries, pair_table(path))
    return F.struct(_literal([rank.get(bytes([b]), NONE) for b in range(256)], "int").alias("b"), one.alias("t1"), two.alias("t2"))


def encode_words(words: Column, path: str, tables: Column | None = None) -> Column:
    """array<array<int>> of bytes to array<array<int>> of ids; tables is the path's rank_map, if it is at hand."""
    rank = ranks(path)
    one, two = pair_table(path)
    tables = rank_map(path) if tables is None else tables
    odd = [(list(t), rank[t]) for t in unreachable(path)]
    bits = lambda x, k: x.bitwiseAND(F.lit((1 << k) - 1).cast("long"))
    none, one_ = F.lit(NONE).cast("long"), F.lit(1)

    def pair(t: Column, left: Column, right: Column) -> Column:
        """The rank of a pair of ids, in its place of a part's number; NONE if an id is null.

        An entry and the key differ in the rank's bits only if the entry is the key's. (No lambdas here: Spark's
        analysis takes twice as long for each level of them.)
        """
        key = F.shiftleft(left, 16).bitwiseOR(right)
        differ = lambda name, size: F.get(t[name], (key % size).cast("int")).bitwiseXOR(F.shiftleft(key, 16))
        return F.shiftleft(F.least(differ("t1", len(one)), differ("t2", len(two)), none), RANK)

    def merged(t: Column, parts: Column, m: Column, p: Column) -> Column:
        """parts after the one at p (from 1), whose number is m, is joined with the next."""
        made, before = F.shiftright(m, RANK), F.get(parts, p - 2)
        own = pair(t, made, bits(F.get(parts, p + 1), PLACE)) + (bits(m, RANK) - bits(m, PLACE)) + made
        both = F.when(p > 1, F.array(pair(t, bits(before, PLACE), made) + bits(before, RANK), own)).otherwise(F.array(own))
        return F.concat(F.slice(parts, one_, F.greatest(p - 2, F.lit(0))), both, F.slice(parts, p + 2, F.size(parts)))

    def step(t: Column, parts: Column) -> Column:
        then = lambda m: F.when(m < (NONE << RANK), _let(F.array_position(parts, m).cast("int"), lambda p: merged(t, parts, m, p))).otherwise(parts)
        return _let(F.array_min(parts), then)

    def blocks_of(arrays: Column) -> Column:
        return F.transform(arrays, lambda a: F.struct(a.alias("a"), F.array_min(a).alias("m")))

    def block_step(t: Column, blocks: Column) -> Column:
        n, least = F.size(blocks), F.transform(blocks, lambda x: x["m"])

        def placed(m: Column, b: Column, p: Column) -> Column:
            parts, first = F.get(blocks, b - 1)["a"], F.greatest(b - 1, one_)
            inside = ((p > 1) | (b == 1)) & ((p + 2 <= F.size(parts)) | (b == n))
            done = F.array(merged(t, parts, m, p))
            joined = F.array(F.flatten(F.transform(F.slice(blocks, first, b + 2 - first), lambda x: x["a"])))
            a, z = F.when(inside, b).otherwise(first), F.when(inside, b + 1).otherwise(b + 2)
            return F.concat(F.slice(blocks, one_, a - 1), blocks_of(F.when(inside, done).otherwise(joined)), F.slice(blocks, z, n))

        at = lambda m, b: _let(F.array_position(F.get(blocks, b - 1)["a"], m).cast("int"), lambda p: placed(m, b, p))
        then = lambda m: F.when(m < (NONE << RANK), _let(F.array_position(least, m).cast("int"), lambda b: at(m, b))).otherwise(blocks)
        return _let(F.array_min(least), then)

    def fold(t: Column, word: Column) -> Column:
        n = F.size(word)
        byte = lambda b: F.get(t["b"], b).cast("long")
        part = lambda b, k: pair(t, byte(b), byte(F.get(word, k + 1))) + F.shiftleft(k.cast("long"), PLACE) + byte(b)
        ids = lambda parts: F.transform(parts, lambda x: bits(x, PLACE).cast("int"))
        out = F.aggregate(F.array_repeat(F.lit(0), n - 1), F.transform(word, part), lambda acc, _: step(t, acc), ids)
        cut = F.transform(F.sequence(F.lit(0), n - 1, F.lit(LONG)), lambda k: F.transform(F.slice(word, k + 1, F.lit(LONG)), lambda b, j: part(b, k + j)))
        steps = F.array_repeat(F.lit(0), n + F.ceil(n / LONG).cast("int"))
        long = F.aggregate(steps, blocks_of(cut), lambda acc, _: block_step(t, acc), lambda acc: ids(F.flatten(F.transform(acc, lambda x: x["a"]))))
        out = F.when(n <= LONG, out).otherwise(long)
        for bytes_, r in odd:
            out = F.when(word == F.array(*map(F.lit, bytes_)), F.array(F.lit(r))).otherwise(out)
        return out

    return F.get(F.transform(F.array(tables), lambda t: F.transform(words, lambda w: fold(t, w))), F.lit(0))


def _pack(table: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_batch(table)
    return sink.getvalue().to_pybytes()


class Hot(NamedTuple):
    """Frequent words in order of their hashes."""

    hashes: np.ndarray
    edge: np.ndarray  # where each word's bytes begin; len = words + 1
    flat: np.ndarray


class HotIds(NamedTuple):
    edge: np.ndarray  # where each word's ids begin; len = words + 1
    flat: np.ndarray


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """One list of words, each a list of its bytes."""
    edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(flat.astype(np.int32)))
    return pa.ListArray.from_arrays(pa.array(np.array([0, len(lists)], np.int32)), lists)


def _binaries(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offs = pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, offs, pa.py_buffer(flat.tobytes())])


@tv.lean
def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of up to 64 bytes, with their counts, of as many neighbouring texts as have COUNTED of them."""
    parts, held = [], 0

    def merged() -> pa.RecordBatch:
        h, often, size, flat = (np.concatenate([p[i] for p in parts]) for i in range(4))
        begin = np.cumsum(size) - size
        # words that share a hash are counted as one of them here: that concerns only which words are in the dictionary
        known, one, where = np.unique(h, return_index=True, return_inverse=True)
        count = np.bincount(where, weights=often, minlength=len(known)).astype(np.int64)
        return pa.RecordBatch.from_arrays([_binaries(tv.gather(flat, begin[one], size[one]), size[one]), pa.array(count)], names=["word", "n"])

    for part in tv.slices(batches):
        b = tv.from_arrow(part.column("text"))
        s = tv.pretokens(b)
        size = s.end - s.start
        start, end = s.start[size <= 64], s.end[size <= 64]
        h, first, often = np.unique(tv.span_hash(b.buf, start, end), return_index=True, return_counts=True)
        size = end[first] - start[first]
        parts.append((h, often, size, tv.gather(b.buf, start[first], size)))
        held += len(h)
        if held > COUNTED:
            yield merged()
            parts, held = [], 0
    if parts:
        yield merged()


@tv.lean
def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        b = tv.from_arrow(rb.column("word"))
        sizes = np.diff(b.offs)
        yield pa.RecordBatch.from_arrays([pa.array([sizes.astype("<u4").tobytes()], pa.binary()), pa.array([b.buf.tobytes()], pa.binary()), _lists(b.buf, sizes)], names=["lengths", "flat", "words"])


@tv.lean
def _as_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        for k in range(rb.num_rows):
            ids = rb.column("ids").slice(k, 1).flatten()
            sizes = np.diff(ids.offsets.to_numpy()).astype("<u4").tobytes()
            flat = ids.flatten().to_numpy().astype("<u2").tobytes()
            yield pa.RecordBatch.from_arrays([rb.column("lengths").slice(k, 1), rb.column("flat").slice(k, 1), pa.array([sizes], pa.binary()), pa.array([flat], pa.binary())], names=["lengths", "flat", "sizes", "ids"])


def dictionary(docs: DataFrame, path: str, most: int = MAX_HOT, tables: Column | None = None) -> tuple[Hot, HotIds]:
    """The frequent words and their ids: at most ``most`` words of at most 64 bytes, each twice or more in all texts."""
    counts = docs.select("text").mapInArrow(_counted_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    counts = stored(counts)
    settle(docs.sparkSession)
    hot = most_frequent(counts, "n", most).select("word")
    rows = hot.mapInArrow(_as_bytes, "lengths binary, flat binary, words array<array<int>>").select("lengths", "flat", encode_words(F.col("words"), path, tables).alias("ids"))
    got = rows.mapInArrow(_as_blobs, "lengths binary, flat binary, sizes binary, ids binary").toArrow()
    lengths, flat, sizes, ids = (tv.from_arrow(got.column(c)).buf.view(t) for c, t in (("lengths", "<u4"), ("flat", np.uint8), ("sizes", "<u4"), ("ids", "<u2")))
    lengths, sizes = lengths.astype(np.int64), sizes.astype(np.int64)
    end = np.cumsum(lengths)
    begin, parts = end - lengths, []
    for a in range(0, len(lengths), 1 << 16):  # the driver holds the dictionary, and little beside it
        z = min(a + (1 << 16), len(lengths))
        parts.append(tv.span_hash(flat[begin[a] : end[z - 1]], begin[a:z] - begin[a], end[a:z] - begin[a]))
    h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    order = np.argsort(h, kind="stable")
    edge = lambda x: np.concatenate([[0], np.cumsum(x[order])]).astype(np.int32)
    sorted_ = lambda data, sizes: tv.from_arrow(_binaries(data, sizes).take(pa.array(order))).buf
    return Hot(h[order], edge(lengths), sorted_(flat, lengths)), HotIds(edge(sizes), sorted_(ids.view(np.uint8), 2 * sizes).view("<u2"))


def chunks(docs: DataFrame, keep: list[str], hot, most: int = CHUNK_BYTES) -> DataFrame:
    """A row for each chunk: kept columns, words in each text, which word stands where, and the words that the dictionary lacks as byte arrays."""
    source = docs.select(*dict.fromkeys([*keep, "text"]))

    @tv.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = hot.value
        for rb in tv.slices(batches, most=most):
            b = tv.from_arrow(rb.column("text"))
            s = tv.pretokens(b)
            h, first, where = tv.distinct_spans(b.buf, s.start, s.end)
            start, size = s.start[first], s.end[first] - s.start[first]
            at, cold = np.zeros(len(h), np.int64), np.ones(len(h), bool)
            if len(have.hashes):
                at = np.minimum(np.searchsorted(have.hashes, h), len(have.hashes) - 1)
                begin = have.edge[at].astype(np.int64)
                likely = np.flatnonzero((have.hashes[at] == h) & (have.edge[at + 1] - begin == size))
                cold[likely[tv.same_bytes(b.buf, start[likely], have.flat, begin[likely], size[likely])]] = False
            at[cold] = len(have.hashes) + np.arange(cold.sum())
            lists = _lists(tv.gather(b.buf, start[cold], size[cold]), size[cold])
            blobs = _pack(rb.select(keep)), tv.counts(s.doc, rb.num_rows).astype("<u4").tobytes(), at[where].astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in blobs), lists], names=["rest", "counts", "places", "words"])

    return source.mapInArrow(run, "rest binary, counts binary, places binary, words array<array<int>>")


def encode(docs: DataFrame, path: str | None = None, keep: list[str] | None = None, out: str = "ids", most: int = CHUNK_BYTES, max_hot: int = MAX_HOT) -> DataFrame:
    """The kept columns of docs (all, unless named) and the text's ids as array<int>."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != out]
    path = path or default_path()
    tables = rank_map(path)
    words, ids_of = map(docs.sparkSession.sparkContext.broadcast, dictionary(docs, path, max_hot, tables))
    tv.give_back()
    settle(docs.sparkSession)
    encoded = chunks(docs, keep, words, most).select("rest", "counts", "places", encode_words(F.col("words"), path, tables).alias("ids"))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, T.ArrayType(T.IntegerType()))])

    @tv.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = ids_of.value
        n = len(hot.edge) - 1
        for rb in batches:
            for k in range(rb.num_rows):
                rest = pa.ipc.open_stream(rb.column("rest")[k].as_buffer()).read_next_batch()
                ends = np.concatenate([[0], np.cumsum(np.frombuffer(rb.column("counts")[k].as_buffer(), "<u4"), dtype=np.int64)])
                places = np.frombuffer(rb.column("places")[k].as_buffer(), "<u4").astype(np.int64)
                cold = rb.column("ids").slice(k, 1).flatten()
                edge, flat = cold.offsets.to_numpy().astype(np.int64), cold.values.to_numpy()
                for a in range(0, rest.num_rows, 512):  # a part at a time: ids take more room than texts
                    part = ends[a : a + 513]
                    p = places[part[0] : part[-1]]
                    own = p >= n
                    begin, size = np.empty(len(p), np.int64), np.empty(len(p), np.int64)
                    for mask, e, at in ((own, edge, p[own] - n), (~own, hot.edge, p[~own])):
                        begin[mask], size[mask] = e[at], e[at + 1] - e[at]
                    tokens = np.empty(int(size.sum()), np.int32)
                    where = np.repeat(own, size)
                    tokens[where], tokens[~where] = tv.gather(flat, begin[own], size[own]), tv.gather(hot.flat, begin[~own], size[~own])
                    upto = np.concatenate([[0], np.cumsum(size)])[part - part[0]]
                    lists = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(tokens))
                    yield pa.RecordBatch.from_arrays([*rest.slice(a, 512).columns, lists], names=[*keep, out])

    return encoded.mapInArrow(run, schema)


def decode(ids: Column, path: str | None = None) -> Column:
    """array<int> of ids to the bytes they stand for."""
    rank = ranks(path or default_path())
    pieces = [""] * (max(rank.values()) + 1)
    for t, r in rank.items():
        pieces[r] = base64.b64encode(t).decode()
    # a string may hold any bytes: pieces are joined as they are
    joined = lambda p: F.transform(ids, lambda i: F.get(p, i).cast("string"))
    whole = lambda j: F.when(~F.exists(j, lambda x: x.isNull()), F.array_join(j, "")).cast("binary")
    return _let(_literal(pieces, "binary"), lambda p: _let(joined(p), whole))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs."""
    done = encode(docs.select("doc_id", "text"), path, ["doc_id"])
    text = F.array_join(F.col("ids").cast("array<string>"), ",")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text.cast("binary"), 256).alias("ids_sha256"), F.sha2(decode(F.col("ids"), path), 256).alias("decoded_sha256"))
