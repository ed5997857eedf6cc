"""Token-ID output: ids of every document in shards compressed by Re-Pair, with random access.

Documents stand in ascending doc_id order (nulls first; ties by ids). Each shard file holds whole
documents: a header, the grammar, the sequence of symbols, and the documents' offsets. Re-Pair
repeatedly replaces the shard's frequent id pairs by nonterminals. A round counts the pairs, takes all that
stand ``LEAST`` times or more, and replaces their occurrences, of two that overlap the left one. Rounds go on until no pair is frequent enough or the symbols run out. After the
first round only pairs next to a symbol that is new, or whose pair lost an occurrence, can have become
frequent, and only those are counted. Each rule's expansion length is stored, so a document's ids
are found by a binary search over the sequence's cumulative lengths, and only its symbols are expanded.

File layout (little-endian): 4 bytes ``RPR1``; u32 documents, terminals, rules, symbols; u32 left and
right of each rule; u32 expansion length of each rule; u32 symbols of the sequence; u64 offsets of the
documents (documents + 1). A shard is one row (shard, part, docs, ids, blob) of a Parquet table, written by
Spark to the shared folder; a shard whose ids would take too much memory is written in several parts, each
with a grammar of its own. A shard is a range of doc_ids: ``KNOTS`` quantiles at the most, and straight lines
between them, say which one, so the number of shards has no bound and the plan has one.

The ids come from the tokenizers library. Since its byte-level splitting is a fixed pattern, each
task encodes the distinct words it meets with the library and reuses the results, kept in arrays of
bounded size and compared by their bytes.

Defined results: a null or empty text has only the end id; repeated rows are written as often as they
stand; an empty table gives no shards and an empty result.
"""

from __future__ import annotations

import functools
import itertools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import arrow_rows, shared_dir, stored
from . import textvec as tv

VOCABULARY, END_ID = "byte_bpe_50k.json", 2
MAGIC = b"RPR1"
PART_IDS = 1 << 19  # ids in one part of a shard
SHARD_BYTES = 24 << 20
TERMINALS, MAX_SYMBOLS = 1 << 16, 1 << 17
LEAST, WORTH = 16, 4  # occurrences that make a pair frequent, and replacements that pay for a rule of three numbers
KNOTS, MAX_TASKS, GROUP = 512, 20_000, 1024  # most quantiles, most tasks that write, shards summed up together
CACHE_BITS, MAX_CACHED_IDS, MAX_CACHED_BYTES = 21, 1 << 24, 1 << 25  # words, their ids and their bytes: 110 MB at the most
#: A page for each file: pages are read as a whole, and the writer's default looks at their size every 100 rows only.
PAGES = {"parquet.page.size": "1048576", "parquet.page.size.row.check.min": "1"}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


class Words:
    """A cache of words' ids with one place for each hash value's first bits; the first word there stays.

    A word is known by its length and first 8 bytes, a longer one by its other bytes too.
    """

    def __init__(self, path: str, bits: int = CACHE_BITS):
        self.path, self.shift = path, np.uint64(64 - bits)
        self.head, self.length = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        self.at, self.begin, self.size = (np.zeros(1 << bits, np.int32) for _ in range(3))
        self.clear()

    def clear(self) -> None:
        self.length[:] = 0
        self.flat, self.used = np.zeros(1 << 20, np.uint16), 0
        self.bytes, self.held = np.zeros(1 << 20, np.uint8), 0

    def _keep(self, data: np.ndarray) -> int:
        """Append bytes of long words; where they begin."""
        if self.held + len(data) > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros(max(len(data), len(self.bytes)), np.uint8)])
        self.bytes[self.held : self.held + len(data)] = data
        self.held += len(data)
        return self.held - len(data)

    def _library(self, words: list[str]) -> list[list[int]]:
        """Each word's ids. Words without inner white space go in texts of 64, a line feed between them: it is a
        token of its own there, so its id marks where each word ends."""
        t = tokenizer(self.path)
        many = lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        feed = many(["\n"])[0][0]
        plain = [i for i, w in enumerate(words) if not w.isspace()]
        out: list[list[int]] = [[]] * len(words)
        groups = [plain[a : a + 64] for a in range(0, len(plain), 64)]
        for group, ids in zip(groups, many(["\n".join([words[i] for i in g]) for g in groups])):
            a = 0
            if ids.count(feed) != len(group) - 1:
                for i, got in zip(group, many([words[i] for i in group])):
                    out[i] = got
                continue
            for i in group[:-1]:
                z = ids.index(feed, a)
                out[i] = ids[a:z]
                a = z + 1
            out[group[-1]] = ids[a:]
        blank = sorted(set(range(len(words))).difference(plain))
        for i, got in zip(blank, many([words[i] for i in blank])):
            out[i] = got
        return out

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encode words with the library: where each one's ids begin in flat, and how many they are."""
        begins, sizes = [], []
        for a in range(0, len(words), 8192):
            got = self._library(words[a : a + 8192])
            size = np.fromiter(map(len, got), np.int32, len(got))
            n = int(size.sum())
            if self.used + n > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(n, len(self.flat)), np.uint16)])
            self.flat[self.used : self.used + n] = np.fromiter(itertools.chain.from_iterable(got), np.uint16, n)
            begins.append(self.used + np.cumsum(size) - size)
            sizes.append(size)
            self.used += n
        return np.concatenate(begins).astype(np.int32), np.concatenate(sizes)

    def encode(self, b: tv.Batch) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch of texts, end id included, and where each text's ids begin (len = texts + 1)."""
        n = len(b.offs) - 1
        if self.used > MAX_CACHED_IDS or self.held > MAX_CACHED_BYTES:
            self.clear()
        s = tv.pretokens(b)
        h, head = tv.span_keys(b.buf, s.start, s.end)
        length = s.end - s.start
        slot = (h >> self.shift).astype(np.int64)
        known = (self.head[slot] == head) & (self.length[slot] == length)
        long = np.flatnonzero(known & (length > 8))
        known[long] = tv.same_bytes(b.buf, s.start[long], self.bytes, self.at[slot[long]].astype(np.int64), length[long])
        begin, size = self.begin[slot], self.size[slot]
        new = np.flatnonzero(~known)
        if len(new):
            _, first, where = tv.distinct_spans(b.buf, s.start[new], s.end[new])
            f = new[first]
            raw = b.buf.tobytes()
            at, count = self.learn([raw[x:y].decode() for x, y in zip(s.start[f].tolist(), s.end[f].tolist())])
            begin[new], size[new] = at[where], count[where]
            free = (self.length[slot[f]] == 0) & (length[f] <= 1024)
            at, count, f = at[free], count[free], f[free]
            _, one = np.unique(slot[f], return_index=True)
            at, count, f = at[one], count[one], f[one]
            to = slot[f]
            self.head[to], self.length[to], self.begin[to], self.size[to] = head[f], length[f], at, count
            self.at[to] = self._keep(tv.gather(b.buf, s.start[f], length[f])) + np.cumsum(length[f]) - length[f]
        ids = tv.gather(self.flat, begin.astype(np.int64), size.astype(np.int64))
        per = tv.counts(s.doc, n, size)
        edge = np.concatenate([[0], np.cumsum(per + 1)])
        out = np.full(edge[-1], END_ID, np.uint16)
        keep = np.ones(len(out), bool)
        keep[edge[1:] - 1] = False
        out[keep] = ids
        return out, edge


_words: dict[str, Words] = {}


def encode(docs: DataFrame, path: str, keep: list[str], shard_of=None) -> DataFrame:
    """The kept columns and ids: binary, unsigned 16-bit little-endian, with the end id; with shard_of also shard, by doc_id."""
    source = docs.select(*keep, "text")
    more = ["shard"] if shard_of else []

    @tv.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words.setdefault(path, Words(path))
        for rb in tv.slices(batches):
            ids, edge = words.encode(tv.from_arrow(rb.column("text")))
            offs = pa.py_buffer((2 * edge).astype(np.int32).tobytes())
            blob = pa.Array.from_buffers(pa.binary(), rb.num_rows, [None, offs, pa.py_buffer(ids.astype("<u2").tobytes())])
            shard = [pa.array(shard_of(rb.column("doc_id")), pa.int32())] if shard_of else []
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in keep), *shard, blob], names=[*keep, *more, "ids"])

    kinds = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"{c} int" for c in more)])
    return source.mapInArrow(run, f"{kinds}, ids binary")


# --- the grammar ---


TABLE_BITS = 17


def _place(pair: np.ndarray) -> np.ndarray:
    return ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _frequent(pair: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that stand often enough, and how often."""
    s = np.sort(pair)
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    count = np.diff(np.append(first, len(s)))
    often = count >= least
    return s[first[often]], count[often]


def _alternate(where: np.ndarray) -> np.ndarray:
    """Of places in a row every second one, from the left."""
    k = np.arange(len(where))
    begin = np.append(True, np.diff(where) > 1)
    return where[(k - np.maximum.accumulate(np.where(begin, k, 0))) % 2 == 0]


def compress(ids: np.ndarray, terminals: int = TERMINALS, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """left, right and expansion length of each rule, and the sequence. Rule k is symbol terminals + k.

    No pair stands ``least`` times without overlap in the sequence, unless the symbols have run out.
    """
    seq = ids.astype(np.uint32)
    rules, made = [], 0  # (left, right) of each round, and how many
    look: np.ndarray | None = None  # symbols that a pair must have to be counted; None: any
    while len(seq) > 1 and made < MAX_SYMBOLS - terminals:
        at = np.arange(len(seq) - 1) if look is None else np.flatnonzero(look[seq[:-1]] | look[seq[1:]])
        pair = (seq[at].astype(np.uint64) << np.uint64(17)) | seq[at + 1]
        found, count = _frequent(pair, least)
        if not len(found):
            break
        best = np.lexsort((found, -count))[: MAX_SYMBOLS - terminals - made][::-1]
        # a table by hash; of pairs that meet in one place the most frequent, written last, is in this round
        table = np.full(1 << TABLE_BITS, 1 << 63, np.uint64)
        table[_place(found[best])] = found[best]
        where = _alternate(at[table[_place(pair)] == pair])
        new, rule, stands = np.unique((seq[where].astype(np.uint64) << np.uint64(17)) | seq[where + 1], return_inverse=True, return_counts=True)
        # a pair whose occurrences went to others that overlap them may not be worth a rule any more
        sure = stands >= min(least, WORTH)
        if not sure.all():
            where = where[sure[rule]]
            new, rule = new[sure], (np.cumsum(sure) - 1)[rule[sure[rule]]]
        if not len(new):
            # they are in each other's way: the most frequent pair alone that does not overlap itself too often
            alone = next(((p, w) for p in found[best[::-1]] if len(w := _alternate(at[pair == p])) >= least), None)
            if alone is None:
                break
            new, where = np.array([alone[0]], np.uint64), alone[1]
            rule = np.zeros(len(where), np.int64)
        l, r = (new >> np.uint64(17)).astype(np.uint32), (new & np.uint64((1 << 17) - 1)).astype(np.uint32)
        seq[where] = (terminals + made + rule).astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[where + 1] = False
        seq = seq[keep]
        # pairs that were frequent and not replaced, wholly or in part, are counted again, and those of new symbols
        look = np.zeros(MAX_SYMBOLS, bool)
        look[terminals + made : terminals + made + len(new)] = True
        look[(found >> np.uint64(17)).astype(np.int64)] = True
        rules.append((l, r))
        made += len(new)
    left, right = (np.concatenate([x[i] for x in rules]) if rules else np.zeros(0, np.uint32) for i in range(2))
    size = np.ones(terminals + made, np.uint32)
    k = terminals
    for l, r in rules:
        size[k : k + len(l)] = size[l] + size[r]
        k += len(l)
    return left, right, size[terminals:], seq


def expand(seq: np.ndarray, left: np.ndarray, right: np.ndarray, terminals: int = TERMINALS) -> np.ndarray:
    """The ids that a sequence of symbols stands for; each step replaces all nonterminals by their two sides."""
    while True:
        rule = seq >= terminals
        if not rule.any():
            return seq
        at = np.cumsum(1 + rule) - (1 + rule)
        out = np.empty(len(seq) + int(rule.sum()), np.uint32)
        out[at[~rule]] = seq[~rule]
        k = seq[rule] - terminals
        out[at[rule]], out[at[rule] + 1] = left[k], right[k]
        seq = out


def write(ids: np.ndarray, edge: np.ndarray) -> bytes:
    left, right, length, seq = compress(ids)
    head = MAGIC + struct.pack("<4I", len(edge) - 1, TERMINALS, len(left), len(seq))
    return head + b"".join(x.astype("<u4").tobytes() for x in (left, right, length, seq)) + edge.astype("<u8").tobytes()


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a token file")
        n, self.terminals, rules, symbols = struct.unpack_from("<4I", blob, 4)
        at = 20
        part = []
        for k in (rules, rules, rules, symbols):
            part.append(np.frombuffer(blob, "<u4", k, at))
            at += 4 * k
        self.left, self.right, self.length, self.seq = part
        self.edge = np.frombuffer(blob, "<u8", n + 1, at).astype(np.int64)
        size = np.concatenate([np.ones(self.terminals, np.int64), self.length])
        self.upto = np.concatenate([[0], np.cumsum(size[self.seq])])

    def __len__(self) -> int:
        return len(self.edge) - 1

    def read(self, a: int, z: int) -> np.ndarray:
        """Ids of the documents a to z - 1, end to end."""
        start, end = self.edge[a], self.edge[z]
        i = np.searchsorted(self.upto, start, side="right") - 1
        j = np.searchsorted(self.upto, end, side="left")
        got = expand(self.seq[i:j], self.left, self.right, self.terminals)
        return got[start - self.upto[i] : end - self.upto[i]]


# --- shards ---


def _knots(docs: DataFrame, shards: int) -> list[int]:
    """Quantiles of doc_id, first and last included; a few numbers, from the id column alone."""
    m = min(shards, KNOTS)
    return docs.agg(F.percentile_approx("doc_id", [i / m for i in range(m + 1)], 10 * m)).first()[0] or []


def _shard_of(knots: list[int], shards: int):
    """doc_ids to shards, never falling: straight lines between the knots. Without a doc_id: shard 0."""
    x, first = np.unique(np.array(knots, np.float64), return_index=True)
    y = first / max(len(knots) - 1, 1)

    def of(doc_id: pa.Array) -> np.ndarray:
        if not len(x):
            return np.zeros(len(doc_id), np.int32)
        share = np.interp(doc_id.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False).astype(np.float64), x, y)
        return np.minimum((share * shards).astype(np.int32), shards - 1)

    return of


def write_shards(docs: DataFrame, path: str | None = None, folder: str | None = None, shards: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Write all documents' ids as shard files. Returns (the files, an index: shard, part, doc_ids, per document)."""
    path, folder = path or default_path(), folder or shared_dir(docs.sparkSession)
    rows = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first() if shards is None else None
    shards = shards or max(1, min(int((rows[1] or 0) // SHARD_BYTES) + 1, max(rows[0], 1)))
    of = _shard_of(_knots(docs, shards), shards)
    encoded = encode(docs.select("doc_id", "text"), path, ["doc_id"], of)
    tasks = min(shards, MAX_TASKS)
    # a range of shards for each task, and so of doc_ids
    ordered = encoded.repartitionById(tasks, F.expr(f"cast(shard * {tasks}L div {shards} as int)")).sortWithinPartitions("shard", "doc_id", "ids")

    @tv.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, ids, docs_, held = None, 0, [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal part, ids, docs_, held
            if docs_:
                sizes = np.concatenate([d[1] for d in docs_])
                edge = np.concatenate([[0], np.cumsum(sizes)])
                blob = write(np.concatenate(ids), edge)
                doc_ids = pa.concat_arrays([d[0] for d in docs_])
                lists = pa.ListArray.from_arrays(pa.array(np.array([0, len(doc_ids)], np.int32)), doc_ids)
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([part], pa.int32()), pa.array([len(doc_ids)], pa.int64()), pa.array([int(edge[-1])], pa.int64()), lists, pa.array([blob], pa.binary())], names=["shard", "part", "docs", "ids", "doc_ids", "blob"])
            part, ids, docs_, held = part + 1, [], [], 0

        for rb in batches:
            b = tv.from_arrow(rb.column("ids"))
            shard_of = rb.column("shard").to_numpy()
            flat = b.buf.view("<u2") if len(b.buf) else np.zeros(0, "<u2")
            edge = b.offs // 2
            # cut where the shard changes, and about every PART_IDS ids
            a = 0
            while a < rb.num_rows:
                if shard_of[a] != now:
                    yield from flush()
                    now, part = int(shard_of[a]), 0
                z = int(np.searchsorted(shard_of, now, side="right"))
                z = min(z, max(a + 1, int(np.searchsorted(edge, edge[a] + PART_IDS - held, side="right")) - 1))
                ids.append(flat[edge[a] : edge[z]].copy())
                docs_.append((rb.column("doc_id").slice(a, z - a).cast(pa.int64()), np.diff(edge[a : z + 1])))
                held += int(edge[z] - edge[a])
                if held >= PART_IDS:
                    yield from flush()
                a = z
        yield from flush()

    with arrow_rows(docs.sparkSession, 1000):
        ordered.mapInArrow(run, "shard int, part int, docs long, ids long, doc_ids array<long>, blob binary").write.options(**PAGES).parquet(folder)
    files = docs.sparkSession.read.parquet(folder)
    return files, files.select("shard", "part", "docs", "ids")


def read_shards(files: DataFrame) -> DataFrame:
    """doc_id, start (in all shards), n_tokens and ids_crc32 of every document, from the written files."""
    # one row for each part; prefix sums of groups of shards first, then within each group
    parts = files.select((F.col("shard") / GROUP).cast("int").alias("_g"), "shard", "part", "ids")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    groups = parts.groupBy("_g").agg(F.sum("ids").alias("ids")).select("_g", F.coalesce(F.sum("ids").over(before.orderBy("_g")), F.lit(0)).alias("_base"))
    own = F.coalesce(F.sum("ids").over(before.partitionBy("_g").orderBy("shard", "part")), F.lit(0))
    starts = parts.withColumn("_own", own).join(F.broadcast(groups), "_g").select("shard", "part", (F.col("_base") + F.col("_own")).alias("base"))

    @tv.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for k in range(rb.num_rows):
                r = Reader(rb.column("blob")[k].as_py())
                raw = memoryview(r.read(0, len(r)).astype("<u4").tobytes())
                edge = r.edge
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(edge[:-1].tolist(), edge[1:].tolist())]
                doc_ids = rb.column("doc_ids").slice(k, 1).flatten()
                n = len(r)
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(np.full(n, rb.column("shard")[k].as_py(), np.int32)), pa.array(np.full(n, rb.column("part")[k].as_py(), np.int32)), pa.array(edge[:-1]), pa.array(np.diff(edge)), pa.array(crc, pa.int64())], names=["doc_id", "shard", "part", "at", "n_tokens", "ids_crc32"])

    with arrow_rows(files.sparkSession, 8):  # files are large rows
        got = stored(files.select("shard", "part", "doc_ids", "blob").mapInArrow(run, "doc_id long, shard int, part int, at long, n_tokens long, ids_crc32 long"))
    return got.join(starts, ["shard", "part"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
