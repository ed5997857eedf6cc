"""N-gram Jaccard join with set-relation skipping: exact links and components of similar documents.

A document is the set of hashes of its five-word shingles. Sets are put in one global order (tokens
that many documents share come last, by count), so two sets that are similar enough share a token
among the first ``n - ceil(0.8 n) + 1`` of each; only these prefixes are indexed.

Two relations between sets save work:

* Index level: each token's list is sorted by set size and cut into blocks. A block knows its least
  and greatest size, its least position and its component if it has only one; pairs of blocks whose
  sizes or positions rule a link out, or that are already known to be one component, are skipped whole.
  Pairs found in the rest are counted: similar sets share a known least number of prefix tokens.
* Answer level: each set is first compared only with a few neighbours in the list and with its block's
  leader, which are the sets most like it. What these comparisons answer is carried over to the whole
  component: later rounds look only for partners in other components. In the next ones, each set is
  compared with the hubs of its lists, two well linked sets of the ``HUBS`` largest components there, since most
  of a group's sets that stay out at first link with its middle. The last round compares every pair of
  different components in the remaining blocks, so no link between components is lost. All but the last take
  comparisons in proportion to a group's size; in the last, only sets that link with no hub are compared with
  all others.

Copies (equal sets) are collapsed to one representative before pairs are made. Components come from
alternating star contractions in Spark; nothing about single documents reaches the driver. The
broadcasts are the list of shared tokens, at most ``MAX_HEAVY`` of them (the order may be any order, so
the bound can cost time and never a link), and a map of ``MARKS`` bits that spares most texts a shuffle.

Defined results: a null text, or one without words, has an empty set and is linked with nothing; with
fewer than five words the whole sequence is the one shingle; repeated rows are copies of each other;
rows that share a doc_id but not the text count as one document with the links of each; rows without a doc_id
belong to the component of their copies, else to none (null); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import most_frequent, settle, stored
from . import textvec as tv

SHINGLE, NUM, DEN = 5, 4, 5  # five words, Jaccard of 4/5 or more
HEAVY_FROM, MAX_HEAVY, BLOCK, LARGE = 8, 1 << 20, 256, 64
NEIGHBOURS = (1, 2, 3, 5, 8)
HUBS, ROUNDS = 4, 2  # components of a list whose best linked sets are tried, and how often; the last round misses no link
FEW = 5  # comparisons that say little about a set
MARKS, MAP_BITS = 1 << 25, 1 << 15  # bits in all (4 MB), and in one map of Spark's bitmap functions


class Sets(NamedTuple):
    tokens: np.ndarray  # sorted and distinct within each text
    edge: np.ndarray  # where each text's tokens begin; len = texts + 1


def lowered(b: tv.Batch) -> tv.Batch:
    up = (b.buf >= 65) & (b.buf <= 90)
    return tv.Batch(np.where(up, b.buf + 32, b.buf).astype(np.uint8), b.offs)


def shingle_sets(b: tv.Batch, size: int = SHINGLE) -> Sets:
    n = len(b.offs) - 1
    b = lowered(b)
    w = tv.words(b)
    h = tv.span_hash(b.buf, w.start, w.end)
    g, at = tv.ngram_hash(h, w.doc, size)
    doc = w.doc[at]
    edge = np.searchsorted(doc, np.arange(n + 1))
    first = np.searchsorted(w.doc, np.arange(n + 1))
    parts, sizes = [], np.zeros(n, np.int64)
    for i in range(n):
        t = g[edge[i] : edge[i + 1]]
        if not len(t):
            k = first[i + 1] - first[i]
            if not k:
                continue
            # fewer words than a shingle: the whole sequence, told apart by its length
            t = tv.ngram_hash(h[first[i] : first[i + 1]], np.zeros(k, np.int64), int(k))[0] ^ np.uint64(int(k) << 8)
        t = np.sort(t)
        t = t[np.append(True, t[1:] != t[:-1])]
        parts.append(t)
        sizes[i] = len(t)
    return Sets(np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)]))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


SURVEYED = 1 << 21  # tokens that a task counts at once


@tv.lean
def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (size and two hashes of its set), and one for each token of two or more of some neighbouring documents."""
    names = ["doc_id", "n", "h1", "h2", "token", "c"]
    none = lambda m: pa.nulls(m, pa.int64())
    seen, held = [], 0

    def shared() -> pa.RecordBatch:
        t = np.concatenate(seen)
        t.sort()
        first = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, np.int64)
        c = np.diff(np.append(first, len(t)))
        t, c = t[first[c > 1]], c[c > 1]
        return pa.RecordBatch.from_arrays([none(len(t))] * 4 + [_signed(t), pa.array(c.astype(np.int64))], names=names)

    for part in tv.slices(batches):
        s = shingle_sets(tv.from_arrow(part.column("text")))
        n = np.diff(s.edge)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tv.mix(s.tokens))])
        other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tv.mix(s.tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)))])
        h1, h2 = (total[s.edge[1:]] - total[s.edge[:-1]]), (other[s.edge[1:]] - other[s.edge[:-1]])
        yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n), _signed(h1), _signed(h2), none(len(n)), none(len(n))], names=names)
        seen.append(s.tokens)
        held += len(s.tokens)
        if held > SURVEYED:
            yield shared()
            seen, held = [], 0
    if seen:
        yield shared()


def _prefixes(heavy: np.ndarray, rank: np.ndarray):
    """Postings of each document's prefix in the global order: light tokens by hash, then heavy ones by rank."""

    @tv.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in tv.slices(batches):
            s = shingle_sets(tv.from_arrow(rb.column("text")))
            key = np.zeros(len(s.tokens), np.int64)
            if len(heavy):
                at = np.minimum(np.searchsorted(heavy, s.tokens), len(heavy) - 1)
                key = np.where(heavy[at] == s.tokens, rank[at] + 1, 0)
            n = np.diff(s.edge)
            take = np.where(n > 0, n - (NUM * n + DEN - 1) // DEN + 1, 0)
            chosen = []
            for a, z, p in zip(s.edge[:-1], s.edge[1:], take):
                if p:
                    k = key[a:z]
                    chosen.append(a + (np.argsort(k, kind="stable")[:p] if k.any() else np.arange(p)))
            chosen = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
            pos = np.arange(len(chosen)) - np.repeat(np.concatenate([[0], np.cumsum(take)[:-1]]), take)
            doc = rb.column("doc_id").cast(pa.int64()).take(pa.array(np.repeat(np.arange(len(n)), take)))
            yield pa.RecordBatch.from_arrays([_signed(s.tokens[chosen]), doc, pa.array(np.repeat(n, take).astype(np.int32)), pa.array(pos.astype(np.int32))], names=["token", "doc_id", "n", "pos"])

    return run


@tv.lean
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in tv.slices(batches):
        s = shingle_sets(tv.from_arrow(rb.column("text")))
        tokens = pa.ListArray.from_arrays(pa.array(s.edge.astype(np.int32)), _signed(s.tokens))
        yield pa.RecordBatch.from_arrays([rb.column("doc_id").cast(pa.int64()), tokens], names=["sid", "tokens"])


def _need(na, nb):
    """The least intersection of two similar sets of these sizes."""
    return F.ceil(NUM * (na + nb) / (NUM + DEN))


def _possible(na, nb, i, j):
    """Size and position bounds for a pair that shares a token at positions i and j.

    What stands before it in the longer front, and not in the shorter one, is missing in the other set.
    """
    least, most = F.least(na, nb), F.greatest(na, nb)
    return (DEN * least >= NUM * most) & (j - i <= nb - _need(na, nb)) & (i - j <= na - _need(na, nb))


def _least_shared(na, nb):
    """How many tokens the indexed prefixes of two similar sets share at least."""
    prefix = lambda n: n - F.ceil(NUM * n / DEN) + 1
    return F.least(prefix(na) - na, prefix(nb) - nb) + _need(na, nb)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, by the exact size of the intersection."""
    a = sets.select(F.col("sid").alias("a"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("sid").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.select("a", "b").join(a, "a").join(b, "b")
    inter = F.size(F.array_intersect("ta", "tb"))
    union = F.size("ta") + F.size("tb") - inter
    return both.where(100 * inter >= 80 * union).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): the root is the least node reachable."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        edges = stored(small.where("u > v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _several(lists: DataFrame, links: DataFrame) -> DataFrame:
    """The lists with sets of several components: token, sid, n, pos, and each set's component and how many members it has."""
    comp = components(links)
    sizes = comp.groupBy("root").agg((F.count("*") + 1).alias("members"))
    named = comp.join(sizes, "root").select(F.col("node").alias("sid"), "root", "members").unionByName(sizes.select(F.col("root").alias("sid"), "root", "members"))
    marked = lists.join(named, "sid", "left").select("token", "sid", "n", "pos", F.coalesce("root", "sid").alias("comp"), F.coalesce("members", F.lit(1)).alias("members"))
    both = Window.partitionBy("token")
    return marked.withColumn("lo", F.min("comp").over(both)).withColumn("hi", F.max("comp").over(both)).where("lo < hi").drop("lo", "hi")


def _hubs(lists: DataFrame, links: DataFrame, seen: DataFrame) -> DataFrame:
    """(sid, n, pos, o: sid, n, pos) for each set and the best linked sets of the largest components of its list, if larger than its own.

    Two of each component: that with most links, and that with most of the pairs (seen) that it was compared in. Leaders of
    blocks are compared often and have many links without being in the middle of their component.
    """
    ends = links.select("a", "b", F.lit(1).alias("hit")).unionByName(seen.select("a", "b", F.lit(0).alias("hit")))
    known = ends.select(F.explode(F.array("a", "b")).alias("sid"), "hit").groupBy("sid").agg(F.sum("hit").alias("degree"), F.sum(1 - F.col("hit")).alias("tried"))
    linked = known.where("degree > 0").select("sid", "degree", (F.col("degree") / (F.col("tried") + FEW)).alias("share"))
    own = F.struct("sid", "n", "pos")
    best = [F.max(F.struct(c, own.alias("o"))).alias(c) for c in ("degree", "share")]
    largest = Window.partitionBy("token").orderBy(F.desc("members"), F.desc("comp"))
    hubs = lists.join(linked, "sid").groupBy("token", "comp", "members").agg(*best).withColumn("r", F.row_number().over(largest)).where(F.col("r") <= HUBS)
    hubs = hubs.select("token", F.struct("members", "comp").alias("rank"), F.explode(F.array_distinct(F.array("degree.o", "share.o"))).alias("o"))
    return lists.join(hubs, "token").where(F.struct("members", "comp") < F.col("rank")).select("sid", "n", "pos", "o")


def _blocks(lists: DataFrame) -> DataFrame:
    """lists (token, sid, n, pos, comp, members) as blocks of at most BLOCK neighbours in size, with their bounds.

    Sets of a large component stand apart, so that whole blocks of it are known to be answered.
    """
    order = Window.partitionBy("token").orderBy(F.when(F.col("members") >= LARGE, F.col("comp")), "n", "pos", "sid")
    numbered = lists.withColumn("block", F.floor((F.row_number().over(order) - 1) / BLOCK))
    bounds = [f(c).alias(f"{c}_{k}") for c in ("n", "pos", "comp") for k, f in (("lo", F.min), ("hi", F.max))]
    return numbered.groupBy("token", "block").agg(*bounds, F.collect_list(F.struct("sid", "n", "pos", "comp", "members")).alias("rows"))


def _across(lists: DataFrame) -> DataFrame:
    """All pairs (a, b) of different components that may be similar, found block by block.

    A pair belongs to the set of the smaller component, and each set's partners are counted in one
    place: a pair that shares fewer prefix tokens than similar sets must is left out.
    """
    blocks = _blocks(lists)
    x = blocks.select("token", *(F.col(c).alias(f"x_{c}") for c in blocks.columns if c != "token"))
    y = blocks.select("token", *(F.col(c).alias(f"y_{c}") for c in blocks.columns if c != "token"))
    one = (F.col("x_comp_lo") == F.col("x_comp_hi")) & (F.col("y_comp_lo") == F.col("y_comp_hi")) & (F.col("x_comp_lo") == F.col("y_comp_lo"))
    least = F.least("x_n_lo", "y_n_lo")
    sizes = DEN * F.least("x_n_hi", "y_n_hi") >= NUM * F.greatest("x_n_lo", "y_n_lo")
    need = _need(least, least)
    positions = (F.col("y_pos_lo") - F.col("x_pos_hi") <= F.col("y_n_hi") - need) & (F.col("x_pos_lo") - F.col("y_pos_hi") <= F.col("x_n_hi") - need)
    met = x.join(y, "token").where((F.col("x_block") <= F.col("y_block")) & sizes & positions & ~one)
    # the block pairs of long lists are dealt out again, so that no list's work falls on one task
    met = met.where("y_block = 0").unionByName(met.where("y_block > 0").repartition("token", "x_block", "y_block"))

    def partners(own: str, others: str):
        def of(p):
            mine = lambda q: (p["comp"] != q["comp"]) & (F.struct(p["members"], p["comp"]) < F.struct(q["members"], q["comp"])) & _possible(p["n"], q["n"], p["pos"], q["pos"])
            ids = F.transform(F.filter(F.col(others), mine), lambda q: F.struct(q["sid"].alias("sid"), q["n"].alias("n")))
            return F.struct(p["sid"].alias("sid"), p["n"].alias("n"), ids.alias("ids"))

        return F.filter(F.transform(F.col(own), of), lambda r: F.size(r["ids"]) > 0)

    both = F.concat(partners("x_rows", "y_rows"), F.when(F.col("x_block") < F.col("y_block"), partners("y_rows", "x_rows")).otherwise(F.expr("slice(transform(x_rows, p -> struct(p.sid AS sid, p.n AS n, array(struct(p.sid AS sid, p.n AS n)) AS ids)), 1, 0)")))
    rows = met.select(F.explode(both).alias("e")).select("e.sid", "e.n", F.col("e.ids.sid").alias("others"), F.col("e.ids.n").alias("sizes"))
    return rows.repartition("sid").sortWithinPartitions("sid").mapInArrow(_count_partners, "a long, b long")


@tv.lean
def _count_partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sid, n, others, sizes) in order of sid: the others that come often enough. Counts are merged now and
    then, so a set's state is as long as its list of different partners."""
    now, n, held, parts = None, 0, 0, []

    def merged():
        ids, sizes, counts = (np.concatenate([p[i] for p in parts]) for i in range(3))
        u, first, where = np.unique(ids, return_index=True, return_inverse=True)
        return u, sizes[first], np.bincount(where, weights=counts, minlength=len(u)).astype(np.int64)

    def done() -> Iterator[pa.RecordBatch]:
        if parts:
            u, m, c = merged()
            prefix = lambda k: k - (NUM * k + DEN - 1) // DEN + 1
            need = -(-NUM * (n + m) // (NUM + DEN))
            u = u[c >= np.minimum(prefix(n) - n, prefix(m) - m) + need]
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, now)), pa.array(np.maximum(u, now))], names=["a", "b"])

    for rb in batches:
        sid, size = rb.column("sid").to_numpy(), rb.column("n").to_numpy()
        others, sizes = rb.column("others"), rb.column("sizes")
        edge = np.concatenate([[0], np.cumsum(others.value_lengths().to_numpy())])
        flat, flat_n = others.flatten().to_numpy(), sizes.flatten().to_numpy().astype(np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(sid[1:] != sid[:-1]) + 1, [len(sid)]]) if len(sid) else np.zeros(1, np.int64)
        for a, z in zip(cuts[:-1], cuts[1:]):
            if sid[a] != now:
                yield from done()
                now, n, held, parts = int(sid[a]), int(size[a]), 0, []
            part = slice(edge[a], edge[z])
            parts.append((flat[part], flat_n[part], np.ones(edge[z] - edge[a], np.int64)))
            held += int(edge[z] - edge[a])
            if held > 1 << 21:
                parts = [merged()]
                held = len(parts[0][0])
    yield from done()


def _counted(near: DataFrame, part: int) -> DataFrame:
    """Distinct pairs (a, b) of near (sid, n, pos, o: sid, n, pos) that come at least as often as similar sets share prefix
    tokens, or a ``part`` of that."""
    pairs = near.where("o IS NOT NULL AND o.sid <> sid").where(_possible(F.col("n"), F.col("o.n"), F.col("pos"), F.col("o.pos")))
    sides = [F.when(F.col("sid") < F.col("o.sid"), F.col(x)).otherwise(F.col(y)).alias(k) for x, y, k in (("sid", "o.sid", "a"), ("o.sid", "sid", "b"), ("n", "o.n", "na"), ("o.n", "n", "nb"))]
    n = pairs.select(*sides).groupBy("a", "b").agg(F.count("*").alias("c"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    return n.where(part * F.col("c") >= _least_shared(F.col("na"), F.col("nb"))).select("a", "b")


def link(docs: DataFrame, heavy_from: int = HEAVY_FROM, max_heavy: int = MAX_HEAVY) -> tuple[DataFrame, DataFrame]:
    """(docs: doc_id, n_shingles, sid; links: a, b between representatives). sid is the least doc_id with an equal set."""
    source = docs.select("doc_id", "text")
    survey = stored(source.mapInArrow(_survey, "doc_id long, n long, h1 long, h2 long, token long, c long"))
    narrow = survey.where("token IS NULL").select("doc_id", "n", "h1", "h2")
    heavy = survey.where("token IS NOT NULL").groupBy("token").agg(F.sum("c").alias("c")).where(F.col("c") >= heavy_from)
    top = most_frequent(stored(heavy), "c", max_heavy).toPandas()  # at most max_heavy rows of 16 bytes
    top = top.sort_values(["c", "token"])
    hashes, rank = top.token.to_numpy(np.int64).view(np.uint64), np.arange(len(top), dtype=np.int32)
    order = np.argsort(hashes)
    shared = docs.sparkSession.sparkContext.broadcast((hashes[order], rank[order]))
    del top, hashes, rank
    settle(docs.sparkSession)
    tv.give_back()
    reps = stored(narrow.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("sid"), F.count("*").alias("rows")))
    copies = narrow.join(reps.where("rows > 1"), ["n", "h1", "h2"]).where("doc_id <> sid").select("doc_id", "sid")

    def prefixes(batches):
        yield from _prefixes(*shared.value)(batches)

    postings = source.where(F.col("doc_id").isNotNull()).mapInArrow(prefixes, "token long, doc_id long, n int, pos int")
    both = Window.partitionBy("token")
    found = stored(postings.withColumn("k", F.count("*").over(both)).where("k > 1").drop("k"))
    shared.destroy()
    # copies give way to their representative
    lists = found.join(copies, "doc_id", "left").select("token", F.coalesce("sid", "doc_id").alias("sid"), "n", "pos").distinct()
    lists = stored(lists.withColumn("k", F.count("*").over(both)).where("k > 1").drop("k"))

    # the same order of sets in every list, so that neighbours are neighbours in many lists
    order = Window.partitionBy("token").orderBy("n", "sid")
    own = F.struct("sid", "n", "pos")
    numbered = lists.withColumn("r", F.row_number().over(order) - 1)
    first = F.first(own).over(Window.partitionBy("token", F.floor(F.col("r") / BLOCK)).orderBy("n", "sid"))
    near = numbered.withColumn("near", F.array(first, *(F.lag(own, k).over(order) for k in NEIGHBOURS))).withColumn("o", F.explode("near"))
    # neighbours in half of the lists that similar sets share are worth a look, and so are hubs; the last round misses none
    seen = stored(_counted(near, 2))
    links = stored(_verified(seen, _needed(source, seen)))
    several = stored(_several(lists, links))
    for _ in range(ROUNDS):
        pairs = stored(_counted(_hubs(several, links, seen), 2).join(seen, ["a", "b"], "left_anti"))
        found = stored(_verified(pairs, _needed(source, pairs)))
        seen = seen.unionByName(pairs)
        if found.isEmpty():
            break
        links = links.unionByName(found)
        several = stored(_several(several.select("token", "sid", "n", "pos"), links))
    rest = stored(_across(several).join(seen, ["a", "b"], "left_anti"))
    links = links.unionByName(_verified(rest, _needed(source, rest)))
    members = narrow.join(reps.select("n", "h1", "h2", F.col("sid").alias("_s")), ["n", "h1", "h2"]).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("_s")).otherwise(F.col("doc_id")).alias("sid"))
    return members, stored(links)


def _needed(source: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sid, tokens) of the documents in pairs.

    Most texts are in no pair. A map of ``MARKS`` bits, broadcast whole, tells them by their id's hash before
    texts are shuffled; ids that share a bit only cost that, since the join with ``ids`` afterwards is exact.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS))
    bucket, bit = F.floor(hashed / MAP_BITS).alias("_bucket"), F.pmod(hashed, F.lit(MAP_BITS)).cast("int").alias("_bit")
    marks = ids.select(bucket, bit).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_bit") / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    marked = byte.bitwiseAND(F.expr("shiftleft(1, _bit % 8)")) > 0
    likely = source.select("doc_id", "text", bucket, bit).join(F.broadcast(marks), "_bucket").where(marked)
    found = likely.select("doc_id", "text").join(ids, "doc_id")  # a semi-join would be moved below the map's
    return stored(found.mapInArrow(_sets, "sid long, tokens array<long>"))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    members, links = link(docs)
    comp = components(links).select(F.col("node").alias("sid"), "root")
    return members.join(comp, "sid", "left").select("doc_id", "n_shingles", F.coalesce("root", "sid").alias("component_id"))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with ``_key``: the doc_id, or a number of its own beyond all of them for each row that has none or shares it
    with another text. Such rows are stored, so that their numbers stay."""
    h = F.xxhash64("text")
    odd = stored(docs.groupBy("doc_id").agg(F.min(h).alias("_lo"), F.max(h).alias("_hi")).where("doc_id IS NULL OR _lo <> _hi").select("doc_id"))
    if odd.isEmpty():
        return docs.withColumn("_key", F.col("doc_id").cast("long"))
    top = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0)).cast("long")).first()[0]
    shared = odd.where("doc_id IS NOT NULL")
    few = docs.where("doc_id IS NULL").unionByName(docs.join(shared, "doc_id", "left_semi").select(*docs.columns))
    rest = docs.where("doc_id IS NOT NULL").join(shared, "doc_id", "left_anti").select(*docs.columns)
    return rest.withColumn("_key", F.col("doc_id").cast("long")).unionByName(stored(few.withColumn("_key", F.lit(top + 1) + F.monotonically_increasing_id())))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row for each component, with its columns as they are: that of the least doc_id; a row without a doc_id stays only if
    no linked one has one. Rows without words are all kept, but for repetitions of a doc_id and its text."""
    safe, back = tv.guarded(docs, ("doc_id", "text"))
    keyed = _keyed(safe)
    got = join(keyed.select(F.col("_key").alias("doc_id"), "text"))
    dropped = got.where("component_id < doc_id").select(F.col("doc_id").alias("_key")).distinct()
    ordered = [c for c in safe.columns if c != "text" and not isinstance(safe.schema[c].dataType, (T.MapType, T.VariantType))]
    first = Window.partitionBy("_key").orderBy(*ordered)
    return keyed.join(dropped, "_key", "left_anti").withColumn("_r", F.row_number().over(first)).where("_r = 1").select(*back)
