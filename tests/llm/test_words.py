"""Words and texts that are hard to tell apart, very long words, and columns that clash, against plain versions."""

import hashlib
import json
import random
import zlib

import numpy as np
import pytest

from lodestream.llm import bpe, gif, mixing, outliers, ranking, repair, setjoin, unigram
from lodestream.llm import textvec as tv


def thue_morse(n):
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


A, B = thue_morse(10)
C, D = thue_morse(12)
PAIRS = [(1, A), (2, B), (3, C), (4, D), (5, f"{A} {B} {A} {B} {A}"), (6, f"{B} {A} {B} {A} {B}"), (7, f"{A}\n{B}\n{A}"), (8, " ".join([A, B, C, D] * 20))]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in PAIRS], "doc_id long, text string, lang string, source string")


def test_hash_tells_patterns_apart_and_bytes_decide():
    words = [w.encode() for w in (A, B, C, D, A[:9], B[:9], "", "a", "\0a")] + [bytes(k) for k in range(1, 40)]
    buf, end = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    start = end - np.array([len(w) for w in words])
    assert len(set(tv.span_hash(buf, start, end).tolist())) == len(words)


def test_words_that_share_a_hash(monkeypatch):
    rng = random.Random(2)
    words = [bytes(rng.choices(b"xyz", k=rng.randint(0, 30))) for _ in range(2000)]
    buf, end = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    start = end - np.array([len(w) for w in words])
    true = tv.span_hash
    monkeypatch.setattr(tv, "span_hash", lambda b, s, e: true(b, s, e) % np.uint64(5))
    h, first, where = tv.distinct_spans(buf, start, end)
    assert len(h) == len(first) == len(set(words)) and all(words[first[k]] == w for k, w in zip(where, words))


def test_bpe_and_token_files(pairs):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = bpe.default_path()
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(path), special_tokens={})
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(pairs).collect()}
    for i, t in PAIRS:
        ids = enc.encode(t)
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    lib = Tokenizer.from_file(repair.default_path())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in repair.read_shards(repair.write_shards(pairs, shards=3)[0]).collect()}
    for i, t in PAIRS:
        ids = [*lib.encode(t, add_special_tokens=False).ids, repair.END_ID]
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_long_words_in_blocks(spark):
    import public_tokenizers
    import tiktoken

    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(bpe.default_path()), special_tokens={})
    r = random.Random(4)
    words = ["".join(r.choices(letters, k=n)) for letters, n in (("abcdefghijklmnopqrstuvwxyz", 2000), ("etaoin", 257), ("a", 1500), ("äöü", 400), ("0123456789abcdef", 900), ("\n", 600))]
    rows = [(i, w) for i, w in enumerate(words)]
    got = {x["doc_id"]: x["ids"] for x in bpe.encode(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: enc.encode(w) for i, w in rows}


def test_rules_and_links(pairs):
    stats = {r["doc_id"]: (r["n_dup_lines"], r["n_repeat_words"]) for r in outliers.annotate(pairs, ["doc_id"]).collect()}
    assert stats[7] == (1, 0) and stats[5] == (0, 5) and stats[8] == (0, 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in setjoin.join(pairs).collect()}
    assert {i: c for i, (_, c) in got.items()} == {i: i for i, _ in PAIRS} and got[8][0] == 4


def test_columns_that_clash_keep_their_values(spark):
    names = ["size", "source_size", "target", "copies", "taken", "n_words", "kept", "distance2", "level", "base_failed", "f_upper", "score", "predicted", "_m_size", "_keys", "_group"]
    rng = random.Random(1)
    text = lambda k: " ".join(f"word{rng.randint(0, 400)}x" for _ in range(60 + k % 7))
    rows = [(k, text(k), "en", "ab"[k % 2], *(f"{n}{k}" for n in names)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    for out in (mixing.emit(docs), outliers.keep(docs), ranking.keep(docs, labels), setjoin.keep_one(docs)):
        got = out.collect()
        assert out.columns == docs.columns and got and all(tuple(r) == rows[r["doc_id"]] for r in got)


def test_counts_equal_the_library_on_random_vocabularies():
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    rng = random.Random(9)
    cases = [([("dddc", -3), ("ccb", -6), ("d", -1), ("aac", -4), ("cbca", -4), ("ab", -6), ("b", -2), ("dacc", -6), ("dc", -1)], ["ddddcdacc"])]
    for _ in range(400):
        pieces = {"".join(rng.choices("abcd", k=rng.randint(1, 4))): float(-rng.randint(1, 6)) for _ in range(rng.randint(2, 10))}
        cases.append((list(pieces.items()), ["".join(rng.choices("abcd", k=rng.randint(1, 12))) for _ in range(50)]))
    for pieces, words in cases:
        lib = Tokenizer(Unigram([("<unk>", 0.0), *pieces], unk_id=0, byte_fallback=False))
        own = unigram.Counter([(p, float(s)) for p, s in pieces])
        vocabulary = {p for p, _ in pieces}
        for w in words:
            # an unknown stretch is one piece there, and one for each byte here
            want = sum(1 if t in vocabulary else len(t) for t in lib.encode(w, add_special_tokens=False).tokens)
            assert own.word(w) == want, (pieces, w)


@pytest.mark.parametrize("seed", range(6))
def test_no_frequent_pair_is_left(seed):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, int(rng.integers(2, 12)), 4000).astype(np.uint16)
    if seed % 2:
        ids = np.tile(ids[:200], 30)
    left, right, length, seq = repair.compress(ids)
    assert (repair.expand(seq, left, right) == ids).all() and len(seq) < len(ids)
    count, last = {}, {}
    for i, p in enumerate(zip(seq[:-1].tolist(), seq[1:].tolist())):
        if last.get(p, -2) < i - 1:
            count[p], last[p] = count.get(p, 0) + 1, i
    assert max(count.values(), default=0) < repair.LEAST
    for k in range(len(left)):
        assert length[k] == len(repair.expand(np.array([repair.TERMINALS + k], np.uint32), left, right))


def test_a_passage_five_hundred_times_collapses():
    ids = np.tile(np.random.default_rng(1).integers(0, 50000, 1000).astype(np.uint16), 500)
    left, right, length, seq = repair.compress(ids)
    assert (repair.expand(seq, left, right) == ids).all() and len(seq) + 3 * len(left) < len(ids) / 50 and length.max() > 1000


def test_shards_are_ranges_of_ids():
    import pyarrow as pa

    for knots, shards in (([1, 5, 5, 9, 1000], 7), ([3], 4), ([], 2), ([-5, 2**40], 100)):
        of = repair._shard_of(knots, shards)
        ids = sorted({*knots, *(random.Random(3).sample(range(-10, 2000), 300))})
        got = of(pa.array([None, *ids], pa.int64()))
        assert got[0] == 0 and (np.diff(got) >= 0).all() and got.min() >= 0 and got.max() < shards


def test_gif_streams_of_whole_texts():
    rng = random.Random(8)
    for n, letters in ((1, b"x"), (64, b"ab"), (70_000, bytes(range(256))), (300_000, b"abcdefgh"), (9000, b"a")):
        payload = gif.payload_of(bytes(rng.choices(letters, k=n)))
        raw = gif.write(payload)
        got = list(gif.frames(raw, compose=False))
        assert b"".join(f.indices.tobytes() for f in got) == payload and len(got) == -(-len(payload) // (64 * gif.FRAME_ROWS))
        whole = list(gif.frames(raw))
        # a shorter last frame stands alone on a cleared canvas
        assert all((f.canvas[: len(f.indices), :, 0] == f.indices).all() and not f.canvas[len(f.indices) :].any() for f in whole)
        assert all((gif.histogram(f) == gif.histogram(w)).all() for f, w in zip(got, whole))
    with pytest.raises(ValueError, match="canvas"):
        list(gif.frames(b"GIF89a" + bytes([255, 255, 255, 255, 0, 0, 0])))


def test_rank_map_is_short_and_whole(spark, monkeypatch):
    """The literals hold every entry of the pair table, and free places take one digit; place 0, where key 0 looks, keeps its mark."""
    texts, lit = [], bpe.F.lit
    monkeypatch.setattr(bpe.F, "lit", lambda x: (texts.append(x), lit(x))[1])
    bpe.rank_map(bpe.default_path())
    texts = [t for t in texts if isinstance(t, str) and t.startswith("[")]
    assert len(texts) == 3 and sum(map(len, texts)) < 2_000_000
    for text, table in zip(sorted(texts, key=len)[1:], sorted(bpe.pair_table(bpe.default_path()), key=lambda t: (t != bpe.FREE).sum()), strict=True):
        values = np.array(json.loads(text))
        assert values[0] == table[0] and ((values == table) | ((values == 0) & (table == bpe.FREE))).all()
