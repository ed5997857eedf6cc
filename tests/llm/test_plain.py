"""Rules, ranking, rows kept and the pipeline against plain versions on the smallest tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.llm import bpe, mixing, outliers, ranking, setjoin

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}


def base(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    three = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {i + k for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for k in range(3)}
    n = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)
    return *n, n[0] < 50 or 100 * n[4] > 50 * n[0]


def test_base_columns(documents, texts):
    got = {r["doc_id"]: tuple(r[c] for c in [*outliers.BASE, "base_failed"]) for r in outliers.rules(documents).collect()}
    assert got == {i: base(t) for i, t in texts.items()}


def test_distances_are_those_of_the_estimate(documents):
    stats = outliers.annotate(documents, ["doc_id", "lang", "source"]).where(~outliers._failed())
    params = {r["_key"]: r for r in outliers.fit(stats).collect()}
    rows = {r["doc_id"]: r for r in stats.collect()}
    seen = collections.Counter()
    for r in outliers.rules(documents).where("NOT base_failed").collect():
        s = rows[r["doc_id"]]
        text = lambda c: "~" if c is None else "=" + c
        lang, source = text(s["lang"]), text(s["source"])
        key = [f"{len(lang)}:{lang}{source}", "L" + lang, "A"][r["level"]]
        assert all(params[k]["rows"] < outliers.SUPPORT * outliers.MIN_ROWS for k in [f"{len(lang)}:{lang}{source}", "L" + lang][: r["level"]] if k in params)
        d = np.array([s[c] for c in outliers.FEATURES]) - np.array(params[key]["centre"])
        d2 = d @ np.array(params[key]["inverse"]).reshape(6, 6) @ d
        assert abs(d2 - r["distance2"]) < 1e-6 * max(1, d2) and r["kept"] == (r["distance2"] <= outliers.CUTOFF)
        seen[r["level"]] += 1
    assert sum(seen.values()) == len(rows)


def test_small_groups_when_asked(documents):
    levels = {r["level"] for r in outliers.rules(documents, min_rows=1).where("NOT base_failed").collect()}
    assert levels == {0}


def test_weights_are_where_the_loss_is_least():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    y = (x @ np.arange(8) + rng.normal(size=400) * 4 > 0).astype(int)
    m = ranking.fit(x, y)
    z = ((x - m.mean) / m.scale).astype(np.float64)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    pairs = np.random.default_rng(7)
    each = ranking.PAIRS_EACH * max(len(good), len(bad))
    d = z[pairs.permutation(np.resize(good, each))] - z[pairs.permutation(np.resize(bad, each))]
    loss = lambda w: np.log1p(np.exp(-d @ w)).sum() + ranking.RIDGE / 2 * w @ w
    least = loss(m.weight)
    for _ in range(200):
        assert loss(m.weight + rng.normal(size=8) * 10 ** rng.uniform(-4, 0)) >= least - 1e-7
    assert np.mean((z @ m.weight >= m.cut) == (y == 1)) > 0.7


def shingles(t):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def least_linked(rows):
    """Ids that are not the least of their component; rows: id to text."""
    sets = {i: shingles(t) for i, t in rows.items()}
    root = {i: i for i in rows}
    find = lambda x: x if root[x] == x else find(root[x])
    ids = sorted(rows)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= 80 * (len(sets[i]) + len(sets[j]) - inter):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in ids if find(i) == i}


def test_rows_without_an_id_of_their_own(spark):
    r = random.Random(6)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(300)]
    p, q, s = (" ".join(r.choices(words, k=40)) for _ in range(3))
    rows = [(1, p, {"k": 1}), (1, q, {"k": 2}), (2, p, {"k": 3}), (None, p, {"k": 4}), (None, s, {"k": 5}), (None, s, {"k": 6}), (None, None, {"k": 7}), (None, None, {"k": 8}), (3, q + " more", {"k": 9}), (4, "", {"k": 10}), (4, "", {"k": 10})]
    got = [(x["doc_id"], x["text"]) for x in setjoin.keep_one(spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>").repartition(4)).collect()]
    # of p the row of doc_id 1 or 2, of q that of 3, as the first 1 has no number that tells it from the second
    assert sum(t == p for _, t in got) == 1 and sum(t in (q, q + " more") for _, t in got) == 1 and sum(t == s for _, t in got) == 1
    assert all(i is not None for i, t in got if t in (p, q, q + " more"))
    assert sum(t is None for _, t in got) == 2 and sum(t == "" for _, t in got) == 1 and len(got) == 6


def test_pipeline_stage_by_stage(spark, documents, texts, tmp_path):
    import public_tokenizers
    import tiktoken

    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    names = list(stages)
    here, kept = documents, set(texts)
    out = {}
    for n in names:
        stages[n](spark, here, SF).write.parquet(f"{tmp_path}/{n}")
        here = out[n] = spark.read.parquet(f"{tmp_path}/{n}")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    good = {r["doc_id"] for r in outliers.rules(documents).where("kept").collect()}
    assert ids(out[names[0]]) == good and all(not base(texts[i])[-1] for i in good)
    first = out[names[0]]
    better = {r["doc_id"] for r in ranking.classify(first, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    assert ids(out[names[1]]) == better
    assert ids(out[names[2]]) == least_linked({i: texts[i] for i in better}) and out[names[2]].count() == out[names[2]].select("doc_id").distinct().count()
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(out[names[2]]).collect()}
    taken = collections.Counter(r["doc_id"] for r in out[names[3]].collect())
    assert taken == collections.Counter({i: n for i, n in copies.items() if n})
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(bpe.default_path()), special_tokens={})
    last = out[names[4]].collect()
    assert collections.Counter(r["doc_id"] for r in last) == taken
    for r in last:
        want = enc.encode(texts[r["doc_id"]], disallowed_special=())
        assert r["ids"] == want and r["n_tokens"] == len(want) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
    assert out[names[4]].where(F.col("source").isNull()).count() == sum(r["source"] is None for r in last)
