"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

Each text gives a vector of transformed statistics. For every (language, source) the minimum
covariance determinant is estimated by concentration steps that run as Spark aggregations: distances
to the present centre, the distance that the nearest ``SUPPORT`` of the group's rows stay below, then
mean and covariance of those rows. The steps begin at two places (medians with deviations from them,
and mean with covariance of all rows) and go on until the determinant of neither falls any more; the
estimate with the least determinant counts. A document whose squared Mahalanobis distance is over
``CUTOFF`` is rejected: the quantile ``CLEAN`` of its chi-square law. No group is collected: histograms
and sums of products are aggregated, and because the statistics are whole numbers (1/1000) the sums are exact and runs agree whatever the partitioning.

Groups with fewer than ``min_rows`` rows (``MIN_ROWS``, unless given) use their language's estimate, and a language with
fewer uses that of all rows: a covariance of few rows says little. Each row tells whose estimate judged it. Every variance has a floor, since most clean texts have no symbols or repeats
at all and their covariance would otherwise be singular. A floor only shortens distances, so that at most
1 - ``CLEAN`` of normally distributed rows are over the cutoff.

Defined results: a null or empty text has no words, fails the base rules and is not kept; null
languages and sources are groups of their own; repeated rows count as often as they stand; an empty
table gives an empty table; ``keep`` changes no column; ``annotate`` and ``judge`` replace columns of the
names that they add.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle, stored
from . import textvec as tv

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["f_word_len", "f_symbols", "f_dup_lines", "f_repeats", "f_upper", "f_punct"]
FLOOR = np.array([250.0, 60.0, 120.0, 120.0, 60.0, 60.0])  # least standard deviations, in 1/1000
SUPPORT, MIN_ROWS, CLEAN = 0.75, 120, 0.999
SYMBOLS = b"#*$%&|<>"
P = len(FEATURES)


def _chi2_cdf(x: float, k: int) -> float:
    """Of k degrees of freedom, k even: a finite sum."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))


def _chi2_quantile(share: float, k: int) -> float:
    lo, hi = 0.0, 100.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, k) < share else (lo, mid)
    return lo


def _consistency() -> float:
    return SUPPORT / _chi2_cdf(_chi2_quantile(SUPPORT, P), P + 2)


CUTOFF = _chi2_quantile(CLEAN, P)


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


def _per_text(b: tv.Batch, flag: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    return total[b.offs[1:]] - total[b.offs[:-1]]


def statistics(b: tv.Batch) -> dict[str, np.ndarray]:
    n = len(b.offs) - 1
    space = tv._space()[b.buf]
    w = tv.words(b)
    out = {"n_words": tv.counts(w.doc, n), "word_chars": _per_text(b, ((b.buf & 0xC0) != 0x80) & ~space)}
    out["n_symbols"] = _per_text(b, _table(SYMBOLS)[b.buf])
    # lines: from a text's start or a line feed to the next line feed or the text's end
    lf = np.flatnonzero(b.buf == 10)
    start = np.concatenate([b.offs[:-1], lf + 1])
    doc = np.concatenate([np.arange(n), tv.rows_at(b, lf)]) if len(lf) else np.arange(n)
    order = np.lexsort((start, doc))
    start, doc = start[order], doc[order]
    nxt = np.append(start[1:], 0)
    same = np.append(doc[1:] == doc[:-1], False)
    end = np.where(same, nxt - 1, b.offs[doc + 1])
    filled = np.concatenate([[0], np.cumsum(~space, dtype=np.int64)])
    full = filled[np.maximum(end, start)] > filled[start]
    s, e, d = start[full], end[full], doc[full]
    h = tv.mix(tv.span_hash(b.buf, s, e) + tv.mix(d.astype(np.uint64)))
    _, first = np.unique(h, return_index=True)
    lines = tv.counts(d, n)
    out["n_dup_lines"] = lines - np.bincount(d[first], minlength=n).astype(np.int64)
    wh = tv.span_hash(b.buf, w.start, w.end)
    g, at = tv.ngram_hash(wh, w.doc, 3)
    covered = np.zeros(len(wh), bool)
    if len(g):
        g = tv.mix(g + tv.mix(w.doc[at].astype(np.uint64)))
        _, inverse, count = np.unique(g, return_inverse=True, return_counts=True)
        at = at[count[inverse] > 1]
        for k in range(3):
            covered[at + k] = True
    out["n_repeat_words"] = tv.counts(w.doc, n, covered)
    words, chars = np.maximum(out["n_words"], 1), np.maximum(out["word_chars"], 1)
    upper = _per_text(b, (b.buf >= 65) & (b.buf <= 90))
    punct = _per_text(b, _table(b"!?.,;:-_=+/\\'\"()[]{}@^~`")[b.buf])
    # transformed: lengths as they are, shares by square root
    out["f_word_len"] = np.minimum(1000 * out["word_chars"] / words, 60_000)
    for name, share in (("f_symbols", out["n_symbols"] / chars), ("f_dup_lines", out["n_dup_lines"] / np.maximum(lines, 1)), ("f_repeats", out["n_repeat_words"] / words), ("f_upper", upper / chars), ("f_punct", punct / chars)):
        out[name] = 1000 * np.sqrt(np.clip(share, 0, 4))
    return {k: np.rint(v).astype(np.int64) for k, v in out.items()}


def annotate(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The given columns of docs (all, unless named), the base statistics and the vector."""
    added = BASE + FEATURES
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    source = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in added])

    @tv.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in tv.slices(batches):
            got = statistics(tv.from_arrow(rb.column("text")))
            yield pa.RecordBatch.from_arrays([rb.column(c) for c in keep] + [pa.array(got[c]) for c in added], names=[*keep, *added])

    return source.mapInArrow(run, schema)


def _failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _key(lang, source):
    text = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("~"))
    return F.concat(F.length(text(lang)).cast("string"), F.lit(":"), text(lang), text(source))


def _levels(df: DataFrame) -> DataFrame:
    lang, source = F.col("lang"), F.col("source")
    keys = F.array(_key(lang, source), F.concat(F.lit("L"), F.coalesce(F.concat(F.lit("="), lang), F.lit("~"))), F.lit("A"))
    return df.withColumn("_keys", keys)


def _distance2(centre: str = "centre", inverse: str = "inverse"):
    d = [F.col(c) - F.get(F.col(centre), F.lit(i)) for i, c in enumerate(FEATURES)]
    terms = [(1 if i == j else 2) * d[i] * d[j] * F.get(F.col(inverse), F.lit(i * P + j)) for i in range(P) for j in range(i, P)]
    return sum(terms[1:], terms[0])


def _bin():
    return F.least(F.floor(64 * F.log2(1 + F.greatest(F.col("_d2"), F.lit(0.0)))), F.lit(4096)).cast("int")


def _under(binned: DataFrame, group: list[str], share: float, weight: Column | int = 1) -> DataFrame:
    """For each group the least bin at or under which ``share`` of its rows lie; bins are few by construction."""
    h = binned.groupBy(*group, "_bin").agg(F.sum(F.lit(weight)).alias("_c"))
    w = Window.partitionBy(*group)
    upto = F.sum("_c").over(w.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return h.withColumn("_u", upto).withColumn("_t", F.sum("_c").over(w)).where(F.col("_u") >= F.ceil(F.col("_t") * share)).groupBy(*group).agg(F.min("_bin").alias("_limit"))


PARAMS = "_key string, _start int, rows long, centre array<double>, inverse array<double>, logdet double"


def _estimate(batches: Iterator[pd.DataFrame], factor: float) -> Iterator[pd.DataFrame]:
    at = [(i, j) for i in range(P) for j in range(i, P)]
    for df in batches:
        rows = []
        for r in df.to_dict("records"):
            n = r["rows"]
            mean = np.array([r[f"s{i}"] / n for i in range(P)])
            cov = np.zeros((P, P))
            for i, j in at:
                cov[i, j] = cov[j, i] = r[f"q{i}_{j}"] / n - mean[i] * mean[j]
            cov = factor * cov + np.diag(FLOOR**2)
            rows.append((r["_key"], r["_start"], n, mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])))
        yield pd.DataFrame(rows, columns=["_key", "_start", "rows", "centre", "inverse", "logdet"])


def fit(stats: DataFrame) -> DataFrame:
    """One row for each level's group: rows, centre, inverse covariance. stats: lang, source and the vector, base rules passed."""
    wide = _levels(stats).select(F.explode("_keys").alias("_key"), *FEATURES)
    # the start: medians, and median absolute deviations as a diagonal covariance
    # from how often each value comes, so that a large group is a few thousand rows
    values = wide.select("_key", F.posexplode(F.array(*FEATURES)).alias("_f", "_v")).groupBy("_key", "_f", "_v").agg(F.count("*").alias("_k"))
    values, often = stored(values), F.col("_k")
    median = _under(values.withColumn("_bin", F.col("_v")), ["_key", "_f"], 0.5, often).withColumnRenamed("_limit", "_med")
    mad = _under(values.join(median, ["_key", "_f"]).withColumn("_bin", F.abs(F.col("_v") - F.col("_med"))), ["_key", "_f"], 0.5, often)
    start = median.join(mad, ["_key", "_f"]).groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_f", "_med", "_limit"))).alias("_a"))
    floors = F.array(*map(F.lit, map(float, FLOOR)))
    spread = F.transform("_a", lambda x: 1.4826**2 * x["_limit"] * x["_limit"] + F.pow(F.get(floors, x["_f"]), F.lit(2.0)))
    robust = start.select(
        "_key",
        F.lit(0).alias("_start"),
        F.lit(0).cast("long").alias("rows"),
        F.transform("_a", lambda x: x["_med"].cast("double")).alias("centre"),
        F.flatten(F.transform(F.sequence(F.lit(0), F.lit(P - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(P - 1)), lambda j: F.when(i == j, 1 / F.get(spread, i)).otherwise(0.0)))).alias("inverse"),
    )
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(FEATURES)] + [F.sum(F.col(a) * F.col(b)).alias(f"q{i}_{j}") for i, a in enumerate(FEATURES) for j, b in enumerate(FEATURES) if i <= j]
    factor, group = _consistency(), ["_key", "_start"]
    whole = wide.groupBy("_key").agg(F.count("*").alias("rows"), *sums).withColumn("_start", F.lit(1)).mapInPandas(lambda b: _estimate(b, 1.0), PARAMS)
    # starts have no determinant to compare, since their rows are no support
    best = stored(robust.unionByName(whole.drop("logdet")).withColumn("logdet", F.lit(None).cast("double")).withColumn("_moving", F.lit(True)))
    while not best.where("_moving").isEmpty():
        binned = wide.join(best.where("_moving"), "_key").withColumn("_d2", _distance2()).withColumn("_bin", _bin()).select(*group, "_bin", *FEATURES)
        limit = _under(binned, group, SUPPORT)
        moments = binned.join(limit, group).where("_bin <= _limit").groupBy(*group).agg(F.count("*").alias("rows"), *sums)
        step = moments.mapInPandas(lambda b: _estimate(b, factor), PARAMS).select(*group, F.struct("rows", "centre", "inverse", "logdet").alias("_n"))
        # a support that stays gives the same determinant; since it has to fall, the steps come to an end
        falls = F.col("_n").isNotNull() & (F.col("logdet").isNull() | (F.col("_n.logdet") < F.col("logdet") - 1e-9))
        old = F.struct("rows", "centre", "inverse", "logdet")
        best = stored(best.join(step, group, "left").select(*group, F.when(falls, F.col("_n")).otherwise(old).alias("_b"), falls.alias("_moving")).select(*group, "_b.*", "_moving"))
    settle(stats.sparkSession)
    least = F.min_by(F.struct("rows", "centre", "inverse"), F.struct("logdet", "_start"))
    return stored(best.groupBy("_key").agg(least.alias("_b")).select("_key", "_b.*"))


def choose(stats: DataFrame, params: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """For each (lang, source) the finest level that has ``min_rows`` rows."""
    # "rows" are those in the support, SUPPORT of the group
    groups = _levels(stats.select("lang", "source").distinct()).select(F.element_at("_keys", 1).alias("_group"), F.posexplode("_keys").alias("_level", "_key"))
    enough = groups.join(params, "_key").where((F.col("rows") >= SUPPORT * min_rows) | (F.col("_level") == 2))
    best = F.min_by(F.struct("centre", "inverse", F.col("_level").alias("level")), "_level")
    return enough.groupBy("_group").agg(best.alias("_p")).select("_group", "_p.*")


def judge(annotated: DataFrame, params: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """annotated with base_failed, distance2 and level (null if the base rules fail) and kept."""
    names = [c for c in annotated.columns if c not in ("base_failed", "distance2", "level", "kept")]
    joined = annotated.select(*names).withColumn("_group", _key(F.col("lang"), F.col("source"))).join(params, "_group", "left")
    scored = joined.withColumn("base_failed", _failed()).withColumn("distance2", F.when(~F.col("base_failed"), _distance2()))
    return scored.select(*names, "base_failed", "distance2", F.when(~F.col("base_failed"), F.col("level")).alias("level"), (~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= cutoff)).alias("kept"))


def rules(docs: DataFrame, min_rows: int = MIN_ROWS, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, lang, source, the base statistics, base_failed, distance2, level (whose estimate judged: 0 the group's, 1 the
    language's, 2 that of all rows), kept for every row."""
    stats = stored(annotate(docs, ["doc_id", "lang", "source"]))
    passed = stats.where(~_failed())
    return judge(stats, stored(choose(passed, fit(passed), min_rows)), cutoff).drop(*FEATURES)


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their columns as they are."""
    safe, back = tv.guarded(docs, ("text", "lang", "source"))
    stats = stored(annotate(safe, ["lang", "source"]))
    passed = stats.where(~_failed())
    params = stored(choose(passed, fit(passed)))
    return judge(annotate(safe), params).where("kept").select(*back)
