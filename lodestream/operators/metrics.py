"""Metric samples over fixed windows: counters, timers, sets, gauges, key/value, histograms.

Samples are rows (w, name, value, ...): w is the window's start. Every aggregate is a plain grouped
aggregation, so Spark combines partial results before the shuffle; a hot name costs no more.
Windows are of event time and an output row carries its window, where the daemon of old used arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import pick


def rounded(c: Column, digits: int = 4) -> Column:
    return F.round(c, digits)


def counters(s: DataFrame, keys: list[str]) -> DataFrame:
    """count, sum, sum_sq, min, max, mean and sample deviation (0 for one sample)."""
    v = F.col("value")
    return s.groupBy(*keys).agg(
        F.count(v).alias("cnt"), rounded(F.sum(v)).alias("total"), rounded(F.sum(v * v)).alias("sum_sq"), F.min(v).alias("lo"), F.max(v).alias("hi"),
        rounded(F.coalesce(F.avg(v), F.lit(0.0))).alias("mean"), rounded(F.coalesce(F.stddev_samp(v), F.lit(0.0))).alias("stdev"),
    )


def scale_samples(s: DataFrame) -> DataFrame:
    """Counters count 1/rate times if the rate is in (0, 1]."""
    scaled = (F.col("type") == "c") & (F.col("rate") > 0) & (F.col("rate") <= 1)
    return s.withColumn("value", F.when(scaled, F.col("value") / F.col("rate")).otherwise(F.col("value")))


def quantiles_exact(s: DataFrame, keys: list[str]) -> DataFrame:
    """The least value that the share of the values is not above: from how often each value comes, so that no group is held whole."""
    often = s.groupBy(*keys, "value").agg(F.count("value").alias("_n"), F.count("*").alias("_rows"))
    w = Window.partitionBy(*keys)
    upto = F.sum("_n").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = often.withColumn("_upto", upto).withColumn("_all", F.sum("_n").over(w))
    q = [F.min(F.when(F.col("_upto") >= F.ceil(F.lit(p) * F.col("_all")), F.col("value"))).alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))]
    return ranked.groupBy(*keys).agg(*q, F.sum("_rows").alias("cnt"))


def quantiles_approx(s: DataFrame, keys: list[str], eps: float = 0.01) -> DataFrame:
    """Bounded memory for groups of any size."""
    return s.groupBy(*keys).agg(F.percentile_approx("value", [0.5, 0.95, 0.99], int(1 / eps)).alias("q"), F.count("*").alias("cnt"))


def set_cardinality(s: DataFrame, keys: list[str], member: str, exact_to: int | None = 64, eps: float = 0.02) -> DataFrame:
    """Exact for small sets, estimated beyond; with None exact for sets of any size. Members are collapsed first."""
    if exact_to is None:
        return s.groupBy(*keys).agg(F.count_distinct(member).alias("members"))
    one = s.where(F.col(member).isNotNull()).groupBy(*keys, member).agg(F.lit(1).alias("_one"))
    n = one.groupBy(*keys).agg(F.count("*").alias("_exact"), F.approx_count_distinct(member, eps).alias("_approx"))
    return n.select(*keys, F.when(F.col("_exact") <= exact_to, F.col("_exact")).otherwise(F.col("_approx")).alias("members"))


def set_sketches(s: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Mergeable sketches, for windows of windows."""
    return s.groupBy(*keys).agg(F.hll_sketch_agg(F.col(member).cast("string")).alias("sketch"))


def merged_sets(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("members"))


def bin_count(lo: float, hi: float, width: float) -> int:
    return int((hi - lo) / width) + 2


def histogram(s: DataFrame, keys: list[str], lo: float, hi: float, width: float) -> DataFrame:
    """Counts for each bin, empty ones too; the first bin is below lo and the last from hi on.

    The number of bins is cut to a whole number, so that values just below hi fall into the last bin
    when the width does not divide the range.
    """
    bins = bin_count(lo, hi, width)
    v = F.col("value")
    b = F.when(v < lo, 0).when(v >= hi, bins - 1).otherwise(F.least(F.floor((v - lo) / width) + 1, F.lit(bins - 1))).cast("int")
    counted = s.where(v.isNotNull()).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("cnt"))
    every = counted.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(counted, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("cnt", F.lit(0).cast("long")).alias("cnt"))


def longest_prefix(names: DataFrame, config: DataFrame) -> DataFrame:
    """names (name) with the config row whose prefix is the longest that the name begins with; '' matches all.

    Joins on the prefixes' own lengths instead of comparing every name with every prefix: config is a small table.
    """
    lengths = config.select(F.length("prefix").alias("_l")).distinct().agg(F.sort_array(F.collect_set("_l")).alias("_ls"))
    tried = names.select("name").distinct().join(F.broadcast(lengths)).select("name", F.explode(F.filter("_ls", lambda n: n <= F.length("name"))).alias("_l"))
    hits = tried.withColumn("prefix", F.expr("substring(name, 1, _l)")).join(config, "prefix")
    rest = [c for c in config.columns if c != "prefix"]
    best = F.max_by(F.struct("prefix", *rest), "_l").alias("b")
    return hits.groupBy("name").agg(best).select("name", "b.*")


def gauge_last(s: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return pick(s.select(*keys, "value", *order), keys, order).select(*keys, "value")


def gauge_delta(s: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Signed samples add, others set; every window begins at 0. is_delta tells them apart.

    The result is the last set value and the sum of the deltas after it: two aggregations, no fold.
    """
    at = F.struct(*order)
    last = s.where(~F.col("is_delta")).groupBy(*keys).agg(F.max(at).alias("_at"), F.max_by("value", at).alias("_set"))
    joined = s.join(last, keys, "left")
    after = F.col("is_delta") & (F.col("_at").isNull() | (at > F.col("_at")))
    return joined.groupBy(*keys).agg(rounded(F.coalesce(F.first("_set", True), F.lit(0.0)) + F.coalesce(F.sum(F.when(after, F.col("value"))), F.lit(0.0))).alias("value"))


def kv_passthrough(s: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Every sample, numbered newest first in its window."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return s.withColumn("pos", F.row_number().over(w)).select(*keys, "value", "pos")


def latest_values(s: DataFrame, order: list[str], width: int = 91, families: tuple[str, ...] = ()) -> DataFrame:
    """Latest-value table of rows (name, value, ts): names that agree in their first ``width`` characters share a key.

    Of names that begin with one of the families a new one evicts all others of its key up to the last dot.
    """
    name = F.col("name")
    evicts = F.greatest(*(name.startswith(f).cast("int") for f in families), F.lit(0), F.lit(0)) == 1
    key = F.when(evicts, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(F.substring(name, 1, width))
    return pick(s.select(key.alias("key"), "value", "ts", *(c for c in order if c != "ts")), ["key"], order).select("key", "value", "ts")


def input_counter(s: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows (keys, name, total): how many samples came in, under a name of its own."""
    return s.groupBy(*keys).agg(F.count("*").cast("double").alias("total")).withColumn("name", F.lit(name))


def merge_flushed(s: DataFrame, keep: tuple[str, ...], drop: tuple[str, ...] = ()) -> DataFrame:
    """Lines that another collector has aggregated: of names with four parts or more only those of the kept families."""
    name = F.col("name")
    family = lambda names: F.greatest(*((name == n).cast("int") for n in names), *(name.startswith(n + ".").cast("int") for n in names), F.lit(0), F.lit(0)) == 1
    return s.where((F.size(F.split(name, r"\.")) < 4) | (family(keep) & ~family(drop)))


def flush_lines(c: DataFrame) -> DataFrame:
    """Counter rows (w, name, total) as text: counts.<name>|<%f>|<seconds>."""
    return c.select(F.concat_ws("|", F.concat(F.lit("counts."), F.col("name")), F.format_string("%.6f", F.col("total")), F.col("w").cast("string")).alias("line"))


def _line(kind: str, name, value, w) -> Column:
    return F.concat_ws("|", F.concat(F.lit(kind + "."), name), value, w.cast("string"))


def kv_lines(s: DataFrame, kind: str = "kv") -> DataFrame:
    """Key/value or gauge rows (w, name, value) as text; kind gauges for gauges."""
    return s.select(_line(kind, F.col("name"), F.format_string("%.6f", F.col("value")), F.col("w")).alias("line"))


def set_lines(s: DataFrame) -> DataFrame:
    """Set rows (w, name, members) as text, with whole numbers."""
    return s.select(_line("sets", F.col("name"), F.col("members").cast("string"), F.col("w")).alias("line"))


def bin_lines(h: DataFrame, lo: float, hi: float, width: float) -> DataFrame:
    """Histogram rows (w, name, bin, cnt) as text: bin_<lo for the first, bin_>hi for the last, else the bin's least value."""
    last, low = bin_count(lo, hi, width) - 1, F.format_string("%.2f", F.lit(lo) + (F.col("bin") - 1) * F.lit(width))
    label = F.when(F.col("bin") == 0, F.format_string("bin_<%.2f", F.lit(lo))).when(F.col("bin") == last, F.format_string("bin_>%.2f", F.lit(hi))).otherwise(F.concat(F.lit("bin_"), low))
    return h.select(_line("timers", F.concat("name", F.lit(".histogram."), label), F.col("cnt").cast("string"), F.col("w")).alias("line"))


def flush_values(c: DataFrame, keys: list[str]) -> DataFrame:
    """The wide form: seven statistics of each counter row as rows (keys, stat, value)."""
    stats = ["cnt", "total", "sum_sq", "mean", "lo", "hi", "stdev"]
    return c.select(*keys, *(F.col(x).cast("double").alias(x) for x in stats)).unpivot(keys, stats, "stat", "value")


def timer_lines(t: DataFrame) -> DataFrame:
    """Ten lines for each timer row: the statistics side by side become rows by an unpivot."""
    stats = ["total", "sum_sq", "mean", "lo", "hi", "cnt", "stdev", "p50", "p95", "p99"]
    long = t.select("w", "name", *(F.col(c).cast("double").alias(c) for c in stats)).unpivot(["w", "name"], stats, "stat", "v")
    return long.select(F.concat_ws("|", F.concat(F.lit("timers."), "name", F.lit("."), "stat"), F.format_string("%.6f", F.col("v")), F.col("w").cast("string")).alias("line"))
