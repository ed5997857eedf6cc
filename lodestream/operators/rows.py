"""One row for each key, the first or the last in an order; ranges of a key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
LEAST = -(1 << 62)


def packed(df: DataFrame, order: list[str | Column]) -> Column | None:
    """One or two whole numbers (of less than 2**62) as one, in the same order, nulls least; None for other orders."""
    kinds = [f.dataType for f in df.select(*order).schema]
    if not all(isinstance(k, T.IntegralType) for k in kinds) or len(kinds) > 2:
        return None
    one = [F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(LEAST)) for c in order]
    return one[0] if len(one) == 1 else one[0].cast("decimal(38,0)") * F.lit(str(1 << 64)).cast("decimal(20,0)") + one[1]


def pick(df: DataFrame, keys: list[str], order: list[str | Column], last: bool = True) -> DataFrame:
    """The whole row with the greatest order for each key (without last: the least).

    If the order packs into one number and all other columns have a fixed width this is one hash aggregation: rows
    are combined before the shuffle and none is sorted. Each column is taken by the same comparisons, so all come
    from one row. Otherwise rows are shuffled once by key and sorted once.
    """
    rest, by = [c for c in df.columns if c not in keys], packed(df, order)
    if by is not None and all(isinstance(df.schema[c].dataType, FIXED) for c in rest):
        take = F.max_by if last else F.min_by
        return df.groupBy(*keys).agg(*(take(c, by).alias(c) for c in rest)).select(*df.columns)
    cols = [c if isinstance(c, Column) else F.col(c) for c in order]
    w = Window.partitionBy(*keys).orderBy(*(c.desc() if last else c.asc() for c in cols))
    return df.withColumn("_row", F.row_number().over(w)).where("_row = 1").drop("_row")


def range_of(df: DataFrame, key: str, least: int = 1 << 14) -> Column:
    """The number of the range that a row's key lies in, null for a null key; ranges go up with the key and hold about equally many rows, ``least`` or more.

    The bounds are keys of a sample of bounded size and stand in the plan as literals, so the number follows from the key
    alone and all uses of it agree. The number of a shuffle partition does not: each place that reads it may have its own
    bounds, and adaptive execution may join partitions in one place and not in another.
    """
    keys, kind = df.select(F.col(key).alias("k")).where("k IS NOT NULL"), T.ArrayType(df.schema[key].dataType)
    rows = keys.count()
    n = max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // least))
    some = keys.sample(min(1.0, 40 * n / rows), 0).agg(F.sort_array(F.collect_list("k")).alias("ks")).first()["ks"] if n > 1 else []
    bounds = list(dict.fromkeys(some[len(some) * i // n] for i in range(1, n) if some))
    if not bounds:
        return F.when(F.col(key).isNotNull(), 0)
    # two steps of about the root of their number, instead of a look at every bound
    wide = math.isqrt(len(bounds)) + 1
    groups = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    below = lambda a: F.size(F.filter(a, lambda b: b < F.col(key)))
    group = below(F.lit([g[0] for g in groups]).cast(kind)) - 1
    inside = below(F.get(F.array(*(F.lit(g).cast(kind) for g in groups)), group))
    return F.when(F.col(key).isNotNull(), F.when(group < 0, 0).otherwise(group * wide + inside))
