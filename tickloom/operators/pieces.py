"""Windows over long series in pieces of bounded size, so that one key with a third of all rows is many tasks.

`windowed` serves windows that look a bounded number of rows back: a series is cut into chunks of equal size, and the
last rows of a chunk are copied in front of the next one. `running` and `cumulative` serve windows that look back to the
start, if what lies before a piece can be summed up: by days in time order, by ranges of equal share in value order.
One row for each key and piece meets in one window; the rows do not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.operators.ordered import numbered

#: Rows of a chunk.
CHUNK = 10_000
#: Ranges of values that a key is cut into.
RANGES = 64


def windowed(df: DataFrame, keys: list[str], ts: str, before: int, made: Callable[[WindowSpec], dict[str, Column]], index: str | None = None, size: int | None = None) -> DataFrame:
    """df with the columns that `made` builds over a window ordered by `ts` within `keys`. They may look `before` rows back,
    by lag or by rowsBetween, and not ahead.

    index: a column that numbers a key's rows from 0 already. Times are taken to be unique in a key.
    """
    size = max(size or CHUNK, before, 1)
    rows = numbered(df, keys, ts, "_at") if index is None else df.withColumn("_at", F.col(index))
    own = F.floor(F.col("_at") / size)
    places = F.when(F.pmod("_at", F.lit(size)) >= size - before, F.array(own, own + 1)).otherwise(F.array(own))
    copied = rows.withColumn("_own", own).withColumn("_piece", F.explode(places))
    out = copied.withColumns(made(Window.partitionBy(*keys, "_piece").orderBy("_at")))
    return out.where(F.col("_piece") == F.col("_own")).drop("_at", "_own", "_piece")


def running(df: DataFrame, keys: list[str], ts: str, sums: dict[str, Column], *ties: str) -> DataFrame:
    """df with the running sums out: value of `sums`, the row itself included, by `ts` and then by `ties` within `keys`.

    Rows of equal time and ties are ordered by chance. Rows without a time come before all others.
    """
    day = df.withColumn("_day", F.to_date(ts)).withColumns({f"_x_{o}": v for o, v in sums.items()})
    total = day.groupBy(*keys, "_day").agg(*[F.sum(f"_x_{o}").alias(f"_s_{o}") for o in sums])
    earlier = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = total.select(*keys, "_day", *[F.coalesce(F.sum(f"_s_{o}").over(earlier), F.lit(0)).alias(f"_b_{o}") for o in sums])
    offsets = offsets.withColumnsRenamed({k: f"_k_{k}" for k in [*keys, "_day"]})
    here = Window.partitionBy(*keys, "_day").orderBy(ts, *ties).rowsBetween(Window.unboundedPreceding, 0)
    inside = day.withColumns({f"_h_{o}": F.sum(f"_x_{o}").over(here) for o in sums})
    same = [inside[k].eqNullSafe(offsets[f"_k_{k}"]) for k in [*keys, "_day"]]
    out = inside.join(offsets, same).withColumns({o: F.col(f"_b_{o}") + F.coalesce(f"_h_{o}", F.lit(0)) for o in sums})
    return out.drop("_day", "_k__day", *[f"_k_{k}" for k in keys], *[f"_{p}_{o}" for o in sums for p in "xbh"])


def cumulative(df: DataFrame, keys: list[str], value: str, sums: dict[str, Column], ranges: int = RANGES) -> DataFrame:
    """df with out: the sum of a column of `sums` over the rows of lesser `value` in the key. Rows are unique by key and
    value (aggregate first), and value is not null.

    A quantile sketch gives each key the bounds of ranges of about equal numbers of rows; range totals give each range
    what lies before it.
    """
    bounds = df.groupBy(*keys).agg(F.percentile_approx(value, [k / ranges for k in range(1, ranges)], F.lit(20 * ranges)).alias("_bounds"))
    rows = df.withColumns({f"_x_{o}": v for o, v in sums.items()}).join(bounds, keys)
    rows = rows.withColumn("_range", F.size(F.filter("_bounds", lambda b: b < F.col(value)))).drop("_bounds")
    total = rows.groupBy(*keys, "_range").agg(*[F.sum(f"_x_{o}").alias(f"_s_{o}") for o in sums])
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = total.select(*keys, "_range", *[F.coalesce(F.sum(f"_s_{o}").over(earlier), F.lit(0)).alias(f"_b_{o}") for o in sums])
    here = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumns({f"_h_{o}": F.coalesce(F.sum(f"_x_{o}").over(here), F.lit(0)) for o in sums})
    out = inside.join(offsets, [*keys, "_range"]).withColumns({o: F.col(f"_b_{o}") + F.col(f"_h_{o}") for o in sums})
    return out.drop("_range", *[f"_{p}_{o}" for o in sums for p in "xbh"])


def ranks(df: DataFrame, keys: list[str], value: str, out: str = "rank", ranges: int = RANGES) -> DataFrame:
    """df with the rank of `value` in its key from 1; equal values share their mean rank, null values have none."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = cumulative(counts, keys, value, {"_less": F.col("_n")}, ranges)
    return df.join(placed.select(*keys, value, (F.col("_less") + (F.col("_n") + 1) / 2).alias(out)), [*keys, value], "left")
