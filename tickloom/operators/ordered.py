"""Operators over ordered series that don't put a whole series into one task.

Series are cut by day. What a day needs from the days before it (a row number, a running sum, the last known value, a
smoothed value) is computed from one row per day and joined back, so the heavy sort and window work is by (key, day).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], ts: str, out: str = "row_no") -> DataFrame:
    """Rows numbered from 0 by `ts` within `keys`."""
    day = df.withColumn("_day", F.to_date(ts))
    counts = day.groupBy(*keys, "_day").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    here = F.row_number().over(Window.partitionBy(*keys, "_day").orderBy(ts)) - 1
    return day.withColumn("_here", here).join(offsets, [*keys, "_day"]).withColumn(out, F.col("_before") + F.col("_here")).drop("_day", "_here", "_before")


def newest_days(df: DataFrame, keys: list[str], ts: str, least: int) -> DataFrame:
    """The rows of each key's last days, of as many as hold `least` rows (all days if there are fewer rows)."""
    day = df.withColumn("_day", F.to_date(ts))
    counts = day.groupBy(*keys, "_day").agg(F.count(F.lit(1)).alias("_n"))
    later = Window.partitionBy(*keys).orderBy(F.col("_day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    wanted = counts.withColumn("_later", F.coalesce(F.sum("_n").over(later), F.lit(0))).where(F.col("_later") < least)
    return day.join(wanted.select(*keys, "_day"), [*keys, "_day"], "left_semi").select(*df.columns)


def running_sum(df: DataFrame, keys: list[str], ts: str, value: str, out: str) -> DataFrame:
    """Running sum by `ts` within `keys`; rows of equal time get the sum of all of them."""
    day = df.withColumn("_day", F.to_date(ts))
    sums = day.groupBy(*keys, "_day").agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    here = Window.partitionBy(*keys, "_day").orderBy(ts).rangeBetween(Window.unboundedPreceding, 0)
    return day.withColumn("_here", F.sum(value).over(here)).join(offsets, [*keys, "_day"]).withColumn(out, F.col("_before") + F.col("_here")).drop("_day", "_here", "_before")


def onto_first(first: DataFrame, others: list[DataFrame], key: list[str]) -> DataFrame:
    """Rows of the first frame with the columns of the others by key; columns that are there already are left out."""
    out = first
    for other in others:
        new = [c for c in other.columns if c not in out.columns]
        out = out.join(other.select(*key, *new).dropDuplicates(key), key, "left")
    return out


def side_by_side(frames: list[DataFrame | None], key: list[str]) -> DataFrame:
    """Full outer join of the frames that there are by key; of columns of the same name the first value that is there
    wins, in the order of the frames. None stands for a source that gave nothing and is skipped.

    The frames' rows are stacked and aggregated by key, so any number of frames takes one shuffle. A frame gives one row
    for each key; of several, the value of any. A column needs one type in all frames.
    """
    given = [f for f in frames if f is not None]
    if not given:
        raise ValueError("no frame to join")
    columns = list(dict.fromkeys(c for f in given for c in f.columns if c not in key))
    stacked = None
    for k, frame in enumerate(given):
        rows = frame.withColumn("_frame", F.lit(k))
        stacked = rows if stacked is None else stacked.unionByName(rows, allowMissingColumns=True)
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_frame"))).alias(c) for c in columns]
    return stacked.groupBy(*key).agg(*first) if first else stacked.select(*key).distinct()


def running_max(df: DataFrame, keys: list[str], ts: str, value: str, out: str, earlier: str | None = None) -> DataFrame:
    """Running maximum by `ts` within `keys`; `earlier` names a column for that of the rows before (times being unique)."""
    day = df.withColumn("_day", F.to_date(ts))
    tops = day.groupBy(*keys, "_day").agg(F.max(value).alias("_m"))
    before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tops.withColumn("_before", F.max("_m").over(before)).drop("_m")
    here = Window.partitionBy(*keys, "_day").orderBy(ts)
    inside = day.withColumn("_here", F.max(value).over(here.rangeBetween(Window.unboundedPreceding, 0)))
    inside = inside.withColumn("_less", F.max(value).over(here.rowsBetween(Window.unboundedPreceding, -1))) if earlier else inside
    made = {out: F.greatest("_before", "_here")} | ({earlier: F.greatest("_before", "_less")} if earlier else {})
    return inside.join(offsets, [*keys, "_day"]).withColumns(made).drop("_day", "_here", "_before", "_less")


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, tolerance_seconds: int | None = None) -> DataFrame:
    """Each left row with the newest right row of equal keys and `right_ts <= left_ts`; all left rows are kept.

    Right columns other than the keys are added; `tolerance_seconds` drops matches that are older. Both sides are
    united and sorted by (keys, day); the last right row of earlier days comes from one row per day.
    """
    columns = [c for c in right.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in columns])
    lefts = left.select(*keys, F.struct(*left.columns).alias("_left"), F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(packed.alias("x")).schema["x"].dataType).alias("_right"))
    rights = right.select(*keys, F.lit(None).cast(lefts.schema["_left"].dataType).alias("_left"), F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), packed.alias("_right"))
    both = lefts.unionByName(rights).withColumn("_day", F.to_date("_ts"))
    within = Window.partitionBy(*keys, "_day").orderBy("_ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    lasts = rights.withColumn("_day", F.to_date("_ts")).groupBy(*keys, "_day").agg(F.max_by("_right", "_ts").alias("_last"))
    days = both.select(*keys, "_day").distinct().join(lasts, [*keys, "_day"], "left")
    before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).select(*keys, "_day", "_carried")
    found = both.withColumn("_near", F.last("_right", ignorenulls=True).over(within)).where("_side = 1").join(carried, [*keys, "_day"], "left")
    match = F.coalesce("_near", "_carried")
    if tolerance_seconds is not None:
        age = F.unix_micros(F.col("_ts")) - F.unix_micros(match[right_ts])
        match = F.when(age <= tolerance_seconds * 1_000_000, match)
    return found.select("_left.*", match.alias("_match")).select(*left.columns, *[F.col(f"_match.{c}").alias(c if c not in left.columns else f"{c}_right") for c in columns])


def smoothed(df: DataFrame, keys: list[str], index: str, values: dict[str, str], decay: float) -> DataFrame:
    """For each out: value of `values`, y = decay * y + (1 - decay) * x along `index`, with y = x at index 0.

    index is 0, 1, 2 ... within keys; rows of negative index get null. The series is cut into chunks of
    40 / (1 - decay) rows: what lies before the chunk before has decayed below double precision, so a chunk needs the
    weighted sum of the one before it only, and windows run by chunk.
    """
    if decay <= 0:
        return df.withColumns({out: F.when(F.col(index) >= 0, F.col(value)) for out, value in values.items()})
    size = max(2, math.ceil(40 / (1 - decay)))
    place = F.col("_k") + 1
    weight = F.when(F.col(index) < 0, F.lit(0.0)).when(F.col(index) == 0, F.lit(1.0)).otherwise(F.lit(1 - decay))
    cut = df.withColumn("_chunk", F.floor(F.col(index) / size)).withColumn("_k", F.pmod(F.col(index), F.lit(size)))
    ends = cut.groupBy(*keys, "_chunk").agg(*[F.sum(F.pow(F.lit(decay), F.lit(size) - place) * weight * F.col(value)).alias(f"_end_{out}") for out, value in values.items()])
    carries = ends.withColumn("_chunk", F.col("_chunk") + 1)
    here = Window.partitionBy(*keys, "_chunk").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    inside = cut.withColumns({f"_in_{out}": F.sum(F.pow(F.lit(decay), -place) * weight * F.col(value)).over(here) for out, value in values.items()})
    joined = inside.join(carries, [*keys, "_chunk"], "left")
    made = {out: F.when(F.col(index) >= 0, F.pow(F.lit(decay), place) * (F.coalesce(f"_end_{out}", F.lit(0.0)) + F.col(f"_in_{out}"))) for out in values}
    return joined.withColumns(made).drop("_chunk", "_k", *[f"_in_{o}" for o in values], *[f"_end_{o}" for o in values])
