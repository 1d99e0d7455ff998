"""Statistics of return series (strategy_id, i, r), for many strategies at once."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.pieces import cumulative, windowed

ID = ["strategy_id"]


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function (Abramowitz and Stegun 7.1.26; error below 1.5e-7)."""
    z = F.abs(x) / F.lit(math.sqrt(2))
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = 0.5 * poly * F.exp(-z * z)
    return F.when(x < 0, half).otherwise(1 - half)


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where f may use the value often: it is computed once, and generated code stays short."""
    return F.transform(F.array(value), f)[0]


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p of a t statistic, by Hill's expansion of the equivalent normal deviate (1970); off by less than 2e-4
    from 3 degrees of freedom on."""
    a = df - 0.5
    b = 48 * a * a
    z = lambda y: (((((-0.4 * y - 3.3) * y - 24.0) * y - 85.5) / (0.8 * y * y + 100.0 + b) + y + 3.0) / b + 1.0) * F.sqrt(y)
    return _with(_with(a * F.log1p(t * t / df), z), lambda z: 2 * normal_cdf(-z))


def student_quantile(p: float, df: Column) -> Column:
    """The t value below which a share p lies, by the Cornish and Fisher expansion; for 10 degrees of freedom or more."""
    z = NormalDist().inv_cdf(p)
    terms = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384]
    return z + terms[0] / df + terms[1] / (df * df) + terms[2] / (df * df * df)


def t_statistic(series: DataFrame, significance: float = 0.05) -> DataFrame:
    """One-sample t statistic of the mean, p of both sides, p of a mean above 0, and power.

    The power is the chance that a mean as large as the observed one, in size, exceeds the upper critical value; the
    noncentral t distribution is taken as normal (Abramowitz and Stegun 26.7.10).
    """
    out = series.groupBy(*ID).agg(F.count("r").alias("n"), F.avg("r").alias("mean_r"), F.stddev_samp("r").alias("sd_r"))
    t = F.when(F.col("sd_r") > 0, F.col("mean_r") / (F.col("sd_r") / F.sqrt("n"))).otherwise(0.0)
    df = (F.col("n") - 1).cast("double")
    out = out.withColumn("t", t).withColumn("p", F.when(df > 0, student_p(F.col("t"), df)))
    critical = student_quantile(1 - significance / 2, df)
    power = _with(critical, lambda c: _with((F.abs("t") - c * (1 - 1 / (4 * df))) / F.sqrt(1 + c * c / (2 * df)), normal_cdf))
    return out.withColumns({"p_one_tailed": F.when(F.col("t") > 0, F.col("p") / 2).otherwise(1 - F.col("p") / 2), "power": F.when(df > 0, power)})


def jarque_bera(series: DataFrame) -> DataFrame:
    out = series.groupBy(*ID).agg(F.count("r").alias("n"), F.skewness("r").alias("skew"), F.kurtosis("r").alias("excess"))
    jb = F.col("n") / 6 * (F.col("skew") * F.col("skew") + F.col("excess") * F.col("excess") / 4)
    return out.withColumn("jb", jb).withColumn("p", F.exp(-F.col("jb") / 2))


def wilcoxon(series: DataFrame) -> DataFrame:
    """Signed-rank test: zeros dropped, equal sizes share their mean rank, normal approximation."""
    sized = series.where("r != 0").withColumn("_a", F.abs("r"))
    counts = sized.groupBy(*ID, "_a").agg(F.count(F.lit(1)).alias("_k"), F.count_if(F.col("r") > 0).alias("_up"))
    ranked = cumulative(counts, ID, "_a", {"_less": F.col("_k")}).withColumn("_rank", F.col("_less") + (F.col("_k") + 1) / 2)
    out = ranked.groupBy(*ID).agg(F.sum(F.col("_rank") * F.col("_up")).alias("w_plus"), F.sum("_k").alias("n"), F.sum(F.col("_k") * F.col("_k") * F.col("_k") - F.col("_k")).alias("_ties"))
    mean = F.col("n") * (F.col("n") + 1) / 4
    var = F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24 - F.col("_ties") / 48
    return out.withColumn("z", F.when(var > 0, (F.col("w_plus") - mean) / F.sqrt(var)).otherwise(0.0)).withColumn("p", 2 * (1 - normal_cdf(F.abs("z")))).drop("_ties")


def anderson_darling(series: DataFrame) -> DataFrame:
    """A-squared against the normal of the sample's mean and deviation, with the small-sample factor; p by the formulas
    of D'Agostino and Stephens (1986)."""
    moments = series.groupBy(*ID).agg(F.count("r").alias("n"), F.avg("r").alias("_m"), F.stddev_samp("r").alias("_s")).where("_s > 0")
    counts = cumulative(series.groupBy(*ID, "r").agg(F.count(F.lit(1)).alias("_k")), ID, "r", {"_less": F.col("_k")})
    p = F.greatest(F.least(normal_cdf((F.col("r") - F.col("_m")) / F.col("_s")), F.lit(1 - 1e-12)), F.lit(1e-12))
    # The sums of 2i - 1 and of 2(n - i) + 1 over the ranks i of equal returns are differences of squares.
    upto, above = (F.col("_less") + F.col("_k")).cast("double"), (F.col("n") - F.col("_less")).cast("double")
    term = (upto * upto - F.col("_less") * F.col("_less")) * F.log(p) + (above * above - (above - F.col("_k")) * (above - F.col("_k"))) * F.log(1 - p)
    out = counts.join(moments, ID).groupBy(*ID).agg(F.first("n").alias("n"), F.sum(term).alias("_s"))
    a2 = (-F.col("n") - F.col("_s") / F.col("n")) * (1 + 0.75 / F.col("n") + 2.25 / (F.col("n") * F.col("n")))
    # Coefficients of the exponent for A-squared from each bound on.
    small = lambda a, b, c: 1 - F.exp(a + b * F.col("a2") + c * F.col("a2") * F.col("a2"))
    large = lambda a, b, c: F.exp(a + b * F.col("a2") + c * F.col("a2") * F.col("a2"))
    p = F.when(F.col("a2") >= 0.6, large(1.2937, -5.709, 0.0186)).when(F.col("a2") >= 0.34, large(0.9177, -4.279, -1.38)).when(F.col("a2") >= 0.2, small(-8.318, 42.796, -59.938)).otherwise(small(-13.436, 101.14, -223.73))
    return out.select(*ID, "n", a2.alias("a2")).withColumn("p", p)


def runs_test(series: DataFrame) -> DataFrame:
    """Wald and Wolfowitz: runs of returns above and not above zero."""
    flagged = series.withColumn("_up", (F.col("r") > 0).cast("int"))
    marked = windowed(flagged, ID, "i", 1, lambda w: {"_new": F.coalesce(F.col("_up") != F.lag("_up").over(w), F.lit(True)).cast("int")}, "i")
    marked = marked.select(*ID, "_up", "_new")
    out = marked.groupBy(*ID).agg(F.sum("_new").alias("runs"), F.sum("_up").alias("n_up"), F.sum(1 - F.col("_up")).alias("n_down"))
    a, b = F.col("n_up").cast("double"), F.col("n_down").cast("double")
    mean, var = 2 * a * b / (a + b) + 1, 2 * a * b * (2 * a * b - a - b) / ((a + b) * (a + b) * (a + b - 1))
    return out.withColumn("z", F.when(var > 0, (F.col("runs") - mean) / F.sqrt(var)).otherwise(0.0)).withColumn("p", 2 * (1 - normal_cdf(F.abs("z"))))


def corrected(tests: DataFrame, method: str) -> DataFrame:
    """tests (test, p): p_adjusted by bonferroni, holm, fdr (Benjamini and Hochberg) or none. One row per test."""
    m = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("p", "test"))
    rows = tests.withColumns({"_m": m, "_k": rank})
    up, down = Window.partitionBy(F.lit(0)).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(F.lit(0)).orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    value = {
        "none": F.col("p"), "bonferroni": F.least(F.col("p") * F.col("_m"), F.lit(1.0)),
        "holm": F.max(F.least(F.col("p") * (F.col("_m") - F.col("_k") + 1), F.lit(1.0))).over(up),
        "fdr": F.min(F.least(F.col("p") * F.col("_m") / F.col("_k"), F.lit(1.0))).over(down),
    }[method]
    return rows.withColumn("p_adjusted", value).drop("_m", "_k")


def _pick(sim: Column, block: Column, seed: int, word: int = 0) -> Column:
    """32 bits of the md5 of (seed, simulation, block), the leading ones for word 0, which any engine repeats."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), sim, block).cast("binary")), 1 + 8 * word, 8), 16, 10).cast("long")


#: Returns of a strategy that are held as one array; longer series are drawn row by row.
LONGEST = 100_000
#: Simulations that one row works off.
CHUNK = 100


def _held(series: DataFrame, simulations: int) -> DataFrame | None:
    """(strategy_id, rs, n, chunk, sim): the returns of a strategy in order, beside each simulation, dealt out by chunks of
    simulations; None if a series is longer than LONGEST."""
    longest = series.groupBy(*ID).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if longest > LONGEST:
        return None
    held = series.groupBy(*ID).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "r"))), lambda x: x["r"]).alias("rs"), F.count(F.lit(1)).alias("n"))
    chunks = held.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit((simulations - 1) // CHUNK)))).repartition(*ID, "chunk")
    last = F.least(F.col("chunk") * CHUNK + CHUNK - 1, F.lit(simulations - 1))
    return chunks.withColumn("sim", F.explode(F.sequence(F.col("chunk") * CHUNK, last)))


def draws(series: DataFrame, simulations: int, seed: int = 7, block: int = 1, steps: int | None = None) -> DataFrame:
    """Bootstrap paths: for each simulation and step, a return picked by a hash of (seed, simulation, block).

    series: strategy_id, i (0, 1 ...), r. With block > 1, whole blocks of consecutive returns are picked, none
    of which runs over the end of the series. Result: strategy_id, chunk (of simulations), sim, step, r. A path's picks
    come from an array beside it, one hash a block, so nothing is joined; series longer than LONGEST are joined.
    """
    starts = F.greatest(F.col("n") - block + 1, F.lit(1))
    length = F.col("n") if steps is None else F.lit(steps).cast("long")
    if (sims := _held(series, simulations)) is not None:
        blocks = F.sequence(F.lit(0).cast("long"), F.expr(f"({'n' if steps is None else steps} - 1) div {block}"))
        offsets = F.sequence(F.lit(0).cast("long"), F.lit(block - 1).cast("long"))
        picked = lambda start: F.transform(offsets, lambda j: F.get("rs", ((start + j) % F.col("n")).cast("int")))
        rs = F.flatten(F.transform(blocks, lambda b: _with(_pick(F.col("sim"), b, seed) % starts, picked)))
        return sims.select(*ID, "chunk", "sim", F.posexplode(F.slice(rs, 1, length.cast("int"))).alias("step", "r"))
    sizes = series.groupBy(*ID).agg(F.count(F.lit(1)).alias("n"))
    grid = sizes.select(*ID, "n", F.explode(F.sequence(F.lit(0), F.lit(simulations - 1))).alias("sim")).withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), length - 1)))
    picked = grid.withColumn("i", (_pick(F.col("sim"), F.expr(f"step div {block}"), seed) % starts + F.col("step") % block) % F.col("n"))
    return picked.join(series.select(*ID, "i", "r"), [*ID, "i"]).select(*ID, F.expr(f"sim div {CHUNK}").cast("int").alias("chunk"), "sim", "step", "r")


def draw_stats(series: DataFrame, simulations: int, seed: int = 7) -> DataFrame:
    """(strategy_id, sim, n, m, sd): mean and deviation of each bootstrap path, as `draws` makes them with blocks of one.

    A series of up to LONGEST returns is an array beside its simulations, so no row is made for a single pick.
    """
    sims = _held(series, simulations)
    if sims is None:
        return draws(series, simulations, seed).groupBy(*ID, "sim").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("m"), F.stddev_pop("r").alias("sd"))
    steps = F.sequence(F.lit(0).cast("long"), F.col("n") - 1)
    picked = sims.withColumn("picks", F.transform(steps, lambda k: F.get("rs", (_pick(F.col("sim"), k, seed) % F.col("n")).cast("int")))).drop("rs")
    means = picked.withColumn("m", F.aggregate("picks", F.lit(0.0), lambda s, x: s + x) / F.col("n"))
    spread = F.aggregate("picks", F.lit(0.0), lambda s, x: s + (x - F.col("m")) * (x - F.col("m")))
    return means.select(*ID, "sim", "n", "m", F.sqrt(spread / F.col("n")).alias("sd"))


def bootstrap_test(series: DataFrame, simulations: int) -> DataFrame:
    """The share of bootstrap paths at least as far from 0 as the series, on its side: for the mean, whose paths are
    centred, and for the ratio of mean and deviation, whose paths are not.

    Both come from the same picks: the mean of a centred path is the path's mean less that of the series.
    """
    seen = series.groupBy(*ID).agg(F.avg("r").alias("mean_r"), (F.avg("r") / (F.stddev_samp("r") + 1e-10)).alias("ratio"))
    rows = draw_stats(series, simulations).join(seen, ID)
    ratio = F.col("m") / (F.col("sd") + 1e-10)
    beyond = lambda drawn, own: F.avg(F.when(own > 0, drawn >= own).otherwise(drawn <= own).cast("double"))
    return rows.groupBy(*ID).agg(
        F.first("mean_r").alias("mean_r"), beyond(F.col("m") - F.col("mean_r"), F.col("mean_r")).alias("p_mean"),
        F.first("ratio").alias("ratio"), beyond(ratio, F.col("ratio")).alias("p_ratio"),
        F.avg(ratio).alias("drawn_ratio"), F.stddev_pop("m").alias("drawn_sd"),
    )


def reality_check(series: DataFrame, simulations: int) -> DataFrame:
    """White's check: the best strategy's scaled mean against the maximum over strategies of centred bootstrap means.

    A pick is the place of a return in the strategy's own series, modulo its length: strategies of equal length are
    drawn at the same places, others at places of their own.
    """
    means = series.groupBy(*ID).agg(F.avg("r").alias("observed"), F.count(F.lit(1)).alias("n"))
    centred = series.join(means, ID).select(*ID, "i", (F.col("r") - F.col("observed")).alias("r"))
    sims = draw_stats(centred, simulations).groupBy("sim").agg(F.max(F.col("m") * F.sqrt("n")).alias("v"))
    best = means.agg(F.max(F.col("observed") * F.sqrt("n")).alias("best"))
    return sims.join(F.broadcast(best)).agg(F.first("best").alias("best"), F.avg((F.col("v") >= F.col("best")).cast("double")).alias("p"))


def parametric_draws(series: DataFrame, simulations: int, seed: int = 7) -> DataFrame:
    """Paths of normal returns with the mean and deviation of each series (strategy_id, sim, step, r), by Box and Muller
    from the hash of (seed, simulation, step)."""
    fitted = series.groupBy(*ID).agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean_r"), F.stddev_samp("r").alias("sd_r"))
    grid = fitted.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(simulations - 1)))).withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    u, v = ((_pick(F.col("sim"), F.col("step"), seed, word) + 0.5) / 2.0**32 for word in (0, 1))
    return grid.select(*ID, F.expr(f"sim div {CHUNK}").cast("int").alias("chunk"), "sim", "step", (F.col("mean_r") + F.col("sd_r") * F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)).alias("r"))


def paths(drawn: DataFrame, start: float) -> DataFrame:
    """Equity paths of drawn returns: strategy_id, sim, step, value. A return of -1 or less ends a path at 0."""
    order = Window.partitionBy(*ID, "chunk", "sim").orderBy("step")
    grown = F.exp(F.sum(F.log1p(F.when(F.col("r") > -1, F.col("r")).otherwise(0.0))).over(order))
    ruined = F.max(F.col("r") <= -1).over(order)
    return drawn.withColumn("value", F.when(ruined, 0.0).otherwise(F.lit(start) * grown))


def simulated_paths(series: DataFrame, simulations: int, start: float, block: int = 1, seed: int = 7) -> DataFrame:
    """Equity paths of bootstrap draws: strategy_id, sim, step, r, value."""
    return paths(draws(series, simulations, seed, block), start)


def bands(paths: DataFrame, lower: float = 0.05, upper: float = 0.95) -> DataFrame:
    """Percentiles of the simulations' values at each step, interpolated between neighbours."""
    held = paths.groupBy(*ID, "step").agg(F.sort_array(F.collect_list("value")).alias("_v"))
    last = F.size("_v") - 1

    def at(share: float) -> Column:
        place = share * last
        low = F.get("_v", F.floor(place).cast("int"))
        return low + (F.get("_v", F.ceil(place).cast("int")) - low) * (place - F.floor(place))

    return held.select(*ID, "step", at(lower).alias("lower"), at(0.5).alias("median"), at(upper).alias("upper"))


def outcome(simulated: DataFrame, start: float, series: DataFrame) -> DataFrame:
    """Final values of the simulations: share of wins, probability of loss, moments, and drawdowns; and the return of
    the series itself in per cent, with the percentage of simulations that end below it."""
    order = Window.partitionBy(*ID, "chunk", "sim").orderBy("step")
    top = F.greatest(F.max("value").over(order), F.lit(start))
    ends = simulated.withColumn("_dd", 1 - F.col("value") / top).groupBy(*ID, "chunk", "sim").agg(F.max_by("value", "step").alias("final"), F.max("_dd").alias("dd"))
    ends = ends.join(series.groupBy(*ID).agg((F.exp(F.sum(F.log1p("r"))) - 1).alias("_own")), ID)
    return ends.groupBy(*ID).agg(
        F.avg((F.col("final") > start).cast("double")).alias("win_rate"), F.avg((F.col("final") <= start).cast("double")).alias("p_loss"),
        F.avg("final").alias("mean_final"), F.percentile("final", 0.5).alias("median_final"), F.min("final").alias("min_final"), F.max("final").alias("max_final"),
        F.stddev_pop("final").alias("sd_final"), F.avg("dd").alias("mean_dd"), F.percentile("dd", 0.5).alias("median_dd"), F.max("dd").alias("worst_dd"),
        (100 * F.first("_own")).alias("original_return"), (100 * F.avg((F.col("final") / start - 1 < F.col("_own")).cast("double"))).alias("percentile"),
    )
