"""Time-series operators as window expressions.

Each takes the columns that name a series (``keys``), order it and hold its
value; missing values are NULL.  Windows are partitioned by series, so a series
is sorted once and operators over the same keys share its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _over(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def middle(values: Column) -> Column:
    """Median of an array without NULLs and of odd length."""
    ordered = F.sort_array(values)
    return F.get(ordered, F.floor(F.size(values) / 2).cast("int"))


def hampel(df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "filtered", *, size: int = 7, sigmas: float = 2.0) -> DataFrame:
    """Outliers replaced by the median of a centred window of the unfiltered values.

    The first and last ``size // 2`` rows, windows with a missing value and
    windows without spread are left alone.
    """
    half = size // 2
    frame = _over(keys, order).rowsBetween(-half, half)
    window = F.collect_list(value).over(frame)
    rows = df.withColumn("_window", window).withColumn("_median", middle(F.col("_window")))
    rows = rows.withColumn("_spread", middle(F.transform("_window", lambda v: F.abs(v - F.col("_median")))))
    score = F.abs(F.try_divide(F.lit(0.6745) * (F.col(value) - F.col("_median")), F.col("_spread")))
    hit = (F.size("_window") == size) & (F.col("_spread") > 0) & (score > sigmas)
    return rows.withColumn(out, F.when(hit, F.col("_median")).otherwise(F.col(value))).drop("_window", "_median", "_spread")


def interpolate(df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "filled", *, most: int | None = None, zero_missing: bool = True) -> DataFrame:
    """Linear interpolation of gaps of up to ``most`` rows; series with four good values or fewer stay."""
    w = _over(keys, order)
    good = F.when(F.col(value) != 0, F.col(value)) if zero_missing else F.col(value)
    rows = df.withColumn("_i", F.row_number().over(w)).withColumn("_good", good)
    point = F.when(F.col("_good").isNotNull(), F.struct(F.col("_i").alias("i"), F.col("_good").alias("v")))
    rows = rows.withColumn("_a", F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_b", F.first(point, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("_n", F.count("_good").over(Window.partitionBy(*keys)))
    a, b = F.col("_a"), F.col("_b")
    filled = a["v"] + (b["v"] - a["v"]) * (F.col("_i") - a["i"]) / F.nullif(b["i"] - a["i"], F.lit(0))
    gap = b["i"] - a["i"] - 1
    inside = filled if most is None else F.when(gap <= most, filled)
    result = F.when(F.col("_n") <= 4, F.col(value)).when(F.col("_good").isNotNull(), F.col("_good")).otherwise(inside)
    return rows.withColumn(out, result).drop("_i", "_good", "_a", "_b", "_n")


def fill_ends(df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "filled", *, using: str = "last_value") -> DataFrame:
    """What is still missing: the last value, else the next, else zero; or zeros; or nothing."""
    w = _over(keys, order)
    if using == "zeros":
        return df.withColumn(out, F.coalesce(value, F.lit(0.0)))
    if using == "nan":
        return df.withColumn(out, F.col(value))
    back = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(out, F.coalesce(back, ahead, F.lit(0.0)))


def valid_runs(df: DataFrame, keys: list[str], order: list[str], valid: Column, *, shortest: int = 1, choose: str = "all") -> DataFrame:
    """Islands of consecutive valid rows: keys, first, last (row numbers from 0), length.

    ``choose`` keeps all of a series' runs, the ``largest`` (the first on ties),
    the ``first`` or the ``last``.
    """
    w = _over(keys, order)
    rows = df.select(*keys, (F.row_number().over(w) - 1).cast("long").alias("_i"), valid.alias("_valid")).filter("_valid")
    island = F.col("_i") - F.row_number().over(_over(keys, ["_i"]))
    found = rows.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min("_i").alias("first"), F.max("_i").alias("last"), F.count("*").alias("length")).drop("_island").filter(F.col("length") >= shortest)
    if choose == "all":
        return found
    by = {"largest": [F.desc("length"), F.asc("first")], "first": [F.asc("first")], "last": [F.desc("first")]}[choose]
    return found.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter("_rank = 1").drop("_rank")


def trim_to_run(df: DataFrame, keys: list[str], order: list[str], valid: Column, *, shortest: int = 1, choose: str = "largest") -> DataFrame:
    """The rows of each series inside its chosen run."""
    runs = valid_runs(df, keys, order, valid, shortest=shortest, choose=choose).select(*keys, "first", "last")
    numbered = df.withColumn("_i", F.row_number().over(_over(keys, order)) - 1)
    return numbered.join(runs, keys).filter("_i between first and last").drop("_i", "first", "last")


def missing_ranges(df: DataFrame, keys: list[str], frame: str, missing: Column, *, longest: int) -> DataFrame:
    """Ranges of missing frames as text: those of up to ``longest`` frames, and the longer ones."""
    rows = df.filter(missing).select(*keys, F.col(frame).alias("_f"))
    island = F.col("_f") - F.row_number().over(_over(keys, ["_f"]))
    found = rows.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min("_f").alias("a"), F.max("_f").alias("b"))
    text = F.struct("a", F.concat_ws(":", F.col("a").cast("string"), F.col("b").cast("string")).alias("t"))
    short = (F.col("b") - F.col("a") + 1) <= longest
    pick = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c, text))), lambda s: s["t"]), ", ")
    return found.groupBy(*keys).agg(pick(short).alias("interpolated"), pick(~short).alias("left_missing"))


def true_runs(df: DataFrame, keys: list[str], order: list[str], flag: Column) -> DataFrame:
    """Starts and last rows of runs of true values: keys, start, end (row numbers from 0)."""
    return valid_runs(df, keys, order, F.coalesce(flag, F.lit(False))).select(*keys, F.col("first").alias("start"), F.col("last").alias("end"))


def speed(df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "speed", *, missing_factor: float = 2.0) -> DataFrame:
    """Difference to the row before; where that is missing, ``missing_factor`` times the second row's difference."""
    w = _over(keys, order)
    rows = df.withColumn("_d", F.col(value) - F.lag(value).over(w)).withColumn("_i", F.row_number().over(w))
    second = F.max(F.when(F.col("_i") == 2, F.col("_d"))).over(Window.partitionBy(*keys))
    return rows.withColumn(out, F.coalesce("_d", second * missing_factor)).drop("_d", "_i")


def total_speed(df: DataFrame, keys: list[str], frame: str, marker: str, xyz: list[str]) -> DataFrame:
    """Per frame, the sum over markers of the distance moved since the marker's last frame; missing moves count as zero."""
    w = _over([*keys, marker], [frame])
    squares = sum((F.pow(F.col(c) - F.lag(c).over(w), 2) for c in xyz[1:]), F.pow(F.col(xyz[0]) - F.lag(xyz[0]).over(w), 2))
    return df.withColumn("_move", F.sqrt(squares)).groupBy(*keys, frame).agg(F.coalesce(F.sum("_move"), F.lit(0.0)).alias("speed"))


def lagged_correlation(df: DataFrame, keys: list[str], frame: str, x: str, y: str, lags: int) -> DataFrame:
    """Pearson correlation of x(f) with y(f - lag) for each lag in [-lags, lags); NULL without spread."""
    left = df.select(*keys, F.col(frame).alias("_f"), F.col(x).alias("_x"), F.explode(F.sequence(F.lit(-lags), F.lit(lags - 1))).alias("lag"))
    right = df.select(*keys, F.col(frame).alias("_g"), F.col(y).alias("_y"))
    joined = left.withColumn("_g", F.col("_f") - F.col("lag")).join(right, [*keys, "_g"]).filter("_x is not null and _y is not null")
    spread = (F.stddev_pop("_x") > 0) & (F.stddev_pop("_y") > 0)
    return joined.groupBy(*keys, "lag").agg(F.count("*").alias("n"), F.when(spread, F.corr("_x", "_y")).alias("r"))


def best_lag(correlations: DataFrame, keys: list[str]) -> DataFrame:
    """The lag of highest correlation of each series, the smallest on ties."""
    best = F.max(F.when(F.col("r").isNotNull(), F.struct("r", (-F.col("lag")).alias("m"))))
    return correlations.groupBy(*keys).agg(best.alias("_b")).select(*keys, (-F.col("_b")["m"]).alias("lag"), F.col("_b")["r"].alias("r"))


def trimmed_mean(df: DataFrame, keys: list[str], value: str, part: float, out: str = "trimmed_mean") -> DataFrame:
    """Mean of the sorted values from n*part/2 to n*(1 - part/2); the plain mean if none is left."""
    rows = df.filter(F.col(value).isNotNull())
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(value)) - 1
    rows = rows.select(*keys, value).withColumn("_i", rank).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    kept = (F.col("_i") >= F.floor(F.col("_n") * (part / 2))) & (F.col("_i") < F.floor(F.col("_n") * (1 - part / 2)))
    return rows.groupBy(*keys).agg(F.coalesce(F.avg(F.when(kept, F.col(value))), F.avg(value)).alias(out))


def weighted_window(df: DataFrame, keys: list[str], order: list[str], value: str, weights: list[float], out: str = "smoothed") -> DataFrame:
    """A short symmetric kernel as lag and lead terms, mirrored at the ends."""
    w, half = _over(keys, order), len(weights) // 2
    rows = df.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    total = F.lit(0.0)
    for k, weight in zip(range(-half, half + 1), weights, strict=True):
        if k < 0:  # row i + k, or its mirror image 1 - (i + k)
            mirrored = F.coalesce(*[F.when(F.col("_i") == i, F.lead(value, 1 - 2 * i - k).over(w)) for i in range(1, -k + 1)])
            term = F.when(F.col("_i") + k >= 1, F.lag(value, -k).over(w)).otherwise(mirrored)
        elif k > 0:
            mirrored = F.coalesce(*[F.when(F.col("_n") - F.col("_i") == j, F.lag(value, 2 * j - k + 1).over(w) if 2 * j - k + 1 >= 0 else F.lead(value, k - 1 - 2 * j).over(w)) for j in range(k)])
            term = F.when(F.col("_i") + k <= F.col("_n"), F.lead(value, k).over(w)).otherwise(mirrored)
        else:
            term = F.col(value)
        total = total + term * weight
    return rows.withColumn(out, total).drop("_i", "_n")


def running_median(df: DataFrame, keys: list[str], order: list[str], value: str, size: int = 3, out: str = "filtered") -> DataFrame:
    """Median of an odd window with zeros beyond the ends."""
    half = size // 2
    frame = _over(keys, order).rowsBetween(-half, half)
    window = F.collect_list(value).over(frame)
    padded = F.concat(window, F.array_repeat(F.lit(0.0), F.lit(size) - F.size(window)))
    return df.withColumn(out, middle(padded))


def desample(df: DataFrame, keys: list[str], frame: str, ratio: int) -> DataFrame:
    """Every ``ratio``-th row of a series, frames numbered anew from 0; other columns stay."""
    i = F.row_number().over(_over(keys, [frame])) - 1
    kept = df.withColumn("_i", i).filter(F.col("_i") % ratio == 0)
    return kept.withColumn(frame, F.floor(F.col("_i") / ratio).cast(df.schema[frame].dataType)).drop("_i")


def combine_by_position(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str], keys: list[str]) -> DataFrame:
    """Rows of two tables side by side by their position in each series, as far as both go."""
    left = a.withColumn("position", F.row_number().over(_over(keys, order_a)).cast("long"))
    right = b.withColumn("position", F.row_number().over(_over(keys, order_b)).cast("long"))
    return left.join(right, [*keys, "position"])


def unwrap(df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "unwrapped", *, period: float = 360.0) -> DataFrame:
    """Angles without jumps of more than half a period."""
    w = _over(keys, order)
    jump = F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(0.0))
    # Not pmod, which takes a rest just below zero for a whole period and turns it to zero.
    rest = (jump + period / 2) % period
    near = F.when(rest < 0, rest + period).otherwise(rest) - period / 2
    near = F.when((near == -period / 2) & (jump > 0), F.lit(period / 2)).otherwise(near)
    step = F.when(F.abs(jump) < period / 2, F.lit(0.0)).otherwise(near - jump)
    rows = df.withColumn("_step", step)
    return rows.withColumn(out, F.col(value) + F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def gradient(df: DataFrame, keys: list[str], time: str, value: str, out: str = "rate") -> DataFrame:
    """Second-order differences over uneven time, one-sided at the ends."""
    w = _over(keys, [time])
    before, after = F.col(time) - F.lag(time).over(w), F.lead(time).over(w) - F.col(time)
    dv0, dv1 = F.col(value) - F.lag(value).over(w), F.lead(value).over(w) - F.col(value)
    inner = (before * before * dv1 + after * after * dv0) / (before * after * (before + after))
    return df.withColumn(out, F.coalesce(inner, F.try_divide(dv1, after), F.try_divide(dv0, before)))


def in_range(df: DataFrame, frame: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Frames from ``first`` to ``last``, both included."""
    if first is not None:
        df = df.filter(F.col(frame) >= first)
    return df if last is None else df.filter(F.col(frame) <= last)


def common_range(df: DataFrame, keys: list[str], frame: str, shortest: bool = True) -> DataFrame:
    """Rows up to the frame that all series reach (or that the longest reaches)."""
    ends = df.groupBy(*keys).agg(F.max(frame).alias("_last"))
    end = ends.agg((F.min if shortest else F.max)("_last").alias("_end"))
    return df.join(F.broadcast(end), F.col(frame) <= F.col("_end")).drop("_end")  # one row


def likely(score: str, threshold: float, value: str, strict: bool = False) -> Column:
    """The value where its score reaches the threshold (or exceeds it, if ``strict``), else NULL."""
    return F.when(F.col(score) > threshold if strict else F.col(score) >= threshold, F.col(value))
