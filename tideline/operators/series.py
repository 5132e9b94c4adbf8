"""Series as rows (keys..., t, value or array): grids, alignment, lags, folds, scaling, filters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPS = 1e-12


def _over(keys: list[str], order: str | None = None):
    w = Window.partitionBy(*keys)
    return w.orderBy(order) if order else w


def param_grid(spark: SparkSession, **dims: list) -> DataFrame:
    """The cross product of small dimensions, a column for each.

    A cross join has a task for each pair of its sides' partitions, so a dimension is one partition."""
    out = None
    for name, values in dims.items():
        one = spark.createDataFrame([(v,) for v in values], [name]).coalesce(1)
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out


def fill_default(grid: DataFrame, store: DataFrame, keys: list[str], value: str, default) -> DataFrame:
    """Every cell of the grid with its stored value, or the default."""
    return grid.join(store.select(*keys, value), keys, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def pending(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of the grid without a result."""
    return grid.join(done, keys, "left_anti")


def dense(series: DataFrame, n: int, value: str, default: float = 0.0) -> DataFrame:
    """(t, value) for t = 0..n-1; missing places get the default."""
    return fill_default(series.sparkSession.range(n).withColumnRenamed("id", "t"), series, ["t"], value, default)


def select_side(signal: Column, side: str) -> Column:
    """One track of a (left, right) array, or the mean of all tracks."""
    if side in ("left", "right"):
        return F.element_at(signal, 1 if side == "left" else 2)
    if side != "mono":
        raise ValueError(f"unknown side {side!r}")
    return F.aggregate(signal, F.lit(0.0), lambda a, x: a + x) / F.size(signal)


def lag_window(df: DataFrame, value: str, delays: list[int], keys: list[str], t: str = "t") -> DataFrame:
    """(keys, t, d, x[t - d]) for few delays, in SQL windows; 0 outside the series."""
    w = _over(keys, t)
    cols = [F.struct(F.lit(d).alias("d"), (F.lag(value, d, 0.0) if d >= 0 else F.lead(value, -d, 0.0)).over(w).alias("x")) for d in delays]
    return df.select(*keys, t, F.array(*cols).alias("l")).select(*keys, t, F.inline("l"))


def lag_features(df: DataFrame, value: str, delays: list[int], keys: list[str], t: str = "t", rows: DataFrame | None = None) -> DataFrame:
    """(keys, t, x array): all lags of a row, feature-major, for many delays.

    ``value`` is a number or an array of features. Each series is cut in time chunks with a
    halo of the largest delay, so a long series is many tasks. ``rows`` (keys, t) keeps only
    those rows, after lagging.
    """
    from tideline.functions.trf import lagged

    halo, chunk = max((abs(d) for d in delays), default=0), 65_536
    bounds = df.groupBy(*keys).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi")) if keys else df.agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    full = df.join(bounds, keys) if keys else df.crossJoin(bounds)
    first, last = F.floor(F.col("_lo") / chunk), F.floor(F.col("_hi") / chunk)
    near = F.sequence(F.greatest(first, F.floor((F.col(t) - halo) / chunk)), F.least(last, F.floor((F.col(t) + halo) / chunk)))
    dealt = full.withColumn("_chunk", F.explode(near))
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{t} {kinds[t]}", "x array<double>"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        at = pdf[t].to_numpy()
        x = np.stack([np.atleast_1d(np.asarray(v, float)) for v in pdf[value]])
        wide = np.zeros((int(at[-1] - at[0]) + 1, x.shape[1]))
        wide[at - at[0]] = x
        own = at // chunk == pdf["_chunk"].iloc[0]
        out = pdf.loc[own, [*keys, t]].copy()
        out["x"] = pd.Series(list(lagged(wide, np.array(delays))[(at - at[0])[own]]), index=out.index, dtype=object)
        return out

    out = dealt.groupBy(*keys, "_chunk").applyInPandas(run, schema)
    return out if rows is None else out.join(rows.select(*keys, t), [*keys, t], "left_semi")


def live_rows(df: DataFrame, x: str = "x") -> DataFrame:
    """Rows whose lag vector isn't all zero."""
    return df.where(F.exists(x, lambda v: v != 0))


def kfold(df: DataFrame, k: int, keys: list[str], t: str = "t") -> DataFrame:
    """Contiguous folds 0..k-1 of each series."""
    return df.withColumn("fold", F.ntile(k).over(_over(keys, t)) - 1)


def inner_split(df: DataFrame, keys: list[str], k: int, share: float = 0.8, cutoff: str = "all", t: str = "t", live: str = "live") -> DataFrame:
    """(.., test_fold, part): the first ``share`` of a fold's training rows train, the rest validate.
    The cutoff counts all training rows, or the live ones; only live rows are dealt."""
    folds = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    rows = df.withColumn("test_fold", folds).where("fold <> test_fold")
    w = _over([*keys, "test_fold"])
    total = F.count("*").over(w) if cutoff == "all" else F.count_if(F.col(live)).over(w)
    rows = rows.withColumn("_cut", F.floor(total * share)).where(F.col(live))
    nth = F.row_number().over(_over([*keys, "test_fold"], t))
    return rows.withColumn("part", F.when(nth <= F.col("_cut"), "train").otherwise("validate")).drop("_cut")


def standardize(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(x - mean) / (population deviation + eps), by the series' own statistics."""
    w = _over(keys)
    return df.withColumn(value, (F.col(value) - F.avg(value).over(w)) / (F.stddev_pop(value).over(w) + EPS))


def standardize_by_fold(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Each row scaled by the statistics of the other folds of its series, from sums a fold."""
    x = F.col(value)
    part = df.groupBy(*keys, "fold").agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    other = part.select(*keys, F.col("fold").alias("_f"), "n", "m", "v")
    pairs = (part.select(*keys, "fold").join(other, keys) if keys else part.select("fold").crossJoin(other)).where("fold <> _f")
    mean = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    square = F.sum(F.col("n") * (F.col("v") + F.col("m") * F.col("m"))) / F.sum("n")
    stats = pairs.groupBy(*keys, "fold").agg(mean.alias("_mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("_sd"))
    return df.join(stats, [*keys, "fold"]).withColumn(value, (x - F.col("_mean")) / (F.col("_sd") + EPS)).drop("_mean", "_sd")


def normalize(df: DataFrame, value: str, keys: list[str], to: str = "1") -> DataFrame:
    """(x - min) / (range + eps); kind '2' maps to [-1, 1]."""
    w = _over(keys)
    unit = (F.col(value) - F.min(value).over(w)) / (F.max(value).over(w) - F.min(value).over(w) + EPS)
    return df.withColumn(value, unit * 2 - 1 if to == "2" else unit)


def normalize_percent(df: DataFrame, value: str, keys: list[str], percent: int = 5) -> DataFrame:
    """Scaled by the n-th smallest and n-th largest value, n = int((percent * rows - 1) / 100)."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_rows")) if keys else df.agg(F.count("*").alias("_rows"))
    n = F.floor((percent * F.col("_rows") - 1) / 100)
    full = df.join(counts, keys) if keys else df.crossJoin(counts)
    ranked = full.withColumn("_up", F.row_number().over(_over(keys, value)))
    low = F.max(F.when(F.col("_up") == n + 1, F.col(value)))
    high = F.max(F.when(F.col("_up") == F.col("_rows") - n, F.col(value)))
    stats = (ranked.groupBy(*keys) if keys else ranked.groupBy()).agg(low.alias("_lo"), high.alias("_hi"))
    out = df.join(stats, keys) if keys else df.crossJoin(stats)
    return out.withColumn(value, (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + EPS)).drop("_lo", "_hi")


def align(df: DataFrame, group: list[str], member: str, t: str = "t") -> DataFrame:
    """Rows of each group up to its shortest member's length."""
    sizes = df.groupBy(*group, member).agg(F.count("*").alias("_n")).groupBy(*group).agg(F.min("_n").alias("_n"))
    return df.join(sizes, group).where(F.col(t) < F.col("_n")).drop("_n")


def trim_tail(df: DataFrame, keys: list[str], delay: int, t: str = "t") -> DataFrame:
    """Drop the last ``delay`` rows of each series; a negative delay is an error."""
    if delay < 0:
        raise ValueError("delay must not be negative")
    return df.withColumn("_n", F.count("*").over(_over(keys))).where(F.col(t) < F.col("_n") - delay).drop("_n") if delay else df


def concat_segments(df: DataFrame, keys: list[str], segment: str, t: str = "t", first: int | None = None) -> DataFrame:
    """A global index over the segments in numeric order; at most the ``first`` segments."""
    rows = df
    if first is not None:
        ranked = df.withColumn("_r", F.dense_rank().over(Window.partitionBy(*keys).orderBy(segment)))
        rows = ranked.where(F.col("_r") <= first).drop("_r")
    return rows.withColumn("index", F.row_number().over(Window.partitionBy(*keys).orderBy(segment, t)) - 1)


def fir(df: DataFrame, value: str, taps: list[float], keys: list[str], t: str = "t") -> DataFrame:
    """Causal convolution with few taps, zero before the series."""
    w = _over(keys, t)
    return df.withColumn(value, sum((F.lag(value, i, 0.0).over(w) * float(c) for i, c in enumerate(taps)), F.lit(0.0)))


def by_series(df: DataFrame, keys: list[str], value: str, run: Callable[[np.ndarray], np.ndarray], t: str = "t") -> DataFrame:
    """A numpy kernel over each whole series in order of t; (keys, t, value or array) out."""
    kinds = dict(df.dtypes)
    probe = np.asarray(run(np.linspace(0.0, 1.0, 2048)))
    kind = "double" if probe.ndim == 1 else "array<double>"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        y = np.asarray(run(pdf.sort_values(t)[value].to_numpy(float)))
        out = pd.DataFrame({k: [pdf[k].iloc[0]] * len(y) for k in keys}, index=range(len(y)))
        out[t] = np.arange(len(y), dtype=np.int64)
        out[value] = list(y) if y.ndim > 1 else y
        return out

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{t} long", f"{value} {kind}"])
    return df.select(*keys, t, value).groupBy(*keys).applyInPandas(one, schema)


def decimate(df: DataFrame, value: str, keys: list[str], every: int, t: str = "t") -> DataFrame:
    """Means over blocks of ``every`` samples; a trailing partial block is dropped."""
    block = df.groupBy(*keys, F.floor(F.col(t) / every).alias(t)).agg(F.avg(value).alias(value), F.count("*").alias("_n"))
    return block.where(F.col("_n") == every).drop("_n")
