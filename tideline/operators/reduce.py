"""Reductions of scores and weights: fold means, field power, errors, peaks, similarity, order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.trf import crests, edges, leaf_order, thinned
from tideline.plans.scratch import drop, stored


def _no_nan(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c))


def fold_mean(df: DataFrame, keys: list[str], value: str, fill: bool) -> DataFrame:
    """(keys, <value>_mean, <value>_std): NaN folds are left out; all NaN gives 0 if ``fill``, else NaN."""
    rest = F.lit(0.0) if fill else F.lit(float("nan"))
    return df.groupBy(*keys).agg(F.coalesce(F.avg(_no_nan(value)), rest).alias(f"{value}_mean"), F.coalesce(F.stddev_pop(_no_nan(value)), rest).alias(f"{value}_std"))


def field_power(df: DataFrame, time: list[str], value: str) -> DataFrame:
    """Population deviation over channels at each time."""
    return df.groupBy(*time).agg(F.stddev_pop(value).alias("gfp"))


def mean_error(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, mean, sem): sample deviation over root n; null for one row."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"))


def find_peaks(df: DataFrame, keys: list[str], value: str, rate: float = 128.0, gap_s: float = 0.025, share: float = 0.1, t: str = "t", flat: bool = True) -> DataFrame:
    """(keys, t, value) of each series' peaks; flat tops count at their middle, or not at all.

    A series is cut in parts of about 4096 rows. A row for each part tells its neighbours where the
    runs of equal values at their ends begin and stop, so no task holds a series. A null is no value
    and no neighbour of a peak; a series with a NaN has none.
    """
    kinds, least = dict(df.dtypes), max(1, int(gap_s * rate))
    rows = stored(df.select(*keys, t, value), "series")
    spans = rows.groupBy(*keys).agg((F.max(t) - F.min(t)).cast("double").alias("span"), F.count("*").alias("n"))
    step = spans.agg(F.sum("span") / F.sum("n")).first()[0]
    # Rows without a time come last.
    dealt = rows.withColumn("_c", F.coalesce(F.floor(F.col(t) / (4096 * step if step else 1.0)), F.lit(2**62))).withColumn("_nan", F.isnan(value))
    named = ", ".join(f"{k} {kinds[k]}" for k in [*keys, t, value])
    own = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "_c long"])

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(t)[value].to_numpy(float)
        top = np.nan if pdf["_nan"].any() else np.fmax.reduce(x, initial=-np.inf)
        lead, after, trail, before = edges(x)
        return pdf[[*keys, "_c"]].iloc[:1].assign(n=len(x), top=top, first=x[0], last=x[-1], lead=lead, after=after, trail=trail, before=before)

    def found(pdf: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        pdf, p = pdf.sort_values(t), around.iloc[0]
        at = crests(pdf[value].to_numpy(float), share * p["top"], int(p["place"]), int(p["start"]), p["before"], int(p["stop"]), p["after"], flat)
        return pdf.iloc[at][[*keys, t, value]].assign(_i=at + int(p["place"]))

    parts = dealt.groupBy(*keys, "_c").applyInPandas(ends, own + ", n long, top double, first double, last double, lead long, after double, trail long, before double")
    around = parts.groupBy(*keys).applyInPandas(lambda pdf: _around(keys, pdf), own + ", place long, start long, before double, stop long, after double, top double")
    tops = dealt.groupBy(*keys, "_c").cogroup(around.groupBy(*keys, "_c")).applyInPandas(found, named + ", _i long")
    if least <= 2:  # two peaks have a lower row between them
        return tops.select(*keys, t, value)
    was, tops, size = rows, tops.withColumn("_open", F.lit(True)), max(8192, 64 * least)
    while True:
        tops = stored(_thin(tops, keys, value, least, size, f"{named}, _i long, _open boolean"), "peaks")
        drop(was)
        if tops.where("_open").isEmpty():
            return tops.select(*keys, t, value)
        was, size = tops, max(1 << 22, size)


def _around(keys: list[str], pdf: pd.DataFrame) -> pd.DataFrame:
    """What a series has around each of its parts: the place of a part, the run of equal values that it
    begins in (its start, the value before it) and ends in, also where they cross parts."""
    pdf = pdf.sort_values("_c")
    c = {name: pdf[name].tolist() for name in ("n", "first", "last", "lead", "after", "trail", "before")}
    size, total = len(pdf), 0
    place, start, before, stop, after = ([0] * size for _ in range(5))
    run, value, outer = 0, np.nan, np.nan  # the last run so far: its start, its value, the value before it
    for i in range(size):
        place[i] = total
        start[i], before[i] = (run, outer) if c["first"][i] == value else (total, value)
        total += c["n"][i]
        whole = c["lead"][i] == c["n"][i]
        run, value, outer = (start[i], c["last"][i], before[i]) if whole else (total - c["trail"][i], c["last"][i], c["before"][i])
    run, value, outer = 0, np.nan, np.nan
    for i in reversed(range(size)):
        stop[i], after[i] = (run, outer) if c["last"][i] == value else (place[i] + c["n"][i] - 1, value)
        whole = c["lead"][i] == c["n"][i]
        run, value, outer = (stop[i], c["first"][i], after[i]) if whole else (place[i] + c["lead"][i] - 1, c["first"][i], c["after"][i])
    return pdf[[*keys, "_c"]].assign(place=place, start=start, before=before, stop=stop, after=after, top=np.max(pdf["top"].to_numpy(float)))


def _thin(tops: DataFrame, keys: list[str], value: str, least: int, size: int, schema: str) -> DataFrame:
    """Peaks (.., _i) that stay, and as ``_open`` those that hang on a chain of ever higher peaks, each
    nearer than ``least`` to the next, that leaves their part of ``size`` rows and its halo. The rest,
    given again, is thinned to the same peaks, and at least the highest open one is settled."""
    halo = 32 * least
    near = F.sequence(F.greatest(F.lit(0), F.floor((F.col("_i") - halo) / size)), F.floor((F.col("_i") + halo) / size))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        c, at = int(pdf["_c"].iloc[0]), pdf["_i"].to_numpy()
        state = thinned(at, pdf[value].to_numpy(float), least, c * size - halo if c else -np.inf, (c + 1) * size + halo, ~pdf["_open"].to_numpy(bool))
        mine = (at // size == c) & (state >= 0)
        return pdf[mine].drop(columns="_c").assign(_open=state[mine] == 0)

    return tops.withColumn("_c", F.explode(near)).groupBy(*keys, "_c").applyInPandas(run, schema)


def similarity(df: DataFrame, keys: list[str], member: str, position: str, value: str) -> DataFrame:
    """(keys, similarity): mean absolute correlation over pairs of members; constant members count for nothing."""
    a = df.select(*keys, F.col(member).alias("a"), position, F.col(value).alias("x"))
    b = df.select(*keys, F.col(member).alias("b"), position, F.col(value).alias("y"))
    pairs = a.join(b, [*keys, position]).where("a > b").groupBy(*keys, "a", "b")
    r = F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))
    return pairs.agg(F.abs(r).alias("r")).groupBy(*keys).agg(F.avg("r").alias("similarity"))


def cluster_order(df: DataFrame, keys: list[str], row: str, values: str) -> DataFrame:
    """(keys, position, row): the rows of each small matrix in order of single linkage."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row)
        order = leaf_order(np.stack(pdf[values].map(lambda v: np.asarray(v, float))))
        out = pd.DataFrame({"position": np.arange(len(order)), row: pdf[row].to_numpy()[order]})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out

    return df.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "position int", f"{row} {kinds[row]}"]))


def map_rule(df: DataFrame, keys: list[str], value: str, least: float = 0.001) -> DataFrame:
    """(keys, skip): whether a channel map is constant or mostly near zero, and not worth drawing."""
    flat = F.coalesce(F.stddev_pop(value), F.lit(0.0)) == 0
    return df.groupBy(*keys).agg((flat | (F.avg((F.abs(value) < least).cast("int")) > 0.5)).alias("skip"))
