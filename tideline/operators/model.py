"""Temporal response functions: one Arrow task a series, block statistics inside."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import trf
from tideline.functions.trf import Options


def joined(stimulus: DataFrame, response: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t, x array, y array): the inner join on time is the truncation to the shortest."""
    return stimulus.select(*keys, "t", "x").join(response.select(*keys, "t", "y"), [*keys, "t"])


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    pdf = pdf.sort_values("t")
    cut = lambda c: np.stack([np.atleast_1d(np.asarray(v, float)) for v in pdf[c]])
    return cut("x"), cut("y")


def _schema(df: DataFrame, keys: list[str], rest: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*(f"{k} {kinds[k]}" for k in keys), rest])


def _own(pdf: pd.DataFrame, keys: list[str], out: pd.DataFrame) -> pd.DataFrame:
    for k in keys:
        out[k] = pdf[k].iloc[0]
    return out


def fit(data: DataFrame, keys: list[str], alpha: float | str, o: Options) -> DataFrame:
    """(keys, fold, channel, r, w array): feature-major weights. ``alpha`` is a number or a column."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = _arrays(pdf)
        w, r = trf.fit(x, y, float(pdf[alpha].iloc[0]) if isinstance(alpha, str) else alpha, o)
        k, c = r.shape
        out = pd.DataFrame({"fold": np.repeat(np.arange(k), c), "channel": np.tile(np.arange(c), k), "r": r.ravel()})
        out["w"] = [w[i, :, j] for i in range(k) for j in range(c)]
        return _own(pdf, keys, out)

    return data.groupBy(*keys).applyInPandas(run, _schema(data, keys, "fold int, channel int, r double, w array<double>"))


def weights_long(fits: DataFrame, keys: list[str], o: Options) -> DataFrame:
    """(keys, fold, channel, feature, delay, w) from feature-major weights."""
    n, delays = len(o.delays), F.array(*map(F.lit, o.delays))
    flat = fits.select(*keys, "fold", "channel", F.posexplode("w").alias("i", "w"))
    return flat.select(*keys, "fold", "channel", F.floor(F.col("i") / n).cast("int").alias("feature"), F.get(delays, F.col("i") % n).alias("delay"), "w")


def sweep(data: DataFrame, keys: list[str], alphas: list[float], o: Options) -> DataFrame:
    """(keys, alpha, r, r_std, r_train, trf array): fold means of the validation and training scores."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = _arrays(pdf)
        val, tra, mean = trf.sweep(x, y, np.array(alphas), o)
        keep = lambda a: pd.DataFrame(a).mean().fillna(0.0).to_numpy()
        out = pd.DataFrame({"alpha": alphas, "r": keep(val), "r_std": pd.DataFrame(val).std(ddof=0).fillna(0.0), "r_train": keep(tra)})
        out["trf"] = [pd.DataFrame(mean[:, i]).mean().to_numpy() for i in range(len(alphas))]
        return _own(pdf, keys, out)

    return data.groupBy(*keys).applyInPandas(run, _schema(data, keys, "alpha double, r double, r_std double, r_train double, trf array<double>"))


def null_scores(data: DataFrame, keys: list[str], alpha: float, o: Options, times: int, seed: int = 42, chunk: int = 50) -> DataFrame:
    """(keys, permutation, fold, channel, r): the permutations of a series are dealt over tasks."""
    dealt = data.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit((times - 1) // chunk))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = _arrays(pdf)
        c = int(pdf["_chunk"].iloc[0])
        n = min(chunk, times - c * chunk)
        r = trf.permuted_scores(x, y, alpha, o, n, seed + c)
        i, k, j = (a.ravel() for a in np.indices(r.shape))
        return _own(pdf, keys, pd.DataFrame({"permutation": i + c * chunk, "fold": k, "channel": j, "r": r.ravel()}))

    return dealt.groupBy(*keys, "_chunk").applyInPandas(run, _schema(data, keys, "permutation int, fold int, channel int, r double"))


def p_values(observed: DataFrame, null: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p): share of null scores above the observed one, one added to both counts."""
    both = null.select(*keys, F.col("r").alias("r0")).join(observed.select(*keys, "r"), keys)
    return both.groupBy(*keys).agg(((F.count_if(F.col("r0") > F.col("r")) + 1) / (F.count("*") + 1)).alias("p"))


def select_alpha(curve: DataFrame, keys: list[str], tolerance: float = 0.02, default: float = 1.0) -> DataFrame:
    """(keys, alpha): the largest alpha whose score is within ``tolerance`` of the best; a best of 0 gives the default."""
    best = F.max("r").over(Window.partitionBy(*keys))
    near = F.abs(F.try_divide(F.col("best") - F.col("r"), F.col("best"))) < tolerance
    return curve.withColumn("best", best).groupBy(*keys).agg(F.coalesce(F.max(F.when(near, F.col("alpha"))), F.lit(default)).alias("alpha"))


def median_alpha(store: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, alpha): ten to the median of the exponents."""
    return store.groupBy(*keys).agg(F.pow(F.lit(10.0), F.median(F.log10("alpha"))).alias("alpha"))


def nearest_alpha(grid: DataFrame, alpha: Column, keys: list[str] | None = None) -> DataFrame:
    """(keys, i, alpha): the grid value nearest to ``alpha`` and its index, the lower index on ties;
    grid is (keys, i, alpha)."""
    near = F.struct(F.abs(F.col("alpha") - alpha), F.col("i"))
    return grid.groupBy(*(keys or [])).agg(F.min_by(F.struct("i", "alpha"), near).alias("n")).select(*(keys or []), "n.i", "n.alpha")


def selection_curves(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Score, relative gap, penalised score and its normalised form, for each alpha."""
    w = Window.partitionBy(*keys)
    gap = F.greatest(F.lit(0.0), F.col("r_train") - F.col("r"))
    unit = F.try_divide(F.col("r") - F.min("r").over(w), F.max("r").over(w) - F.min("r").over(w))
    out = curve.withColumn("gap_percent", 100 * F.try_divide(F.col("r") - F.col("r_train"), F.col("r_train")))
    return out.withColumn("penalised", F.col("r") - 1.5 * gap).withColumn("normalised", unit - 1.5 * gap / (F.max(gap).over(w) + 1e-10))


def run_analysis(data: DataFrame, keys: list[str], alphas: DataFrame | None, o: Options, default: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(correlations, trfs) of every cell: fold means, NaN folds left out; a missing alpha is the default."""
    from tideline.operators.reduce import fold_mean

    full = data.withColumn("alpha", F.lit(default)) if alphas is None else data.join(alphas, keys, "left").fillna({"alpha": default})
    fits = fit(full, keys, "alpha", o)
    trfs = fold_mean(weights_long(fits, keys, o), [*keys, "channel", "feature", "delay"], "w", fill=False).drop("w_std")
    return fold_mean(fits, [*keys, "channel"], "r", fill=True), trfs


def select(data: DataFrame, keys: list[str], alphas: list[float], o: Options, tolerance: float = 0.02) -> DataFrame:
    """(keys, alpha): the sweep, then the rule."""
    return select_alpha(sweep(data, keys, alphas, replace(o)), keys, tolerance)
