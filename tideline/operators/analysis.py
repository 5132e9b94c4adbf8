"""The whole analysis: a grid of cells, their stored results, and the tables behind the figures.

A cell is (band, attribute, side, subject). Results are Parquet, partitioned by band, attribute and
side, so a run writes only the cells it computed and a reload prunes to the cells it asks for.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.signal import _hertz, _mel
from tideline.functions.trf import Options
from tideline.operators import model, reduce, series
from tideline.plans.scratch import stored

CELL = ["band", "attribute", "side", "subject"]

# The channels of a 64-channel cap in its order.
CHANNELS = (
    "Fp1 AF7 AF3 F1 F3 F5 F7 FT7 FC5 FC3 FC1 C1 C3 C5 T7 TP7 CP5 CP3 CP1 P1 P3 P5 P7 P9 PO7 PO3 O1 Iz Oz POz Pz CPz "
    "Fpz Fp2 AF8 AF4 AFz Fz F2 F4 F6 F8 FT8 FC6 FC4 FC2 FCz Cz C2 C4 C6 T8 TP8 CP6 CP4 CP2 P2 P4 P6 P8 P10 PO8 PO4 O2"
).split()


def channels(spark: SparkSession) -> DataFrame:
    """(channel, name): the channel dimension."""
    return spark.createDataFrame(list(enumerate(CHANNELS)), "channel int, name string")


def select_channels(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows of the named channels, with ``name``; an unknown name is an error."""
    if unknown := sorted(set(names) - set(CHANNELS)):
        raise ValueError(f"unknown channels {unknown}")
    return df.join(F.broadcast(channels(df.sparkSession).where(F.col("name").isin(names))), "channel")


def feature_names(spark: SparkSession, attribute: str, n: int, phonemes: list[str] | None = None) -> DataFrame:
    """(feature, label): centre frequencies of a spectrogram's bands up to 8 kHz, phonemes, or numbers."""
    if attribute == "Spectrogram":
        labels = [str(int(x)) for x in _hertz(np.linspace(0, _mel(np.array(8000.0)), n + 2))[1:-1]]
    elif attribute == "Phonemes" and phonemes:
        labels = list(phonemes)[:n]
    else:
        labels = [str(i + 1) for i in range(n)]
    return spark.createDataFrame(list(enumerate(labels)), "feature int, label string")


def complete_join(left: DataFrame, right: DataFrame, on: list[str], what: str) -> DataFrame:
    """The inner join; a row of ``left`` without a partner is an error when it is read."""
    found = right.withColumn("_found", F.lit(True))
    joined = left.join(found, on, "left")
    named = F.concat_ws(", ", *(F.col(c).cast("string") for c in on))
    checked = F.when(F.col("_found"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"no {what} for "), named)).cast("boolean"))
    return joined.where(checked).drop("_found")


def save(results: DataFrame, path: str) -> None:
    """Write the cells of ``results`` (band, attribute, side, ...) over those of the same partition."""
    by = CELL[:3]
    results.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def reload(spark: SparkSession, path: str, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Stored results on the grid; a cell without any has nulls."""
    return grid.join(spark.read.option("basePath", path).parquet(path), keys, "left")


def run(data: DataFrame, grid: DataFrame, path: str, o: Options, alphas: DataFrame | None = None) -> DataFrame:
    """Computes the cells of ``grid`` that ``path`` lacks and gives all cells' correlations.

    ``data`` is (cell, t, x array, y array); ``alphas`` (cell, alpha), a missing one is the default.
    Stores correlations (cell, channel, r_mean, r_std) and trfs (cell, channel, feature, delay, w_mean).
    A cell without data stays null. Parts of a partition that were there are written again with it.
    """
    spark = data.sparkSession
    names = ["correlations", "trfs"]
    done = [_stored(spark, f"{path}/{n}") for n in names]
    todo = grid if done[0] is None else stored(series.pending(grid, done[0].select(*CELL).distinct(), CELL), "cells")
    parts = todo.select(*CELL[:3]).distinct()
    made = []
    for name, was, new in zip(names, done, model.run_analysis(data.join(todo, CELL), CELL, alphas, o), strict=True):
        kept = new if was is None else new.unionByName(was.join(parts, CELL[:3]).select(*new.columns))
        made.append(stored(kept, name))
    for name, table in zip(names, made, strict=True):  # what is read above is written over here
        save(table, f"{path}/{name}")
    return reload(spark, f"{path}/correlations", grid, CELL)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.parquet(path) if there else None


# -- tables behind the figures


def channel_curves(trfs: DataFrame, keys: list[str], value: str = "w_mean") -> DataFrame:
    """(keys, channel, delay, w): mean over the features and whatever ``keys`` leave out."""
    return trfs.groupBy(*keys, "channel", "delay").agg(F.avg(value).alias("w"))


def feature_map(trfs: DataFrame, keys: list[str], value: str = "w_mean") -> DataFrame:
    """(keys, feature, delay, w): mean over the channels and whatever ``keys`` leave out."""
    return trfs.groupBy(*keys, "feature", "delay").agg(F.avg(value).alias("w"))


def evoked(trfs: DataFrame, keys: list[str], rate: float = 128.0, value: str = "w_mean") -> DataFrame:
    """(keys, delay, mean, sem, gfp, peak): over channels at each delay, and whether the power peaks there."""
    curves = channel_curves(trfs, keys, value)
    at = [*keys, "delay"]
    table = reduce.mean_error(curves, at, "w").join(reduce.field_power(curves, at, "w"), at)
    found = reduce.find_peaks(table.withColumn("_all", F.lit(0)), [*keys, "_all"], "gfp", rate, t="delay").select(*at, F.lit(True).alias("peak"))
    return table.join(found, at, "left").fillna({"peak": False})


def heat_map(trfs: DataFrame, keys: list[str], cluster: bool = False, value: str = "w_mean") -> DataFrame:
    """(keys, feature, position, delay, w, mean, sem): the feature map, its rows in order of single
    linkage or as they are (all-zero rows have no position there), with mean and error over the features."""
    full = feature_map(trfs, keys, value)
    curve = reduce.mean_error(full, [*keys, "delay"], "w")
    if cluster:
        rows = full.groupBy(*keys, "feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("delay", "w"))), lambda x: x["w"]).alias("row"))
        full = full.join(reduce.cluster_order(rows.withColumn("_all", F.lit(0)), [*keys, "_all"], "feature", "row").drop("_all"), [*keys, "feature"], "left")
    else:
        full = full.withColumn("position", F.col("feature").cast("int"))
    return full.join(curve, [*keys, "delay"])
