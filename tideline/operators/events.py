"""Events and intervals: edges, gaps, crops, masks, phones, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rising_edges(df: DataFrame, flag: Column, keys: list[str], order: list[str]) -> DataFrame:
    """Rows where the flag becomes true; a series that begins with it has no edge there."""
    before = F.lag("_flag").over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_flag", flag).withColumn("_before", before).where("_flag and not _before").drop("_flag", "_before")


def gaps(samples: DataFrame, tasks: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    """(keys, onset, offset): times outside all tasks (onset <= time < offset).

    An inner gap begins at the last sample of the task before it, as a forward difference
    finds it; one at the very begin starts with the first sample.
    """
    kind = dict(samples.dtypes)[time]
    # A running count of open tasks over samples and borders in turn: no join, whatever their numbers.
    borders = tasks.where("onset < offset").select(*keys, F.inline(F.array(F.struct(F.col("onset").alias(time), F.lit(1).alias("step")), F.struct(F.col("offset").alias(time), F.lit(-1).alias("step")))))
    rows = samples.select(*keys, time).distinct().withColumn("step", F.lit(0)).withColumn("_sample", F.lit(True))
    rows = rows.unionByName(borders.withColumn("_sample", F.lit(False)))
    before = Window.partitionBy(*keys).orderBy(time, "_sample").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("busy", F.sum("step").over(before) > 0).where("_sample").select(*keys, F.col(time).cast(kind).alias(time), "busy")
    w = Window.partitionBy(*keys).orderBy(time)
    steps = marked.withColumn("_was", F.lag("busy").over(w)).withColumn("_prior", F.lag(time).over(w))
    steps = steps.withColumn("_run", F.sum(F.when(F.col("busy") != F.col("_was"), 1).otherwise(0)).over(w))
    free = steps.where("not busy").groupBy(*keys, "_run").agg(F.coalesce(F.min_by("_prior", time), F.min(time)).alias("onset"), F.max(time).alias("offset"))
    return free.drop("_run")


def crop(series: DataFrame, intervals: DataFrame, keys: list[str], t: str = "t", width: float | None = None) -> DataFrame:
    """Samples within an interval (onset <= t < onset + duration), with the interval's columns.

    With ``width`` both sides are cut in buckets of that many units first, so the range
    condition becomes an equi-join; without it the intervals should be few.
    """
    i = intervals.withColumn("_end", F.col("onset") + F.col("duration"))
    if width is None:
        cond = (F.col(f"s.{t}") >= F.col("i.onset")) & (F.col(f"s.{t}") < F.col("i._end"))
        for k in keys:
            cond = (F.col(f"s.{k}") == F.col(f"i.{k}")) & cond
        return series.alias("s").join(i.alias("i"), cond).select("s.*", *(F.col(f"i.{c}") for c in intervals.columns if c not in keys))
    first, last = F.floor(F.col("onset") / width), F.floor(F.col("_end") / width)
    dealt = i.withColumn("_b", F.explode(F.sequence(first, F.greatest(first, last))))
    out = series.withColumn("_b", F.floor(F.col(t) / width)).join(dealt, [*keys, "_b"])
    return out.where(F.col(t).between(F.col("onset"), F.col("_end")) & (F.col(t) < F.col("_end"))).drop("_b", "_end")


def contained(words: DataFrame, keys: list[str], width: float) -> DataFrame:
    """(.., window): words that lie whole in one window [i * width, (i + 1) * width]."""
    w = F.floor(F.col("start") / width).cast("long")
    own = words.withColumn("window", w).where(F.col("end") <= (F.col("window") + 1) * width)
    edge = words.where((F.col("start") == F.floor(F.col("start") / width) * width) & (F.col("start") == F.col("end")) & (F.col("start") > 0))
    return own.union(edge.withColumn("window", w - 1))


def onset_mask(grid: DataFrame, onsets: DataFrame, keys: list[str], rate: float, t: str = "t") -> DataFrame:
    """(keys, t, mask): 1.0 at int(onset * rate), else 0.0."""
    at = onsets.select(*keys, F.floor(F.col("onset") * rate).cast("long").alias(t)).distinct().withColumn("mask", F.lit(1.0))
    return grid.join(at, [*keys, t], "left").fillna({"mask": 0.0})


def phoneme_ratios(posteriors: DataFrame, phones: DataFrame, keys: list[str], silence: str = "/sil/") -> DataFrame:
    """(keys, t, phoneme, llr) from (keys, t, phone, p): clipped posteriors summed by phoneme,
    log odds floored at 1e-8, centred over the frame's phonemes, silence dropped after that."""
    p = F.least(F.greatest(F.col("p"), F.lit(1e-6)), F.lit(1 - 1e-6))
    summed = posteriors.join(F.broadcast(phones) if _few(phones) else phones, "phone").groupBy(*keys, "t", "phoneme").agg(F.sum(p).alias("p"))
    odds = F.try_divide(F.col("p"), 1 - F.col("p") + 1e-8)
    raw = summed.withColumn("llr", F.nanvl(F.coalesce(F.log10(F.greatest(odds, F.lit(1e-8))), F.lit(0.0)), F.lit(0.0)))
    centred = raw.withColumn("llr", F.col("llr") - F.avg("llr").over(Window.partitionBy(*keys, "t")))
    return centred.where(F.col("phoneme") != silence).select(*keys, "t", "phoneme", "llr")


def _few(dim: DataFrame, limit: int = 10_000) -> bool:
    return dim.limit(limit + 1).count() <= limit


def greedy_label(scores: Column, labels: list[str]) -> Column:
    """The label of the greatest score; the first on ties."""
    return F.element_at(F.array(*map(F.lit, labels)), F.array_position(scores, F.array_max(scores)).cast("int"))
