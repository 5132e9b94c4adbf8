"""Streaming forms: buckets with late data, and lags of an ordered stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bucket_means(stream: DataFrame, time: str, keys: list[str], value: str, width: str, late: str) -> DataFrame:
    """(keys, begin, x, n): means over tumbling windows; rows later than ``late`` are dropped."""
    out = stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.avg(value).alias("x"), F.count("*").alias("n"))
    return out.select(*keys, F.col("window.start").alias("begin"), "x", "n")


def online_lags(stream: DataFrame, key: str, t: str, value: str, depth: int) -> DataFrame:
    """(key, t, x array): the value and the ``depth`` before it, 0 before the first. Each batch is
    ordered by ``t``; rows of a key must not come in an earlier batch than their elders."""
    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail = list(state.get[0]) if state.exists else [0.0] * depth
        rows = pd.concat(list(batches)).sort_values(t)
        x = tail + rows[value].tolist()
        out = [x[i : i + depth + 1][::-1] for i in range(len(rows))]
        state.update((x[len(x) - depth :],))
        yield pd.DataFrame({key: k[0], t: rows[t].to_numpy(), "x": out})

    kinds = dict(stream.dtypes)
    schema = f"{key} {kinds[key]}, {t} {kinds[t]}, x array<double>"
    return stream.select(key, t, value).groupBy(key).applyInPandasWithState(run, schema, "tail array<double>", "append", GroupStateTimeout.NoTimeout)
