"""Peaks of series that are cut in parts."""

import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.functions import trf
from tideline.operators import reduce
from tideline.plans import queries as Q


def brute(x, gap, share=0.1, flat=True):
    """Places of the peaks, by looking at each value."""
    found, i, top = [], 1, np.fmax.reduce(x)
    while i < len(x) - 1:
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if j + 1 < len(x) and x[i - 1] < x[i] > x[j + 1] and x[i] >= share * top and (flat or i == j):
            found.append((i + j) // 2)
        i = j + 1
    stays = np.zeros(len(x), bool)
    for i in sorted(found, key=lambda i: (-x[i], i)):
        stays[i] = not stays[max(0, i - gap + 1) : i + gap].any()
    return np.flatnonzero(stays).tolist()


def series_of(seed, n):
    rng = np.random.default_rng(seed)
    return rng.integers(-1, 4, n).astype(float) if seed % 2 else rng.normal(size=n)


def zigzag(n):
    """A peak at every second place, each higher than the one before: all hang on the last one."""
    return np.arange(n) + np.where(np.arange(n) % 2, 3.0, 0.0)


def test_parts_have_the_maxima_of_the_whole():
    for seed in range(60):
        x = series_of(seed, 40)
        if seed % 5 == 0:
            x[9:25] = x.max() + seed % 2  # a run over several parts
        cuts = np.array_split(np.arange(40), 1 + seed % 14)
        rows = []
        for c, at in enumerate(cuts):
            lead, after, trail, before = trf.edges(x[at])
            rows.append((0, c, len(at), x[at].max(), x[at][0], x[at][-1], lead, after, trail, before))
        around = reduce._around(["k"], pd.DataFrame(rows, columns="k _c n top first last lead after trail before".split()))
        for flat in (True, False):
            got = [int(i) + p.place for p, at in zip(around.itertuples(), cuts, strict=True) for i in trf.crests(x[at], 0.1 * p.top, p.place, p.start, p.before, p.stop, p.after, flat)]
            assert got == brute(x, 1, flat=flat)


def test_maxima_are_found_in_many_tasks(spark):
    x = series_of(0, 30_000)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "t": np.arange(len(x)) * 1000, "v": x}))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = reduce.find_peaks(df, ["k"], "v", gap_s=0.0).select(F.spark_partition_id().alias("p"), "t").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.t // 1000 for r in out) == brute(x, 1)
    assert len({r.p for r in out}) > 1


def test_maxima_query_is_its_sql_with_runs_and_nulls(spark, tmp_path):
    con = duckdb.connect()
    con.execute("create table embeddings as select t as vec_id, case when t % 997 = 5 then [null, null] when t between 3000 and 8300 then [0, 9] else [0, (t * t) % 7] end::float[] as embedding, 0 as label from range(9000) r(t)")
    con.execute(f"copy embeddings to '{tmp_path}/embeddings.parquet' (format parquet)")
    want = sorted(con.execute(Q.ORACLE["gfp_maxima"]).fetchall())
    assert len(want) > 500
    assert sorted((r.t, r.gfp) for r in Q.gfp_maxima(spark, str(tmp_path)).collect()) == want


def test_thinning_of_a_long_series_is_not_quadratic():
    x, began = zigzag(200_000), time.process_time()
    found = trf.peaks(x, 3).tolist()
    assert time.process_time() - began < 20
    assert found == brute(x, 3)


@pytest.mark.parametrize("gap", [3, 10])
def test_thinning_settles_what_a_part_can_tell(gap):
    for seed in range(40):
        x = series_of(seed, 300)
        at = np.array(brute(x, 1, share=-9.0), int)
        whole = set(brute(x, gap, share=-9.0))
        inner = at[(at >= 100) & (at < 220)]
        for i, s in zip(inner.tolist(), trf.thinned(inner, x[inner], gap, 100, 220).tolist(), strict=True):
            assert s == 0 or (s > 0) == (i in whole)


def test_peaks_of_many_series(spark):
    far = np.r_[series_of(1, 9000), np.full(9000, 4.0), series_of(3, 3000)]
    nothing = np.r_[series_of(2, 50), np.nan]
    every = {"zigzag": zigzag(30_000), "back": zigzag(30_000)[::-1].copy(), "far": far, "short": series_of(4, 90), "two": np.array([1.0, 2.0]), None: series_of(6, 700), "nan": nothing}
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"k": k, "t": np.arange(len(x)), "v": x}) for k, x in every.items()])).withColumn("v", F.when(F.col("k").isNull() | (F.col("k") != "nan") | ~F.isnan("v"), F.col("v")).otherwise(float("nan")))
    got = {k: [] for k in every}
    for r in reduce.find_peaks(df.repartition(5, "t"), ["k"], "v").collect():
        got[r.k].append(r.t)
        assert r.v == every[r.k][r.t]
    assert {k: sorted(v) for k, v in got.items()} == {k: brute(x, 3) if k != "nan" else [] for k, x in every.items()}


def test_chains_over_many_parts_are_settled_in_rounds(spark):
    x = np.r_[zigzag(900), series_of(1, 300), zigzag(700)[::-1]]
    at = brute(x, 1)
    tops = spark.createDataFrame(pd.DataFrame({"k": 0, "v": x[at], "_i": at, "_open": True}))
    for rounds in range(1, 30):
        tops = reduce.stored(reduce._thin(tops, ["k"], "v", 3, 128, "k long, v double, _i long, _open boolean"), "peaks")
        if tops.where("_open").isEmpty():
            break
    assert rounds > 2
    assert sorted(r._i for r in tops.collect()) == brute(x, 3)
