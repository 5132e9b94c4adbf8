"""Every query with SQL against DuckDB; sources; streaming."""

import glob
import math
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions.text import normalize_text
from tideline.operators import analysis, events, model, series
from tideline.plans import queries as Q
from tideline.sources import files
from tideline.streaming import online

DATA = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {Path(p).stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_oracle(spark, duck, name):
    df = Q.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    q = duck.execute(Q.ORACLE[name])
    names = [x[0] for x in q.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(dict(zip(names, r, strict=True))[c]) for c in cols) for r in q.fetchall()), key=str)
    assert sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str) == want


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE)))
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, DATA).count() > 0


def test_lag_forms_agree_over_chunks(spark):
    df = spark.createDataFrame([("a", t, float(t % 7)) for t in range(65_530, 65_560)] + [("b", 3, 1.0)], "k string, t long, x double")
    wide = series.lag_features(df, "x", [-2, 0, 5], ["k"]).select("k", "t", F.posexplode("x").alias("i", "x"))
    delays = {0: -2, 1: 0, 2: 5}
    got = {(r.k, r.t, delays[r.i]): r.x for r in wide.collect()}
    assert got == {(r.k, r.t, r.d): r.x for r in series.lag_window(df, "x", [-2, 0, 5], ["k"]).collect()}


def test_alpha_rule(spark):
    rows = [("tie", 1.0, 0.5, 1.0), ("tie", 10.0, 0.495, 1.0), ("tie", 100.0, 0.4, 1.0), ("zero", 1.0, 0.0, 0.0), ("neg", 1.0, -0.1, 0.0), ("neg", 5.0, -0.1001, 0.0)]
    df = spark.createDataFrame(rows, "s string, alpha double, r double, r_train double")
    assert {r.s: r.alpha for r in model.select_alpha(df, ["s"]).collect()} == {"tie": 10.0, "zero": 1.0, "neg": 5.0}


def test_normalize_text(spark):
    rows = [("¿Canción,  de\tLA_niña!",), ("",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(normalize_text(F.col("t"))).collect()] == ["cancion de la_nina", "", None]


def test_sources(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(files.wav_bytes(np.array([[1, -2], [3, 4]]), 8000))
    assert [(r.t, r.s, r.sample_rate) for r in files.read_wav(spark, str(tmp_path)).orderBy("t").collect()] == [(0, [1.0, -2.0], 8000), (1, [3.0, 4.0], 8000)]
    (tmp_path / "a.json").write_text('{"listening_onsets": [1.5, 9], "listening_durations": [2, 3], "listening_annotations": ["x", "y"], "metadata": {"audio_filecodes": ["q", "p"]}}')
    assert [(r.segment, r.onset, r.label) for r in files.read_annotations(spark, str(tmp_path / "a.json")).collect()] == [(0, 1.5, "x"), (1, 9.0, "y")]
    codes = files.read_filecodes(spark, str(tmp_path / "a.json")).withColumn("p", F.lit(1))
    seg = spark.createDataFrame([(1, f"s_segment{n}_eeg") for n in (10, 2, 1)], "p int, path string").withColumn("segment", files.segment_number("path"))
    assert {(r.segment, r.filecode) for r in files.pair_segments(seg.drop("path"), codes, ["p"]).collect()} == {(1, "q"), (2, "p")}
    (tmp_path / "o.csv").write_text("left_s,right_s\n1.0,2.0\n3.0,\n")
    assert sorted(r.onset for r in files.read_onsets(spark, str(tmp_path / "o.csv")).collect()) == [1.0, 2.0, 3.0]
    store = files.store_from_json(spark, '{"Theta": {"Envelope": {"left": {"s1": 2.5, "s2": null}}}}')
    assert files.store_to_json(store) == '{"Theta": {"Envelope": {"left": {"s1": 2.5, "s2": null}}}}'
    files.write_series(store, str(tmp_path / "w"), ["band"])
    assert spark.read.parquet(str(tmp_path / "w")).count() == 2


def test_gaps_of_many_tasks(spark):
    samples = spark.createDataFrame([("a", t) for t in range(30)] + [("b", 5)], "k string, time long")
    tasks = spark.createDataFrame([("a", 3, 6), ("a", 5, 9), ("a", 9, 10), ("a", 20, 20), ("a", 25, 40), ("c", 0, 9)], "k string, onset long, offset long")
    got = sorted((r.k, r.onset, r.offset) for r in events.gaps(samples, tasks, ["k"]).collect())
    assert got == [("a", 0, 2), ("a", 9, 24), ("b", 5, 5)]


def test_analysis_is_resumed(spark, tmp_path):
    o, path = Q.Options((1,)), f"{tmp_path}/out"
    grid, cells = Q._grid(spark), Q._cells(spark, DATA)
    first = analysis.run(cells.where("subject = 's0'"), grid, path, o)
    assert {(r.side, r.subject): r.r_mean is not None for r in first.collect()} == {("left", "s0"): False, ("left", "s1"): False, ("mono", "s0"): True, ("mono", "s1"): False}
    written = {r.subject: r.r_mean for r in spark.read.parquet(f"{path}/correlations").where("channel = 3").collect()}
    again = analysis.run(cells, grid, path, o)
    assert again.where("r_mean is not null").count() == 128
    assert {r.subject: r.r_mean for r in spark.read.parquet(f"{path}/correlations").where("channel = 3").collect()} == {"s0": written["s0"], "s1": written["s0"]}
    trfs = analysis.reload(spark, f"{path}/trfs", grid, analysis.CELL)
    assert trfs.where("side = 'mono'").count() == 128 and trfs.where("side = 'left' and w_mean is null").count() == 2


def test_grid_has_few_tasks(spark):
    grid = series.param_grid(spark, a=[1, 2, 3], b=["x", "y"], c=[0.5, 1.5], d=["p"])
    assert grid.rdd.getNumPartitions() == 1
    assert sorted(map(tuple, grid.collect())) == [(a, b, c, "p") for a in (1, 2, 3) for b in "xy" for c in (0.5, 1.5)]
    assert grid.dtypes == [("a", "bigint"), ("b", "string"), ("c", "double"), ("d", "string")]


def test_dimensions(spark):
    with pytest.raises(ValueError):
        analysis.select_channels(analysis.channels(spark), ["Cz", "nowhere"])
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(Exception, match="no file for 2"):
        analysis.complete_join(left, right, ["k"], "file").collect()
    labels = [r.label for r in analysis.feature_names(spark, "Spectrogram", 21).orderBy("feature").collect()]
    assert len(labels) == 21 and labels == sorted(labels, key=int) and 0 < int(labels[0]) and int(labels[-1]) < 8000
    assert [r.label for r in analysis.feature_names(spark, "Phonemes", 2, ["/a/", "/b/"]).orderBy("feature").collect()] == ["/a/", "/b/"]


def test_cluster_order_query_is_the_linkage(spark):
    rows = Q.heat_map_clustered(spark, DATA).collect()
    place = {r.feature: r.position for r in rows}
    assert sorted(place.values()) == list(range(len(place)))


def test_crop_forms_agree(spark):
    s = spark.range(300).withColumnRenamed("id", "t")
    i = spark.createDataFrame([(1, 3.5, 100.0), (2, 64.0, 64.0), (3, 250.0, 0.0)], "n int, onset double, duration double")
    rows = lambda df: sorted((r.t, r.n) for r in df.collect())
    assert rows(events.crop(s, i, [])) == rows(events.crop(s, i, [], width=64.0))


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([("a", t, float(t)) for t in range(5)], "k string, t long, x double")
    df.write.parquet(str(tmp_path / "in"))
    q = online.online_lags(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "k", "t", "x", 2).writeStream.format("memory").queryName("lags").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {r.t: list(r.x) for r in spark.table("lags").collect()} == {t: [float(t), float(max(t - 1, 0)), float(max(t - 2, 0))] for t in range(5)}
