"""Readers and writers: WAV, annotations, metadata, onset lists, stores, segment files."""

from __future__ import annotations

import io
import json
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """(path, sample_rate, t, s array): the samples of each track, as integers."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                with wave.open(io.BytesIO(content)) as w:
                    rate, tracks, width = w.getframerate(), w.getnchannels(), w.getsampwidth()
                    at = 0
                    while raw := w.readframes(65_536):
                        kind = {1: "u1", 2: "<i2", 4: "<i4"}[width]
                        x = np.frombuffer(raw, kind).reshape(-1, tracks).astype(float)
                        yield pd.DataFrame({"path": name, "sample_rate": rate, "t": np.arange(at, at + len(x)), "s": list(x)})
                        at += len(x)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, sample_rate int, t long, s array<double>")


def wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    """A 16-bit WAV file of (n,) or (n, tracks) samples."""
    x = np.asarray(samples)
    x = x[:, None] if x.ndim == 1 else x
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(x.shape[1])
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.rint(x), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(path, segment, onset, duration, label) of listening annotations, in file order."""
    kind = "listening_onsets array<double>, listening_durations array<double>, listening_annotations array<string>"
    rows = spark.read.json(path, schema=kind, multiLine=True).withColumn("path", F.input_file_name())
    return rows.select("path", F.posexplode(F.arrays_zip("listening_onsets", "listening_durations", "listening_annotations")).alias("segment", "a")).select(
        "path", "segment", F.col("a.listening_onsets").alias("onset"), F.col("a.listening_durations").alias("duration"), F.col("a.listening_annotations").alias("label"))


def read_filecodes(spark: SparkSession, path: str) -> DataFrame:
    """(path, ordinal, filecode) of behavioural metadata."""
    rows = spark.read.json(path, schema="metadata struct<audio_filecodes: array<string>>", multiLine=True)
    return rows.select(F.input_file_name().alias("path"), F.posexplode("metadata.audio_filecodes").alias("ordinal", "filecode"))


def read_onsets(spark: SparkSession, path: str, side: str = "mono") -> DataFrame:
    """(path, onset): one column of a CSV with left_s and right_s, or both."""
    rows = spark.read.csv(path, header=True, schema="left_s double, right_s double").withColumn("path", F.input_file_name())
    cols = {"left": ["left_s"], "right": ["right_s"], "mono": ["left_s", "right_s"]}[side]
    return rows.select("path", F.explode(F.array(*cols)).alias("onset")).where("onset is not null")


def segment_number(path):
    """The number in ``..._segment<n>_...``: segments are ordered by it, not by name."""
    return F.regexp_extract(path, r"segment(\d+)", 1).cast("int")


def pair_segments(segments: DataFrame, filecodes: DataFrame, keys: list[str]) -> DataFrame:
    """Segment k of a participant with file code k; the shorter list wins."""
    from pyspark.sql import Window

    ranked = segments.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy("segment")) - 1)
    return ranked.join(filecodes.select(*keys, "ordinal", "filecode"), [*keys, "ordinal"])


def write_series(df: DataFrame, path: str, by: list[str]) -> None:
    """Parquet, a folder for each value of ``by``; only the partitions written are replaced."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def store_to_json(store: DataFrame) -> str:
    """A small (band, attribute, side, subject, alpha) table as a nested document."""
    out: dict = {}
    for r in store.toLocalIterator():
        out.setdefault(r.band, {}).setdefault(r.attribute, {}).setdefault(r.side, {})[r.subject] = r.alpha
    return json.dumps(out, sort_keys=True)


def store_from_json(spark: SparkSession, text: str) -> DataFrame:
    rows = [(b, a, s, u, None if v is None else float(v)) for b, x in json.loads(text).items() for a, y in x.items() for s, z in y.items() for u, v in z.items()]
    return spark.createDataFrame(rows, "band string, attribute string, side string, subject string, alpha double")
