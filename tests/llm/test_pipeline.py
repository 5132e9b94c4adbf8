"""The stages of the pipeline on a small table, each held against brute force on its own input."""

import itertools
import re

import sentencepiece

import corpus_pipeline
from tideline.llm import pieces

LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def least_of_groups(rows):
    sets = [(r.doc_id, shingles(r.text)) for r in rows]
    group = {i: i for i, _ in sets}
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            lo, hi = sorted((group[i], group[j]))
            group = {k: lo if v == hi else v for k, v in group.items()}
    return {i for i, g in group.items() if i == g}


def holds(words, item):
    size = min(10, len(item))
    windows = {tuple(item[i : i + size]) for i in range(len(item) - size + 1)} if size else set()
    return any(tuple(words[i : i + size]) in windows for i in range(len(words) - size + 1))


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    items = [alnum(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs.write.parquet(f"{tmp_path}/start")
    docs = spark.read.parquet(f"{tmp_path}/start")
    was = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        now = out.collect()
        if name == "language ID":
            assert {r.doc_id for r in now} <= {r.doc_id for r in was if re.search(r"[^\W\d_]", r.text or "")} and len(now) > 0.8 * len(was)
        elif name == "MinHash near-dedup":
            assert {r.doc_id for r in now} == least_of_groups(was)
        elif name == "benchmark decontamination":
            assert {r.doc_id for r in now} == {r.doc_id for r in was if not any(holds(alnum(r.text), i) for i in items)}
        elif name == "PII":
            assert {r.doc_id for r in now} == {r.doc_id for r in was} and all(r.n_chars == len(r.text) for r in now)
        else:
            model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
            text = {r.doc_id: r.text for r in was}
            assert len(now) == len(was) and all(r.round_trip and list(r.ids) == model.encode(text[r.doc_id]) for r in now)
            continue
        assert out.columns == docs.columns and all(r in was for r in now if name != "PII")
        docs, was = out, now
