"""Benchmark decontamination (operator 7): one Aho-Corasick automaton over the items.

Texts are normalised to words of letters, digits and non-ASCII in lower case (A-Z only),
one space between. Every window of ten words of an item (or the whole item, if it has
fewer) is a pattern ``" w1 ... wn "`` of the automaton; a text is scanned once, and a
match's character range is mapped to word positions and to byte offsets of the original.

The automaton's patterns have at most about ``MAX_ITEM_BYTES``, which bounds what the driver
collects, what is broadcast and what a worker builds (once, for all its tasks). Within it the texts
are scanned once. A larger benchmark is cut into parts within the bound; the texts are scanned once for
each, with one automaton at a time, and the word ranges that are hit are written and united by hash
of the text, so results don't depend on the cut.

Defined results. Null or blank text: no words, nothing hit. A null or blank item, or one
without words, has no windows. Repeated items count once per item_id; a null item_id marks
words as hit but isn't an item of the list. Repeated documents each get their row. Further
columns are ignored; an empty benchmark hits nothing.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import kernel as K
from tideline.plans.scratch import stored

WINDOW = 10
MAX_ITEM_BYTES = 16 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().translate(_LOWER))


def windows(words: list[bytes], size: int = WINDOW) -> list[list[bytes]]:
    return [words[i : i + size] for i in range(max(1, len(words) - size + 1))] if words else []


def _parts(benchmark: DataFrame, size: int, limit: int) -> Iterator[list[tuple]]:
    """Patterns (text, words, ids of items) in parts of bounded size; items arrive one by one."""
    found: dict[bytes, tuple[int, list]] = {}
    held = 0
    for row in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).distinct().toLocalIterator():
        for w in windows(words_of(row[1]), size):
            key = b" " + b" ".join(w) + b" "
            held += len(key) if key not in found else 0
            ids = found.setdefault(key, (len(w), []))[1]
            if row[0] is not None and row[0] not in ids:
                ids.append(row[0])
            if held > limit:
                yield [(k, n, ids) for k, (n, ids) in found.items()]
                found, held = {}, 0
    if found:
        yield [(k, n, ids) for k, (n, ids) in found.items()]


class Patterns:
    """A broadcast part of the patterns; each worker builds its automaton once and holds one at a time."""

    def __init__(self, spark: SparkSession, part: list[tuple]):
        self.name, self.shared = uuid.uuid4().hex, spark.sparkContext.broadcast(part)

    def automaton(self) -> ahocorasick.Automaton:
        return K.kept(self.name, self._build)

    def _build(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for key, n, ids in self.shared.value:
            a.add_word(key.decode("latin-1"), (len(key), n, ids))
        a.make_automaton()
        return a


def scan(block: K.Block, automaton: ahocorasick.Automaton) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[tuple]]]:
    """For each text: row, begins and ends of its words, and (first word, words, ids of items) of each match."""
    s, e, rows = block.spans(K.ALNUM)
    at = np.concatenate([[0], np.cumsum(block.counts(rows))])
    lower = np.frombuffer(bytes(block.buf).translate(_LOWER), np.uint8)
    inside = np.zeros(len(lower) + 1, np.int32)
    np.add.at(inside, s, 1)
    np.add.at(inside, e, -1)
    member = np.cumsum(inside[:-1]).astype(bool)
    length = (e - s) + 1
    for r in range(block.n):
        lo, hi = at[r], at[r + 1]
        matches: list[tuple] = []
        if hi > lo and len(automaton):
            # The text's word bytes, each word followed by a space, one space before the first.
            line = np.full(1 + int(length[lo:hi].sum()), 32, np.uint8)
            begins = 1 + np.concatenate([[0], np.cumsum(length[lo:hi])])[:-1]
            b0, b1 = s[lo], e[hi - 1]
            gaps = np.repeat(begins - s[lo:hi], e[lo:hi] - s[lo:hi])
            where = np.flatnonzero(member[b0:b1]) + b0
            line[where + gaps] = lower[where]
            found = [(end - size + 2, k, ids) for end, (size, k, ids) in automaton.iter(line.tobytes().decode("latin-1"))]
            if found:
                first = np.searchsorted(begins, [x[0] for x in found]).tolist()
                matches = [(f, k, ids) for f, (_, k, ids) in zip(first, found, strict=True)]
        yield r, s[lo:hi] - block.off[r], e[lo:hi] - block.off[r], matches


def covered(n: int, ranges: list) -> np.ndarray:
    """Which of n words lie in a range (first word, words)."""
    mark = np.zeros(n + 1, np.int32)
    if ranges:
        first, size = np.array([x[0] for x in ranges]), np.array([x[1] for x in ranges])
        np.add.at(mark, first, 1)
        np.add.at(mark, first + size, -1)
    return np.cumsum(mark[:-1]) > 0


def spans_of(hit: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges in the original of runs of hit words."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [(int(begins[a]), int(ends[b - 1])) for a, b in zip(edge[::2], edge[1::2], strict=True)]


_KINDS = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
_SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<begin: long, end: long>>"


def _result(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    """Rows of (begins, ends, ranges, items) to the columns of :func:`contamination`."""
    out = []
    for b, e, ranges, items in rows:
        hit = covered(len(b), ranges)
        out.append((len(b), int(hit.sum()), sorted(items), [{"begin": x, "end": y} for x, y in spans_of(hit, b, e)]))
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), _KINDS, strict=True))], ["doc_id", "n_words", "n_hit", "items", "spans"])


def _first_two(parts: Iterator[list]) -> tuple[list, Iterator[list] | None]:
    """The first part; if there are more, all of them."""
    first, second = next(parts, []), next(parts, None)
    return first, None if second is None else chain([first, second], parts)


def _hits(docs: DataFrame, parts: Iterator[list]) -> DataFrame:
    """A written table (text_hash, ranges, items) of the texts hit, a row for each part that hits one."""
    texts, out = docs.select(F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string")), None

    def run_of(patterns: Patterns):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = patterns.automaton()
            for batch in batches:
                rows = []
                for part, block in K.blocks(batch.column(1)):
                    for r, _, _, found in scan(block, a):
                        if found:
                            rows.append((batch.column(0)[part.start + r].as_py(), sorted({(f, k) for f, k, _ in found}), sorted({i for x in found for i in x[2]})))
                if rows:
                    ranges = pa.array([[{"first": f, "words": k} for f, k in x[1]] for x in rows], pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())])))
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows]), ranges, pa.array([x[2] for x in rows], pa.list_(pa.string()))], ["text_hash", "ranges", "items"])

        return run

    for part in parts:
        patterns = Patterns(docs.sparkSession, part)
        got = texts.mapInArrow(K.task("decontaminate", run_of(patterns)), "text_hash long, ranges array<struct<first: long, words: long>>, items array<string>")
        # Copies of a text have the same matches; one of them is kept.
        got = stored(got.groupBy("text_hash").agg(F.first("ranges").alias("ranges"), F.first("items").alias("items")), "hits")
        patterns.shared.destroy()
        out = got if out is None else out.union(got)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = MAX_ITEM_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids), spans (byte ranges of hit runs in the text)."""
    first, several = _first_two(_parts(benchmark, window, limit))
    if several is None:
        patterns = Patterns(docs.sparkSession, first)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = patterns.automaton()
            for batch in batches:
                for part, block in K.blocks(batch.column(1)):
                    rows = [(b, e, found, {i for x in found for i in x[2]}) for _, b, e, found in scan(block, a)]
                    yield _result(batch.column(0)[part.start : part.stop], rows)

        return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(K.task("decontaminate", run), _SCHEMA)

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in K.blocks(batch.column(1)):
                own = batch.slice(part.start, part.stop - part.start)
                s, e, rows = block.spans(K.ALNUM)
                at = np.concatenate([[0], np.cumsum(block.counts(rows))])
                out = []
                for r, (ranges, items) in enumerate(zip(own.column(2).to_pylist(), own.column(3).to_pylist(), strict=True)):
                    lo, hi = at[r], at[r + 1]
                    out.append((s[lo:hi] - block.off[r], e[lo:hi] - block.off[r], [(x["first"], x["words"]) for x in ranges or []], items or []))
                yield _result(own.column(0), out)

    hits = _hits(docs, several).groupBy("text_hash").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    return rows.join(hits, "text_hash", "left").select("doc_id", "text", "ranges", "items").mapInArrow(K.task("decontaminate", united), _SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = MAX_ITEM_BYTES) -> DataFrame:
    """Rows of ``docs``, all columns, whose text holds no window of the benchmark."""
    first, several = _first_two(_parts(benchmark, window, limit))
    if several is not None:
        (h,) = K.fresh(docs, "text_hash")
        hits = _hits(docs, several).select(F.col("text_hash").alias(h)).distinct()
        return docs.withColumn(h, F.xxhash64(F.col("text").cast("string"))).join(hits, h, "left_anti").select(*docs.columns)
    patterns = Patterns(docs.sparkSession, first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = patterns.automaton()
        for batch in batches:
            keep = [not found for _, block in K.blocks(batch.column("text")) for _, _, _, found in scan(block, a)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(K.task("decontaminate", run), docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of :func:`contamination`'s rows."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


_SQL_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
slot AS (SELECT item_id, w, least({WINDOW}, len(w)) AS k, unnest(range(1, greatest(1, len(w) - {WINDOW} + 1) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM slot),
size AS (SELECT DISTINCT k FROM win),
place AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, size WHERE len(w) >= k),
hit AS (SELECT doc_id, i, p.k AS k, item_id FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM place) p JOIN win ON p.k = win.k AND p.g = win.g),
n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM hit) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
"""
