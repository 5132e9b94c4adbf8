"""Quality rules (operator 10): text statistics and cross-document line frequency.

One pass measures each text and hashes its lines (the sequence of their words of letters,
digits and non-ASCII, A-Z lowered; other lines don't count). A line's frequency is the
number of documents of its host (``source``) that hold it; exact copies all count. A
document is a different doc_id of a text, each row where doc_id is null. Lines in more
than ``MIN_TEXTS`` documents are removed, whatever the size of the host, and
a document is depleted if more than ``DEPLETED`` (half) of its line characters go. Rows are first
reduced to one a text and host that carries its documents, then summed with partial sums, so a
line that a third of all texts share is no hot key; the join back is split by the adaptive skew join.

``kept`` is false for ``base_failed`` (under ten words, or over a fifth of the words in
repeated 5-word windows) or a depleted document.

Defined results. Null or blank text: no words, so base_failed. Null source: a host of its
own (the empty name). Repeated rows: one row each. Ties don't occur: limits are strict.
Further columns are ignored; an empty table gives an empty result. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import kernel as K
from tideline.plans.scratch import stored

MIN_TEXTS, DEPLETED = 20, 0.5
_SYMBOL = K.byte_class(*b"#*$%&|<>")
_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[off[1:]] - total[off[:-1]]


def _distinct(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (row, hash): first place of each different one, where each belongs, how often it stands."""
    _, first, back, n = np.unique(K.mix(h + K.mix(rows, 5)), return_index=True, return_inverse=True, return_counts=True)
    return first, back, n


def measure(block: K.Block) -> tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The five statistics, and (row, hash, characters) of each different line of a row."""
    buf, off = block.buf, block.off
    s, e, rows = block.spans(K.SPACED)
    n_words = block.counts(rows)
    chars = _per_row(K.SPACED[buf] & ((buf & 0xC0) != 0x80), off)
    symbols = _per_row(_SYMBOL[buf], off)
    # Lines: from a text's begin or a line break to the next.
    breaks = np.flatnonzero(buf == 10)
    start = np.union1d(off[:-1][off[:-1] < off[1:]], breaks + 1)
    start = start[start < len(buf)]
    stop = np.minimum(np.append(start[1:], len(buf)), len(buf))
    ends_in_break = buf[stop - 1] == 10 if len(stop) else np.zeros(0, bool)
    stop = stop - ends_in_break
    line_row = np.searchsorted(off, start, side="right") - 1
    worded = np.zeros(len(start), bool)
    if len(s):
        worded[np.searchsorted(start, s, side="right") - 1] = True
    ls, le, lr = start[worded], stop[worded], line_row[worded]
    dup = np.zeros(block.n, np.int64)
    if len(ls):
        first, _, _ = _distinct(block.hashes(ls, le, fold=False), lr)
        dup = block.counts(lr) - block.counts(lr[first])
    # Words of 5-word windows that stand twice or more in their text.
    repeat = np.zeros(block.n, np.int64)
    ok = np.flatnonzero(K.whole(rows, 5))
    if len(ok):
        g = K.grams(block.hashes(s, e, fold=False), rows, 5)[ok]
        _, back, n = _distinct(g, rows[ok])
        at = ok[n[back] > 1]
        mark = np.zeros(len(s) + 1, np.int32)
        np.add.at(mark, at, 1)
        np.add.at(mark, at + 5, -1)
        repeat = block.counts(rows[np.flatnonzero(np.cumsum(mark[:-1]) > 0)])
    return [n_words, chars, symbols, dup, repeat], _lines(block, start)


def _lines(block: K.Block, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    s, e, rows = block.spans(K.ALNUM)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, K.U), np.zeros(0, np.int64)
    line = np.searchsorted(start, s, side="right") - 1
    begin = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    size = np.diff(np.append(begin, len(s)))
    pw, inv = K._power(len(s) + 1)
    total = np.concatenate([np.zeros(1, K.U), np.cumsum(block.hashes(s, e) * pw[: len(s)], dtype=K.U)])
    h = K.mix((total[begin + size] - total[begin]) * inv[begin] + size.astype(K.U), 11)
    chars = np.add.reduceat(e - s, begin)
    row = rows[begin]
    first, back, _ = _distinct(h, row)
    order = np.argsort(first)
    summed = np.bincount(back, chars).astype(np.int64)
    return row[first][order], h[first][order], summed[order]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("line", pa.int64()), ("chars", pa.int64())])
    for batch in batches:
        for part, block in K.blocks(batch.column(3)):
            stats, (row, h, chars) = measure(block)
            at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=block.n))])
            lines = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(chars)], fields=list(kind)))
            own = [c[part.start : part.stop] for c in batch.columns[:3]]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(x.astype(np.int64)) for x in stats), lines], ["doc_id", "host", "text_hash", *_NAMES, "lines"])


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string"))
    schema = "doc_id long, host string, text_hash long, " + ", ".join(f"{n} long" for n in _NAMES) + ", lines array<struct<line: long, chars: long>>"
    return rows.mapInArrow(_measured, schema)


def removed(stats: DataFrame, min_texts: int = MIN_TEXTS) -> DataFrame:
    """(host, text_hash, removed_chars, removed_lines): the lines above the limit of each text."""
    ids = stats.groupBy("host", "text_hash", "doc_id").agg(F.count("*").alias("rows"))
    copies = ids.groupBy("host", "text_hash").agg(F.sum(F.when(F.col("doc_id").isNull(), F.col("rows")).otherwise(1)).alias("docs"))
    texts = stats.groupBy("host", "text_hash").agg(F.first("lines").alias("lines")).join(copies, ["host", "text_hash"])
    lines = texts.select("host", "text_hash", "docs", F.inline("lines"))
    often = lines.groupBy("host", "line").agg(F.sum("docs").alias("n")).where(F.col("n") > min_texts).select("host", "line")
    return lines.join(often, ["host", "line"]).groupBy("host", "text_hash").agg(F.sum("chars").alias("removed_chars"), F.collect_list("line").alias("removed_lines"))


def judge(docs: DataFrame, host: str = "source", min_texts: int = MIN_TEXTS, depleted: float = DEPLETED) -> DataFrame:
    """A row for each row of ``docs``: statistics, base_failed, depletion and kept."""
    stats = stored(measured(docs, host), "quality")
    gone = removed(stats, min_texts).select("host", "text_hash", "removed_chars")
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["chars"])
    out = stats.withColumn("line_chars", total).drop("lines").join(gone, ["host", "text_hash"], "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    share_gone = F.coalesce(F.col("removed_chars") / F.nullif("line_chars", F.lit(0)), F.lit(0.0))
    out = out.withColumn("base_failed", failed).withColumn("removed_share", share_gone)
    return out.select("doc_id", *_NAMES, "base_failed", (~F.col("base_failed") & (F.col("removed_share") <= depleted)).alias("kept"), "removed_share")


def _cut(batches: Iterator[pa.RecordBatch], removed_lines: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        gone = batch.column(removed_lines).to_pylist()
        texts = batch.column(at).to_pylist()
        for i, lines in enumerate(gone):
            if lines:
                drop = set(lines)
                raw = texts[i].split("\n")
                h = [measure(K.block_of([x]))[1][1].view(np.int64) for x in raw]
                texts[i] = "\n".join(x for x, y in zip(raw, h, strict=True) if not (len(y) and int(y[0]) in drop))
        cols = list(batch.columns)
        cols[at] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays(cols, batch.schema.names)


def cleaned(docs: DataFrame, host: str = "source", min_texts: int = MIN_TEXTS) -> DataFrame:
    """``docs``, all columns, the text without the lines above the limit."""
    h, t, lines = K.fresh(docs, "host", "text_hash", "removed_lines")
    gone = removed(stored(measured(docs, host), "quality"), min_texts)
    gone = gone.select(F.col("host").alias(h), F.col("text_hash").alias(t), F.col("removed_lines").alias(lines))
    keyed = docs.withColumn(h, F.coalesce(F.col(host).cast("string"), F.lit(""))).withColumn(t, F.xxhash64(F.col("text").cast("string")))
    out = keyed.join(gone, [h, t], "left").select(*docs.columns, lines)
    return out.mapInArrow(lambda it: _cut(it, lines), out.schema).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM twice) GROUP BY doc_id),
k AS (SELECT doc_id, host, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS x FROM l),
m AS (SELECT doc_id, host, array_to_string(x, ' ') AS key, sum(strlen(array_to_string(x, ''))) AS chars FROM k WHERE len(x) > 0 GROUP BY ALL),
often AS (SELECT host, key FROM m GROUP BY ALL HAVING count(DISTINCT doc_id) > {MIN_TEXTS}),
gone AS (SELECT doc_id, sum(chars) AS every, sum(CASE WHEN often.key IS NOT NULL THEN chars ELSE 0 END) AS removed FROM m LEFT JOIN often ON m.host = often.host AND m.key = often.key GROUP BY doc_id),
f AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(CAST(removed AS DOUBLE) / nullif(CAST(every AS DOUBLE), 0), 0.0::DOUBLE) AS removed_share
  FROM d LEFT JOIN dup ON d.doc_id = dup.doc_id LEFT JOIN rep ON d.doc_id = rep.doc_id LEFT JOIN gone ON d.doc_id = gone.doc_id)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND removed_share <= {DEPLETED} AS kept FROM f
"""
