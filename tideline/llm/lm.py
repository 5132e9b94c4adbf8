"""Language-model scoring (operator 5): a log-frequency Bloom filter of n-gram counts.

Counting. A task sums the words and word pairs of its texts by hash and writes them packed,
one row for each part of the hash range (``PART_TOKENS`` training tokens a part); each part
is summed by itself. All training texts count. A word or pair with a third of all places is
one entry of each task by then.

Filter. A count c is held as the level 1 + floor(log c / log ``BASE``): the entries
(n-gram, 1) to (n-gram, level) are put into the segment of its part, ``BITS`` bits an
entry. A count is read by probing level after level until one is missing. All words and
pairs are held, at every size. Up to ``MAX_FILTER`` bytes the filter is broadcast. A larger one
stays a table and is dealt to. Both ways give the same levels. Parts grow with the input so that
one is always summed in bounded memory; a task takes several of them in turn past ``MAX_TASKS``.

Dealing. Each ``BLOCK_TOKENS`` tokens of text are stored as places in their different words,
packed. The different words and pairs of a block are dealt to the parts, probed where the
segments lie, and their levels, with the words' exact counts, go back to the block. ``learned``
counts the training texts of the same deal, so that a corpus that trains its own model is dealt
once; the query does so at every size, and its disk grows with the texts alone.

Probabilities. p(w | v) = l * c(v w) / c(v) + (1 - l) * p(w), with p(w) the base formula on
the filter's counts and l depending on the level of c(v); the weights maximise the
likelihood of all training texts, each place left out of its own counts; the places are first
counted by (level of v, level of w, level of the pair), so that the weights need one histogram.
A text begins after the end token. The query's levels are written, a byte a token and pair, and
read for the weights and for the scores.

The base uses exact counts: the table of words is broadcast while it is within ``MAX_WORDS``
entries and the filter is, else texts are dealt; both ways give the same figures up to rounding.

Defined results. Null or empty text: the end token only. Null doc_id: not held out, so it
trains. Repeated rows: one row each, each trains. No training rows: all counts 0, N = 0.
Further columns are ignored; an empty table gives an empty result. Hashes have 64 bits.
"""

from __future__ import annotations

import copy
import gc
import math
import uuid
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import kernel as K
from tideline.plans.scratch import drop, stored

BASE, BITS, PROBES = 1.5, 10, 6
PART_TOKENS, BLOCK_TOKENS = 1_500_000, 1_500_000
MAX_FILTER, MAX_WORDS, MAX_TASKS = 128 << 20, 8_000_000, 1 << 16
END = K.U(0x1234567DEADBEEF1)
WEIGHTS = np.array([0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])
LEVELS = 64
LEVELLED = "doc_id long, text_hash long, n_tokens long, n_known long, base_score double, words binary, pairs binary"
BLOCKS = "block string, words binary, at binary, doc_id array<long>, text_hash array<long>, n_tokens array<long>, learn array<boolean>"
DEALT = "part int, block string, words binary, times binary, pairs binary, twice binary, segment binary"
ANSWERS = "block string, part int, words binary, times binary, pairs binary, n long, v long"
ZSTD = pa.Codec("zstd", compression_level=1)



def _tokens(block: K.Block) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token (words, then the end), tokens a row."""
    s, e, rows = block.spans(K.SPACED)
    n = block.counts(rows) + 1
    ends = np.cumsum(n) - 1
    w = np.full(int(n.sum()), END, K.U)
    word = np.ones(len(w), bool)
    word[ends] = False
    w[word] = block.hashes(s, e)
    return w, n


def tokens(block: K.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each token, the pair with the token before, tokens a row."""
    w, n = _tokens(block)
    return w, pair(np.concatenate([[END], w[:-1]]), w), n


def pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return K.mix(K.mix(v, 21) + w, 22)


def level(c: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(c, 1)) / math.log(BASE) + 1e-9).astype(np.int64)


def _estimates() -> np.ndarray:
    """The count that a level stands for: the middle of the counts that have it; level 0 is 0."""
    out = np.zeros(LEVELS + 1)
    for q in range(1, LEVELS + 1):
        lo, hi = math.ceil(BASE ** (q - 1) - 1e-9), math.ceil(BASE**q - 1e-9) - 1
        out[q] = max((lo + hi) / 2, BASE ** (q - 1))
    return out


ESTIMATE = _estimates()


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> K.U(32)) * K.U(parts)) >> K.U(32)


def _cuts(h: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """The parts that sorted hashes fall into, and where."""
    part = _part(h, parts).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=True):
        yield int(part[lo]), slice(lo, hi)


def _summed(h: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if n is None:
        return np.unique(h, return_counts=True)
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(n, first) if len(h) else n


def _packed(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Texts to rows (part, kind, hashes, counts); kind 1 words, 2 pairs."""
    held: list[list[np.ndarray]] = [[], []]
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for kind in (1, 2):
            h, n = _summed(np.concatenate(held[kind - 1]))
            n = n.astype(np.uint32)  # of one block of tokens
            for own in batched(_cuts(h, parts), 64):
                cols = [[x[at].tobytes() for _, at in own] for x in (h, n)]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in own], pa.int32()), pa.array([kind] * len(own), pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], ["part", "kind", "hashes", "counts"])

    for batch in batches:
        for _, block in K.blocks(batch.column(0)):
            w, p, _ = tokens(block)
            held[0].append(w)
            held[1].append(p)
            size += len(w)
            if size > 1_500_000:
                yield from out()
                held, size = [[], []], 0
    if size:
        yield from out()


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows in order of part to one row a part: words, their counts, the filter's segment."""
    part, held = None, {1: [], 2: []}

    def out() -> pa.RecordBatch:
        got = {}
        for kind, rows in held.items():
            h = np.concatenate([np.frombuffer(x, K.U) for x, _ in rows] or [np.zeros(0, K.U)])
            n = np.concatenate([np.frombuffer(y, np.uint32) for _, y in rows] or [np.zeros(0, np.uint32)])
            got[kind] = _summed(h, n.astype(np.int64))
        words, counts = got[1]
        seg = _segment(np.concatenate([words, got[2][0]]), np.concatenate([counts, got[2][1]]))
        row = [part, int(counts.sum()), words.tobytes(), counts.astype(np.int64).tobytes(), seg.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["part", "n", "words", "counts", "segment"])

    for batch in batches:
        for p, kind, h, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part is not None and p != part:
                yield out()
                held = {1: [], 2: []}
            part = p
            held[kind].append((h, n))
    if part is not None:
        yield out()


def _segment(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The filter's segment of different n-grams and their counts."""
    q = level(c)
    bits = max(64, -(-int(q.sum()) * BITS // 64) * 64)
    seg = np.zeros(bits, bool)
    for j in range(1, int(q.max()) + 1 if len(q) else 1):
        for pos in _places(h[q >= j], j, K.U(bits)):
            seg[pos] = True
    return np.packbits(seg, bitorder="little")


def _places(h: np.ndarray, j: int, bits: np.ndarray | K.U) -> Iterator[np.ndarray]:
    """Where an entry's bits are in its segment (double hashing)."""
    a, b = K.mix(h, 100 + j), K.mix(h, 300 + j) | K.U(1)
    for i in range(PROBES):
        x = a + K.U(i) * b
        yield (x - x // bits * bits).astype(np.int64)  # numpy divides by one number faster than it takes remainders


def _probed(h: np.ndarray, data: np.ndarray, begin: np.ndarray | int, bits: np.ndarray | K.U) -> np.ndarray:
    """The level of each n-gram, by repeated membership probes of its segment (or of one) in ``data``."""
    out, live = np.zeros(len(h), np.int64), np.arange(len(h))
    for j in range(1, LEVELS + 1):
        a, b = K.mix(h, 100 + j), K.mix(h, 300 + j) | K.U(1)
        for i in range(PROBES):
            x = a + K.U(i) * b
            at = (x - x // bits * bits).astype(np.int64)
            ok = (data[begin + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 == 1
            if not ok.all():
                live, h, a, b = (x[ok] for x in (live, h, a, b))
                if isinstance(begin, np.ndarray):
                    begin, bits = begin[ok], bits[ok]
            if not len(live):
                return out
        out[live] = j
    return out


class Filter:
    """The filter: segments on end and where each begins, or None where they stay a table; the weights."""

    def __init__(self, segments: list[bytes] | None, parts: int, n: int, v: int):
        self.parts, self.n, self.v = parts, n, v
        self.spread = segments is None
        self.data = np.frombuffer(b"".join(segments or []), np.uint8)
        self.shared = None
        size = np.array([len(x) for x in segments or []], np.int64)
        self.begin, self.bits = np.cumsum(size) - size, (size * 8).astype(K.U)
        self.weights = np.zeros(LEVELS + 1)

    def sent(self, spark: SparkSession) -> Filter:
        """The same filter, its bits in a broadcast."""
        out = copy.copy(self)
        if not self.spread:
            out.shared, out.data = spark.sparkContext.broadcast(self.data), None
        return out

    def light(self) -> Filter:
        """The same without the bits."""
        out = Filter(None, self.parts, self.n, self.v)
        out.weights = self.weights
        return out

    def levels(self, h: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.zeros(len(h), np.int64)
        data = self.shared.value if self.shared is not None else self.data
        part = _part(h, self.parts).astype(np.int64)
        return _probed(h, data, self.begin[part], self.bits[part])


def _levels_of(f: Filter, h: np.ndarray) -> np.ndarray:
    u, back = np.unique(h, return_inverse=True)
    return f.levels(u)[back]


def _base(w: np.ndarray, n: np.ndarray, f: Filter, words: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    """Known tokens and base score of each text, from the exact counts; 0 without them."""
    if words is None or not len(n):
        return np.zeros(len(n), np.int64), np.zeros(len(n))
    keys, counts = words
    u, back = np.unique(w, return_inverse=True)
    i = np.minimum(np.searchsorted(keys, u), max(0, len(keys) - 1))
    c = np.where(keys[i] == u, counts[i], 0).astype(np.float64) if len(keys) else np.zeros(len(u))
    return _summed_base(c, back, n, f)


def _summed_base(c: np.ndarray, back: np.ndarray, n: np.ndarray, f: Filter) -> tuple[np.ndarray, np.ndarray]:
    """The same from the counts of different words, and which of them each token is."""
    at = np.cumsum(n) - n
    return np.add.reduceat((c > 0)[back].astype(np.int64), at), np.add.reduceat((np.log10(c + 1) - math.log10(f.n + f.v + 1))[back], at)


def _binary(x: np.ndarray, n: np.ndarray) -> pa.Array:
    off = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(off), pa.py_buffer(x.astype(np.uint8))])


def _level_rows(ids: list[pa.Array], n: np.ndarray, known: np.ndarray, base: np.ndarray, lw: np.ndarray, lp: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*ids, pa.array(n), pa.array(known), pa.array(base), _binary(lw, n), _binary(lp, n)], ["doc_id", "text_hash", "n_tokens", "n_known", "base_score", "words", "pairs"])


def _held(batches: Iterator[pa.RecordBatch], f: Filter, words: Broadcast | None) -> Iterator[pa.RecordBatch]:
    """Rows to the levels of their tokens and pairs, by the filter at hand."""
    words = words and words.value
    for batch in batches:
        for part, block in K.blocks(batch.column(2)):
            w, p, n = tokens(block)
            own = [c[part.start : part.stop] for c in batch.columns[:2]]
            yield _level_rows(own, n, *_base(w, n, f, words), _levels_of(f, w), _levels_of(f, p))


def _record(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows as a batch of a schema like ``DEALT``."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    names, types = zip(*(x.split(" ") for x in schema.split(", ")), strict=True)
    types = [pa.list_(kinds[t[6:-1]]) if t.startswith("array<") else kinds[t] for t in types]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))


def _planes(x: np.ndarray) -> bytes:
    """Numbers by byte: the lowest of all, then the next, so that the upper bytes of small ones pack well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _unplaned(x: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(x, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _steps(h: np.ndarray) -> bytes:
    """Hashes in order as their differences, by byte."""
    return _planes(np.diff(h, prepend=K.U(0)))


def _unstepped(x: bytes) -> np.ndarray:
    return np.cumsum(_unplaned(x, K.U), dtype=K.U)


def _release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of ended jobs: Spark deletes them once the driver has collected
    what refers to them. Those of the last job may still be referred to: call it after another one."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows to blocks: different words, the frequent ones first, and of each token its place among them, packed by byte."""
    held: list[tuple] = []
    size = 0

    def out() -> pa.RecordBatch:
        uw, at, c = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True, return_counts=True)
        order = np.argsort(-c, kind="stable")
        place = np.empty(len(uw), np.uint32)
        place[order] = np.arange(len(uw), dtype=np.uint32)
        own = [[y for x in held for y in x[i]] for i in range(1, 5)]
        return _record(BLOCKS, [(uuid.uuid4().hex, uw[order].tobytes(), ZSTD.compress(_planes(place[at]), asbytes=True), own[1], own[2], own[0], own[3])])

    for batch in batches:
        for part, block in K.blocks(batch.column(2)):
            w, n = _tokens(block)
            held.append((w, n.tolist(), *(batch.column(i)[part.start : part.stop].to_pylist() for i in (0, 1, 3))))
            size += len(w)
            if size > BLOCK_TOKENS:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def _block_rows(batch: pa.RecordBatch) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray]]:
    """Each block of a batch: its row, its different words, of each token its place among them, tokens a text."""
    for i in range(batch.num_rows):
        row = batch.slice(i, 1).to_pylist()[0]
        n = np.array(row["n_tokens"], np.int64)
        at = ZSTD.decompress(row["at"], 4 * int(n.sum()), asbytes=True)
        yield row, np.frombuffer(row["words"], K.U), _unplaned(at, np.uint32), n


def _pairs(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts on end: the different pairs in order, the order of all pairs, where a pair is the first of its kind in it, and the pair each one is."""
    p = pair(np.concatenate([[END], w[:-1]]), w)
    order = np.argsort(p)
    p = p[order]
    new = np.concatenate([[True], p[1:] != p[:-1]])
    first, which = np.flatnonzero(new), np.empty(len(p), np.int64)
    which[order] = np.cumsum(new) - 1
    return p[first], order, first, which


def _dealt(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Blocks to their different words and pairs in order, with their counts in texts that train, a row for each part."""
    for batch in batches:
        for row, uw, at, n in _block_rows(batch):
            own = np.repeat(np.array(row["learn"], bool), n)
            order = np.argsort(uw)
            words, times = uw[order], np.bincount(at[own], minlength=len(uw))[order].astype(np.uint32)
            pairs, by, first, _ = _pairs(uw[at])
            twice = np.add.reduceat(own[by], first, dtype=np.uint32)
            edges = [np.searchsorted(_part(h, parts), np.arange(parts + 1, dtype=K.U)).tolist() for h in (words, pairs)]
            some = [k for k in range(parts) if edges[0][k] < edges[0][k + 1] or edges[1][k] < edges[1][k + 1]]
            for ks in batched(some, 64):
                yield _record(DEALT, [(k, row["block"], *(to(x[e[k] : e[k + 1]]) for to, x, e in ((_steps, words, edges[0]), (_planes, times, edges[0]), (_steps, pairs, edges[1]), (_planes, twice, edges[1]))), None) for k in ks])


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dealt rows in order of part, to the levels of their words and pairs and the counts of their words.

    A part's model (block null: words, their counts, segment) comes before them; where none does, it
    is made of their counts, and a row (block null) has its tokens n and different words v."""
    part, given, held, size = None, None, [], 0

    def out() -> Iterator[pa.RecordBatch]:
        blocks = [x[0] for x in held]
        h = [np.concatenate([_unstepped(x[i]) for x in held]) for i in (1, 3)]
        u, back = zip(*(np.unique(x, return_inverse=True) for x in h), strict=True)
        if given is None:
            c = [np.concatenate([_unplaned(x[i], np.uint32) for x in held]) for i in (2, 4)]
            total, more = (np.bincount(b, weights=n, minlength=len(x)).astype(np.int64) for b, n, x in zip(back, c, u, strict=True))
            seg = _segment(np.concatenate([u[0][total > 0], u[1][more > 0]]), np.concatenate([total[total > 0], more[more > 0]]))
            yield _record(ANSWERS, [(None, part, None, None, None, int(total.sum()), int((total > 0).sum()))])
        else:
            words, counts, seg = given
            i = np.minimum(np.searchsorted(words, u[0]), max(0, len(words) - 1))
            total = np.where(words[i] == u[0], counts[i], 0) if len(words) else np.zeros(len(u[0]), np.int64)
        got = [_probed(x, seg, 0, K.U(8 * len(seg))).astype(np.uint8)[b] for x, b in zip(u, back, strict=True)]
        got.insert(1, total[back[0]])
        ends = [np.cumsum([0, *(len(x[i]) // 8 for x in held)]).tolist() for i in (1, 1, 3)]
        for ks in batched(range(len(held)), 256):
            yield _record(ANSWERS, [(blocks[k], part, *(x[e[k] : e[k + 1]].tobytes() for x, e in zip(got, ends, strict=True)), None, None) for k in ks])

    for batch in batches:
        for k, block, *own, segment in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (k != part or given is not None and size > BLOCK_TOKENS):
                yield from out()
                held, size = [], 0
            if k != part:
                part, given = k, None
            if block is None:
                given = np.frombuffer(own[0], K.U), np.frombuffer(own[1], np.int64), np.frombuffer(segment, np.uint8)
                continue
            held.append((block, *own))
            size += (len(own[0]) + len(own[2])) // 8
    if held:
        yield from out()


def _returned(batches: Iterator[pa.RecordBatch], f: Filter) -> Iterator[pa.RecordBatch]:
    """Rows in order of block and part, the block itself first and then its answers, to the levels of each text."""
    block, answers = None, []

    def out() -> pa.RecordBatch:
        row, uw, at, n = block
        order = np.argsort(uw)
        lw, c = np.empty(len(uw), np.uint8), np.empty(len(uw), np.float64)
        lw[order], c[order] = np.frombuffer(b"".join(x[0] for x in answers), np.uint8), np.frombuffer(b"".join(x[1] for x in answers), np.int64)
        lp = np.frombuffer(b"".join(x[2] for x in answers), np.uint8)[_pairs(uw[at])[3]]
        ids = [pa.array(row[c], pa.int64()) for c in ("doc_id", "text_hash")]
        return _level_rows(ids, n, *_summed_base(c, at, n, f), lw[at], lp)

    for batch in batches:
        for i, part in enumerate(batch.column("part").to_pylist()):
            if part >= 0:
                answers.append([batch.column(c)[i].as_py() for c in ("words", "times", "pairs")])
                continue
            if block:
                yield out()
            block, answers = next(_block_rows(batch.slice(i, 1))), []
    if block:
        yield out()


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0)).alias("text_hash"), F.col("text").cast("string"))


def _parts(chars: int) -> int:
    return max(8, math.ceil(chars / 5 / PART_TOKENS))


def _tasks(parts: int) -> int:
    return min(parts, MAX_TASKS)


def _blocks(rows: DataFrame, learn: Column) -> DataFrame:
    return stored(rows.withColumn("learn", F.coalesce(learn, F.lit(False))).mapInArrow(K.task("lm", _blocked), BLOCKS), "blocks")


def _answers(blocks: DataFrame, parts: int, table: DataFrame | None = None) -> DataFrame:
    """The answers of the parts to the blocks, from a model's table or else from the blocks' counts."""
    dealt = blocks.mapInArrow(K.task("lm", lambda it: _dealt(it, parts)), DEALT)
    if table is not None:
        none = F.lit(None)
        dealt = dealt.union(table.select("part", none.cast("string"), "words", "counts", none.cast("binary"), none.cast("binary"), "segment"))
    return stored(dealt.repartition(_tasks(parts), "part").sortWithinPartitions("part", "block").mapInArrow(K.task("lm", _answered), ANSWERS), "answers", "zstd")


def _levels(blocks: DataFrame, answers: DataFrame, f: Filter) -> DataFrame:
    light = f.light()
    both = blocks.drop("learn").withColumn("part", F.lit(-1)).unionByName(answers.where("block is not null").drop("n", "v"), allowMissingColumns=True)
    return both.repartition(_tasks(f.parts), "block").sortWithinPartitions("block", "part").mapInArrow(K.task("lm", lambda it: _returned(it, light)), LEVELLED)


def levelled(docs: DataFrame, model: Model, max_words: int = MAX_WORDS) -> DataFrame:
    """A row for each row of ``docs``: the filter's levels of its tokens and of their pairs, a
    byte each. Texts are dealt past ``max_words`` words; if that is negative, they needn't be,
    and n_known and base_score may be 0."""
    spark, rows = docs.sparkSession, _rows(docs)
    f = model.filter
    if f.spread or 0 <= max_words < f.v:
        blocks = _blocks(rows, F.lit(False))
        return _levels(blocks, _answers(blocks, f.parts, model.table), f)
    words = spark.sparkContext.broadcast(_words(model)) if f.v <= max_words else None
    f = f.sent(spark)
    return rows.mapInArrow(lambda it: _held(it, f, words), LEVELLED)


def learned(docs: DataFrame, learn: Column) -> tuple[DataFrame, Filter]:
    """The levels of the rows of ``docs`` by a model of those where ``learn`` (a condition on
    doc_id) holds, and what scoring needs of that model: the same as of ``train`` and ``levelled``."""
    rows = _rows(docs)
    size = F.octet_length("text")
    own, chars = rows.agg(F.sum(F.when(learn, size)), F.sum(size)).first()
    parts = _parts(max(own or 0, (chars or 0) // 2))
    blocks = _blocks(rows, learn)
    answers = _answers(blocks, parts)
    n, v = answers.where("block is null").agg(F.sum("n"), F.sum("v")).first()
    _release(docs.sparkSession)
    f = Filter(None, parts, n or 0, v or 0)
    levels = stored(_levels(blocks, answers, f), "levels", "zstd")
    drop(blocks, answers)
    if f.n:
        f.weights = fitted(levels.where(learn), f)
    _release(docs.sparkSession)
    return levels, f


def _places_of(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Slices of levelled rows, tokens a row, and of each token the cell (level of the word before, of the word, of the pair)."""
    for i in range(0, batch.num_rows, 512):
        own = batch.slice(i, 512)
        lw, lp = (np.frombuffer(b"".join(own.column(c).to_pylist()), np.uint8).astype(np.int64) for c in ("words", "pairs"))
        before = np.concatenate([lw[-1:], lw[:-1]])  # each text ends, so each begins after, the end
        yield slice(i, i + own.num_rows), own.column("n_tokens").to_numpy(), (before * (LEVELS + 1) + lw) * (LEVELS + 1) + lp


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((LEVELS + 1) ** 3, np.int64)
    for batch in batches:
        for _, _, cell in _places_of(batch):
            total += np.bincount(cell, minlength=len(total))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])


def fitted(levels: DataFrame, f: Filter) -> np.ndarray:
    """The weight of each level of the word before that makes ``levels`` likeliest, each place left out."""
    got = sorted(map(tuple, levels.mapInArrow(_cells, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect()))
    cell, n = np.array(got, np.int64).reshape(-1, 2).T
    before, lw, lp = cell // (LEVELS + 1) ** 2, cell // (LEVELS + 1) % (LEVELS + 1), cell % (LEVELS + 1)
    low = (np.maximum(ESTIMATE[lw] - 1, 0) + 1) / (f.n + f.v + 1)
    high = np.minimum(np.maximum(ESTIMATE[lp] - 1, 0) / np.maximum(ESTIMATE[before] - 1, 1), 1)
    gain = np.zeros((LEVELS + 1, len(WEIGHTS)))
    np.add.at(gain, before, n[:, None] * np.log(WEIGHTS[None, :] * high[:, None] + (1 - WEIGHTS[None, :]) * low[:, None]))
    return WEIGHTS[gain.argmax(axis=1)]


class Model:
    """What scoring needs: ``table`` of the parts in the shared folder, the filter, N and V."""

    def __init__(self, table: DataFrame, filter_: Filter):
        self.table, self.filter = table, filter_


def count(docs: DataFrame, max_sent: int = MAX_FILTER) -> Model:
    """The counts of the ``text`` of all rows of ``docs``; all weights are 0. The filter is sent up to ``max_sent`` bytes."""
    texts = docs.select(F.col("text").cast("string"))
    chars = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = _parts(chars)
    packed = texts.mapInArrow(lambda it: _packed(it, parts), "part int, kind int, hashes binary, counts binary")
    made = packed.repartition(_tasks(parts), "part").sortWithinPartitions("part", "kind").mapInArrow(_segments, "part int, n long, words binary, counts binary, segment binary")
    table = stored(made, "segments")
    size, n, v = table.agg(F.sum(F.octet_length("segment")), F.sum("n"), F.sum(F.octet_length("words") / 8)).first()
    segments = None
    if not n or size <= max_sent:
        segments = [bytes(8)] * parts
        for p, seg in table.select("part", "segment").toLocalIterator():
            segments[p] = bytes(seg)
    return Model(table, Filter(segments, parts, int(n or 0), int(v or 0)))


def train(docs: DataFrame, max_sent: int = MAX_FILTER) -> Model:
    """A model of the ``text`` of all rows of ``docs``."""
    model = count(docs, max_sent)
    if model.filter.n:
        model.filter.weights = fitted(levelled(docs, model, -1), model.filter)
    return model


def _words(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes in order, and their counts; parts are ranges of the hash."""
    h, n = np.zeros(model.filter.v, K.U), np.zeros(model.filter.v, np.int64)
    at = 0
    for w, c in model.table.orderBy("part").select("words", "counts").toLocalIterator():
        k = len(w) // 8
        h[at : at + k], n[at : at + k] = np.frombuffer(w, K.U), np.frombuffer(c, np.int64)
        at += k
    return h, n


def _scores(batches: Iterator[pa.RecordBatch], f: Filter) -> Iterator[pa.RecordBatch]:
    before, lw, lp = np.ogrid[: LEVELS + 1, : LEVELS + 1, : LEVELS + 1]
    high = np.minimum(ESTIMATE[lp] / np.maximum(ESTIMATE[before], 1), 1)
    term = np.log10(f.weights[before] * high + (1 - f.weights[before]) * (ESTIMATE[lw] + 1) / (f.n + f.v + 1)).ravel()
    for batch in batches:
        for part, n, cell in _places_of(batch):
            own = [c[part.start : part.stop] for c in batch.columns[:5]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.add.reduceat(term[cell], np.cumsum(n) - n))], ["doc_id", "text_hash", "n_tokens", "n_known", "base_score", "score"])


def score(docs: DataFrame, model: Model, max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``."""
    return scored(levelled(docs, model, max_words), model.filter)


def scored(levels: DataFrame, f: Filter) -> DataFrame:
    """The same from the levels."""
    light = f.light()
    schema = "doc_id long, text_hash long, n_tokens long, n_known long, base_score double, score double"
    out = levels.mapInArrow(K.task("lm", lambda it: _scores(it, light)), schema)
    return out.select("doc_id", "n_tokens", "n_known", F.lit(f.n).cast("long").alias("train_tokens"), "base_score", "score")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = scored(*learned(docs, ~held_out()))
    return got.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
