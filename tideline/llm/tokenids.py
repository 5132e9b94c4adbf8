"""Token ids in binary shards with a minimal perfect hash index (operator 4).

Writing. Rows are range-partitioned and sorted by doc_id (rows of one doc_id by the hash of their
text, so a frequent or null id is no hot shard); each partition encodes its texts,
appends the end id and writes one shard: ``NNNNN.ids``, the raw little-endian ids of its
documents on end (unsigned, 16 bits where the vocabulary allows, else 32), and
``NNNNN.idx``, its index. A file is written under a name of its own attempt and then moved,
so a lost executor or a second attempt leaves the same files. The driver gets one row a
shard (documents, ids, first and last doc_id) and turns the sums into each shard's start.

Index. A key is a document's id and its ordinal among equal ids of its shard. The keys are put into a
minimal perfect hash: level after level, keys alone on their bit stay, the others go on;
a key's slot is the number of bits before its own. A slot holds the key's 32-bit
fingerprint, the offset and the number of ids, so one document is found by a few bit
probes and one read, and an absent key is refused but for one in 2**32. ``lookup`` finds the
shards of an id by their first and last ids. Should two keys of a shard have one hash, the next
seed is taken.

Encoding. For a tokenizer that lowers, drops white space and splits letters from marks
(checked in its file) ids of a text are the ids of its units one after another; a block's
different units are encoded once. Texts with the string of an added token, and other
tokenizers, are encoded whole by the library.

Defined results. Null or empty text: the end id alone. Null doc_id: a key of its own,
before all others. Repeated rows: each is written, those of one id in the order of their texts'
hashes. Further columns are ignored; an empty table gives no shard and an empty result.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import kernel as K
from tideline.plans.scratch import new_path

END_ID = 2
SHARD_CHARS = 48 << 20
_LETTER = K.byte_class(*range(0x41, 0x5B), *range(0x61, 0x7B))
_MARK = K.byte_class(*(c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != 0x27))
#: Units remembered by a worker; the memory is emptied when it is full.
REMEMBERED = 600_000
# Fixed value: the splitting pattern under which units may be encoded apart.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of blocks of texts by one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.wide = self.t.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = json.dumps(spec.get("pre_tokenizer"))
        drops = '"type": "Lowercase"' in json.dumps(spec.get("normalizer")) and '"behavior": "Removed", "invert": true' in pre
        self.apart = drops and json.dumps(_PATTERN) in pre and not spec.get("post_processor")
        self.added = [x["content"].encode() for x in spec.get("added_tokens", [])]
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.pool = [np.zeros(0, self.kind)]
        self.start, self.size, self.held = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def _learn(self, hashes: list[int], units: list[str]) -> None:
        starts, sizes = [self.start], [self.size]
        self.known.update(zip(hashes, range(len(self.start), len(self.start) + len(hashes)), strict=True))
        for i in range(0, len(units), 256):
            own = units[i : i + 256]
            got = self.t.encode(" ".join(own), add_special_tokens=False)
            begin = np.cumsum([0] + [len(u) + 1 for u in own])
            at = np.searchsorted(begin, [a for a, _ in got.offsets], side="right") - 1
            n = np.bincount(at, minlength=len(own))[: len(own)]
            starts.append(self.held + np.cumsum(n) - n)
            sizes.append(n)
            self.pool.append(np.array(got.ids, self.kind))
            self.held += len(got.ids)
        self.start, self.size, self.pool = np.concatenate(starts), np.concatenate(sizes), [np.concatenate(self.pool)]

    def block(self, b: K.Block) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a block on end, without end ids, and how many each has."""
        raw = b.buf.tobytes()
        if not self.apart or any(x in raw for x in self.added):
            texts = [raw[b.off[i] : b.off[i + 1]].decode() for i in range(b.n)]
            got = [np.array(e.ids, self.kind) for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate(got), np.array([len(x) for x in got])
        letter, mark = _LETTER[b.buf], _MARK[b.buf]
        cut = 1 + np.flatnonzero(letter[:-1] & mark[1:] | mark[:-1] & letter[1:]) if len(raw) else np.zeros(0, np.int64)
        s, e, rows = b.spans(K.SPACED, cut)
        h, first, back = np.unique(b.hashes(s, e), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.clear()
        keys = h.tolist()
        slot = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(slot < 0)
        if len(new):
            slot[new] = np.arange(len(self.known), len(self.known) + len(new))
            self._learn(h[new].tolist(), [raw[a:z].decode() for a, z in zip(s[first[new]].tolist(), e[first[new]].tolist(), strict=True)])
        slot = slot[back]
        start, size = self.start[slot], self.size[slot]
        total = np.cumsum(size)
        at = np.repeat(start - (total - size), size) + np.arange(int(total[-1]) if len(total) else 0)
        return self.pool[0][at], np.bincount(rows, size, minlength=b.n).astype(np.int64)


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """A worker's encoder of a file; it and the units it remembers serve all tasks of the worker."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


class PerfectHash:
    """A minimal perfect hash of different 64-bit keys: bits of all levels, and counts before each word."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.begin = np.cumsum(sizes) - sizes
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, parts, left = [], [], np.asarray(keys, K.U)
        while len(left):
            m = -(-max(64, int(len(left) * 1.5)) // 64) * 64
            at = (K.mix(left, 500 + len(sizes)) % K.U(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            parts.append(np.packbits(alone, bitorder="little"))
            sizes.append(m)
            left = left[~alone[at]]
        words = np.concatenate(parts).view("<u8") if parts else np.zeros(0, "<u8")
        return cls(np.array(sizes, np.int64), words)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, in 0..n-1; -1 if no level has it."""
        out, live = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, m in enumerate(self.sizes):
            if not len(live):
                break
            at = self.begin[k] + (K.mix(keys[live], 500 + k) % K.U(m)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(K.U)
            yes = (word >> bit) & K.U(1) == 1
            below = np.bitwise_count(word & ((K.U(1) << bit) - K.U(1))).astype(np.int64)
            out[live[yes]] = (self.before[at >> 6] + below)[yes]
            live = live[~yes]
        return out


_NULL = 0x6E756C6C


def keys_of(doc_ids: np.ndarray, null: np.ndarray, ordinal: np.ndarray, seed: int = 0) -> np.ndarray:
    """The 64-bit key of a document: different (doc_id, ordinal) have different keys but for chance."""
    return K.mix(K.mix(np.where(null, _NULL, doc_ids).astype(np.int64).view(K.U) ^ null.astype(K.U) << K.U(63), 31 + 2 * seed) + ordinal.astype(K.U), 32 + 2 * seed)


def seeded(doc_ids: np.ndarray, null: np.ndarray, ordinal: np.ndarray, hashed=keys_of) -> tuple[int, np.ndarray]:
    """The first seed under which all keys differ, and the keys."""
    for seed in range(1000, 1064):
        keys = hashed(doc_ids, null, ordinal, seed)
        if len(np.unique(keys)) == len(keys):
            return seed, keys
    raise ValueError("two documents have the same id and ordinal")


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _put(fs: pafs.FileSystem, temporary: str, name: str, chunks: Iterator[bytes]) -> None:
    with fs.open_output_stream(temporary) as f:
        for c in chunks:
            f.write(c)
    fs.move(temporary, name)


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> list[tuple]:
    """Write shards below ``path``; gives (shard, documents, ids, first doc_id, last doc_id) of each, in order."""
    spark = docs.sparkSession
    model = tokenizer or default_tokenizer()
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // SHARD_CHARS))
    fs, base = _fs(path)
    fs.create_dir(base, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard, own = task.partitionId(), f".{task.taskAttemptId()}"
        fs, base = _fs(path)
        enc = encoder(model)
        ids, sizes = [], []

        def payload() -> Iterator[bytes]:
            for batch in batches:
                for part, block in K.blocks(batch.column(1)):
                    got, n = enc.block(block)
                    out = np.full(len(got) + block.n, end_id, enc.kind)
                    ends = np.cumsum(n + 1) - 1
                    inside = np.ones(len(out), bool)
                    inside[ends] = False
                    out[inside] = got
                    ids.append(batch.column(0)[part.start : part.stop])
                    sizes.append(n + 1)
                    yield out.tobytes()

        _put(fs, f"{base}/{shard:05d}.ids{own}", f"{base}/{shard:05d}.ids", payload())
        if not sizes:
            fs.delete_file(f"{base}/{shard:05d}.ids")
            return
        doc = pa.concat_arrays(ids)
        n = np.concatenate(sizes)
        null = doc.is_null().to_numpy(zero_copy_only=False)
        doc = doc.fill_null(0).to_numpy()
        fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (null[1:] != null[:-1])])
        first = np.flatnonzero(fresh)
        ordinal = np.arange(len(doc)) - first[np.cumsum(fresh) - 1]
        seed, keys = seeded(doc, null, ordinal)
        mph = PerfectHash.build(keys)
        slot = mph.slots(keys)
        index = {k: np.zeros(len(doc), t) for k, t in (("print", "<u4"), ("offset", "<u8"), ("count", "<u4"))}
        index["print"][slot], index["offset"][slot], index["count"][slot] = K.mix(keys, 33).astype(np.uint32), np.cumsum(n) - n, n
        arrays = {"doc_id": doc.astype("<i8"), "null": null.astype("u1"), "ordinal": ordinal.astype("<u4"), "sizes": mph.sizes.astype("<i8"), "words": mph.words, **index}
        head = json.dumps({"ids": enc.kind.str, "end": end_id, "seed": seed, "arrays": [[k, a.dtype.str, len(a)] for k, a in arrays.items()]}).encode()
        _put(fs, f"{base}/{shard:05d}.idx{own}", f"{base}/{shard:05d}.idx", iter([len(head).to_bytes(8, "little"), head, *(a.tobytes() for a in arrays.values())]))
        ends = [None if null[i] else int(doc[i]) for i in (0, -1)]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard, len(doc), int(n.sum()), *ends)], ["shard", "docs", "ids", "first", "last"])

    order = [F.asc_nulls_first("doc_id"), F.asc("text_hash")]
    ordered = rows.withColumn("text_hash", F.xxhash64("text")).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    return sorted((tuple(r) for r in ordered.mapInArrow(run, "shard long, docs long, ids long, first long, last long").collect()), key=lambda r: r[0])


class Shard:
    """One shard's files, opened: its index in memory, its ids read as asked."""

    def __init__(self, path: str, shard: int):
        self.fs, base = _fs(path)
        self.name = f"{base}/{shard:05d}"
        raw = self.fs.open_input_stream(f"{self.name}.idx").read()
        n = int.from_bytes(raw[:8], "little")
        head, at = json.loads(raw[8 : 8 + n]), 8 + n
        self.arrays = {}
        for k, kind, size in head["arrays"]:
            self.arrays[k] = np.frombuffer(raw, kind, size, at)
            at += size * np.dtype(kind).itemsize
        self.kind, self.seed = np.dtype(head["ids"]), head["seed"]
        self.mph = PerfectHash(self.arrays["sizes"], self.arrays["words"])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key is there, the offset of its ids and their number."""
        slot = self.mph.slots(keys)
        there = slot >= 0
        there[there] = self.arrays["print"][slot[there]] == K.mix(keys[there], 33).astype(np.uint32)
        at = np.where(there, slot, 0)
        return there, self.arrays["offset"][at].astype(np.int64), self.arrays["count"][at].astype(np.int64)

    def keys(self, doc_ids: np.ndarray, null: np.ndarray, ordinal: np.ndarray) -> np.ndarray:
        return keys_of(doc_ids, null, ordinal, self.seed)

    def ids(self, offset: int, count: int) -> np.ndarray:
        with self.fs.open_input_file(f"{self.name}.ids") as f:
            f.seek(offset * self.kind.itemsize)
            return np.frombuffer(f.read(count * self.kind.itemsize), self.kind)


def lookup(path: str, shards: list[tuple], doc_id: int | None) -> list[np.ndarray]:
    """The ids of each document of this doc_id, by its keys: a few probes and a read for each."""
    low = lambda x: (x is not None, x)  # noqa: E731  null ids come first
    out = []
    at = bisect_left([low(x[4]) for x in shards], low(doc_id))
    while at < len(shards) and low(shards[at][3]) <= low(doc_id):
        sh, ordinal, there = Shard(path, shards[at][0]), 0, True
        while there:
            key = sh.keys(np.array([doc_id or 0]), np.array([doc_id is None]), np.array([ordinal]))
            (there,), (offset,), (count,) = sh.find(key)
            if there:
                out.append(sh.ids(int(offset), int(count)))
            ordinal += 1
        at += 1
    return out


def read(spark: SparkSession, path: str, shards: list[tuple]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, looked up by its key in the files."""
    start, total = [], 0
    for shard, _, n, *_ in shards:
        start.append((shard, total))
        total += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sh = Shard(path, shard)
                a = sh.arrays
                null = a["null"].astype(bool)
                there, offset, count = sh.find(sh.keys(a["doc_id"], null, a["ordinal"]))
                if not there.all():
                    raise ValueError(f"{sh.name}: the index misses {int((~there).sum())} of its keys")
                with sh.fs.open_input_stream(f"{sh.name}.ids") as f:
                    crc, at = np.zeros(len(count), np.int64), 0
                    for i in np.argsort(offset, kind="stable"):
                        if offset[i] != at:
                            raise ValueError(f"{sh.name}: ids of a document begin at {offset[i]}, not at {at}")
                        crc[i] = zlib.crc32(np.frombuffer(f.read(int(count[i]) * sh.kind.itemsize), sh.kind).astype("<u4").tobytes())
                        at += int(count[i])
                yield pa.RecordBatch.from_arrays([pa.array(a["doc_id"], mask=null), pa.array(before + offset), pa.array(count), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # The list goes into the plan's rows, not into every task's closure.
    rows = spark.createDataFrame(start, "shard long, before long").repartition(max(1, len(start)))
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "ids")
    return read(spark, path, write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path))
