"""MinHash near-duplicates (operator 1).

One-permutation hashing with optimal densification, banded buckets, star-shaped
candidate edges, exact confirmation on the full shingle sets.

1. One pass over the texts makes a sketch for each row: the set of 5-word shingles is
   hashed once, the hash range is cut into ``bands * rows`` bins, a bin's value is its
   least hash, and an empty bin copies the first filled bin in a fixed random order of
   its own (optimal densification). ``rows`` bins make a band.
2. Rows with equal sets are one node from here on, so copies are never paired.
3. Nodes that share a band are a bucket. In the first ``LEAD`` bands each bucket is a
   star: its least node is paired with the others, n - 1 pairs for n nodes. Pairs are
   confirmed on the full sets, and links make components: a large group of near copies is
   one component from here on. The leaves of a star are dealt to tasks of about ``STAR``, each
   with a copy of the centre, so the centre of a large family is no hot key.
4. A star can lose a link between two of its leaves, so every bucket of every band that
   still holds two components is searched in full. Its largest component needs no
   comparison with itself: only the s other nodes are held against all m, in tasks of at most
   2 * SIDE nodes, so a bucket costs m * s / SIDE rows and one stray in a large family costs
   m. Nodes of different components are compared by their sketches, one byte a bin. Nodes
   with a partner whose estimate reaches ``cutoff`` get their texts, and the same task compares
   the full sets of just these pairs. Only links leave it, so no link within a bucket is lost to
   the stars, and no group's pairs are written out.

A pair at the threshold shares no bucket with chance (1 - t**rows)**bands: 1.7e-5 at
t = 0.75 with 56 bands of 6, under 1e-6 from 0.79 on. The estimate of such a pair has a
deviation of 0.024 and so lies 5 of them over ``CUTOFF``; ``cutoff=0`` compares every two nodes
that share a bucket on their full sets.

Defined results. Null or blank text: no shingles, component of its own. Fewer words
than five: the whole sequence is the one shingle. Null doc_id: no part in linking,
component_id null, kept false. Repeated rows: one row each, the same component; rows
that share a doc_id but not the text are linked each by its own text. Further columns are
ignored. An empty table gives an empty result. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import kernel as K
from tideline.llm.graph import components
from tideline.plans.scratch import drop, stored

BANDS, ROWS, WORDS, PERCENT = 56, 6, 5, 75
#: Bands whose stars are confirmed first; groups of near copies are one component after them.
LEAD = 6
#: Nodes of a side of a search task; the least estimate of the similarity that is confirmed on the full sets.
SIDE, CUTOFF = 512, 0.62
#: Leaves of a star in one task.
STAR = 128


def shingle_sets(block: K.Block, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block."""
    s, e, rows = block.spans(K.SPACED)
    h = block.hashes(s, e)
    g = K.grams(h, rows, words)
    n = block.counts(rows)
    at = np.concatenate([[0], np.cumsum(n)])
    out = []
    for r in range(block.n):
        if n[r] >= words:
            out.append(np.unique(g[at[r] : at[r + 1] - words + 1]))
        else:
            out.append(K.grams(h[at[r] : at[r + 1]], rows, int(n[r])) if n[r] else np.zeros(0, K.U))
    return out


@lru_cache(4)
def _donors(bins: int) -> np.ndarray:
    rng = np.random.default_rng(20240607)
    return np.stack([rng.permutation(bins) for _ in range(bins)])


def minima(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """Densified one-permutation minima, a row for each set; sets must not be empty."""
    lens = np.array([len(x) for x in sets])
    h = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), lens)
    at = (((h >> K.U(32)) * K.U(bins)) >> K.U(32)).astype(np.int64)
    first = np.ones(len(h), bool)
    first[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    sig, full = np.zeros((len(sets), bins), K.U), np.zeros((len(sets), bins), bool)
    sig[row[first], at[first]], full[row[first], at[first]] = h[first], True
    donors = _donors(bins)
    r, b = np.nonzero(~full)
    for attempt in range(bins):
        if not len(r):
            break
        d = donors[b, attempt]
        got = full[r, d]
        sig[r[got], b[got]] = sig[r[got], d[got]]
        r, b = r[~got], b[~got]
    return sig


def _sketches(batches: Iterator[pa.RecordBatch], bands: int, rows: int, words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, block in K.blocks(batch.column(2)):
            sets = shingle_sets(block, words)
            n = np.array([len(x) for x in sets], np.int64)
            some = np.flatnonzero(n)
            node, keys, low = np.zeros(len(n), K.U), np.zeros((len(n), bands), K.U), np.zeros((len(n), bands * rows), np.uint8)
            if len(some):
                own = [sets[i] for i in some]
                at = np.concatenate([[0], np.cumsum(n[some])[:-1]])
                node[some] = K.mix(np.add.reduceat(K.mix(np.concatenate(own), 1), at) + n[some].astype(K.U), 2)
                sig = minima(own, bands * rows)
                low[some] = K.mix(sig, 3).astype(np.uint8)
                sig = sig.reshape(len(some), bands, rows)
                acc = np.zeros((len(some), bands), K.U)
                for i in range(rows):
                    acc = K.mix(acc + sig[:, :, i], i)
                keys[some] = K.mix(acc + np.arange(bands, dtype=K.U), 9)
            size = np.where(n > 0, bands, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(keys[some].reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(c[part.start : part.stop] for c in batch.columns[:2]), pa.array(n), pa.array(node.view(np.int64)), lists, pa.array([x.tobytes() for x in low], pa.binary())], ["doc_id", "text_hash", "n_shingles", "node", "bands", "bins"])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string"))


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, words: int = WORDS) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, bands, bins): the set's size and hash, its band keys, and
    the low byte of each bin's value."""
    return _rows(docs).mapInArrow(K.task("neardup", lambda it: _sketches(it, bands, rows, words)), "doc_id long, text_hash long, n_shingles long, node long, bands array<long>, bins binary")


def _confirmed(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of (center, chunk), the centre's own first, to the links (u, v) of a centre and its
    leaves. Only the centre's set is held; texts are read block by block."""
    center, own = None, np.zeros(0, K.U)
    for batch in batches:
        ids, nodes = batch.column("center").to_pylist(), batch.column("node").to_pylist()
        u, v = [], []
        for part, block in K.blocks(batch.column("text")):
            for i, x in zip(range(part.start, part.stop), shingle_sets(block, words), strict=True):
                if nodes[i] == ids[i]:
                    center, own = ids[i], x
                elif ids[i] == center:
                    both = len(np.intersect1d(own, x, assume_unique=True))
                    if len(x) and 100 * both >= percent * (len(own) + len(x) - both):
                        u.append(ids[i])
                        v.append(nodes[i])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _texts(docs: DataFrame, members: DataFrame, classes: DataFrame) -> DataFrame:
    """A written table (node, text) of each node of ``members``, by the id and the text's hash of one of
    its rows: rows that share a doc_id but not the text are told apart."""
    need = members.select("node").distinct().join(classes.select("node", "rep.doc_id", "rep.text_hash"), "node")
    found = _rows(docs).join(need, ["doc_id", "text_hash"]).groupBy("node").agg(F.first("text").alias("text"))
    return stored(found, "texts")


def confirm(pairs: DataFrame, texts: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Links (u, v) among ``pairs`` (center, node): a star's leaves in tasks of about STAR."""
    chunks = pairs.groupBy("center").agg(F.ceil(F.count("*") / STAR).cast("int").alias("chunks"))
    leaves = pairs.join(chunks, "center").select("center", F.pmod(F.xxhash64("node"), "chunks").cast("int").alias("chunk"), "node")
    centers = chunks.select("center", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("center").alias("node"))
    rows = leaves.union(centers).join(texts, "node").select("center", "chunk", (F.col("node") != F.col("center")).alias("leaf"), "node", "text")
    rows = rows.repartition("center", "chunk").sortWithinPartitions("center", "chunk", "leaf")
    return rows.mapInArrow(K.task("neardup", lambda it: _confirmed(it, words, percent)), "u long, v long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in order of (key, i, j), cut where these change; at most 2 * SIDE rows or so each."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        run = np.stack([t.column(c).to_numpy() for c in ("key", "i", "j")])
        cuts = [0, *(np.flatnonzero((run[:, 1:] != run[:, :-1]).any(0)) + 1).tolist()]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield t.slice(lo, hi - lo)
        rest = t.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def _alike(t: pa.Table, percent: int, cutoff: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a run, the rows of the other side and another component whose sketches are alike."""
    side, node, root, n = (t.column(c).to_numpy() for c in ("side", "node", "root", "n"))
    bins = np.frombuffer(b"".join(t.column("bins").to_pylist()), np.uint8).reshape(t.num_rows, -1)
    i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
    least = (cutoff + (1 - cutoff) / 256) * bins.shape[1]
    far = np.flatnonzero(side == j)
    for x in np.flatnonzero(side == i):
        y = far[far > x] if i == j else far
        y = y[(root[y] != root[x]) & (100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x]))]
        if len(y):
            y = y[np.count_nonzero(bins[y] == bins[x], axis=1) >= least]
            if len(y):
                yield int(x), y


def _searched(batches: Iterator[pa.RecordBatch], percent: int, cutoff: float) -> Iterator[pa.RecordBatch]:
    """The rows that have a partner in their run."""
    for t in _runs(batches):
        has = np.zeros(t.num_rows, bool)
        for x, y in _alike(t, percent, cutoff):
            has[x] = True
            has[y] = True
        if has.any():
            yield from t.filter(pa.array(has)).combine_chunks().to_batches()


def _linked(batches: Iterator[pa.RecordBatch], words: int, percent: int, cutoff: float) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of the rows' texts; none between nodes already joined within the run."""
    for t in _runs(batches):
        sets = [s for _, block in K.blocks(t.column("text")) for s in shingle_sets(block, words)]
        node = t.column("node").to_numpy()
        up = {int(r): int(r) for r in t.column("root").to_numpy()}
        root = t.column("root").to_pylist()

        def top(r: int, up: dict[int, int] = up) -> int:
            while up[r] != r:
                up[r] = r = up[up[r]]
            return r

        u, v = [], []
        for x, ys in _alike(t, percent, cutoff):
            for y in ys.tolist():
                if top(root[x]) == top(root[y]):
                    continue
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    up[top(root[x])] = top(root[y])
                    u.append(node[x])
                    v.append(node[y])
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def search(members: DataFrame, roots: DataFrame, classes: DataFrame, texts: DataFrame, words: int = WORDS, percent: int = PERCENT, cutoff: float = CUTOFF) -> DataFrame:
    """Links (u, v) within buckets between components, enough of them to join what belongs together."""
    now = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    sizes = now.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("roots"), F.sum("n").alias("m"), F.max(F.struct("n", "root")).alias("most"))
    # Chunks of the nodes outside the bucket's largest component come first, then the chunks of that.
    less, most = F.ceil((F.col("m") - F.col("most.n")) / SIDE), F.ceil(F.col("most.n") / SIDE)
    open_ = sizes.where("roots > 1").select("key", F.col("most.root").alias("main"), less.cast("int").alias("less"), most.cast("int").alias("most"))
    dealt, mix = now.join(open_, "key"), F.xxhash64("node", "key")
    minor = F.col("root") != F.col("main")
    dealt = dealt.withColumn("side", F.when(minor, F.pmod(mix, "less")).otherwise(F.col("less") + F.pmod(mix, "most")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(minor, F.col("less") + F.col("most")).otherwise(F.col("less")) - 1)))
    dealt = dealt.select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node", "root")
    run = ["key", "i", "j"]
    full = dealt.join(classes.select("node", "n", "bins"), "node").select(*run, "side", "node", "root", "n", "bins")
    full = full.repartition(*run).sortWithinPartitions(*run)
    near = stored(full.mapInArrow(K.task("neardup", lambda it: _searched(it, percent, cutoff)), full.schema), "near")
    near = near.join(texts, "node").select(*full.columns, "text").repartition(*run).sortWithinPartitions(*run)
    return near.mapInArrow(K.task("neardup", lambda it: _linked(it, words, percent, cutoff)), "u long, v long")


def near_duplicates(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, words: int = WORDS, percent: int = PERCENT, cutoff: float = CUTOFF) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_shingles, component_id, kept, text_hash. See the module."""
    sk = stored(sketches(docs, bands, rows, words), "sketches")
    live = sk.where("n_shingles > 0 and doc_id is not null")
    classes = stored(live.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("bins").alias("bins")), "classes")
    banded = classes.select("node", "n", F.posexplode("bands").alias("band", "key"))
    stars = banded.groupBy("key").agg(F.min(F.struct("node", "n")).alias("least"), F.count("*").alias("size")).where("size > 1")
    members = stored(banded.join(stars, "key").select("key", "band", "node", "n", F.col("least.node").alias("center"), F.col("least.n").alias("center_n")), "members")
    texts = _texts(docs, members, classes)
    # A pair whose sizes alone rule it out is dropped first.
    sized = members.where((F.col("node") != F.col("center")) & (F.col("band") < LEAD)).where(f"100 * least(n, center_n) >= {percent} * greatest(n, center_n)")
    first = stored(sized.select("center", "node").distinct(), "pairs")
    links = stored(confirm(first, texts, words, percent), "links")
    roots = stored(components(links), "roots")
    links = stored(search(members, roots, classes, texts, words, percent, cutoff), "links")
    roots = stored(components(links.union(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))), "roots")
    drop(texts, members, first)
    named = classes.select("node", "rep.doc_id").join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    lowest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_node = stored(named.join(lowest, "root").select("node", "component_id"), "component")
    drop(classes)
    out = sk.select("doc_id", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node")).join(of_node, "node", "left")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", found.alias("component_id"), F.coalesce(F.col("doc_id") == found, F.lit(False)).alias("kept"), "text_hash")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are kept; rows without doc_id stay. Rows that share
    a doc_id are told apart by their text."""
    h, d = K.fresh(docs, "text_hash", "kept_id")
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias(d), F.col("text_hash").alias(h)).distinct()
    keyed = docs.withColumn(d, F.col("doc_id").cast("long")).withColumn(h, F.xxhash64(F.col("text").cast("string")))
    return keyed.join(kept, [d, h], "left_semi").select(*docs.columns).union(docs.where("doc_id is null"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")


SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
place AS (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {WORDS - 1}) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least({WORDS}, len(w)) - 1], ' ') AS g FROM place),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)),
b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r(doc_id, low) AS (SELECT doc_id, doc_id FROM d UNION SELECT b.v, r.low FROM r JOIN b ON b.u = r.doc_id WHERE r.low < b.v)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.low AS component_id, d.doc_id = c.low AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT doc_id, min(low) AS low FROM r GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""
