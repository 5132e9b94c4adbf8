"""Language identification (operator 2): interpolated Kneser-Ney character models.

Training. Letters are lowered, every other run of characters is one space, and a text
begins and ends with a space. Characters count in 16 bits, so a 4-gram is one 64-bit
number. 4-grams of at most about ``TRAIN_CHARS`` characters a language (rows picked by a
hash of doc_id, a documented bound) are counted on the workers; a fifth of the picked
rows calibrates instead. The orders below use continuation counts, and every order is
interpolated with the next by the absolute discount of Kneser and Ney, down to uniform.

Model. For each language and order two sorted hash arrays: n-gram to discounted
probability, context to back-off weight. Their size is bounded by the training bound.

Prediction. The language of least cross-entropy per character (length-normalised).

Calibrated rejection. A text's excess is its entropy less the calibration mean of the
language found, in deviations that shrink with the text's length: the variance is
v0 + v1 / length, fitted on the rightly predicted calibration rows of all languages together
(a language without any has the mean of all). The limit is the excess that a share of
``REJECT_RATE`` of right rows passes: beyond the ``TAIL`` quantile the excess is taken as
exponential with the mean found there, so the limit is defined for any number of rows.
``rejected``: no letter, an excess over the limit, or an entropy no better than the model's
uniform floor. With no right calibration row only the floor rejects.

``score`` is a logistic function of the lead over the second language, its slope fitted on the
calibration rows with one pseudo-row right and one wrong (so it is finite), times the
share of right rows that have so large an excess, over ``REJECT_RATE``, where it is rejected.

Defined results. Null text or no letter: ``und``, score 0, rejected. Ties go to the first
language in order of name. Languages that no training row has are never predicted; with no
training rows every row is ``und``. Further columns are ignored; an empty table gives an
empty result. Whole texts are read, whatever their length.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import kernel as K

ORDER = 4
TRAIN_CHARS = 4_000_000
#: Characters of all languages together, and languages, that one model is fitted on and for.
TRAIN_ALL, MAX_LANGS = 48_000_000, 4096
REJECT_RATE, TAIL = 1e-4, 0.1
_SLOTS = 1 << 20
_WORDS = re.compile(r"[^\W\d_]+")


def letters(text: str | None) -> list[str]:
    """The runs of letters (Unicode's categories L*) of the text in lower case."""
    words = _WORDS.findall((text or "").lower())
    if "".join(words).isalpha():
        return words
    # Some word holds a number sign (Nl, No), which the pattern takes for a letter.
    return "".join(c if c.isalpha() else " " for c in " ".join(words)).split()


def _codes(text: str | None) -> np.ndarray:
    """The normalised text as 16-bit numbers; empty if there is no letter."""
    t = " ".join(letters(text))
    if not t:
        return np.zeros(0, np.uint64)
    c = np.frombuffer(f" {t} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    return np.where(c > 0xFFFF, np.uint64(0xE000) + c % np.uint64(0x1000), c)


def _fourgrams(c: np.ndarray) -> np.ndarray:
    """The 4-gram that ends at each character from the second on; begins are padded with 0."""
    p = np.concatenate([np.zeros(ORDER - 2, np.uint64), c])
    out = np.zeros(max(0, len(c) - 1), np.uint64)
    for i in range(ORDER):
        out = (out << np.uint64(16)) | p[i : i + len(out)]
    return out


@dataclass
class Model:
    """``langs`` in order of name; ``tables[l][order]``: sorted hashes and values, of n-grams and of contexts."""

    langs: list[str]
    tables: list[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]
    floor: list[float]
    slope: float = 1.0
    means: tuple[float, ...] = ()
    variance: tuple[float, float] = (0.0, 0.0)
    tail: tuple[float, float] = (math.inf, 1.0)

    def excess(self, ent: np.ndarray, lens: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Deviations of entropies over the mean of the language found."""
        if not self.means:
            return np.zeros(len(ent))
        return (ent - np.array(self.means)[best]) / np.sqrt(self.variance[0] + self.variance[1] / np.maximum(lens, 1))

    def limit(self) -> float:
        """The excess that ``REJECT_RATE`` of right rows pass."""
        return self.tail[0] + self.tail[1] * math.log(TAIL / REJECT_RATE)

    def calibrate(self, lang: np.ndarray, ent: np.ndarray, lens: np.ndarray) -> None:
        """Fits means, variance and tail on right rows: index of the language, entropy, length."""
        if not len(ent):
            return
        n, total = np.bincount(lang, minlength=len(self.langs)), np.bincount(lang, ent, minlength=len(self.langs))
        self.means = tuple(np.where(n > 0, total / np.maximum(n, 1), ent.mean()))
        square = (ent - np.array(self.means)[lang]) ** 2
        inverse = 1 / np.maximum(lens, 1)
        # Least squares of square = v0 + v1 / length with neither negative.
        spread = ((inverse - inverse.mean()) ** 2).sum()
        v1 = max(0.0, float(((inverse - inverse.mean()) * (square - square.mean())).sum() / spread)) if spread > 1e-18 else 0.0
        v0 = float(square.mean() - v1 * inverse.mean())
        if v0 < 0:
            v0, v1 = 0.0, float((square * inverse).sum() / (inverse**2).sum())
        self.variance = (max(v0, 1e-6), v1)
        z = self.excess(ent, lens, lang)
        start = float(np.quantile(z, 1 - TAIL))
        over = z[z >= start] - start
        self.tail = (start, max(float(over.mean()), 0.1))

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """Minus the natural logarithm of each 4-gram's probability, a column for each language."""
        out = np.empty((len(grams), len(self.langs)), np.float32)
        for k, tables in enumerate(self.tables):
            p = np.full(len(grams), self.floor[k])
            for order in range(1, ORDER + 1):
                keys, probs, ctx, back = tables[order]
                low = grams & np.uint64((1 << 16 * order) - 1)
                p = _look(keys, probs, K.mix(low, order), 0.0) + p * _look(ctx, back, K.mix(low >> np.uint64(16), order + 8), 1.0)
            out[:, k] = -np.log(p)
        return out


def _look(keys: np.ndarray, values: np.ndarray, h: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(h), missing)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, values[at], missing)


def kneser_ney(grams: np.ndarray, counts: np.ndarray) -> tuple[dict, float]:
    """The tables of one language from its distinct 4-grams and their counts."""
    tables = {}
    g, c = grams.astype(np.uint64), counts.astype(np.float64)
    for order in range(ORDER, 0, -1):
        n1, n2 = float((c == 1).sum()), float((c == 2).sum())
        d = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        d = min(max(d, 0.1), 0.9)
        ctx, inv = np.unique(g >> np.uint64(16), return_inverse=True)
        total = np.bincount(inv, c)
        kinds = np.bincount(inv)
        prob, back = np.maximum(c - d, 0) / total[inv], d * kinds / total
        hg, hc = K.mix(g, order), K.mix(ctx, order + 8)
        og, oc = np.argsort(hg), np.argsort(hc)
        tables[order] = (hg[og], prob[og], hc[oc], back[oc])
        # Continuation counts: how many different characters go before the shorter n-gram.
        if order > 1:
            g, c = np.unique(g & np.uint64((1 << 16 * (order - 1)) - 1), return_counts=True)
            c = c.astype(np.float64)
    return tables, 1.0 / (len(g) + 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, gram, n), summed within the task."""
    held: dict[str, list] = {}
    size = 0

    def out():
        for lang, parts in held.items():
            g, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            g = _fourgrams(_codes(text))
            held.setdefault(lang, [np.zeros(0, np.uint64)]).append(g)
            size += len(g)
            if size > 4_000_000:
                yield from out()
                held, size = {}, 0
    yield from out()


class Scorer:
    """Entropies of texts. Costs of 4-grams seen before are kept in a table of fixed size."""

    def __init__(self, model: Model):
        self.m = model
        self.keys = np.zeros(_SLOTS, np.uint64)
        self.cost = np.zeros((_SLOTS, len(model.langs)), np.float32)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """A row for each text, infinite where there is no letter; and the texts' lengths."""
        out, size_of = np.full((len(texts), len(self.m.langs)), np.inf), np.zeros(len(texts), np.int64)
        i = 0
        while i < len(texts):
            part, size, j = [], 0, i
            while j < len(texts) and (not part or size < 500_000):
                part.append(_fourgrams(_codes(texts[j])))
                size += len(part[-1])
                j += 1
            lens = size_of[i:j] = np.array([len(x) for x in part])
            some = np.flatnonzero(lens)
            if len(some):
                cost = self._costs(np.concatenate(part))
                at = np.concatenate([[0], np.cumsum(lens[some])[:-1]])
                out[i + some] = np.add.reduceat(cost, at, axis=0, dtype=np.float64) / lens[some, None]
            i = j
        return out, size_of

    def _costs(self, grams: np.ndarray) -> np.ndarray:
        h = K.mix(grams)
        slot = (h >> np.uint64(44)).astype(np.int64)
        miss = np.flatnonzero(self.keys[slot] != h)
        cost = self.cost[slot]
        if len(miss):
            u, back = np.unique(grams[miss], return_inverse=True)
            fresh = self.m.costs(u)
            cost[miss] = fresh[back]
            hu = K.mix(u)
            su = (hu >> np.uint64(44)).astype(np.int64)
            _, own = np.unique(su, return_index=True)
            self.keys[su[own]], self.cost[su[own]] = hu[own], fresh[own]
        return cost


def scorer_of(name: str, shared: Broadcast) -> Scorer:
    """A worker's scorer of a broadcast model; its table of costs serves all tasks of the worker."""
    return K.kept(name, lambda: Scorer(shared.value))


def _lead(ent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    best = np.argmin(ent, axis=1)
    low = ent[np.arange(len(ent)), best]
    rest = ent.copy()
    rest[np.arange(len(ent)), best] = np.inf
    second = rest.min(axis=1) if ent.shape[1] > 1 else low + 1
    with np.errstate(invalid="ignore"):
        return best, low, second - low


def train(labelled: DataFrame, chars: int = TRAIN_CHARS) -> Model:
    """A model of the non-null ``lang`` of ``labelled`` (doc_id, text, lang)."""
    spark = labelled.sparkSession
    rows = labelled.where("text is not null and lang is not null").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang")
    sums = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.sum(F.length("text"))).limit(MAX_LANGS + 1).collect()}
    if len(sums) > MAX_LANGS:
        raise ValueError(f"lang has more than {MAX_LANGS} values")
    langs = sorted(k for k, v in sums.items() if v)
    chars = min(chars, TRAIN_ALL // max(1, len(langs)))
    if not langs:
        return Model([], [], [])
    rate = F.create_map(*(F.lit(x) for k in langs for x in (k, min(1.0, chars / sums[k]))))
    place = F.pmod(F.xxhash64(F.lit("pick"), "doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    picked = rows.withColumn("place", place / rate[F.col("lang")]).where("place < 1")
    grams = picked.where("place < 0.8").select("lang", "text").mapInArrow(K.task("langid", _count), "lang string, gram long, n long")
    got = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    tables, floor = [], []
    for k in langs:
        own = got[got.lang == k]
        t, f = kneser_ney(own.gram.to_numpy().view(np.uint64), own.n.to_numpy())
        tables.append(t)
        floor.append(f)
    model = Model(langs, tables, floor)
    shared = spark.sparkContext.broadcast(model)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            ent, lens = scorer.entropies(b.column(1).to_pylist())
            best, low, lead = _lead(ent)
            ok = np.isfinite(low)
            lang = np.array(b.column(0).to_pylist(), object)
            right = np.array(shared.value.langs, object)[best] == lang
            yield pa.RecordBatch.from_arrays([pa.array(lang[ok], pa.string()), pa.array(right[ok]), pa.array(low[ok]), pa.array(np.where(np.isfinite(lead), lead, 1.0)[ok]), pa.array(lens[ok])], ["lang", "right", "low", "lead", "size"])

    seen = picked.where("place >= 0.8").select("lang", "text").mapInArrow(K.task("langid", check), "lang string, right boolean, low double, lead double, size long").toPandas()
    model.slope = _slope(seen.lead.to_numpy(float), seen.right.to_numpy(bool))
    right = seen[seen.right]
    model.calibrate(np.searchsorted(np.array(langs, object), right.lang.to_numpy(object)), right.low.to_numpy(float), right["size"].to_numpy(float))
    return model


def _slope(lead: np.ndarray, right: np.ndarray) -> float:
    """The slope under which leads explain right and wrong best; a right and a wrong row of the mean lead are added."""
    tries = np.geomspace(0.01, 10_000, 240)
    lead = np.append(lead, [lead.mean() if len(lead) else 1.0] * 2)
    right = np.append(right, [True, False])
    z = tries[:, None] * lead[None, :]
    loss = np.where(right, np.logaddexp(0, -z), np.logaddexp(0, z)).sum(axis=1)
    return float(tries[int(np.argmin(loss))])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs``, all columns, with lang_pred, score, entropy and rejected. Only ``text`` is read."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    names = ["lang_pred", "score", "entropy", "rejected"]
    schema = docs.drop(*names).schema
    for column, kind in zip(names, ("string", "double", "double", "boolean"), strict=True):
        schema = schema.add(column, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(name, shared)
        m = scorer.m
        for b in (whole.slice(i, 1000) for whole in batches for i in range(0, max(1, whole.num_rows), 1000)):
            texts = b.column("text").to_pylist()
            lang = np.full(len(texts), "und", object)
            score, low, bad = np.zeros(len(texts)), np.full(len(texts), np.nan), np.ones(len(texts), bool)
            if m.langs and texts:
                every, lens = scorer.entropies(texts)
                best, ent, lead = _lead(every)
                ok = np.isfinite(ent)
                lang[ok] = np.array(m.langs, object)[best[ok]]
                over = m.excess(ent[ok], lens[ok], best[ok]) - m.limit()
                score[ok] = np.exp(-np.maximum(over, 0) / m.tail[1]) / (1 + np.exp(-np.minimum(m.slope * lead[ok], 700)))
                low[ok] = ent[ok]
                bad[ok] = (over > 0) | (ent[ok] >= -np.log(np.array(m.floor))[best[ok]])
            cols = [*b.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(low, mask=np.isnan(low)), pa.array(bad)]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names, *names])

    return docs.drop(*names).mapInArrow(K.task("langid", run), schema)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "entropy", "rejected")
