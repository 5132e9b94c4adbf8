"""SentencePiece encoding and decoding (operator 9) by a streaming Viterbi.

The lattice. For every boundary of a text the best way to reach it is one backpointer: the
last piece. Only the boundaries within the longest piece's length are kept; as soon as all
surviving paths run through one boundary, the ids before it are committed and forgotten, so
memory doesn't grow with the text.

Unigram models take the path of greatest score. For BPE models scores are merge ranks and
their sum says nothing, so the path is the one whose neighbouring pieces are all merged as
the model merges them: a sequence of pieces is what BPE yields if and only if each pair of
neighbours is what BPE yields for the pair alone, and each boundary has exactly one such
last piece. (Pairs are checked once and remembered; an automaton of all pieces, read as a
stream, tells which end at a boundary.) This gives the library's ids;
characters outside the vocabulary become byte pieces.

Spaces are written as U+2581, with one put before the text, as the model has it. A piece
has U+2581 only at its front or throughout, so no path leaves a boundary between another
character and U+2581 out: all paths converge there. The same holds between ASCII marks and
Latin letters or digits if no piece has them side by side. So the stream over a text is cut at
these certain boundaries as it is read; what lies between two of them goes through the Viterbi
(``path``), and the ids of spans of at most ``CACHED`` characters are kept in a cache in front of
it, which changes no id. At most ``SPANS`` spans are held at once, and never a lattice of the text.

Defined results. Null or empty text: no ids. Ties of unigram paths go to the longer last
piece. Repeated rows: one row each. Further columns are kept by ``encode`` and ignored by
the query; an empty table gives an empty result. Whole texts are encoded, of any length.
"""

from __future__ import annotations

import re
import sys
from array import array
from bisect import insort
from collections.abc import Iterator
from itertools import chain, filterfalse, islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tideline.llm import kernel as K

SPACE = "▁"
#: Spans remembered within a task, their longest, and neighbours remembered; a full cache is emptied.
REMEMBERED, CACHED, PAIRS = 300_000, 64, 300_000
#: Spans looked up at once, and characters that the automaton reads at once.
SPANS, BLOCK = 512, 4096


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _is_bpe(path: str) -> bool:
    """Reads the model type (1 unigram, 2 BPE) from the file's trainer section."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto())
    return m.trainer_spec.model_type == 2


class Encoder:
    """Encodes and decodes with the vocabulary of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        own = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id_of = {sp.id_to_piece(i): i for i in own}
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in own}
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = {int(p[3:-1], 16): i for i, p in enumerate(self.piece) if sp.is_byte(i)}
        self.raw = [bytes([int(p[3:-1], 16)]) if sp.is_byte(i) else p.encode() for i, p in enumerate(self.piece)]
        self.longest = max(map(len, self.id_of))
        self.bpe = _is_bpe(path)
        self.normal = sp.normalize
        self.unknown = min(self.score.values(), default=0.0) - 10
        self.pairs: dict[int, bool] = {}  # by both numbers: piece ids, and above them code points outside the vocabulary
        self.chunks: dict[str, bytes] = {}
        # BPE: how a piece came about (its last two parts); pieces that never form are left out.
        self.halves: dict[str, tuple[str, str]] = {}
        if self.bpe:
            for t in self.id_of:
                if len(t) > 1 and len(two := self._merged(t, 2)) == 2 and self._merged(t) == [t]:
                    self.halves[t] = (two[0], two[1])
        # Where no piece has an ASCII mark beside a Latin letter or digit, paths converge there too.
        self.split = _CHUNK if any(_MIXED.search(t) for t in (self.halves if self.bpe else self.id_of)) else _FINE
        self.usable = {t for t in self.id_of if len(t) == 1 or not self.bpe or t in self.halves}
        # Lengths by number; the one after the last, which -1 finds, is longer than any piece or text.
        self.length = [len(t) for t in self.piece] + [sys.maxsize]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t in self.usable:
            self.automaton.add_word(t, self.id_of[t])
        self.automaton.make_automaton()

    # -- the lattice

    def _merged(self, text: str, down_to: int = 1) -> list[str]:
        """BPE of a short text: merge the best-scored neighbours, the first on ties, until none is left."""
        parts = list(text)
        while len(parts) > down_to:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, left: int, right: int) -> bool:
        """Whether BPE leaves two neighbouring pieces as they are; remembered."""
        key = left << 22 | right
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            own = len(self.piece)
            a, b = (self.piece[n] if n < own else chr(n - own) for n in (left, right))
            got = self.pairs[key] = self._apart(a, b)
        return got

    def _apart(self, a: str, b: str) -> bool:
        """Undoes the later of the two pieces' last merges again and again. The pieces stay
        apart unless, at some moment, what touched across the border merged earlier than
        what was done instead; of equal merges the left one is first."""
        inf = float("inf")
        until, left_undone = inf, True  # the rank of the merge undone last, and its side
        while True:
            rank = -self.score.get(a + b, -inf)
            if rank < until or rank == until and not left_undone and rank < inf:
                return False
            ra = -self.score[a] if a in self.halves else -inf
            rb = -self.score[b] if b in self.halves else -inf
            if ra == rb == -inf:
                return True
            if ra > rb:
                until, left_undone, a = ra, True, self.halves[a][1]
            else:
                until, left_undone, b = rb, False, self.halves[b][0]

    def path(self, chunk: str) -> Iterator[list[str]]:
        """The pieces of the best path, in lists, each as soon as all surviving paths share it."""
        return self._bpe_path(chunk) if self.bpe else self._unigram_path(chunk)

    def _bpe_path(self, chunk: str) -> Iterator[list[str]]:
        pairs, length, longest, size = self.pairs, self.length, self.longest, len(chunk)
        # For each boundary from ``done`` to ``at``, the one last piece that fits what is before it (None: no path).
        last: list[int | None] = [0]
        done = at = 0
        stop = min(size, longest)
        for end, n in chain.from_iterable(self._endings(chunk)):
            if end < at:
                continue
            while at < end:  # no piece led to the boundary after ``at``
                last.append(self._lone(chunk[at], last[-1], at))
                at += 1
                if at == stop:
                    out, done = self._committed(chunk, last, done, at)
                    stop = min(size, at + longest)
                    yield out
            j = end + 1 - length[n]
            if j < done:
                continue
            if j:
                left = last[j - done]
                if left is None:
                    continue
                ok = pairs.get(left << 22 | n)
                if not (self._fits(left, n) if ok is None else ok):
                    continue
            last.append(n)
            at += 1
            if at == stop:
                out, done = self._committed(chunk, last, done, at)
                stop = min(size, at + longest)
                yield out
                if at == size:
                    return

    def _endings(self, chunk: str) -> Iterator:
        """The usable pieces that end at each character, as (its position, number); at last the
        text's end, with the number of a piece too long to fit. One automaton reads block by block."""
        found = self.automaton.iter(chunk[:BLOCK])
        yield found
        for at in range(BLOCK, len(chunk), BLOCK):
            found.set(chunk[at : at + BLOCK])
            yield found
        yield ((len(chunk), -1),)

    def _lone(self, char: str, left: int | None, at: int) -> int | None:
        """The number of a character outside the vocabulary, if a path leads to it."""
        if char in self.usable or left is None:
            return None
        n = len(self.piece) + ord(char)
        return n if not at or self._fits(left, n) else None

    def _committed(self, chunk: str, last: list[int | None], done: int, at: int) -> tuple[list[str], int]:
        """The pieces up to the boundary that all surviving paths share, and that boundary;
        ``last`` is shortened to what is after it."""
        piece, length, own = self.piece, self.length, len(self.piece)
        common = at
        if at < len(chunk):
            common = _meeting([None if n is None else length[n] if n < own else 1 for n in last], done, at, self.longest)
        out, k = [], common - done
        while k > 0:
            n = last[k]
            out.append(piece[n] if n < own else chr(n - own))
            k -= length[n] if n < own else 1
        out.reverse()
        del last[: common - done]
        return out, common

    def _unigram_path(self, chunk: str) -> Iterator[list[str]]:
        back: list[int | None] = [0]
        cost: dict[int, float] = {0: 0.0}
        size, longest, done = len(chunk), self.longest, 0
        for i in range(1, size + 1):
            back.append(self._cheapest(chunk, i, done, back, cost))
            if i == size or not (i - done) % longest:
                common = i if i == size else _meeting(back, done, i, longest)
                yield _walked(chunk, back, done, common)
                for j in range(done, common):
                    cost.pop(j, None)
                back, done = back[common - done :], common

    def _cheapest(self, chunk: str, i: int, done: int, back: list[int | None], cost: dict[int, float]) -> int | None:
        """Unigram: the length of the last piece of the path of greatest score; the longest on ties."""
        best = None
        for n in range(min(self.longest, i - done), 0, -1):
            t = chunk[i - n : i]
            if back[i - n - done] is None or n > 1 and t not in self.usable:
                continue
            c = cost[i - n] + self.score.get(t, self.unknown)
            if best is None or c > best[0]:
                best = c, n
        if best:
            cost[i] = best[0]
        return best and best[1]

    def _ids(self, chunk: str) -> bytes:
        out = array("i")
        for pieces in self.path(chunk):
            for p in pieces:
                i = self.id_of.get(p)
                if i is not None:
                    out.append(i)
                else:
                    out.extend([self.byte_id[b] for b in p.encode()])
        return out.tobytes()

    # -- texts

    def encode(self, text: str | None) -> np.ndarray:
        out = array("i")
        known = self.chunks
        spans = map(re.Match.group, self.split.finditer(self.normal(text) if text else ""))
        while block := list(islice(spans, SPANS)):
            if len(known) > REMEMBERED:
                known.clear()
            long = []
            for chunk in filterfalse(known.__contains__, block):
                known[chunk] = self._ids(chunk)
                if len(chunk) > CACHED:
                    long.append(chunk)
            out.frombytes(b"".join(map(known.__getitem__, block)))
            for chunk in long:
                del known[chunk]
        return np.frombuffer(out, np.int32) if out else np.zeros(0, np.int32)

    def forget(self) -> None:
        """Empties the caches, so a worker that goes on to other work doesn't hold them."""
        self.chunks.clear()
        self.pairs.clear()

    def decode(self, ids) -> str:
        raw = self.raw
        text = b"".join(map(raw.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def _meeting(back: list[int | None], done: int, i: int, longest: int) -> int:
    """The last boundary that the paths to all boundaries a later piece can start from have in common."""
    live = [j for j in range(max(done, i - longest), i + 1) if back[j - done] is not None]
    while len(live) > 1:
        j = live.pop()
        before = max(done, j - back[j - done])
        if before not in live:
            insort(live, before)
    return live[0]


def _walked(chunk: str, back: list[int | None], done: int, j: int) -> list[str]:
    """The pieces from ``done`` to the boundary j."""
    out = []
    while j > done:
        out.append(chunk[j - back[j - done] : j])
        j -= back[j - done]
    return out[::-1]


_MARK, _LATIN = "!-/:-@\\[-`{-~", "0-9A-Za-z\u00c0-\u024f"
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_REST = f"(?![^{SPACE}{_LATIN}{_MARK}])"
_FINE = re.compile(f"{SPACE}*+(?:[{_LATIN}]++{_REST}|[{_MARK}]++{_REST}|[^{SPACE}]++)|{SPACE}++")
_MIXED = re.compile(f"[{_MARK}][{_LATIN}]|[{_LATIN}][{_MARK}]")


def encoder(path: str) -> Encoder:
    return K.kept(path, lambda: Encoder(path))


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``docs``, all columns, with ids, n_ids and round_trip (decoding the ids gives the text)."""
    path = model or default_model()
    names = ["ids", "n_ids", "round_trip"]
    keep = docs.drop(*names)
    schema = T.StructType(list(keep.schema.fields))
    for name, kind in zip(names, (T.ArrayType(T.IntegerType()), T.LongType(), T.BooleanType()), strict=True):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            i = 0
            while i < whole.num_rows:
                batch = whole.slice(i, 256)
                i += 256
                texts = batch.column("text").to_pylist()
                ids = [enc.encode(t) for t in texts]
                same = [enc.decode(x.tolist()) == (t or "") for x, t in zip(ids, texts, strict=True)]
                size = np.array([len(x) for x in ids], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(size), pa.array(same)], [*batch.schema.names, *names])
        enc.forget()

    return keep.mapInArrow(K.task("pieces", run), schema)


def decode(rows: DataFrame, model: str | None = None) -> DataFrame:
    """``rows``, all columns, with ``text`` decoded from ``ids``; null ids give null."""
    path = model or default_model()
    keep = rows.drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            text = [None if x is None else enc.decode(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], [*b.schema.names, "text"])

    return keep.mapInArrow(K.task("pieces", run), T.StructType([*keep.schema.fields, T.StructField("text", T.StringType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs).select("doc_id", "n_ids", "ids", "round_trip")
