"""Unigram segmentation over the pieces of a SentencePiece vocabulary file.

Texts are escaped as the tokenizer does (a leading U+2581, spaces as U+2581). No piece holds U+2581 after
another character, or a line feed beside another one, so a text falls into units (white space and a word; a
line feed) that no piece crosses: the best segmentation of a text is that of its units, side by side. Units
repeat, so a task keeps the results of those it has met, in tables of a bounded number of bytes.

Scores add up as 32-bit floats inside a unit, as in the tokenizer: each sum is rounded, which changes nothing
for whole numbers within 2 ** 24. Between units they add up exactly; the tokenizer's own running sum over a text
loses precision beyond 2 ** 24.

A very long text without a space is one unit. It is walked by end positions; counts keep a ring as long as the
longest piece, segmentations a few numbers a character in flat arrays.

Ties, as in the tokenizer: of equal scores at a position, the longest last piece wins. A character without a
piece of its own costs ten below the worst piece, and becomes its UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import per_batch

SPACE = "▁"
#: Bytes of each table of units that a task remembers before it makes room; about what an entry takes besides
#: its unit and result; characters of the longest unit that is worth it.
REMEMBERED, ENTRY, WORTH = 64 << 20, 240, 64
#: Scores up to this stand for pieces that are the last choice; they count as one less than the worst other score.
NEVER = -1e6
#: Characters of a unit whose sums 32-bit floats surely hold exactly.
SHORT = 500
_EXACT, _NONE = float(1 << 24), -math.inf


@dataclass(frozen=True)
class Vocabulary:
    """Pieces and scores as the file has them, and the ids of the 256 byte pieces."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    plain: tuple[int, ...]  # ids of pieces that match text
    byte_ids: tuple[int, ...]
    unknown: float


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load(path: str | None = None) -> Vocabulary:
    """Reads a vocabulary file on the driver; tasks get it broadcast, a megabyte or so."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path or default_path(), "rb") as f:
        model.ParseFromString(f.read())
    kind = pb.ModelProto.SentencePiece
    plain = tuple(k for k, p in enumerate(model.pieces) if p.type in (kind.NORMAL, kind.USER_DEFINED))
    byte_of = {int(p.piece[3:5], 16): k for k, p in enumerate(model.pieces) if p.type == kind.BYTE}
    real = [model.pieces[k].score for k in plain if model.pieces[k].score > NEVER]
    scores = tuple(p.score if p.score > NEVER else min(real) - 1 for p in model.pieces)
    worst = min(scores[k] for k in plain)
    return Vocabulary(tuple(p.piece for p in model.pieces), scores, plain, tuple(byte_of[b] for b in range(256)), float(np.float32(worst - 10)))


def _whole(x: float) -> float:
    return x if -_EXACT < x < _EXACT else float(np.float32(x))


def _rounded(x: float) -> float:
    return float(np.float32(x))


class Remembered(dict):
    """What a function gave for each unit, as far as memory allows. size: bytes of a result."""

    def __init__(self, f: Callable, most: int = REMEMBERED, size: Callable = lambda out: 0) -> None:
        super().__init__()
        self.f, self.most, self.size, self.used = f, most, size, 0

    def __missing__(self, unit):
        out, long = self.f(unit), len(unit if isinstance(unit, str) else unit[0])
        if long <= WORTH:
            if self.used >= self.most:
                self.clear()
            self.used += ENTRY + long + self.size(out)
            self[unit] = out
        return out

    def clear(self) -> None:
        super().clear()
        self.used = 0


class Numbered(dict):
    """A number for each unit, and by number what is known of its best segmentation.

    It has two halves: when one is full, it takes the place of the older one, and what is met again there is
    carried over. So frequent units stay, however many rare ones come by.
    """

    def __init__(self, f: Callable[[str], tuple[bytes, float, float, int]], most: int = REMEMBERED) -> None:
        super().__init__()
        self.f, self.most = f, most
        self.clear()

    def clear(self) -> None:
        self._start()
        self.older: tuple = ({}, self.ids, self.scores, self.losses, self.sizes)

    def _start(self) -> None:
        super().clear()
        self.used, self.ids = 0, []
        self.scores, self.losses, self.sizes = array("d"), array("d"), array("q")

    def make_room(self) -> None:
        """Gives up the older half if the newer one is full; between texts, as numbers hold within one."""
        if self.used >= self.most // 2:
            self.older = (dict(self), self.ids, self.scores, self.losses, self.sizes)
            self._start()

    def __missing__(self, unit: str) -> int:
        known, *values = self.older
        k = known.get(unit)
        ids, score, loss, size = self.f(unit) if k is None else (v[k] for v in values)
        number = self[unit] = len(self.ids)
        self.used += ENTRY + len(unit) + len(ids)
        self.ids.append(ids), self.scores.append(score), self.losses.append(loss), self.sizes.append(size)
        return number


class Lattice:
    """Segmentations of units."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        v = self.vocabulary = vocabulary
        self.matches = ahocorasick.Automaton()
        for k in v.plain:
            self.matches.add_word(v.pieces[k], (len(v.pieces[k]), v.scores[k], k))
        self.matches.make_automaton()
        many = [v.pieces[k] for k in v.plain if len(v.pieces[k]) > 1]
        self.single = {v.pieces[k] for k in v.plain if len(v.pieces[k]) == 1}
        self.longest = max([1, *map(len, many)])
        self.whole = all(v.scores[k] == int(v.scores[k]) for k in v.plain)
        self.round = _whole if self.whole else _rounded
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in many):
            self.units = lambda text: [text]
        else:
            self.units = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+").findall
        self.counts = Remembered(self._count, REMEMBERED // 2)
        self.bests = Numbered(self._best)
        self.lists = Remembered(lambda key: self.n_best(*key), REMEMBERED // 8, lambda out: sum(160 + 4 * len(ids) for _, ids in out))

    def forget(self) -> None:
        """Gives back what was remembered."""
        self.counts.clear(), self.bests.clear(), self.lists.clear()

    def split(self, text: str | None) -> list[str]:
        return self.units(SPACE + text.replace(" ", SPACE)) if text else []

    # -- the best segmentation ------------------------------------------------------------------------

    def _plain(self, unit: str) -> bool:
        """Whether every character has its own piece and no sum leaves what 32 bits hold exactly."""
        return self.whole and len(unit) <= SHORT and self.single.issuperset(unit)

    def _bytes(self, char: str) -> tuple[int, ...]:
        return tuple(self.vocabulary.byte_ids[b] for b in char.encode())

    def _edges(self, unit: str) -> Iterator[list[tuple[int, float, tuple[int, ...]]]]:
        """For each end from 1 on: (start, score, ids) of the pieces that end there, longest first."""
        at, edges = 0, []

        def closed() -> list:
            if unit[at] not in self.single:
                edges.append((at, self.vocabulary.unknown, self._bytes(unit[at])))
            return edges

        for end, (length, score, k) in self.matches.iter(unit):
            while at < end:
                yield closed()
                at, edges = at + 1, []
            edges.append((end + 1 - length, score, (k,)))
        while at < len(unit):
            yield closed()
            at, edges = at + 1, []

    def _edges_at(self, unit: str, at: int) -> list[tuple[int, float, tuple[int, ...]]]:
        """The same for one end."""
        before = unit[max(0, at - self.longest) : at]
        found = [(at - length, score, (k,)) for end, (length, score, k) in self.matches.iter(before) if end + 1 == len(before)]
        if unit[at - 1] not in self.single:
            found.append((at - 1, self.vocabulary.unknown, self._bytes(unit[at - 1])))
        return found

    def _count(self, unit: str) -> tuple[int, float]:
        """Pieces and score of the best segmentation; only these two are carried along, in a ring as long as the
        longest piece."""
        if not self._plain(unit):
            ring = self.longest + 1
            best, pieces, at, round_ = [0.0] * ring, [0] * ring, 0, self.round
            for at, edges in enumerate(self._edges(unit), 1):
                top, n = -np.inf, 0
                for start, score, ids in edges:
                    total = round_(best[start % ring] + score)
                    if total > top:
                        top, n = total, pieces[start % ring] + len(ids)
                best[at % ring], pieces[at % ring] = top, n
            return pieces[at % ring], best[at % ring]
        best, pieces, at, top, n = [], [], -1, 0.0, 0
        for end, (length, score, _) in self.matches.iter(unit):  # by end, the longest first
            if end != at:
                best.append(top)
                pieces.append(n)
                at, top = end, -np.inf
            total = best[end + 1 - length] + score
            if total > top:
                top, n = total, pieces[end + 1 - length] + 1
        return n, top

    def count(self, text: str | None) -> tuple[int, float]:
        found = list(map(self.counts.__getitem__, self.split(text)))
        return sum(n for n, _ in found), sum(s for _, s in found)

    # -- segmentations ------------------------------------------------------------------------------

    def _forward(self, ends: Iterable[list]) -> tuple[array, array, array, array]:
        """For each position the best score to it, the start and id of the last piece there (-1: the bytes of a
        character), and how much less the next best last piece gives."""
        best, starts, last, loss, round_ = array("d", [0.0]), array("i", [0]), array("i", [0]), array("d", [np.inf]), self.round
        for edges in ends:
            top, second, via = -np.inf, -np.inf, (0, 0.0, (0,))
            for edge in edges:
                total = round_(best[edge[0]] + edge[1])
                if total > top:
                    top, second, via = total, top, edge
                elif total > second:
                    second = total
            best.append(top)
            starts.append(via[0])
            last.append(via[2][0] if len(via[2]) == 1 else -1)
            loss.append(top - second)
        return best, starts, last, loss

    def _best(self, unit: str) -> tuple[bytes, float, float, int]:
        """Ids (32 bits each), score and number of pieces of the best segmentation, and how much less the
        second best scores (infinite if there is none).

        The second best leaves the best once: it comes to some position of the best by another last piece.
        """
        if not self._plain(unit):
            best, starts, last, loss = self._forward(self._edges(unit))
            at, ids, gap = len(unit), array("i"), np.inf
            while at:
                gap = min(gap, loss[at])
                if last[at] < 0:
                    ids.extend(reversed(self._bytes(unit[at - 1])))
                else:
                    ids.append(last[at])
                at = starts[at]
            ids.reverse()
            return ids.tobytes(), best[-1], gap, len(ids)
        best, back = [], []  # scores; start, piece and loss
        at, top, second, start, piece = -1, 0.0, _NONE, 0, 0
        keep, note = best.append, back.append
        for end, (length, score, k) in self.matches.iter(unit):  # by end, the longest first
            if end != at:
                keep(top)
                note((start, piece, top - second))
                at, top, second = end, _NONE, _NONE
            total = best[end + 1 - length] + score
            if total > top:
                top, second, start, piece = total, top, end + 1 - length, k
            elif total > second:
                second = total
        score, gap, ids = top, top - second, [piece]
        while start:
            start, piece, loss = back[start]
            ids.append(piece)
            if loss < gap:
                gap = loss
        ids.reverse()
        return array("i", ids).tobytes(), score, gap, len(ids)

    def n_best(self, unit: str, n: int) -> list[tuple[float, array]]:
        """The n best segmentations of a unit: (score, ids), best first.

        A backward A-star search: the forward Viterbi scores are what the rest of a path can still give,
        exactly, so complete paths come up in order, and no more open paths than results are still wanted
        matter. Equal scores: longer pieces from the end first.
        """
        if not unit:
            return [(0.0, array("i"))]
        if len(unit) <= SHORT:
            every = [[], *self._edges(unit)]
            best, edges = self._forward(every[1:])[0], every.__getitem__
        else:
            best, edges = self._forward(self._edges(unit))[0], partial(self._edges_at, unit)
        out: list[tuple[float, array]] = []
        # the steps taken so far: the one before (towards the end of the unit), and a piece (-1 - start: a character's bytes)
        before, taken = array("i"), array("i")
        # open paths, in the order that settles ties: what they can give, where they are, their score, their last
        # step and the one before it
        paths: list[tuple] = [(best[-1], len(unit), 0.0, 0, -1)]
        while paths and len(out) < n:
            first = max(range(len(paths)), key=lambda k: (paths[k][0], -k))
            _, at, done, piece, step = paths[first]
            if at < len(unit):
                before.append(step), taken.append(piece)
                step = len(taken) - 1
            if at == 0:
                ids = array("i")
                while step >= 0:
                    ids.append(taken[step]) if taken[step] >= 0 else ids.extend(self._bytes(unit[-1 - taken[step]]))
                    step = before[step]
                out.append((done, ids))
                del paths[first]
                continue
            paths[first : first + 1] = [(best[start] + score + done, start, score + done, part[0] if len(part) == 1 else -1 - start, step) for start, score, part in edges(at)]
            if len(paths) > n - len(out):
                kept = sorted(range(len(paths)), key=lambda k: (-paths[k][0], k))[: n - len(out)]
                paths = [paths[k] for k in sorted(kept)]
        return out

    def encode(self, text: str | None, n: int = 1) -> tuple[np.ndarray, float, list[dict]]:
        """Ids and score of the best segmentation, and the n best as changes to it.

        Any of the n best differs from the best only in units among the n - 1 with the least loss: each of
        those alone already gives a segmentation at least as good as one that changes another unit. Of equal
        losses, the earlier unit counts as less.
        """
        units = self.split(text)
        known = self.bests
        known.make_room()
        found = list(map(known.__getitem__, units))
        at = np.array(found, np.int64)
        ids = np.frombuffer(b"".join(map(known.ids.__getitem__, found)), np.int32)
        score = math.fsum(np.frombuffer(known.scores)[at].tolist()) if units else 0.0
        if n < 2:
            return ids, score, []
        ranked = [{"score": score, "pieces": len(ids), "changes": []}]
        loss = np.frombuffer(known.losses)[at] if units else np.zeros(0)
        likely = np.argsort(loss, kind="stable")[: n - 1] if len(loss) < 4 * n else _least(loss, n - 1)
        likely = sorted(k for k in likely.tolist() if loss[k] < np.inf)
        combined: list[tuple[float, tuple]] = [(0.0, ())]
        lists = {k: self.lists[units[k], n] for k in likely}
        for k, choices in lists.items():
            top = choices[0][0]
            combined = heapq.nsmallest(n, ((l + top - s, (*c, (k, r)) if r else c) for l, c in combined for r, (s, _) in enumerate(choices)))
        if len(combined) > 1:
            sizes = np.frombuffer(known.sizes, np.int64)[at]
            starts = np.cumsum(sizes) - sizes
            for l, choice in combined[1:n]:
                changes = [_change(int(starts[k]), lists[k][0][1], lists[k][r][1]) for k, r in choice]
                pieces = len(ids) + sum(len(c["ids"]) - c["replaced"] for c in changes)
                ranked.append({"score": score - l, "pieces": pieces, "changes": changes})
        return ids, score, ranked

    def decode(self, ids) -> str:
        """The text of piece ids; bytes that aren't UTF-8 become U+FFFD."""
        v = self.vocabulary
        if not hasattr(self, "_raw"):
            self._raw = [p.encode() for p in v.pieces]
            for b, k in enumerate(v.byte_ids):
                self._raw[k] = bytes([b])
        ids = np.asarray(ids, np.int32)
        raw = b"".join([b"".join([self._raw[k] for k in ids[at : at + 65_536].tolist()]) for at in range(0, len(ids), 65_536)])
        text = raw.decode(errors="replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def _change(at: int, old: array, new: array) -> dict:
    """What turns the ids from `at` on from old into new, without what they have in common at either end."""
    most, head, tail = min(len(old), len(new)), 0, 0
    while head < most and old[head] == new[head]:
        head += 1
    while tail < most - head and old[-1 - tail] == new[-1 - tail]:
        tail += 1
    return {"at": at + head, "replaced": len(old) - head - tail, "ids": new[head : len(new) - tail].tolist()}


def _least(loss: np.ndarray, n: int) -> np.ndarray:
    """Places of the n least values, the earlier first among equals."""
    limit = np.partition(loss, n - 1)[n - 1]
    below = np.flatnonzero(loss < limit)
    return np.concatenate([below, np.flatnonzero(loss == limit)[: n - len(below)]])


_lattices: dict[int, Lattice] = {}


def _each(shared, make: Callable[[Lattice, pa.RecordBatch], pa.RecordBatch], texts: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow with this worker's lattice of a broadcast vocabulary; what it remembers goes at
    the end of the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        if hash(v) not in _lattices:
            _lattices.clear()
            _lattices[hash(v)] = Lattice(v)
        lattice = _lattices[hash(v)]
        yield from per_batch(partial(make, lattice), texts)(batches)
        lattice.forget()

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, score) of the best segmentation of each whole text.

    Null and empty texts have no tokens and score 0. Null and repeated ids go through, a row for a row; other
    columns aren't read. Texts are counted whole, also very long ones, unit by unit, and a unit without an end in a
    ring as long as the longest piece. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def make(lattice: Lattice, batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [lattice.count(t) for t in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([float(s) for _, s in found], pa.float64())], ["doc_id", "n_tokens", "score"])

    return _rows(docs, id_col, text_col).mapInArrow(_each(shared, make, 1), "doc_id long, n_tokens long, score double")


_CHANGE = pa.struct([("at", pa.int32()), ("replaced", pa.int32()), ("ids", pa.list_(pa.int32()))])
_RANKED = pa.list_(pa.struct([("score", pa.float64()), ("pieces", pa.int32()), ("changes", pa.list_(_CHANGE))]))
_RANKED_DDL = "array<struct<score: double, pieces: int, changes: array<struct<at: int, replaced: int, ids: array<int>>>>>"


def encode(docs: DataFrame, n: int = 4, path: str | None = None, text_col: str = "text", digest: bool = False) -> DataFrame:
    """docs and the n best segmentations of each whole text.

    Added columns: ids (array of int, the best segmentation) or, with digest, ids_sha256 (of the ids as
    little-endian 32-bit integers); n_pieces; score; n_best, from the best on: score, pieces and the changes
    to ids (at a place, so many ids replaced by others); round_trip: whether decoding ids gives the text.
    Null and empty texts have no pieces; null doesn't round trip to anything and gets null. A text that holds
    U+2581 decodes to one with a space there. Columns of docs with these names are replaced. Repeated rows each give
    a row. Texts are encoded whole, also very long ones: a task holds a text's ids, and the open paths of one unit at
    a time. An empty table gives an empty result.
    """
    ours = ["ids", "ids_sha256", "n_pieces", "score", "n_best", "round_trip"]
    base = docs.drop(*(c for c in ours if c != text_col))
    shared, at = docs.sparkSession.sparkContext.broadcast(load(path)), base.columns.index(text_col)

    def make(lattice: Lattice, batch: pa.RecordBatch) -> pa.RecordBatch:
        every, scores, ranked, trips = [], [], [], []
        for text in batch.column(at).to_pylist():
            ids, score, best = lattice.encode(text, n)
            every.append(ids), scores.append(score), ranked.append(best)
            trips.append(None if text is None else lattice.decode(ids) == text)
        if digest:
            first = pa.array([hashlib.sha256(ids.tobytes()).hexdigest() for ids in every], pa.string())
        else:
            ends = np.concatenate([[0], np.cumsum([len(ids) for ids in every])])
            first = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(every) if every else [], pa.int32()))
        more = [first, pa.array([len(ids) for ids in every], pa.int32()), pa.array(scores, pa.float64()), pa.array(ranked, _RANKED), pa.array(trips, pa.bool_())]
        return pa.record_batch([*batch.columns, *more], [*batch.schema.names, "ids_sha256" if digest else "ids", *ours[2:]])

    added = f"{'ids_sha256 string' if digest else 'ids array<int>'}, n_pieces int, score double, n_best {_RANKED_DDL}, round_trip boolean"
    return base.mapInArrow(_each(shared, make, at), _schema(base, added))


def _schema(base: DataFrame, added: str):
    return T.StructType([*base.schema.fields, *T._parse_datatype_string(added).fields])


def decode(rows: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """rows with decoded, the text of ids (null for null); a column of that name is replaced."""
    base = rows.drop("decoded")
    shared, at = rows.sparkSession.sparkContext.broadcast(load(path)), base.columns.index(ids_col)

    def make(lattice: Lattice, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [None if ids is None else lattice.decode(ids) for ids in batch.column(at).to_pylist()]
        return pa.record_batch([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return base.mapInArrow(_each(shared, make, at), _schema(base, "decoded string"))

