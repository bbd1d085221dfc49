"""SimHash near-duplicate detection by tiled exact comparison.

A fingerprint is a majority vote over the bits of the hashes of a text's word shingles. Every two distinct
fingerprints within a radius are found exactly:

* Fingerprints are dealt into cells that bound the distance: by the population counts of four 16-bit parts
  (two fingerprints within r bits have counts within r in all) or, if a least similarity is asked for, by
  bands of the number of shingles. A cell meets only the cells near it.
* If a least similarity is asked for, fingerprints within the radius are candidates only: a pair links if the
  exact Jaccard similarity of its two sets of shingles reaches it. Sets meet inside the candidates' components.
* Inside a cell, tiles of fingerprints are compared by exclusive-or and bit counts. Tile pairs whose
  population counts differ beyond the radius are skipped.
* A task sends on a spanning forest of the links it finds, not all pairs, so a group of thousands of copies
  costs as many rows as it has members. Components come from alternating star contractions. Joins in which a
  node, a fingerprint or a component may have a large part of all rows look up the largest ones in a broadcast
  table of bounded size.

The number of cells is at most 17 ** 4; a large cell is cut into blocks, so no task holds an unbounded group.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import dropped, joined, per_batch, written

SEED = 42
#: Fingerprints in a block of a cell; rows of a tile on either side; shingles hashed at a time.
BLOCK, TILE, WIDE, CHUNK = 65_536, 128, 2_048, 1 << 16
#: Shingles of the sets in a block; of those compared at a time or sent on in one batch.
SHINGLES, BULK = 1 << 22, 1 << 20
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of all word shingles, repeats included, in chunks of unsigned integers.

    Words are runs of other bytes than 20 and 09-0D (hex) after A-Z become a-z. A text of fewer words than
    width gives its whole sequence; one without words gives nothing.
    """
    words = (text or "").encode().lower().split()
    digest = xxhash.xxh64_digest
    if 0 < len(words) < width:
        words, width = [b" ".join(words)], 1
    for at in range(0, len(words) - width + 1, CHUNK):
        part = words[at : at + CHUNK + width - 1]
        raw = b"".join([digest(s, SEED) for s in map(b" ".join, zip(*(part[k:] for k in range(width)), strict=False))])
        yield np.frombuffer(raw, ">u8").astype(np.uint64)


def _more_bits(h: np.ndarray, k: int) -> np.ndarray:
    """Word k of a longer hash: the hash itself, then mixtures of it (multiply and shift)."""
    if k:
        h = h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(29))
    return h


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes of a text's shingles in ascending order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, width)]))


def simhash(text: str | None, width: int = 3, words: int = 1) -> tuple[bytes, int]:
    """The fingerprint of a text (8 bytes a word, big-endian) and its number of shingles.

    A bit is 1 if it is 1 in more than half of the hashes; a text without words has only zeros.
    """
    return vote(shingle_hashes(text, width), words)


def vote(hashes: Iterable[np.ndarray], words: int) -> tuple[bytes, int]:
    """The fingerprint by chunks of shingle hashes, and their number."""
    ones, n = np.zeros(64 * words, np.int64), 0
    for h in hashes:
        n += len(h)
        for k in range(words):
            raw = _more_bits(h, k).astype(">u8").view(np.uint8).reshape(-1, 8)
            for j in range(8):
                at = 64 * k + 8 * j
                ones[at : at + 8] += np.bincount(raw[:, j], minlength=256) @ _BITS
    return np.packbits(2 * ones > n).tobytes(), n


def fingerprints(docs: DataFrame, width: int = 3, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp binary, size): one row per row of docs; size is the number of shingles.

    A null text counts as one without words. Null and repeated ids go through. Other columns of docs,
    whatever their names, are not read.
    """

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [simhash(t, width, words) for t in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array([f for f, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], ["doc_id", "fp", "size"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(per_batch(make, 1), "doc_id long, fp binary, size long")


def fp_hex(fp: Column) -> Column:
    return F.lower(F.hex(fp))


# -- links ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Cells:
    """Where a fingerprint is at home, and the steps to later cells that may hold some within reach."""

    side: int
    parts: int
    reach: int
    similarity: float | None = None

    @property
    def place(self) -> np.ndarray:
        return self.side ** np.arange(self.parts, dtype=np.int64)

    def at(self, fps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if self.similarity is None:
            return np.bitwise_count(fps[:, 0].astype(np.uint64).view(np.uint16).reshape(-1, self.parts)).astype(np.int64)
        band = np.log(np.maximum(sizes, 1)) / -math.log(self.similarity)
        return np.minimum(np.floor(band + 1e-9), self.side - 1).astype(np.int64)[:, None]

    def steps(self) -> list[np.ndarray]:
        every = (np.array(x, np.int64) for x in product(range(-self.reach, self.reach + 1), repeat=self.parts) if sum(map(abs, x)) <= self.reach)
        return [s for s in every if s @ self.place > 0]


def _unpacked(column: pa.Array, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, words)


def _packed(fps: np.ndarray) -> list[bytes]:
    raw, size = fps.astype(">u8").tobytes(), 8 * fps.shape[1]
    return [raw[k : k + size] for k in range(0, len(raw), size)]


def stars(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph with edges i-j: each node beside the least of its component."""
    nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = at[: len(i)], at[len(i) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new[label]]
        if np.array_equal(new, label):
            break
        label = new
    apart = label != np.arange(len(nodes))
    return nodes[apart], nodes[label[apart]]


class Forest:
    """A running union-find: label holds the least index of each one's component. Linear in the number of indices."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.label[i], self.label[j]
        apart = a != b
        if apart.any():
            u, v = stars(a[apart], b[apart])
            to = np.arange(len(self.label))
            to[u] = v
            self.label = to[self.label]

    def grow(self, n: int) -> None:
        self.label = np.concatenate([self.label, np.arange(len(self.label), len(self.label) + n)])

    def since(self, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of the roots of before, earlier labels of this forest, that are none any more to their new roots."""
        gone = np.flatnonzero((before == np.arange(len(before))) & (self.label != before))
        return gone, self.label[gone]


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a and b, (n, words) each, within the radius, tile by tile; same: a is b, each pair once.

    Tiles hold fingerprints with like byte population counts. A tile pair is skipped when the ranges of its
    counts are further apart than the radius allows.
    """

    def tiles(x: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        counts = np.bitwise_count(x.view(np.uint8).reshape(len(x), -1)).astype(np.int16)
        order = np.lexsort((*counts.T, counts.sum(axis=1))) if len(x) > size else np.arange(len(x))
        cut = [order[k : k + size] for k in range(0, len(x), size)]
        return [(c, counts[c].min(axis=0), counts[c].max(axis=0)) for c in cut]

    right = tiles(b, WIDE)
    if not right:
        return
    low, high = np.stack([t[1] for t in right]), np.stack([t[2] for t in right])
    for rows, least, most in tiles(a, TILE):
        gap = np.maximum(np.maximum(low - most, least - high), 0).sum(axis=1)
        for k in np.flatnonzero(gap <= radius):
            cols = right[k][0]
            apart = np.bitwise_count(a[rows, 0][:, None] ^ b[cols, 0][None, :])
            if a.shape[1] > 1:
                apart = apart.astype(np.uint16)
                for w in range(1, a.shape[1]):
                    apart += np.bitwise_count(a[rows, w][:, None] ^ b[cols, w][None, :])
            r, c = np.nonzero(apart <= radius)
            r, c = rows[r], cols[c]
            if same:
                r, c = r[keep := r < c], c[keep]
            if len(r):
                yield r, c


def _visits(cells: Cells, blocks: np.ndarray, words: int):
    """Deals each fingerprint out to its own block and to the blocks of later cells nearby."""
    steps, place = cells.steps(), cells.place

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = _unpacked(batch.column(0), words)
        where = cells.at(fps, batch.column(1).to_numpy())
        own = where @ place
        block = ((fps[:, 0] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.maximum(blocks[own], 1).astype(np.uint64)).astype(np.int64)
        everyone = np.arange(len(fps))
        who, to, at = [everyone], [own], [block]

        def visit(guests: np.ndarray, code: np.ndarray, first: np.ndarray) -> None:
            while len(guests):  # one block of the visited cell a round
                going = first < blocks[code]
                guests, code, first = guests[going], code[going], first[going]
                who.append(guests), to.append(code), at.append(first)
                first = first + 1

        visit(everyone, own, block + 1)
        for step in steps:
            there = where + step
            inside = np.flatnonzero(((there >= 0) & (there < cells.side)).all(axis=1))
            visit(everyone[inside], there[inside] @ place, np.zeros(len(inside), np.int64))
        visiting = np.arange(sum(map(len, who))) >= len(fps)
        who, to, at = map(np.concatenate, (who, to, at))
        return pa.record_batch([pa.array(to * (1 << 32) + at), pa.array(visiting), batch.column(0).take(pa.array(who))], ["cell", "visiting", "fp"])

    return per_batch(make)


def _links(radius: int, words: int, extra: int = 0):
    """Over rows sorted by (cell, visiting): a spanning forest of the links of each block.

    extra: 64-bit words of a node that follow its fingerprint and don't count for the distance. Only the fingerprints at home in a block (BLOCK or a few more) are held; visitors stream past.
    """

    def found(homes: np.ndarray, forest: Forest, other: np.ndarray | None) -> list[tuple[list[bytes], list[bytes]]]:
        same, n = other is None, len(homes)
        if not same:
            forest.grow(len(other))
        before = forest.label
        for i, j in near_pairs(homes[:, :words], (homes if same else other)[:, :words], radius, same):  # never all pairs at once
            forest.join(i, j if same else j + n)
        u, v = forest.since(before)
        every = homes if same else np.concatenate([homes, other])
        forest.label = forest.label[:n]  # visitors link to homes only, so homes are the roots
        return [(_packed(every[u]), _packed(every[v]))] if len(u) else []

    def edges(out: list[tuple[list[bytes], list[bytes]]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([x for pair in out for x in pair[k]], pa.binary()) for k in (0, 1)], ["u", "v"])

    def settle(homes: list[np.ndarray], out: list) -> tuple[np.ndarray, Forest]:
        settled = np.concatenate(homes)
        forest = Forest(len(settled))
        out += found(settled, forest, None)
        return settled, forest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, homes, settled = None, [], None
        for batch in batches:
            at, visiting = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            fps = _unpacked(batch.column(2), words + extra)
            turns = np.flatnonzero((at[1:] != at[:-1]) | (visiting[1:] != visiting[:-1])) + 1
            out = []
            for lo, hi in zip([0, *turns], [*turns, len(at)], strict=True):
                if at[lo] != cell:
                    if homes:
                        settle(homes, out)
                    cell, homes, settled = at[lo], [], None
                if not visiting[lo]:
                    homes.append(fps[lo:hi])
                    continue
                if homes:
                    settled, homes = settle(homes, out), []
                if settled is not None:
                    out += found(*settled, fps[lo:hi])
            if out:
                yield edges(out)
        out = []
        if homes:
            settle(homes, out)
        if out:
            yield edges(out)

    return run


def links(distinct: DataFrame, radius: int, words: int = 1, similarity: float | None = None, extra: int = 0) -> DataFrame:
    """(u, v): links between distinct fingerprints (columns fp, size) that connect all those within reach.

    Without similarity, any two fingerprints within the radius end up in one component of these links. With
    it, that holds for those whose numbers of shingles also allow that similarity. extra: as in _links.
    """
    spark = distinct.sparkSession
    cells = Cells(17, 4, radius) if similarity is None else Cells(4096, 1, 1, similarity)
    place = cells.place

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells.side**cells.parts, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(cells.at(_unpacked(batch.column(0), words + extra), batch.column(1).to_numpy()) @ place, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["cell", "n"])

    blocks = np.zeros(cells.side**cells.parts, np.int64)  # 83,521 or 4,096 counts, however many fingerprints there are
    for row in distinct.select("fp", "size").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        blocks[row["cell"]] = -(-row["n"] // BLOCK)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = distinct.select("fp", "size").mapInArrow(_visits(cells, blocks, words + extra), "cell long, visiting boolean, fp binary")
    dealt = dealt.repartition(parts, "cell").sortWithinPartitions("cell", "visiting")
    return dealt.mapInArrow(_links(radius, words, extra), "u binary, v binary")


# -- exact similarity -------------------------------------------------------------------------------


def _sets(width: int):
    """(cell, node, blocks, set): the shingle set of each text, in batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, n, sets = 0, 0, []

            def some(end: int) -> pa.RecordBatch:
                part = batch.slice(first, end - first)
                return pa.record_batch([*part.columns[:3], pa.array(sets, pa.binary())], ["cell", "node", "blocks", "set"])

            for k, text in enumerate(batch.column(3)):
                sets.append((own := shingle_set(text.as_py(), width)).tobytes())
                n += len(own)
                if n >= BULK:
                    yield some(k + 1)
                    first, n, sets = k + 1, 0, []
            if sets:
                yield some(batch.num_rows)

    return run


def shared(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many members of one each of the others has; all are ascending, distinct and not empty."""
    out, at = [], 0
    while at < len(others):
        end, n = at, 0
        while end < len(others) and (end == at or n + len(others[end]) <= BULK):
            n += len(others[end])
            end += 1
        flat = np.concatenate(others[at:end])
        hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
        out.append(np.add.reduceat(hit.astype(np.int64), np.cumsum([0, *map(len, others[at : end - 1])])))
        at = end
    return np.concatenate(out)


def _alike(radius: int, words: int, extra: int, similarity: float):
    """Over rows (cell, visiting, node, set) sorted by the first two: a spanning forest of the pairs in each
    block whose fingerprints are within the radius and whose sets have the similarity.

    Pairs that are connected already aren't compared. Only the sets at home in a block are held.
    """

    def found(nodes: np.ndarray, sets: list, forest: Forest, other: np.ndarray | None, others: list) -> list[tuple[list[bytes], list[bytes]]]:
        same, n = other is None, len(nodes)
        if same:
            other, others, n = nodes, sets, 0
        else:
            forest.grow(len(other))
        before = forest.label
        size, sizes = np.array([*map(len, sets)]), np.array([*map(len, others)])
        for i, j in near_pairs(nodes[:, :words], other[:, :words], radius, same):
            small, large = np.minimum(size[i], sizes[j]), np.maximum(size[i], sizes[j])
            open_ = (forest.label[i] != forest.label[j + n]) & (small >= similarity * large - 1e-9)
            i, j = i[open_], j[open_]
            turns = np.flatnonzero(i[1:] != i[:-1]) + 1
            for part in np.split(j, turns) if len(j) else []:
                k, i = i[0], i[len(part) :]
                part = part[forest.label[part + n] != forest.label[k]]
                if len(part):
                    both = shared(sets[k], [others[x] for x in part])
                    part = part[both >= similarity * (size[k] + sizes[part] - both) - 1e-9]
                    forest.join(np.full(len(part), k), part + n)
        u, v = forest.since(before)
        every = nodes if same else np.concatenate([nodes, other])
        forest.label = forest.label[: len(nodes)]
        return [(_packed(every[u]), _packed(every[v]))] if len(u) else []

    def settle(homes: list[tuple[np.ndarray, list]], out: list) -> tuple[np.ndarray, list, Forest]:
        nodes, sets = np.concatenate([x for x, _ in homes]), [x for _, part in homes for x in part]
        forest = Forest(len(nodes))
        out += found(nodes, sets, forest, None, [])
        return nodes, sets, forest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges() -> pa.RecordBatch:
            return pa.record_batch([pa.array([x for pair in out for x in pair[k]], pa.binary()) for k in (0, 1)], ["u", "v"])

        cell, homes, settled, out = None, [], None, []
        for batch in batches:
            at, visiting = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            nodes = _unpacked(batch.column(2), words + extra)
            sets = [np.frombuffer(x, np.uint64) for x in batch.column(3).to_pylist()]
            turns = np.flatnonzero((at[1:] != at[:-1]) | (visiting[1:] != visiting[:-1])) + 1
            for lo, hi in zip([0, *turns], [*turns, len(at)], strict=True):
                if at[lo] != cell:
                    if homes:
                        settle(homes, out)
                    cell, homes, settled = at[lo], [], None
                if not visiting[lo]:
                    homes.append((nodes[lo:hi], sets[lo:hi]))
                    continue
                if homes:
                    settled, homes = settle(homes, out), []
                if settled is not None:
                    out += found(*settled, nodes[lo:hi], sets[lo:hi])
            if out:
                yield edges()
                out = []
        if homes:
            settle(homes, out)
        if out:
            yield edges()

    return run


def alike(marked: DataFrame, nodes: DataFrame, width: int, radius: int, words: int, similarity: float) -> DataFrame:
    """(u, v): links between nodes that connect all those whose shingle sets have the similarity and whose
    fingerprints are within the radius, and no others.

    The radius is a filter: its components are the cells in which sets are compared. A large cell is cut into
    blocks of SHINGLES shingles or BLOCK nodes, and each block meets the others.
    """
    # sets that differ have at most n / (n + 1) in common, n being the size of the smaller
    able = nodes.where(F.col("size") * (1 - similarity) >= similarity - 1e-9)
    near = components(links(able.select(F.col("node").alias("fp"), "size"), radius, words, similarity, EXTRA), "near")
    members = near.union(near.select("root", "root").distinct()).toDF("node", "cell")
    members = written(able.join(members, "node").select("row_id", "node", "cell", "size"), "members")
    blocks = F.ceil(F.greatest(F.sum("size") / SHINGLES, F.count("*") / BLOCK)).cast("long")
    big = members.groupBy("cell").agg(blocks.alias("blocks")).where("blocks > 1")  # one a SHINGLES shingles at most
    members = members.join(F.broadcast(big), "cell", "left").select("row_id", "cell", "node", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    texts = marked.select("row_id", "text").join(members, "row_id").select("cell", "node", "blocks", "text")
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = texts.mapInArrow(_sets(width), "cell binary, node binary, blocks long, set binary").withColumn("block", block)
    dealt = dealt.select("cell", "node", "set", "block", F.explode(F.sequence("block", F.col("blocks") - 1)).alias("to"))
    dealt = dealt.select(F.xxhash64("cell", "to").alias("cell"), (F.col("to") != F.col("block")).alias("visiting"), "node", "set")
    parts = int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "cell").sortWithinPartitions("cell", "visiting")
    return dealt.mapInArrow(_alike(radius, words, EXTRA, similarity), "u binary, v binary")


# -- components -------------------------------------------------------------------------------------


def components(edges: DataFrame, label: str = "stars") -> DataFrame:
    """(node, root) for every node of the edges (u, v): root is the least node of its component.

    Alternates large and small stars until nothing changes; each round is a few joins on edges that stay
    distributed, written to the shared folder. The edges are a spanning forest already; a star with a large part of
    them is split by adaptive execution, as its joins feed other exchanges.
    """
    now = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    before = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = seen
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), label)
        dropped(last)


def radius_for(similarity: float, bits: int, slack: float = 6) -> int:
    """Differing bits that texts of this Jaccard similarity have, and slack standard deviations more."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * p + slack * math.sqrt(bits * p * (1 - p)))


#: 64-bit words of the digest of a shingle set in a node, after the fingerprint.
EXTRA = 2


def _marked(docs: DataFrame, columns: list[str], width: int, words: int, similarity: float | None, id_col: str, text_col: str) -> DataFrame:
    """(row_id, doc_id, text, row, node, fp, size): a written row for each row of docs; row has the
    columns as c0, c1 ...

    With a similarity, repeated shingles count once, and a node stands for a set of shingles (fingerprint and
    digest); else it stands for a fingerprint.
    """
    kept = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"), F.struct(F.lit(True).alias("_"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(columns))).alias("row"),
    )

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in batch.column(2):
            if similarity is None:
                fp, n = simhash(text.as_py(), width, words)
                out.append((fp, fp, n))
            else:
                own = shingle_set(text.as_py(), width)
                fp, n = vote((own[k : k + CHUNK] for k in range(0, len(own), CHUNK)), words)
                out.append((fp + xxhash.xxh3_128_digest(own.tobytes()), fp, n))
        made = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.binary(), pa.binary(), pa.int64()), strict=True)]
        return pa.record_batch([*batch.columns, *made], [*batch.schema.names, "node", "fp", "size"])

    schema = StructType([*kept.schema.fields, StructField("node", BinaryType()), StructField("fp", BinaryType()), StructField("size", LongType())])
    return written(kept.mapInArrow(per_batch(make, 2), schema), "marked")


def _rooted(marked: DataFrame, width: int, words: int, similarity: float | None, radius: int | None) -> DataFrame:
    """(node, n, first_id, root, component_id) for every node of marked, n being its rows; written."""
    if radius is None:
        radius = radius_for(similarity, 64 * words)
    nodes = marked.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.max("size").alias("size"), F.count("*").alias("n"), *([F.min("row_id").alias("row_id")] if similarity is not None else []))
    nodes = written(nodes, "nodes")
    if similarity is None:
        linked = links(nodes.select(F.col("node").alias("fp"), "size"), radius, words)
    else:
        linked = alike(marked, nodes, width, radius, words, similarity)
    found = components(linked, "links")
    rooted = written(nodes.join(found, "node", "left").select("node", "n", "first_id", F.coalesce("root", "node").alias("root")), "rooted")
    least = written(rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members")), "least")
    return written(joined(rooted, least, ["root"], "members").select("node", "n", "first_id", "root", "component_id"), "named")


def near_duplicates(
    docs: DataFrame, width: int = 5, similarity: float | None = 0.8, words: int = 4, radius: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs.

    With a similarity, texts link whose sets of shingles have that Jaccard similarity or more; fingerprints of
    `words` 64-bit words only choose the pairs to compare, those that differ in `radius` bits or fewer (by
    default, six standard deviations beyond what the similarity leads one to expect). Without it, fingerprints
    within the radius link. component_id is the smallest id reachable over links, the row's own included; null
    if no row of the component has an id. Texts that are null, empty or without words are alike. Repeated rows
    each get their row. An empty table gives an empty result.
    """
    if similarity is None:
        marked = written(fingerprints(docs, width, words, id_col, text_col), "fps").withColumn("node", F.col("fp"))
    else:
        marked = _marked(docs, [], width, words, similarity, id_col, text_col)
    named = _rooted(marked, width, words, similarity, radius).select("node", "component_id", "n")
    return joined(marked.select("doc_id", "fp", "node"), named, ["node"]).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, width: int = 5, similarity: float | None = 0.8, words: int = 4, radius: int | None = None) -> DataFrame:
    """The rows of docs, one of each near-duplicate group: the first by doc_id, text (null first), other columns.

    Rows without an id belong to no group and stay. Rows that share an id are rows of their own. Columns go
    through, whatever their names and types. Of wholly equal rows the one that is scanned first stays. Very long texts
    are hashed whole, in chunks. An empty table gives an empty result.
    """
    others = [c for c in docs.columns if c != "text"]  # the text is there already
    marked = _marked(docs, others, width, words, similarity, "doc_id", "text")
    heads = _rooted(marked, width, words, similarity, radius).where("first_id = component_id").select("node", "root", F.col("first_id").alias("head"), "n")
    first = written(joined(marked.select("row_id", "node", "doc_id"), heads, ["node"]).where("doc_id = head").select("row_id", "root"), "first")
    count = written(first.groupBy("root").agg(F.count("*").alias("n"), F.min("row_id").alias("row_id")), "count")
    # only where a group's least id is repeated do texts decide
    tied = written(joined(first, count.where("n > 1").select("root", "n"), ["root"]), "tied")
    order = F.struct("text", F.to_json("row").alias("other"), "row_id")
    best = marked.join(tied, "row_id").groupBy("root").agg(F.min_by("row_id", order).alias("row_id"))
    kept = count.where("n = 1").select("row_id").union(best.select("row_id")).union(marked.where("doc_id is null").select("row_id"))
    found = marked.select("row_id", "text", "row").join(kept, "row_id", "left_semi")
    return found.select(*(F.col("text") if c == "text" else F.col("row")[f"c{others.index(c)}"].alias(c) for c in docs.columns))
