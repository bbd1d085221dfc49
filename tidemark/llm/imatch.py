"""I-Match fingerprints over randomised lexicons.

The lexicon holds the terms whose inverse document frequency, counted over all documents, lies in a band. Each
of several random subsets of the lexicon gives one signature: the hash of a document's distinct terms in that
subset, sorted. Subsets keep shares of 1, 1/2, 1/4 ... of the lexicon, so that some of them react to small
edits of short texts and others survive large edits of long ones.

Size of the broadcast lexicon: a band up to idf h holds terms that occur in at least N / exp(h) documents, so
there are at most exp(h) times the mean number of distinct terms of a document, however large N is. The number is
counted before the lexicon is fetched.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import per_batch, written

#: Distinct terms that a task counts before it hands the counts on.
FLUSH = 400_000
#: Keys sampled for each place where the document order is cut.
SAMPLED = 20
#: Terms in a broadcast lexicon, at most; more are an error (a wider band than the table's texts allow).
TERMS = 50_000_000
_TERM = re.compile(r"\w+")
_LEAST = -(2**63)


@dataclass(frozen=True)
class Band:
    """The chosen band (natural logarithm of N / df) and the shares of the lexicon that subsets keep."""

    low: float = 0.7
    high: float = 6.9
    rates: tuple[float, ...] = field(default_factory=lambda: (1.0, *(2.0**-k for k in range(1, 13) for _ in range(8))))
    seed: int = 7

    def bounds(self, n: int) -> tuple[float, float]:
        return n * np.exp(-self.high), n * np.exp(-self.low)


def terms(text: str | None) -> set[str]:
    return set(_TERM.findall((text or "").lower()))


def _hashes(words: set[str]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df): the 64-bit hash of each term and the number of documents that hold it."""

    def flushed(counts: Counter[str]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(_hashes(counts).view(np.int64)), pa.array(list(counts.values()), pa.int64())], ["term", "df"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(terms(text))
                if len(counts) > FLUSH:
                    yield flushed(counts)
                    counts.clear()
        if counts:
            yield flushed(counts)

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "term long, df long")
    return found.groupBy("term").agg(F.sum("df").alias("df"))


class Signer:
    """Signs texts with one lexicon (sorted hashes)."""

    def __init__(self, lexicon: np.ndarray, band: Band) -> None:
        self.lexicon, self.n = lexicon, len(band.rates)
        self.salt = np.random.default_rng(band.seed).integers(1, 2**63, self.n, dtype=np.uint64)
        self.least = np.array([min(2**64 - 1, int(r * 2**64)) for r in band.rates], np.uint64)

    def sign(self, text: str | None) -> bytes:
        """Four bytes a subset; zeros where it has none of the text's terms.

        A text without terms in the band is signed by all of its terms.
        """
        found = _hashes(terms(text))
        if len(self.lexicon) and len(found):
            at = np.minimum(np.searchsorted(self.lexicon, found), len(self.lexicon) - 1)
            inside = found[self.lexicon[at] == found]
            found = inside if len(inside) else found
        found = np.sort(found)
        kept = np.zeros((len(found), self.n), bool)
        for at in range(0, len(found), 4096):
            x = (found[at : at + 4096, None] ^ self.salt) * np.uint64(0x9FB21C651E98DF25)
            x = (x ^ (x >> np.uint64(35))) * np.uint64(0x9FB21C651E98DF25)
            kept[at : at + 4096] = (x ^ (x >> np.uint64(28))) <= self.least
        subset, place = np.nonzero(kept.T)  # by subset, then by term
        ends = np.searchsorted(subset, np.arange(self.n + 1)) * 8
        raw, out, digest = memoryview(found[place].tobytes()), bytearray(4 * self.n), xxhash.xxh64_digest
        for s in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
            out[4 * s : 4 * s + 4] = digest(raw[ends[s] : ends[s + 1]], s)[:4]
        return bytes(out)


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal signatures among the subsets in which either text has terms; 1 if neither has any."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    some = (x != 0) | (y != 0)
    return float(((x == y) & some).sum() / some.sum()) if some.any() else 1.0


def lexicon(docs: DataFrame, band: Band, text_col: str = "text") -> np.ndarray:
    """The sorted hashes of the terms in the band; see the bound above."""
    least, most = band.bounds(docs.count())
    found = written(document_frequencies(docs, text_col).where(F.col("df").between(float(least), float(most))).select("term"), "lexicon")
    if (n := found.count()) > TERMS:
        raise ValueError(f"{n} terms in the band: a lexicon is broadcast, so it may have {TERMS}; choose a narrower band")
    return np.sort(found.toArrow().column("term").combine_chunks().to_numpy().view(np.uint64))


def _cuts(keyed: DataFrame) -> np.ndarray:
    """Keys (key, tie), ascending, that cut the order into about as many stretches as a stretch has rows."""
    rows = keyed.count()
    n = math.isqrt(rows)
    if n < 2:
        return np.zeros((0, 2), np.int64)
    some = keyed.select("key", "tie").sample(min(1.0, SAMPLED * n / rows), seed=1).toArrow()
    found = np.stack([some.column(c).combine_chunks().to_numpy() for c in ("key", "tie")], axis=1)
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    return np.unique(found[SAMPLED // 2 :: SAMPLED], axis=0)


def stretch_of(cuts: np.ndarray, key: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """How many cuts are not after each (key, tie)."""
    low, high = np.searchsorted(cuts[:, 0], key, side="left"), np.searchsorted(cuts[:, 0], key, side="right")
    for k in np.flatnonzero(high > low):  # cuts inside the rows of one key
        high[k] = low[k] + np.searchsorted(cuts[low[k] : high[k], 1], tie[k], side="right")
    return high


def fingerprint_edits(docs: DataFrame, band: Band | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness.

    The edited text replaces the last floor(n / 2) code points by as many of the first ones of the next
    document (all, if it has fewer), in descending order of id; the document after the last is the first.
    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null and empty texts have an empty fingerprint (zeros). Null ids come last; rows with the same id follow
    the hash of their text. A single row is its own next document. One row per row of docs; other columns
    aren't read. The order is kept stretch by stretch, each with a copy of the next one's first row. There are as
    many stretches as the square root of the number of rows, each with about as many rows, also where many rows
    have the same id or none; rows that share both id and text lie in one stretch (sorted on disk, if need be).
    Repeated rows each follow one another. Texts are read whole, also very long ones, packed on their way: a task
    holds a few texts at a time. An empty table gives an empty result.
    """
    band = band or Band()
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = rows.withColumns({"key": F.coalesce("doc_id", F.lit(_LEAST)), "tie": F.xxhash64("text")})
    shared = spark.sparkContext.broadcast((lexicon(rows, band), band))
    cuts = _cuts(keyed)

    def read(ghost: bool, moved: dict[int, int]):
        def make(batch: pa.RecordBatch) -> pa.RecordBatch:
            signer, pack = Signer(*shared.value), zstandard.ZstdCompressor(level=3)
            texts = batch.column(1).to_pylist()
            at = stretch_of(cuts, batch.column(2).to_numpy(), batch.column(3).to_numpy())
            raw = [t.encode() for t in texts]
            return pa.record_batch(
                [
                    pa.array([moved.get(x, x) for x in at.tolist()], pa.int32()),
                    pa.array([ghost] * len(texts)),
                    *batch.columns[:1],
                    batch.column(2),
                    batch.column(3),
                    pa.array([signer.sign(t) for t in texts], pa.binary()),
                    pa.array([pack.compress(t) for t in raw], pa.binary()),
                ],
                ["stretch", "ghost", "doc_id", "key", "tie", "fp", "packed"],
            )

        return per_batch(make, 1)

    schema = "stretch int, ghost boolean, doc_id long, key long, tie long, fp binary, packed binary"

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = stretch_of(cuts, keys, ties)
            order = np.lexsort((ties, keys, at))
            last = order[np.flatnonzero(np.append(at[order][1:] != at[order][:-1], True))] if len(order) else order
            yield pa.record_batch([pa.array(at[last].astype(np.int32)), pa.array(keys[last]), pa.array(ties[last])], ["stretch", "key", "tie"])

    # the first row of each stretch: no more rows than stretches
    top = F.max(F.struct("key", "tie")).alias("top")
    firsts = keyed.select("key", "tie").mapInArrow(tops, "stretch int, key long, tie long").groupBy("stretch").agg(top).select("stretch", "top.*").toArrow()
    order = sorted(firsts.column("stretch").to_pylist(), reverse=True)
    before = dict(zip(order, order[-1:] + order[:-1], strict=True))
    sought = F.broadcast(spark.createDataFrame(firsts).select("key", "tie"))
    heads = keyed.join(sought, ["key", "tie"]).select("doc_id", "text", "key", "tie").dropDuplicates(["key", "tie"])
    every = keyed.mapInArrow(read(False, {}), schema).union(heads.mapInArrow(read(True, before), schema))
    following = Window.partitionBy("stretch").orderBy("ghost", F.desc("key"), F.desc("tie"))
    paired = every.withColumns({"next_fp": F.lead("fp").over(following), "next_packed": F.lead("packed").over(following)}).where("not ghost")

    def edit(batch: pa.RecordBatch) -> pa.RecordBatch:
        signer, unpack = Signer(*shared.value), zstandard.ZstdDecompressor()
        out = []
        for fp, packed, next_fp, next_packed in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
            text, after = unpack.decompress(packed).decode(), unpack.decompress(next_packed).decode()
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            other = signer.sign(edited)
            out.append((len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.hex(), other.hex(), likeness(fp, other), likeness(fp, next_fp)))
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        return pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names)

    return paired.select("doc_id", "fp", "packed", "next_fp", "next_packed").mapInArrow(
        per_batch(edit),
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
