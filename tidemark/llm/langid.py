"""Language identification by bit-sliced Bloom filters.

Each language has a set of frequent character n-grams. One table of bit masks holds all of them: position p
has bit l set if language l's Bloom filter has bit p set, so the masks at an n-gram's positions, and-ed, name
all languages that contain it. A text's n-grams are looked up at once; the number of hits of each language is
corrected for its filter's false positives, and the largest share decides.

The table is learned from a sample of labelled rows that a parameter bounds (`per_language`); prediction reads
whole texts. Counting the n-grams of the sample is a grouped aggregation; what is collected is
`grams` n-grams a language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import per_batch, sliced

#: Characters of a text looked at together.
SLICE = 1 << 20
_MIX = np.uint64(0x9FB21C651E98DF25)
_tables: dict[str, np.ndarray] = {}


@dataclass(frozen=True)
class Settings:
    """per_language: labelled rows to learn from, about so many a language. grams: n-grams kept of each.
    bits: base-2 logarithm of the filters' size. probes: positions of an n-gram."""

    per_language: int = 4_000
    grams: int = 8_000
    bits: int = 19
    probes: int = 2


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    masks: np.ndarray  # (slices, positions): 64 languages a slice
    false_positive: np.ndarray  # of each language's filter
    probes: int


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower case, or a space for what isn't a letter; and whether it is one."""
    if not _tables:
        letter = np.zeros(0x110000, bool)
        lower = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if (ch := chr(c)).isalpha():
                letter[c] = True
                low = ch.lower()
                lower[c] = ord(low) if len(low) == 1 else c
        _tables.update(lower=lower, letter=letter)
    return _tables["lower"], _tables["letter"]


def grams(text: str) -> Iterator[np.ndarray]:
    """Hashes of a text's n-grams of three and four characters, slice by slice, none of them missing.

    Letters in lower case; anything else counts as one space. n-grams with a space inside don't count.
    """
    lower, letter = _letters()
    for at in range(0, max(len(text), 1), SLICE):
        head = " " if at == 0 else text[at - 3 : at]
        part = head + text[at : at + SLICE] + (" " if at + SLICE >= len(text) else "")
        points = np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32)
        inner = letter[points]
        c = lower[points].astype(np.uint64)
        three = (c[:-2] * np.uint64(0x1F123BB5) ^ c[1:-1] * np.uint64(0x9E3779B97F4A7C15) ^ c[2:] * np.uint64(0xC2B2AE3D27D4EB4F)) * _MIX
        first = 0 if at == 0 else 1  # a later slice starts with three characters of the one before
        yield _mixed(three[first:][inner[1:-1][first:]])
        if len(c) > 3:
            four = (three[:-1] + c[3:] * np.uint64(0x165667B19E3779F9)) * _MIX
            yield _mixed(four[inner[1:-2] & inner[2:-1]])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _places(h: np.ndarray, bits: int, probe: int) -> np.ndarray:
    return (h >> np.uint64(bits * probe)) & np.uint64((1 << bits) - 1)


def crc_thirds(id_col: str):
    """crc32 of the id as text, mod 3; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3


def train(rows: DataFrame, settings: Settings | None = None, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the languages in rows (null languages and texts don't count).

    Each text is in the sample with the same chance, decided by its hash, so that about per_language rows of
    each language are; ids play no part. A language's n-grams are its most frequent ones; equal counts: the
    smaller hash.
    """
    settings = settings or Settings()
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    share = {r["lang"]: settings.per_language / r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(share))
    if not languages:
        return Model((), np.zeros((1, 1 << settings.bits), np.uint8), np.zeros(0), settings.probes)
    chance = F.create_map(*(F.lit(x) for pair in share.items() for x in pair))[F.col("lang")]
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < chance * float(1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 0):
                langs = np.array(part.column(1).to_pylist())
                for lang in np.unique(langs).tolist():
                    own = part.column(0).take(pa.array(np.flatnonzero(langs == lang))).to_pylist()
                    h, n = np.unique(np.concatenate([h for text in own for h in grams(text)]), return_counts=True)
                    yield pa.record_batch([pa.array([lang] * len(h)), pa.array(h.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    kept = counts.withColumn("rank", rank).where(F.col("rank") <= settings.grams).select("lang", "gram").toArrow()
    size = 1 << settings.bits
    kind = next(k for n, k in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (1 << 60, np.uint64)) if len(languages) <= n)
    masks = np.zeros((-(-len(languages) // 64), size), kind)
    langs, found = np.array(kept.column("lang").to_pylist()), kept.column("gram").to_numpy().view(np.uint64)
    false = np.zeros(len(languages))
    for k, lang in enumerate(languages):
        own = np.zeros(size, bool)
        for probe in range(settings.probes):
            own[_places(found[langs == lang], settings.bits, probe)] = True
        masks[k // 64, own] |= kind(1 << k % 64)
        false[k] = own.mean() ** settings.probes
    return Model(languages, masks, false, settings.probes)


def classify(text: str | None, model: Model) -> tuple[str, float]:
    """The language and its share of the text's n-grams (0 to 1); und and 0 if there is no letter.

    Equal shares: the first language in code point order.
    """
    if not text or not model.languages:
        return "und", 0.0
    bits = model.masks.shape[1].bit_length() - 1
    hits, n = np.zeros(len(model.languages), np.int64), 0
    for h in grams(text):
        n += len(h)
        places = [_places(h, bits, p) for p in range(model.probes)]
        for s, masks in enumerate(model.masks):
            found = masks[places[0]]
            for p in places[1:]:
                found &= masks[p]
            for k in range(64 * s, min(64 * s + 64, len(hits))):
                hits[k] += np.count_nonzero(found & masks.dtype.type(1 << k % 64))
    if not n:
        return "und", 0.0
    share = np.clip((hits / n - model.false_positive) / (1 - model.false_positive), 0, 1)
    best = int(np.argmax(share))
    return model.languages[best], float(share[best])


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and lang_score; columns of these names are replaced.

    Only the text is looked at. Null, empty and letterless texts are und with score 0. Repeated rows each give a row,
    with the same prediction. Texts are read whole, also very long ones, in slices. An empty table gives an empty
    result, and a model that has learned nothing says und.
    """
    base = docs.drop("lang_pred", "lang_score")
    shared, at = docs.sparkSession.sparkContext.broadcast(model), base.columns.index(text_col)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [classify(t, shared.value) for t in batch.column(at).to_pylist()]
        more = [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
        return pa.record_batch([*batch.columns, *more], [*batch.schema.names, "lang_pred", "lang_score"])

    wider = base.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("lang_score")).schema
    return base.mapInArrow(per_batch(make, at), wider)
