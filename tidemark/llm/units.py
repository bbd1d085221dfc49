"""Substring dedup by hashing lines, paragraphs or sentences.

Texts are cut into units, each with the separator behind it. Units are normalised (A-Z become a-z, white space
runs become one space) and hashed; digests are grouped over all documents, the first occurrence by (doc_id,
row, position) stays and later ones count as repeated. What goes are runs of consecutive repeated units that
reach a number of words: short lines and sentences repeat by chance, passages don't.

A row sends one mark for each distinct digest that it has; marks are pre-aggregated in each task, and the most
frequent digests are looked up in a broadcast table of bounded size, so a line that a third of the documents
share is no hot key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, joined, per_batch, sliced, written

#: What ends a unit of each kind. A sentence ends with its line, too.
_ENDS = {"line": "\n", "paragraph": r"\n[ \t\r]*\n\s*", "sentence": r"\n|[.!?][ \t\r]+"}


def cut(text: str, unit: str) -> list[tuple[int, int]]:
    """The code point spans of a text's units; they cover it without gaps."""
    ends = [m.end() for m in re.finditer(_ENDS[unit], text, re.ASCII)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return list(zip([0, *ends], ends, strict=False))


def digests(text: str, spans: list[tuple[int, int]]) -> tuple[list[bytes | None], list[int]]:
    """96 bits of each normalised unit (none without words), and its number of words.

    Of 10 ** 12 different units about one pair in a hundred thousand such corpora shares its digest.
    """
    found, sizes = [], []
    digest = xxhash.xxh3_128_digest
    for a, b in spans:
        words = text[a:b].encode().lower().split()
        found.append(digest(b" ".join(words))[:12] if words else None)
        sizes.append(len(words))
    return found, sizes


def _firsts(found: list[bytes | None]) -> dict[bytes, int]:
    """Where each digest comes up first in its text."""
    first: dict[bytes, int] = {}
    for k, d in enumerate(found):
        if d is not None:
            first.setdefault(d, k)
    return first


def _marks(unit: str):
    """Over (row_id, id, text): (row_id, id, place, high, low), the first place of each distinct digest of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 2):
                firsts = [_firsts(digests(t, cut(t, unit))[0]) if t else {} for t in part.column(2).to_pylist()]
                row = pa.array(np.repeat(np.arange(len(firsts)), [len(f) for f in firsts]))
                places = np.fromiter((k for f in firsts for k in f.values()), np.int32)
                raw = np.frombuffer(b"".join(d for f in firsts for d in f), np.dtype([("high", "<i8"), ("low", "<i4")]))
                made = [part.column(0).take(row), part.column(1).take(row), pa.array(places), *(pa.array(np.ascontiguousarray(raw[c])) for c in ("high", "low"))]
                yield pa.record_batch(made, ["row_id", "id", "place", "high", "low"])

    return run


def gone(found: list[bytes | None], sizes: list[int], repeated: set[int], least: int) -> list[tuple[int, int]]:
    """Runs [first, last) of units to remove: all repeated, with `least` words or more.

    repeated: first places of the digests that an earlier row has. A digest that the text has had already is
    repeated, too. Units without words belong to the runs beside them.
    """
    first, out, start, words = _firsts(found), [], 0, 0
    for k, d in enumerate(found):
        if d is None or first[d] != k or k in repeated:
            words += sizes[k]
            continue
        if words >= least:
            out.append((start, k))
        start, words = k + 1, 0
    if words >= least:
        out.append((start, len(found)))
    return out


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ADDED = (("n_units", T.IntegerType()), ("n_removed", T.IntegerType()), ("removed", _SPANS))


def remove_repeats(docs: DataFrame, unit: str = "sentence", min_words: int = 30, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated passages removed from the text, and (n_units, n_removed, removed) beside it.

    A unit is repeated if it comes up earlier: in a row with a smaller id (nulls last; among equal ids, in some
    fixed order of the rows), or before in its own text. Runs of repeated units of min_words words or more in
    all go with their separators; the rest of the text stays as it is. removed holds the [start, end) spans of
    what went, in code points of the original text, in order; n_removed counts the units in them.

    A null text stays null, with no units; an empty one has none either. Every row of docs gives a row, also
    repeated ones, of which one keeps its text. Columns of docs named n_units, n_removed or removed are
    replaced; all others go through, whatever their names and types. Texts are cut whole, also very long ones: a task
    holds the digests of one text at a time. An empty table gives an empty result.
    """
    others = [c for c in docs.columns if c != text_col and c not in dict(_ADDED)]
    rows = written(
        docs.select(
            F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
            F.struct(F.lit(True).alias("_"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(others))).alias("row"),
        ),
        "unit-rows",
    )
    marks = written(rows.select("row_id", "id", "text").mapInArrow(_marks(unit), "row_id long, id long, place int, high long, low int"), "unit-marks")
    rank = F.struct(F.isnull("id").alias("none"), "id", "row_id")
    firsts = written(marks.groupBy("high", "low").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1"), "unit-firsts")
    later = joined(marks, firsts, ["high", "low"]).where(rank != F.col("first"))
    held = written(later.groupBy("row_id").agg(F.collect_list("place").alias("held")), "unit-held")
    dropped(marks, firsts)
    every = rows.join(held, "row_id", "left").select("text", "held", "row")

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, n_units, n_removed, removed = [], [], [], []
        for text, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            spans = cut(text, unit) if text else []
            runs = gone(*digests(text, spans), set(held or ()), min_words) if text else []
            n_units.append(len(spans)), n_removed.append(sum(b - a for a, b in runs))
            out = [(spans[a][0], spans[b - 1][1]) for a, b in runs]
            removed.append([{"start": a, "end": b} for a, b in out])
            if out:
                text = "".join(text[a:b] for a, b in zip([0, *(b for _, b in out)], [*(a for a, _ in out), len(text)], strict=True))
            texts.append(text)
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        made = [pa.array(texts, pa.string()), pa.array(n_units, pa.int32()), pa.array(n_removed, pa.int32()), pa.array(removed, span)]
        return pa.record_batch([*made, batch.column(2)], ["text", *dict(_ADDED), "row"])

    schema = T.StructType([T.StructField("text", T.StringType()), *(T.StructField(*x) for x in _ADDED), rows.schema["row"]])
    made = every.mapInArrow(per_batch(clean, 0), schema)
    kept = [F.col("text").alias(c) if c == text_col else F.col("row")[f"c{others.index(c)}"].alias(c) for c in docs.columns if c not in dict(_ADDED)]
    return made.select(*kept, *dict(_ADDED))


#: The same rows for DuckDB, as the query op3 has them; \x01 doesn't come up in the texts.
ORACLE = r"""
WITH pieces AS (
  SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '(\n|[.!?][ \t\r]+)', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents
), units AS (
  SELECT doc_id, place, parts[place] AS piece,
    regexp_extract_all(translate(parts[place], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS place FROM pieces) WHERE parts[place] <> ''
), marked AS (
  SELECT doc_id, place, piece, len(words) AS n,
    sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY place) AS until,
    len(words) > 0 AND row_number() OVER (PARTITION BY array_to_string(words, ' ') ORDER BY doc_id, place) = 1 AS fresh
  FROM units
), runs AS (
  SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY doc_id ORDER BY place) AS run FROM marked
), sized AS (
  SELECT *, NOT fresh AND sum(CASE WHEN fresh THEN 0 ELSE n END) OVER (PARTITION BY doc_id, run) >= 30 AS gone FROM runs
), spans AS (
  SELECT doc_id, string_agg(start || '-' || until, ',' ORDER BY run) AS removed
  FROM (SELECT doc_id, run, min(until - length(piece))::BIGINT AS start, max(until)::BIGINT AS until FROM sized WHERE gone GROUP BY doc_id, run) GROUP BY doc_id
), texts AS (
  SELECT doc_id, string_agg(piece, '' ORDER BY place) FILTER (WHERE NOT gone) AS text, count(*)::INTEGER AS n_units, count(*) FILTER (WHERE gone)::INTEGER AS n_removed
  FROM sized GROUP BY doc_id
)
SELECT d.doc_id, coalesce(t.text, '') AS text, coalesce(n_units, 0)::INTEGER AS n_units, coalesce(n_removed, 0)::INTEGER AS n_removed, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN texts t ON t.doc_id = d.doc_id LEFT JOIN spans s ON s.doc_id = d.doc_id
"""
