"""Fill-in-the-middle transformation by in-place rotation of blocks.

A text is cut into prefix, middle and suffix. Sentinels go in where it is cut, in the text's own bytearray, and then
two blocks change places by three reversals (each of them, then both together); doing that again restores the text
exactly. Nothing else than the bytearray and a buffer of a fixed size is held.

Cuts are drawn from a digest of the row's id, so they don't depend on how the table is partitioned.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import per_batch

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes that a reversal moves at a time.
STEP = 1 << 16


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit integers of the id's digest; a null id counts as no text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def reverse(buffer: np.ndarray, start: int, end: int) -> None:
    """Reverses buffer[start:end] in place."""
    while end - start > 1:
        n = min(STEP, (end - start) // 2)
        head = buffer[start : start + n][::-1].copy()
        buffer[start : start + n] = buffer[end - n : end][::-1]
        buffer[end - n : end] = head
        start, end = start + n, end - n


def rotate(buffer: np.ndarray, start: int, cut: int, end: int) -> None:
    """Exchanges buffer[start:cut] and buffer[cut:end] in place by three reversals."""
    reverse(buffer, start, cut)
    reverse(buffer, cut, end)
    reverse(buffer, start, end)


def places(buffer: bytearray, cuts: list[int]) -> list[int]:
    """The byte at which each of the ascending cuts, in code points, lies."""
    starts = np.flatnonzero((np.frombuffer(buffer, np.uint8) & 0xC0) != 0x80)
    return [int(starts[c]) if c < len(starts) else len(buffer) for c in cuts]


def transformed(text: str, form: str, first: int, second: int) -> bytearray:
    """The text with sentinels, in the order of the form; first and second are the cuts in code points."""
    buffer = bytearray(text, "utf-8")
    if form == "plain":
        return buffer
    a, b = places(buffer, [first, second])
    buffer[b:b] = SUFFIX
    buffer[a:a] = MIDDLE
    buffer[0:0] = PREFIX
    middle, suffix = a + len(PREFIX), b + len(PREFIX) + len(MIDDLE)
    view = np.frombuffer(buffer, np.uint8)
    rotate(view, middle if form == "psm" else 0, suffix, len(buffer))
    return buffer


def restored(output: str, form: str) -> bytearray:
    """The text of an output, by turning the blocks back and taking the sentinels out.

    No text of a form other than plain holds a sentinel, and sentinels can't overlap with what is beside them.
    """
    buffer = bytearray(output, "utf-8")
    if form == "plain":
        return buffer
    view = np.frombuffer(buffer, np.uint8)
    if form == "psm":
        at, turn = buffer.index(SUFFIX), buffer.index(MIDDLE)
        rotate(view, at, turn, len(buffer))
    else:
        rotate(view, 0, buffer.index(PREFIX), len(buffer))
    del view
    for mark in (SUFFIX, MIDDLE, PREFIX):  # from the end on
        at = buffer.rindex(mark)
        del buffer[at : at + len(mark)]
    return buffer


def planned(text: str, doc_id: int | None, seed: int, plain_from: int, spm_below: int) -> tuple[int, str, int | None, int | None]:
    """(n, form, first cut, second cut) of a text, in code points; no cuts for plain."""
    n = len(text)
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or any(m.decode() in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= plain_from:
        return n, "plain", None, None
    x, y = h1 % (n + 1), h2 % (n + 1)
    return n, "spm" if h4 % 100 < spm_below else "psm", min(x, y), max(x, y)


def transform(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of docs.

    Output is the text (plain: of plain_from or more hundredths, empty or null texts, and those that hold a
    sentinel), `<P>` prefix `<S>` suffix `<M>` middle (psm) or `<S>` suffix `<P>` prefix `<M>` middle (spm: of less
    than spm_below hundredths). n, prefix_chars and middle_chars count code points; the latter are null if plain.

    Rows with null or repeated ids each give a row; rows that share an id share their draws, and equal rows equal
    results. Other columns of docs, whatever their names, aren't read. Whole texts are cut, also very long ones: a
    task holds a few times the longest text of its rows. An empty table gives an empty result.
    """

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, form, first, middle, output = [], [], [], [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            size, kind, a, b = planned(text or "", i, seed, plain_from, spm_below)
            n.append(size), form.append(kind), first.append(a), middle.append(None if a is None else b - a)
            output.append(bytes(transformed(text or "", kind, a or 0, b or 0)))
        made = [pa.array(x, k) for x, k in ((n, pa.int64()), (form, pa.string()), (first, pa.int64()), (middle, pa.int64()))]
        return pa.record_batch([batch.column(0), *made, pa.array(output, pa.binary()).cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(per_batch(make, 1), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame) -> DataFrame:
    """rows of transform(), or of any table with form and output, with restored: the text, from those two alone.

    Null outputs give an empty text. A column named restored is replaced; all others go through.
    """
    base = rows.drop("restored")
    form, output = base.columns.index("form"), base.columns.index("output")

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [bytes(restored(o or "", f or "plain")) for o, f in zip(batch.column(output).to_pylist(), batch.column(form).to_pylist(), strict=True)]
        return pa.record_batch([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], [*batch.schema.names, "restored"])

    return base.mapInArrow(per_batch(make, output), T.StructType([*base.schema.fields, T.StructField("restored", T.StringType())]))


#: The same rows for DuckDB, as the query op13 has them.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (
  SELECT doc_id, text, n, [('0x' || substr(h, 8 * k + 1, 8))::BIGINT for k in range(4)] AS u FROM d
), f AS (
  SELECT doc_id, text, n, least(u[1] % (n + 1), u[2] % (n + 1)) AS a, greatest(u[1] % (n + 1), u[2] % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR u[3] % 100 >= 90 THEN 'plain'
      WHEN u[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT *, substr(text, 1, a::INTEGER) AS prefix, substr(text, (a + 1)::INTEGER, (b - a)::INTEGER) AS middle, substr(text, (b + 1)::INTEGER) AS suffix FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
