"""What several operators share: scratch tables, joins on skewed keys and row batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import TIDY, dropped, tables_of, written

__all__ = ["BYTES", "OFTEN", "TIDY", "dropped", "few", "joined", "per_batch", "sliced", "tables_of", "written"]

#: Bytes of text that a task turns into rows at a time.
BYTES = 2 << 20
#: Keys of a join that are looked up in a broadcast table, at most.
OFTEN = 1_000
#: Rows of a table that is broadcast because it was counted, at most.
FEW = 100_000


def few(rows: DataFrame, label: str, most: int = FEW) -> DataFrame:
    """rows, written, and marked to be broadcast if they are no more than `most`."""
    rows = written(rows, label)
    return F.broadcast(rows) if rows.count() <= most else rows


def joined(large: DataFrame, small: DataFrame, on: list[str], count: str = "n") -> DataFrame:
    """large joined to small, where some keys may hold a large part of large's rows.

    small has one row a key, with the number of large's rows of that key in `count` (which doesn't come out).
    The OFTEN keys with the most rows are broadcast; any other key has less than an OFTEN-th of the rows.
    """
    rest = [c for c in small.columns if c not in (*on, count)]
    often = small.orderBy(F.desc(count), *on).limit(OFTEN).select(*on, *rest)
    keys = F.broadcast(often.select(*on))
    hot = large.join(F.broadcast(often), on)
    return hot.unionByName(large.join(keys, on, "left_anti").join(small.select(*on, *rest).join(keys, on, "left_anti"), on))


def sliced(batch: pa.RecordBatch, texts: int | None, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose column number `texts` (texts or lists of 32-bit numbers) holds about `most`
    bytes; one row at least."""
    if texts is None or batch.num_rows < 2:
        yield batch
        return
    column = batch.column(texts)
    size = pc.multiply(pc.list_value_length(column), 4) if pa.types.is_list(column.type) else pc.binary_length(column)
    size = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def per_batch(make: Callable[[pa.RecordBatch], pa.RecordBatch], texts: int | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that turns each batch into one, or into several of about BYTES of text each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from map(make, sliced(batch, texts))

    return run
