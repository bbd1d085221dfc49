"""Versions kept as a table that ticks add to, without reading what is closed.

Under a folder: closed/batch=n has the versions that tick n closed, and never changes; open/batch=n has all versions that
are open after tick n; pointer says which tick counts. The pointer moves last. So a reader sees whole ticks only, a tick
that died halfway runs again and replaces its own files, and a tick reads its batch of the log and the open versions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import committed, last_mark, mark, there
from . import facts as V

SCHEMA = (
    "id string, tenant string, subject string, predicate string, object string, valid_from long, valid_until long, confidence double, "
    "sources array<string>, superseded_by string, asserted long, seq long"
)


@dataclass
class FactTable:
    spark: SparkSession
    path: str

    def last(self) -> int:
        """The last tick that counts; -1 before the first."""
        where = f"{self.path}/pointer"
        found = last_mark(self.spark, where).agg(F.max("done")).first()[0] if there(self.spark, where) else None
        return -1 if found is None else found

    def open(self) -> DataFrame:
        """The versions that hold now."""
        n = self.last()
        return self._at("open", f"batch={n}") if n >= 0 else self.spark.createDataFrame([], SCHEMA)

    def closed(self) -> DataFrame:
        """The versions that held until some tick that counts."""
        where, n = f"{self.path}/closed", self.last()
        if n < 0:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(f"{SCHEMA}, batch int").option("basePath", where).parquet(where)
        return rows.where(F.col("batch") <= n).drop("batch")

    def versions(self) -> DataFrame:
        return self.open().unionByName(self.closed())

    def _at(self, kind: str, part: str) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{kind}/{part}")

    def add(self, log: DataFrame, now_ms: int, number: int | None = None) -> DataFrame:
        """Adds a batch of log rows as tick `number` (by default the next) and returns the actions of its assertions.

        Its rows must follow all earlier ones by seq. A tick that counts already isn't added again: its number says so.
        """
        last = self.last()
        number = last + 1 if number is None else number
        if not last < number <= last + 1:
            if number <= last:
                return V.batch_actions(self.spark.createDataFrame([], SCHEMA), log.limit(0))
            raise ValueError(f"tick {number} doesn't follow tick {last}")
        now = self.open()
        acted = V.batch_actions(now, log)
        changed = committed(V.advance(now, log), f"{self.path}/changed", number)
        committed(changed.where("valid_until IS NOT NULL"), f"{self.path}/closed", number)
        rest = now.join(changed.select("id"), "id", "left_anti").select(*V.FACT)
        committed(rest.unionByName(changed.where("valid_until IS NULL").select(*V.FACT)), f"{self.path}/open", number)
        mark(self.spark, f"{self.path}/pointer", "added", now_ms, number, number)
        return acted
