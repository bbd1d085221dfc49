"""Positions of rows in a whole order, or in the order of a few large groups, without a task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Rows of (partition, group) counts that are broadcast, at most.
COUNTS = 100_000
#: The part of monotonically_increasing_id that counts rows inside a partition.
_TURN = (1 << 33) - 1


def numbered(rows: DataFrame, order: Sequence[str | Column], within: Sequence[str] = (), name: str = "position", label: str = "order") -> DataFrame:
    """rows with their position (from 1) in the order given, inside each group of the columns `within`.

    Rows are range-partitioned by group and order, so a large group is dealt over many tasks; counts of each
    (partition, group) say where a partition's rows of a group begin. Nulls come first and group together. Rows that
    are equal in group and order are numbered in the order in which they are scanned. An empty table gives an empty result.

    rows must not have columns that begin with _order.
    """
    within = list(within)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = {f"_order_{k}": F.col(c) if isinstance(c, str) else c for k, c in enumerate(order)}
    dealt = rows.withColumns(keys | {"_order_row": F.monotonically_increasing_id()})
    by = [*within, *keys, "_order_row"]
    dealt = dealt.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop(*keys, "_order_row")
    dealt = dealt.withColumns({"_order_part": F.spark_partition_id(), "_order_turn": F.monotonically_increasing_id().bitwiseAND(_TURN)})
    dealt = written(dealt, label)
    counts = dealt.groupBy("_order_part", *within).agg(F.count("*").alias("_order_n"), F.min("_order_turn").alias("_order_first"))
    before = Window.partitionBy(*within).orderBy("_order_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_order_start", F.coalesce(F.sum("_order_n").over(before), F.lit(0)) - F.col("_order_first") + 1)
    held = [F.col(c).alias(f"_order_{k}") for k, c in enumerate(within)]
    counts = written(counts.select(F.col("_order_part").alias("_order_of"), *held, "_order_start"), f"{label}-counts")
    if counts.count() <= COUNTS:
        counts = F.broadcast(counts)
    same = F.col("_order_part") == F.col("_order_of")
    for k, c in enumerate(within):
        same &= F.col(c).eqNullSafe(F.col(f"_order_{k}"))
    found = dealt.join(counts, same).withColumn(name, F.col("_order_turn") + F.col("_order_start"))
    return found.select(*(c for c in rows.columns if c != name), name)
