"""Mixing sources to target weights by repeating documents.

Tokens are summed by source, each source's target gives its repetition rate, and every document comes
floor(rate) times plus one more with probability rate - floor(rate), decided by a hash of its id, its text and
its number among equal rows. Sums are pre-aggregated in each task. The table of sources has a row a source; it is
broadcast if it has no more than SOURCES rows, so that a hot source only means many rows that find the same small
row.

Equal rows are numbered by (key, partition of the scan): counts of each partition are pre-aggregated, and a
partition's rows go on from those of the partitions before it. So many equal rows are dealt over many tasks, and
together they have the same numbers however the table is cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, written

#: Sources of a table that is broadcast, at most.
SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"
#: 13 hex digits of a digest, as a fraction.
_UNIT = float(16**13)


def words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long"), F.lit(0).cast("long"))


def chance(seed: int, *parts: Column) -> Column:
    """A number from 0 to 1 (excluded) that depends on the seed and the parts alone; null counts as no text."""
    told = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(told.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(_UNIT)


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), total: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size): what each source should contribute.

    Sources in code point order, null last, take the weights in turn and share total times the sum of all
    sizes. No target is above most times its source's size; what is cut off goes to the others by weight until
    none is above. Runs over one row a source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", cycle).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    # sources reach their cap in the order of cap / weight; find how many do
    capped = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = capped.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    by = by.withColumns({
        "free": F.lit(float(total)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "left": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    by = by.withColumn("level", F.col("free") / F.col("left")).withColumn("open", F.col("level") <= F.col("cap") / F.col("weight"))
    # the first open source's level holds for all that are open
    level = F.min_by(F.when(F.col("open"), F.col("level")), F.struct(~F.col("open"), F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")).over(whole)
    target = F.least(F.col("cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return by.select("source", "source_size", target.alias("target"))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (key, part, ...) with number: 0 for the first row of a key, then 1 and so on.

    Only rows whose key comes up more than once are sorted, and while such keys are few, only they are shuffled.
    """
    parts = rows.groupBy("key", "part").agg(F.count("*").alias("n"))
    of_key = Window.partitionBy("key")
    before = F.sum("n").over(of_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    several = parts.withColumns({"all": F.sum("n").over(of_key), "before": F.coalesce(before, F.lit(0))}).where("all > 1").select("key", "part", "before")
    several = few(several, "equal-rows")
    turn = F.row_number().over(Window.partitionBy("key", "part").orderBy("key")) - 1
    equal = rows.join(several, ["key", "part"]).withColumn("number", (F.col("before") + turn).cast("long"))
    alone = rows.join(several.select("key", "part"), ["key", "part"], "left_anti").withColumn("number", F.lit(0).cast("long"))
    return equal.drop("before").unionByName(alone)


def _planned(docs: DataFrame, carried: Sequence[str], seed: int, id_col: str, text_col: str, source_col: str, **shares) -> DataFrame:
    """(row, size, source_size, target, rate, copies) for each row of docs; row has the carried columns as c0, c1 ..."""
    rows = docs.select(
        F.struct(F.lit(True).alias("_"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(carried))).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        words(F.col(text_col)).alias("size"), F.md5(F.coalesce(text_col, F.lit("")).cast("binary")).alias("digest"),
        F.xxhash64(id_col, text_col, source_col).alias("key"), F.spark_partition_id().alias("part"),
    )
    found = written(targets(rows.select("source", "size"), **shares), "targets")
    found = F.broadcast(found) if found.count() <= SOURCES else found
    held = found.select(F.col("source").alias("of"), "source_size", "target")
    joined = _numbered(rows).join(held, F.col("source").eqNullSafe(F.col("of")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    more = (chance(seed, F.col("id"), F.col("number"), F.col("digest")) < F.col("rate") - F.floor("rate")).cast("long")
    return joined.withColumn("rate", rate).select("row", "size", "source_size", "target", "rate", (F.floor("rate") + more).alias("copies"))


def plan(
    docs: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carried: Sequence[str] | None = None, **shares
) -> DataFrame:
    """docs, or their carried columns, with size, source_size, target, rate and copies (how often the mix takes the row).

    Size is the number of words (null text: 0). Rows draw by their id, text and number among equal rows, so
    rows with null or repeated ids draw each for itself. Sources without words have target and rate 0. Columns
    of docs with these names are replaced; all others go through. An empty table gives an empty result.
    """
    ours = ["size", "source_size", "target", "rate", "copies"]
    carried = [c for c in (docs.columns if carried is None else carried) if c not in ours]
    kept = [F.col("row")[f"c{k}"].alias(c) for k, c in enumerate(carried)]
    return _planned(docs, carried, seed, id_col, text_col, source_col, **shares).select(*kept, *ours)


def mix(docs: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **shares) -> DataFrame:
    """The mixed rows: each row of docs as often as the plan takes it, with the columns of docs as they are.

    Nulls, ties, repeated rows and clashing names as in plan(). Texts go through whole, also very long ones; only rows
    that have an equal are shuffled. An empty table gives an empty result.
    """
    planned = _planned(docs, docs.columns, seed, id_col, text_col, source_col, **shares)
    repeated = planned.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return repeated.select(*(F.col("row")[f"c{k}"].alias(c) for k, c in enumerate(docs.columns)))


#: The same rows for DuckDB, as the query op9 has them.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, text, row_number() OVER (PARTITION BY doc_id, source, text) - 1 AS number,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INTEGER] AS weight,
    source_size * 2.0::DOUBLE AS cap FROM s
), f AS (
  SELECT *, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0.0::DOUBLE) AS free,
    sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0::DOUBLE) AS remaining
  FROM w WINDOW b AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT free / remaining AS level FROM f WHERE free / remaining <= cap / weight ORDER BY cap / weight, source IS NULL, source LIMIT 1
), t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT level FROM l), 'inf'::DOUBLE) * weight) AS target FROM f
), r AS (
  SELECT doc_id, text, number, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate)::BIGINT
    + CASE WHEN ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || number || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
