"""Export, import, dumps and backups as files that Spark reads and writes."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import day_of
from ..operators.order import numbered


def export_lines(episodes: DataFrame, facts: DataFrame) -> DataFrame:
    """One JSON line ({type, data}) for every episode, archived ones too, and every fact."""
    def lines(rows: DataFrame, kind: str) -> DataFrame:
        return rows.select(F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(*rows.columns).alias("data"))).alias("value"))

    return lines(episodes, "episode").union(lines(facts, "fact"))


def export(episodes: DataFrame, facts: DataFrame, path: str) -> None:
    export_lines(episodes, facts).write.text(path)


def import_records(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """The records of one kind from exported lines; lines that can't be read are left out."""
    lines = spark.read.text(path).select(F.from_json("value", f"type string, data struct<{schema}>").alias("r"))
    return lines.where(F.col("r.type") == kind).select("r.data.*")


def import_in_order(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """import_records with position from 1 in the order of created_at, then id, as a replay takes them."""
    return numbered(import_records(spark, path, kind, schema), ["created_at", "id"], label="import")


def there(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, in whatever store the path names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def committed(rows: DataFrame, path: str, batch: int) -> DataFrame:
    """Writes rows as one batch of the table at path, and returns them as they were written.

    A batch that is written again takes its own place, so a run that died can be repeated, and what belongs together (a
    row, its vector and its code) is there as a whole or not at all.
    """
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/batch={batch}")


def dump_archived(episodes: DataFrame, path: str, now_ms: int) -> DataFrame:
    """Writes archived episodes that aren't in the dump at path yet as JSON lines, under the month of now and a folder of
    this call; returns what remains. A second call adds nothing, and one that died is made good by the next."""
    spark = episodes.sparkSession
    gone = episodes.where("archived")
    month = spark.range(1).select(F.date_format(day_of(F.lit(now_ms)), "yyyy-MM")).first()[0]
    if there(spark, path):
        had = spark.read.schema("id string, call long").json(path).where(F.col("call") != now_ms)
        gone = gone.join(had.select("id"), "id", "left_anti").select(*gone.columns)
    gone.write.mode("overwrite").json(f"{path}/month={month}/call={now_ms}")
    return episodes.where("NOT archived")


def backup(tables: dict[str, DataFrame], path: str, stamp: str) -> None:
    """A snapshot of each table under path/stamp."""
    for name, rows in tables.items():
        rows.write.mode("errorifexists").parquet(f"{path}/{stamp}/{name}")


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """A skill registry file ({name: skill}); one that isn't a JSON object gives no rows."""
    kind = "map<string, struct<name: string, desc: string, signature: string, success_rate: double, last_used_at: bigint, version: int, uses: bigint>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("m"))
    return whole.select(F.posexplode("m").alias("position", "key", "s")).select("position", "s.*")


def save_registry(skills: DataFrame, path: str) -> None:
    """Writes a registry (position, name, desc, signature, success_rate, last_used_at, version, uses) as one file of the
    form that load_registry reads. Skills are few: each is a line of code that someone has registered."""
    body = F.to_json(F.struct("name", "desc", "signature", "success_rate", "last_used_at", "version", "uses"), {"ignoreNullFields": "false"})
    told = skills.select("position", body.alias("body"), F.to_json(F.struct(F.col("name").alias("n"))).alias("key"))
    entries = told.select("position", F.concat(F.expr("substring(key, 6, length(key) - 6)"), F.lit(": "), "body").alias("entry"))
    whole = entries.agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "entry"))), lambda x: x["entry"]), ", "), F.lit("}")).alias("value"))
    whole.coalesce(1).write.mode("overwrite").text(path)


def with_tenant(rows: DataFrame, default: str = "user") -> DataFrame:
    """Rows of a table from before tenants."""
    return rows.withColumn("tenant", F.coalesce("tenant", F.lit(default)) if "tenant" in rows.columns else F.lit(default))


def append_raw(output: DataFrame, path: str, model: str, prompt: str, run: int = 0) -> None:
    """Adds raw model output (id, kind, raw) as JSON lines, so that it can be read again without the model. A run that is
    added again replaces its own lines."""
    output.select(F.lit(model).alias("model"), F.lit(prompt).alias("prompt"), "id", "kind", "raw").write.mode("overwrite").json(f"{path}/run={run}")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("model string, prompt string, id string, kind string, raw string").json(path)


def read_references(spark: SparkSession, path: str, tenant: str) -> DataFrame:
    """Reference facts from JSON lines, numbered in the order of the file: ref_id, tenant, subject, predicate, object,
    confidence. Lines that can't be read, or lack one of the three names, are left out."""
    rows = spark.read.schema("subject string, predicate string, object string, confidence double").json(path)
    found = rows.where("subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL")
    return found.select(F.monotonically_increasing_id().alias("ref_id"), F.lit(tenant).alias("tenant"), "subject", "predicate", "object", "confidence")


def mark(spark: SparkSession, path: str, phase: str, now_ms: int, done: int = 0, total: int = 0, remaining_s: int | None = None) -> None:
    """Replaces the one-row status of a worker under path: its phase, progress and time. A reader sees the last."""
    row = spark.createDataFrame([(phase, now_ms, done, total, remaining_s)], "phase string, at_ms long, done int, total int, remaining_s int")
    row.coalesce(1).write.mode("overwrite").json(path)


def last_mark(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("phase string, at_ms long, done int, total int, remaining_s int").json(path)


def reset(spark: SparkSession, schemas: dict[str, str], path: str) -> None:
    """Empty tables under path in place of those of the names given; nothing else there is touched."""
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/{name}")


def alive(rows: DataFrame) -> bool:
    """Whether a table can be read; false if its files are missing or can't be opened."""
    try:
        rows.limit(1).collect()
    except (AnalysisException, PySparkException, Py4JJavaError):
        return False
    return True
