"""Micro-batch jobs: scoring new episodes, consolidation ticks, dumps, and keeping the last state of a stream."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings
from ..operators import salience as S
from ..operators.consolidation import Run, run_once
from ..operators.providers import Local, Provider, scored_text
from ..sources.files import dump_archived, mark, there
from .working import with_history


def deduplicated(rows: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of episodes without repeated ids within the delay (event time is created_at)."""
    timed = rows.withColumn("ts", F.timestamp_millis("created_at"))
    return timed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"]).drop("ts")


def score_stream(rows: DataFrame, path: str, checkpoint: str, provider: Provider | None = None, turns: int = 5, idle_ms: int | None = None) -> StreamingQuery:
    """Scores each new episode of a stream, by the turns before it, and writes to the score log at path, a folder a
    micro-batch: one that runs again replaces its own rows. Nothing is dropped, however far scoring falls behind.

    The last turns of each session are state of the stream, so a new turn sees those of earlier micro-batches, also
    after a restart. After the batch, backlog() tells what is left.
    """
    provider = provider or Local()

    def batch(part: DataFrame, number: int) -> None:
        raw = part.select("id", scored_text(F.col("content"), F.col("history"), provider).alias("raw"), F.col("created_at").alias("at"))
        S.parse(raw).drop("raw").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return with_history(rows, turns, idle_ms).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_batches(rows: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Writes each micro-batch of an updating stream under its number; writing one again replaces it."""

    def batch(part: DataFrame, number: int) -> None:
        part.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def backlog(episodes: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: depth (episodes that are neither archived nor in the score log yet), and oldest_ms and newest_ms of
    those. scores: the log that score_stream writes."""
    left = episodes.where(~F.col("archived")).join(scores.select("id").distinct(), "id", "left_anti")
    return left.agg(F.count("*").alias("depth"), F.min("created_at").alias("oldest_ms"), F.max("created_at").alias("newest_ms"))


def progress(query: StreamingQuery) -> dict[str, int]:
    """Of a stream: micro-batches, rows taken in, and rows of state as of the last one."""
    told = [p if isinstance(p, dict) else p.jsonValue for p in query.recentProgress]
    state = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in told if p.get("stateOperators")]
    return {"batches": len(told), "rows": sum(p["numInputRows"] for p in told), "state": state[-1] if state else 0}


def remaining_seconds(durations: list[float], done: int, total: int) -> int | None:
    """What is left of a run by the mean time of what is done; None before anything is."""
    return round(sum(durations) / len(durations) * (total - done)) if durations else None


def dump_due(now_ms: int, last_ms: int | None) -> bool:
    """Whether the monthly dump (from 03:00 UTC of the first day on) hasn't run in the month of now."""
    now = datetime.fromtimestamp(now_ms / 1000, UTC)
    start = now.replace(day=1, hour=3, minute=0, second=0, microsecond=0)
    return now >= start and (last_ms is None or last_ms < start.timestamp() * 1000)


def consolidation_tick(
    read: Callable[[], tuple[DataFrame, DataFrame, DataFrame]], write: Callable[[Run], None], now_ms: int, settings: Settings | None = None, status: str | None = None,
    entities: DataFrame | None = None,
) -> Run:
    """One tick: reads (episodes, log, versions after the log), runs once against the open versions, and hands the new
    rows on. A scheduler, or ticking(), calls it.

    status: a path that says what the worker does; after the run it tells when that was.
    """
    episodes, log, facts = read()
    if status:
        mark(episodes.sparkSession, status, "extracting", now_ms)
    run = run_once(episodes, log, now_ms, settings, facts=facts, entities=entities)
    write(run)
    if status:
        mark(episodes.sparkSession, status, "idle", now_ms)
    return run


def dump_monthly(episodes: DataFrame, path: str, marks: str, now_ms: int) -> DataFrame | None:
    """The monthly dump of archived episodes, if it is due by the mark at `marks`: returns what remains, or None.

    The mark moves after the dump is written; one that died between the two writes the same files again.
    """
    spark = episodes.sparkSession
    last = spark.read.schema("at_ms long").json(marks).agg(F.max("at_ms")).first()[0] if there(spark, marks) else None
    if not dump_due(now_ms, last):
        return None
    left = dump_archived(episodes, path, now_ms)
    mark(spark, marks, "dumped", now_ms)
    return left


def ticking(spark: SparkSession, tick: Callable[[int], None], checkpoint: str, every: str = "1 hour", clock: Callable[[], int] | None = None) -> StreamingQuery:
    """Calls tick(now_ms) at once and then at every interval, until the query is stopped. A tick that is still running
    when the next is due delays it; none run side by side. clock: what gives now_ms, by default the time of the trigger.
    """

    def batch(part: DataFrame, number: int) -> None:
        tick(clock() if clock else part.agg(F.max(F.unix_millis("timestamp"))).first()[0] or 0)

    source = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load() if clock is None else spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
