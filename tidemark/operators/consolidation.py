"""One consolidation run: rescore, select, extract, assert, mark, decay, archive.

Model output is written once, to a table of raw output, and everything else reads that: however often results are
looked at, no text is scored or extracted again. Only the batch is asserted, against the open versions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..sources.scratch import written
from . import episodes as E
from . import extraction as X
from . import facts as V
from . import salience as S
from .providers import Local, Provider, extracted_text, scored_text


@dataclass
class Run:
    """What a run leaves: new log rows, the state after it, and a report of one row."""

    scores: DataFrame
    outcomes: DataFrame
    assertions: DataFrame
    mentions: DataFrame
    changed: DataFrame
    raw: DataFrame
    episodes: DataFrame
    report: DataFrame


def run_once(
    episodes: DataFrame, log: DataFrame, now_ms: int, settings: Settings | None = None, provider: Provider | None = None,
    facts: DataFrame | None = None, keep: Callable[[DataFrame, str], DataFrame] = written, entities: DataFrame | None = None,
) -> Run:
    """Consolidates over logs; a replay gives the same rows, so a lost run can be repeated.

    Unscored episodes are scored without history. Candidates are asserted in the order of their salience,
    then age and id; an episode's entities become known before its facts, and the names in facts are those that their
    aliases stand for by then. Episodes whose extraction fails are marked and not tried again.

    facts: the versions after the log, if they are kept (see facts.FactTable); else they are derived from the log.
    entities: those known before. keep: writes a table of raw model output under a label and gives what was written.
    """
    settings, provider = settings or Settings(), provider or Local()
    facts = V.versions(log) if facts is None else facts
    lost = E.unscored(episodes, settings.rescore_limit)
    none = F.array().cast("array<string>")
    said = keep(lost.select("id", scored_text(F.col("content"), none, provider).alias("raw")), "raw-scores")
    scores = S.parse(said).drop("raw").withColumn("at", F.lit(now_ms))
    scored = E.with_scores(episodes, scores)
    chosen = E.candidates(scored, now_ms, settings)
    subjects = F.create_map(*(F.lit(x) for p in settings.canonical_subjects.items() for x in p)) if settings.canonical_subjects else F.create_map().cast("map<string,string>")
    raw = chosen.select("id", "tenant", "salience", "created_at", extracted_text(F.col("content"), F.coalesce(subjects[F.col("tenant")], F.col("tenant")), provider).alias("raw"))
    raw = keep(raw, "raw-extractions")
    found = X.map_predicates(X.raw_facts(raw), settings)
    named = X.raw_entities(raw)
    # within a run (what batch_size episodes say), counted in order, entities before facts; after everything in the log
    order = raw.select("id", "tenant", "salience", "created_at")
    rows = named.select("id", F.lit(0).alias("kind"), "position").unionByName(found.select("id", F.lit(1).alias("kind"), "position"))
    turn = F.row_number().over(Window.partitionBy("_one").orderBy(F.desc("salience"), "created_at", "id", "kind", "position"))
    start = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("start")).withColumn("_one", F.lit(1))
    turns = rows.join(order.drop("tenant"), "id").withColumn("_one", F.lit(1)).withColumn("turn", turn).join(start, "_one").select("id", "kind", "position", (F.col("start") + F.col("turn")).alias("seq"))
    mentions = named.join(turns.where("kind = 0").drop("kind"), ["id", "position"]).select("tenant", "name", "entity_type", "aliases", F.lit(now_ms).cast("long").alias("ts"), "seq")
    placed = found.join(turns.where("kind = 1").drop("kind"), ["id", "position"])
    assertions = placed.select(
        "tenant", "seq", F.lit(now_ms).cast("long").alias("ts"), F.lit("assert").alias("op"), "subject", "predicate", "object", "confidence", F.col("id").alias("source"),
    )
    assertions = V.resolve_log(assertions, V.alias_history(mentions, entities))
    refs = named.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda x: x["name"]).alias("refs"))
    outcomes = raw.select("id", F.lit(now_ms).cast("long").alias("at"), F.col("raw").isNull().alias("failed")).join(refs, "id", "left")
    outcomes = outcomes.withColumn("refs", F.coalesce("refs", none))
    after = E.archive(E.decay(E.with_outcomes(scored, outcomes), now_ms, settings), now_ms, settings)
    assertions = keep(assertions, "assertions")
    acted = V.batch_actions(facts, assertions)
    counts = acted.agg(*(F.count_if(F.col("action") == a).alias(a) for a in ("inserted", "superseded", "duplicate")))
    marked = outcomes.agg(F.count("*").alias("candidates"), F.count_if("failed").alias("failed"))
    archived = after.agg(F.count_if(F.col("archive_rule") == 1).alias("faded"), F.count_if(F.col("archive_rule") == 2).alias("expired"))
    rescored = scores.agg(F.count("*").alias("rescored"))
    one = F.lit(1).alias("_one")
    report = rescored.select("*", one).join(marked.select("*", one), "_one").join(counts.select("*", one), "_one").join(archived.select("*", one), "_one").drop("_one")
    output = said.select("id", F.lit("score").alias("kind"), "raw").union(raw.select("id", F.lit("extract").alias("kind"), "raw"))
    return Run(scores, outcomes, assertions, mentions, V.advance(facts, assertions), output, after, report)

