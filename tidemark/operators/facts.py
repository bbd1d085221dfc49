"""Versioned facts from an append-only log of assertions and retractions.

The log: tenant, seq, ts, op ('assert' or 'retract'), subject, predicate, object, confidence, source. Versions
are derived, never updated: a functional predicate has one current object for a subject, others one version
for each object.

versions() derives them from the whole log. advance() derives what a new batch changes from the open versions alone,
so that a tick costs as much as its batch, however long the log is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import FUNCTIONAL, MULTI, Settings
from ..sources.scratch import written
from .episodes import checked, nearest
from .order import numbered

KEY = ("tenant", "subject_key", "predicate", "slot")
FACT = ("id", "tenant", "subject", "predicate", "object", "valid_from", "valid_until", "confidence", "sources", "superseded_by", "asserted", "seq")


def _keyed(rows: DataFrame) -> DataFrame:
    rows = rows.where(F.col("predicate").isin(*FUNCTIONAL, *MULTI)).withColumns({"subject_key": F.lower("subject"), "object_key": F.lower("object")})
    return rows.withColumn("slot", F.when(F.col("predicate").isin(*FUNCTIONAL), "").otherwise(F.col("object_key")))


def _said(log: DataFrame) -> DataFrame:
    """Log rows that stand for one assertion each; open versions stand for several (see _open_rows)."""
    return log.select("tenant", "seq", "ts", "op", "subject", "predicate", "object", "confidence", F.array("source").alias("sources"), F.lit(1).cast("long").alias("times"))


def _open_rows(facts: DataFrame) -> DataFrame:
    """Open versions as rows of a log: each asserts its object with what was merged into it so far."""
    return facts.where("valid_until IS NULL").select(
        "tenant", "seq", F.col("valid_from").alias("ts"), F.lit("assert").alias("op"), "subject", "predicate", "object", "confidence", "sources", F.col("asserted").alias("times")
    )


#: What rows of a log count by: their number, or the time of which they speak and then their number.
BY_SEQ, BY_TIME = ("seq",), ("ts", "seq")


def _islands(log: DataFrame, by: Sequence[str] = BY_SEQ) -> DataFrame:
    """The log with the version each row belongs to, without retractions that hit nothing."""
    rows = _keyed(log)
    w = Window.partitionBy(*KEY).orderBy(*by)
    asserted = F.last(F.when(F.col("op") == "assert", F.col("object_key")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("asserted", asserted).where((F.col("op") == "assert") | (F.col("asserted") == F.col("object_key")))
    rows = rows.withColumns({"op_before": F.lag("op").over(w), "object_before": F.lag("object_key").over(w)})
    rows = rows.where(~((F.col("op") == "retract") & (F.coalesce("op_before", F.lit("retract")) == "retract")))
    rows = rows.withColumns({"op_before": F.lag("op").over(w), "object_before": F.lag("object_key").over(w)})
    broken = (F.col("op") == "retract") | F.col("op_before").isNull() | (F.col("op_before") == "retract") | (F.col("object_before") != F.col("object_key"))
    return rows.withColumn("broken", broken).withColumn("version", F.sum(F.col("broken").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def versions(log: DataFrame, by: Sequence[str] = BY_SEQ) -> DataFrame:
    """All fact versions: id, tenant, subject, predicate, object, valid_from, valid_until (null: current),
    confidence, sources, superseded_by, asserted (rows merged), seq (of the first).

    A version starts with an assertion of an object that isn't current; asserting it again raises its
    confidence to the maximum and adds sources. Another object (functional) or a retraction ends it; only an
    assertion supersedes. Names compare without case; the first spelling stays. Unknown predicates don't count.

    by: BY_SEQ takes rows as they come in; with BY_TIME they count at their time, so that a row that comes in late
    goes where it belongs: it may split a version, open one again, or lie between two.
    """
    return _versions(_said(log), by)


def _versions(said: DataFrame, by: Sequence[str] = BY_SEQ) -> DataFrame:
    at = F.struct(*by)
    merged = _islands(said, by).groupBy(*KEY, "version").agg(
        F.min_by("op", at).alias("op"), F.min_by("seq", at).alias("seq"), F.min_by("subject", at).alias("subject"), F.min_by("object", at).alias("object"),
        F.min_by("ts", at).alias("valid_from"), F.max("confidence").alias("confidence"), F.sum("times").alias("asserted"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(*by, "sources"))), lambda x: x["sources"]))).alias("sources"),
    )
    w = Window.partitionBy(*KEY).orderBy("version")
    fact_id = F.concat(F.lit("f"), F.col("seq").cast("string"))
    merged = merged.withColumns({"id": fact_id, "valid_until": F.lead("valid_from").over(w), "superseded_by": F.when(F.lead("op").over(w) == "assert", F.lead(fact_id).over(w))})
    return merged.where("op = 'assert'").select(*FACT)


def _with_open(facts: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch after the open versions of the subjects and predicates that it touches."""
    touched = _keyed(batch).select(*KEY).distinct()
    held = _keyed(_open_rows(facts)).join(touched, list(KEY), "left_semi")
    return held.drop("subject_key", "object_key", "slot").unionByName(_said(batch))


def advance(facts: DataFrame, batch: DataFrame) -> DataFrame:
    """The versions that a batch of log rows opens, closes or adds to, given the versions before it.

    facts: the result of versions() or apply() over everything before; only open ones are read. Rows of the batch
    must follow all earlier ones by seq. An open version keeps its id. A batch that touches nothing gives no rows.
    """
    return _versions(_with_open(facts, batch))


def apply(facts: DataFrame, changed: DataFrame) -> DataFrame:
    """All versions after advance(): changed ones take the place of those with their ids."""
    return facts.join(changed.select("id"), "id", "left_anti").select(*FACT).unionByName(changed)


def splice(facts: DataFrame, log: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stale, fresh): the ids of the versions that a batch with late rows does away with, and the versions that take
    their place, by event time.

    facts: versions(log, BY_TIME), closed ones too; log: all rows before the batch. Of each subject and predicate (and
    object, if it may have several) that the batch touches, versions stay as they are up to the one that holds when its
    first row of the batch speaks; from that one's first row on, the log's rows and the batch are read again. Rows of
    the log before it, and of other subjects, don't matter: partition the log by tenant and day, and they aren't read.
    """
    at = F.struct("ts", "seq").alias("at")
    late = _keyed(batch).groupBy(*KEY).agg(F.min(at).alias("_since"))
    own = _keyed(facts).withColumn("_start", F.struct(F.col("valid_from").alias("ts"), "seq"))
    held = own.join(late, list(KEY)).where(F.col("_start") <= F.col("_since")).groupBy(*KEY).agg(F.max("_start").alias("_held"))
    since = late.join(held, list(KEY), "left").select(*KEY, F.coalesce("_held", "_since").alias("_from"))
    since = written(since, "since")
    stale = own.join(since, list(KEY)).where(F.col("_start") >= F.col("_from")).select("id")
    again = _keyed(log).join(since, list(KEY)).where(F.struct("ts", "seq") >= F.col("_from")).select(*log.columns)
    return stale, versions(again.unionByName(batch.select(*log.columns)), BY_TIME)


def spliced(facts: DataFrame, stale: DataFrame, fresh: DataFrame) -> DataFrame:
    """All versions after splice()."""
    return facts.join(stale, "id", "left_anti").select(*FACT).unionByName(fresh)


def batch_actions(facts: DataFrame, batch: DataFrame) -> DataFrame:
    """actions() of a batch, given the versions before it."""
    return actions(_with_open(facts, batch)).join(batch.select("seq"), "seq", "left_semi")


def seeds(references: DataFrame, start: int, now_ms: int, source: str = "seed_import") -> DataFrame:
    """Log rows that assert reference facts (ref_id, subject, predicate, object, confidence) in the order of their
    unique ref_id, numbered from start on; a missing confidence is 1."""
    confidence = F.coalesce(F.col("confidence"), F.lit(1.0)) if "confidence" in references.columns else F.lit(1.0)
    return references.select(
        "tenant", (F.lit(start) + F.col("ref_id")).cast("long").alias("seq"), F.lit(now_ms).cast("long").alias("ts"), F.lit("assert").alias("op"),
        "subject", "predicate", "object", confidence.cast("double").alias("confidence"), F.lit(source).alias("source"),
    )


def action_counts(acted: DataFrame) -> DataFrame:
    """(action, n) for the three actions, also those that didn't come up."""
    every = acted.sparkSession.createDataFrame([("inserted",), ("superseded",), ("duplicate",)], "action string")
    return every.join(acted.groupBy("action").agg(F.count("*").alias("n")), "action", "left").select("action", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def actions(log: DataFrame) -> DataFrame:
    """(seq, tenant, predicate, action) of each assertion: inserted, superseded or duplicate."""
    rows = _islands(log).where("op = 'assert'")
    replaced = F.col("broken") & (F.col("slot") == "") & (F.coalesce("op_before", F.lit("retract")) == "assert")
    return rows.select("seq", "tenant", "predicate", F.when(replaced, "superseded").when(F.col("broken"), "inserted").otherwise("duplicate").alias("action"))


def retractions(log: DataFrame) -> DataFrame:
    """(seq, tenant, subject, predicate, object) of the retractions that closed a version."""
    return _islands(log).where("op = 'retract'").select("seq", "tenant", "subject", "predicate", "object")


def current(facts: DataFrame, tenant: str | None = None, subject: str | None = None, predicate: str | None = None) -> DataFrame:
    found = facts.where("valid_until IS NULL")
    if tenant is not None:
        found = found.where(F.col("tenant") == tenant)
    if subject is not None:
        found = found.where(F.lower("subject") == subject.lower())
    if predicate is not None:
        found = found.where(F.col("predicate") == predicate)
    return found


def listed(facts: DataFrame) -> DataFrame:
    """Current facts in the order of a report, by predicate and object: position from 1 in each predicate.

    There are few predicates, so positions come from a sort over many tasks."""
    return numbered(current(facts), ["object", "id"], ["tenant", "predicate"], label="listed").withColumn("position", F.col("position").cast("int"))


def as_of(facts: DataFrame, ms: int) -> DataFrame:
    """Facts that held at a time. (An addition: only current facts and whole histories are needed elsewhere.)"""
    return facts.where((F.col("valid_from") <= ms) & (F.col("valid_until").isNull() | (F.col("valid_until") > ms)))


def history(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """All versions of (tenant, subject, predicate) pairs, oldest first: version_no from 1."""
    keys = pairs.select("tenant", F.lower("subject").alias("_key"), "predicate").distinct()
    found = facts.withColumn("_key", F.lower("subject")).join(keys, ["tenant", "_key", "predicate"], "left_semi")
    w = Window.partitionBy("tenant", "_key", "predicate").orderBy("valid_from", "seq")
    return found.withColumn("version_no", F.row_number().over(w)).drop("_key")


def chains(facts: DataFrame) -> DataFrame:
    """facts of functional predicates with chain (the id of the last version that supersession leads to) and
    steps (how many versions before it), by the order of derived versions. See walk() for links as they are."""
    w = Window.partitionBy("tenant", F.lower("subject"), "predicate").orderBy(F.desc("seq"))
    ended = F.sum(F.col("superseded_by").isNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = facts.where(F.col("predicate").isin(*FUNCTIONAL)).withColumn("_chain", ended)
    c = Window.partitionBy("tenant", F.lower("subject"), "predicate", "_chain").orderBy(F.desc("seq"))
    return rows.withColumns({"chain": F.first("id").over(c), "steps": F.row_number().over(c) - 1}).drop("_chain")


def walk(facts: DataFrame) -> DataFrame:
    """(id, chain, steps, state) for each version (id, superseded_by), whatever its links say: imported ones may be broken.

    chain is the id that the links lead to and steps how many there are; state is whole, or gap (a link names a version
    that isn't there: chain is the last that is), or cycle (links go round: chain is the smallest id in the circle, and
    steps is null). Every round doubles how far each row looks, so a chain of n links takes log n rounds of one join each;
    rows that have arrived don't take part any more. Ids must be unique.
    """
    links = facts.select("id", F.col("superseded_by").alias("to"))
    there = links.select(F.col("id").alias("to"), F.lit(True).alias("_there"))
    start = links.join(there, "to", "left").select(
        "id", F.when(F.col("_there"), F.col("to")).alias("to"), F.when(F.col("to").isNull(), "whole").when(F.col("_there").isNull(), "gap").alias("state"),
    )
    rows = start.select("id", F.coalesce("to", "id").alias("at"), F.col("to").isNotNull().cast("long").alias("steps"), F.least("id", F.coalesce("to", "id")).alias("low"), "state")
    rows = written(rows, "walk")
    done = rows.where("state IS NOT NULL")
    going, looked, most = rows.where("state IS NULL"), 1, rows.count()
    while (n := going.count()) and looked <= most:
        # a row that looks at one that has arrived arrives; else it looks as much further as that one does
        ends = done.select(F.col("id").alias("at"), F.col("at").alias("_end"), F.col("steps").alias("_more"), F.col("state").alias("_state"), F.lit(None).cast("string").alias("_low"))
        others = going.select(F.col("id").alias("at"), F.col("at").alias("_end"), F.col("steps").alias("_more"), F.col("state").alias("_state"), F.col("low").alias("_low"))
        step = going.join(ends.unionByName(others), "at").select("id", F.col("_end").alias("at"), (F.col("steps") + F.col("_more")).alias("steps"), F.least("low", F.coalesce("_low", "low")).alias("low"), F.col("_state").alias("state"))
        step = written(step, "walk")
        done, going, looked = done.unionByName(step.where("state IS NOT NULL")), step.where("state IS NULL"), looked * 2
    none = F.lit(None).cast("long")
    # what is left has gone round at least once: where it is now lies in the circle, and so does all that was seen from there
    circle = going.select(F.col("id").alias("at"), F.col("low").alias("chain"))
    round_ = going.select("id", "at").join(circle, "at").select("id", "chain", none.alias("steps"), F.lit("cycle").alias("state"))
    return done.select("id", F.col("at").alias("chain"), "steps", "state").unionByName(round_)


def duplicate_current(facts: DataFrame) -> DataFrame:
    """How many (tenant, subject, predicate, object) hold more than one current fact; should be 0."""
    keys = [F.col("tenant"), F.lower("subject").alias("s"), F.col("predicate"), F.lower("object").alias("o")]
    found = facts.where("valid_until IS NULL").groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return found.agg(F.count("*").alias("duplicates"))


def totals(facts: DataFrame) -> DataFrame:
    """One row: current_facts, past_facts and duplicates (see duplicate_current), from one grouping."""
    open_ = F.count_if(F.col("valid_until").isNull())
    by = facts.groupBy("tenant", F.lower("subject").alias("s"), "predicate", F.lower("object").alias("o")).agg(open_.alias("n"), F.count("valid_until").alias("past"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("current_facts"), F.coalesce(F.sum("past"), F.lit(0)).alias("past_facts"), F.count_if(F.col("n") > 1).alias("duplicates"))


def forget(facts: DataFrame, tenant: str, subject: str, predicate: str, object_: str) -> DataFrame:
    """The current fact that a retraction would close or, if there is none, the subject's current facts."""
    own = current(facts, tenant, subject)
    hit = (F.col("predicate") == predicate) & (F.lower("object") == object_.lower())
    ranked = own.withColumn("hit", hit).withColumn("any_hit", F.max("hit").over(Window.partitionBy("tenant")))
    return ranked.where(F.col("hit") | ~F.col("any_hit")).drop("any_hit")


def search(facts: DataFrame, vectors: DataFrame, query: Sequence[float], tenant: str, settings: Settings, k: int = 10) -> DataFrame:
    """The k current facts of a tenant nearest to the query, among the overfetched nearest of all facts."""
    checked("-", k)
    found = nearest(vectors, query, k * settings.fact_overfetch)
    return current(facts, tenant).join(F.broadcast(found), "id").orderBy(F.desc("similarity"), "id").limit(k)


# -- names ------------------------------------------------------------------------------------------


def resolve_names(names: DataFrame, entities: DataFrame, name_col: str = "name") -> DataFrame:
    """names with canonical: the entity of that name, else one with that alias, else the name itself.

    Compared without case and outer spaces; of several entities the smallest name. Blank names stay.
    """
    own = entities.select("tenant", F.lower("canonical_name").alias("_key"), "canonical_name", F.lit(0).alias("_rank"))
    other = entities.select("tenant", F.explode("aliases").alias("_key"), "canonical_name").select("tenant", F.lower("_key").alias("_key"), "canonical_name", F.lit(1).alias("_rank"))
    best = own.union(other).groupBy("tenant", "_key").agg(F.min(F.struct("_rank", "canonical_name")).alias("_best"))
    keyed = names.withColumn("_key", F.lower(F.trim(name_col)))
    joined = keyed.join(best.where("_key <> ''"), ["tenant", "_key"], "left")
    return joined.withColumn("canonical", F.coalesce(F.col("_best.canonical_name"), F.col(name_col))).drop("_key", "_best")


def alias_history(mentions: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """(tenant, key, since): what a name without case stood for from which row of the log on; since is an array of (seq,
    canonical), of which the last that isn't later holds.

    mentions: tenant, name, aliases, seq (that of the first row of the log that the mention goes before, or of the row
    itself). entities: those known before all mentions, as upsert_entities gives them. An entity's name goes before
    others' aliases; of several the smallest. What a name stands for only changes when a better entity comes, so since
    stays short; only such changes are kept, found in salted parts first, so that an alias of very many entities is dealt
    over many tasks.
    """
    first = F.lit(-(1 << 63)).cast("long")
    said = mentions.select("tenant", F.lower("name").alias("_entity"), F.col("name").alias("_name"), F.col("seq").cast("long").alias("seq"), "aliases")
    if entities is not None:
        said = said.unionByName(entities.select("tenant", F.lower("canonical_name").alias("_entity"), F.col("canonical_name").alias("_name"), first.alias("seq"), "aliases"))
    names = said.groupBy("tenant", "_entity").agg(F.min_by("_name", F.struct("seq", "_name")).alias("canonical"), F.min("seq").alias("seq"))
    other = said.select("tenant", "_entity", "seq", F.explode("aliases").alias("_alias")).groupBy("tenant", "_entity", F.lower("_alias").alias("key")).agg(F.min("seq").alias("seq"))
    other = other.join(names.select("tenant", "_entity", "canonical"), ["tenant", "_entity"])
    every = names.select("tenant", F.col("_entity").alias("key"), "seq", F.struct(F.lit(0).alias("rank"), "canonical").alias("best"))
    every = every.unionByName(other.select("tenant", "key", "seq", F.struct(F.lit(1).alias("rank"), "canonical").alias("best"))).where("key <> ''")

    def records(rows: DataFrame, *more: str) -> DataFrame:
        """Rows that are better than all rows before them."""
        w = Window.partitionBy("tenant", "key", *more).orderBy("seq", "best")
        before = F.min("best").over(w.rowsBetween(Window.unboundedPreceding, -1))
        return rows.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("best") < F.col("_before"))).drop("_before")

    salted = every.withColumn("_salt", F.pmod(F.xxhash64("best", "seq"), F.lit(64)))
    kept = records(records(salted, "_salt").drop("_salt"))
    return kept.groupBy("tenant", "key").agg(F.array_sort(F.collect_list(F.struct("seq", "best.canonical"))).alias("since"))


def resolve_log(log: DataFrame, aliases: DataFrame) -> DataFrame:
    """The log with each row's subject and object as they were called when it came in: aliases that turn up later don't
    rewrite it. aliases: see alias_history. Blank names stay."""
    for column in ("subject", "object"):
        keyed = log.withColumn("key", F.lower(F.trim(column)))
        held = F.filter("since", lambda c: c["seq"] <= F.col("seq"))
        found = keyed.join(aliases, ["tenant", "key"], "left").withColumn(column, F.coalesce(F.when(F.size(held) > 0, F.element_at(held, -1)["canonical"]), F.col(column)))
        log = found.drop("key", "since")
    return log.select("tenant", "seq", "ts", "op", "subject", "predicate", "object", "confidence", "source")


def upsert_entities(mentions: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Entities from mentions (tenant, name, entity_type, aliases, ts, seq), going on from those known before.

    The first spelling of a name stays; its type is the first that isn't null; aliases add up without case,
    the first spelling of each, in order, without the name itself. Batch by batch gives what the whole log gives; only
    entities that a batch mentions are worked on, and no array is longer than an entity's distinct aliases.
    """
    key = ["tenant", "_key"]
    new = mentions.select("tenant", F.lower("name").alias("_key"), F.lit(1).alias("_gen"), "seq", "name", "entity_type", "aliases", "ts", F.col("ts").alias("_until"), F.lit(1).cast("long").alias("_n"))
    rest = None
    if entities is not None:
        known = entities.withColumn("_key", F.lower("canonical_name"))
        touched = new.select(*key).distinct()
        rest = known.join(touched, key, "left_anti").drop("_key")
        old = known.join(touched, key, "left_semi")
        new = new.unionByName(old.select("tenant", "_key", F.lit(0).alias("_gen"), F.lit(0).cast("long").alias("seq"), F.col("canonical_name").alias("name"), "entity_type", "aliases", F.col("first_seen").alias("ts"), F.col("last_seen").alias("_until"), F.col("episode_count").alias("_n")))
    at = F.struct("_gen", "seq")
    by = new.groupBy(*key).agg(
        F.min_by("name", at).alias("canonical_name"), F.min_by("entity_type", F.when(F.col("entity_type").isNotNull(), at)).alias("entity_type"),
        F.min("ts").alias("first_seen"), F.max("_until").alias("last_seen"), F.sum("_n").alias("episode_count"),
    )
    said = new.select(*key, "_gen", "seq", F.posexplode("aliases").alias("pos", "alias")).where(F.lower("alias") != F.col("_key"))
    first = said.groupBy(*key, F.lower("alias").alias("_alias")).agg(F.min(F.struct("_gen", "seq", "pos", "alias")).alias("a"))
    listed = first.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list("a")), lambda a: a["alias"]).alias("aliases"))
    empty = F.array().cast("array<string>")
    found = by.join(listed, key, "left").withColumn("aliases", F.coalesce("aliases", empty)).drop("_key")
    return found if rest is None else found.unionByName(rest.select(*found.columns))
