"""The memory graph of a tenant: entities, facts around its subject with their history, and memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ENTITY_LABELS, LINK_FAMILIES, PREDICATE_LABELS, Settings, canonical_subject
from ..functions.text import day_label, month_label, percent, truncate
from .facts import chains

OBJECT_LABEL, MEMORY_LABEL = 48, 90


def _mapped(column: Column, table: dict[str, str], default: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[column], default)


def _around(facts: DataFrame, entities: DataFrame, tenant: str, settings: Settings) -> DataFrame:
    """Current facts about the tenant's subject, with the node that their object is."""
    root = canonical_subject(tenant, settings)
    known = entities.where(F.col("tenant") == tenant).groupBy(F.lower("canonical_name").alias("_key")).agg(F.min("canonical_name").alias("known"))
    own = facts.where((F.col("tenant") == tenant) & F.col("valid_until").isNull() & (F.lower("subject") == root.lower()))
    own = own.withColumn("_key", F.lower("object")).join(known, "_key", "left")
    return own.withColumns({"object_id": F.coalesce("known", F.concat(F.lit("c:"), "_key")), "family": _mapped(F.col("predicate"), LINK_FAMILIES, F.lit("projet"))})


def edges(facts: DataFrame, entities: DataFrame, tenant: str, settings: Settings) -> DataFrame:
    return _around(facts, entities, tenant, settings).select(
        F.concat(F.lit("f:"), "id").alias("id"), _mapped(F.col("predicate"), PREDICATE_LABELS, F.col("predicate")).alias("predicate"), "object_id",
        F.col("family").alias("type"), month_label(F.col("valid_from")).alias("since"), F.concat(F.lit("confiance "), percent(F.col("confidence"))).alias("detail"),
    )


def edge_history(facts: DataFrame, entities: DataFrame, tenant: str, settings: Settings) -> DataFrame:
    """The versions before each current fact around the subject, newest first (steps from 1)."""
    own = _around(facts, entities, tenant, settings).select(F.col("id").alias("chain"), "object_id")
    known = entities.where(F.col("tenant") == tenant).groupBy(F.lower("canonical_name").alias("_key")).agg(F.min("canonical_name").alias("entity"))
    past = chains(facts.where(F.col("tenant") == tenant)).where("steps > 0").join(own, "chain")
    past = past.withColumn("_key", F.lower("object")).join(known, "_key", "left")
    return past.select(
        F.concat(F.lit("f:"), "chain").alias("fact_id"), "object_id", "steps", truncate(F.col("object"), OBJECT_LABEL).alias("value"), "entity",
        month_label(F.col("valid_from")).alias("from_month"), month_label(F.coalesce("valid_until", "valid_from")).alias("to_month"), "valid_from",
    )


def ghosts(facts: DataFrame, entities: DataFrame, tenant: str, settings: Settings) -> DataFrame:
    """(entity, tether): entities that were objects of earlier versions and of no current fact, tied to the
    node that came after; of several the latest."""
    past = edge_history(facts, entities, tenant, settings).where("entity IS NOT NULL")
    held = facts.where((F.col("tenant") == tenant) & F.col("valid_until").isNull()).select(F.lower("object").alias("_key")).distinct()
    gone = past.withColumn("_key", F.lower("entity")).join(held, "_key", "left_anti")
    return gone.groupBy("entity").agg(F.max_by("object_id", F.struct("valid_from", "fact_id")).alias("tether"))


def nodes(facts: DataFrame, entities: DataFrame, tenant: str, settings: Settings) -> DataFrame:
    """All entities of the tenant and a concept for each other object: id, type, label, mentions, expired, tether."""
    own = entities.where(F.col("tenant") == tenant).select(
        F.col("canonical_name").alias("id"), _mapped(F.coalesce("entity_type", F.lit("")), ENTITY_LABELS, F.lit("projet")).alias("type"),
        F.col("canonical_name").alias("label"), F.greatest(F.lit(1).cast("long"), F.col("episode_count")).alias("mentions"),
    )
    tied = ghosts(facts, entities, tenant, settings).withColumnRenamed("entity", "id")
    own = own.join(tied, "id", "left").withColumn("expired", F.col("tether").isNotNull())
    return own.unionByName(concepts(facts, entities, tenant, settings), allowMissingColumns=True)


def concepts(facts: DataFrame, entities: DataFrame, tenant: str, settings: Settings) -> DataFrame:
    kind = F.when(F.col("family") == "localisation", "lieu").when(F.col("family") == "emploi", "organisation").otherwise("projet")
    loose = _around(facts, entities, tenant, settings).where("known IS NULL").withColumn("type", kind)
    first = loose.groupBy("object_id").agg(F.min_by(F.struct("type", "object"), "seq").alias("f"))
    return first.select(F.col("object_id").alias("id"), F.col("f.type").alias("type"), truncate(F.col("f.object"), OBJECT_LABEL).alias("label"), F.lit(1).cast("long").alias("mentions"))


def memories(episodes: DataFrame, entities: DataFrame, tenant: str, settings: Settings) -> DataFrame:
    """The newest episodes, each anchored to the first entity that it refers to."""
    newest = episodes.where((F.col("tenant") == tenant) & ~F.col("archived")).orderBy(F.desc("created_at"), F.desc("id")).limit(settings.graph_episodes)
    known = entities.where(F.col("tenant") == tenant).groupBy(F.lower("canonical_name").alias("_key")).agg(F.min("canonical_name").alias("known"))
    refs = newest.select("id", F.posexplode("entity_refs").alias("pos", "ref")).withColumn("_key", F.lower("ref")).join(known, "_key")
    anchors = refs.groupBy("id").agg(F.min_by("known", "pos").alias("anchor"))
    return newest.join(anchors, "id", "left").select(
        F.concat(F.lit("m:"), "id").alias("id"), truncate(F.col("content"), MEMORY_LABEL).alias("label"), day_label(F.col("created_at")).alias("date"),
        F.round("decay_state", 3).alias("freshness"), F.round("salience", 3).alias("importance"), "anchor",
    )
