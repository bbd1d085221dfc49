"""Validation of extracted facts and entities, and mapping of predicates onto the closed vocabulary."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..config import ENTITY_TYPES, FALLBACK, FUNCTIONAL, MULTI, Settings

VOCABULARY = (*FUNCTIONAL, *MULTI)
_RAW = "facts array<struct<subject: string, predicate: string, object: string, confidence: string>>, entities array<struct<name: string, entity_type: string, aliases: array<string>>>"


def raw_facts(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Valid facts of model output in JSON: the other columns of rows, position, subject, predicate (raw),
    object and confidence.

    Names are trimmed; a fact without subject, predicate or object goes, as does one whose confidence (1 if
    missing) isn't a number from 0 to 1. Output that isn't JSON, or whose facts aren't a list, gives nothing.
    """
    others = [c for c in rows.columns if c != raw]
    each = rows.select(*others, F.posexplode(F.from_json(F.col(raw), _RAW)["facts"]).alias("position", "_f"))
    each = each.select(
        *others, "position", F.trim("_f.subject").alias("subject"), F.col("_f.predicate").alias("predicate"), F.trim("_f.object").alias("object"),
        F.when(F.col("_f.confidence").isNull(), 1.0).otherwise(F.expr("try_cast(_f.confidence AS double)")).alias("confidence"),
    )
    return each.where("subject <> '' AND object <> '' AND predicate IS NOT NULL AND confidence BETWEEN 0 AND 1")


def raw_entities(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Valid entities of model output: the other columns of rows, position, name, entity_type, aliases.

    Unknown types become null; blank aliases go; aliases that aren't a list become none.
    """
    others = [c for c in rows.columns if c != raw]
    each = rows.select(*others, F.posexplode(F.from_json(F.col(raw), _RAW)["entities"]).alias("position", "_e"))
    kind = F.lower(F.trim("_e.entity_type"))
    aliases = F.filter(F.transform(F.coalesce("_e.aliases", F.array().cast("array<string>")), lambda a: F.trim(a)), lambda a: a != "")
    each = each.select(*others, "position", F.trim("_e.name").alias("name"), F.when(kind.isin(*ENTITY_TYPES), kind).alias("entity_type"), aliases.alias("aliases"))
    return each.where("name <> ''")


def exact_predicate(predicate: Column) -> Column:
    """The predicate of the vocabulary that it is, apart from case and outer spaces; else null."""
    plain = F.lower(F.trim(predicate))
    return F.when(plain.isin(*VOCABULARY), plain)


def _closest(cutoff: float):
    @pandas_udf("string")
    def closest(names: pd.Series) -> pd.Series:
        return names.map(lambda n: next(iter(difflib.get_close_matches(n, VOCABULARY, n=1, cutoff=cutoff)), None), na_action="ignore")

    return closest


def map_predicates(facts: DataFrame, settings: Settings | None = None) -> DataFrame:
    """facts with predicate from the vocabulary, and mapped: exact, near or fallback.

    A near predicate is the closest by matching blocks. The fallback keeps the raw predicate before the
    object. Closeness is worked out once for each distinct raw predicate.
    """
    settings = settings or Settings()
    plain = F.lower(F.trim("predicate"))
    facts = facts.withColumn("_raw", plain)
    odd = facts.where(~plain.isin(*VOCABULARY)).select("_raw").distinct().withColumn("_near", _closest(settings.fuzzy_cutoff)("_raw"))
    joined = facts.join(odd, "_raw", "left")
    exact, near = F.col("_raw").isin(*VOCABULARY), F.col("_near").isNotNull()
    return joined.withColumns({
        "predicate": F.when(exact, F.col("_raw")).when(near, F.col("_near")).otherwise(FALLBACK),
        "object": F.when(exact | near, F.col("object")).otherwise(F.concat("_raw", F.lit(": "), "object")),
        "mapped": F.when(exact, "exact").when(near, "near").otherwise("fallback"),
    }).drop("_raw", "_near")
