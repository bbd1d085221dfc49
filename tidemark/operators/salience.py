"""Salience: parsing and combining model scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCORES = ("surprise", "arousal", "self_ref", "recurrence")
_RAW = "surprise string, arousal string, self_ref string, recurrence string"


def combine(surprise: Column, arousal: Column, self_ref: Column, recurrence: Column) -> Column:
    """A weighted sum, and at least self_ref."""
    return F.greatest(0.4 * surprise + 0.3 * self_ref + 0.2 * arousal + 0.1 * recurrence, self_ref)


def clamp(x: Column) -> Column:
    """Into 0..1; NaN becomes 0."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.nanvl(x, F.lit(0.0))))


def parse(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """rows with the four scores and salience from model output in JSON.

    Any missing or unreadable number makes all of them 0.5; others are clamped.
    """
    data = F.from_json(F.col(raw), _RAW)
    read = {k: F.expr(f"try_cast(_data.{k} AS double)") for k in SCORES}
    rows = rows.withColumn("_data", data).withColumns({f"_{k}": v for k, v in read.items()})
    good = F.lit(True)
    for k in SCORES:
        good = good & F.col(f"_{k}").isNotNull()
    rows = rows.withColumns({k: F.when(good, clamp(F.col(f"_{k}"))).otherwise(F.lit(0.5)) for k in SCORES})
    return rows.withColumn("salience", F.when(good, combine(*map(F.col, SCORES))).otherwise(F.lit(0.5))).drop("_data", *(f"_{k}" for k in SCORES))
