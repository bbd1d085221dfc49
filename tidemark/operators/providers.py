"""Model calls behind replaceable providers.

A provider is a pure function of its input, so results replay. The local ones stand in for a model: an
embedding from a digest, scores and extractions from what a text says plainly.
"""

from __future__ import annotations

import hashlib
import json
import re
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


class Provider(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def score(self, text: str, history: list[str]) -> str: ...

    def extract(self, text: str, subject: str) -> str: ...


class Local:
    """A deterministic provider without a model."""

    dims = 64
    _says = re.compile(r"\b(\w+) (works_at|lives_in|prefers|dislikes|owns|is_a|knows_about|has_goal|has_skill) ([\w ]+)")

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[b / 255 - 0.5 for b in hashlib.blake2b(t.encode(), digest_size=self.dims).digest()] for t in texts]

    def score(self, text: str, history: list[str]) -> str:
        digest = hashlib.blake2b(text.encode(), digest_size=3).digest()
        seen = sum(text == h for h in history) / max(1, len(history))
        return json.dumps({"surprise": digest[0] / 255, "arousal": digest[1] / 255, "self_ref": digest[2] / 255, "recurrence": seen})

    def extract(self, text: str, subject: str) -> str:
        facts = [{"subject": s if s != "I" else subject, "predicate": p, "object": o.strip(), "confidence": 0.9} for s, p, o in self._says.findall(text)]
        entities = [{"name": f["object"], "entity_type": "concept", "aliases": []} for f in facts]
        return json.dumps({"facts": facts, "entities": entities})


class Plain(Local):
    """A local provider whose output SQL can follow: scores from an md5 digest, and facts from "I <predicate> <object>."."""

    _says = re.compile(r"^(I) (works_at|lives_in|prefers|owns) ([\w ]+)\.$")

    def score(self, text: str, history: list[str]) -> str:
        digest = hashlib.md5(text.encode()).digest()
        return json.dumps({name: digest[k] / 256 for k, name in enumerate(("surprise", "arousal", "self_ref"))} | {"recurrence": min(1.0, len(history) / 8)})


def text_digest(text: Column) -> Column:
    """128 bits of a text in hexadecimal digits, by which its vector is kept."""
    return F.substring(F.sha2(text, 256), 1, 32)


def embedded(rows: DataFrame, text: str, provider: Provider, known: DataFrame | None = None) -> DataFrame:
    """rows with vector (32-bit floats); each distinct text is embedded once, and none that known has already.

    known: (digest, vector) of earlier texts, digest as text_digest makes it.
    """

    @pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(provider.embed(texts.tolist()))

    keyed = rows.withColumn("_digest", text_digest(F.col(text)))
    once = keyed.where(F.col(text).isNotNull()).groupBy("_digest").agg(F.first(text).alias("_t"))
    if known is not None:
        once = once.join(known.select(F.col("digest").alias("_digest")), "_digest", "left_anti")
    fresh = once.select("_digest", embed("_t").alias("vector"))
    if known is not None:
        fresh = fresh.unionByName(known.select(F.col("digest").alias("_digest"), F.col("vector").cast("array<float>").alias("vector")))
    return keyed.join(fresh, "_digest", "left").drop("_digest")


def scored_text(text: Column, history: Column, provider: Provider) -> Column:
    @pandas_udf("string")
    def score(texts: pd.Series, before: pd.Series) -> pd.Series:
        return pd.Series([provider.score(t or "", [] if h is None else list(h)) for t, h in zip(texts, before, strict=True)])

    return score(text, history)


def extracted_text(text: Column, subject: Column, provider: Provider, attempts: int = 2) -> Column:
    """Raw output, or null after so many failures."""

    @pandas_udf("string")
    def extract(texts: pd.Series, subjects: pd.Series) -> pd.Series:
        def tried(t: str, s: str) -> str | None:
            for _ in range(attempts):
                try:
                    json.loads(raw := provider.extract(t or "", s))
                    return raw
                except ValueError:
                    continue
            return None

        return pd.Series([tried(t, s) for t, s in zip(texts, subjects, strict=True)])

    return extract(text, subject)
