"""Vector and hash-code expressions.

A hash code has 256 bits, held as eight longs of 32 bits each, so that distances are bit counts of the JVM.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .text import time_bucket, tokenize

CONTENT_BITS, WORDS, TIME_WORD = 224, 8, 7


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if a vector has no length or lengths differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((norm > 0) & (F.size(a) == F.size(b)), dot(a, b) / norm)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def code_similarity(a: Column, b: Column) -> Column:
    return F.lit(1.0) - hamming(a, b) / F.lit(256.0)


def _hex_long(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("long")


def _word(places: Column, w: int) -> Column:
    """The bits of one 32-bit word."""
    own = F.filter(places, lambda p: F.floor(p / 32) == w)
    return F.aggregate(own, F.lit(0).cast("long"), lambda s, p: s + F.pow(F.lit(2.0), F.pmod(p, F.lit(32))).cast("long"))


def sparse_code(text: Column, ms: Column) -> Column:
    """Bits for the tokens (an md5 prefix of each) in seven words, and the time bucket in the eighth."""
    places = F.transform(tokenize(text), lambda t: F.pmod(_hex_long(F.substring(F.md5(t.cast("binary")), 1, 4)), F.lit(CONTENT_BITS)))
    # bound once: the text is cut into tokens a single time for all words
    held = F.transform(F.array(F.array_distinct(places)), lambda p: F.array(*(_word(p, w) for w in range(TIME_WORD))))[0]
    return F.concat(held, F.array(_hex_long(F.substring(F.md5(time_bucket(ms).cast("binary")), 1, 8))))


@pandas_udf(T.ArrayType(T.LongType()))
def _blake_code(tokens: pd.Series, seeds: pd.Series) -> pd.Series:
    def code(words, seed: str) -> list[int]:
        bits = 0
        for word in words:
            bits |= 1 << int.from_bytes(hashlib.blake2b(word.encode(), digest_size=2).digest(), "little") % CONTENT_BITS
        bits |= int.from_bytes(hashlib.blake2b(seed.encode(), digest_size=4).digest(), "little") << CONTENT_BITS
        return [bits >> 32 * k & 0xFFFFFFFF for k in range(WORDS)]

    return pd.Series([None if t is None or s is None else code(t, s) for t, s in zip(tokens, seeds, strict=True)])


def sparse_code_blake(text: Column, ms: Column) -> Column:
    """The same with BLAKE2b, which SQL doesn't have: two bytes a token and four for the time bucket."""
    return _blake_code(tokenize(text), time_bucket(ms))


def recency(ms: Column, now_ms: int, half_life_days: float) -> Column:
    """1 for now and later, half of it every half_life_days before."""
    age = F.greatest(F.lit(0.0), (F.lit(now_ms) - ms) / F.lit(86_400_000.0))
    return F.pow(F.lit(2.0), -age / F.lit(half_life_days))
