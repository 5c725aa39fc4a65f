"""Hashes that must equal other systems' bit for bit, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of 32-bit FNV-1a, and of the sampling hash.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
SAMPLE_FACTOR = 31
SAMPLE_RANGE = 1000


def utf8_bytes(text: Column) -> Column:
    """array<bigint> of the UTF-8 bytes."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), 1)
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("bigint"))


def fnv1a32(text: Column) -> Column:
    return F.aggregate(
        utf8_bytes(text),
        F.lit(FNV_OFFSET).cast("bigint"),
        lambda h, x: (h.bitwiseXOR(x) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(4294967295)),
    )


def crc32_text(text: Column) -> Column:
    return F.crc32(F.encode(text, "UTF-8"))


def sample_bucket(text: Column) -> Column:
    """0 to 999: a 31-fold over the code points, modulo 1000."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("bigint"), lambda h, c: (h * SAMPLE_FACTOR + F.ascii(c)) % SAMPLE_RANGE)


def sampled(text: Column, rate: float) -> Column:
    return sample_bucket(text) < F.lit(rate * SAMPLE_RANGE)
