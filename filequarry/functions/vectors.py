"""Similarity of vectors and of perceptual hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_NORM = 1e-8


def dot(a: Column, b: Column) -> Column:
    """The inner product in double precision; null if the lengths differ."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 for a zero vector, null for null vectors and for unequal lengths."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(LEAST_NORM)) * F.greatest(norm_b if norm_b is not None else norm(b), F.lit(LEAST_NORM)))


def hash_bits(phash: Column) -> Column:
    """The 64 bits of an 8-byte hash as a bigint; null for other lengths."""
    return F.when(F.octet_length(phash) == 8, F.conv(F.hex(phash), 16, -10).cast("bigint"))


def hamming(a: Column, b: Column) -> Column:
    """How many bits two 64-bit hashes differ in."""
    return F.bit_count(a.bitwiseXOR(b))


def sign_bits(vector: Column) -> Column:
    """The signs of a vector's first 64 entries as bits of a bigint, the first entry highest; null entries count as negative."""
    return F.aggregate(F.slice(vector, 1, 64), F.lit(0).cast("bigint"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.when(x > 0, 1).otherwise(0).cast("bigint")))
