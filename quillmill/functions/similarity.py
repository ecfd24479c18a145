"""Similarity of sets, strings and vectors, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct members; 0 where both are empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def edit_similarity(a: Column, b: Column) -> Column:
    """One less the edit distance over the longer length; 0 where either is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the shorter of two vectors."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter dimension, clamped to [0, 1]; 0 for a zero vector; null for a null (failed) one."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm == 0, 0.0).when(norm.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(x, y) / F.nullif(norm, F.lit(0.0)))))


def fitted(vector: Column, dimension: int) -> Column:
    """Cut or padded with zeros to a dimension; a vector that starts with the failure mark becomes null."""
    padded = F.slice(F.concat(vector.cast("array<double>"), F.array_repeat(F.lit(0.0), dimension)), 1, dimension)
    return F.when(F.get(vector, F.lit(0)) == -99999, F.lit(None)).otherwise(padded)
