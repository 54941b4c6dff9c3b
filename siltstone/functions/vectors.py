"""Vector arithmetic on arrays, inside the JVM; for all pairs use the blocked operators of siltstone.operators.retrieval."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, vectors of different lengths and null vectors."""
    size = norm(a) * norm(b)
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (size > 0)
    return F.when(usable, dot(a, b) / size).otherwise(0.0)


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def mean_vector(tokens: Column) -> Column:
    """Mean of an array of vectors, of the length of the first; empty for none."""
    length = F.size(F.element_at(tokens, 1))
    zero = F.array_repeat(F.lit(0.0), length)
    total = F.aggregate(tokens, zero, lambda acc, t: F.zip_with(acc, t, lambda x, y: x + y.cast("double")))
    return F.when(F.size(tokens) > 0, F.transform(total, lambda x: x / F.size(tokens))).otherwise(F.expr("cast(array() as array<double>)"))


def max_sim(query_tokens: Column, doc_tokens: Column) -> Column:
    """Sum over the query's vectors of the best cosine with any of the document's; minus infinity without document vectors."""
    best = F.transform(query_tokens, lambda q: F.array_max(F.transform(doc_tokens, lambda d: cosine(q, d))))
    return F.when(F.size(doc_tokens) > 0, _sum(best)).otherwise(F.lit(float("-inf")))
