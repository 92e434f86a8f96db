"""Vectors: normalisation and exact cosine search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalise(v: Column) -> Column:
    n = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / n)


def cosine_distance(v: Column, query: Sequence[float]) -> Column:
    """1 - cosine against a vector that the driver holds."""
    length = max(sum(x * x for x in query) ** 0.5, 1e-12)
    q = F.array(*(F.lit(float(x) / length) for x in query))
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
    return 1 - dot / F.greatest(norm(v), F.lit(1e-12))


def nearest(vectors: DataFrame, query: Sequence[float], limit: int, id_col: str = "chunk_id") -> DataFrame:
    """The `limit` nearest vectors with sem_rank from 1; every vector is compared, none is shuffled."""
    d = vectors.select(id_col, F.round(cosine_distance(F.col("embedding"), query), 9).alias("distance"))
    best = d.orderBy("distance", id_col).limit(limit)
    return best.withColumn("sem_rank", F.row_number().over(Window.orderBy("distance", id_col)))


def similarity(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance))


def first_copies(vectors: DataFrame, order: str, id_col: str = "chunk_id") -> DataFrame:
    """One vector an id: the first by `order`."""
    rest = [c for c in vectors.columns if c != id_col]
    return vectors.groupBy(id_col).agg(F.min_by(F.struct(*rest), order).alias("_v")).select(id_col, "_v.*")
