"""Vector and score expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING_RANK, RRF_K = 1000, 60


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unit(vectors: pd.Series) -> pd.Series:
    """Vectors of length 1; null for those that are null or zero."""

    def one(x):
        n = 0.0 if x is None else float(np.linalg.norm(np.asarray(x, np.float64)))
        return np.asarray(x, np.float64) / n if n > 0 else None

    return vectors.map(one)


def cosine_distance(units: Column, query: list[float]) -> Column:
    """1 - cosine of unit vectors with a query, by one matrix product a batch; null where a vector is null or of another length, or the query is zero."""
    q = np.asarray(query, np.float64)
    n = float(np.linalg.norm(q))

    @F.pandas_udf(T.DoubleType())
    def distance(own: pd.Series) -> pd.Series:
        there = own.map(lambda x: x is not None and len(x) == len(q) and n > 0).to_numpy(bool)
        out = np.full(len(own), np.nan)
        if there.any():
            out[there] = 1 - np.stack(own[there]).astype(np.float64) @ (q / n)
        return pd.Series(out)

    return distance(units)


def rrf(*ranks: Column) -> Column:
    """Reciprocal rank fusion: a leg that lacks the row counts as rank 1000."""
    out = F.lit(0.0)
    for r in ranks:
        out = out + F.lit(1.0) / (F.lit(float(RRF_K)) + F.coalesce(r, F.lit(MISSING_RANK)).cast("double"))
    return out
