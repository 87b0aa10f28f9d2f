"""Whitening of vectors by hierarchical merging of singular value decompositions.

Every task reduces its rows to a summary: how many there are, exact sums, and all singular values and right singular vectors of the
centred rows. Two summaries merge into that of both: their weighted axes, one above the other, with one row more that corrects for the difference of the
means, are decomposed again. Nothing is cut off, so the summary of all rows has the covariance of all rows as if they
had been centred and decomposed at once. FAN summaries meet in a task, level by level, until one is left.

Entries become integers, floor(SCALE * c). Centring uses their exact sums. A number added to all entries changes nothing here, so none is: it would only cost digits.

Rows of the vectors are read three times (fit, check, result) and are never shuffled; summaries are, of dimension * dimension numbers each. One of
them reaches the driver, and through it the tasks.

Defined cases: rows without a vector, and vectors with null or non-finite entries, are left out, as are entries so large that their integer has no exact
double (64 |c| of 2**52 or more). Vectors must have the commonest length of the table (the longer of equally common ones); others are left out, as are empty ones. Repeated rows and ids
are rows like any other, null ids too. Components whose eigenvalue is zero to double precision do not exist and give no row: equal vectors, or a single
one, give none at all. An empty table gives an empty result. Other columns of any name travel along with :func:`whitened`, which adds two of names that it is told. A deviation that no long can hold is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shipped, written

SCALE, COMPONENTS = 64, 32
#: A singular value of this share of the largest one, or less, is zero.
ZERO = 1e-12
#: Summaries that a task merges.
FAN = 8
#: Rows are decomposed in blocks of about this many numbers, and of at least as many rows as there are dimensions.
BLOCK = 1 << 20

SUMMARY = "part long, n long, sums array<string>, mean array<double>, singular array<double>, axes binary"


@dataclass
class Summary:
    """n rows, their exact sums (none for rows that are not of integers), mean, all singular values, and an axis (row of ``axes``) for each."""

    n: int
    sums: list[int]
    mean: np.ndarray
    singular: np.ndarray
    axes: np.ndarray

    def row(self, part: int) -> tuple:
        return part, self.n, [str(x) for x in self.sums], self.mean.tolist(), self.singular.tolist(), self.axes.tobytes()

    @staticmethod
    def of(row) -> Summary:
        mean, singular = np.array(row.mean, float), np.array(row.singular, float)
        return Summary(int(row.n), [int(x) for x in row.sums], mean, singular, np.frombuffer(row.axes, float).reshape(len(singular), len(mean)))


def _decomposed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, singular, axes = np.linalg.svd(rows, full_matrices=False)
    return singular, axes


def summary_of(rows: np.ndarray) -> Summary:
    """Of a block of rows; integers are summed exactly."""
    if rows.dtype.kind == "i":
        small = np.abs(rows).max(initial=0) <= (1 << 62) // len(rows)
        sums = [int(x) for x in rows.sum(axis=0)] if small else [sum(map(int, c)) for c in rows.T]
        mean = np.array([x / len(rows) for x in sums])
    else:
        sums, mean = [], rows.mean(axis=0)
    return Summary(len(rows), sums, mean, *_decomposed(rows - mean))


def merged(a: Summary, b: Summary) -> Summary:
    n = a.n + b.n
    if a.sums:
        apart = np.array([(x * b.n - y * a.n) / (a.n * b.n) for x, y in zip(a.sums, b.sums)])
        sums = [x + y for x, y in zip(a.sums, b.sums)]
        mean = np.array([x / n for x in sums])
    else:
        apart, sums, mean = a.mean - b.mean, [], a.mean + (b.mean - a.mean) * (b.n / n)
    correction = np.sqrt(a.n * (b.n / n)) * apart
    return Summary(n, sums, mean, *_decomposed(np.vstack([a.singular[:, None] * a.axes, b.singular[:, None] * b.axes, correction])))


def _matrix(column: pa.Array, kind) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), kind)


def _summaries(kind) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        total = None
        for b in batches:
            rows = _matrix(b.column(0), kind)
            step = max(rows.shape[1], BLOCK // max(1, rows.shape[1]))
            for k in range(0, len(rows), step):
                own = summary_of(rows[k : k + step])
                total = own if total is None else merged(total, own)
        if total is not None:
            yield pa.RecordBatch.from_pandas(pd.DataFrame([total.row(TaskContext.get().partitionId())], columns=[x.split()[0] for x in SUMMARY.split(", ")]), preserve_index=False)

    return run


def _merge_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("part")
    total = None
    for row in pdf.itertuples():
        total = Summary.of(row) if total is None else merged(total, Summary.of(row))
    return pd.DataFrame([total.row(int(pdf["part"].iloc[0]) // FAN)], columns=[c for c in pdf.columns if c != "up"])


def summarised(rows: DataFrame, integers: bool) -> Summary | None:
    """The summary of all rows of the one column (arrays of one length, nothing null); None if there is none."""
    level = written(shipped(rows).mapInArrow(_summaries(np.int64 if integers else np.float64), SUMMARY), "summaries")
    while level.count() > 1:
        level = written(level.groupBy((F.col("part") / FAN).cast("long").alias("up")).applyInPandas(_merge_group, SUMMARY), "summaries")
    row = level.first()
    return Summary.of(row) if row else None


@dataclass
class Whitening:
    """n and sums of the fit list; components (rows of ``axes``) by falling eigenvalue, the largest entry of each positive; the trace of the covariance."""

    n: int
    sums: list[int]
    axes: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector takes part."""
    v = F.col(column).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c * SCALE) >= float(1 << 52)))
    own = vectors.filter(F.coalesce(~bad & (F.size(v) > 0), F.lit(False)))
    lengths = own.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return own.filter(F.size(column) == lengths.d) if lengths else own


def _integers(column: str):
    return F.transform(F.col(column).cast("array<double>"), lambda c: F.floor(c * SCALE))


def fit(own: DataFrame, column: str = "embedding") -> Whitening | None:
    """The whitening of the usable rows; None if there are none."""
    total = summarised(own.select(_integers(column).alias("x")), integers=True)
    if total is None:
        return None
    there = total.singular > ZERO * total.singular.max(initial=0.0)
    axes, values = total.axes[there], total.singular**2 / total.n
    largest = axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)] if len(axes) else np.zeros(0)
    return Whitening(total.n, total.sums, axes * np.sign(largest)[:, None], values[there], float(values.sum()))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)**2, exactly."""
    near = [round(s / n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, near)]
    apart = x - np.array(near, np.int64)
    if (np.abs(apart.astype(float)).max(initial=0) * n + n) ** 2 * x.shape[1] < 2.0**62:
        apart = n * apart - np.array(rest, np.int64)
        return (apart * apart).sum(axis=1).tolist()
    out = [sum((n * int(v) - r) ** 2 for v, r in zip(row, rest)) for row in apart]
    return [v if v < 1 << 63 else None for v in out]


def whitened(own: DataFrame, model: Whitening, column: str = "embedding", most: int = COMPONENTS, names: tuple[str, str] = ("deviation", "whitened")) -> DataFrame:
    """The usable rows with their exact deviation from the mean (see :func:`_deviations`) and their whitened vector, of ``most`` components at most."""
    k = min(most, len(model.axes))
    mean = np.array([s / model.n for s in model.sums])
    turn, n, sums = model.axes[:k].T / np.sqrt(model.eigenvalues[:k]), model.n, model.sums

    def run(batches):
        for b in batches:
            x = _matrix(b.column(b.num_columns - 1), np.int64)
            y = (x - mean) @ turn
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(_deviations(x, n, sums), pa.int64()), lists], names=[*b.schema.names[:-1], *names])

    fields = T.StructType(own.schema.fields + [T.StructField(names[0], T.LongType()), T.StructField(names[1], T.ArrayType(T.DoubleType()))])
    return shipped(own).select("*", _integers(column).alias(f"{names[1]}_")).mapInArrow(run, fields)


def identity_error(rows: DataFrame, column: str = "whitened") -> float:
    """Largest absolute entry of the covariance of whitened rows minus the identity."""
    total = summarised(rows.select(column), integers=False)
    weighted = total.singular[:, None] * total.axes
    return float(np.abs(weighted.T @ weighted / total.n - np.eye(len(total.mean))).max(initial=0.0))
