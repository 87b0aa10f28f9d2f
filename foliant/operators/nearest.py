"""A nearest-neighbour index: cells around centroids, codes of what vectors differ from these by, and the vectors themselves by id.

Of a vector the index keeps its cell and, for every SUB dimensions of the rest, the number of the nearest of 256 code words: a byte in place of SUB floats. A search has three steps. The
first reads the codes of the cells nearest to the query, and the exact vectors (:mod:`foliant.sources.points`) of a short list of these: the last of as many as are asked for says how near a neighbour must be.
The second reads the codes of every cell that can hold one, as no vector of a cell is nearer than the cell's radius allows, and keeps each vector that can be so near: what a code loses is known for each. The
third ranks these by their exact vectors. Cells and vectors are left out without loss, so the result is that of a scan of all vectors; equal vectors have equal distances in both. A short list that is longer
moves work from the third step to the first.

Centroids and code words are fitted on a bounded sample (SAMPLE vectors at most, those whose ids have the smallest hashes); every vector is indexed. Cells are partitions of the written table, so
a cell with many vectors has many files. The fitted numbers reach the driver and the tasks: at most MOST_CELLS + 256 vectors.

Vectors that are null, zero or of another length than most of the sample are not indexed; a query of another length finds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.sources.points import MOST_KEYS, read_points, write_points

SAMPLE, MOST_CELLS, ROUNDS = 100_000, 4096, 8
#: Dimensions of a code word, and how many words there are at most.
SUB, WORDS = 2, 256
#: The short list, as a multiple of what is asked for; vectors whose codes the first step reads before it looks for more cells, as a multiple of that list.
SHORT, FIRST = 1.4, 4
#: Candidates that pass through the driver at most, so that the vectors of a few are read by id; more of them are joined where they are found.
LISTED = 100_000
#: What sums in double precision may be off by.
SLACK = 1e-9
HIT = "query_id long, chunk_id string, document_id long, near double, lost double"


def clusters(own: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """k-means."""
    out = own[np.random.default_rng(seed).choice(len(own), k, replace=False)]
    for _ in range(rounds):
        at = closest(own, out)
        sums, n = np.zeros_like(out), np.bincount(at, minlength=k)[:, None]
        np.add.at(sums, at, own)
        out = np.where(n > 0, sums / np.maximum(n, 1), out)
    return out


def closest(own: np.ndarray, centres: np.ndarray, block: int = 4096) -> np.ndarray:
    """For each row the place of the centre next to it."""
    size = (centres**2).sum(axis=1)
    parts = [(size - 2 * own[k : k + block] @ centres.T).argmin(axis=1) for k in range(0, len(own), block)]
    return np.concatenate(parts) if parts else np.zeros(0, int)


@dataclass
class Codes:
    """centres [cells, d]; words: for each group of dimensions [words, SUB or fewer]."""

    centres: np.ndarray
    words: list[np.ndarray]

    @staticmethod
    def fit(sample: np.ndarray, cells: int | None = None) -> Codes:
        k = min(cells or MOST_CELLS, max(1, int(len(sample) ** 0.5)))
        centres = clusters(sample, k)
        rest = sample - centres[closest(sample, centres)]
        words = [clusters(np.ascontiguousarray(rest[:, j : j + SUB]), min(WORDS, max(1, len(sample) // 2))) for j in range(0, sample.shape[1], SUB)]
        return Codes(centres, words)

    def encode(self, own: np.ndarray) -> pd.DataFrame:
        cell = closest(own, self.centres)
        rest = own - self.centres[cell]
        code = np.stack([closest(rest[:, SUB * j : SUB * j + SUB], w) for j, w in enumerate(self.words)], axis=1).astype(np.uint8)
        lost = rest - np.concatenate([w[code[:, j]] for j, w in enumerate(self.words)], axis=1)
        return pd.DataFrame({"cell": cell.astype(np.int32), "code": [x.tobytes() for x in code], "apart": np.linalg.norm(rest, axis=1), "lost": np.linalg.norm(lost, axis=1)})

    def near(self, cell: np.ndarray, code: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Products of the query with the vectors that the codes stand for."""
        out = (self.centres @ query)[cell]
        for j, w in enumerate(self.words):
            out += (w @ query[SUB * j : SUB * j + SUB])[code[:, j]]
        return out


def write_cells(chunks: DataFrame, path: str, cells: int | None = None) -> None:
    """Of (chunk_id, document_id, unit), chunk_id unique: codes by cell, cells, code words, and vectors by id."""
    spark, own = chunks.sparkSession, chunks.filter(F.col("unit").isNotNull()).select("chunk_id", "document_id", "unit")
    sample = own.select("unit", F.xxhash64("chunk_id").alias("_h")).orderBy("_h").limit(SAMPLE).toPandas()["unit"]
    length = int(sample.map(len).mode().max()) if len(sample) else 0
    fitted = np.stack(sample[sample.map(len) == length]).astype(np.float64) if length else np.zeros((0, 0))
    own = own.filter(F.size("unit") == length)
    codes = Codes.fit(fitted, cells) if length else Codes(fitted, [])

    @F.pandas_udf("cell int, code binary, apart double, lost double")
    def coded(units: pd.Series) -> pd.DataFrame:
        return codes.encode(np.stack(units).astype(np.float64)) if len(units) else pd.DataFrame({"cell": [], "code": [], "apart": [], "lost": []})

    rows = own.select("chunk_id", "document_id", coded("unit").alias("e")).select("chunk_id", "document_id", "e.*")
    rows.repartitionByRange("cell", "chunk_id").write.partitionBy("cell").parquet(f"{path}/codes")
    stored = _codes(spark, path)
    found = stored.groupBy("cell").agg(F.count("*").alias("n"), F.max("apart").alias("radius"))
    middle = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(codes.centres)], "cell int, centre array<double>")
    found.join(middle, "cell").coalesce(1).write.parquet(f"{path}/cells")
    spark.createDataFrame([(j, w.ravel().tolist()) for j, w in enumerate(codes.words)], "place int, words array<double>").coalesce(1).write.parquet(f"{path}/words")
    write_points(own, f"{path}/vectors", "chunk_id")


def _codes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("chunk_id string, document_id long, code binary, apart double, lost double, cell int").parquet(f"{path}/codes")


def _best(rows: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("near"), "chunk_id")
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def products(own: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Products of rows with a query. Each row is added up alone, so that equal rows have equal products wherever they stand, which a product of matrices does not promise."""
    return (own * query).sum(axis=1)


class Best:
    """The ``most`` best rows of each query so far; ties by chunk_id."""

    def __init__(self, most: int):
        self.most, self.found = most, {}

    def add(self, query: int, rows: pd.DataFrame, near: np.ndarray) -> None:
        """Of ``rows``, whose products with the query are ``near``."""
        before = self.found.get(query)
        if before is not None and len(before) == self.most:
            there = np.flatnonzero(near >= before["near"].iloc[-1])
            rows, near = rows.iloc[there], near[there]
        elif len(near) > self.most:
            there = np.flatnonzero(near >= np.partition(near, len(near) - self.most)[len(near) - self.most])
            rows, near = rows.iloc[there], near[there]
        if len(near):
            own = rows.assign(query_id=query, near=near)
            both = own if before is None else pd.concat([before, own])
            self.found[query] = both.sort_values(["near", "chunk_id"], ascending=[False, True]).head(self.most)

    def frames(self):
        for own in self.found.values():
            yield own[[x.split()[0] for x in HIT.split(", ")]]


def _scan(spark: SparkSession, path: str, codes: Codes, number: np.ndarray, queries: dict[int, np.ndarray], cells: dict[int, list[int]], short: int, least: dict[int, float] | None = None) -> DataFrame:
    """Of each query the ``short`` best by code in its cells, of which tasks put out their own best only; with ``least`` every vector whose product with the query can be as high."""
    wanted = {q: np.isin(number, c) for q, c in cells.items()}
    row_of = np.full(int(number.max(initial=-1)) + 1, -1)
    row_of[number] = np.arange(len(number))

    def run(frames):
        best = Best(short)
        for f in frames:
            at, code = row_of[f["cell"].to_numpy()], np.frombuffer(b"".join(f["code"]), np.uint8).reshape(len(f), -1)
            rows, lost = f[["chunk_id", "document_id", "lost"]], f["lost"].to_numpy()
            for q, query in queries.items():
                if (there := np.flatnonzero(wanted[q][at])).size:
                    near = codes.near(at[there], code[there], query)
                    if least is None:
                        best.add(q, rows.iloc[there], near)
                    elif (may := near + lost[there] >= least[q] - SLACK).any():
                        yield rows.iloc[there[may]].assign(query_id=q, near=near[may])[[x.split()[0] for x in HIT.split(", ")]]
        yield from best.frames()

    union = sorted({int(c) for x in cells.values() for c in x})
    rows = _codes(spark, path).filter(F.col("cell").isin(union) if union else F.lit(False)).select("chunk_id", "document_id", "cell", "code", "lost").mapInPandas(run, HIT)
    return _best(rows, short) if least is None else rows


def _exact(spark: SparkSession, path: str, units: dict[int, np.ndarray], hits: DataFrame, ids: list[str] | None) -> DataFrame:
    """(query_id, chunk_id, document_id, near) of hits (query_id, chunk_id), by their exact vectors. ids: all that are among the hits, if they are few enough to be read by."""
    rows = spark.read.parquet(f"{path}/vectors") if ids is None else read_points(spark, f"{path}/vectors", "chunk_id", ids)

    @F.pandas_udf(T.DoubleType())
    def near(query: pd.Series, own: pd.Series) -> pd.Series:
        out, own = np.zeros(len(own)), np.stack(own).astype(np.float64) if len(own) else np.zeros((0, 0))
        for q, at in query.groupby(query).indices.items():
            out[at] = products(own[at], units[q])
        return pd.Series(out)

    return rows.join(hits.select("query_id", "chunk_id"), "chunk_id").select("query_id", "chunk_id", "document_id", near("query_id", "unit").alias("near"))


def nearest_to(spark: SparkSession, path: str, queries: dict[int, list[float]], most: int, short: float = SHORT) -> DataFrame:
    """(query_id, chunk_id, document_id, distance, rank) of the nearest chunks of each of a few queries by cosine distance; ties by id. Bounded lists pass through the driver."""
    none = spark.createDataFrame([], "query_id long, chunk_id string, document_id long, distance double, rank int")
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # at most MOST_CELLS
    if not cells:
        return none
    number, centres = np.array([r["cell"] for r in cells]), np.array([r.centre for r in cells])
    words = [np.array(r.words) for r in spark.read.parquet(f"{path}/words").orderBy("place").collect()]
    dims = [min(SUB, centres.shape[1] - SUB * j) for j in range(len(words))]
    codes = Codes(centres, [w.reshape(-1, k) for w, k in zip(words, dims)])
    units = {q: np.asarray(v, float) for q, v in queries.items()}
    units = {q: v / np.linalg.norm(v) for q, v in units.items() if len(v) == centres.shape[1] and np.linalg.norm(v) > 0}
    if not units:
        return none
    keep = max(most, int(np.ceil(short * most)))
    near = {q: centres @ v for q, v in units.items()}
    counts, radius = np.array([r.n for r in cells]), np.array([r.radius for r in cells])
    first = {}
    for q in units:
        order = np.argsort(-near[q], kind="stable")
        first[q] = number[order[: int(np.searchsorted(np.cumsum(counts[order]), FIRST * keep)) + 1]].tolist()

    def listed(hits: DataFrame, most: int) -> tuple[DataFrame, list[str] | None]:
        """``hits`` by way of the driver, and their ids, if there are at most so many."""
        rows = hits.select("query_id", "chunk_id").limit(most + 1).toPandas()
        if len(rows) > most:
            return hits, None
        ids = rows["chunk_id"].unique().tolist()
        return F.broadcast(spark.createDataFrame(rows, "query_id long, chunk_id string")), ids if len(ids) <= MOST_KEYS else None

    best = _exact(spark, path, units, *listed(_scan(spark, path, codes, number, units, first, keep), keep * len(units)))
    least = {r.query_id: r.sure[-1] for r in best.groupBy("query_id").agg(F.sort_array(F.collect_list("near"), asc=False).alias("sure")).select("query_id", F.slice("sure", 1, most).alias("sure")).collect() if len(r.sure) == most}
    least = {q: least.get(q, -np.inf) for q in units}
    may = {q: number[near[q] + radius >= least[q] - SLACK].tolist() for q in units}
    scored = _exact(spark, path, units, *listed(_scan(spark, path, codes, number, units, may, keep, least), LISTED))
    scored = scored.select("query_id", "chunk_id", "document_id", (1 - F.col("near")).alias("distance"))
    order = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def nearest(spark: SparkSession, path: str, query: list[float], most: int, short: float = SHORT) -> DataFrame:
    """(chunk_id, document_id, distance) of the nearest chunks of one query, nearest first."""
    return nearest_to(spark, path, {0: query}, most, short).orderBy("rank").select("chunk_id", "document_id", "distance")


def exactly_nearest(chunks: DataFrame, queries: dict[int, list[float]], most: int) -> DataFrame:
    """(query_id, chunk_id) of the nearest chunks of each query by a scan of all vectors: what the index is measured against."""
    units = {q: np.asarray(v, float) / np.linalg.norm(v) for q, v in queries.items()}

    def run(frames):
        best = Best(most)
        for f in frames:
            if len(f):
                own, rows = np.stack(f["unit"]).astype(np.float64), f[["chunk_id", "document_id"]].assign(lost=0.0)
                for q, v in units.items():
                    best.add(q, rows, products(own, v))
        yield from best.frames()

    return _best(chunks.filter("unit is not null").select("chunk_id", "document_id", "unit").mapInPandas(run, HIT), most).select("query_id", "chunk_id")

