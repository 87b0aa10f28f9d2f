"""Vectors in NPY files beside ids in JSON lines, as a Spark data source: row k of one belongs to line k of the other.

A pair is read in ranges of bytes of its ids. How many lines begin in each range is counted by a job first; sums of these few counts say which rows of the vectors a range needs, so a task reads its lines and
its rows by position and nothing is joined or shuffled. Pairs are written by tasks, one pair each.

Files are opened by pyarrow's file systems, so paths are local or those of a store that pyarrow reaches. A pair whose numbers of lines and rows differ is an error, as are vectors that are not two-dimensional, in
rows, and of floating numbers.
"""

from __future__ import annotations

import json
import uuid
from ast import literal_eval
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as stores
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from foliant.sources.ship import ship

NAME = "vector_pairs"
SCHEMA = "pos long, id string, embedding array<float>"
RANGE_BYTES, BATCH_BYTES = 64 << 20, 4 << 20


def _store(path: str) -> tuple[stores.FileSystem, str]:
    return stores.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (stores.LocalFileSystem(), path)


@dataclass
class Header:
    rows: int
    width: int
    dtype: np.dtype
    begin: int


def header(path: str) -> Header:
    """Of an NPY file: the magic string, two bytes of version, the length of the description, and that, as Python writes a dict."""
    fs, p = _store(path)
    with fs.open_input_file(p) as f:
        lead = f.read(12)
        if lead[:6] != b"\x93NUMPY":
            raise ValueError(f"{path} is no NPY file")
        size = 2 if lead[6] == 1 else 4
        length = int.from_bytes(lead[8 : 8 + size], "little")
        f.seek(8 + size)
        about = literal_eval(f.read(length).decode("latin1"))
    dtype = np.dtype(about["descr"])
    if about["fortran_order"] or len(about["shape"]) != 2 or dtype.kind != "f":
        raise ValueError(f"{path} must have rows of floating numbers, not {about}")
    return Header(*about["shape"], dtype, 8 + size + length)


@dataclass
class Part(InputPartition):
    """Lines that begin in [lo, hi) of a file of ids; the first of them is number ``first`` of ``n``; ``base``: lines of the pairs before."""

    ids: str
    vectors: str
    lo: int
    hi: int
    first: int
    n: int
    base: int


def lines_from(ids: str, lo: int, hi: int) -> Iterator[bytes]:
    """The lines that begin in [lo, hi)."""
    fs, p = _store(ids)
    with fs.open_input_file(p) as raw:
        raw.seek(max(0, lo - 1))
        at, rest = max(0, lo - 1), b""
        skip = lo > 0  # what goes on from the range before
        while True:
            block = raw.read(1 << 20)
            rest += block
            *whole, rest = rest.split(b"\n")
            for line in whole:
                begin, at = at, at + len(line) + 1
                if skip:
                    skip = False
                    continue
                if begin >= hi:
                    return
                yield line
            if not block:
                if rest and not skip and at < hi:
                    yield rest
                return


class Pairs(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PairReader(self.options)


class PairReader(DataSourceReader):
    def __init__(self, options):
        self.field, self.parts = options["field"], [Part(*p) for p in json.loads(options["parts"])]

    def partitions(self) -> list[Part]:
        return self.parts

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        about = header(part.vectors)
        row = about.width * about.dtype.itemsize
        step = max(1, BATCH_BYTES // max(1, row))
        fs, p = _store(part.vectors)
        lines = lines_from(part.ids, part.lo, part.hi)
        with fs.open_input_file(p) as f:
            for k in range(0, part.n, step):
                n = min(step, part.n - k)
                f.seek(about.begin + (part.first + k) * row)
                own = np.frombuffer(f.read(n * row), about.dtype).astype(np.float32)
                ids = [json.loads(next(lines))[self.field] for _ in range(n)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * about.width), pa.array(own))
                pos = pa.array(part.base + part.first + k + np.arange(n))
                yield pa.RecordBatch.from_arrays([pos, pa.array([None if i is None else str(i) for i in ids]), lists], names=["pos", "id", "embedding"])


def pairs_in(folder: str) -> list[tuple[str, str]]:
    """The pairs of a folder, x.jsonl beside x.npy, by name."""
    fs, p = _store(folder)
    lead = folder[: len(folder) - len(p)] if folder.endswith(p) else ""
    names = sorted(f.path for f in fs.get_file_info(stores.FileSelector(p)) if f.path.endswith(".npy"))
    return [(f"{lead}{n[:-4]}.jsonl", f"{lead}{n}") for n in names]


def read_pairs(spark: SparkSession, pairs: list[tuple[str, str]], field: str = "id", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(pos, id, embedding) of (ids, vectors) files; pos counts through all pairs in their order."""
    ship(spark)
    ranges = []
    for k, (ids, _) in enumerate(pairs):
        fs, p = _store(ids)
        size = fs.get_file_info(p).size
        ranges += [(k, ids, lo, min(size, lo + range_bytes)) for lo in range(0, size, range_bytes)]

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(n=[sum(1 for _ in lines_from(r.ids, r.lo, r.hi)) for r in f.itertuples()])

    schema = "k int, ids string, lo long, hi long"
    counted = spark.createDataFrame(ranges, schema).repartition(max(1, len(ranges))).mapInPandas(count, f"{schema}, n long").orderBy("k", "lo").collect()  # a row for each range
    parts, base = [], 0
    for k, (ids, vectors) in enumerate(pairs):
        first = 0
        for r in (r for r in counted if r.k == k):
            parts += [(ids, vectors, r.lo, r.hi, first, r.n, base)] if r.n else []
            first += r.n
        if first != (rows := header(vectors).rows):
            raise ValueError(f"{ids} has {first} lines, {vectors} has {rows} rows")
        base += first
    spark.dataSource.register(Pairs)
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.format(NAME).option("field", field).option("parts", json.dumps(parts)).load()


def last_of_id(rows: DataFrame) -> DataFrame:
    """(id, embedding): of a repeated id the last row counts."""
    return rows.groupBy("id").agg(F.max_by("embedding", "pos").alias("embedding"))


def write_pairs(rows: DataFrame, folder: str, width: int) -> None:
    """(id, embedding) of vectors of one length as a pair of files for each partition. A task that is run again replaces its files."""
    ship(rows.sparkSession)

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, p = _store(folder)
        fs.create_dir(p, recursive=True)
        own = [f for f in frames if len(f)]
        if own:
            own = pd.concat(own)
            name, mark = f"{p}/part-{TaskContext.get().partitionId():05d}", uuid.uuid4().hex
            vectors = np.stack(own["embedding"]).astype("<f4").reshape(len(own), width)
            about = f"{{'descr': '<f4', 'fortran_order': False, 'shape': {vectors.shape}, }}".encode()
            about += b" " * (-(len(about) + 11) % 64) + b"\n"
            files = {".jsonl": "".join(json.dumps({"id": i}, ensure_ascii=False) + "\n" for i in own["id"]).encode(), ".npy": b"\x93NUMPY\x01\x00" + len(about).to_bytes(2, "little") + about + vectors.tobytes()}
            for ending, content in files.items():
                with fs.open_output_stream(f"{name}{ending}.{mark}") as f:
                    f.write(content)
                fs.move(f"{name}{ending}.{mark}", f"{name}{ending}")
        yield pd.DataFrame({"n": [len(own)]})

    rows.select("id", "embedding").mapInPandas(put, "n long").agg(F.sum("n")).collect()
