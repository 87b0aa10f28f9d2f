"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Every item is cut into distinct shingles of five words (A-Z lower-cased). A document contains an item when it has at
least ``threshold`` of the item's shingles. Items are partitioned by size. An item of n shingles gets the MinHash
sketch of its n - ceil(threshold * n) + 1 smallest hashes: a document that contains the item misses at most
n - ceil(threshold * n) of its shingles, so it has at least one value of the sketch, and the search loses nothing.
Long documents therefore cost no recall, and what the sketch proposes is verified on the whole sets.

Defined cases: a null or empty text, document or item, contains nothing and is contained nowhere. An item of m < 5
words is one shingle of m words and is sought among the m-word shingles of documents. Repeated rows give repeated
results for documents (same doc_id, one row per row) and one for items of equal id and text. A very long text is searched whole, in a slice of
its own. Columns other than those named are ignored, and empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, distinct, fold, shipped, slices, text_bytes, utf8

SHINGLE = 5
THRESHOLD = 0.8
#: Bytes of item text in one broadcast index; a larger benchmark is searched slice by slice.
INDEX_BYTES = 16 << 20
FILTER_BITS = 20
SCHEMA = "doc_id long, item_id long, n_item_shingles int, n_shared int, containment double"


def required(n: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * n - 1e-9))


class Partition:
    """Items of 2**size to 2**(size + 1) - 1 shingles of ``gram`` words: sketch values, sorted, with their items."""

    def __init__(self, gram: int, items: list[tuple[int, np.ndarray]], threshold: float):
        self.gram, self.ids, self.sets = gram, [i for i, _ in items], [s for _, s in items]
        self.needs = [required(len(s), threshold) for s in self.sets]
        sketches = [s[: len(s) - need + 1] for s, need in zip(self.sets, self.needs)]
        values, owners = np.concatenate(sketches), np.repeat(np.arange(len(items)), [len(s) for s in sketches])
        order = np.argsort(values, kind="stable")
        self.owners = owners[order]
        self.values, self.first = np.unique(values[order], return_index=True)
        self.first = np.append(self.first, len(values))
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.values >> U64(64 - FILTER_BITS)] = True

    def candidates(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h that hold a sketch value, and for each the first place of that value."""
        at = np.flatnonzero(self.filter[h >> U64(64 - FILTER_BITS)])
        place = np.searchsorted(self.values, h[at])
        place[place == len(self.values)] = 0
        hit = self.values[place] == h[at]
        return at[hit], place[hit]


def build_index(items: list[tuple[int, bytes]], threshold: float = THRESHOLD) -> list[Partition]:
    parts: dict[tuple[int, int], list] = {}
    for item_id, text in items:
        words = Words([text]).hashes
        if len(words):
            gram = min(SHINGLE, len(words))
            s = distinct(fold(words, gram)[: len(words) - gram + 1])
            parts.setdefault((gram, len(s).bit_length()), []).append((item_id, s))
    return [Partition(gram, own, threshold) for (gram, _), own in sorted(parts.items())]


def search(index: list[Partition], texts: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
    """(number of text, item id, shingles of the item, shingles shared) for each text that contains an item."""
    for a, b in slices(texts):
        words = Words(texts[a:b])
        grams = {}
        for part in index:
            if part.gram not in grams:
                h, ok = words.grams(part.gram)
                grams[part.gram] = h, ok
            h, ok = grams[part.gram]
            at, place = part.candidates(h)
            keep = ok[at]
            at, place = at[keep], place[keep]
            found: dict[int, set[int]] = {}
            for doc, p in zip(np.searchsorted(words.first, at, side="right") - 1, place):
                found.setdefault(int(doc), set()).update(part.owners[part.first[p] : part.first[p + 1]].tolist())
            for doc, own in found.items():
                mine = distinct(h[words.first[doc] : words.first[doc + 1]][ok[words.first[doc] : words.first[doc + 1]]])
                for i in sorted(own):
                    s = part.sets[i]
                    p = np.minimum(np.searchsorted(mine, s), len(mine) - 1)
                    if (shared := int((mine[p] == s).sum())) >= part.needs[i]:
                        yield a + doc, part.ids[i], len(s), shared


def indexes(benchmark: DataFrame, threshold: float) -> Iterator:
    """Broadcast indexes over the items, each over at most about INDEX_BYTES of text."""
    items = benchmark.select("item_id", "text").filter("item_id is not null").distinct()
    n = max(1, math.ceil(text_bytes(benchmark) / INDEX_BYTES))
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        rows = sorted((r.item_id, (r.text or "").encode()) for r in part.toLocalIterator())
        yield benchmark.sparkSession.sparkContext.broadcast(build_index(rows, threshold))


def contained_items(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of a document (doc_id, text) and an item (item_id, text) that it contains, with exact shingle counts."""
    docs, out = shipped(docs).select("doc_id", "text"), None
    for shared in indexes(benchmark, threshold):

        def run(batches, shared=shared):
            for batch in batches:
                got = list(search(shared.value, utf8(batch.column(1))))
                at, item, size, both = zip(*got) if got else ((), (), (), ())
                columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(item, pa.int64()), pa.array(size, pa.int32()), pa.array(both, pa.int32())]
                columns.append(pa.array([x / y for x, y in zip(both, size)], pa.float64()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "n_item_shingles", "n_shared", "containment"])

        found = docs.mapInArrow(run, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that contain an item. All columns stay, and no text moves between executors."""
    at = shipped(docs).columns.index("text")
    for shared in indexes(benchmark, threshold):

        def run(batches, shared=shared):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[x[0] for x in search(shared.value, utf8(batch.column(at)))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
