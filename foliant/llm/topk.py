"""Exact top-k search by BM25: an inverted index in shards of documents, searched by block-max WAND, merged exactly.

A shard holds up to SHARD_DOCS documents and about SHARD_POSTINGS postings. Its documents stand in the order of their most frequent
word and length, so that neighbours share a language and bounds are tight. For each term it has the postings in document
order; a term that many of the shard's documents have is also laid out as a row with a place for each document. Largest
weights are kept by block: of BLOCK documents for frequent terms, of REGION documents for the others.

How a query is searched in a shard, with the k-th best score that is known for it so far as threshold:

1. Blocks. The largest weights of the query's terms are added up for each block; blocks whose sum is under the threshold are
   left out, and so are shards without any other.
2. Pivot. In the blocks left, frequent terms that enough of the queries at hand ask for are added up from their rows, for all these queries by one product of matrices. The lists of the other terms are taken in the
   order of what a posting can add, up to the pivot: what the lists before it can add together is under a share of what even the best document lacks, so that a document without a term from the pivot on cannot come
   in. Lists from the pivot on are read.
3. Candidates. If many documents still can come in, the lists before the pivot are read as well; sums raise the threshold. What is left is scored exactly, in double precision, term by term in one order in all shards.

The shards of a query are searched in rounds, in an order drawn for each query: FIRST of them, then up to MORE times as many as before. The k-th best
score so far is the threshold that the query takes to the shards of the next round, so a round finds some k * MORE documents a query, however
many shards there are. Scores use the statistics of all documents, and thresholds are scores of documents, so the merged lists of all
shards are the exact top k.

Queries are dealt with in blocks of at most QUERY_TERMS terms, each broadcast to one pass over the index; the index is written once.

Defined cases: a query without words finds nothing, and a document without words is found by none. Fewer than k documents that share a
term with the query: all of them. Scores are rounded to DIGITS places; equal ones rank by doc_id. Rows of equal doc_id are documents of their
own; a query has the words of all rows of its id. Rows whose doc_id is null are neither queries nor documents. A very long text is a
document like any other; its shard ends with it. Other columns are not read, whatever they are called. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Words, give_back, mix, release, slices, utf8, written

K, K1, B = 10, 1.2, 0.75
DIGITS = 9
SHARD_DOCS, SHARD_POSTINGS = 8_192, 3_000_000
BLOCK, REGION = 64, 512
#: Terms of at least this share of a shard's documents, the most frequent MOST_ROWS of them, are laid out as rows.
FREQUENT, MOST_ROWS = 0.06, 1024
QUERY_TERMS, TOGETHER = 3_000_000, 256
#: Shards that a query is searched in in the first round, and how many times as many it has behind it after each further round.
FIRST, MORE = 2, 6
#: Single-precision sums are trusted up to this share; what is nearer to a threshold is scored exactly.
SLACK = 1e-4
#: Candidates that are scored exactly at once rather than narrowed by the lists before the pivot. The share of what the best document lacks that these lists may add: more of them leave more candidates.
FEW, LACK = 16, 0.1
#: Sums over a row of all documents that cost as much as one posting of a list.
DENSE = 200
#: A posting as lists are read: both parts from one place in memory.
POST = np.dtype([("weight", np.float32), ("doc", np.uint32)])


def term_counts(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct term hashes of each text, and how often each occurs."""
    for a, b in slices(texts):
        words = Words(texts[a:b])
        text = np.repeat(np.arange(b - a, dtype=np.uint32), np.diff(words.first))
        order = np.argsort(words.hashes, kind="stable")
        order = order[np.argsort(text[order], kind="stable")]
        terms, text = words.hashes[order], text[order]
        new = np.flatnonzero(np.concatenate(([True], (terms[1:] != terms[:-1]) | (text[1:] != text[:-1])))) if len(terms) else np.zeros(0, int)
        counts, ends = np.diff(np.append(new, len(terms))), np.searchsorted(text[new], np.arange(b - a + 1))
        terms = terms[new]
        for lo, hi in zip(ends[:-1], ends[1:]):
            yield terms[lo:hi], counts[lo:hi]


# --- index ---------------------------------------------------------------------------------------------------------

SHARD = "shard long, docs binary, lengths binary, terms binary, first binary, post_docs binary, post_counts binary"
KINDS = {"docs": np.int64, "lengths": np.uint32, "terms": U64, "first": np.uint32, "post_docs": np.uint16, "post_counts": np.uint32}


def build_shard(ids: list, counted: list[tuple[np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
    """The shard of some documents' terms and counts; ``counted`` is put into the shard's order."""
    top = [int(t[c.argmax()]) if len(t) else 0 for t, c in counted]
    lengths = [int(c.sum()) for _, c in counted]
    order = sorted(range(len(ids)), key=lambda i: (top[i], lengths[i], i))
    counted[:] = [counted[i] for i in order]
    docs = np.repeat(np.arange(len(counted), dtype=np.uint16), [len(t) for t, _ in counted])
    counts = np.concatenate([c.astype(np.uint32) for _, c in counted]) if counted else np.zeros(0, np.uint32)
    terms = np.concatenate([t for t, _ in counted]) if counted else np.zeros(0, U64)
    counted.clear()
    by = np.argsort(terms, kind="stable")
    docs, counts, terms = docs[by], counts[by], terms[by]
    del by
    first = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))) if len(terms) else np.zeros(0, np.int64)
    return {"docs": np.array([ids[i] for i in order], np.int64), "lengths": np.array([lengths[i] for i in order]), "terms": terms[first], "first": np.append(first, len(terms)), "post_docs": docs, "post_counts": counts}


def _pack(number: int, shard: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number]), *[pa.array([shard[n].astype(k).tobytes()], pa.binary()) for n, k in KINDS.items()]], ["shard", *KINDS])


def _packed_shard(number: int, ids: list, counted: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """The shard of what the lists hold, which are empty afterwards; what it was built from goes back to the system."""
    out = _pack(number, build_shard(ids, counted))
    ids.clear()
    counted.clear()
    give_back()
    return out


def write_index(docs: DataFrame) -> DataFrame:
    """The shards, numbered by task and place in it, as binary columns."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        ids, counted, held, number = [], [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, own in zip(batch.column(0).to_pylist(), term_counts(utf8(batch.column(1)))):
                ids.append(doc_id)
                counted.append(own)
                held += len(own[0])
                if len(ids) == SHARD_DOCS or held >= SHARD_POSTINGS:
                    yield _packed_shard(number, ids, counted)
                    held, number = 0, number + 1
        if ids:
            yield _packed_shard(number, ids, counted)

    return written(docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(run, SHARD), "index")


def statistics(index: DataFrame) -> tuple[int, float, DataFrame]:
    """Documents, mean length, and (term, df) over all shards. Of each shard a term is sent once."""

    def sizes(batches):
        for batch in batches:
            own = [np.frombuffer(x, np.uint32) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in own], pa.int64()), pa.array([int(x.sum(dtype=np.int64)) for x in own], pa.int64())], ["n", "words"])

    def frequencies(batches):
        for batch in batches:
            for terms, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                terms, df = np.frombuffer(terms, np.int64), np.diff(np.frombuffer(first, np.uint32).astype(np.int64))
                for a in range(0, len(terms), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(terms[a : a + 100_000]), pa.array(df[a : a + 100_000])], ["term", "df"])

    total = index.select("lengths").mapInArrow(sizes, "n long, words long").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
    df = index.select("terms", "first").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return total.n or 0, (total.words or 0) / max(1, total.n or 0), df


# --- search --------------------------------------------------------------------------------------------------------


def ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of all ranges, one range after the other."""
    n = last - first
    out = np.repeat(last - np.cumsum(n), n)
    out += np.arange(len(out))
    return out


class Shard:
    """A shard as read, with weights under the statistics of the whole collection and their maxima by block.

    Only terms of ``vocabulary`` (sorted, with their idf) are kept; place_of: where each of them is among the shard's own.
    """

    def __init__(self, row: dict, mean_length: float, vocabulary: np.ndarray, idf: np.ndarray):
        own = {n: np.frombuffer(row[n], k) for n, k in KINDS.items()}
        self.docs, n, terms, sizes = own["docs"], len(own["docs"]), own["terms"], np.diff(own["first"].astype(np.int64))
        at = np.minimum(np.searchsorted(vocabulary, terms), max(0, len(vocabulary) - 1))
        known = vocabulary[at] == terms if len(vocabulary) else np.zeros(len(terms), bool)
        self.place_of = np.full(len(vocabulary), -1, np.int32)
        self.place_of[at[known]] = np.arange(known.sum())
        self.df, asked = sizes[known], np.repeat(known, sizes)
        post_docs = own["post_docs"][asked]
        term = np.repeat(np.arange(len(self.df), dtype=np.int32), self.df)
        self.first = np.concatenate(([0], np.cumsum(self.df)))
        tf, norm = own["post_counts"][asked].astype(np.float64), K1 * (1 - B + B * own["lengths"] / max(mean_length, 1e-9))
        del asked
        exact = norm[post_docs]
        exact += tf
        np.divide(tf, exact, out=exact)
        exact *= (idf[at[known]] * (K1 + 1))[term]
        del tf
        by = np.argsort(post_docs, kind="stable")  # documents' own terms, for exact scores
        self.own_terms, self.own_weights = term[by], exact[by]
        del by
        self.own_first = np.concatenate(([0], np.cumsum(np.bincount(post_docs, minlength=n))))
        self.asked = np.zeros(len(self.df), bool)
        self.posts = np.empty(len(exact), POST)
        self.posts["doc"], self.posts["weight"] = post_docs, exact
        del exact
        weights = self.posts["weight"].copy()
        self.most = np.maximum.reduceat(weights, self.first[:-1]).astype(float) if len(self.df) else np.zeros(0)
        self.each = self.most / self.df
        frequent = np.flatnonzero(self.df >= max(1, FREQUENT * n))
        if len(frequent) > MOST_ROWS:
            frequent = np.sort(frequent[np.argsort(-self.df[frequent], kind="stable")[:MOST_ROWS]])
        self.row_of = np.full(len(self.df), -1, np.int32)
        self.row_of[frequent] = np.arange(len(frequent))
        self.row_df = self.df[frequent]
        self.n_blocks, self.n_regions = -(-n // BLOCK), -(-n // REGION)
        self.rows = np.zeros((len(frequent), self.n_blocks * BLOCK), np.float32)
        for j, (a, b) in enumerate(zip(self.first[frequent], self.first[frequent + 1])):
            self.rows[j, post_docs[a:b]] = weights[a:b]
        self.row_most = np.ascontiguousarray(self.rows.reshape(len(frequent), self.n_blocks, BLOCK).max(axis=2))
        rest = np.flatnonzero(self.row_of[term] < 0)
        region, term = post_docs[rest] // REGION, term[rest]
        new = (term[1:] != term[:-1]) | (region[1:] != region[:-1])
        entry = np.flatnonzero(np.concatenate(([True], new))) if len(rest) else np.zeros(0, int)
        self.entry_region, self.entry_first = region[entry], np.searchsorted(term[entry], np.arange(len(self.df) + 1, dtype=np.int32))
        self.entry_most = np.maximum.reduceat(weights[rest], entry) if len(entry) else np.zeros(0, np.float32)

    def exact(self, docs: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Scores of some documents; their terms at ``places`` are added in the order of hashes in every shard."""
        self.asked[places] = True
        out = [self.own_weights[a:b][self.asked[self.own_terms[a:b]]].sum() for a, b in zip(self.own_first[docs].tolist(), self.own_first[docs + 1].tolist())]
        self.asked[places] = False
        return np.round(np.array(out), DIGITS)

    def lists(self, places: np.ndarray) -> np.ndarray:
        """What the lists at ``places`` add to each document."""
        posts = self.posts.view(np.int64).take(ranges(self.first[places], self.first[places + 1])).view(POST)
        return np.bincount(posts["doc"], weights=posts["weight"], minlength=len(self.docs))


def better(scores: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((docs, -scores))[:k]
    return scores[order], docs[order]


class Best:
    """The k best of each query so far, and the score that a document must have to come in."""

    def __init__(self, k: int, least: np.ndarray):
        self.k, self.least, self.found = k, least.copy(), {}

    def add(self, i: int, scores: np.ndarray, docs: np.ndarray) -> None:
        s, d = self.found.get(i, (np.zeros(0), np.zeros(0, np.int64)))
        self.found[i] = s, d = better(np.concatenate([s, scores]), np.concatenate([d, docs]), self.k)
        if len(s) == self.k:
            self.least[i] = max(self.least[i], s[-1])


def lowered(score):
    """A bound under which no sum in single precision of so high a score can lie."""
    return score * (1 - SLACK) - 1e-6


def search_shard(shard: Shard, queries: list[int], places: list[np.ndarray], best: Best) -> None:
    """The best of some queries (by number; the places of their terms in the shard) that the shard adds."""
    frequent, rest = np.zeros((len(queries), len(shard.rows)), np.float32), []
    for j, p in enumerate(places):
        row = shard.row_of[p]
        frequent[j, row[row >= 0]] = 1
        rest.append(p[row < 0])
    dense = frequent.sum(axis=0) * shard.row_df * DENSE > len(queries) * len(shard.docs)
    flat = np.concatenate(rest)
    first, last = shard.entry_first[flat], shard.entry_first[flat + 1]
    e, of = ranges(first, last), np.repeat(np.repeat(np.arange(len(queries)), [len(p) for p in rest]), last - first)
    bounds = np.bincount(of * shard.n_regions + shard.entry_region[e], weights=shard.entry_most[e], minlength=len(queries) * shard.n_regions).reshape(len(queries), shard.n_regions)
    least = lowered(best.least[queries])
    bounds = np.repeat(bounds, REGION // BLOCK, axis=1)[:, : shard.n_blocks] + frequent @ shard.row_most
    live = (bounds >= least[:, None]) & (bounds > 0)
    blocks = np.flatnonzero(live.any(axis=0))
    if not len(blocks):
        return
    lo, hi = int(blocks[0]) * BLOCK, min((int(blocks[-1]) + 1) * BLOCK, len(shard.docs))
    sums = frequent[:, dense] @ shard.rows[dense, lo:hi]
    added = np.append(dense, False)  # at -1, where terms without a row look
    for j, i in enumerate(queries):
        own = np.flatnonzero(live[j])
        if len(own):
            listed = places[j][~added[shard.row_of[places[j]]]]
            a, b = max(lo, int(own[0]) * BLOCK), min(hi, (int(own[-1]) + 1) * BLOCK)
            _search(shard, i, places[j], listed, a, sums[j, a - lo : b - lo], best)


def _search(shard: Shard, i: int, places: np.ndarray, rest: np.ndarray, start: int, sums: np.ndarray, best: Best) -> None:
    """One query in the documents from ``start`` on, whose terms but ``rest`` add up to ``sums``."""
    k, least, high = best.k, lowered(best.least[i]), float(sums.max())
    rest = rest[np.argsort(shard.each[rest], kind="stable")]
    before = np.cumsum(shard.most[rest])
    if high + (before[-1] if len(before) else 0) < least:
        return
    pivot = int(np.searchsorted(before, LACK * (least - high)))  # the lists before it add less than a share of what the best document lacks
    if pivot < len(rest):
        sums = sums + shard.lists(rest[pivot:])[start : start + len(sums)]
    at = np.flatnonzero(sums >= max(least - (before[pivot - 1] if pivot else 0.0), 1e-12))
    if pivot and len(at) > FEW:
        sums, pivot = sums[at] + shard.lists(rest[:pivot])[at + start], 0
        at = at[keep := np.flatnonzero(sums >= max(least, 1e-12))]
        sums = sums[keep]
    else:
        sums = sums[at]
    if not pivot and len(at) > k:
        at = at[sums >= lowered(np.partition(sums, len(sums) - k)[len(sums) - k])]
    if len(at):
        scores = shard.exact(at := at + start, places)
        hit = (scores >= best.least[i]) & (scores > 0)
        if hit.any():
            best.add(i, scores[hit], shard.docs[at[hit]])


class Queries:
    """Queries in an order that puts those of one language side by side, as lists of places in their sorted vocabulary, and
    the score that a document must have to come in."""

    def __init__(self, ids: list[int], terms: list[np.ndarray], idf: list[np.ndarray]):
        commonest = [int(t[w.argmin()]) for t, w in zip(terms, idf)]
        order = sorted(range(len(ids)), key=lambda i: (commonest[i], len(terms[i])))
        self.ids, self.first = np.array([ids[i] for i in order], np.int64), np.concatenate(([0], np.cumsum([len(terms[i]) for i in order])))
        self.vocabulary, at, self.own = np.unique(np.concatenate([terms[i] for i in order]), return_index=True, return_inverse=True)
        self.idf, self.own = np.concatenate([idf[i] for i in order])[at], self.own.astype(np.int32)
        self.least = np.zeros(len(ids))


def drawn(queries: np.ndarray, shard: int) -> np.ndarray:
    """For each query a number from 0 to 1 by which the shard comes early or late for it."""
    with np.errstate(over="ignore"):
        return mix(queries.astype(U64) * U64(0x9E3779B97F4A7C15) ^ mix(np.array([shard], U64))) / 2.0**64


def search_index(index: DataFrame, queries: Queries, mean_length: float, k: int, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """(query, doc_id, score): for each task that reads shards the k best of those, for every query by number. A query is searched in the shards
    that it draws a number from ``lo`` to below ``hi`` for."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches) -> Iterator[pa.RecordBatch]:
        q = shared.value
        best, numbers = Best(k, q.least), np.arange(len(q.ids))
        for batch in batches:
            for i, number in enumerate(batch.column("shard").to_pylist()):
                at = drawn(numbers, number)
                mine = numbers[(at >= lo) & (at < hi)]
                if len(mine):
                    search_all(Shard({n: batch.column(n)[i].as_buffer() for n in KINDS}, mean_length, q.vocabulary, q.idf), q, mine.tolist(), best)
        for i, (scores, docs) in best.found.items():
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(docs), pa.int32()), pa.array(docs), pa.array(scores)], ["query", "doc_id", "score"])

    return index.mapInArrow(run, "query int, doc_id long, score double")


def search_all(shard: Shard, q: Queries, mine: list[int], best: Best) -> None:
    """The best that a shard adds for the queries numbered ``mine``, TOGETHER at a time."""
    for a in range(0, len(mine), TOGETHER):
        numbers, places = [], []
        for i in mine[a : a + TOGETHER]:
            own = shard.place_of[q.own[q.first[i] : q.first[i + 1]]]
            own = own[own >= 0]
            if len(own):
                numbers.append(i)
                places.append(own)
        if numbers:
            search_shard(shard, numbers, places, best)


def _packed_queries(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists, rows = batch.column(1), []
        terms, idf, ends = lists.values.field(0).to_numpy().view(U64), lists.values.field(1).to_numpy(), lists.offsets.to_numpy()
        for query, a, b in zip(batch.column(0).to_pylist(), ends[:-1], ends[1:]):
            order = a + np.argsort(terms[a:b])
            rows.append((query, terms[order].tobytes(), idf[order].tobytes()))
        types = [pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 3, types)], ["query_id", "terms", "idf"])


def query_blocks(queries: DataFrame, df: DataFrame, n_docs: int) -> Iterator[Queries]:
    """Queries with their distinct terms' weights, in blocks; the driver holds one block at a time."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, (terms, _) in zip(batch.column(0).to_pylist(), term_counts(utf8(batch.column(1)))):
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(terms), pa.int64()), pa.array(terms.view(np.int64))], ["query_id", "term"])

    terms = queries.filter("doc_id is not null").select("doc_id", "text").mapInArrow(run, "query_id long, term long")
    weighted = terms.join(df, "term").select("query_id", F.struct("term", F.log1p((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")).alias("t"))
    listed = weighted.groupBy("query_id").agg(F.collect_set("t").alias("t"))
    per = written(listed.mapInArrow(_packed_queries, "query_id long, terms binary, idf binary"), "queries")
    ids, own, idf, held = [], [], [], 0
    for row in per.toLocalIterator():
        ids.append(row.query_id)
        own.append(np.frombuffer(row.terms, U64))
        idf.append(np.frombuffer(row.idf, np.float64))
        held += len(own[-1])
        if held > QUERY_TERMS:
            yield Queries(ids, own, idf)
            ids, own, idf, held = [], [], [], 0
    if ids:
        yield Queries(ids, own, idf)


FOUND = "query_id long, doc_id long, score double"


def _named(found: DataFrame, queries: Queries) -> DataFrame:
    """With the queries' ids for their numbers."""
    ids = found.sparkSession.sparkContext.broadcast(queries.ids)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(ids.value[batch.column(0).to_numpy()]), batch.column(1), batch.column(2)], ["query_id", "doc_id", "score"])

    return found.mapInArrow(run, FOUND)


def search_rounds(index: DataFrame, n_shards: int, block: Queries, mean_length: float, k: int) -> DataFrame:
    """What :func:`search_index` finds for a block of queries, in rounds of FIRST shards a query, MORE times as many, and so on."""
    out, lo, rank = None, 0.0, F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    while lo < 1:
        hi = min(1.0, lo * MORE or FIRST / max(1, n_shards))
        hi = 1.0 if 2 * hi > 1 else hi
        found = written(search_index(index, block, mean_length, k, lo, hi if hi < 1 else 2.0), "found")
        out, lo = found if out is None else out.unionByName(found), hi
        if hi < 1:
            for r in out.withColumn("rank", rank).filter(F.col("rank") == k).collect():  # a row a query of the block
                block.least[r["query"]] = r.score
    return out


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents for each query (doc_id, text), the query's own row included."""
    index = write_index(docs)
    release(docs.sparkSession)
    n, mean_length, df = statistics(index)
    n_shards, out = index.count(), None
    for block in query_blocks(queries, df, n):
        found = _named(search_rounds(index, n_shards, block, mean_length, k), block)
        release(docs.sparkSession)  # the block and the shards as searched
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def is_query(doc_id: str = "doc_id") -> Column:
    return F.col(doc_id) % 50 == 0
