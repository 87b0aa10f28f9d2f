"""N-gram Jaccard join: a blocked sparse product of the document by shingle incidence with itself, and its components.

Two documents link when their sets of distinct shingles (five words, A-Z lower-cased; shorter texts whole) have a Jaccard
similarity of at least 4/5. The incidence matrix is cut into blocks by shingle; a block's product gives the
overlaps it contributes; documents and pairs that cannot reach their bound are dropped before anything larger is built:

1. Documents with equal sets are one class; only its smallest doc_id goes on.
2. First product, counts only. A set of n shingles shares at least l shingles with any partner among its first
   n - ceil(4n/5) + l in hash order (l = n/8; both sides, l of the smaller). Blocks of those prefixes count how many
   of a document's shingles occur elsewhere at all; documents below their bound have no partner.
3. Second product, over the remaining documents' whole sets: exact frequencies, so that prefixes can be taken rarest
   shingle first, and documents of which fewer than ceil(4n/5) shingles occur elsewhere fall out.
4. Documents that share a prefix shingle are candidates. Small candidate groups are settled in one place; large ones by rounds
   of star tests, in which the members of each list meet its smallest member only. Jaccard distance is a metric, so what a
   star's centre knows settles all other pairs but those that it cannot tell apart, which stay for the next round. No group of copies
   is ever expanded into all its pairs, and no link between different sets is lost.

Defined cases: null and wordless texts have an empty set and link with nothing. Rows of equal doc_id are one document
for reachability, and each keeps a row. A null doc_id takes no part and has itself (null) as component. A very long text is one set, hashed in a slice of its own. Other columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, broadcast_if_small, mix, release, slices, state, task_lot, utf8, written
from .components import connected_components, roots_of

#: Shingles in one block of the product, about.
BLOCK_TOKENS = 1_500_000
#: Shingles, and documents, of which a task takes the sets at once, about.
GROUP_TOKENS, GROUP_DOCS = 1_000_000, 2_000
#: Candidate groups with more shingles in all are settled by distributed rounds.
LOCAL_TOKENS = 3_000_000
#: After so many rounds what is left is settled pair by pair.
ROUNDS = 8
EPS = 1e-9


def bound(n):
    """Smallest overlap of a set of n with any partner: ceil(4n/5)."""
    return (4 * n + 4) // 5


def extra(n):
    return np.maximum(1, n // 8)


def links(shared, a, b):
    """Whether sets of sizes a and b with so many common shingles link: 100 * intersection >= 80 * union."""
    return 5 * shared >= 4 * (a + b - shared)


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _u64(b: bytes) -> np.ndarray:
    return np.frombuffer(b, U64)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in schema.split(", "))])


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    s = _arrow(schema)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * len(s), s.types)], schema=s)


# --- 1: sets -------------------------------------------------------------------------------------------------------

SETS = "doc_id long, n long, h1 long, h2 long, prefix binary"


def _sets(whole: bool):
    def run(batches) -> Iterator[pa.RecordBatch]:
        state("jaccard")
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), utf8(batch.column(1))
            for a, b in slices(texts):
                rows = []
                for doc_id, s in zip(ids[a:b], Words(texts[a:b]).shingles()):
                    n = len(s)
                    with np.errstate(over="ignore"):
                        h1, h2 = (int(mix(s ^ U64(k)).sum(dtype=U64).astype(np.int64)) for k in (0x51, 0xA7))
                    rows.append((doc_id, n, h1, h2, _blob(s if whole else s[: n - bound(n) + extra(n)] if n else s)))
                yield _batch(rows, SETS)

    return run


def shingled(docs: DataFrame, whole: bool = False) -> DataFrame:
    """n, a hash of the set, and its first shingles in hash order (or all) for each (doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(_sets(whole), SETS)


# --- 2: how many of a document's shingles occur elsewhere ----------------------------------------------------------

BLOCKS = "block int, tokens binary, owners binary"


def _blocks(n_blocks: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        """Per batch: shingles of one document only go to their block with their owner; those of several are credited to
        their owners here, and go to their block once, without an owner. So a shingle is sent once a batch at most.
        Credit goes to blocks under 0, by task and batch in turn."""
        for k, batch in enumerate(batches, task_lot()):
            ids, sets = batch.column(0).to_numpy(), [_u64(x) for x in batch.column(1).to_pylist()]
            tokens = np.concatenate(sets) if sets else np.zeros(0, U64)
            owners = np.repeat(ids, [len(s) for s in sets])
            order = np.argsort(tokens, kind="stable")
            tokens, owners = tokens[order], owners[order]
            new = np.concatenate(([True], tokens[1:] != tokens[:-1])) if len(tokens) else np.zeros(0, bool)
            count = np.diff(np.append(np.flatnonzero(new), len(tokens)))
            many = np.repeat(count > 1, count)
            own, credit = np.unique(owners[many], return_counts=True)
            rows = [(-1 - k % n_blocks, _blob(credit), _blob(own))] if len(own) else []
            tokens, owners = tokens[new], np.where(count > 1, -1, owners[new])
            block = (tokens % U64(n_blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            tokens, owners, ends = tokens[order], owners[order], np.cumsum(np.bincount(block, minlength=n_blocks))
            for i, (a, b) in enumerate(zip(np.concatenate(([0], ends[:-1])), ends)):
                if b > a:
                    rows.append((i, _blob(tokens[a:b]), _blob(owners[a:b])))
            yield _batch(rows, BLOCKS)

    return run


COUNTS = "deal int, owners binary, counts binary"


def _by_owner(owners: np.ndarray, counts: np.ndarray, n_blocks: int) -> pd.DataFrame:
    deal = (mix(owners.view(U64)) % U64(n_blocks)).astype(np.int64)
    order = np.argsort(deal, kind="stable")
    owners, counts, ends = owners[order], counts[order].astype(np.int64), np.cumsum(np.bincount(deal, minlength=n_blocks))
    rows = [(i, _blob(owners[a:b]), _blob(counts[a:b])) for i, (a, b) in enumerate(zip(np.concatenate(([0], ends[:-1])), ends)) if b > a]
    return pd.DataFrame(rows, columns=["deal", "owners", "counts"])


def _elsewhere(n_blocks: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Of one block: owners and how many of their shingles another batch has too, or several documents of one."""
        state("jaccard")
        owners = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["owners"]])
        if key[0] < 0:
            return _by_owner(owners, np.concatenate([np.frombuffer(x, np.int64) for x in pdf["tokens"]]), n_blocks)
        tokens = np.concatenate([_u64(x) for x in pdf["tokens"]])
        order = np.argsort(tokens, kind="stable")
        tokens, owners = tokens[order], owners[order]
        same = tokens[1:] == tokens[:-1]
        twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
        return _by_owner(*np.unique(owners[twice & (owners != -1)], return_counts=True), n_blocks)

    return run


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    own, at = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in pdf["owners"]]), return_inverse=True)
    counts = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["counts"]])
    return pd.DataFrame({"doc_id": own, "shared": np.bincount(at, weights=counts, minlength=len(own)).astype(np.int64)})


def shared_counts(sets: DataFrame, total: int) -> DataFrame:
    """(doc_id, shared): how many of each set's shingles occur in another set (or in a row of equal set)."""
    n_blocks = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // BLOCK_TOKENS + 1)
    blocks = sets.mapInArrow(_blocks(n_blocks), BLOCKS)
    counts = blocks.groupBy("block").applyInPandas(_elsewhere(n_blocks), COUNTS)
    return counts.groupBy("deal").applyInPandas(_summed, "doc_id long, shared long")


# --- 3: frequencies, and prefixes rarest first ---------------------------------------------------------------------


def _group_counts(n_blocks: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tokens, counts = np.unique(np.concatenate([_u64(x) for x in pdf["prefix"]]), return_counts=True)
        block = (tokens % U64(n_blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        tokens, counts, ends = tokens[order], counts[order].astype(np.int64), np.cumsum(np.bincount(block, minlength=n_blocks))
        rows = [(key[0], i, _blob(tokens[a:b]), _blob(counts[a:b])) for i, (a, b) in enumerate(zip(np.concatenate(([0], ends[:-1])), ends)) if b > a]
        return pd.DataFrame(rows, columns=["grp", "block", "tokens", "counts"])

    return run


def _frequencies(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one block: for each group of documents, its shingles that occur at least twice among all, and how often."""
    sizes = [len(x) // 8 for x in pdf["tokens"]]
    tokens = np.concatenate([_u64(x) for x in pdf["tokens"]])
    counts = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["counts"]])
    _, at = np.unique(tokens, return_inverse=True)
    df = np.bincount(at, weights=counts).astype(np.int64)[at]
    rows, a = [], 0
    for grp, n in zip(pdf["grp"], sizes):
        keep = df[a : a + n] > 1
        rows.append((grp, _blob(tokens[a : a + n][keep]), _blob(df[a : a + n][keep])))
        a += n
    return pd.DataFrame(rows, columns=["grp", "tokens", "df"])


def _rarest(sets: pd.DataFrame, frequencies: pd.DataFrame) -> pd.DataFrame:
    """Prefixes by frequency. Shingles of one document only come first and need no list."""
    state("jaccard")
    if not len(sets) or not len(frequencies):
        return pd.DataFrame({"doc_id": [], "apart": [], "tokens": []})
    known = np.concatenate([_u64(x) for x in frequencies["tokens"]])
    df = np.concatenate([np.frombuffer(x, np.int64) for x in frequencies["df"]])
    order = np.argsort(known)
    known, df, rows = known[order], df[order], []
    for doc_id, blob in zip(sets["doc_id"], sets["prefix"]):
        s = _u64(blob)
        if not len(known):
            continue
        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
        hit = known[at] == s
        n, k = len(s), int(hit.sum())
        room = n - bound(n) + 1 - (n - k)
        if k >= bound(n) and room > 0:
            own, f = s[hit], df[at[hit]]
            rows.append((doc_id, (n - k) * 1_000_000 // n, own[np.lexsort((own, f))[:room]].astype(np.int64)))
    return pd.DataFrame(rows, columns=["doc_id", "apart", "tokens"])


def deals(n_docs: int, total: int) -> int:
    """Into how many groups documents are dealt by hash, so that none has many documents or many shingles."""
    return max(n_docs // GROUP_DOCS, total // GROUP_TOKENS) + 1


def postings(sets: DataFrame, n_docs: int, total: int) -> DataFrame:
    """(token, doc_id, apart): prefix shingles, rarest first, of the sets that can still have a partner; apart: the share of
    a set's shingles (in millionths) that no other set has, small for the middle of a group of copies."""
    spark = sets.sparkSession
    groups = deals(n_docs, total)
    n_blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BLOCK_TOKENS + 1)
    own = sets.select("doc_id", "prefix", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int").alias("grp"))
    counts = own.groupBy("grp").applyInPandas(_group_counts(n_blocks), "grp int, block int, tokens binary, counts binary")
    df = counts.groupBy("block").applyInPandas(_frequencies, "grp int, tokens binary, df binary")
    rare = own.groupBy("grp").cogroup(df.groupBy("grp")).applyInPandas(_rarest, "doc_id long, apart int, tokens array<long>")
    return rare.select(F.explode("tokens").alias("token"), "doc_id", "apart")


# --- 4: settling candidates ----------------------------------------------------------------------------------------


def settle(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that give the components of all links among the sets, by stars (the local form of the rounds below)."""
    sizes = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    flag, out, open_ = np.zeros(codes.max() + 1, bool), [], list(range(len(sets)))

    def overlaps(i: int) -> np.ndarray:
        own = codes[first[i] : first[i] + sizes[i]]
        flag[own] = True
        got = np.add.reduceat(flag[codes], first)
        flag[own] = False
        return got

    common = np.bincount(codes)[codes]
    central = np.add.reduceat(common, first) / sizes
    open_.sort(key=lambda i: -central[i])
    while open_:
        hub, got = open_[0], overlaps(open_[0])
        d = 1 - got / (sizes + sizes[hub] - got)
        star = links(got, sizes, sizes[hub])
        own = np.array([j for j in open_ if star[j] and j != hub], int)
        out += [(hub, int(j)) for j in own]
        for j in open_:
            near = own[d[own] >= d[j] - 0.2 - EPS] if not star[j] and d[j] <= 0.4 + EPS else own[:0]
            if len(near):
                linked = near[links(overlaps(j)[near], sizes[near], sizes[j])]
                out += [(int(i), j) for i in linked[:1]]  # one link joins it to the star, whose members are joined already
        open_ = [j for j in open_ if not star[j] and j != hub]
    return out


def _settle_groups(pdf: pd.DataFrame) -> pd.DataFrame:
    state("jaccard")
    a, b = [], []
    for _, own in pdf.groupby("root", sort=False):
        ids = own["doc_id"].to_numpy()
        for i, j in settle([_u64(x) for x in own["prefix"]]):
            a.append(ids[i])
            b.append(ids[j])
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _overlap(batches) -> Iterator[pa.RecordBatch]:
    """(hub, doc_id, set of doc, set of hub) to (hub, doc_id, d, link)."""
    for batch in batches:
        hub, doc, left, right = (batch.column(i).to_pylist() for i in range(4))
        rows = []
        for h, x, a, b in zip(hub, doc, left, right):
            a, b = _u64(a), _u64(b)
            shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
            rows.append((h, x, 1 - shared / (len(a) + len(b) - shared), int(links(shared, len(a), len(b)))))
        yield _batch(rows, "hub long, doc_id long, d double, link int")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact distances of (hub, doc_id) pairs. Hubs are few for the pairs they have, so their sets are fetched last."""
    hubs = pairs.select("hub").distinct().join(sets.select(F.col("doc_id").alias("hub"), F.col("prefix").alias("_h")), "hub")
    both = pairs.join(sets.select("doc_id", "prefix"), "doc_id").join(broadcast_if_small(written(hubs, "hubs")), "hub")
    return written(both.select("hub", "doc_id", "prefix", "_h").mapInArrow(_overlap, "hub long, doc_id long, d double, link int"), "compared")


def star_rounds(lists: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Links that give the components of all links among documents that share a list of (token, doc_id, apart).

    Each round compares the members of a list with its centre, the member with the least of its own, and joins the
    components found so far. Done with are the centre, lists of one component, and members of a star that lie so near its
    centre that no member of another component can be in their reach.
    """
    out = None
    for k in range(ROUNDS + 1):
        heads = lists.groupBy("token").agg(F.min(F.struct("apart", "doc_id")).alias("h"), F.count("*").alias("m")).filter("m > 1")
        heads = heads.select("token", F.col("h.doc_id").alias("hub"), "m")
        left = heads.agg(F.count("*").alias("n"), F.sum("m").alias("rows"), F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("pairs")).first()
        if not left.n:
            return out
        last = k == ROUNDS or left.pairs <= 4 * left.rows
        if last:
            a = lists.join(heads.select("token"), "token")
            pairs = a.select("token", F.col("doc_id").alias("hub")).join(a, "token").filter("hub < doc_id").select("hub", "doc_id").distinct()
        else:
            entries = lists.join(heads.select("token", "hub"), "token").filter("doc_id <> hub")
            pairs = entries.select("hub", "doc_id").distinct()
        d = compared(pairs, sets)
        found = d.filter("link = 1").select(F.col("hub").alias("a"), F.col("doc_id").alias("b"))
        out = found if out is None else out.unionByName(found)
        if last:
            return out
        roots = written(connected_components(out, "stars"), "stars")
        label = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
        known = entries.join(d, ["hub", "doc_id"]).join(label("doc_id"), "doc_id", "left").join(label("hub"), "hub", "left")
        known = known.withColumn("own", F.coalesce("doc_id_root", "doc_id")).withColumn("other", F.col("own") != F.coalesce("hub_root", "hub"))
        fringe = known.filter(F.col("other") & (F.col("d") <= 0.4 + EPS)).groupBy("token").agg(F.min("d").alias("nearest"))
        keep = (F.col("link") == 0) | (F.col("d") >= F.col("nearest") - 0.2 - EPS)
        rest = written(known.join(fringe, "token", "left").filter(keep).select("token", "doc_id", "apart", "own"), "lists")
        mixed = rest.groupBy("token").agg(F.min("own").alias("x"), F.max("own").alias("y")).filter("x < y").select("token")
        lists = written(rest.join(mixed, "token").select("token", "doc_id", "apart"), "lists")
    return out


def set_links(docs: DataFrame, survivors: DataFrame) -> DataFrame | None:
    """Links (a, b) among the documents in survivors (doc_id): those of a spanning structure of each component."""
    sets = written(shingled(docs.select("doc_id", "text").join(broadcast_if_small(survivors), "doc_id"), whole=True).select("doc_id", "n", "prefix"), "sets")
    size = sets.agg(F.count("*").alias("docs"), F.sum("n").alias("tokens")).first()
    if not size.docs:
        return None
    lists = written(postings(sets, size.docs, size.tokens), "postings")
    heads = lists.groupBy("token").agg(F.min("doc_id").alias("a"), F.count("*").alias("m")).filter("m > 1")
    edges = lists.join(heads, "token").select("a", F.col("doc_id").alias("b")).filter("a <> b").distinct()
    groups = connected_components(edges, "candidates")
    groups = groups.withColumnRenamed("node", "doc_id").join(sets.select("doc_id", "n"), "doc_id")
    sizes = groups.groupBy("root").agg(F.sum("n").alias("size"))
    groups = written(groups.join(sizes, "root"), "groups")
    small = sets.join(groups.filter(F.col("size") <= LOCAL_TOKENS).select("doc_id", "root"), "doc_id")
    deal = F.pmod(F.xxhash64("root"), F.lit(deals(size.docs, size.tokens) + int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    found = small.withColumn("deal", deal).groupBy("deal").applyInPandas(_settle_groups, "a long, b long")
    large = groups.filter(F.col("size") > LOCAL_TOKENS).select("doc_id")
    rounds = star_rounds(written(lists.join(large, "doc_id", "left_semi"), "large"), sets)
    return found if rounds is None else found.unionByName(rounds)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id): class_id is the smallest doc_id with an equal set."""
    base = written(shingled(docs), "shingles")
    whole = base.filter("n > 0 and doc_id is not null")
    classes = whole.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("class_id"))
    thin = base.select("doc_id", "n", "h1", "h2").join(classes, ["h1", "h2", "n"], "left")
    members = written(thin.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id")), "members")
    total = base.agg(F.sum(F.length("prefix") / 8).alias("t")).first().t or 0
    counts = shared_counts(whole.select("doc_id", "prefix"), int(total))
    need = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * 4 / 5) / 8))
    survivors = counts.join(members.filter("doc_id = class_id"), "doc_id").filter(F.col("shared") >= need).select("doc_id").distinct()
    edges = set_links(docs, written(survivors, "survivors"))
    if edges is None:
        return members.select("doc_id", F.col("n").alias("n_shingles"), "class_id", F.col("class_id").alias("component_id"))
    roots = connected_components(written(edges, "links"), "components").withColumnRenamed("node", "class_id")
    joined = members.join(roots, "class_id", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("root", "class_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with the document of the smallest doc_id of each component only (of rows of that doc_id, all)."""
    rest = jaccard_components(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    copies = broadcast_if_small(written(rest, "copies"))
    release(docs.sparkSession)  # sets are done with
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)
