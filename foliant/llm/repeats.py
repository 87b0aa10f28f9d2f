"""Suffix-array dedup: bytes covered by strings of LENGTH bytes that also start elsewhere, over all whole texts.

A suffix array of the whole corpus is not needed, only the parts of it in which repeats of LENGTH bytes can be:

* Anchors. Every window of LENGTH bytes has its smallest hashed GRAM-byte string as an anchor; equal windows have equal
  anchors in equal places, so a repeated window has one that occurs at least twice. Anchors that do not are dropped.
* Contexts. What any window through an anchor can reach is its context, LENGTH - GRAM bytes before it and LENGTH from it.
  Where a context occurs twice as a whole, every window through the anchor is repeated, and its hash settles it.
* Suffix arrays. The other contexts of repeated anchors are dealt out by anchor. In each block the suffixes at the anchors are
  sorted, with common prefix lengths; a scan with a stack gives the tree of common-prefix intervals. In each
  interval, the members' left contexts say how far each can be extended to the left along with another member (left
  diversity: members that all extend alike make no repeat of their own). Prefix and extension together of LENGTH or
  more are a maximal repeat, with all its occurrences.
* An anchor with very many different contexts (HOT in one batch) is not gathered: its windows are hashed one by one, and
  counted with a sum per batch before anything moves.

Equal texts are treated as one text that occurs several times. Texts are told apart by 128 bits of hashes, contexts by the hashes of their anchor and of
their whole, windows through hot anchors by 64 bits; contexts that are compared in suffix arrays are compared byte by byte.

Defined cases: a null text counts as empty: 0 bytes, nothing removed, the SHA-256 of nothing. Texts under LENGTH bytes lose
nothing. Rows of equal doc_id are texts of their own, each with its row. Very long texts are read in pieces that overlap. Other columns are not read, whatever
they are called, and an empty table gives an empty result. A ValueError ends the job if more than MOST_SHARED pairs of texts share a 64-bit hash by chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUES, SLICE_BYTES, U64, broadcast_if_small, mix, powers, shipped, slices, task_lot, text_bytes, utf8, written

LENGTH, GRAM = 200, 50
BEFORE = LENGTH - GRAM
#: Different contexts of one anchor in one batch from which on it is hot.
HOT = 64
#: Anchors or contexts in one block, about.
BLOCK_ANCHORS, BLOCK_CONTEXTS = 1_000_000, 20_000
UNIQUE, SETTLED, SEND, WINDOWS = 0, 1, 2, 3
#: Seed of the second hash of a text; texts that may share the first (chance gives some 270 among 10**11 texts).
SECOND, MOST_SHARED = 99, 10_000


# --- enhanced suffix arrays ----------------------------------------------------------------------------------------


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Of all suffixes, by prefix doubling."""
    n, step = len(text), 1
    rank = text.astype(np.int64) + 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:]
        order = np.lexsort((after, rank))
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum((rank[order[1:]] != rank[order[:-1]]) | (after[order[1:]] != after[order[:-1]]))
        rank = new + 1
        step *= 2
        if step >= n or (n and rank.max() == n):
            return order


def common_prefixes(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Common prefix length of each row with the one before it (0 for the first); rows are padded to equal width."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        out[1:] = np.minimum(first, np.minimum(lengths[1:], lengths[:-1]))
    return out


def intervals(lcp: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(prefix length, first, last) of every interval of two or more suffixes, inner ones first: a scan with a stack."""
    stack = [(0, 0)]
    for i in range(1, len(lcp) + 1):
        now, left = (int(lcp[i]) if i < len(lcp) else -1), i - 1
        while stack and now < stack[-1][0]:
            length, left = stack.pop()
            yield length, left, i - 1
        if now >= 0 and (not stack or now > stack[-1][0]):
            stack.append((now, left))


def maximal_repeats(texts: list[bytes], least: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, all its occurrences as (text, place)) of every maximal repeat of at least ``least`` bytes in small texts."""
    codes = np.concatenate([np.append(np.frombuffer(x, np.uint8).astype(np.int64) + len(texts), i) for i, x in enumerate(texts)] or [np.zeros(0, np.int64)])
    if not len(codes):
        return []
    owner = np.repeat(np.arange(len(texts)), [len(x) + 1 for x in texts])
    begin = np.concatenate(([0], np.cumsum([len(x) + 1 for x in texts])))
    order = suffix_array(codes)
    lcp = np.zeros(len(order), np.int64)
    for i in range(1, len(order)):
        a, b, k = order[i - 1], order[i], 0
        while a + k < len(codes) and b + k < len(codes) and codes[a + k] == codes[b + k]:
            k += 1
        lcp[i] = k
    out = []
    for length, i, j in intervals(lcp):
        if length >= max(1, least):
            own = np.sort(order[i : j + 1])
            left = {int(codes[p - 1]) if p and owner[p - 1] == owner[p] else -1 - int(p) for p in own}
            if len(left) > 1:
                out.append((length, [(int(owner[p]), int(p - begin[owner[p]])) for p in own]))
    return sorted(out)


def extents(lcp: np.ndarray, left_rank: np.ndarray, lcs: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """How far left and right of its anchor each member is covered by repeats of ``length`` (0, 0: not at all).

    lcp: of the members in suffix order. left_rank: their places in the order of left contexts read backwards. lcs: common
    lengths of neighbours in that order.
    """
    m = len(lcp)
    left, right, lcs = np.zeros(m, np.int64), np.zeros(m, np.int64), np.append(lcs, 0)
    for common, i, j in intervals(lcp):
        rank = left_rank[i : j + 1]
        by = np.argsort(rank)
        near = np.minimum.reduceat(lcs, rank[by] + 1)[:-1]  # of neighbours in the order of left contexts
        most = np.maximum(np.append(near, 0), np.append(0, near))
        own = i + by
        good = most + common >= length
        left[own] = np.where(good, np.maximum(left[own], most), left[own])
        right[own] = np.where(good, np.maximum(right[own], common), right[own])
    return left, right


# --- anchors -------------------------------------------------------------------------------------------------------


def sliding(x: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    """f over every w neighbours of x, by prefixes and suffixes of blocks of w."""
    n = len(x)
    pad = (-n) % w
    blocks = np.concatenate([x, np.full(pad, x[-1])]).reshape(-1, w)
    ahead = f.accumulate(blocks, axis=1).ravel()
    behind = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(behind[: n - w + 1], ahead[w - 1 : n])


class Hashes:
    """Hashes of any substring of some texts, laid end to end."""

    def __init__(self, texts: list[bytes]):
        self.buf = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum([len(x) for x in texts])
        up, self.down = powers(len(self.buf) + 1)
        self.sums = np.zeros(len(self.buf) + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum(BYTE_VALUES[self.buf] * up[: len(self.buf)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[stop] - self.sums[start]) * self.down[start])


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash, hash of context) of the anchors of all windows of all texts."""
    h, n = Hashes(texts), sum(map(len, texts))
    if n < LENGTH:
        return (*[np.zeros(0, np.int64)] * 2, *[np.zeros(0, U64)] * 2)
    grams = h.of(np.arange(n - GRAM + 1), np.arange(GRAM, n + 1)) | U64(1)
    low = sliding(grams, BEFORE + 1, np.minimum)
    sizes = np.diff(np.concatenate(([0], h.ends)))
    for end, size in zip(h.ends, sizes):  # windows that begin in a text and end behind it
        low[max(end - size, end - LENGTH + 1) : end] = 0
    seen = np.concatenate([np.zeros(BEFORE, U64), low, np.zeros(BEFORE, U64)])
    at = np.flatnonzero(sliding(seen, BEFORE + 1, np.maximum)[: len(grams)] == grams)
    text = np.searchsorted(h.ends, at, side="right")
    begin = h.ends[text] - sizes[text]
    lo, hi = np.maximum(at - BEFORE, begin), np.minimum(at + LENGTH, h.ends[text])
    with np.errstate(over="ignore"):
        context = mix(h.of(lo, hi) ^ ((at - lo).astype(U64) << U64(32)) ^ (hi - at).astype(U64))
    return text, at - begin, grams[at], context


def anchors_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of one text of any length, piece by piece."""
    found, step = [], SLICE_BYTES
    for a in range(0, len(text), step):
        lo, hi = max(0, a - 2 * LENGTH), min(len(text), a + step + 2 * LENGTH)
        _, at, gram, context = anchors([text[lo:hi]])
        at = at + lo
        own = (at >= a) & (at < a + step)
        found.append((at[own], gram[own], context[own]))
    return tuple(np.concatenate(x) for x in zip(*found))


def batch_anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    out = []
    for a, b in slices(texts):
        if len(texts[a]) > SLICE_BYTES:
            at, gram, context = anchors_of(texts[a])
            out.append((np.full(len(at), a), at, gram, context))
        else:
            text, *rest = anchors(texts[a:b])
            out.append((text + a, *rest))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (*[np.zeros(0, np.int64)] * 2, *[np.zeros(0, U64)] * 2)


# --- which anchors and contexts are repeated -----------------------------------------------------------------------

ANCHORS = "block int, grams binary, contexts binary, owners binary, places binary, flags binary"
MARKS = "owner long, place int, state int"
MANY, MARKER = 1, 2


def _pack(*columns: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(c).tobytes() for c in columns]


def _dealt(block: np.ndarray, n_blocks: int, columns: list[np.ndarray]) -> Iterator[tuple]:
    order = np.argsort(block, kind="stable")
    ends = np.cumsum(np.bincount(block, minlength=n_blocks))
    columns = [c[order] for c in columns]
    for i, (a, b) in enumerate(zip(np.concatenate(([0], ends[:-1])), ends)):
        if b > a:
            yield i, *_pack(*[c[a:b] for c in columns])


def _record_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    s = pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in schema.split(", "))])
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * len(s), s.types)], schema=s)


def _anchor_blocks(n_blocks: int):
    """Per batch, each (anchor, context) once; a context that the batch has several times is settled there, and a hot
    anchor's contexts are marked for window hashes there. Blocks under 0 hold what is decided, by task and batch in turn: owners,
    places, states."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(batches, task_lot()):
            all_keys, all_texts = batch.column(0).to_pylist(), utf8(batch.column(1))
            copies: dict[int, int] = {}
            for key in all_keys:
                copies[key] = copies.get(key, 0) + 1
            own = {key: x for key, x in zip(all_keys, all_texts) if len(x) >= LENGTH}
            keys, texts = np.array(list(own), np.int64), list(own.values())
            text, place, gram, context = batch_anchors(texts)
            if not len(text):
                continue
            times = np.array([copies[x] for x in own])[text]
            order = np.lexsort((context, gram))
            text, place, gram, context, times = text[order], place[order], gram[order], context[order], times[order]
            new_gram = np.concatenate(([True], gram[1:] != gram[:-1]))
            new = new_gram | np.concatenate(([True], context[1:] != context[:-1]))
            cls = np.cumsum(new) - 1
            many = np.bincount(cls, weights=times)[cls] > 1
            rows = [(-1 - k % n_blocks, b"", b"", *_pack(keys[text[many]], place[many].astype(np.int32), np.full(int(many.sum()), SETTLED, np.int8)))] if many.any() else []
            group = (np.cumsum(new_gram) - 1)[new]
            hot = np.bincount(group)[group] >= HOT
            text, place, gram, context, many = text[new], place[new], gram[new], context[new], many[new]
            if hot.any():
                rows.append((-1 - (k + 1) % n_blocks, b"", b"", *_pack(keys[text[hot]], place[hot].astype(np.int32), np.full(int(hot.sum()), WINDOWS, np.int8))))
            first = np.concatenate(([True], group[1:] != group[:-1]))
            go = ~hot | first
            flags = np.where(hot, MARKER, np.where(many, MANY, 0)).astype(np.int8)[go]
            columns = [gram[go], context[go], keys[text[go]], place[go].astype(np.int32), flags]
            rows += _dealt((gram[go] % U64(n_blocks)).astype(np.int64), n_blocks, columns)
            yield _record_batch(rows, ANCHORS)

    return run


def _repeated(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one block: the anchors that are repeated, and what is to be done with each."""
    join = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in pdf[name]])
    owner, place, flag = join("owners", np.int64), join("places", np.int32), join("flags", np.int8)
    if key[0] < 0:
        return pd.DataFrame({"owner": owner, "place": place, "state": flag.astype(np.int32)})
    gram, context = join("grams", U64), join("contexts", U64)
    order = np.lexsort((context, gram))
    gram, context, owner, place, flag = gram[order], context[order], owner[order], place[order], flag[order]
    new_gram = np.concatenate(([True], gram[1:] != gram[:-1]))
    new = new_gram | np.concatenate(([True], context[1:] != context[:-1]))
    group, cls = np.cumsum(new_gram) - 1, np.cumsum(new) - 1
    marker = flag == MARKER
    classes = np.bincount(group[new])[group]
    hot = (np.bincount(group, weights=marker) > 0)[group]
    twice = (np.bincount(cls, weights=~marker) > 1)[cls] & ~marker
    send = new & ((classes > 1) | hot) & ~marker
    # a marker may stand before entries of its class: the first that is none stands for the class
    lone = hot & ~marker & ~new & np.concatenate(([False], marker[:-1])) & (cls == np.concatenate(([-1], cls[:-1])))
    send |= lone
    parts = [(owner[twice], place[twice], np.full(int(twice.sum()), SETTLED)), (owner[send], place[send], np.where(hot[send], WINDOWS, SEND))]
    return pd.DataFrame({n: np.concatenate(x) for n, x in zip(("owner", "place", "state"), zip(*parts))})


# --- contexts that have to be compared -----------------------------------------------------------------------------

CONTEXTS = "block int, gram long, owner long, place int, behind binary, ahead binary"


def _contexts(n_blocks: int):
    """(key, text, places to send) to contexts; the part before the anchor is read backwards. Once a task for each text."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            rows = []
            for key, text, places in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist()):
                if key in sent or not places:
                    continue
                if len(sent) > 1_000_000:
                    sent.clear()
                sent.add(key)
                for p in places:
                    gram = hash_of(text[p : p + GRAM])
                    rows.append((gram % n_blocks, gram - (1 << 63), key, p, text[max(0, p - BEFORE) : p][::-1], text[p : p + LENGTH]))
                if len(rows) > 10_000:
                    yield _record_batch(rows, CONTEXTS)
                    rows = []
            yield _record_batch(rows, CONTEXTS)

    return run


def hash_of(gram: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(gram, digest_size=8).digest(), "big")


def _matrix(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in parts), np.uint8).reshape(-1, width), np.array([len(x) for x in parts])


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one block of contexts: (owner, lo, hi) covered by repeats, by the suffix array at its anchors."""
    gram, owner, place, behind, ahead = (pdf[c].tolist() for c in ("gram", "owner", "place", "behind", "ahead"))
    order = sorted(range(len(gram)), key=lambda i: (gram[i], ahead[i]))
    lcp = common_prefixes(*_matrix([ahead[i] for i in order], LENGTH))
    by_left = sorted(range(len(order)), key=lambda j: (gram[order[j]], behind[order[j]]))
    lcs = common_prefixes(*_matrix([behind[order[j]] for j in by_left], BEFORE))
    rank = np.empty(len(order), np.int64)
    rank[by_left] = np.arange(len(order))
    g = np.array([gram[i] for i in order])
    edges = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True])))
    left, right = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a == 2:
            l, r = lcs[a + 1], lcp[a + 1]
            if l + r >= LENGTH:
                left[a:b], right[a:b] = l, r
        elif b - a > 2:
            l, r = lcs[a:b].copy(), lcp[a:b].copy()
            l[0] = r[0] = 0
            left[a:b], right[a:b] = extents(r, rank[a:b] - a, l)
    hit = right > 0
    p, o = np.array([place[i] for i in order]), np.array([owner[i] for i in order])
    return pd.DataFrame({"owner": o[hit], "lo": p[hit] - left[hit], "hi": p[hit] + right[hit]})


# --- hot anchors ---------------------------------------------------------------------------------------------------

WINDOW_BLOCKS = "block int, tokens binary, owners binary, places binary"


def _window_blocks(n_blocks: int):
    """Hashes of all windows through the hot anchors of each text; those that a batch has twice, or of a text that it has
    in several rows, are decided there."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(batches, task_lot()):
            tokens, owners, starts, times = [], [], [], []
            all_keys = batch.column(0).to_pylist()
            copies: dict[int, int] = {}
            for key in all_keys:
                copies[key] = copies.get(key, 0) + 1
            own = {key: (x, p) for key, x, p in zip(all_keys, utf8(batch.column(1)), batch.column(2).to_pylist()) if p}
            for key, (text, places) in own.items():
                s = np.unique(np.concatenate([np.arange(max(0, p - BEFORE), min(p, len(text) - LENGTH) + 1) for p in places]))
                lo, hi = int(s[0]), int(s[-1]) + LENGTH
                tokens.append(Hashes([text[lo:hi]]).of(s - lo, s - lo + LENGTH))
                owners.append(np.full(len(s), key))
                starts.append(s)
                times.append(np.full(len(s), copies[key]))
            if not tokens:
                continue
            tokens, owners, starts, times = np.concatenate(tokens), np.concatenate(owners), np.concatenate(starts).astype(np.int32), np.concatenate(times)
            order = np.argsort(tokens, kind="stable")
            tokens, owners, starts, times = tokens[order], owners[order], starts[order], times[order]
            new = np.concatenate(([True], tokens[1:] != tokens[:-1]))
            count = np.add.reduceat(times, np.flatnonzero(new))
            many = count[np.cumsum(new) - 1] > 1
            rows = [(-1 - k % n_blocks, b"", *_pack(owners[many], starts[many]))] if many.any() else []
            starts[new] = np.where(count > 1, -1, starts[new])  # decided here: no owner need hear of it
            rows += _dealt((tokens[new] % U64(n_blocks)).astype(np.int64), n_blocks, [tokens[new], owners[new], starts[new]])
            yield _record_batch(rows, WINDOW_BLOCKS)

    return run


def _repeated_windows(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    owner = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["owners"]])
    start = np.concatenate([np.frombuffer(x, np.int32) for x in pdf["places"]])
    if key[0] >= 0:
        tokens = np.concatenate([np.frombuffer(x, U64) for x in pdf["tokens"]])
        _, at, count = np.unique(tokens, return_inverse=True, return_counts=True)
        hit = (count[at] > 1) & (start >= 0)
        owner, start = owner[hit], start[hit]
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order]
    run = np.concatenate(([True], (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1))) if len(owner) else np.zeros(0, bool)
    first = np.flatnonzero(run)
    last = (np.append(first[1:], len(owner)) - 1)[: len(first)]
    return pd.DataFrame({"owner": owner[first], "lo": start[first].astype(np.int64), "hi": start[last].astype(np.int64) + LENGTH})


# --- all together --------------------------------------------------------------------------------------------------


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, owner, text): owner is a 64-bit hash of the text. Texts that share it by chance, as a second hash of the same width tells, have
    both hashes mixed instead, so that texts are told apart by 128 bits."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("owner"), F.xxhash64(F.lit(SECOND), text).alias("_second"), text.alias("text"))
    shared = rows.groupBy("owner").agg(F.min("_second").alias("a"), F.max("_second").alias("b")).filter("a <> b").select("owner").limit(MOST_SHARED + 1).collect()
    if len(shared) > MOST_SHARED:
        raise ValueError("too many texts share a 64-bit hash")
    mixed = F.xxhash64("owner", "_second")
    owner = F.when(F.col("owner").isin([r.owner for r in shared]), mixed).otherwise(F.col("owner")) if shared else F.col("owner")
    return rows.select("doc_id", owner.alias("owner"), "text")


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(owner, spans) of :func:`keyed`: for each text the parts [lo, hi) of repeats found in it; they may overlap and pass its end."""
    spark = texts.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = max(least, text_bytes(texts) // 76 // BLOCK_ANCHORS + 1)
    blocks = texts.select("owner", "text").mapInArrow(_anchor_blocks(n_blocks), ANCHORS)
    marks = written(blocks.groupBy("block").applyInPandas(_repeated, MARKS), "anchors")
    spans = marks.filter(F.col("state") == SETTLED).select("owner", (F.col("place") - BEFORE).cast("long").alias("lo"), (F.col("place") + LENGTH).cast("long").alias("hi"))
    wanted = marks.filter(F.col("state") >= SEND).groupBy("owner").agg(
        F.array_sort(F.collect_set(F.when(F.col("state") == SEND, F.col("place")))).alias("send"),
        F.array_sort(F.collect_set(F.when(F.col("state") == WINDOWS, F.col("place")))).alias("windows"),
    )
    wanted = broadcast_if_small(written(wanted, "wanted"))
    count = marks.groupBy("state").count().collect()
    n_send, n_hot = (sum(r["count"] for r in count if r["state"] == s) for s in (SEND, WINDOWS))
    asked = texts.select("owner", "text").join(wanted, "owner")
    n_blocks = max(least, n_send // BLOCK_CONTEXTS + 1)
    contexts = asked.select("owner", "text", "send").mapInArrow(_contexts(n_blocks), CONTEXTS)
    spans = spans.unionByName(contexts.groupBy("block").applyInPandas(_compare, "owner long, lo long, hi long"))
    if n_hot:
        n_blocks = max(least, n_hot * BEFORE // BLOCK_ANCHORS + 1)
        windows = asked.select("owner", "text", "windows").mapInArrow(_window_blocks(n_blocks), WINDOW_BLOCKS)
        spans = spans.unionByName(windows.groupBy("block").applyInPandas(_repeated_windows, "owner long, lo long, hi long"))
    listed = spans.groupBy("owner").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))
    return listed.mapInArrow(_joined, "owner long, spans array<struct<lo:long,hi:long>>")


def merged(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Maximal runs of sorted spans within 0 to size; touching ones are one."""
    out: list[list[int]] = []
    for lo, hi in spans:
        lo, hi = max(0, lo), min(size, hi)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        elif hi > lo:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


SPANS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def _joined(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = [[{"lo": a, "hi": b} for a, b in merged([(x["lo"], x["hi"]) for x in own], 1 << 62)] for own in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, SPANS)], ["owner", "spans"])


def _cut(texts: bool):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist()):
                runs = merged([(x["lo"], x["hi"]) for x in spans or ()], len(text))
                kept, at = [], 0
                for lo, hi in runs:
                    kept.append(text[at:lo])
                    at = hi
                kept = b"".join([*kept, text[at:]])
                row = (doc_id, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())
                rows.append((*row, kept, [{"lo": a, "hi": b} for a, b in runs]) if texts else row)
            types = [pa.int64()] * 4 + [pa.string()] + ([pa.binary(), SPANS] if texts else [])
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"][: len(types)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * len(types), types)], names)

    return run


def cut_repeats(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with ``texts`` also the bytes kept and the spans removed."""
    own = keyed(shipped(docs))
    spans = broadcast_if_small(written(repeated_spans(own), "spans"))
    more = ", kept binary, spans array<struct<lo:long,hi:long>>" if texts else ""
    joined = own.join(spans, "owner", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut(texts), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}")
