"""Token-ID output as a content-addressed store.

Documents are encoded to ids, an end id closes each. A rolling hash over the ids cuts the stream of a document into
chunks; each distinct chunk is stored once, under the digest of its ids; a document is a recipe, the list of its chunks.
Recipes stand in ascending doc_id order with the place of the document in the whole id stream. A manifest holds, for each run of
recipes, the root of a Merkle tree over them, and a root over those. Reading recomputes every digest and every root.

Files under the store's path (Parquet): ``objects/kind=0`` chunks (digest, ids as little-endian unsigned 16-bit or, for
vocabularies over 65536, 32-bit integers); ``recipes`` (doc_id, start, chunks: digest and number of ids); ``manifest``; ``layout`` (the
width of ids).

A chunk leaves a task once at most, and chunks are dealt by digest, so a text that a third of all documents repeat costs
one chunk a task. Verification moves no ids: the CRC of a document is put together from the CRCs of its chunks.

Defined cases: a null text is empty and has the end id alone. Strings of special tokens in a text become their ids, as the library's
plain call has it, or are ordinary text with ``special=False``. Repeated rows are documents of their own, one after the other. A very long text
is encoded whole and has as many chunks as it needs. Other columns are not read. An empty table gives an empty store with a manifest
root over nothing.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain
from unicodedata import category

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, _mixed, mix, powers, release, shipped, slices, state, utf8

END_ID = 0
WINDOW, LEAST, MOST, MASK = 16, 64, 4096, 511
#: Pieces whose ids a Python worker keeps, if they have at most LONG characters; chunks that a task remembers having sent.
CACHED, LONG, REMEMBERED = 500_000, 32, 300_000
RECIPES_PER_RUN = 200_000
DIGEST = 16
#: Fixed value: the pre-tokenizer's pattern. Of characters of :func:`usual` kinds, re's classes are the pattern's own.
PIECES = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Fixed value: the pre-tokenizer with that pattern, as tokenizer files name it.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def usual(c: str) -> bool:
    """Whether a character is a letter, a decimal digit, or neither of these nor a number, to re and to the pattern alike."""
    return not "\x1c" <= c <= "\x1f" and (not c.isnumeric() or c.isdecimal() or c.isalpha() and not category(c).startswith("N"))


LETTER, DIGIT, OTHER, SPACE, UNUSUAL, END, UNKNOWN = range(7)


def kind_of(c: str) -> int:
    return UNUSUAL if not usual(c) else SPACE if c.isspace() else DIGIT if c.isdecimal() else LETTER if c.isalnum() else OTHER


def piece_starts(code: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where the pieces of :data:`PIECES` begin in texts of usual characters (END behind each text, a piece of its own)."""
    before, after = np.concatenate(([END], kind[:-1])), np.append(kind[1:], END)
    start = (kind != before) | (kind == END) | (kind == SPACE) & (after < SPACE)  # the last white space before something else
    start[1:] &= (code[:-1] != 32) | (kind[1:] >= SPACE)  # a blank goes with what follows it
    q = np.flatnonzero((code == 39) & start & (kind != before) & (after == LETTER))
    a, b = code[q + 1], code[np.minimum(q + 2, len(code) - 1)]
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
    start[q[one | two] + 1] = False
    beyond = np.concatenate((q[one] + 2, q[two] + 3))
    start[beyond] |= kind[beyond] == LETTER
    return np.flatnonzero(start)


class Table:
    """Numbers by keys of two 64-bit words, the second never 0: open addresses in arrays, asked for many keys at once."""

    BITS = 20

    def __init__(self):
        self.words, self.numbers = np.zeros((2, 1 << self.BITS), U64), np.zeros(1 << self.BITS, np.int32)

    def _places(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(low ^ high * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.BITS)).astype(np.int64)

    def get(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The numbers of the keys, -1 for those that are not there."""
        out, left, at = np.full(len(low), -1, np.int64), np.arange(len(low)), self._places(low, high)
        while len(left):
            there = self.words[1][at]
            same = (there == high[left]) & (self.words[0][at] == low[left])
            out[left[same]] = self.numbers[at[same]]
            further = ~same & (there != 0)
            left, at = left[further], (at[further] + 1) & ((1 << self.BITS) - 1)
        return out

    def add(self, low: np.ndarray, high: np.ndarray, numbers: np.ndarray) -> None:
        """Of distinct keys that are not there."""
        left, at = np.arange(len(low)), self._places(low, high)
        while len(left):
            free = np.flatnonzero(self.words[1][at] == 0)
            put = free[np.unique(at[free], return_index=True)[1]]
            self.words[0][at[put]], self.words[1][at[put]], self.numbers[at[put]] = low[left[put]], high[left[put]], numbers[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << self.BITS) - 1)


#: Bytes of a piece that is its own key in a :class:`Table`: these, and their number in the last byte.
SHORT = 15
_LOWEST = np.array([(1 << (8 * i)) - 1 for i in range(9)], U64)


class Encoder:
    """Ids of whole texts by the tokenizers library, with a cache of pieces.

    Merges never cross the pieces that the pre-tokenizer cuts a text into, so each distinct piece needs encoding once. Texts with a special
    token's string or an unusual character are encoded whole, and so is every text if the tokenizer cuts in another way. Pieces are cut and
    looked up as arrays, all of some texts at once; only new and long ones become strings.
    """

    def __init__(self, path: str, special: bool = True):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cutter = cutter = self.tokenizer.pre_tokenizer
        self.by_lines = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        own = json.loads(cutter.__getstate__()) if cutter else {}
        plain = self.tokenizer.normalizer is None and not getattr(self.tokenizer.model, "dropout", None)
        self.cuts = plain and {k: own.get(k) for k in BYTE_LEVEL} == BYTE_LEVEL
        named = [x.content for x in self.tokenizer.get_added_tokens_decoder().values() if special or not x.special]
        self.named = re.compile("|".join(map(re.escape, named))) if named else None
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)  # of characters
        self.short, self.long, self.kept = Table(), {}, 0  # pieces to their places in begin and lengths; how many there are
        self.flat, self.begin, self.lengths = array("I", [END_ID]), array("q", [0]), array("q", [1])
        newline = self._whole(["\n"])[0]
        self.newline = int(newline[0]) if len(newline) == 1 else None

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _lines(self, pieces: list[str]) -> np.ndarray:
        """Ids of pieces as the lines of one text, each encoded as it is."""
        self.tokenizer.pre_tokenizer = self.by_lines
        try:
            return self._whole(["\n".join(pieces)])[0]
        finally:
            self.tokenizer.pre_tokenizer = self.cutter

    def _encoded(self, kind: int, pieces: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, number of ids of each piece) of pieces of one kind. Those that are no white space are encoded as the lines of one text: a
        newline is a piece of its own there, with an id that nothing else has."""
        for a in range(0, len(pieces), 4096):
            own = pieces[a : a + 4096]
            if kind in (0, 2) and self.newline is not None:
                ids = self._lines(own)
                ends = np.append(np.flatnonzero(ids == self.newline), len(ids))
                yield ids[ids != self.newline], np.diff(ends, prepend=-1) - 1
            else:
                each = self._whole([x[0] if isinstance(x, tuple) else x for x in own])
                yield np.concatenate(each), np.array([len(x) for x in each])

    def _learn(self, pieces: list) -> dict:
        """Places of new pieces. The first CACHED short ones stay; the others are there for one call."""
        kinds: list[list] = [[], [], [], [], []]  # short, short white space, long, long white space, texts to be encoded as they are
        for p in pieces:
            kinds[4 if type(p) is tuple else 2 * (len(p) > LONG) + p.isspace()].append(p)
        kept = max(0, min(len(kinds[0]) + len(kinds[1]), CACHED - self.kept))
        pieces = list(chain.from_iterable(kinds))
        found = dict(zip(pieces, range(len(self.begin), len(self.begin) + len(pieces))))
        for ids, lengths in chain.from_iterable(self._encoded(k, own) for k, own in enumerate(kinds)):
            self.begin.frombytes((len(self.flat) + np.cumsum(lengths) - lengths).astype(np.int64).tobytes())
            self.lengths.frombytes(lengths.astype(np.int64).tobytes())
            self.flat.frombytes(ids.tobytes())
        self.kept += kept
        staying = [(p.encode(), found[p]) for p in pieces[:kept]]
        self.long.update((p, at) for p, at in staying if len(p) > SHORT)
        keys = np.frombuffer(b"".join(p.ljust(SHORT, b"\0") + bytes([len(p)]) for p, _ in staying if len(p) <= SHORT), "<u8").reshape(-1, 2)
        self.short.add(keys[:, 0], keys[:, 1], np.array([at for p, at in staying if len(p) <= SHORT], np.int32))
        return found

    def _characters(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """UTF-8 of the texts with a character more behind each; code points; their kinds."""
        joined = "\0".join([*texts, ""])
        code = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        kind = self.kinds[code]
        if (unknown := kind == UNKNOWN).any():
            for c in np.unique(code[unknown]).tolist():
                self.kinds[c] = kind_of(chr(c))
            kind = self.kinds[code]
        kind[np.cumsum([len(x) + 1 for x in texts], dtype=np.int64) - 1] = END
        return joined.encode(), code, kind

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by the end id, and the number of ids of each text."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, int)
        whole = {i for i, x in enumerate(texts) if not self.cuts or self.named and self.named.search(x)}
        cut = ["" if i in whole else x for i, x in enumerate(texts)]
        data, code, kind = self._characters(cut)
        if len(odd := np.flatnonzero(kind == UNUSUAL)):
            whole.update(np.searchsorted(np.flatnonzero(kind == END), odd).tolist())
            data, code, kind = self._characters(["" if i in whole else x for i, x in enumerate(texts)])
        starts = piece_starts(code, kind)
        ends = np.flatnonzero(kind[starts] == END)
        buf = np.frombuffer(data + bytes(16), np.uint8)
        first = np.flatnonzero((buf[: len(data)] & 0xC0) != 0x80)[starts]
        n = np.diff(first, append=len(data))
        words = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
        low, high = words[first] & _LOWEST[np.minimum(n, 8)], words[first + 8] & _LOWEST[np.clip(n - 8, 0, 7)] | n.astype(U64) << U64(56)
        at, long = np.full(len(n), -1, np.int64), n > SHORT
        at[~long] = self.short.get(low[~long], high[~long])
        for i in np.flatnonzero(long).tolist():
            at[i] = self.long.get(data[first[i] : first[i] + n[i]], -1)
        at[ends] = 0  # slot 0: the end id
        lacking = np.flatnonzero(at < 0)
        new = [data[a:b].decode() for a, b in zip(first[lacking].tolist(), (first + n)[lacking].tolist())]
        if new or whole:
            found = self._learn([*dict.fromkeys(new), *dict.fromkeys((texts[i],) for i in sorted(whole))])
            at[lacking] = [found[p] for p in new]
            more = np.array(sorted(whole), np.int64)
            at = np.insert(at, ends[more], [found[texts[i],] for i in more.tolist()])
            ends = ends + np.searchsorted(more, np.arange(len(ends)), side="right")
        sizes = np.frombuffer(self.lengths, np.int64)[at]
        place = np.repeat(np.frombuffer(self.begin, np.int64)[at] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        out = np.frombuffer(self.flat, np.uint32)[place], np.add.reduceat(sizes, np.concatenate(([0], ends[:-1] + 1)))
        kept = 1 + self.kept
        if kept < len(self.begin):
            del self.flat[self.begin[kept] :], self.begin[kept:], self.lengths[kept:]
        return out


def encoder(path: str, special: bool = True) -> Encoder:
    """The worker's encoder, with the pieces that it has seen, as long as the worker does nothing else."""
    kept = state("tokenstore")
    if (path, special) not in kept:
        kept[path, special] = Encoder(path, special)
    return kept[path, special]


ID_VALUES = _mixed(1 << 16, 501)


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document: where the hash of the last WINDOW ids says so, LEAST to MOST ids apart."""
    n = len(ids)
    marks = np.zeros(0, np.int64)
    if n > LEAST:
        up, down = powers(n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, U64)
            np.cumsum(ID_VALUES[ids & 0xFFFF] * (ids.astype(U64) + U64(1)) * up[:n], out=sums[1:])
            h = mix((sums[WINDOW:] - sums[: n + 1 - WINDOW]) * down[: n + 1 - WINDOW])
        marks = np.flatnonzero((h & U64(MASK)) == 0) + WINDOW
    out, at = [], 0
    for m in [*marks.tolist(), n]:
        while m - at > MOST:
            at += MOST
            out.append(at)
        if m - at >= LEAST and m < n:
            out.append(at := m)
    if n > at:
        out.append(n)
    return out


def packed(ids: np.ndarray, wide: bool) -> bytes:
    return ids.astype("<u4" if wide else "<u2").tobytes()


def unpacked(blob: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(blob, "<u4" if wide else "<u2").astype("<u4")


def digest_of(blob: bytes) -> bytes:
    return hashlib.blake2b(blob, digest_size=DIGEST).digest()


OBJECTS = pa.schema([("kind", pa.int32()), ("digest", pa.binary()), ("blob", pa.binary()), ("doc_id", pa.int64()), ("sizes", pa.binary())])


def _objects(path: str, wide: bool, special: bool):
    def run(batches) -> Iterator[pa.RecordBatch]:
        enc, sent = encoder(path, special), set()
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), utf8(batch.column(1))
            for a, b in slices(texts):
                ids, lengths = enc.encode([x.decode() for x in texts[a:b]])
                rows, at = [], 0
                for doc_id, n in zip(doc_ids[a:b], lengths):
                    own, begin, digests, sizes = ids[at : at + n], 0, [], []
                    at += n
                    for end in cuts(own):
                        digest = digest_of(blob := packed(own[begin:end], wide))
                        if digest not in sent:
                            if len(sent) > REMEMBERED:
                                sent.clear()
                            sent.add(digest)
                            rows.append((0, digest, blob, None, None))
                        digests.append(digest)
                        sizes.append(end - begin)
                        begin = end
                    rows.append((1, None, b"".join(digests), doc_id, np.array(sizes, "<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), OBJECTS.types)], schema=OBJECTS)

    return run


def _once(batches) -> Iterator[pa.RecordBatch]:
    """Rows sorted by digest: the first of each chunk; every recipe."""
    last = None
    for batch in batches:
        keep = []
        for kind, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            keep.append(kind == 1 or digest != last)
            last = digest if kind == 0 else last
        yield batch.filter(pa.array(keep, pa.bool_()))


def merkle(leaves: list[bytes]) -> bytes:
    while len(leaves) > 1:
        leaves = [hashlib.sha256(b"\1" + b"".join(leaves[i : i + 2])).digest() for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else hashlib.sha256(b"").digest()


def leaf(doc_id, start: int, digests: bytes, sizes: bytes) -> bytes:
    return hashlib.sha256(b"\0" + repr((None if pd.isna(doc_id) else int(doc_id), int(start))).encode() + digests + sizes).digest()


def _place(offsets: dict[int, int]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "digests", "sizes"], kind="stable", na_position="first")
        n = pdf["n_ids"].to_numpy()
        return pdf.assign(start=offsets[int(pdf["run"].iloc[0])] + np.cumsum(n) - n)

    return run


def _roots(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("start", kind="stable")
    leaves = [leaf(*x) for x in zip(pdf["doc_id"], pdf["start"], pdf["digests"], pdf["sizes"])]
    return pd.DataFrame({"run": [pdf["run"].iloc[0]], "n_docs": [len(pdf)], "n_ids": [pdf["n_ids"].sum()], "first": [pdf["start"].iloc[0]], "root": [merkle(leaves)]})


ROOTS = "run int, n_docs long, n_ids long, first long, root binary"


def write_store(docs: DataFrame, path: str, tokenizer: str, special: bool = True) -> None:
    from tokenizers import Tokenizer

    spark, wide = docs.sparkSession, max(Tokenizer.from_file(tokenizer).get_vocab().values(), default=0) >= 1 << 16
    spark.createDataFrame([(wide,)], "wide boolean").coalesce(1).write.parquet(f"{path}/layout")
    raw = shipped(docs).select("doc_id", "text").mapInArrow(_objects(tokenizer, wide, special), "kind int, digest binary, blob binary, doc_id long, sizes binary")
    dealt = raw.repartition(F.xxhash64("kind", "digest", "doc_id")).sortWithinPartitions("kind", "digest")
    dealt.mapInArrow(_once, dealt.schema).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/objects")
    release(spark)  # encoders are done with
    recipes = objects(spark, path, 1).select(F.col("doc_id"), F.col("blob").alias("digests"), "sizes", _ids_of("sizes").alias("n_ids"))
    runs = max(int(spark.conf.get("spark.sql.shuffle.partitions")), recipes.count() // RECIPES_PER_RUN + 1)
    recipes.repartitionByRange(runs, F.col("doc_id").asc_nulls_first(), "digests").withColumn("run", F.spark_partition_id()).write.parquet(f"{path}/unplaced")
    unplaced = spark.read.parquet(f"{path}/unplaced")
    offsets, total = {}, 0
    for r in unplaced.groupBy("run").agg(F.sum("n_ids").alias("n")).orderBy("run").collect():
        offsets[r.run], total = total, total + r.n
    placed = unplaced.groupBy("run").applyInPandas(_place(offsets), "doc_id long, digests binary, sizes binary, n_ids long, run int, start long")
    placed.write.parquet(f"{path}/recipes")
    manifest = spark.read.parquet(f"{path}/recipes").groupBy("run").applyInPandas(_roots, ROOTS)
    manifest.write.parquet(f"{path}/manifest")
    spark.createDataFrame([(bytearray(manifest_root(spark, path)),)], "root binary").coalesce(1).write.parquet(f"{path}/root")


def _ids_of(sizes: str):
    """Sum of packed little-endian unsigned 32-bit sizes."""

    @F.pandas_udf("long")
    def total(x: pd.Series) -> pd.Series:
        return x.map(lambda b: int(np.frombuffer(b, "<u4").sum()))

    return total(sizes)


def objects(spark: SparkSession, path: str, kind: int) -> DataFrame:
    schema = "digest binary, blob binary, doc_id long, sizes binary"
    return spark.read.schema(f"{schema}, kind int").parquet(f"{path}/objects").filter(F.col("kind") == kind)


def is_wide(spark: SparkSession, path: str) -> bool:
    return spark.read.schema("wide boolean").parquet(f"{path}/layout").first().wide


def manifest_root(spark: SparkSession, path: str) -> bytes:
    """The root over the roots of all runs (one row a run)."""
    return merkle([bytes(r.root) for r in spark.read.parquet(f"{path}/manifest").orderBy("run").collect()])


def verify(spark: SparkSession, path: str) -> DataFrame:
    """Runs of recipes whose Merkle root, recomputed from the recipes as read, is not that of the manifest: none, if all is well."""
    now = spark.read.parquet(f"{path}/recipes").groupBy("run").applyInPandas(_roots, ROOTS).withColumnRenamed("root", "now")
    return spark.read.parquet(f"{path}/manifest").join(now.select("run", "now"), "run", "full").filter(~F.col("root").eqNullSafe(F.col("now")))


# --- reading -------------------------------------------------------------------------------------------------------


def _crc_tables() -> np.ndarray:
    """[k, byte place, byte] effect on a CRC-32 of 2**k further zero bytes."""
    one = [(0xEDB88320 if b & 1 else 0) ^ (b >> 1) for b in (1 << i for i in range(32))]  # one zero bit
    apply = lambda m, v: np.bitwise_xor.reduce([m[i] for i in range(32) if v >> i & 1] or [0])
    square = lambda m: [int(apply(m, x)) for x in m]
    for _ in range(3):
        one = square(one)
    out = np.zeros((44, 4, 256), np.uint32)
    for k in range(44):
        for place in range(4):
            for byte in range(256):
                out[k, place, byte] = apply(one, byte << (8 * place))
        one = square(one)
    return out


_tables: list = []


def crc_shifted(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """CRC-32s as if ``after`` bytes stood behind what they are of: XORed over its parts, a document's CRC-32."""
    if not _tables:
        _tables.append(_crc_tables())
    crc, after = crc.astype(np.uint32), after.astype(np.int64)
    for k in range(int(after.max()).bit_length() if len(after) else 0):
        t, on = _tables[0][k], (after >> k & 1).astype(bool)
        c = crc[on]
        crc[on] = t[0, c & 255] ^ t[1, c >> 8 & 255] ^ t[2, c >> 16 & 255] ^ t[3, c >> 24]
    return crc


def chunk_sums(spark: SparkSession, path: str) -> DataFrame:
    """(digest, n, crc, ok) of every stored chunk, from its ids as read."""
    wide = is_wide(spark, path)
    schema = pa.schema([("digest", pa.binary()), ("n", pa.int64()), ("crc", pa.int64()), ("ok", pa.bool_())])

    def run(batches):
        for batch in batches:
            blobs, digests = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            ids = [unpacked(x, wide) for x in blobs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array([digest_of(x) == d for x, d in zip(blobs, digests)], pa.bool_())], schema=schema)

    return objects(spark, path, 0).select("digest", "blob").mapInArrow(run, "digest binary, n long, crc long, ok boolean")


def _parts(batches) -> Iterator[pa.RecordBatch]:
    """Recipes as a row per chunk: which, and how many bytes of ids follow it in its document."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("run", pa.int32()), ("pos", pa.int32()), ("digest", pa.binary()), ("after", pa.int64())])
    for batch in batches:
        rows = []
        for doc_id, start, own, digests, sizes in zip(*(batch.column(i).to_pylist() for i in range(5))):
            sizes = np.frombuffer(sizes, "<u4").astype(np.int64)
            after = 4 * (sizes.sum() - np.cumsum(sizes))
            rows += [(doc_id, start, own, i, digests[DIGEST * i : DIGEST * (i + 1)], int(x)) for i, x in enumerate(after)]
        for a in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[a : a + 50_000]), schema.types)], schema=schema)


def parts(spark: SparkSession, path: str) -> DataFrame:
    recipes = spark.read.schema("doc_id long, start long, run int, digests binary, sizes binary").parquet(f"{path}/recipes")
    return recipes.mapInArrow(_parts, "doc_id long, start long, run int, pos int, digest binary, after long")


def document_sums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, valid) of every document, from the files of the store.

    ids_crc32 is the CRC-32 of all ids of the document as little-endian unsigned 32-bit integers. valid: every chunk is
    there and has the digest it is named by, the Merkle root over the run of recipes that the document's stands in is that
    of the manifest, and the root over all runs, stored last, is that of the manifest as read.
    """

    @F.pandas_udf("long")
    def shifted(crc: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series(crc_shifted(crc.fillna(0).to_numpy(np.int64), after.to_numpy()).astype(np.int64))

    joined = shipped(parts(spark, path)).join(chunk_sums(spark, path), "digest", "left")
    rows = joined.select("doc_id", "start", "run", "n", F.coalesce("ok", F.lit(False)).alias("ok"), shifted("crc", "after").alias("crc"))
    sums = rows.groupBy("doc_id", "start", "run").agg(F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"), F.min("ok").alias("ok"))
    bad = F.broadcast(verify(spark, path).select("run", F.lit(True).alias("bad")))  # a row at most for RECIPES_PER_RUN documents
    whole = bytes(spark.read.parquet(f"{path}/root").first().root) == manifest_root(spark, path)
    return sums.join(bad, "run", "left").select("doc_id", "start", "n_tokens", "ids_crc32", (F.col("ok") & F.col("bad").isNull() & F.lit(whole)).alias("valid"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): documents put together again from their chunks."""
    wide = is_wide(spark, path)
    joined = shipped(parts(spark, path)).join(objects(spark, path, 0).select("digest", "blob"), "digest")
    grouped = joined.groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "blob"))).alias("c"))

    @F.pandas_udf("array<long>")
    def ids(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda x: unpacked(b"".join(x), wide).astype(np.int64))

    return grouped.select("doc_id", "start", ids(F.col("c.blob")).alias("ids"))
