"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's documents are dealt by hash into blocks of at most about ``block_words`` words; a source's target becomes
an exact quota of whole passes over its blocks and of blocks drawn once more. The tree halves the set of output shards
again and again and splits the quotas of all sources between the halves by one multivariate-hypergeometric draw, so that
every shard gets a random, exact share. Within a source the blocks stand in a permuted order; shards take disjoint runs
of that order, as long as their share, and shuffle the documents of their blocks locally. Whole passes are dealt in the same way, each in an order of its own, so that
every copy of a document has a shard and a place in it. The block at which a source
reaches its target is taken in part: whole documents in hash order, each one that still fits (rows of one id, source and size together).

All that moves is (doc_id, size, source): texts are read once, to count their words. What reaches the driver is a row
per source, and a quota per source and shard. Draws depend on the seed and on hashes of ids, so reruns agree.

Defined cases: a null text has size 0 and is taken 0 times. A document larger than what is left of its source's target in that last block is passed over; in a source of one such document the target stays out of reach. A null source is a source of its own, ordered last. Rows of
equal doc_id, source and size are each counted and are all taken equally often. A very long text is one document like any other. Other columns
travel along with :func:`mixed`, which needs none of the names that it adds. An empty table gives an empty mix.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
SEED = 42
#: A source is dealt into blocks of about this many words, into MOST_BLOCKS at most, so that the order of a source's
#: blocks is a bounded sort, and the one block that is taken in part a small share of its source.
BLOCK_WORDS = 50_000
MOST_BLOCKS = 1 << 16
#: Output shards at least, and words of a shard above which there are more.
SHARDS, SHARD_WORDS = 64, 100_000_000


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words to take of each source: the share by weight, at most ``most`` times its size, excess going to the others by weight."""
    total, out, open_ = share * sum(sizes), [0.0] * len(sizes), list(range(len(sizes)))
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    while open_:
        unit = total / sum(w[i] for i in open_)
        full = [i for i in open_ if w[i] * unit > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = w[i] * unit
            break
        for i in full:
            out[i] = most * sizes[i]
            total -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def splitting_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """[sources, shards] blocks: quotas split between the halves of the shards, down to single shards."""
    out = np.zeros((len(quotas), shards), np.int64)

    def split(own: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[:, lo] = own
            return
        mid, total = (lo + hi) // 2, int(own.sum())
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(own, total * (mid - lo) // (hi - lo), method="marginals") if total else own * 0
        split(left, lo, mid)
        split(own - left, mid, hi)

    split(np.asarray(quotas, np.int64), 0, shards)
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """A row per document: doc_id, size, source, source_size, target, taken (words), epochs (whole passes of its source),
    drawn (1 if taken once more), the shard and place of that last draw, and copies: pass, shard and place of every copy."""
    spark = docs.sparkSession
    base = written(docs.select("doc_id", "source", word_count().alias("size"), F.xxhash64(F.lit(seed), "doc_id").alias("h")), "sizes")
    by_source = base.groupBy("source").agg(F.sum("size").alias("words")).collect()
    by_source.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be")))
    goal = targets([r.words for r in by_source], weights, share, most)
    shards, plan = shards or max(SHARDS, int(sum(goal) // SHARD_WORDS) + 1), []
    for r, g in zip(by_source, goal):
        epochs = int(g // r.words) if r.words else 0
        plan.append((r.source, r.words, g, epochs, g - epochs * r.words, min(MOST_BLOCKS, r.words // BLOCK_WORDS + 1)))
    keys = [(p[0], e) for p in plan for e in range(p[3] + 1)]
    plan = spark.createDataFrame(plan, "source string, source_size long, target double, epochs int, rest double, n_blocks long")
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    base = base.alias("d").join(plan.alias("p"), same("d", "p")).select("d.*", "source_size", "target", "epochs", "rest", F.pmod("h", "n_blocks").cast("int").alias("block"))

    blocks = base.groupBy("source", "block", "rest", "epochs").agg(F.sum("size").alias("words")).withColumn("pass", F.explode(F.sequence(F.lit(0), "epochs")))
    order = Window.partitionBy("source", "pass").orderBy(F.xxhash64(F.lit(seed + 1), "pass", "block"), "block")
    ranked = blocks.withColumn("rank", F.row_number().over(order)).withColumn("before", F.sum("words").over(order) - F.col("words"))
    last = F.col("pass") == F.col("epochs")
    state = F.when(~last | (F.col("before") + F.col("words") <= F.col("rest")), 2).when(F.col("before") < F.col("rest"), 1).otherwise(0)
    ranked = written(ranked.select("source", "block", "pass", "rank", last.alias("last"), state.alias("state"), (F.col("rest") - F.col("before")).alias("room")), "blocks")
    quotas = {(r.source, r["pass"]): r.n for r in ranked.filter("state = 2").groupBy("source", "pass").agg(F.count("*").alias("n")).collect()}
    ends = np.cumsum(splitting_tree(np.array([quotas.get(k, 0) for k in keys], np.int64), shards, seed), axis=1)
    runs = spark.createDataFrame([(*k, [int(x) for x in e]) for k, e in zip(keys, ends)], "source string, pass int, ends array<long>")
    shard = F.size(F.filter("ends", lambda e: e < F.col("rank")))
    dealt = ranked.alias("r").join(runs.alias("s"), same("r", "s") & (F.col("r.pass") == F.col("s.pass")))
    dealt = dealt.select("r.source", "block", "r.pass", "last", "state", "room", F.when(F.col("state") == 2, shard).when(F.col("state") == 1, shards - 1).alias("shard"))
    of_last = lambda c: F.max(F.when(F.col("last"), F.col(c))).alias(c)
    whole_passes = F.array_sort(F.collect_list(F.when(~F.col("last"), F.struct("pass", "shard"))))
    dealt = dealt.groupBy("source", "block").agg(of_last("state"), of_last("room"), of_last("shard"), F.transform(whole_passes, lambda x: x["shard"]).alias("passes"))

    rows = base.alias("d").join(dealt.alias("r"), same("d", "r") & (F.col("d.block") == F.col("r.block"))).select("d.*", "state", "room", "shard", "passes")
    part = rows.filter("state = 1").groupBy("source", "block").applyInPandas(_fill, f"{_schema(rows)}, drawn int")
    whole = rows.filter("state <> 1").withColumn("drawn", (F.col("state") == 2).cast("int"))
    drawn = F.col("drawn") == 1
    placed = lambda n, shard: F.struct(n.cast("int").alias("pass"), shard.cast("int").alias("shard"), F.xxhash64(F.lit(seed + 2), "doc_id", shard, n.cast("int")).alias("place"))
    copies = F.concat(F.transform("passes", lambda x, i: placed(i, x)), F.when(drawn, F.array(placed(F.col("epochs"), F.col("shard")))).otherwise(F.array()))
    return whole.unionByName(part).select(
        "doc_id", "size", "source", "source_size", "target", (F.col("size") * (F.col("epochs") + F.col("drawn"))).alias("taken"), "epochs", "drawn",
        F.when(drawn, F.col("shard")).alias("shard"), F.when(drawn, placed(F.col("epochs"), F.col("shard"))["place"]).alias("place"),
        F.when(F.col("size") > 0, copies).otherwise(F.slice(copies, 1, 0)).alias("copies"),
    )


def _schema(df: DataFrame) -> str:
    return ", ".join(f"{n} {t}" for n, t in df.dtypes)


def _fill(pdf):
    """Of the block in which a source reaches its target: documents in hash order, each that still fits."""
    pdf = pdf.sort_values(["h", "doc_id", "size"], kind="stable")
    room, drawn = float(pdf["room"].iloc[0]), []
    for _, same in pdf.groupby(["h", "doc_id", "size"], sort=False, dropna=False):
        words = int(same["size"].sum())
        take = 0 < words <= room
        room -= words * take
        drawn += [int(take)] * len(same)
    return pdf.assign(drawn=drawn)


def mixed(docs: DataFrame, shards: int | None = None, **how) -> DataFrame:
    """The mix itself: the columns of ``docs``, each document as often as it is taken. Each shard is whole in one partition,
    its rows in the order of their places."""
    taken = mix(docs, shards=shards, **how).filter(F.size("copies") > 0)
    times = taken.groupBy(F.col("doc_id").alias("_doc"), F.col("source").alias("_source"), F.col("size").alias("_size")).agg(F.first("copies").alias("_copies"))
    times = written(times, "times")
    last = times.agg(F.max(F.array_max(F.transform("_copies", lambda x: x["shard"])))).first()[0] or 0
    times = broadcast_if_small(times)
    same = docs["doc_id"].eqNullSafe(times["_doc"]) & docs["source"].eqNullSafe(times["_source"]) & (word_count() == times["_size"])
    dealt = docs.join(times, same).withColumn("_copy", F.explode("_copies")).select(*[docs[c] for c in docs.columns], F.col("_copy.shard").alias("_shard"), F.col("_copy.place").alias("_place"))
    return dealt.repartitionById(last + 1, "_shard").sortWithinPartitions("_shard", "_place", "doc_id").drop("_shard", "_place")
