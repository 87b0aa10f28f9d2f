"""Corpus construction: tiers, split parts, keyed matches, preflight, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as X

TIER_ORDER = {"standard": 0, "partial": 1, "fallback": 2, "extraction_failed": 99}
UNKNOWN_TIER = 50
QUALITIES = ["standard", "partial", "fallback"]


def tier_rank(base: Column) -> Column:
    out = F.lit(UNKNOWN_TIER)
    for name, rank in TIER_ORDER.items():
        out = F.when(base == name, rank).otherwise(out)
    return out


def resolve_tiers(cases: DataFrame) -> DataFrame:
    """One record per (source_file, case_number), from (seq, source_file, case_number, title, parse_tier, raw_text).

    Overviews go; of each group the records of the best tier stay. If all of them are parts, their texts are joined in
    part order, the first seen of a repeated part, and the lowest part stands for the group; else the first record does.
    A group whose best tier is a failed extraction goes. Null keys are keys like any other.
    """
    tier, keys = X.parse_tier(F.col("parse_tier")), ["source_file", "case_number"]
    own = cases.select(*keys, tier["idx"].alias("idx"), F.struct("seq", "title", tier["base"].alias("tier"), "raw_text").alias("r")).filter("r.tier <> 'overview'")
    own = own.withColumn("rank", tier_rank(F.col("r.tier")))
    # minima only, so that a key with very many records is summed up before it moves
    per = own.groupBy(*keys, "rank").agg(F.min(F.col("idx").isNotNull()).alias("split"), F.min("r").alias("r"))
    best = per.groupBy(*keys).agg(F.min(F.struct("rank", "split", "r")).alias("b")).select(*keys, "b.*").filter(F.col("rank") != TIER_ORDER["extraction_failed"])
    record = lambda r, text: [*keys, F.col(f"{r}.title").alias("title"), F.col(f"{r}.tier").alias("parsing_quality"), text.alias("raw_text")]
    whole = best.filter("not split").select(*record("r", F.col("r.raw_text")))
    parts = best.filter("split").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("rank").alias("_rank"))
    same = own["source_file"].eqNullSafe(parts["_source_file"]) & own["case_number"].eqNullSafe(parts["_case_number"]) & (own["rank"] == parts["_rank"])
    once = own.join(parts, same).groupBy(*keys, "idx").agg(F.min("r").alias("r"))
    merged = once.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", "r"))).alias("p")).withColumn("h", F.col("p")[0]["r"])
    return whole.unionByName(merged.select(*record("h", F.array_join(F.col("p.r.raw_text"), "\n"))))


def unambiguous_documents(chunks: DataFrame) -> DataFrame:
    """(document_id, title, source_file) of documents with one distinct title (null is one); the first source file seen."""
    title, no = F.col("title"), F.count_if(F.col("title").isNull())
    grouped = chunks.groupBy("document_id").agg(F.min(title).alias("title"), F.max(title).alias("_last"), no.alias("_none"), F.min_by("source_file", "seq").alias("source_file"))
    one = F.col("title").isNull() | ((F.col("title") == F.col("_last")) & (F.col("_none") == 0))
    return grouped.filter(one).select("document_id", "title", "source_file")


def keyed_match(documents: DataFrame, records: DataFrame) -> DataFrame:
    """Documents with the record of equal (source_file, title), nulls equal; of several records the last by seq; others go. source_file is the document's
    or, where that is empty, the record's, and audit_type what its name says."""
    order = Window.partitionBy("source_file", "title").orderBy(F.desc("seq"))
    last = records.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    renamed = last.withColumnsRenamed({c: f"r_{c}" for c in last.columns})
    on = documents["source_file"].eqNullSafe(renamed["r_source_file"]) & documents["title"].eqNullSafe(renamed["r_title"])
    source = F.coalesce(X.none_if_empty(documents["source_file"]), F.col("r_source_file"))
    joined = documents.join(renamed, on).select(*[documents[c] for c in documents.columns if c != "source_file"], source.alias("source_file"), *[c for c in renamed.columns])
    return joined.withColumn("audit_type", X.parse_source(F.col("source_file"))["audit_type"]).drop("r_source_file", "r_title", "r_seq")


def semi_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    return chunks.join(documents.select("document_id"), "document_id", "left_semi")


def orphan_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    return chunks.join(documents.select("document_id"), "document_id", "left_anti")


def preflight(documents: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row of counts, and whether any of them is fatal. Each side is summed up by its key and then as a whole."""
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    repeated = lambda name: F.count_if(F.col("_n") > 1).alias(name)
    by_document = documents.groupBy("document_id").agg(
        F.count("*").alias("_n"), one(~F.coalesce(F.col("parsing_quality").isin(QUALITIES), F.lit(False))).alias("bad_quality"),
        one(F.coalesce(F.col("raw_text"), F.lit("")) == "").alias("missing_text"), one(F.col("year").isNull()).alias("missing_year"),
    )
    of_documents = by_document.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_documents"), total("bad_quality"), total("missing_text"), total("missing_year"), repeated("duplicate_documents"))
    known = chunks.select("chunk_id", "document_id").join(by_document.select("document_id", F.lit(True).alias("_d")), "document_id", "left")
    known = known.join(embeddings.select("chunk_id", F.lit(True).alias("_e")).distinct(), "chunk_id", "left")
    by_chunk = known.groupBy("chunk_id").agg(F.count("*").alias("_n"), one(F.col("_d").isNull()).alias("orphans"), one(F.col("_e").isNull()).alias("missing_embeddings"))
    of_chunks = by_chunk.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_chunks"), repeated("duplicate_chunks"), total("orphans"), total("missing_embeddings"))
    both = of_documents.withColumn("_k", F.lit(1)).join(of_chunks.withColumn("_k", F.lit(1)), "_k").drop("_k")  # single rows
    return both.withColumn("fatal", F.expr("bad_quality + missing_text + orphans > 0"))


def sample_reuse(rows: DataFrame, done: DataFrame, size: int, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """A random sample by hash of the key, rows already processed first."""
    marked = rows.join(done.select(key, F.lit(1).alias("_done")), key, "left")
    order = [F.col("_done").isNull(), F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)]
    return marked.orderBy(*order).limit(size).withColumn("reused", F.col("_done").isNotNull()).drop("_done")


def stratified_sample(rows: DataFrame, sizes: dict[str, int], stratum: str, length: str, key: str) -> DataFrame:
    """Of each stratum every (n // size)-th row by length, then key, as many as its size.

    Ranks come from counts by length: only the lengths that hold a wanted rank are looked at row by row, so that no stratum is ever
    sorted in one place.
    """
    size = F.lit(0)
    for name, n in sizes.items():
        size = F.when(F.col(stratum) == name, n).otherwise(size)
    counts = rows.groupBy(stratum, length).agg(F.count("*").alias("_c")).withColumn("_size", size).filter("_size > 0")
    per = Window.partitionBy(stratum)
    ranked = counts.withColumn("_before", F.sum("_c").over(per.orderBy(length)) - F.col("_c")).withColumn("_step", F.greatest(F.lit(1), F.floor(F.sum("_c").over(per) / F.col("_size"))))
    last = F.least(F.col("_before") + F.col("_c") - 1, (F.col("_size") - 1) * F.col("_step"))
    wanted = ranked.filter(F.floor(last / F.col("_step")) * F.col("_step") >= F.col("_before")).select(stratum, length, "_before", "_step", "_size")
    inside = rows.join(F.broadcast(wanted), [stratum, length])  # at most as many rows as are drawn
    rank = F.col("_before") + F.row_number().over(Window.partitionBy(stratum, length).orderBy(key)) - 1
    picked = inside.withColumn("_rank", rank).filter("_rank % _step = 0 and _rank / _step < _size")
    return picked.select(rows.columns)
