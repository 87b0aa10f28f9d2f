"""Quality audits: duplicates, hotspots, tags, tables, similarity reviews, embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.functions.udfs import bag_ratio
from foliant.functions.vectors import norm
from foliant.operators.ranks import quantile


def group_counts(rows: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def top_counts(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The most frequent values, ties in the order of the keys; nulls do not count."""
    named = rows
    for k in keys:
        named = named.filter(F.col(k).isNotNull())
    return group_counts(named, keys).orderBy(F.desc("n"), *keys).limit(most)


def bars(counts: DataFrame, key: str, least: float = 6.0) -> DataFrame:
    """Counts as bar heights of 100 at most; the last key is the latest."""
    everything = Window.partitionBy()
    height = F.greatest(F.lit(least), F.col("n") / F.max("n").over(everything) * 100)
    return counts.select(key, "n", height.alias("height"), (F.col(key) == F.max(key).over(everything)).alias("latest"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(text_hash, n, first_id, last_id) of texts that occur more than once. Hashes move, not texts."""
    own = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))
    return own.groupBy("text_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("n > 1")


def near_duplicates(docs: DataFrame, keys: list[str], head: int = 300, least: int = 100) -> DataFrame:
    """Groups of equal keys and equal beginnings without white space, among texts that have no exact copy."""
    own = docs.select("doc_id", *keys, F.length("text").alias("_n"), F.sha2("text", 256).alias("_h"), F.sha2(F.substring(X.squeezed(F.col("text")), 1, head), 256).alias("head_hash"))
    single = own.groupBy("_h").agg(F.count("*").alias("_c")).filter("_c = 1").select("_h")
    rest = own.join(single, "_h", "left_semi").filter(F.col("_n") >= least)
    return rest.groupBy(*keys, "head_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


def pattern_frequency(docs: DataFrame, pattern: str, most: int = 500) -> DataFrame:
    """(pattern, n_docs, sample_ids): in how many documents each match of the pattern occurs, with the first and the last of them."""
    found = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).alias("pattern"))
    grouped = found.groupBy("pattern").agg(F.count("*").alias("n_docs"), F.array_distinct(F.array(F.min("doc_id"), F.max("doc_id"))).alias("sample_ids"))
    return grouped.orderBy(F.desc("n_docs"), "pattern").limit(most)


def tag_families(docs: DataFrame, families: dict[str, str]) -> DataFrame:
    """(family, n_docs): documents with a match of each family; texts without any are left out by one test first."""
    any_tag = docs.filter(F.col("text").rlike("|".join(families.values())))
    sums = any_tag.agg(*[F.coalesce(F.sum(F.col("text").rlike(p).cast("long")), F.lit(0)).alias(n) for n, p in families.items()])
    return sums.unpivot([], list(families), "family", "n_docs")


def similarity_statistics(rows: DataFrame, by: str = "similarity") -> DataFrame:
    """(n, mean, median, least, most). The median is exact, by counts alone (:mod:`foliant.operators.ranks`)."""
    median = F.lit(quantile(rows, by)).cast("double").alias("median")
    return rows.agg(F.count(by).alias("n"), F.avg(by).alias("mean"), F.min(by).alias("least"), F.max(by).alias("most")).select("n", "mean", median, "least", "most")


def similarity_bucket(x: Column) -> Column:
    return F.when(x < 0.5, "[0,.5)").when(x < 0.7, "[.5,.7)").when(x < 0.8, "[.7,.8)").when(x < 0.9, "[.8,.9)")


def length_flags(rows: DataFrame) -> DataFrame:
    ratio = F.col("new_len") / F.col("old_len")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return rows.filter("old_len > 0").agg(F.count("*").alias("n"), count(ratio >= 1.1).alias("longer"), count(ratio <= 0.9).alias("shorter"))


def norm_gate(vectors: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(n, mean, std, ok): norms of embeddings, population deviation; ok if the mean is 1 within the tolerance."""
    n = norm(F.col("embedding"))
    return vectors.filter("embedding is not null").agg(F.count("*").alias("n"), F.avg(n).alias("mean"), F.stddev_pop(n).alias("std")).withColumn("ok", F.abs(F.col("mean") - 1) <= tolerance)


def bag_similarity(pairs: DataFrame) -> DataFrame:
    """(pair_id, bag): characters but the space that both texts have, by the larger text's number; 1 if neither has any."""
    return pairs.select("pair_id", bag_ratio("a", "b").alias("bag"))


def fallback_usage(rows: DataFrame) -> DataFrame:
    """(quality, n, line1..line4): of well-formed summaries, how often each line has its own fallback phrase."""
    own = rows.withColumn("_l", X.filled_lines(F.col("summary"))).filter(F.size("_l") == 4)
    uses = [F.sum(F.get("_l", F.lit(i)).contains(p).cast("long")).alias(f"line{i + 1}") for i, p in enumerate(X.FALLBACK_PHRASES)]
    return own.groupBy("quality").agg(F.count("*").alias("n"), *uses)


def cost_projection(rows: DataFrame, n: int, price_in: float, price_out: float, concurrency: int) -> DataFrame:
    means = rows.agg(F.avg("input_tokens").alias("avg_in"), F.avg("output_tokens").alias("avg_out"), F.avg("seconds").alias("avg_seconds"))
    cost = F.col("avg_in") / 1e6 * price_in + F.col("avg_out") / 1e6 * price_out
    return means.select("*", cost.alias("cost_each"), (cost * n).alias("cost_all"), (F.col("avg_seconds") * n / 3600 / concurrency).alias("hours"))


def population_estimate(rows: DataFrame, flag: str, population: int) -> DataFrame:
    rate = F.avg(F.col(flag).cast("double"))
    return rows.agg(F.count("*").alias("n"), rate.alias("rate"), F.round(rate * population).cast("long").alias("estimate"))


def table_loss(rows: DataFrame) -> DataFrame:
    """(id, n_table_markers, has_trace, affected): markers in the original though the stored text shows no table."""
    n = F.size(F.split("original", "<표>", -1)) - 1
    trace = X.has_table_trace(F.col("stored"))
    return rows.select("id", n.alias("n_table_markers"), trace.alias("has_trace"), ((n > 0) & ~trace).alias("affected"))
