"""Spelling variants by a symmetric-delete join.

Every word emits itself and its distinct single deletions as keys. Two words at distance one share a key: the shorter one is a deletion of the longer, or both
lose the place at which they differ. Words are joined on equal keys; a deletion carries the places that give it, so that of two words of one length only
those that can lose the same place are paired at all. What comes out is verified to be at distance one exactly. A pair has one key in common, so none comes twice.
Near words are counted, and the most frequent one becomes a word's form if it is frequent enough. Forms are followed to roots by joins that double their reach: a
form is at least ``ratio`` times as frequent as its word, so chains are short and end.

Words that share a key differ from it by one letter, so a key has at most (places * letters) words. Texts are read once, by Spark's own expressions, and words
are counted before they are shuffled; everything after moves words, not occurrences.

Defined cases: a null text has no words, an empty one neither; a null doc_id counts as an empty string where ids are hashed. Very long texts are split whole. Repeated rows count
as often as they stand there. Of forms of equal frequency the first in code-point order counts. Other columns are not read, whatever they are called. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Letters of a run. Only A-Z are lower-cased.
LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10


def runs(docs: DataFrame, least: int = LEAST_LENGTH, text: str = "text") -> DataFrame:
    """(doc_id, run): every maximal run of at least ``least`` letters, A-Z lower-cased."""
    found = F.regexp_extract_all(text, F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("run")).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))


def without(word: Column, at: Column) -> Column:
    """``word`` without the code point at a place, from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def worn(rows: DataFrame, every: int) -> DataFrame:
    """(word): runs, of which those whose hash (CRC32 of ``<doc_id>:<run>``) ``every`` divides have lost one letter, at the hash modulo the length."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    return rows.select("run", h.alias("h")).select(F.when(F.col("h") % every == 0, without(F.col("run"), at)).otherwise(F.col("run")).alias("word"))


def counted(words: DataFrame, length: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    return words.filter(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= count)


def keys(words: DataFrame) -> DataFrame:
    """(word, n, key, lo, hi): each word itself, with lo = -1, and its distinct single deletions with the first and the last place that give them."""
    letters = F.split("word", "")
    places = F.sequence(F.lit(0), F.length("word") - 1)
    # letters of an equal run give one deletion: it is emitted at the run's first letter, and lasts as long as the run
    first = F.filter(places, lambda i: (i == 0) | (F.get("letters", i) != F.get("letters", i - 1)))
    ends = F.concat(F.slice(F.transform("first", lambda i: i - 1), F.lit(2), F.size("first")), F.array(F.length("word") - 1))
    emitted = F.transform("first", lambda i, k: F.struct(without(F.col("word"), i).alias("key"), i.alias("lo"), F.get("ends", k).alias("hi")))
    own = F.array(F.struct(F.col("word").alias("key"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi")))
    rows = words.withColumn("letters", letters).withColumn("first", first).withColumn("ends", ends)
    return rows.select("word", "n", F.inline(F.concat(own, emitted)))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): every ordered pair of words at distance one."""
    a = keys(words)
    b = a.select(F.col("word").alias("other"), F.col("n").alias("other_n"), "key", F.col("lo").alias("other_lo"), F.col("hi").alias("other_hi"))
    meet = (F.col("lo") < 0) | (F.col("other_lo") < 0) | ((F.col("lo") <= F.col("other_hi")) & (F.col("other_lo") <= F.col("hi")))
    pairs = a.join(b, (a["key"] == b["key"]) & (F.col("word") < F.col("other")) & meet).filter(F.levenshtein("word", "other", 1) == 1)
    return pairs.select(F.inline(F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))))


def with_forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n)"""
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("best")
    found = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    enough = -F.col("best.n") >= ratio * F.col("n")
    return words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: the last one along forms. Every round joins what each word points at with what that points at."""
    ups = written(forms.filter("form is not null").select("word", F.col("form").alias("root")), "ups")
    while True:
        more = ups.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        joined = written(ups.join(more, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "ups")
        ups = joined.select("word", "root")
        if joined.filter("moved").limit(1).count() == 0:
            return ups


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of (word, n) with distinct words."""
    forms = written(with_forms(written(words, "words"), ratio), "forms")
    return forms.join(roots(forms), "word", "left").withColumn("root", F.coalesce("root", "word"))
