"""The stages one by one against plain versions, the registered queries against their SQL, and the whole run."""

import collections

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from foliant.llm import queries
from foliant.llm.common import table, written
from tests.llm.test_operators import brute_components, shingles
from tests.oracle import assert_same, connect


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, sf_dir, name):
    assert_same(queries.queries()[name](spark, sf_dir), connect(sf_dir), queries.oracle_sql()[name])


def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_stages(spark, sf_dir):
    docs, seen = table(spark, sf_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        seen.append(docs.collect())
    first, second, third, fourth, last = seen
    assert all(r.asDict().keys() == first[0].asDict().keys() for s in (second, third, fourth) for r in s)
    want = brute_components([(r.doc_id, r.text) for r in first])
    assert sorted(r.doc_id for r in second) == sorted({c for _, c in want.values()})
    items = [shingles(r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    clean = [r.doc_id for r in second if not any(5 * len(s & shingles(r.text)) >= 4 * len(s) for s in items)]
    assert sorted(r.doc_id for r in third) == sorted(clean) and len(clean) < len(second)
    times = collections.Counter(r.doc_id for r in fourth)
    assert set(times) <= set(clean) and max(times.values()) == 2
    assert collections.Counter(r.doc_id for r in last) == times and all(r.valid for r in last)


ODD = [(9001, None), (9002, ""), (9003, "one two"), (9004, "word " * 20_000), (9005, None), (9005, None), (None, "a text without an id")]


def folder(spark, sf_dir, tmp_path, rows):
    """A data folder of some documents, and odd ones among them, with columns whose names operators use."""
    own = table(spark, sf_dir, "documents").filter("doc_id < 60")
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    more = [F.lit(None).cast(t).alias(n) for n, t in own.dtypes if n not in ("doc_id", "text")]
    odd = odd.select("doc_id", "text", *more).select(own.columns).unionByName(own.filter("doc_id in (3, 4)"))
    docs = own.unionByName(odd) if rows else own.limit(0)
    for c in ("n", "block", "size", "h", "words", "shard", "owner", "n_words", "_text", "label"):
        docs = docs.withColumn(c, F.lit("clash"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, sf_dir, "labels").filter("true" if rows else "false").write.parquet(str(tmp_path / "labels.parquet"))
    table(spark, sf_dir, "benchmark").filter("true" if rows else "false").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_run_of_odd_rows(spark, sf_dir, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns go through every stage; the run is that of its stages."""
    at = folder(spark, sf_dir, tmp_path, True)
    docs, seen = table(spark, at, "documents"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, at), name)
        assert docs.columns == table(spark, at, "documents").columns
        seen.append(collections.Counter(r.doc_id for r in docs.collect()))
    assert seen[1] <= seen[0] and seen[2] <= seen[1] and set(seen[3]) <= set(seen[2])
    got = corpus_pipeline.run(spark, at).collect()
    assert collections.Counter(r.doc_id for r in got) == seen[3] and all(r.valid for r in got)


def test_run_of_nothing(spark, sf_dir, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, sf_dir, tmp_path, False)).count() == 0
