"""Operators whose effects queries do not show: readers and writers, summaries, streams, layout."""

import math
import tracemalloc

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.operators import layout, search, summaries
from foliant.plans import reading, retrieval
from foliant.sources import tables
from foliant.streaming.incremental import load_incrementally
from tests.conftest import DATA


def test_json_lines_strict_and_tolerant(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "x": "가"}\nbroken\n{"id": "2"}\n')
    got = tables.read_jsonl(spark, str(tmp_path), "id string, x string", tolerant=True).collect()
    assert sorted((r.id, r.x) for r in got) == [("1", "가"), ("2", None)]
    with pytest.raises(Exception):
        tables.read_jsonl(spark, str(tmp_path), "id string, x string").collect()


def test_json_object(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"a": {"old": "1", "new": "2"}, "b": {"old": "3", "new": "4"}}')
    got = tables.read_json_object(spark, str(tmp_path), "struct<old:string,new:string>").collect()
    assert sorted(map(tuple, got)) == [("a", "1", "2"), ("b", "3", "4")]


def test_vectors_by_position(spark):
    ids = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "c")], "pos int, id string")
    vectors = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [2.0])], "pos int, embedding array<double>")
    assert sorted((r.id, r.embedding[0]) for r in tables.zip_vectors(ids, vectors).collect()) == [("a", 2.0), ("b", 1.0)]


def test_checkpoints_and_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id int, t string")
    tables.append_checkpoint(rows.filter("id = 1"), str(tmp_path / "c"))
    tables.append_checkpoint(rows.filter("id = 2"), str(tmp_path / "c"))
    assert tables.read_checkpoint(spark, str(tmp_path / "c")).count() == 2
    tables.export_column(rows, "id", "t", str(tmp_path / "e"))
    tables.write_jsonl(rows, str(tmp_path / "w"))
    assert spark.read.json(str(tmp_path / "w")).count() == spark.read.json(str(tmp_path / "e")).count() == 2


def test_blank_search_is_an_error(spark):
    with pytest.raises(ValueError):
        search.search(None, None, [], "  ")


def test_summaries(spark):
    docs = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "fallback")], "doc_id long, text string")
    answers = {"good": "a\nb\n\nc\nd", "bad": "one line", "fallback": "지적사항 불분명\n원인 미기재\n조치사항 미기재\n처리결과 미기재"}
    got = {r.doc_id: r for r in summaries.summarise(docs, lambda t: {"good": "a\nb\n\nc\nd", "bad": "one line"}.get(t, "지적사항 불분명\n원인 미기재\n조치사항 미기재\n처리결과 미기재")).collect()}
    assert [got[1][n] for n in ("point", "cause", "action", "result")] == ["a", "b", "c", "d"] and [got[i].failed for i in (1, 2, 3)] == [False, True, True]
    free = {r.doc_id: r.freeform for r in summaries.summarise_freeform(docs, lambda t: t if t != "bad" else " ", "fallback").collect()}
    assert free == {1: "good", 2: None, 3: None} and len(answers) == 3
    assert summaries.stub_tokens("") == (1, 40) and summaries.structured(summaries.stub("x"))


def test_reading_order(spark):
    text = layout.document_text(reading.glyphs(spark)).first().text.split("\n")
    assert text[:6] == [f"left line {k} of the page text" for k in range(6)] and text[6:12] == [f"right line {k} of the page text" for k in range(6)]
    assert text[12:] == ["row 0 [부서] end", "row 1 [부서] end", "row 2 [부서] end"]
    tight = layout.page_rows(reading.glyphs(spark), tolerance=1.0).filter("page = 2").select("band").distinct().count()
    assert tight == 6


def test_incremental_loading(spark, tmp_path):
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows = lambda *ids: spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    rows(1, 2, 2).write.parquet(source)
    load_incrementally(spark, source, target, check).awaitTermination(120)
    rows(2, 3).write.mode("append").parquet(source)
    load_incrementally(spark, source, target, check).awaitTermination(120)
    assert sorted(r.document_id for r in spark.read.parquet(target).collect()) == [1, 2, 3]
    assert spark.read.parquet(target).agg(F.count("*")).first()[0] == 3


def test_ids_of_others_and_of_earlier_batches_are_known(spark, tmp_path):
    """Of a repeated id the first row counts; what the target held before is not loaded again; later batches do not read the target."""
    import shutil

    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id long, text string").coalesce(1)
    load = lambda: load_incrementally(spark, source, target, check).awaitTermination(120)
    spark.createDataFrame([(7, 0, "old", "7_old")], "document_id long, chunk_index int, text string, chunk_id string").write.parquet(f"{target}/load=other")
    rows((1, "first"), (1, "second"), (7, "again"), (None, "no id"), (2, None)).write.parquet(source)
    load()
    assert sorted((r.document_id, r.text) for r in spark.read.parquet(target).collect()) == [(1, "first"), (7, "old")]
    shutil.move(target, target + "-away")
    rows((1, "third"), (3, "new"), (7, "again")).write.mode("append").parquet(source)
    load()
    assert [(r.document_id, r.text) for r in spark.read.parquet(target).collect()] == [(3, "new")]
    load()
    assert spark.read.parquet(target).count() == 1


def test_exact_quantiles(spark, monkeypatch):
    import random
    import statistics

    from foliant.operators import ranks

    monkeypatch.setattr(ranks, "FEW", 3)
    monkeypatch.setattr(ranks, "BINS", 5)
    rng = random.Random(1)
    for values in ([3.5], [1.0, 2.0], [5.0] * 40 + [1.0], [rng.gauss(0, 1) ** 9 for _ in range(501)], [float(rng.randrange(4)) for _ in range(200)], [1e-300, 1.0, 1e300, -1e300]):
        df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double").repartition(3)
        assert ranks.quantile(df, "v") == statistics.median(values)
        assert ranks.quantile(df, "v", 0.0) == min(values) and ranks.quantile(df, "v", 1.0) == max(values)
    assert ranks.quantile(spark.createDataFrame([(None,)], "v double"), "v") is None
    with pytest.raises(ValueError):
        ranks.quantile(spark.createDataFrame([(float("inf"),)], "v double"), "v")


def test_vectors_beside_ids(spark, tmp_path):
    """Files that numpy writes, lines of any length, ranges that cut lines, repeated and null ids, several pairs."""
    import json

    import numpy as np

    from foliant.sources import npy

    rng, pairs, want = np.random.default_rng(0), [], []
    for k, (n, kind) in enumerate(((50, "<f8"), (0, "<f4"), (7, "<f4"))):
        x = rng.normal(size=(n, 5)).astype(kind)
        ids = [None if i == 3 else f"{'가' * (i % 9)}{i % 40}" for i in range(n)]
        np.save(tmp_path / f"{k}.npy", x)
        (tmp_path / f"{k}.jsonl").write_text("\n".join(json.dumps({"x": "y" * (i % 13), "id": v}, ensure_ascii=k == 0) for i, v in enumerate(ids)) + ("\n" if k == 0 else ""))
        pairs.append((str(tmp_path / f"{k}.jsonl"), str(tmp_path / f"{k}.npy")))
        want += [(len(want) + i, v, x[i].astype(np.float32).tolist()) for i, v in enumerate(ids)]
    want = [(i, *r[1:]) for i, r in enumerate(want)]
    assert npy.pairs_in(str(tmp_path)) == pairs
    for size in (1, 10, 100, 1 << 20):
        got = sorted((r.pos, r.id, list(r.embedding)) for r in npy.read_pairs(spark, pairs, range_bytes=size).collect())
        assert got == want
    last = {r.id: list(r.embedding) for r in npy.last_of_id(npy.read_pairs(spark, pairs)).collect()}
    assert last == {i: v for _, i, v in want}
    assert npy.read_pairs(spark, []).count() == npy.read_pairs(spark, pairs[1:2]).count() == 0
    with pytest.raises(ValueError, match="lines"):
        npy.read_pairs(spark, [(pairs[0][0], pairs[2][1])])
    (tmp_path / "odd.npy").write_bytes(b"not at all, no")
    with pytest.raises(ValueError):
        npy.header(str(tmp_path / "odd.npy"))
    rows = spark.createDataFrame([(str(i), [float(i), 1.0]) for i in range(20)], "id string, embedding array<float>").repartition(3)
    npy.write_pairs(rows, at := f"file://{tmp_path}/out", 2)
    assert {(r.id, *r.embedding) for r in npy.read_pairs(spark, npy.pairs_in(at)).collect()} == {(str(i), float(i), 1.0) for i in range(20)}
    assert np.load(next((tmp_path / "out").glob("*.npy"))).shape[1] == 2


def test_embedding(spark):
    from foliant.operators import embedding

    chunks = spark.createDataFrame([("a", "xx", None), ("b", "y", None), ("c", "z", [1.0, 0.0])], "chunk_id string, text string, embedding array<float>")
    factory = lambda: lambda texts: [[len(t) * 0.0 + 0.6000001, 0.8] for t in texts]
    done = spark.createDataFrame([("b",)], "chunk_id string")
    new = embedding.embed_missing(chunks, done, factory)
    assert [(r.chunk_id, [round(x, 5) for x in r.embedding]) for r in new.collect()] == [("a", [0.6, 0.8])]
    after = {r.chunk_id: r.embedding for r in embedding.apply_embeddings(chunks, new).collect()}
    assert after["a"] is not None and after["b"] is None and after["c"] == [1.0, 0.0]
    with pytest.raises(ValueError):
        embedding.apply_embeddings(chunks, embedding.embed(chunks, lambda: lambda texts: [[3.0, 4.0] for _ in texts]))


def test_ensured_summaries(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, False, None, False), (2, "p", "c", "a", "r", False, None, False), (3, None, None, None, None, True, None, False)], "doc_id long, summary_point string, summary_cause string, summary_action string, summary_result string, summary_failed boolean, summary_freeform string, freeform_failed boolean")
    texts = spark.createDataFrame([(1, "t"), (2, "t"), (3, "t")], "doc_id long, text string")
    got = {r.doc_id: r for r in summaries.ensure(docs, texts, summaries.stub).collect()}
    assert got[1].summary_point == "지적사항 한 문장" and got[2].summary_point == "p" and got[3].summary_failed


def test_sql_functions(spark):
    from foliant.functions.sql import register

    register(spark)
    assert spark.sql("SELECT explode(chunk_text('a\n\nb')) AS c").collect()[0].c == "a\n\nb"
    assert spark.sql("SELECT line_class('1. 업무') AS k").first().k == "heading"
    spark.createDataFrame([(1, "a\n\n가. 목적 "), (2, None), (3, "")], "doc_id long, text string").createOrReplaceTempView("some_texts")
    assert [tuple(r) for r in spark.sql("SELECT doc_id, c.* FROM some_texts, LATERAL chunks(doc_id, text) c").collect()] == [(1, 0, "a\n\n가. 목적")]
    assert [tuple(r) for r in spark.sql("SELECT doc_id, l.* FROM some_texts, LATERAL text_lines(text) l ORDER BY doc_id, line").collect()] == [(1, 0, "a", "body"), (1, 1, "", "blank"), (1, 2, "가. 목적 ", "heading"), (3, 0, "", "blank")]


def test_chunks_of_both_ways(spark, sf_dir):
    from foliant.plans import construction

    one = {(r.document_id, r.chunk_index, r.text) for r in construction.chunk_documents(spark, sf_dir).collect()}
    assert one == {(r.document_id, r.chunk_index, r.chunk) for r in reading.chunks_by_sql(spark, sf_dir).collect()}


def test_originals_and_replacement(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.hwpx").write_bytes(b"abc")
    assert bytes(tables.read_originals(spark, str(tmp_path), "*.hwpx").first().content) == b"abc"
    for n in (1, 2):
        tables.replace_checkpoint(spark.range(n).toDF("id"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2


def test_cells_find_the_nearest(spark, sf_dir, tmp_path):
    """Recall of at least 0.95 against the exact scan, every vector indexed; a short list of all is exact; cells that cannot hold a neighbour are not read."""
    import numpy as np

    from foliant.functions.vectors import unit
    from foliant.operators import nearest as N
    from foliant.sources.tables import table

    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("vec_id").alias("document_id"), unit("embedding").alias("unit"))
    rows = rows.unionByName(spark.createDataFrame([("none", -1, None), ("short", -2, [1.0])], "chunk_id string, document_id long, unit array<float>")).cache()
    N.write_cells(rows, path := str(tmp_path / "cells"))
    assert spark.read.parquet(f"{path}/codes").select("chunk_id").distinct().count() == spark.read.parquet(f"{path}/vectors").count() == rows.filter("size(unit) = 64").count()
    queries = {r.document_id: [float(x) for x in r.unit] for r in rows.filter("document_id % 10 = 7").collect()}
    exact = {(r.query_id, r.chunk_id) for r in N.exactly_nearest(rows.filter("size(unit) = 64"), queries, 20).collect()}
    got = {(r.query_id, r.chunk_id) for r in N.nearest_to(spark, path, queries, 20).collect()}
    assert len(exact) == 20 * len(queries) and len(got) == len(exact) and len(got & exact) >= 0.95 * len(exact)
    assert {(r.query_id, r.chunk_id) for r in N.nearest_to(spark, path, queries, 20, short=50).collect()} == exact
    assert N.nearest(spark, path, [1.0], 5).count() == N.nearest(spark, path, [0.0] * 64, 5).count() == 0
    # two far apart groups: a search of one reads no code of the other
    rng = np.random.default_rng(0)
    two = np.vstack([rng.normal(size=(600, 8)) * 0.05 + np.eye(8)[k] for k in (0, 5)])
    two /= np.linalg.norm(two, axis=1, keepdims=True)
    rows = spark.createDataFrame([(str(i), i, v.tolist()) for i, v in enumerate(two)], "chunk_id string, document_id long, unit array<float>")
    N.write_cells(rows, path := str(tmp_path / "two"))
    seen, scan = [], N._scan
    N._scan = lambda *a: seen.append(a[5]) or scan(*a)
    try:
        assert {r.document_id // 600 for r in N.nearest(spark, path, np.eye(8)[5].tolist(), 10).collect()} == {1}
    finally:
        N._scan = scan
    read = spark.read.parquet(f"{path}/codes").filter(F.col("cell").isin([c for x in seen for c in x[0]]))
    assert read.count() <= 600 and read.filter("document_id < 600").count() == 0
    N.write_cells(rows.limit(0), path := str(tmp_path / "none"))
    assert N.nearest(spark, path, [1.0], 10).count() == 0


def test_cells_lose_no_neighbour_among_many(spark, tmp_path, monkeypatch):
    """Of vectors without clusters, of a tight cluster whose vectors codes do not tell apart, and of one vector many times, the index finds what a scan finds: by list through the driver and by join."""
    import numpy as np

    from foliant.operators import nearest as N

    rng = np.random.default_rng(3)
    tight = rng.normal(size=64) + rng.normal(size=(400, 64)) * 0.02
    own = np.vstack([rng.normal(size=(3000, 64)), tight, np.repeat(rng.normal(size=(1, 64)), 300, axis=0)])
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    rows = spark.createDataFrame([(f"c{i}", i, v.tolist()) for i, v in enumerate(own)], "chunk_id string, document_id long, unit array<float>").repartition(7)
    N.write_cells(rows, path := str(tmp_path / "cells"))
    queries = {i: own[i].tolist() for i in (0, 1, 2, 3001, 3100, 3500)}
    exact = {(r.query_id, r.chunk_id) for r in N.exactly_nearest(rows, queries, 100).collect()}
    # ties by id: the first of the copies in the order of ids
    assert {c for q, c in exact if q == 3500} == set(sorted(f"c{i}" for i in range(3400, 3700))[:100])
    found = lambda: {(r.query_id, r.chunk_id) for r in N.nearest_to(spark, path, queries, 100).collect()}
    assert found() == exact
    monkeypatch.setattr(N, "LISTED", 50)
    assert found() == exact


def test_a_lookup_reads_one_row_group(spark, tmp_path):
    from foliant.sources.points import read_points, write_points

    rows = spark.range(60_000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("key"), F.sha2(F.col("id").cast("string"), 512).alias("v"))
    write_points(rows.repartition(7), path := str(tmp_path / "p"), "key", group_bytes=100_000)
    assert read_points(spark, path, "key", ["k000123", "k059999", "k000123", None, "none"]).count() == 2
    assert read_points(spark, path, "key", []).count() == read_points(spark, path, "key", ["k", "z"]).count() == 0
    many = [f"k{i:06d}" for i in range(0, 60_000, 50)]
    assert {r.key for r in read_points(spark, path, "key", many).collect()} == set(many)

    def scanned(values):
        df = read_points(spark, path, "key", values)
        df.collect()
        node = df._jdf.queryExecution().executedPlan()
        while node.children().size():
            node = node.children().head()
        return node.metrics().apply("numOutputRows").value()

    import pyarrow.parquet as pq

    files = [pq.ParquetFile(p).metadata for p in (tmp_path / "p").glob("*.parquet")]
    groups = [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]
    assert len(groups) > 20 and 0 < scanned(["k031234"]) <= max(groups) and 0 < scanned(["k031234", "k000002"]) <= 2 * max(groups)


def test_search_reads_what_is_stored(spark, tmp_path):
    """All terms must occur; chunks without a vector are found by their words, and zero vectors by nothing else."""
    rows = [("a", 1, "The cat, the Dog", [1.0, 0.0]), ("b", 2, "the cat", None), ("c", 3, "dog_1 the", [0.0, 0.0]), ("d", 4, None, [0.6, 0.8])]
    search.write_index(spark.createDataFrame(rows, "chunk_id string, document_id long, text string, embedding array<float>"), str(tmp_path / "i"))
    index = search.read_index(spark, str(tmp_path / "i"))
    assert [(r.chunk_id, r.score, r.rank_text) for r in search.text_topk(index.postings, "THE cat the").collect()] == [("a", 3, 1), ("b", 2, 2)]
    assert search.text_topk(index.postings, " ,. ").count() == 0 and search.text_topk(index.postings, "the bird").count() == 0
    assert [(r.chunk_id, round(r.distance, 6)) for r in search.vector_topk(index.chunks, [3.0, 0.0]).collect()] == [("a", 0.0), ("d", 0.4)]
    assert search.vector_topk(index.chunks, [0.0, 0.0]).count() == 0
    docs = spark.createDataFrame([(i, "t") for i in range(1, 5)], "document_id long, raw_text string")
    assert [r.document_id for r in search.hybrid_search(index, docs, [1.0, 0.0], "the").collect()] == [1, 2, 4, 3]
    assert [r.document_id for r in search.hybrid_search(index, docs, [1.0, 0.0], "the", leg=search.ranked_topk).collect()] == [1, 2, 4, 3]
    assert {r.term: r.gaps for r in index.postings.filter("chunk_id = 'a'").collect()} == {"the": [1, 2], "cat": [2], "dog": [4]}


def plain_rank(places):
    """The rank pair by pair, as it is defined."""
    if len(places) == 1:
        return sum(0.1 / k**2 for k in range(1, len(places[0]) + 1)) / 1.64493406685
    out = -1.0
    for i in range(1, len(places)):
        for k in range(i):
            for a in places[i]:
                for b in places[k]:
                    if d := abs(a - b):
                        w = (0.01 * (1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)))) ** 0.5
                        out = w if out < 0 else 1 - (1 - out) * (1 - w)
    return out if out >= 0 else 1e-20


def test_rank_by_places(spark, tmp_path):
    import numpy as np

    for places in ([[1, 5, 9]], [[1, 2], [3, 400]], [[1], [2], [3]], [[7], [7]], [list(range(1, 300, 3)), list(range(2, 900, 7))]):
        assert abs(search.rank_of_places([np.array(p) for p in places]) - plain_rank([p[:256] for p in places])) < 1e-12
    rows = [("near", 1, "the cat sat", None), ("far", 2, "the dog and then one more cat", None), ("often", 3, "the cat the cat", None), ("one", 4, "cat", None), ("null", 5, None, None)]
    search.write_index(spark.createDataFrame(rows, "chunk_id string, document_id long, text string, embedding array<float>"), str(tmp_path / "i"))
    index = search.read_index(spark, str(tmp_path / "i"))
    assert [r.chunk_id for r in search.ranked_topk(index.postings, "the cat").collect()] == ["often", "near", "far"]
    assert [(r.chunk_id, round(r.score, 6)) for r in search.ranked_topk(index.postings, "cat", 2).collect()] == [("often", round(0.125 / 1.64493406685, 6)), ("far", round(0.1 / 1.64493406685, 6))]
    assert search.ranked_topk(index.postings, " ").count() == 0


def test_an_index_is_written_anew_when_its_table_changes(spark, tmp_path):
    from foliant.sources.shared import once

    spark.range(3).write.parquet(at := str(tmp_path / "t"))
    made = []
    use = lambda: once(spark, "test of once", made.append, at)
    assert use() == use() and len(made) == 1
    spark.range(1).write.mode("append").parquet(at)
    assert use() != made[0] and len(made) == 2


def test_postings_go_by_pieces(spark):
    """A batch is bounded in rows, not in bytes: what a worker has at once is a piece, of which the postings are one run in the order of terms. Nulls and empty texts have none."""
    import pyarrow as pa

    from foliant.functions.udfs import pieces

    sizes = [0, 0, 300, 500, 200, 2000, 10, 990, 1]
    own = [None, *("é" * (n // 2) + "x" * (n % 2) for n in sizes[1:])]
    parts = list(pieces(pa.array(own), 1000))
    assert [k for a, n in parts for k in range(a, a + n)] == list(range(len(own)))
    assert all(n == 1 or sum(sizes[a : a + n]) <= 1000 for a, n in parts)
    texts = [" ".join(f"w{(i * 7919 + k) % 30_011}" for k in range(1000)) + " w1 W1" for i in range(1500)]
    batch = pa.RecordBatch.from_pydict({"chunk_id": [f"c{i}" for i in range(1500)], "document_id": list(range(1500)), "text": texts})
    tracemalloc.start()
    got = [(len(b), b["term"].to_pylist()[:1000]) for b in search.runs(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) >= 2 and all(t == sorted(t) for _, t in got) and peak < 250e6
    rows = spark.createDataFrame([("a", 1, "The of_the, the"), ("b", 2, None), ("c", 3, ""), ("d", 4, "é the É")], "chunk_id string, document_id long, text string")
    want = {("the", "a", 1, 2, (1, 2)), ("of_the", "a", 1, 1, (2,)), ("é", "d", 4, 2, (1, 2)), ("the", "d", 4, 1, (2,))}
    plan = search.postings_of(rows)
    assert {(*r[:4], tuple(r.gaps)) for r in plan.collect()} == want and "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_fragments_that_hold_their_glyphs(spark):
    """They give what rows of glyphs give, and dealt by document are not shuffled again: of a query over documents only the texts are."""
    flat = reading.glyphs(spark)
    own = F.array_sort(F.collect_list(F.struct("seq", "c", "x0", "x1", "y0", "y1"))).alias("glyphs")
    held = flat.groupBy("doc_id", "page", "page_width", "fragment").agg(own)
    for read in (layout.page_rows, layout.page_lines, layout.document_text, lambda g: layout.two_columns(layout.page_lines(g)), lambda g: layout.multicolumn_pages(layout.page_lines(g))):
        columns = read(flat).columns
        assert sorted(read(held).select(columns).collect()) == sorted(read(flat).collect())
    for read in (layout.page_rows, layout.document_text, lambda g: layout.two_columns(layout.page_lines(g))):
        plan = read(reading.laid_out(spark, DATA))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan


def test_texts_reach_workers_by_pieces(spark):
    """Of a batch of long texts an Arrow UDF, and summaries, have only a piece at once as Python's strings. Nulls stay null."""
    import pyarrow as pa

    from foliant.functions.udfs import PIECE_BYTES, by_pieces, html_unescape

    live, most = [], []

    def one(text):
        live.append(len(text))
        return text[:1]

    run = by_pieces(one, T.StringType()).func
    texts = pa.array([*(chr(97 + k % 26) * 100_000 for k in range(60)), None])
    for part in run(iter([texts])):
        most.append((len(part), sum(live)))
        live.clear()
    assert sum(n for n, _ in most) == 61 and max(b for _, b in most) <= PIECE_BYTES and len(most) > 5
    rows = [(k, "&amp;" * 100_000 if k % 2 else None) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.n for r in docs.select("doc_id", F.length(html_unescape("text")).alias("n")).collect()}
    assert got == {k: 100_000 if k % 2 else None for k in range(12)}
    answers = summaries.summarise(docs, lambda t: "a\nb\nc\nd" if t else None).collect()
    assert sorted((r.doc_id, r.failed) for r in answers) == [(k, k % 2 == 0) for k in range(12)]


def test_titles_are_cut_before_the_join(spark):
    """The store that searches read moves first characters only; whole texts are read by id from their own."""
    own = retrieval.documents(spark, DATA, F.substring("text", 1, 5).alias("title_buffer"))
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("substring(")
    whole = {r.document_id: r.raw_text for r in retrieval.documents(spark, DATA).collect()}
    assert {r.document_id: r.title_buffer for r in own.collect()} == {k: x[:5] for k, x in whole.items()}
    assert [r.raw_text for r in retrieval.document_detail(spark, DATA).collect()] == [whole[7]]


def test_fragments_hold_glyphs_in_two_ways(spark):
    """Rows of glyphs, arrays of glyphs and arrays of their fields give the same lines, in order or not, touching or apart; glyphs of documents are laid out and boxed without a lambda for each."""
    own = [(f, [(q, c, 10.0 * f + x, 10.0 * f + x + w, 5.0, 9.0) for q, c, x, w in g]) for f, g in enumerate([
        [(0, "a", 0.0, 6.0), (1, "b", 6.0, 6.0), (2, "c", 12.0, 6.0)], [(2, "c", 12.0, 6.0), (0, "a", 0.0, 6.0), (1, "b", 6.0, 6.0)], [(0, "a", 0.0, 6.0), (1, "b", 9.0, 6.0), (2, " ", 20.0, 6.0), (3, "c", 40.0, 6.0)],
        [(0, "z", 6.0, 6.0), (5, "y", 12.0, 6.0)], [(0, "q", 0.0, 6.0)], [(0, "a", 0.0, 6.0), (1, None, 6.0, 6.0), (2, "b", 12.0, 6.0)], [(1, "y", 6.0, 6.0), (1, "x", 0.0, 6.0)], [(0, "a", 0.0, float("nan")), (1, "b", float("nan"), 6.0)],
    ])]
    arrays = spark.createDataFrame([(1, f, 600.0, 0, g) for f, g in own], "doc_id long, page int, page_width double, fragment int, glyphs array<struct<seq: int, c: string, x0: double, x1: double, y0: double, y1: double>>")
    fields = ["seq", "c", "x0", "x1", "y0", "y1"]
    structs = arrays.withColumn("glyphs", F.struct(*[F.col(f"glyphs.{c}").alias(c) for c in fields]))
    rows = arrays.select("doc_id", "page", "page_width", "fragment", F.explode("glyphs").alias("g")).select("doc_id", "page", "page_width", "fragment", "g.*")
    read = lambda g: {r.page: r.text for r in layout.page_lines(g).collect()}
    assert read(structs) == read(arrays) == read(rows) == {0: "abc", 1: "abc", 2: "a b c", 3: "zy", 4: "q", 5: "ab", 6: "xy", 7: "a b"}
    plan = layout.page_rows(reading.laid_out(spark, DATA))._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan
