"""Layers and versions: what a version shows, conflicts, what a change writes, and indexes that change."""

import pathlib

import pytest
from pyspark.sql import functions as F

from foliant.operators import search
from foliant.sources import layers


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id long, v string")


def put(df):
    return lambda path: df.write.parquet(f"{path}/t")


def shown(spark, folder, at=None):
    return sorted(map(tuple, layers.read(spark, folder, "t", "id", at).collect()), key=str)


def test_changes(spark, tmp_path):
    f, gone = str(tmp_path / "f"), lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    assert layers.latest(spark, f).number == 0
    one = layers.add(spark, f, put(rows(spark, (1, "a"), (2, "b"), (2, "b2"), (3, "c"), (None, "n"))))
    two = layers.add(spark, f, put(rows(spark, (2, "B"), (4, "d"))), gone(2, 2, None))
    three = layers.add(spark, f, lambda path: None, gone(1, 4, 99))
    four = layers.add(spark, f, put(rows(spark, (1, "again"))))
    assert shown(spark, f, one) == [(1, "a"), (2, "b"), (2, "b2"), (3, "c"), (None, "n")]
    assert shown(spark, f, two) == [(1, "a"), (2, "B"), (3, "c"), (4, "d"), (None, "n")]
    assert shown(spark, f, three) == [(2, "B"), (3, "c"), (None, "n")]
    assert shown(spark, f) == [(1, "again"), (2, "B"), (3, "c"), (None, "n")]
    changes = lambda a, b: sorted(map(tuple, layers.diff(spark, f, "t", "id", a, b).collect()))
    assert changes(one, two) == [(2, "replaced"), (4, "inserted")] and changes(two, one) == [(2, "replaced"), (4, "deleted")]
    assert changes(two, three) == [(1, "deleted"), (4, "deleted")] and changes(one, four) == [(1, "replaced"), (2, "replaced")] and changes(four, four) == []
    merged = layers.merge(spark, f, lambda path, at: layers.read(spark, f, "t", "id", at).write.parquet(f"{path}/t"))
    assert len(merged.layers) == 1 and shown(spark, f) == shown(spark, f, four)
    assert layers.version(spark, f, 2) == two and layers.version(spark, f, 9) is None


def test_of_two_writers_one_wins(spark, tmp_path):
    f = str(tmp_path / "f")
    base = layers.add(spark, f, put(rows(spark, (1, "a"))))
    layers.add(spark, f, put(rows(spark, (2, "b"))), base=base)
    with pytest.raises(layers.Conflict):
        layers.add(spark, f, put(rows(spark, (3, "c"))), base=base)
    assert shown(spark, f) == [(1, "a"), (2, "b")]
    # a reader keeps its version while the table is replaced; half a version file is none
    open_ = layers.read(spark, f, "t", "id", layers.latest(spark, f))
    layers.add(spark, f, put(rows(spark, (9, "z"))), alone=True)
    assert open_.count() == 2 and shown(spark, f) == [(9, "z")]
    (tmp_path / "f" / "versions" / f"{4:020d}").write_text("[")
    assert layers.latest(spark, f).number == 3 and shown(spark, f) == [(9, "z")]


def test_many_keys_are_joined_by_a_shuffle(spark, tmp_path, monkeypatch):
    f = str(tmp_path / "f")
    layers.add(spark, f, put(spark.range(1000).select("id", F.lit("x").alias("v"))))
    layers.add(spark, f, lambda path: None, spark.range(400))
    monkeypatch.setattr(layers, "BROADCAST_KEYS", 10)
    assert len(shown(spark, f)) == 600


def size(path):
    return sum(p.stat().st_size for p in pathlib.Path(path).rglob("*.parquet"))


def test_what_is_written_follows_what_is_changed(spark, sf_dir, tmp_path):
    """An update of a few rows of lineitem writes these."""
    f = str(tmp_path / "f")
    own = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumnRenamed("l_orderkey", "id")
    first = layers.add(spark, f, put(own))
    keys = own.select("id").distinct().orderBy("id").limit(5)
    second = layers.add(spark, f, put(own.join(keys, "id", "left_semi").withColumn("l_comment", F.lit("new")) if "l_comment" in own.columns else own.join(keys, "id", "left_semi")), keys)
    assert size(f"{f}/{second.layers[1][0]}") < 0.1 * size(f"{f}/{first.layers[0][0]}")
    assert layers.read(spark, f, "t", "id").count() == own.count()


CHUNKS = "chunk_id string, document_id long, text string, embedding array<float>"


def test_an_index_that_changes_is_searched_as_one_written_anew(spark, tmp_path):
    f = str(tmp_path / "live")
    frame = lambda *r: spark.createDataFrame(list(r), CHUNKS)
    ids = lambda *i: spark.createDataFrame([(x,) for x in i], "document_id long")
    docs = spark.createDataFrame([(i, f"doc {i}") for i in range(1, 6)], "document_id long, raw_text string")
    a, b, c, d = ("a", 1, "the cat", [1.0, 0.0]), ("b", 2, "the dog", [0.0, 1.0]), ("c", 3, "the cat and the dog", None), ("d", 4, "no such", [0.7, 0.7])
    search.change_index(spark, f, frame(a, b))
    before = size(f)
    search.change_index(spark, f, frame(c, d))
    search.change_index(spark, f, frame(("b", 2, "a cat the cat", [1.0, 0.1])), ids(2))
    search.change_index(spark, f, None, ids(1))
    assert size(f) < 5 * before
    search.write_index(frame(("b", 2, "a cat the cat", [1.0, 0.1]), c, d), str(tmp_path / "new"))
    new, live = search.read_index(spark, str(tmp_path / "new")), search.open_index(spark, f)
    find = lambda index: [tuple(r) for r in search.hybrid_search(index, docs, [1.0, 0.0], "the cat").collect()]
    assert find(live) == find(new) and {r[0] for r in find(live)} == {2, 3, 4}
    search.merge_index(spark, f)
    assert find(search.open_index(spark, f)) == find(new) and len(layers.latest(spark, f).layers) == 1
    assert find(search.open_index(spark, f, layers.version(spark, f, 1))) != find(new)


def test_long_lists_of_keys_are_joined_and_not_compiled(spark, tmp_path):
    """A list of more than MOST_KEYS has no equality for each key in its plan, and one of as many is a filter still."""
    from foliant.sources import points

    points.write_points(spark.range(5000).selectExpr("id", "concat('x', id) as name"), path := str(tmp_path / "points"), "name")
    many = [f"x{i}" for i in range(1000, 4000)]
    got = points.read_points(spark, path, "name", [*many, "none", None, "x1000"])
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert got.columns == ["id", "name"] and sorted(r.name for r in got.collect()) == sorted(many)
    assert {r.id for r in points.read_points(spark, path, "name", many[:20]).collect()} == set(range(1000, 1020))


def test_parts_of_an_index_are_written_apart(spark, tmp_path):
    """A part needs its own columns only, and no other part is written."""
    import os

    from foliant.operators import search

    own = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("b", 2, None)], "chunk_id string, document_id long, embedding array<float>")
    at = search.change_index(spark, folder := str(tmp_path / "index"), own, parts=("chunks",))
    assert [n for n in os.listdir(f"{folder}/{at.layers[0][0]}") if not n.startswith(".")] == ["chunks"]
    own = own.drop("embedding").withColumn("text", F.lit("two words"))
    at = search.change_index(spark, folder, own, parts=("postings",))
    assert [n for n in os.listdir(f"{folder}/{at.layers[1][0]}") if not n.startswith(".")] == ["postings"]
