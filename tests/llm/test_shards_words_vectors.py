"""Sharding, spelling variants and whitening against plain versions, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import queries, sharding, variants, whitening
from foliant.llm.common import new_path, table

SCHEMA = "doc_id long, text string, slot string, shard string, _bucket string, _h string"


# --- sharding ------------------------------------------------------------------------------------------------------


def records(spark, rows, parts=3):
    """With columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, "x", "y", "z", None) for r in rows], SCHEMA).repartition(parts)


def in_shards(spark, docs, shards=8, **how):
    sharding.write_shards(docs, path := new_path(spark, "shards"), shards, **how)
    return path, sharding.read_shards(spark, path, docs.schema)


def assert_dealt(rows, docs, shards):
    assert collections.Counter(tuple(r)[:6] for r in rows) == collections.Counter(tuple(r) for r in docs.collect())
    of = collections.defaultdict(list)
    for r in rows:
        of[r["shard_"]].append(r["slot_"])
    n = [len(of[k]) for k in range(shards)]
    assert set(of) <= set(range(shards)) and sum(n) == len(rows) and max(n) - min(n) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in of.values())


def test_every_record_has_one_place(spark):
    rng = random.Random(3)
    rows = [(i, "w" * rng.randrange(900)) for i in range(400)] + [(None, None), (7, ""), (8, None), (9, "long " * 40_000), (5, "tie"), (5, "tie"), (None, "tie")]
    docs = records(spark, rows)
    path, got = in_shards(spark, docs, bucket_bytes=20_000)
    first = got.collect()
    assert_dealt(first, docs, 8)
    assert [f.name for f in got.schema.fields] == [*docs.columns, "slot_", "shard_"]
    assert sharding.plan(docs, bucket_bytes=20_000).buckets > 10
    # the order of a file is that of its slots
    inside = spark.read.schema(got.schema).parquet(path).select("shard_", "slot_", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).collect()
    by_file = collections.defaultdict(list)
    for r in sorted(inside, key=lambda r: r.i):
        by_file[r.f].append(r["slot_"])
    assert all(x == sorted(x) for x in by_file.values())
    # the same on any number of partitions, another order with another seed
    place = lambda df: sorted((r.doc_id or -1, r.text or "", r["shard_"], r["slot_"]) for r in df.collect())
    assert place(got) == place(in_shards(spark, records(spark, rows, 7), bucket_bytes=20_000)[1])
    assert place(got) != place(in_shards(spark, docs, bucket_bytes=20_000, seed=2)[1])


def test_order_is_random(spark):
    """Places of ids neither follow ids nor depend on the bucket alone, and neighbours are spread over all shards."""
    docs = records(spark, [(i, "text") for i in range(4000)])
    rows = in_shards(spark, docs, bucket_bytes=1500)[1].orderBy("shard_", "slot_").collect()
    order = np.array([r.doc_id for r in rows])
    assert abs(np.corrcoef(order, np.arange(len(order)))[0, 1]) < 0.06
    assert abs(np.corrcoef(order[1:], order[:-1])[0, 1]) < 0.06
    counts = np.bincount([r["shard_"] for r in rows if r.doc_id < 800], minlength=8)
    assert counts.min() > 60 and counts.max() < 145


def test_fisher_yates_is_uniform():
    seen = collections.Counter(tuple(sharding.fisher_yates(4, 1, k)) for k in range(24_000))
    assert len(seen) == 24 and 850 < min(seen.values()) and max(seen.values()) < 1150
    assert sharding.fisher_yates(0, 1, 0).tolist() == []


def test_many_equal_records_are_spread(spark):
    """A third of all rows are one record: no bucket gets them all."""
    docs = spark.createDataFrame([(i, f"text {i}", *"xyzw") for i in range(8000)], SCHEMA).unionByName(records(spark, [(1, "again and again")]).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(4000)))).drop("n"))
    docs.write.parquet(at := new_path(spark, "in"))
    docs = spark.read.parquet(at)
    own = sharding.plan(docs, bucket_bytes=10_000)
    assert own.spread is not None and own.counts.sum() == 12_000 and own.counts.max() < 3 * own.counts.mean()
    assert_dealt(in_shards(spark, docs, bucket_bytes=10_000)[1].collect(), docs, 8)


def test_few_and_no_records(spark):
    docs = records(spark, [(1, "a"), (2, None), (3, "")], 1)
    assert_dealt(in_shards(spark, docs)[1].collect(), docs, 8)
    assert in_shards(spark, docs.limit(0))[1].count() == 0
    assert in_shards(spark, docs, shards=1)[1].filter("shard_ <> 0").count() == 0


def test_input_that_changes_is_an_error(spark):
    other = F.udf(lambda i: f"{i} {random.random()}").asNondeterministic()
    docs = spark.range(500).select(F.col("id").alias("doc_id"), other("id").alias("text"))
    with pytest.raises(Exception, match="records"):
        in_shards(spark, docs, bucket_bytes=1000)


def test_sharding_query(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").collect()}
    rows = queries.op11_sharding(spark, sf_dir).collect()
    assert {(r.doc_id, r["size"], r.text_crc32) for r in rows} == {(i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs.items()}
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    n = collections.Counter(r.shard for r in rows)
    assert set(n) == set(range(8)) and max(n.values()) - min(n.values()) <= 1 and len({(r.shard, r.slot) for r in rows}) == len(docs)


# --- spelling variants ---------------------------------------------------------------------------------------------


def plain_words(rows, every=31):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def distance_is_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def plain_variants(n):
    out = {}
    for w in n:
        near = [x for x in n if distance_is_one(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        out[w] = [n[w], len(near), best if near and n[best] >= 10 * n[w] else None]
    for w, row in out.items():
        at = w
        while out[at][2]:
            at = out[at][2]
        row.append(at)
    return out


def found_variants(df):
    rows = df.collect()
    assert all((r.form is None) == (r.form_n is None) for r in rows) and len({r.word for r in rows}) == len(rows)
    return {r.word: [r.n, r.n_near, r.form, r.root] for r in rows}


def test_variants_of_odd_texts(spark):
    rng = random.Random(5)
    base = ["committee", "comittee", "aaaaaaa", "aaaaaaaa", "Àéîõüÿñç", "àéîõüÿñç", "abcdefgh", "bcdefgha", "x" * 3000, "x" * 2999]
    rows = [(i, " ".join(rng.choice(base) + rng.choice([" ", ", ", "1", "\n", "_", "日"]) for _ in range(60))) for i in range(120)]
    rows += [(None, "Committee COMMITTEE"), (1, None), (2, ""), (3, "short 123"), (3, "short 123")] + [(4, "repeated rows")] * 3 + [(5, "tretion tretiom tretiom tretion " + "tretios " * 2 + "tretiox " * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("word", F.lit("w")).withColumn("n", F.lit(1)).withColumn("key", F.lit("k"))
    got = found_variants(variants.variants(variants.counted(variants.worn(variants.runs(docs), 31))))
    assert got == plain_variants(plain_words(rows)) and got["tretion"][2] == "tretiox" and got["repeated"][0] == 3
    assert variants.variants(variants.counted(variants.worn(variants.runs(docs.limit(0)), 31))).count() == 0


def test_chains_ties_and_near_words(spark):
    """Forms of forms, ties by code point, deletions within equal letters, and words that share a key but are two steps apart."""
    words = {"aaaaaaa": 1000, "aaaaaab": 100, "aaaaabb": 10, "aaaabbb": 1, "mmmmmmm": 1, "mmmmmmz": 10, "mmmmmmÿ": 10, "mmmmmma": 9, "abcdefgh": 50, "bcdefgha": 2, "ccddeeff": 3, "cccddeeff": 30, "éccddeeff": 30}
    got = found_variants(variants.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == plain_variants(words)
    assert got["aaaabbb"][3] == "aaaaaaa" and got["mmmmmmm"][2] == "mmmmmmz" and got["abcdefgh"][1] == 0 and got["ccddeeff"][2] == "cccddeeff"


def test_random_words(spark):
    rng = random.Random(9)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(7, 10))): rng.choice([2, 3, 30, 400]) for _ in range(500)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert found_variants(variants.variants(df)) == plain_variants(words)
    pairs = variants.near_words(df).select("word", "other").collect()
    assert len(set(map(tuple, pairs))) == len(pairs)


# --- whitening -----------------------------------------------------------------------------------------------------


def vectors(spark, rows, parts=5):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts).withColumn("x", F.lit("x")).withColumn("n", F.lit(0)).withColumn("deviation", F.lit("d"))


def plain_whitening(rows):
    """By the eigenvectors of the covariance in long doubles, over Python's integers."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(axis=0)
    deviation = [sum((n * a - b) ** 2 for a, b in zip(row, s)) for row in x]
    centred = ((n * x - s) / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    return deviation, centred, values[order], axes[:, order]


def assert_whitened(got, rows, model, most=32):
    deviation, centred, values, axes = plain_whitening(rows)
    k = min(most, len(values))
    assert model.n == len(rows) and np.allclose(model.eigenvalues[:k], values[:k], rtol=1e-9) and np.isclose(model.trace, values.sum(), rtol=1e-12)
    want = centred @ axes[:, :k] / np.sqrt(values[:k])
    by_row = sorted(zip([r[0] for r in rows], deviation, want.tolist()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    mine = sorted(((r.vec_id, r["dev"], r["white"]) for r in got), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert [r[:2] for r in mine] == [r[:2] for r in by_row]
    a, b = np.array([r[2] for r in mine]), np.array([r[2] for r in by_row])
    assert np.allclose(np.abs(a), np.abs(b), atol=1e-6)
    assert np.allclose(np.abs((a * b).sum(axis=0)), (b * b).sum(axis=0), rtol=1e-6)  # one sign for all rows
    cov = (a - a.mean(axis=0)).T @ (a - a.mean(axis=0)) / len(a)
    assert np.abs(cov - np.eye(k)).max() < 1e-9


def whiten(spark, df, **how):
    own = whitening.usable(df)
    model = whitening.fit(own)
    return model, whitening.whitened(own, model, names=("dev", "white"), **how)


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(4)
    good = [(i, [float(np.float32(c)) for c in rng.normal(size=40) * np.linspace(3, 0.2, 40) + 7]) for i in range(700)]
    good += [(None, good[3][1]), (5, good[5][1])] + [(9000 + i, good[6][1]) for i in range(250)]
    bad = [(1000, None), (1001, []), (1002, [1.0] * 39), (1003, [None] + [1.0] * 39), (1004, [float("nan")] + [1.0] * 39), (1005, [float("inf")] * 40), (1006, [-float("inf")] + [0.0] * 39), (1007, [1e30] * 40), (1008, [1.0] * 41)]
    df = vectors(spark, good + bad)
    model, rows = whiten(spark, df)
    assert_whitened(rows.collect(), good, model)
    assert rows.columns == [*df.columns, "dev", "white"]
    assert whitening.identity_error(rows, "white") < 1e-9
    assert [len(r.white) for r in whiten(spark, df, most=3)[1].limit(5).collect()] == [3] * 5


def test_summaries_merge_without_loss(monkeypatch):
    """Any split and order of merging gives the decomposition of all rows at once, and the mean's size costs nothing."""
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(300, 12)) * 50).astype(np.int64) + 10**6
    whole = whitening.summary_of(x)
    for cut in ([1, 2, 3, 150], [299], list(range(7, 300, 7))):
        parts = [whitening.summary_of(p) for p in np.split(x, cut)]
        total = parts[0]
        for p in parts[1:]:
            total = whitening.merged(total, p)
        assert total.n == 300 and total.sums == [int(v) for v in x.sum(axis=0)] and len(total.singular) == 12
        assert np.allclose(total.singular, whole.singular, rtol=1e-10)
        assert np.allclose(np.abs(total.axes @ whole.axes.T), np.eye(12), atol=1e-7)


def test_dimensions_without_variance_and_few_rows(spark):
    rng = np.random.default_rng(2)
    flat = [(i, [*rng.normal(size=3).astype(np.float32).astype(float).tolist(), 5.0, 5.0]) for i in range(90)]
    model, rows = whiten(spark, vectors(spark, flat))
    assert len(model.axes) == 3 and {len(r.white) for r in rows.collect()} == {3} and whitening.identity_error(rows, "white") < 1e-9
    model, rows = whiten(spark, vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]))
    assert [(r.dev, r.white) for r in rows.collect()] == [(0, []), (0, [])]
    assert whitening.fit(whitening.usable(vectors(spark, [(1, None)]))) is None
    big = [10**9 + 7, 3]
    assert whitening._deviations(np.array([big, [10**9, 0]]), 2 * 10**9, [2 * 10**18, 0]) == [None, 0]
    assert whitening._deviations(np.array([[10**6 + 1, 10**6]]), 10, [10**7, 10**7 + 5]) == [125]


def test_whitening_query(spark, sf_dir, tmp_path):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf_dir, "embeddings").collect()]
    got = queries.op13_whitening(spark, sf_dir)
    assert got.count() == 32 * len(rows)
    first = {r.vec_id: r for r in got.filter("component = 1").collect()}
    deviation, _, values, _ = plain_whitening(rows)
    assert [first[i].deviation for i, _ in rows] == deviation and {r.n for r in first.values()} == {len(rows)}
    assert np.isclose(first[rows[0][0]].explained, values[0] / values.sum(), rtol=1e-10) and 0 <= first[rows[0][0]].identity_error < 1e-9
    table(spark, sf_dir, "embeddings").limit(0).write.parquet(str(tmp_path / "embeddings.parquet"))
    none = queries.op13_whitening(spark, str(tmp_path))
    assert none.count() == 0 and none.dtypes == got.dtypes


# --- what workers keep ---------------------------------------------------------------------------------------------


def test_what_one_operator_keeps_goes_when_another_begins():
    from foliant.llm import common, jaccard, licenses, tokenstore

    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    enc = tokenstore.encoder(path)
    assert tokenstore.encoder(path) is enc
    next(jaccard._sets(False)(iter([])), None)
    assert list(common._states) == ["jaccard"] and tokenstore.encoder(path) is not enc
    long = "MIT License " + "x" * 10_000
    licenses._remembered.cache_clear()
    licenses.best(long), licenses.best("MIT License")
    assert licenses._remembered.cache_info().currsize == 1
    assert jaccard.deals(10, 5 * jaccard.GROUP_TOKENS) == 6


def test_a_run_that_is_lost_with_its_recipes_is_noticed(spark):
    """The root over all runs is stored last, and without it no document is valid."""
    import public_tokenizers

    from foliant.llm import tokenstore

    docs = spark.createDataFrame([(i, f"text number {i} and more") for i in range(40)], "doc_id long, text string")
    tokenstore.write_store(docs, path := new_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    assert all(r.valid for r in tokenstore.document_sums(spark, path).collect())
    runs = [r.run for r in spark.read.parquet(f"{path}/manifest").collect()]
    assert len(runs) > 1
    for name in ("manifest", "recipes"):
        rows = spark.read.parquet(f"{path}/{name}").filter(f"run <> {max(runs)}").collect()
        spark.createDataFrame(rows, spark.read.parquet(f"{path}/{name}").schema).write.mode("overwrite").parquet(f"{path}/{name}")
    got = tokenstore.document_sums(spark, path).collect()
    assert 0 < len(got) < 40 and not any(r.valid for r in got)


@pytest.mark.parametrize("shards", [64, 1000])
def test_a_partition_for_each_shard_of_a_mix(spark, shards):
    """However many shards there are, a partition holds one, and all copies are in that of their shard."""
    from foliant.llm import mixing

    rng = random.Random(shards)
    rows = [(i, " ".join(["word"] * rng.randrange(1, 40)), f"s{i % 3}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keep, mixing.BLOCK_WORDS = mixing.BLOCK_WORDS, 20
    try:
        where = collections.defaultdict(collections.Counter)
        for r in mixing.mix(docs, shards=shards).collect():
            for c in r.copies:
                where[c.shard][r.doc_id] += 1
        parts = mixing.mixed(docs, shards=shards).rdd.glom().collect()
    finally:
        mixing.BLOCK_WORDS = keep
    assert len(parts) == max(where) + 1 > shards // 2
    assert [collections.Counter(r.doc_id for r in p) for p in parts] == [where[k] for k in range(len(parts))]


def test_larger_mixes_have_more_shards(spark, monkeypatch):
    from foliant.llm import mixing

    monkeypatch.setattr(mixing, "SHARDS", 2)
    monkeypatch.setattr(mixing, "SHARD_WORDS", 100)
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 10)
    docs = spark.createDataFrame([(i, "one two three four five", "s") for i in range(200)], "doc_id long, text string, source string")
    assert {c.shard for r in mixing.mix(docs).collect() for c in r.copies} == set(range(16))
