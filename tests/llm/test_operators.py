"""Each dealt operator against a plain version, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import common, decontaminate, jaccard, language, licenses, mixing, quality, repeats, tokenstore, topk, warc
from foliant.llm.common import Words, new_path, table, written
from foliant.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def docs(spark, rows, parts=3):
    """With columns whose names operators use themselves."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts) if rows else spark.createDataFrame([], SCHEMA)
    return df.withColumn("n", F.lit(7)).withColumn("block", F.lit("x")).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 3)).withColumn("lang", F.lit("en"))


@pytest.fixture(scope="module")
def rng():
    return random.Random(11)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", ",", ".\n"]) for _ in range(n))


def near(rng, text, edits):
    w = text.split(" ")
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
    return " ".join(w)


# --- shared --------------------------------------------------------------------------------------------------------


def test_words_and_shingles(rng):
    texts = ["", " ", "One two", "a b c d e", "A b\tC d\x0bE f", "é É x\x1cy z", prose(rng, 300), "x" * 5000]
    w = Words([t.encode() for t in texts])
    assert np.diff(w.first).tolist() == [len(words(t)) for t in texts]
    assert [len(s) for s in w.shingles()] == [len(shingles(t)) for t in texts]
    same = Words([b"The Cat sat on the mat", b"the cat\nsat  on\tTHE mat"]).shingles()
    assert (same[0] == same[1]).all()


def test_components(spark, rng):
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)] + [(i, i + 1) for i in range(400, 460)] + [(500, 501 + i) for i in range(50)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 -------------------------------------------------------------------------------------------------------------


def test_arc_round_trip(spark):
    big, html = "x" * 1500, "<p>é\r\n\r\nWARC/1.1</p>"
    rows = [(1, "http://a b", big), (2, None, big), (3, "http://c", None), (4, "http://d", html), (5, "http://e", ""), (9, "http://f", big), (9, "http://f", big), (10, "http://g", "short"), (11, "http://h", "short"), (None, "http://n", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash")).repartition(2)
    records = warc.arc_to_records(warc.pages_as_arc(pages))
    assert records.filter("problem is not null").count() == 0 and {r.version for r in records.collect()} <= {1, 2}
    path = new_path(spark, "warc")
    warc.write_warc(records, warc.revisits(records), path)
    got = warc.with_responses(warc.read_warc(spark, path)).collect()
    assert len(got) == len(rows) and all(r.valid for r in got)
    by = {r.key: r for r in got}
    for page, _, x in rows:
        assert (by[page].payload_bytes, by[page].payload_digest) == (len((x or "").encode()), hashlib.sha1((x or "").encode()).hexdigest())
    assert {k: (r.record_type, r.refers_to) for k, r in by.items()} == {1: ("revisit", 9), 2: ("revisit", 9), None: ("revisit", 9)} | {k: ("response", None) for k in (3, 4, 5, 9, 10, 11)}


def test_arc_versions_and_damage():
    record = ("http://u", "1.2.3.4", "19970101000000", "text/html", "200", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\n\n")
    for version in (1, 2):
        whole = warc.arc_file("x.arc", version, [record, record])
        got = list(warc.parse_arc(whole))
        assert [x["content"] for x in got] == [record[5]] * 2 and got[0]["Archive-date"] == record[2]
        import gzip

        assert len(list(warc.parse_arc(gzip.compress(whole[:100]) + gzip.compress(whole[100:])))) == 2
        assert [x["problem"] for x in warc.parse_arc(whole[:-20])] == [None, "truncated"]
        assert [x["problem"] for x in warc.parse_arc(whole + b"http://x 1 2\n")][-1] is not None
    assert [x["problem"] for x in warc.parse_arc(b"http://u 1.2.3.4 19970101000000 text/html 3\nabc\n")] == ["header line does not fit the version"]
    assert list(warc.parse_arc(b"")) == []
    assert warc.iso_date("19970203040506") == "1997-02-03T04:05:06Z" and warc.iso_date("199702") == "1997-02-01T00:00:00Z"


def test_keys_of_64_bits(spark):
    """The largest and smallest long ids, and equal payloads whose ids have 19 digits."""
    ids = [2**63 - 1, -(2**63), 10**18, 5]
    pages = spark.createDataFrame([(i, f"http://a/{i}", "y" * 1500) for i in ids], "page_id long, url string, html string")
    records = warc.arc_to_records(warc.pages_as_arc(pages))
    warc.write_warc(records, warc.revisits(records), path := new_path(spark, "warc"))
    got = {r.key: (r.record_type, r.refers_to) for r in warc.with_responses(warc.read_warc(spark, path)).collect()}
    assert got == {i: ("revisit", ids[0]) if i != ids[0] else ("response", None) for i in ids}
    head = lambda key: b"HTTP/1.1 200 OK\r\nX-Record-Key: " + key + b"\r\n\r\n"
    assert [warc.record_key(head(x)) for x in (b"9223372036854775808", b"-9223372036854775809", b"12a", b"7")] == [None, None, None, 7]


def test_pages_that_look_like_version_blocks(spark):
    """A url that begins with filedesc:// is a record; no page vanishes, and damage ends a strict job."""
    pages = spark.createDataFrame([(i, url, "z" * 20) for i, url in enumerate(["filedesc://x", "http://a", "filedesc://y 1", ""])], "page_id long, url string, html string").coalesce(1)
    arcs = warc.pages_as_arc(pages)
    records = warc.arc_to_records(arcs)
    warc.write_warc(records, warc.revisits(records), path := new_path(spark, "warc"), strict=True)
    assert sorted(r.key for r in warc.read_warc(spark, path).collect()) == [0, 1, 2, 3]
    damaged = warc.arc_to_records(arcs.withColumn("content", F.expr("substring(content, 1, length(content) - 9)")))
    assert damaged.filter("problem = 'truncated'").count() == 1
    with pytest.raises(Exception, match="damaged archive"):
        warc.write_warc(damaged, warc.revisits(damaged), new_path(spark, "warc"), strict=True)


def test_arc_of_nothing_and_of_long_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARC_BYTES", 1000)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    records = warc.arc_to_records(warc.pages_as_arc(empty))
    warc.write_warc(records, warc.revisits(records), path := new_path(spark, "warc"), strict=True)
    assert warc.with_responses(warc.read_warc(spark, path)).count() == 0
    pages = spark.createDataFrame([(i, "http://a", "é\r\n" * n) for i, n in enumerate([10, 400_000, 10, 300, 300])], "page_id long, url string, html string").coalesce(1)
    arcs = warc.pages_as_arc(pages)
    assert arcs.count() == 3
    warc.write_warc(warc.arc_to_records(arcs), warc.revisits(warc.arc_to_records(arcs)), path := new_path(spark, "warc"), strict=True)
    got = {r.key: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.with_responses(warc.read_warc(spark, path)).collect()}
    assert got == {0: (40, "response", None), 1: (1_600_000, "response", None), 2: (40, "response", None), 3: (1200, "revisit", 4), 4: (1200, "response", None)}


# --- 2 -------------------------------------------------------------------------------------------------------------


def test_language_mixtures(spark, sf_dir):
    train = table(spark, sf_dir, "documents")
    model = language.fit(train.filter("doc_id % 5 <> 0"))
    got = language.predict(train.filter("doc_id % 5 = 0"), model).join(train.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95 and all(0 <= r.score <= 1 for r in got)
    text = {r.lang: r.text for r in train.filter("n_chars > 2000").select("lang", "text").collect()}
    both = text["en"][:1500] + "\n" + text["de"][:1500]
    odd = docs(spark, [(1, None), (2, ""), (3, "12 34 -- !"), (4, "— … “"), (5, both), (5, both), (6, text["fr"] * 20)])
    by = {r.doc_id: r for r in language.predict(odd, model).collect()}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (1, 2, 3, 4))
    assert {x.lang for x in by[5].langs} == {"en", "de"} and abs(sum(x.share for x in by[5].langs) - 1) < 1e-6
    assert by[6].lang_pred == "fr"
    empty = language.fit(train.limit(0))
    assert {r.lang_pred for r in language.predict(odd, empty).collect()} == {"und"}
    assert language.predict(docs(spark, []), model).count() == 0


def plain_mixture(model, text):
    """Proportions and number of languages by EM in plain loops, word by word."""
    words = re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode())
    if not words or not any(map(str.isalpha, text)):
        return None
    like = []
    for w in words:
        c = [0, *[(b - 101) if b >= 128 else (b | 32) - 96 for b in w], 0]
        codes = [((c[i - 1] * 155 + c[i]) * 155 + c[i + 1]) * 2654435761 % 2**32 >> (32 - language.BITS) for i in range(1, len(c) - 1)]
        logs = [sum(float(model.logp[x, j]) for x in codes) for j in range(len(model.langs))]
        like.append([math.exp(max(x - max(logs), -60.0)) for x in logs])

    def em(allowed, rounds):
        pi = [1 / len(allowed) if j in allowed else 0.0 for j in range(len(model.langs))]
        for _ in range(rounds):
            sums = [0.0] * len(pi)
            for row in like:
                total = sum(a * p for a, p in zip(row, pi))
                sums = [s + a * p / total for s, a, p in zip(sums, row, pi)]
            pi = [s / len(like) for s in sums]
        return pi, sum(math.log(sum(a * p for a, p in zip(row, pi))) for row in like)

    k = len(model.langs)
    full = em(set(range(k)), language.ROUNDS)
    order, best = sorted(range(k), key=lambda j: -full[0][j]), None
    for n in range(1, k + 1):
        pi, ll = full if n == k else em(set(order[:n]), language.ROUNDS if n > 1 else 0)
        value = ll - language.PENALTY * 0.5 * math.log(len(words) + 1) * (n - 1)
        if best is None or value > best[0] + 1e-9:
            best = value, pi, n
    return best[1:]


def test_mixtures_are_those_of_plain_em(spark, sf_dir):
    train = table(spark, sf_dir, "documents")
    model = language.fit(train.filter("doc_id % 5 <> 0"))
    some = [(r.doc_id, r.text[:400]) for r in train.filter("doc_id < 12").select("doc_id", "text").collect()]
    rows = some + [(100, some[0][1][:200] + " " + some[1][1][:200]), (101, "Äpfel und the apples"), (102, None), (103, "1 2"), (104, "語"), (104, "語")]
    want = {i: plain_mixture(model, t) for i, t in rows}
    for r in language.predict(docs(spark, rows), model).collect():
        if want[r.doc_id] is None:
            assert (r.lang_pred, r.n_langs) == ("und", 0)
        else:
            pi, n = want[r.doc_id]
            assert r.n_langs == n and r.score == pytest.approx(max(pi), abs=1e-4) and pi[model.langs.index(r.lang_pred)] == pytest.approx(max(pi), abs=1e-4)


# --- 3 -------------------------------------------------------------------------------------------------------------


def test_targets():
    assert mixing.targets([100, 100, 100]) == [200.0, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mixing.targets([]) == [] and mixing.targets([0, 10]) == [0.0, 15.0]
    assert all(t <= 2 * s + 1e-9 for t, s in zip(mixing.targets([5, 1000, 1, 7]), [5, 1000, 1, 7]))


def test_splitting_tree_is_exact():
    quotas = np.array([13, 0, 200])
    tree = mixing.splitting_tree(quotas, 7, 1)
    assert (tree.sum(axis=1) == quotas).all() and (tree >= 0).all() and np.ptp(tree.sum(axis=0)) <= 1
    assert (tree == mixing.splitting_tree(quotas, 7, 1)).all()


def test_mix(spark, rng):
    rows = [(i, prose(rng, rng.choice([0, 1, 20, 60]))) for i in range(300)] + [(1000, None), (1001, prose(rng, 3000)), (5, prose(rng, 10))]
    own = docs(spark, rows).withColumn("source", F.when(F.col("doc_id") % 4 == 0, None).otherwise(F.col("source")))
    got = mixing.mix(own).collect()
    assert sorted((r.doc_id, r["size"]) for r in got) == sorted((i, len(words(t))) for i, t in rows)
    taken, goal, most = collections.Counter(), {}, collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and (r.drawn == 0) == (r.shard is None)
        taken[r.source] += r.taken
        goal[r.source] = r.target
        most[r.source] = max(most[r.source], r["size"])
    assert all(abs(taken[s] - goal[s]) <= min(most[s], 70) for s in goal)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(own.repartition(5)).collect()), key=repr)
    times, want = collections.Counter((r.doc_id, len(words(r.text))) for r in mixing.mixed(own).collect()), collections.Counter()
    for r in got:
        want[r.doc_id, r["size"]] += len(r.copies)
    assert times == +want and mixing.mixed(own).columns == own.columns
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.mixed(docs(spark, [])).count() == 0


def test_mixed_takes_what_mix_says(spark):
    """Rows of one id and source with different and equal sizes, which fill a block in part."""
    ten = " ".join("abcdefghij")
    own = spark.createDataFrame([(1, ten, "s"), (1, ten, "s"), (2, ten, "s"), (1, "a b", "s"), (3, ten, None), (3, None, None)], "doc_id long, text string, source string")
    taken = sum(r.taken for r in mixing.mix(own, share=1.2).collect())
    assert taken == sum(len(words(r.text)) for r in mixing.mixed(own, share=1.2).collect()) and taken > 0


def plain_draw(rows, shards, seed=mixing.SEED):
    """Words taken of each source, drawn block by block in plain Python from blocks and permuted orders as the operator numbers them:
    (passes over whole blocks, blocks of the last draw, rows of the block that is taken in part)."""
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, mixing.targets([sizes[s] for s in order])))
    out = {}
    for s in order:
        own = [r for r in rows if r.source == s]
        epochs = int(goal[s] // sizes[s]) if sizes[s] else 0
        room, n = goal[s] - epochs * sizes[s], min(mixing.MOST_BLOCKS, sizes[s] // mixing.BLOCK_WORDS + 1)
        blocks = collections.defaultdict(list)
        for r in own:
            blocks[r.h % n].append(r)
        draw, before = collections.Counter(), 0
        for b in sorted(blocks, key=lambda b: (own[0].orders[epochs][b], b)):
            total = sum(r["size"] for r in blocks[b])
            if before + total <= room:
                draw.update((r.doc_id, r["size"]) for r in blocks[b] if r["size"])
            elif before < room:
                left = room - before
                for key in dict.fromkeys((r.h, r.doc_id, r["size"]) for r in sorted(blocks[b], key=lambda r: (r.h, r.doc_id, r["size"]))):
                    same = [r for r in blocks[b] if (r.h, r.doc_id, r["size"]) == key]
                    if 0 < key[2] * len(same) <= left:
                        left -= key[2] * len(same)
                        draw.update((r.doc_id, r["size"]) for r in same)
            before += total
        for r in own:
            out[s, r.doc_id, r["size"]] = r["size"] * (epochs + (draw[r.doc_id, r["size"]] > 0))
    return out


def test_mix_agrees_with_a_plain_draw(spark, rng, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 150)
    own = docs(spark, [(i, prose(rng, rng.choice([0, 1, 20, 60]))) for i in range(300)])
    hashed = own.select("doc_id", "source", mixing.word_count().alias("size"), F.xxhash64(F.lit(mixing.SEED), "doc_id").alias("h"))
    orders = [[r[0] for r in spark.range(4000).select(F.xxhash64(F.lit(mixing.SEED + 1), F.lit(p), F.col("id").cast("int"))).collect()] for p in range(3)]
    rows = [type("Row", (dict,), {"source": r.source, "doc_id": r.doc_id, "h": r.h, "orders": orders})({"size": r["size"]}) for r in hashed.collect()]
    assert {(r.source, r.doc_id, r["size"]): r.taken for r in mixing.mix(own).collect()} == plain_draw(rows, 8)


def test_every_copy_has_a_shard_and_a_place(spark, rng, monkeypatch):
    """Whole passes are dealt like the last draw, and the mix comes shard by shard in the order of places."""
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 200)
    own = docs(spark, [(i, prose(rng, 20)) for i in range(400)])
    got = mixing.mix(own, shards=8).collect()
    assert all(len(r.copies) == r.epochs + r.drawn and [c["pass"] for c in r.copies] == list(range(len(r.copies))) for r in got)
    assert all(0 <= c.shard < 8 for r in got for c in r.copies) and max(r.epochs for r in got) == 2
    assert all((r.copies[-1].shard, r.copies[-1].place) == (r.shard, r.place) for r in got if r.drawn)
    filled = collections.Counter(c.shard for r in got for c in r.copies)
    assert len(filled) == 8 and max(filled.values()) < 2 * min(filled.values())
    parts = [[r.doc_id for r in p] for p in mixing.mixed(own, shards=8).rdd.glom().collect()]
    at = collections.defaultdict(list)
    for c, i in sorted(((c.shard, c.place), r.doc_id) for r in got for c in r.copies):
        at[c[0]].append(i)
    left = [p for p in parts if p]
    for p in left:  # whole shards, one after another
        while p:
            shard = next(s for s, ids in at.items() if p[: len(ids)] == ids)
            p = p[len(at.pop(shard)) :]
    assert not at


# --- 4 -------------------------------------------------------------------------------------------------------------


def brute_components(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, shingles(t))
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("local", [3_000_000, 500])
def test_jaccard(spark, rng, monkeypatch, local):
    """local=500 sends groups through the distributed rounds."""
    monkeypatch.setattr(jaccard, "LOCAL_TOKENS", local)
    bases = [prose(rng, n, 3000) for n in (4, 6, 40, 200, 200, 900)]
    rows, shared = [], prose(rng, 30, 3000)
    for b in bases:
        for edits in (0, 0, 1, 2, 3, 5, 8, 12):
            rows.append((len(rows), near(rng, b, edits)))
    chain = bases[3]
    for _ in range(12):  # each is near the one before it, not the first
        chain = near(rng, chain, 3)
        rows.append((len(rows), chain))
    rows += [(len(rows) + i, prose(rng, 100, 3000) + " " + shared) for i in range(25)]
    rows += [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "ONE"), (505, "one two"), (2, rows[2][1]), (506, "x" * 20000)]
    got = jaccard.jaccard_components(docs(spark, rows)).collect()
    want = brute_components(rows)
    assert len(got) == len(rows) and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    kept = {r.doc_id for r in jaccard.one_of_each(docs(spark, rows)).collect()}
    assert kept == {c for _, c in want.values()}


def test_jaccard_without_links(spark):
    assert jaccard.jaccard_components(docs(spark, [])).count() == 0
    got = jaccard.jaccard_components(docs(spark, [(1, "a b c d e f"), (2, None), (None, "a b c d e f")])).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 2), (None, None)}


# --- 5 -------------------------------------------------------------------------------------------------------------


def test_token_store(spark, rng):
    import public_tokenizers
    from tokenizers import Tokenizer

    name = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(name)
    long = prose(rng, 6000)
    rows = [(3, "Hello  world's  \n\n end "), (1, None), (2, ""), (9, long), (8, long + " tail"), (4, "<|endoftext|> é\x1c　 ñ 12"), (9, long), (-5, "a\x85 b")]
    tokenstore.write_store(docs(spark, rows), path := new_path(spark, "tokens"), name)
    got = sorted(map(tuple, tokenstore.document_sums(spark, path).collect()), key=lambda r: r[1])
    at = 0
    for (doc_id, text), r in zip(sorted(rows, key=lambda x: x[0]), got):
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        assert r == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()), True)
        at += len(ids)
    back = sorted(tokenstore.read_ids(spark, path).collect(), key=lambda r: r.start)
    assert [list(r.ids) for r in back] == [plain.encode(t or "", add_special_tokens=False).ids + [0] for _, t in sorted(rows, key=lambda x: x[0])]
    chunks = tokenstore.objects(spark, path, 0)
    assert chunks.count() == chunks.select("digest").distinct().count() and tokenstore.verify(spark, path).count() == 0
    assert chunks.agg(F.sum(F.length("blob"))).first()[0] < 2 * at * 0.6  # the long text is stored once, near enough
    assert len(tokenstore.manifest_root(spark, path)) == 32
    tokenstore.write_store(docs(spark, []), path := new_path(spark, "tokens"), name)
    assert tokenstore.document_sums(spark, path).count() == 0


def test_words_of_all_kinds_are_encoded_as_in_whole_texts(rng, monkeypatch):
    """White space of many kinds and runs, contractions, long words, special tokens as ids and as text; with a full cache too."""
    import public_tokenizers
    from tokenizers import Tokenizer

    name = public_tokenizers.path("byte_bpe_50k.json")
    bits = [" ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\u00a0", "\u3000", "\u200b", "'s", "'", "don't", "12", "é", "漢字", "<|endoftext|>", "a", "word", "Ünï", "!?", "x" * 70, "\0", "😀", "e\u0301"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(3000)] + ["", " ", " a", "a ", "a " * 50, "z" * 3000]
    for special in (True, False):
        for cached in (900_000, 20):
            monkeypatch.setattr(tokenstore, "CACHED", cached)
            plain = Tokenizer.from_file(name)
            plain.encode_special_tokens = not special
            enc = tokenstore.Encoder(name, special)
            for a in range(0, len(texts), 500):
                ids, lengths = enc.encode(texts[a : a + 500])
                want = [plain.encode(t, add_special_tokens=False).ids + [0] for t in texts[a : a + 500]]
                assert lengths.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_other_tokenizers_and_wide_ids(spark, tmp_path):
    """A tokenizer that cuts in another way encodes whole texts, and ids over 65,535 keep their bits."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    own = Tokenizer(models.WordLevel({"[UNK]": 0, "high one": 70_000, "low": 7}, unk_token="[UNK]"))
    own.pre_tokenizer = pre_tokenizers.Split("|", "removed")
    own.save(str(tmp_path / "own.json"))
    tokenstore.write_store(docs(spark, [(1, "high one|low"), (2, None)]), path := new_path(spark, "tokens"), str(tmp_path / "own.json"))
    assert {r.doc_id: list(r.ids) for r in tokenstore.read_ids(spark, path).collect()} == {1: [70_000, 7, 0], 2: [0]}


def test_a_changed_recipe_is_not_valid(spark, rng):
    import public_tokenizers

    tokenstore.write_store(docs(spark, [(i, prose(rng, 50)) for i in range(20)]), path := new_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    recipes = spark.read.parquet(f"{path}/recipes")
    run = recipes.filter("doc_id = 3").first().run
    changed = written(recipes.withColumn("start", F.when(F.col("doc_id") == 3, F.col("start") + 1).otherwise(F.col("start"))), "changed")
    changed.write.mode("overwrite").parquet(f"{path}/recipes")
    got = {r.doc_id: r.valid for r in tokenstore.document_sums(spark, path).collect()}
    assert got == {r.doc_id: r.run != run for r in changed.collect()} and not got[3]


def test_crc_of_parts():
    data = random.Random(3).randbytes(5000)
    cuts = [0, 1, 700, 700, 4999, 5000]
    parts = [data[a:b] for a, b in zip(cuts, cuts[1:])]
    after = np.array([5000 - b for b in cuts[1:]])
    assert int(np.bitwise_xor.reduce(tokenstore.crc_shifted(np.array([zlib.crc32(p) for p in parts]), after))) == zlib.crc32(data)


# --- 6 -------------------------------------------------------------------------------------------------------------


def brute_repeats(texts, length=200):
    count, out = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1)), []
    for t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        own = gone[1 : len(t) + 1]
        kept = bytes(np.frombuffer(t, np.uint8)[~own]) if t else b""
        out.append((len(t), int(own.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [64, 3])
def test_repeats(spark, rng, monkeypatch, hot):
    """hot=3 sends anchors through window hashes."""
    monkeypatch.setattr(repeats, "HOT", hot)
    letters = lambda n: "".join(rng.choice("abcde fgh\n") for _ in range(n))
    passages = [letters(n) for n in (150, 199, 200, 201, 260, 500)]
    rows = [(i, "".join(rng.choice(passages) if rng.random() < 0.5 else letters(rng.randint(0, 300)) for _ in range(rng.randint(0, 5)))) for i in range(60)]
    base = letters(2500)
    rows += [(100 + i, "".join(c if rng.random() > 0.004 else "Z" for c in base)) for i in range(15)]
    rows += [(200, None), (201, ""), (202, "a" * 700), (203, "ab" * 150), (204, "a" * 199), (205, rows[3][1]), (5, rows[5][1]), (206, "é" * 250)]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.cut_repeats(docs(spark, rows)).collect())
    assert got == sorted((i, *x) for (i, _), x in zip(rows, brute_repeats([(t or "").encode() for _, t in rows])))


@pytest.mark.parametrize("broadcast", [24 << 20, 0])
def test_copies_that_share_only_the_second_batch(spark, rng, monkeypatch, broadcast):
    """Exact copies with hot anchors, in different batches of the first pass and in one of the second."""
    monkeypatch.setattr(repeats, "HOT", 1)
    monkeypatch.setattr(common, "BROADCAST_BYTES", broadcast)
    texts = ["".join(rng.choice("abcde fgh\n") for _ in range(n)) for n in (600, 250)]
    rows = [(i, x) for i, x in enumerate([texts[0], "short", texts[0], "short too", texts[1], "s", texts[1], "t", texts[0][:100] + texts[1][:100], "u"])]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.cut_repeats(docs(spark, rows, 1)).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got == [(i, *x) for (i, _), x in zip(rows, brute_repeats([t.encode() for _, t in rows]))]


@pytest.mark.parametrize("blocks", [lambda n: repeats._anchor_blocks(n), lambda n: jaccard._blocks(n)])
def test_decided_rows_meet_in_no_one_block(spark, blocks):
    """200 tasks of one batch each: what a batch decides is dealt over the blocks."""
    if blocks(1).__qualname__.startswith("_anchor"):
        texts = spark.range(400).select("id", F.concat(F.lit("x" * 300), (F.col("id") % 200).cast("string")).alias("text")).repartitionByRange(200, F.col("id") % 200)
        rows = texts.mapInArrow(blocks(64), repeats.ANCHORS)
    else:
        sets = spark.range(400).select("id", F.lit(b"12345678" * 3).alias("prefix")).repartitionByRange(200, F.col("id") % 200)
        rows = sets.mapInArrow(blocks(64), jaccard.BLOCKS)
    sizes = [r["count"] for r in rows.filter("block < 0").groupBy("block").count().collect()]
    assert sum(sizes) >= 100 and max(sizes) <= 16


def test_pieces_are_cut_as_the_pattern_cuts(rng):
    """Places found over arrays are those of the pattern, and keys of a table come back with their numbers, however they collide."""
    import public_tokenizers

    enc = tokenstore.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    letters = list("ab'strevelmdLl  \n\t\r_.!,019\u00e9\u4e2d\u3000\u00a0\u0663\0")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["", "'", "'s", " 's", "''s", "'lla'rex", "a  ", "  ", "\n\n x"]
    _, code, kind = enc._characters(texts)
    starts, first = tokenstore.piece_starts(code, kind), np.concatenate(([0], np.cumsum([len(x) + 1 for x in texts])))
    for x, a, b in zip(texts, first, first[1:]):
        own = (starts[(starts >= a) & (starts < b)] - a).tolist()
        assert [x[i:j] for i, j in zip(own, own[1:])] == tokenstore.PIECES.findall(x)
    enc.encode(["the house"] * 3)
    assert enc.kept == 2 and not enc.long  # pieces of few bytes are no Python objects
    table = tokenstore.Table()
    low, high = np.arange(100_000, dtype=np.uint64) % 7, np.arange(1, 100_001, dtype=np.uint64)
    table.add(low[::2], high[::2], np.arange(50_000, dtype=np.int32))
    got = table.get(low, high)
    assert (got[::2] == np.arange(50_000)).all() and (got[1::2] == -1).all()


def test_long_texts_are_read_in_pieces(spark, rng, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE_BYTES", 1500)
    text = "".join(rng.choice("abcdef ") for _ in range(9000))
    rows = [(1, text), (2, "x" * 40 + text[2000:7000]), (3, text[:210])]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.cut_repeats(docs(spark, rows)).collect())
    assert got == [(i, *x) for (i, _), x in zip(rows, brute_repeats([t.encode() for _, t in rows]))]
    assert repeats.cut_repeats(docs(spark, [])).count() == 0
    kept = repeats.cut_repeats(docs(spark, rows), texts=True).filter("doc_id = 2").first()
    assert bytes(kept.kept) == b"x" * 40 and [(s.lo, s.hi) for s in kept.spans] == [(40, 5040)]


def test_maximal_repeats():
    assert repeats.maximal_repeats([b"xabcy", b"zabcw", b"qab"], 2) == [(2, [(0, 1), (1, 1), (2, 1)]), (3, [(0, 1), (1, 1)])]
    assert repeats.maximal_repeats([], 1) == [] and repeats.maximal_repeats([b"abc"], 1) == []


# --- 7 -------------------------------------------------------------------------------------------------------------


def test_quality(spark, sf_dir):
    own, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(own.filter("doc_id % 5 <> 0"), labels)
    assert model.rules
    got = quality.score(own, model).join(labels, "doc_id").filter("doc_id % 5 = 0").collect()
    assert sum((r._score >= 0.3) == (r.quality == 1) for r in got) / len(got) > 0.9
    odd = quality.score(docs(spark, [(1, None), (2, ""), (3, "x" * 50000), (3, "a b")]), model)
    assert odd.columns == ["doc_id", "text", "n", "block", "source", "lang", "_score"] and all(0 <= r._score <= 1 for r in odd.collect())
    assert {r._score for r in quality.score(docs(spark, [(1, "a")]), quality.fit(own, labels.limit(0))).collect()} == {0.5}
    one = quality.fit(own, labels.filter("quality = 1"))
    assert all(r._score > 0.99 for r in quality.score(docs(spark, [(1, "a")]), one).collect())
    assert "Python" not in quality.score(own, model)._jdf.queryExecution().executedPlan().toString()


def plain_statistics(t):
    """The statistics of a text, counted one by one."""
    w, lines = WORD.findall(t), t.split("\n")
    share = lambda a, b: a / b if b else 0.0
    return {
        "chars": len(t), "words": len(w), "lines": len(lines), "word_length": share(len(t), len(w)), "symbols": share(sum(c in "#$%&*|<>{}[]\\/~^@=+_" for c in t), len(t)),
        "symbol_runs": share(len(re.findall(r"[#$%&*|]{2,}", t)), len(w)), "digits": share(sum(c in "0123456789" for c in t), len(t)),
        "upper": share(sum("A" <= c <= "Z" for c in t), len(t)), "stops": share(sum(c in ".!?" for c in t), len(w)), "commas": share(t.count(","), len(w)),
        "short_words": share(sum(len(x) <= 3 for x in w), len(w)), "long_words": share(sum(len(x) >= 16 for x in w), len(w)),
        "distinct_words": share(len(set(w)), len(w)), "distinct_lines": share(len(set(lines)), len(lines)), "pipes": share(t.count("|"), len(w)),
        "open_lines": share(sum(a not in ".!?\n" and b == "\n" for a, b in zip(t, t[1:])), len(lines)),
    }


def test_quality_scores_are_those_of_the_rules(spark, sf_dir):
    """Statistics counted one by one, and rules applied row by row, give what the compiled expression gives."""
    own, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(own.filter("doc_id % 5 <> 0"), labels)
    odd = docs(spark, [(-1, None), (-2, ""), (-3, "é|# \n\nA"), (-4, "x " * 40000), (-5, "a"), (-5, "a")]).select("doc_id", "text")
    for r in quality.score(own.select("doc_id", "text").unionByName(odd), model).collect():
        got = plain_statistics(r.text or "")
        margin = model.intercept + sum(x.weight for x in model.rules if all(got[n] > t if above else got[n] <= t for n, t, above in x.conditions))
        assert r._score == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-9)
    assert quality.score(docs(spark, []), model).count() == 0


def test_filters_do_not_copy_the_statistics(spark, sf_dir):
    """A filter on the score moves below the projection; the statistics still stand in the plan once."""
    own = table(spark, sf_dir, "documents")
    rules = [quality.Rule((("words", float(i), True), ("stops", 0.1, False)), 0.1) for i in range(30)]
    plan = quality.score(own, quality.RuleEnsemble(0.0, rules)).filter("_score >= 0.3").drop("_score")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("{2,}") == 1


def test_the_plan_of_scores_does_not_grow_with_the_rules(spark, sf_dir):
    """Rules are one constant: the driver plans and compiles as much for many of them as for one, and their weights still add up."""
    own = docs(spark, [(1, "a b c d e"), (2, "a b")])
    many = lambda n: quality.RuleEnsemble(0.5, [quality.Rule((("words", 3.0, True),), 0.01), *[quality.Rule((("words", 4.5, i % 2 == 0), ("stops", -float(i), True)), 0.01) for i in range(1, n)]])
    whens = [quality.score(own, many(n))._jdf.queryExecution().optimizedPlan().toString().count("CASE WHEN") for n in (1, 200)]
    assert whens[0] == whens[1]
    got = {r.doc_id: r._score for r in quality.score(own, many(200)).collect()}
    assert got[1] == pytest.approx(1 / (1 + math.exp(-0.5 - 0.01 * 100)), abs=1e-12)
    assert got[2] == pytest.approx(1 / (1 + math.exp(-0.5 - 0.01 * 100)), abs=1e-12)


def test_first_split_is_the_best_of_all():
    """A tree's first condition against every threshold of every statistic."""
    r = np.random.default_rng(4)
    x = np.round(r.random((200, 4)), 1)
    y = ((x[:, 1] > 0.42) ^ (r.random(200) < 0.1)).astype(float)
    cuts = quality._thresholds(x)
    codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    paths, _ = quality.grow(codes, cuts, y - y.mean(), np.arange(200), list("abcd"))
    g = y - y.mean()
    gain = {(j, float(t)): sum(g[m].sum() ** 2 / m.sum() for m in (x[:, j] <= t, x[:, j] > t)) for j in range(4) for t in cuts[j] if min((x[:, j] <= t).sum(), (x[:, j] > t).sum()) >= quality.least_rows(200)}
    j, t = max(gain, key=gain.get)
    assert {("abcd"[j], t, False), ("abcd"[j], t, True)} == {p[0] for p in paths if len(p) == 1}


def test_lasso_is_the_minimum():
    """The weights reach the objective of plain coordinate descent in double precision."""
    r = np.random.default_rng(2)
    z = (r.random((500, 12)) < 0.4).astype(np.float32)
    y = (r.random(500) < 1 / (1 + np.exp(-(2 * z[:, 2] - 2 * z[:, 7] + 0.3)))).astype(float)
    scaled = (z - z.mean(axis=0)) / z.std(axis=0)

    def loss(b, w):
        m = b + scaled @ w
        return np.mean(np.log1p(np.exp(-np.abs(m))) + np.maximum(m, 0) - y * m) + 0.01 * np.abs(w).sum()

    b, w = 0.0, np.zeros(12)
    for _ in range(400):
        for j in range(-1, 12):
            p = 1 / (1 + np.exp(-(b + scaled @ w)))
            if j < 0:
                b -= 4 * np.mean(p - y)
            else:
                u = w[j] - 4 * np.mean((p - y) * scaled[:, j])
                w[j] = np.sign(u) * max(abs(u) - 4 * 0.01, 0)
    gb, gw = quality.lasso_logistic(z, y, 0.01)
    dev, mean = z.std(axis=0), z.mean(axis=0)
    assert loss(gb + float((gw * mean).sum()), gw * dev) == pytest.approx(loss(b, w), abs=1e-5)


def test_lasso_keeps_few():
    r = np.random.default_rng(1)
    z = (r.random((2000, 30)) < 0.4).astype(float)
    y = (r.random(2000) < 1 / (1 + np.exp(-(3 * z[:, 2] - 3 * z[:, 7])))).astype(float)
    _, w = quality.lasso_logistic(z, y, 0.03)
    assert w[2] > 0.5 and w[7] < -0.5 and (np.abs(w) > 1e-4).sum() <= 4


# --- 8 -------------------------------------------------------------------------------------------------------------


def test_licenses(spark, sf_dir):
    own = table(spark, sf_dir, "documents")
    got = {(r.doc_id, r.first_line, r.license) for r in licenses.scan(own).collect()}
    patterns = {"Apache": r"Licensed under the Apache License, Version \d", "MIT": r"Released under the MIT License", "GPL": "GNU General Public License", "CC-BY-NC": "Licensed under CC BY-NC", "Proprietary": "All rights reserved"}
    want = {(r.doc_id, i, name) for r in own.select("doc_id", "text").collect() for i, line in enumerate(r.text.split("\n")) for name, p in patterns.items() if re.search(p, line)}
    assert got == want and want
    odd = docs(spark, [(1, None), (2, ""), (3, "A license to think about things, and permission to go on."), (4, "Licensed under CC BY-SA 4.0."), (4, "x\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and\nassociated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software")])
    assert sorted((r.doc_id, r.license) for r in licenses.scan(odd).collect()) == [(4, "CC-BY-SA"), (4, "MIT")]
    assert licenses.scan(docs(spark, [])).count() == 0


def test_short_statements(spark, sf_dir):
    """Lines of fixed statements alone: each line of the test tables that reads so, and SPDX lines."""
    own = table(spark, sf_dir, "documents")
    got = {(r.doc_id, r.first_line) for r in licenses.scan(own).collect() if r.license == "Proprietary"}
    want = {(r.doc_id, i) for r in own.select("doc_id", "text").collect() for i, line in enumerate(r.text.split("\n")) if "All rights reserved" in line}
    assert got == want and want
    lines = ["All rights reserved.", "SPDX-License-Identifier: MIT", "// SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: Foo-1.0"]
    found = licenses.scan(docs(spark, list(enumerate(lines)))).collect()
    assert sorted((r.doc_id, r.license) for r in found) == [(0, "Proprietary"), (1, "MIT"), (2, "GPL")]


def test_wrapped_and_inner_statements(spark):
    """Notices with lines that have no cue, statements within long lines, and several licenses of one text."""
    mit = ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and", 'associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights', "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"]
    lgpl = " * This library is free software; you can\n * redistribute it and/or modify it under the terms\n * of the GNU Lesser General Public\n * License as published by the Free Software Foundation;\n * either version 2.1 of the\n * License, or (at your option) any later version."
    bsd = "# Redistribution and use in source and binary forms,\n# with or without modification, are\n# permitted provided that the following conditions are met"
    apache = "Licensed under the Apache License, Version 2.0."
    prose_ = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, "x\n" + "\n".join(mit)), (2, "/*\n" + lgpl + "\n */"), (3, bsd), (4, f"{prose_} {apache} {prose_}"), (5, "Free as in air.\n" + apache + "\n" + "\n".join(mit)),
        (6, f"{apache} {prose_} Released under the MIT License."), (7, mit[0] + "\n\n" + "\n".join(mit[1:])), (8, prose_ + ", all rights\nreserved."), (9, apache), (9, "no cue\n" + apache),
        (10, "Permission to copy a license, free of charge. " + prose_ + " and a copyright."),
    ]
    got = sorted((r.doc_id, r.first_line, r.last_line, r.license) for r in licenses.scan(docs(spark, rows, 1)).collect())
    assert got == [
        (1, 1, 3, "MIT"), (2, 1, 6, "LGPL"), (3, 0, 2, "BSD"), (4, 0, 0, "Apache"), (5, 1, 1, "Apache"), (5, 2, 4, "MIT"),
        (6, 0, 0, "Apache"), (6, 0, 0, "MIT"), (8, 0, 1, "Proprietary"), (9, 0, 0, "Apache"), (9, 1, 1, "Apache"),
    ]


def test_rows_do_not_change_each_other(spark):
    """Rows of one id, repeated rows and ties have the same results in one partition and in many; long lines are read whole."""
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the\nFree Software Foundation, either version 3 of the License, or (at your option) any later version."
    rows = [(7, "Released under the MIT License."), (7, gpl), (7, gpl), (8, "word " * 30_000 + "Released under the MIT License. " + "word " * 30_000), (8, None)]
    found = [sorted(map(tuple, licenses.scan(docs(spark, rows, n)).drop("block").collect())) for n in (1, 5)]
    assert found[0] == found[1] and sorted((x[0], x[3]) for x in found[0]) == [(7, "GPL"), (7, "GPL"), (7, "MIT"), (8, "MIT")]


def test_wording():
    t = licenses.words("Licensed under the Apache License, Version *.")
    assert licenses.differences(t, licenses.words("Licensed under the Apache License, Version 2.0.")) == (0, 0)
    assert licenses.differences(t, licenses.words("Licensed under the Foo License, Version 2.0."))[0] == 1
    assert licenses.best("Licensed under CC BY-NC 4.0.")[0] == "CC-BY-NC" and licenses.best("Licensed under CC BY 4.0.")[0] == "CC-BY"


# --- 9 -------------------------------------------------------------------------------------------------------------


def brute_bm25(rows, query, k):
    c = [(i, collections.Counter(words(t))) for i, t in rows if i is not None]
    n, mean = len(c), sum(sum(x.values()) for _, x in c) / len(c)
    df = collections.Counter(w for _, x in c for w in x)
    out = []
    for i, x in c:
        size = sum(x.values())
        s = sum(math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * x[w] * 2.2 / (x[w] + 1.2 * (0.25 + 0.75 * size / mean)) for w in set(words(query)) if w in x)
        if s > 0:
            out.append((-round(s, 9), i))
    return [(i, -s) for s, i in sorted(out)[:k]]


def test_rows_that_few_queries_ask_for_are_not_added_up():
    """Of a shard in two languages, queries of one have rows of their own words added up, others are read as lists; what comes out is the exact best under any threshold."""
    rng, chance = np.random.default_rng(5), 1 / np.arange(1, 1001)
    texts = [b" ".join(b"%c%d" % (b"wv"[i % 2], k) for k in {*rng.choice(1000, 80, p=chance / chance.sum())}) + (b" v0" if i == 30 else b"") for i in range(800)]
    counted = list(topk.term_counts(texts))
    terms, df = np.unique(np.concatenate([t for t, _ in counted]), return_counts=True)
    idf, asked = np.log1p((800 - df + 0.5) / (df + 0.5)), list(range(0, 800, 10))
    own = topk.Queries(asked, [counted[i][0] for i in asked], [idf[np.searchsorted(terms, counted[i][0])] for i in asked])
    own.vocabulary, at = terms, np.searchsorted(terms, own.vocabulary)
    own.own, own.idf = at[own.own].astype(np.int32), idf
    shard = topk.Shard({n: x.astype(topk.KINDS[n]).tobytes() for n, x in topk.build_shard(list(range(800)), counted).items()}, 100.0, own.vocabulary, own.idf)
    every = [shard.exact(np.arange(800), shard.place_of[own.own[a:b]]) for a, b in zip(own.first[:-1], own.first[1:])]

    class Taken(np.ndarray):
        def __getitem__(self, at):
            taken.append(len(out := np.asarray(self)[at]))
            return out

    taken, shard.rows = [], shard.rows.view(Taken)
    for share in (0.0, 0.9, 1.0):  # of the score that the tenth has
        best = topk.Best(10, np.array([share * np.sort(scores)[-10] for scores in every]))
        topk.search_all(shard, own, list(range(len(asked))), best)
        for i, scores in enumerate(every):
            want = topk.better(scores, shard.docs, 10)
            assert np.array_equal(best.found[i][0], want[0]) and np.array_equal(best.found[i][1], want[1])
    assert len(shard.rows) > 40 and 0 < max(taken) <= 0.6 * len(shard.rows)
    # no word is frequent: there are no rows
    counted = list(topk.term_counts([b"a%d b%d" % (k, k // 2) for k in range(100)]))
    own = topk.Queries([7], [counted[7][0]], [np.ones(2)])
    shard = topk.Shard({n: x.astype(topk.KINDS[n]).tobytes() for n, x in topk.build_shard(list(range(100)), counted).items()}, 2.0, own.vocabulary, own.idf)
    topk.search_all(shard, own, [0], best := topk.Best(10, np.zeros(1)))
    assert len(shard.rows) == 0 and best.found[0][1].tolist() == [7, 6]


def test_bm25(spark, rng, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_DOCS", 40)
    monkeypatch.setattr(topk, "QUERY_TERMS", 60)
    rows = [(i, prose(rng, rng.choice([0, 3, 40, 200]), 300)) for i in range(200)] + [(300, None), (301, ""), (302, "w1"), (303, "w1"), (7, "w1 w2"), (None, "w1")]
    own = docs(spark, rows)
    got = collections.defaultdict(list)
    for r in topk.bm25_topk(own, own.filter("doc_id % 50 = 0 or doc_id > 299")).collect():
        got[r.query_id].append(r)
    queries = [(i, t) for i, t in rows if i is not None and (i % 50 == 0 or i > 299)]
    assert set(got) == {i for i, t in queries if words(t)}
    for i, t in queries:
        have = sorted(got.get(i, []), key=lambda r: r["rank"])
        assert [(r.doc_id, pytest.approx(r.score, abs=1e-8)) for r in have] == brute_bm25(rows, t, 10)
    assert topk.bm25_topk(docs(spark, []), docs(spark, [])).count() == 0


# --- 10 ------------------------------------------------------------------------------------------------------------


def test_decontamination(spark, rng):
    items = [(1, prose(rng, 30)), (2, prose(rng, 8)), (3, "w1 w2 w3"), (4, ""), (5, None), (6, prose(rng, 30)), (6, None)]
    half = " ".join(words(items[0][1])[:14])
    rows = [(1, prose(rng, 400) + " " + items[0][1] + " " + prose(rng, 4000)), (2, items[1][1].upper()), (3, "x w1 W2\nw3 y"), (4, half), (5, None), (6, ""), (7, near(rng, items[0][1], 1)), (7, items[0][1]), (8, "w1 w2 z w3")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(3))
    got = {(r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in decontaminate.contained_items(docs(spark, rows), bench).collect()}
    want = set()
    for i, t in rows:
        for j, x in items:
            w, d = words(x), words(t)
            m = min(5, len(w))
            own = {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if m else set()
            both = own & {tuple(d[k : k + m]) for k in range(len(d) - m + 1)} if m else set()
            if own and 5 * len(both) >= 4 * len(own):
                want.add((i, j, len(own), len(both)))
    assert got == want
    kept = decontaminate.decontaminated(docs(spark, rows), bench)
    assert kept.columns == docs(spark, rows).columns
    alone = [{w[1] for w in want if w[0] == i} if sum(i == j for j, _ in rows) == 1 else {1} for i, _ in rows]  # both rows of id 7 hold item 1
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted((i, t or "") for (i, t), x in zip(rows, alone) if not x)
    assert decontaminate.contained_items(docs(spark, []), bench).count() == 0
    assert decontaminate.contained_items(docs(spark, rows), bench.limit(0)).count() == 0
    many = pytest.MonkeyPatch()
    many.setattr(decontaminate, "INDEX_BYTES", 50)
    assert {(r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in decontaminate.contained_items(docs(spark, rows), bench).collect()} == want
    many.undo()


def test_texts_that_share_a_hash_are_told_apart(spark, monkeypatch):
    """With a first hash of a few values, texts still keep their own spans."""
    real = repeats.F.xxhash64
    first = lambda *c: F.pmod(real(*c), F.lit(3)) if len(c) == 1 else real(*c)
    monkeypatch.setattr(repeats.F, "xxhash64", first)
    texts = ["".join(random.Random(i).choice("abcdef ") for _ in range(400)) for i in range(6)]
    rows = list(enumerate([*texts, texts[0], "x" + texts[1][:250], None]))
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.cut_repeats(docs(spark, rows)).collect())
    assert got == [(i, *x) for (i, _), x in zip(rows, brute_repeats([(t or "").encode() for _, t in rows]))]


def test_a_cluster_needs_a_shared_folder():
    from foliant.sources.shared import shared_dir

    for master, ok in (("local[4]", True), ("local", True), ("spark://host:7077", False), ("local-cluster[2,1,1024]", False)):
        conf = type("Conf", (), {"get": lambda self, k, d=None: d, "set": lambda self, k, v: None})()
        session = type("Session", (), {"conf": conf, "sparkContext": type("Context", (), {"master": master})()})()
        if ok:
            assert shared_dir(session)
        else:
            with pytest.raises(ValueError):
                shared_dir(session)


def test_written_tables_are_in_the_shared_folder(spark):
    df = written(spark.range(3).toDF("x"), "t")
    assert df.count() == 3 and df.foliant_path.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_a_shard_leaves_nothing_behind_that_it_was_built_from(monkeypatch):
    """The lists that a shard is built from are empty when it is put out, and memory is handed back; the shard is as before."""
    handed = []
    monkeypatch.setattr(topk, "give_back", lambda: handed.append(1))
    ids, counted = [7, 8, 9], list(topk.term_counts([b"a b a", b"", b"b c"]))
    batch = topk._packed_shard(3, ids, counted)
    assert ids == [] and counted == [] and handed == [1]
    own = {n: np.frombuffer(batch.column(n)[0].as_py(), k) for n, k in topk.KINDS.items()}
    assert sorted(own["docs"].tolist()) == [7, 8, 9] and sorted(own["lengths"].tolist()) == [0, 2, 3]
    assert len(own["terms"]) == 3 and np.diff(own["first"]).tolist().count(2) == 1 and sorted(own["post_counts"].tolist()) == [1, 1, 1, 2]
