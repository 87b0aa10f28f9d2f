"""The queries of this subpackage, each over its whole table with production parameters, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, language, licenses, mixing, quality, repeats, sharding, tokenstore, topk, variants, warc, whitening
from .common import broadcast_if_small, new_path, table, written
from .decontaminate import contained_items


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.arc_to_records(written(warc.pages_as_arc(table(spark, sf_dir, "pages")), "arc"))
    groups = broadcast_if_small(written(warc.revisits(records), "revisits"))
    warc.write_warc(records, groups, path := new_path(spark, "warc"), strict=True)
    read = warc.with_responses(warc.read_warc(spark, path))
    return read.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "valid")


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(~held_out()).select("text", "lang"))
    return language.predict(docs, model).withColumn("held_out", held_out())


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).drop("class_id")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokenstore.write_store(table(spark, sf_dir, "documents"), path := new_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    return tokenstore.document_sums(spark, path)


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.cut_repeats(table(spark, sf_dir, "documents"))


def quality_model(spark: SparkSession, sf_dir: str) -> quality.RuleEnsemble:
    return quality.fit(table(spark, sf_dir, "documents").filter(~held_out()), table(spark, sf_dir, "labels").filter(~held_out()))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents").select("doc_id", "text"), quality_model(spark, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= quality.REJECT_BELOW).cast("int").alias("predicted"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return topk.bm25_topk(docs, docs.filter(topk.is_query())).withColumn("score", F.round("score", 4))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sharding.write_shards(docs, path := new_path(spark, "shards"))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return sharding.read_shards(spark, path, docs.schema).select(
        "doc_id", sharding.record_bytes().alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


#: One run in so many loses a letter, so that variants stand in the texts.
WORN = 31


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(variants.counted(variants.worn(variants.runs(table(spark, sf_dir, "documents")), WORN)))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = whitening.usable(table(spark, sf_dir, "embeddings"))
    if (model := whitening.fit(own)) is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows = whitening.whitened(own.select("vec_id", "embedding"), model)
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues[: whitening.COMPONENTS]])
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(whitening.identity_error(rows)).alias("identity_error"),
    )


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP1_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN first END AS refers_to, true AS valid
FROM g
"""

OP4_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END, ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (s) JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
      WHERE a.doc_id <> b.doc_id GROUP BY 1, 2, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
r AS (SELECT a AS doc_id, b AS other FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce((SELECT min(other) FROM r WHERE r.doc_id = d.doc_id), d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP6_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, i, b[i:i + 199] AS s FROM (SELECT r, b, unnest(range(1, octet_length(b) - 198)) AS i FROM d WHERE octet_length(b) >= 200)),
x AS (SELECT r, i FROM w WHERE s IN (SELECT s FROM w GROUP BY s HAVING count(*) > 1)),
g AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM x),
k AS (SELECT r, k, min(i) AS lo, max(i) + 199 AS hi FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM g) GROUP BY r, k),
p AS (SELECT r, k, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY r ORDER BY k) AS before FROM k),
c AS (SELECT r, string_agg(hex(b[before + 1:lo - 1]), '' ORDER BY k) AS kept, max(hi) AS last, sum(hi - lo + 1) AS removed, count(*) AS spans FROM p JOIN d USING (r) GROUP BY r)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(CASE WHEN c.r IS NULL THEN b ELSE unhex(kept || hex(b[last + 1:octet_length(b)])) END) AS kept_sha256
FROM d LEFT JOIN c ON c.r = d.r
"""

OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS w FROM documents WHERE doc_id IS NOT NULL),
t AS (SELECT r, doc_id, w, count(*) AS tf FROM (SELECT r, doc_id, unnest(w) AS w FROM d) GROUP BY r, doc_id, w),
a AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS mean FROM d),
f AS (SELECT w, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM t, a GROUP BY w, n),
q AS (SELECT DISTINCT doc_id AS query_id, w FROM t WHERE doc_id % 50 = 0),
s AS (SELECT query_id, t.r, t.doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d.w) / mean))) AS score
      FROM q JOIN t USING (w) JOIN f USING (w) JOIN d ON d.r = t.r, a GROUP BY 1, 2, 3),
k AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s)
SELECT query_id, rank, doc_id, round(score, 4) AS score FROM k WHERE rank <= 10
"""

OP10_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, w, least(5, len(w)) AS m FROM (SELECT item_id, {WORDS_SQL} AS w FROM benchmark) WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, m, array_to_string(w[i:i + m - 1], ' ') AS s
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM b))),
bs AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS s
       FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM b)),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS n_item_shingles, CAST(count(*) AS INTEGER) AS n_shared, count(*) / n::DOUBLE AS containment
FROM bs JOIN ds USING (m, s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n HAVING 5 * count(*) >= 4 * n
"""

#: CRC32 by its table, over the UTF-8 bytes of texts of ASCII characters and letters up to U+00FF.
CRC_SQL = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(s, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END))),
  lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT)"""
OP12_SQL = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END)) AS t),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
h AS (SELECT run, m, {CRC_SQL} AS h FROM (SELECT run, count(*) AS m, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s FROM r GROUP BY doc_id, run), crc),
o AS (SELECT m, CASE WHEN h % {WORN} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
w AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM o WHERE length(word) >= 7 GROUP BY word HAVING sum(m) >= 2),
d AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS k FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word AS a, b.word AS b FROM d a JOIN d b USING (i, k) WHERE a.word <> b.word
      UNION SELECT w.word, d.word FROM w JOIN d ON d.k = w.word UNION SELECT d.word, w.word FROM w JOIN d ON d.k = w.word),
c AS (SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS place FROM p JOIN w ON w.word = b),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN c.n >= 10 * w.n THEN b END AS form, CASE WHEN c.n >= 10 * w.n THEN c.n END AS form_n FROM w LEFT JOIN c ON a = word AND place = 1),
z AS (SELECT word, word AS at, form AS up FROM f UNION ALL SELECT z.word, f.word, f.form FROM z JOIN f ON f.word = z.up)
SELECT f.*, z.at AS root FROM f JOIN z ON z.word = f.word AND z.up IS NULL
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op4_jaccard": OP4_SQL, "op6_repeats": OP6_SQL, "op9_bm25": OP9_SQL, "op10_benchmark_decontamination": OP10_SQL, "op12_variants": OP12_SQL}
