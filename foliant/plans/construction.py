"""Corpus construction, writes and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.functions.udfs import MOST, TARGET
from foliant.operators import audits as A
from foliant.operators import corpus as C
from foliant.operators import structure as T
from foliant.operators import upserts as U
from foliant.plans.literals import literal, literal_sql, rows, rows_sql
from foliant.plans.registry import query
from foliant.plans.retrieval import CHUNKS_SQL, DOCS_SQL, chunks, documents
from foliant.sources import npy
from foliant.sources.shared import once
from foliant.sources.tables import spread, table

TIER_SQL = r"""SELECT *, coalesce(nullif(regexp_extract(parse_tier, '^(.*?)_split(\d+)of(\d+)$', 1), ''), parse_tier) AS base,
  TRY_CAST(nullif(regexp_extract(parse_tier, '^(.*?)_split(\d+)of(\d+)$', 2), '') AS INTEGER) AS idx, TRY_CAST(nullif(regexp_extract(parse_tier, '^(.*?)_split(\d+)of(\d+)$', 3), '') AS INTEGER) AS total FROM """


@query("SELECT doc_id, lang, n_chars FROM documents")
def scan_project(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "n_chars")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)")
def id_list_lookup(spark, d):
    ids = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    return table(spark, d, "documents").select("doc_id", "lang").join(ids, "doc_id", "left_semi")


@query(f"SELECT seq, base, idx, total FROM ({TIER_SQL}{rows_sql('tiers')})")
def parse_tier(spark, d):
    return rows(spark, d, "tiers").select("seq", X.parse_tier(F.col("parse_tier")).alias("t")).select("seq", "t.*")


@query(f"""WITH t AS ({TIER_SQL}{rows_sql('tiers')}),
r AS (SELECT *, CASE base WHEN 'standard' THEN 0 WHEN 'partial' THEN 1 WHEN 'fallback' THEN 2 WHEN 'extraction_failed' THEN 99 ELSE 50 END AS rank FROM t WHERE base <> 'overview'),
b AS (SELECT *, count(*) OVER g = count(idx) OVER g AS split FROM (SELECT * FROM r QUALIFY rank = min(rank) OVER (PARTITION BY source_file, case_number)) WHERE rank < 99 WINDOW g AS (PARTITION BY source_file, case_number)),
o AS (SELECT *, row_number() OVER (PARTITION BY source_file, case_number ORDER BY CASE WHEN split THEN idx END, seq) AS n, row_number() OVER (PARTITION BY source_file, case_number, CASE WHEN split THEN idx ELSE seq END ORDER BY seq) AS k FROM b)
SELECT source_file, case_number, min(title) FILTER (n = 1) AS title, min(base) FILTER (n = 1) AS parsing_quality,
  CASE WHEN bool_and(split) THEN string_agg(raw_text, chr(10) ORDER BY idx) FILTER (k = 1) ELSE min(raw_text) FILTER (n = 1) END AS raw_text FROM o GROUP BY source_file, case_number""")
def tier_resolve(spark, d):
    return C.resolve_tiers(rows(spark, d, "tiers"))


@query(f"""WITH t AS ({TIER_SQL}{rows_sql('tiers')}),
b AS (SELECT * FROM t WHERE idx IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_file, case_number, idx ORDER BY seq) = 1)
SELECT source_file, case_number, string_agg(raw_text, chr(10) ORDER BY idx) AS raw_text FROM b GROUP BY source_file, case_number HAVING count(*) > 1""")
def split_merge(spark, d):
    parts = rows(spark, d, "tiers").filter(F.col("parse_tier").rlike(X.TIER))
    counts = parts.withColumn("_i", X.parse_tier(F.col("parse_tier"))["idx"]).groupBy("source_file", "case_number").agg(F.count_distinct("_i").alias("c")).filter("c > 1")
    return C.resolve_tiers(parts).join(counts.select("source_file", "case_number"), ["source_file", "case_number"]).select("source_file", "case_number", "raw_text")


UNAMBIGUOUS_SQL = f"""u AS (SELECT document_id, any_value(title) AS title, arg_min(source_file, seq) AS source_file FROM {rows_sql('embed_ready')}
  GROUP BY document_id HAVING count(DISTINCT coalesce(title, chr(1))) = 1)"""


@query(f"WITH {UNAMBIGUOUS_SQL} SELECT * FROM u")
def unambiguous_docs(spark, d):
    return C.unambiguous_documents(rows(spark, d, "embed_ready"))


@query(rf"""WITH {UNAMBIGUOUS_SQL}, r AS (SELECT * FROM {rows_sql('records')} QUALIFY row_number() OVER (PARTITION BY source_file, title ORDER BY seq DESC) = 1),
m AS (SELECT document_id, u.title, coalesce(nullif(u.source_file, ''), r.source_file) AS source_file, r.raw_text AS r_raw_text FROM u JOIN r ON u.source_file IS NOT DISTINCT FROM r.source_file AND u.title IS NOT DISTINCT FROM r.title)
SELECT *, nullif(trim(regexp_replace(regexp_extract(source_file, '_\d{{4}}년\s*(.*)\.[a-zA-Z]+$', 1), '[(（]\d+[)）]\s*$', '')), '') AS audit_type FROM m""".replace("\\\\", "\\"))
def keyed_match(spark, d):
    return C.keyed_match(C.unambiguous_documents(rows(spark, d, "embed_ready")), rows(spark, d, "records"))


@query(f"SELECT document_id, arg_min(source_file, seq) AS source_file FROM {rows_sql('embed_ready')} GROUP BY document_id")
def first_source(spark, d):
    return rows(spark, d, "embed_ready").groupBy("document_id").agg(F.min_by("source_file", "seq").alias("source_file"))


@query(f"WITH {CHUNKS_SQL}, {DOCS_SQL} SELECT chunk_id FROM chunks WHERE document_id IN (SELECT document_id FROM docs WHERE parsing_quality = 'standard')")
def semi_chunks(spark, d):
    return C.semi_chunks(chunks(spark, d), documents(spark, d).filter("parsing_quality = 'standard'")).select("chunk_id")


@query("SELECT doc_id, d.lang, len(embedding) AS dims FROM documents d JOIN embeddings e ON doc_id = vec_id")
def chunk_embed_join(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id")).select("doc_id", "lang", F.size("embedding").cast("long").alias("dims"))


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def orphan_chunks(spark, d):
    docs = table(spark, d, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("document_id"))
    return C.orphan_chunks(table(spark, d, "embeddings").select(F.col("vec_id").alias("document_id")), docs).select(F.col("document_id").alias("vec_id"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_embeddings(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("SELECT CAST(vec_id AS VARCHAR) AS id, CAST(len(embedding) AS INTEGER) AS dims, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings WHERE embedding IS NOT NULL")
def vectors_by_position(spark, d):
    """All embeddings, written as pairs of NPY and JSON lines and read back by position."""

    def write(path: str) -> None:
        npy.write_pairs(spread(table(spark, d, "embeddings")).filter("embedding is not null").select(F.col("vec_id").cast("string").alias("id"), "embedding"), path, 64)

    own = npy.last_of_id(npy.read_pairs(spark, npy.pairs_in(once(spark, f"pairs {d}", write, f"{d}/embeddings.parquet")), range_bytes=10_000))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return own.select("id", F.size("embedding").alias("dims"), F.round(total, 6).alias("total"))


@query("SELECT count(*) AS n FROM documents LEFT JOIN embeddings ON doc_id = vec_id WHERE embedding IS NULL")
def missing_embedding(spark, d):
    both = table(spark, d, "documents").select("doc_id").join(table(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left")
    return both.filter(F.col("embedding").isNull()).agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_todo(spark, d):
    return U.resume(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query(f"""WITH {DOCS_SQL}, {CHUNKS_SQL}, x AS (SELECT CASE WHEN document_id % 100 = 3 THEN document_id - 1 ELSE document_id END AS id, CASE WHEN document_id % 50 = 0 THEN 'odd' ELSE parsing_quality END AS q, raw_text, year FROM docs),
c AS (SELECT CASE WHEN document_id % 97 = 5 THEN 'c' || (document_id - 1) ELSE chunk_id END AS cid, document_id, embedding FROM chunks), e AS (SELECT DISTINCT cid FROM c WHERE embedding IS NOT NULL)
SELECT *, bad_quality + missing_text + orphans > 0 AS fatal FROM (SELECT (SELECT count(*) FROM x) AS n_documents, (SELECT count(*) FROM x WHERE coalesce(q, '') NOT IN ('standard', 'partial', 'fallback')) AS bad_quality, (SELECT count(*) FROM x WHERE coalesce(raw_text, '') = '') AS missing_text,
  (SELECT count(*) FROM x WHERE year IS NULL) AS missing_year, (SELECT count(*) FROM (SELECT id FROM x GROUP BY id HAVING count(*) > 1)) AS duplicate_documents, (SELECT count(*) FROM c) AS n_chunks,
  (SELECT count(*) FROM (SELECT cid FROM c GROUP BY cid HAVING count(*) > 1)) AS duplicate_chunks, (SELECT count(*) FROM c WHERE document_id NOT IN (SELECT id FROM x)) AS orphans,
  (SELECT count(*) FROM c WHERE cid NOT IN (SELECT cid FROM e)) AS missing_embeddings)""")
def preflight(spark, d):
    """Over all rows, some with an odd quality, some with the id of the row before."""
    docs, own = documents(spark, d), chunks(spark, d)
    docs = docs.withColumn("parsing_quality", F.when(F.col("document_id") % 50 == 0, "odd").otherwise(F.col("parsing_quality")))
    docs = docs.withColumn("document_id", F.col("document_id") - F.when(F.col("document_id") % 100 == 3, 1).otherwise(0))
    own = own.withColumn("chunk_id", F.when(F.col("document_id") % 97 == 5, F.concat(F.lit("c"), (F.col("document_id") - 1).cast("string"))).otherwise(F.col("chunk_id")))
    return C.preflight(docs, own, own.filter("embedding is not null"))


@query(f"""SELECT r_regionkey AS region_key, r_name AS name FROM region UNION ALL
SELECT region_key, name FROM {literal_sql('incoming')} WHERE region_key NOT IN (SELECT r_regionkey FROM region) QUALIFY row_number() OVER (PARTITION BY region_key ORDER BY seq) = 1""")
def insert_ignore(spark, d):
    target = table(spark, d, "region").select(F.col("r_regionkey").alias("region_key"), F.col("r_name").alias("name"))
    return U.insert_ignore(target, literal(spark, "incoming"), "region_key", "seq")


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def update_changed(spark, d):
    target = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    new = U.changed(target, target.withColumn("s_acctbal", F.greatest(F.lit(0.0), "s_acctbal")), "s_suppkey", ["s_acctbal"])
    return U.update(target, new, "s_suppkey", ["s_acctbal"])


@query("SELECT 'parent' AS kind, count(*) AS n FROM orders WHERE o_orderkey % 10 <> 1 UNION ALL SELECT 'child', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 1)")
def cascade_delete(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    parents, children = U.cascade_delete(orders, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), orders.filter("k % 10 = 1"), "k")
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(parents, "parent").unionByName(count(children, "child"))


CAS_SQL = """c AS (SELECT doc_id + (CASE WHEN doc_id % 5 = 4 THEN 10000000 ELSE 0 END) AS doc_id, CASE WHEN doc_id % 5 = 2 THEN 'xx' ELSE lang END AS old, upper(lang) AS new FROM documents),
p AS (SELECT c.*, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN d.lang IS NOT DISTINCT FROM c.old THEN 'apply' ELSE 'mismatch' END AS status FROM c LEFT JOIN documents d USING (doc_id))"""


def _cas(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    moved = F.col("doc_id") + F.when(F.col("doc_id") % 5 == 4, 10000000).otherwise(0)
    old = F.when(F.col("doc_id") % 5 == 2, "xx").otherwise(F.col("lang"))
    return docs, docs.select(moved.alias("doc_id"), old.alias("old"), F.upper("lang").alias("new"))


@query(f"WITH {CAS_SQL} SELECT * FROM p")
def cas_plan(spark, d):
    return U.cas_apply(*_cas(spark, d), "doc_id", "lang", plan_only=True)


@query(f"WITH {CAS_SQL} SELECT d.doc_id, coalesce(p.new, d.lang) AS lang FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id AND status = 'apply'")
def cas_apply(spark, d):
    return U.cas_apply(*_cas(spark, d), "doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE lang = 'de' UNION SELECT doc_id FROM labels WHERE toxic = 1")
def id_union(spark, d):
    return U.id_union(table(spark, d, "documents").filter("lang = 'de'").select("doc_id"), table(spark, d, "labels").filter("toxic = 1").select("doc_id"))


@query("SELECT doc_id FROM documents WHERE lang = 'de' EXCEPT SELECT doc_id FROM labels")
def id_except(spark, d):
    return U.id_except(table(spark, d, "documents").filter("lang = 'de'"), table(spark, d, "labels"), "doc_id")


@query(f"""SELECT d.doc_id, lang, r.doc_id IS NOT NULL AS reused FROM documents d LEFT JOIN {literal_sql('done')} r ON r.doc_id = d.doc_id
ORDER BY r.doc_id IS NULL, md5('42:' || d.doc_id), d.doc_id LIMIT 100""")
def sample_reuse(spark, d):
    return C.sample_reuse(table(spark, d, "documents").select("doc_id", "lang"), literal(spark, "done"), 100)


@query("""WITH q AS (SELECT d.doc_id, CASE l.quality WHEN 1 THEN 'standard' WHEN 0 THEN 'partial' ELSE 'fallback' END AS q, length(text) AS n FROM documents d LEFT JOIN labels l USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY n, doc_id) - 1 AS rn, CASE q WHEN 'standard' THEN 20 WHEN 'partial' THEN 10 ELSE 5 END AS size, count(*) OVER (PARTITION BY q) AS c FROM q)
SELECT doc_id, q AS parsing_quality FROM r WHERE rn % greatest(1, c // size) = 0 AND rn // greatest(1, c // size) < size""")
def stratified_sample(spark, d):
    docs = documents(spark, d).select("document_id", "parsing_quality", F.length("raw_text").alias("n"))
    return C.stratified_sample(docs, {"standard": 20, "partial": 10, "fallback": 5}, "parsing_quality", "n", "document_id").select(F.col("document_id").alias("doc_id"), "parsing_quality")


@query(f"SELECT id, TRY_CAST(CASE WHEN regexp_full_match(trim(year), '[+-]?\\d+') THEN trim(year) END AS INTEGER) AS year FROM {rows_sql('years')}")
def safe_year(spark, d):
    return rows(spark, d, "years").select("id", X.safe_year(F.col("year")).alias("year"))


@query("SELECT doc_id, doc_id || '_' || left(md5(doc_id || '_' || 0 || '_' || left(text, 30)), 8) AS chunk_id FROM documents")
def chunk_id(spark, d):
    return table(spark, d, "documents").select("doc_id", X.chunk_id(F.col("doc_id"), F.lit(0), F.col("text")).alias("chunk_id"))


_bare = lambda x: f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"
#: Chunks in SQL: paragraphs, or sentences of long ones, in order; one after the other joins the chunk before it or begins another.
CHUNKED_SQL = rf"""cp AS (SELECT doc_id, i, {_bare("w[i]")} AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '\n\s*\n') AS w FROM documents WHERE text IS NOT NULL)) WHERE {_bare("w[i]")} <> ''),
cs AS (SELECT doc_id, i, j, w[j] AS s FROM (SELECT doc_id, i, w, unnest(range(1, len(w) + 1)) AS j FROM (SELECT doc_id, i, string_split(regexp_replace(p, '([.!?。])\s+', '\1' || chr(1), 'g'), chr(1)) AS w FROM cp WHERE length(p) > {MOST}))),
ce AS (SELECT doc_id, i, 0 AS j, 0 AS k, p AS s, 'paragraph' AS kind, {TARGET} AS most FROM cp WHERE length(p) <= {MOST} UNION ALL SELECT doc_id, i, j, 0, s, 'sentence', {MOST} FROM cs WHERE length(s) <= {MOST}
  UNION ALL SELECT doc_id, i, j, k, substr(s, k * {MOST} + 1, {MOST}), 'slice', 0 FROM (SELECT *, unnest(range(CAST(ceil(length(s) / {MOST}.0) AS BIGINT))) AS k FROM cs WHERE length(s) > {MOST})),
cn AS (SELECT *, row_number() OVER w AS n, kind = 'slice' OR lag(kind) OVER w IS DISTINCT FROM kind OR (kind = 'sentence' AND lag(i) OVER w <> i) AS anew FROM ce WINDOW w AS (PARTITION BY doc_id ORDER BY i, j, k)),
cr AS (SELECT doc_id, n, length(s) AS held, 0 AS c FROM cn WHERE n = 1 UNION ALL
  SELECT cn.doc_id, cn.n, CASE WHEN anew OR held + length(s) > most THEN length(s) ELSE held + length(s) END, CASE WHEN anew OR held + length(s) > most THEN c + 1 ELSE c END FROM cr JOIN cn ON cn.doc_id = cr.doc_id AND cn.n = cr.n + 1),
cj AS (SELECT doc_id, c, CASE WHEN any_value(kind) = 'paragraph' THEN string_agg(s, chr(10) || chr(10) ORDER BY n) ELSE string_agg(s, ' ' ORDER BY n) END AS s FROM cn JOIN cr USING (doc_id, n) GROUP BY doc_id, c),
cx AS (SELECT doc_id, c, k, substr(s, k * {MOST} + 1, {MOST}) AS text FROM (SELECT *, unnest(range(CAST(ceil(length(s) / {MOST}.0) AS BIGINT))) AS k FROM cj)),
chunked AS (SELECT doc_id AS document_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY c, k) - 1 AS INTEGER) AS chunk_index, text FROM cx),
fresh AS (SELECT document_id, chunk_index, document_id || '_' || left(md5(document_id || '_' || chunk_index || '_' || left(text, 30)), 8) AS chunk_id, text FROM chunked)"""


@query(f"WITH RECURSIVE {CHUNKED_SQL} SELECT * FROM fresh")
def chunk_documents(spark, d):
    return T.chunk_rows(spread(table(spark, d, "documents")))


@query(f"""WITH RECURSIVE {CHUNKED_SQL}, {CHUNKS_SQL} SELECT chunk_id, document_id, true AS to_embed FROM fresh UNION ALL
SELECT chunk_id, document_id, embedding IS NULL FROM chunks WHERE document_id NOT IN (SELECT document_id FROM fresh)""")
def rechunk_replace(spark, d):
    fresh = T.chunk_rows(spread(table(spark, d, "documents"))).select("chunk_id", "document_id", "text")
    return U.rechunk_replace(chunks(spark, d), fresh).select("chunk_id", "document_id", F.col("embedding").isNull().alias("to_embed"))


BAG_SQL = f"""WITH c AS (SELECT pair_id, side, ch, count(*) AS n FROM (SELECT pair_id, 'a' AS side, unnest(string_split(replace(a, ' ', ''), '')) AS ch FROM {rows_sql('pairs')} UNION ALL
  SELECT pair_id, 'b', unnest(string_split(replace(b, ' ', ''), '')) FROM {rows_sql('pairs')}) WHERE ch <> '' GROUP BY ALL),
m AS (SELECT pair_id, ch, sum(n) FILTER (side = 'a') AS na, sum(n) FILTER (side = 'b') AS nb FROM c GROUP BY ALL),
s AS (SELECT pair_id, sum(least(coalesce(na, 0), coalesce(nb, 0))) AS common, greatest(sum(coalesce(na, 0)), sum(coalesce(nb, 0))) AS total FROM m GROUP BY pair_id)
SELECT p.pair_id, CASE WHEN coalesce(total, 0) = 0 THEN 1e0 ELSE CAST(common AS DOUBLE) / total END AS bag FROM {rows_sql('pairs')} p LEFT JOIN s USING (pair_id)"""
GATE_SQL = f"SELECT *, CASE WHEN old_len > 0 THEN new_len / old_len ELSE 0 END AS lr FROM {rows_sql('reviews')}"


@query(f"""SELECT id, CASE WHEN similarity >= 0.9 THEN 'apply' ELSE 'review' END AS first, CASE WHEN similarity >= 0.9 OR (bag >= 0.97 AND lr BETWEEN 0.95 AND 1.05) THEN 'apply' ELSE 'review' END AS second,
  CASE WHEN similarity >= 0.9 THEN 'sequence' WHEN bag >= 0.97 AND lr BETWEEN 0.95 AND 1.05 THEN 'reorder' END AS reason FROM ({GATE_SQL})""")
def accept_gate(spark, d):
    own = rows(spark, d, "reviews").withColumn("lr", X.length_ratio(F.col("old_len"), F.col("new_len")))
    second = X.accept_second(F.col("similarity"), F.col("bag"), F.col("lr"))
    return own.select("id", X.accept_first(F.col("similarity")).alias("first"), second["decision"].alias("second"), second["reason"].alias("reason"))


@query(f"SELECT pair_id, CASE WHEN a = b THEN 'unchanged' WHEN bag >= 0.9 THEN 'apply' ELSE 'review' END AS third FROM ({BAG_SQL}) JOIN {rows_sql('pairs')} USING (pair_id)")
def third_gate(spark, d):
    own = rows(spark, d, "pairs")
    return A.bag_similarity(own).join(own, "pair_id").select("pair_id", X.accept_third(F.col("bag"), F.col("a"), F.col("b")).alias("third"))


@query(f"SELECT id, CASE WHEN id % 2 = 0 THEN 'marker_table_count_mismatch' WHEN coalesce(similarity, 0) < 0.9 THEN 'low_similarity_after_merge' END AS reason FROM {rows_sql('reviews')}")
def table_gate(spark, d):
    return rows(spark, d, "reviews").select("id", X.table_gate(F.col("id") % 2 == 1, F.coalesce("similarity", F.lit(0.0))).alias("reason"))


@query(BAG_SQL)
def bag_similarity(spark, d):
    return A.bag_similarity(rows(spark, d, "pairs"))
