"""Filters, counts and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators import audits as A
from foliant.operators.ranks import quantile
from foliant.plans.literals import rows, rows_sql
from foliant.plans.registry import query
from foliant.plans.repairing import CORRUPT_SQL, corrupt
from foliant.plans.retrieval import DOCS_SQL, documents
from foliant.sources.tables import table

DISPOSITION_SQL = " OR ".join(f"ends_with(bare, '{w}')" for w in X.DISPOSITIONS)


@query(f"SELECT id FROM {rows_sql('sources')} WHERE source_file ILIKE '%.pdf' OR (source_file ILIKE '%.hwp' AND NOT source_file ILIKE '%.hwpx')")
def ext_filter(spark, d):
    s = F.col("source_file")
    return rows(spark, d, "sources").filter(s.ilike("%.pdf") | (s.ilike("%.hwp") & ~s.ilike("%.hwpx"))).select("id")


@query("SELECT doc_id FROM documents WHERE length(text) BETWEEN 900 AND 1020")
def length_band(spark, d):
    return table(spark, d, "documents").filter(F.length("text").between(900, 1020)).select("doc_id")


@query("SELECT page_id FROM pages WHERE html LIKE '%<table%' OR html LIKE '%</ul>%'")
def marker_like(spark, d):
    return table(spark, d, "pages").filter(F.col("html").contains("<table") | F.col("html").contains("</ul>")).select("page_id")


@query(f"SELECT id FROM {rows_sql('texts')} WHERE contains(text, '연번 지적사항 처분') OR contains(text, '연번' || chr(10) || '지적사항' || chr(10) || '처분')")
def template_marker(spark, d):
    return rows(spark, d, "texts").filter(X.any_of(X.TEMPLATE_MARKERS, F.col("text").contains)).select("id")


@query(f"SELECT id, regexp_matches(text, '연번[\\s\\n]*지적사항[\\s\\n]*처분') AS flag FROM {rows_sql('texts')}")
def interleave_flag(spark, d):
    return rows(spark, d, "texts").select("id", F.col("text").rlike(X.INTERLEAVED).alias("flag"))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY n DESC, event_type LIMIT 20")
def type_top20(spark, d):
    return A.top_counts(table(spark, d, "events"), ["event_type"], 20)


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1")
def year_histogram(spark, d):
    return A.group_counts(table(spark, d, "orders").filter("o_orderdate is not null").select(F.year("o_orderdate").alias("year")), ["year"])


@query("WITH c AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY 1) SELECT year, n, round(greatest(6.0, n / max(n) OVER () * 100), 6) AS height, year = max(year) OVER () AS latest FROM c")
def year_bars(spark, d):
    return A.bars(year_histogram(spark, d), "year").withColumn("height", F.round("height", 6))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) >= 2")
def inst_year_hotspots(spark, d):
    return A.group_counts(table(spark, d, "documents"), ["source", "lang"], 2)


@query("SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY n DESC, source LIMIT 10")
def inst_topn(spark, d):
    return A.top_counts(table(spark, d, "documents"), ["source"], 10)


@query("SELECT sha256(coalesce(text, '')) AS text_hash, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dups(spark, d):
    return A.exact_duplicates(table(spark, d, "documents"))


#: Every third document comes a second time, with another ending.
COPIED_SQL = "copied AS (SELECT document_id AS doc_id, institution, year, raw_text AS text FROM docs UNION ALL SELECT -1 - document_id, institution, year, raw_text || ' (' || document_id || ')' FROM docs WHERE document_id % 3 = 0)"


@query(f"""WITH {DOCS_SQL}, {COPIED_SQL}, s AS (SELECT * FROM copied QUALIFY count(*) OVER (PARTITION BY text) = 1)
SELECT institution, year, sha256(left(regexp_replace(text, '\\s+', '', 'g'), 300)) AS head_hash, count(*) AS n, min(doc_id) AS first_id FROM s WHERE length(text) >= 100 GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def near_dups(spark, d):
    """Of all documents, and of copies of every third one that end in another way."""
    docs = documents(spark, d).select(F.col("document_id").alias("doc_id"), "institution", "year", F.col("raw_text").alias("text"))
    copies = docs.filter("doc_id % 3 = 0").withColumn("text", F.concat("text", F.lit(" ("), F.col("doc_id").cast("string"), F.lit(")"))).withColumn("doc_id", -1 - F.col("doc_id"))
    return A.near_duplicates(docs.unionByName(copies), ["institution", "year"])


DOUBLES_SQL = f"""WITH t AS (SELECT doc_id, text FROM documents UNION ALL SELECT -id, text FROM {CORRUPT_SQL}),
f AS (SELECT DISTINCT doc_id, text[i:i + 1] AS pattern FROM (SELECT doc_id, text, unnest(range(1, length(text))) AS i FROM t) WHERE text[i] = text[i + 1] AND text[i] BETWEEN '가' AND '힣')
SELECT pattern, count(*) AS n_docs, CASE WHEN min(doc_id) = max(doc_id) THEN [min(doc_id)] ELSE [min(doc_id), max(doc_id)] END AS sample_ids FROM f GROUP BY pattern ORDER BY n_docs DESC, pattern LIMIT 500"""


@query(DOUBLES_SQL)
def isolated_dup_freq(spark, d):
    """Doubled syllables of all documents, and of texts that have some."""
    docs = table(spark, d, "documents").select("doc_id", "text").unionByName(corrupt(spark).select((-F.col("id")).cast("long").alias("doc_id"), "text"))
    return A.pattern_frequency(docs, rf"([{X.HANGUL}])\1")


@query(f"""SELECT unnest(['runs', 'shapes', 'positions', 'links', 'outline']) AS family, unnest([sum(regexp_matches(text, 'hp:run|hp:linesegarray')::INT), sum(regexp_matches(text, 'hc:\\w+')::INT),
  sum(regexp_matches(text, 'textpos=|vertpos=')::INT), sum(regexp_matches(text, 'linkListNextIDRef=')::INT), sum(regexp_matches(text, 'outlineS')::INT)])::BIGINT AS n_docs FROM {rows_sql('texts')}""")
def tag_families(spark, d):
    return A.tag_families(rows(spark, d, "texts"), X.TAG_FAMILIES)


@query(f"SELECT count(similarity) AS n, round(avg(similarity), 9) AS mean, median(similarity) AS median, min(similarity) AS least, max(similarity) AS most FROM {rows_sql('reviews')}")
def sim_stats(spark, d):
    return A.similarity_statistics(rows(spark, d, "reviews")).withColumn("mean", F.round("mean", 9))


@query("SELECT l_returnflag, count(*) AS n, min(l_extendedprice) AS least, max(l_extendedprice) AS most, (SELECT median(l_extendedprice) FROM lineitem) AS median_of_all, (SELECT quantile_cont(l_extendedprice, 0.99) FROM lineitem) AS high_of_all FROM lineitem GROUP BY l_returnflag")
def price_ranks(spark, d):
    """Exact median and 99th percentile of all prices beside the groups' extremes."""
    own = table(spark, d, "lineitem")
    groups = own.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most"))
    return groups.select("*", F.lit(quantile(own, "l_extendedprice")).alias("median_of_all"), F.lit(quantile(own, "l_extendedprice", 0.99)).alias("high_of_all"))


@query(f"""SELECT CASE WHEN similarity < 0.5 THEN '[0,.5)' WHEN similarity < 0.7 THEN '[.5,.7)' WHEN similarity < 0.8 THEN '[.7,.8)' ELSE '[.8,.9)' END AS bucket, count(*) AS n FROM {rows_sql('reviews')} WHERE similarity < 0.9 GROUP BY 1""")
def sim_buckets(spark, d):
    own = rows(spark, d, "reviews").withColumn("bucket", A.similarity_bucket(F.col("similarity")))
    return A.group_counts(own.filter("bucket is not null"), ["bucket"])


@query(f"SELECT count(*) AS n, count(*) FILTER (new_len / old_len >= 1.1) AS longer, count(*) FILTER (new_len / old_len <= 0.9) AS shorter FROM {rows_sql('reviews')} WHERE old_len > 0")
def len_ratio_flags(spark, d):
    return A.length_flags(rows(spark, d, "reviews"))


@query(f"SELECT left(error, 60) AS error, count(*) AS n FROM {rows_sql('reviews')} WHERE error IS NOT NULL GROUP BY 1")
def error_patterns(spark, d):
    return A.group_counts(rows(spark, d, "reviews").filter("error is not null").select(F.substring("error", 1, 60).alias("error")), ["error"])


LINES_SQL = "list_filter(string_split(trim(summary, chr(10) || ' '), chr(10)), lambda x: trim(x) <> '')"


@query(f"""WITH s AS (SELECT quality, {LINES_SQL} AS l FROM {rows_sql('summaries')})
SELECT quality, count(*) AS n, count(*) FILTER (contains(l[1], '지적사항 불분명')) AS line1, count(*) FILTER (contains(l[2], '원인 미기재')) AS line2, count(*) FILTER (contains(l[3], '조치사항 미기재')) AS line3, count(*) FILTER (contains(l[4], '처리결과 미기재')) AS line4
FROM s WHERE len(l) = 4 GROUP BY quality""")
def fallback_usage(spark, d):
    return A.fallback_usage(rows(spark, d, "summaries"))


@query(f"""WITH m AS (SELECT avg(input_tokens) AS avg_in, avg(output_tokens) AS avg_out, avg(seconds) AS avg_seconds FROM {rows_sql('usage')}), c AS (SELECT *, avg_in / 1e6 * 0.15 + avg_out / 1e6 * 0.6 AS cost_each FROM m)
SELECT avg_in, avg_out, avg_seconds, round(cost_each, 12) AS cost_each, round(cost_each * 72913, 6) AS cost_all, round(avg_seconds * 72913 / 3600 / 5, 6) AS hours FROM c""")
def cost_projection(spark, d):
    out = A.cost_projection(rows(spark, d, "usage"), 72913, 0.15, 0.6, 5)
    return out.withColumn("cost_each", F.round("cost_each", 12)).withColumn("cost_all", F.round("cost_all", 6)).withColumn("hours", F.round("hours", 6))


@query("SELECT count(*) AS n, avg(toxic::DOUBLE) AS rate, CAST(round(avg(toxic::DOUBLE) * 67751) AS BIGINT) AS estimate FROM labels")
def population_estimate(spark, d):
    return A.population_estimate(table(spark, d, "labels"), "toxic", 67751)


@query("""WITH n AS (SELECT sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings WHERE embedding IS NOT NULL)
SELECT count(*) AS n, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, abs(avg(n) - 1) <= 0.01 AS ok FROM n""")
def norm_gate(spark, d):
    return A.norm_gate(table(spark, d, "embeddings")).withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query("SELECT lang, count(*) AS n, round(avg(length(text)), 6) AS mean, min(length(text)) AS least, max(length(text)) AS most FROM documents GROUP BY lang")
def chunk_stats(spark, d):
    n = F.length("text").cast("long")
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean"), F.min(n).alias("least"), F.max(n).alias("most"))


@query(f"SELECT (len(string_split(original, '<표>')) - 1)::INTEGER AS n_table_markers, count(*) AS n FROM {rows_sql('originals')} GROUP BY 1")
def table_count_histogram(spark, d):
    return A.group_counts(A.table_loss(rows(spark, d, "originals")), ["n_table_markers"])


@query(f"""WITH t AS (SELECT id, (len(string_split(original, '<표>')) - 1)::INTEGER AS n_table_markers, contains(stored, '<표>') OR contains(stored, '[표]') OR length(stored) - length(replace(stored, '|', '')) >= 3 AS has_trace FROM {rows_sql('originals')})
SELECT *, n_table_markers > 0 AND NOT has_trace AS affected FROM t""")
def table_loss(spark, d):
    return A.table_loss(rows(spark, d, "originals"))


PLACEHOLDER_SQL = "trim(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '표'), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), chr(10) || ' ')"


@query(f"""SELECT coalesce(CASE WHEN length(text) < 50 AND q <> 'fallback' THEN 'short_non_fallback' WHEN contains(text, chr(65533)) THEN 'encoding_broken' WHEN length({PLACEHOLDER_SQL}) < 300 THEN 'table_placeholder_only' END, 'keep') AS reason, count(*) AS n
FROM (SELECT d.text, CASE l.quality WHEN 1 THEN 'standard' WHEN 0 THEN 'partial' ELSE 'fallback' END AS q FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY 1""")
def unrecoverable_docs(spark, d):
    from foliant.plans.retrieval import documents

    reason = F.coalesce(X.unrecoverable_reason(F.col("raw_text"), F.col("parsing_quality")), F.lit("keep"))
    return A.group_counts(documents(spark, d).select(reason.alias("reason")), ["reason"])


@query(f"""SELECT length({PLACEHOLDER_SQL}) < 300 AS short, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY 1""")
def placeholder_spike(spark, d):
    flagged = table(spark, d, "labels").filter("quality = 0").select("doc_id")
    own = table(spark, d, "documents").join(flagged, "doc_id", "left_semi")
    return A.group_counts(own.select((F.length(X.strip_placeholder(F.col("text"))) < 300).alias("short")), ["short"])


@query(f"""WITH t AS (SELECT id, trim(string_split(rtrim(text, chr(10) || ' '), chr(10))[-1]) AS last FROM {rows_sql('texts')}), b AS (SELECT *, regexp_replace(last, '\\s+', '', 'g') AS bare FROM t)
SELECT id, regexp_matches(last, '(및|에|은|는|이|가|을|를|로|와|과|의|하고|하며|또는|그리고)\\s*$') AND NOT regexp_matches(last, '[.!?。」』"'')\\]】>]\\s*$') AND NOT ({DISPOSITION_SQL}) AS cut FROM b""")
def truncated(spark, d):
    return rows(spark, d, "texts").select("id", X.looks_truncated(F.col("text")).alias("cut"))


@query(f"""WITH t AS (SELECT id, list_transform(string_split(text, chr(10)), lambda x: trim(x)) AS l FROM {rows_sql('texts')})
SELECT id, CAST(len(list_filter(range(2, len(l) + 1), lambda i: regexp_matches(l[i], '^({'|'.join(X.LEADING_PARTICLES)})(\\s|$)') AND l[i - 1] <> '' AND NOT regexp_matches(l[i - 1], '[.!?。:：)\\]】」』]$'))) AS INTEGER) AS hits FROM t""")
def wordbreak_scan(spark, d):
    return rows(spark, d, "texts").select("id", X.word_breaks(F.col("text")).alias("hits"))
