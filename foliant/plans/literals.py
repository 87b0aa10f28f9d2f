"""Inputs of operators whose columns the tables do not have: derived from all rows of a table by SQL that Spark and DuckDB both read, and a few literal rows for cases that even
those do not show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources.tables import spread, table

LITERALS: dict[str, tuple[str, list[tuple]]] = {
    "titles": ("id int, text string", [
        (1, "제목 장애인 전용 주차구획 표기 부적정\n본문"), (2, "제 목 : 휴가 관리\n제목 다른 것"), (3, "제 목] 대괄호"), (4, "본문만 있음"), (5, "  제목：  채용 절차  \n"), (6, "제목"), (7, ""), (8, "제목 "), (9, "제목: a\tb"),
    ]),
    "sources": ("id int, source_file string", [
        (1, "data_repo/파일/가나공사_2016년 종합감사(27).pdf"), (2, "data_repo/a b/기관_2020년 복무감사.HWP"), (3, "/x/이름만.hwpx"), (4, "기관_종합감사(1).pdf"), (5, None), (6, ""), (7, "data_repo/"), (8, "기관_2021년 (3).doc"), (9, "a/b~c*d'(1)_2019년 특정감사（4）.docx"), (10, "_2018년 일상감사.pdf"),
    ]),
    "tiers": ("seq int, source_file string, case_number string, title string, parse_tier string, raw_text string", [
        (1, "a.pdf", "1", "t1", "standard", "first"), (2, "a.pdf", "1", "t2", "partial", "second"), (3, "a.pdf", "2", "t3", "standard_split2of2", "two"), (4, "a.pdf", "2", "t4", "standard_split1of2", "one"),
        (5, "a.pdf", "2", "t5", "standard_split2of2", "two again"), (6, "b.pdf", None, "t6", "overview", "o"), (7, "b.pdf", None, "t7", "fallback", "f1"), (8, "b.pdf", None, "t8", "fallback", "f2"), (9, None, "9", "t9", "extraction_failed", "x"),
        (10, "c.pdf", "1", "t10", "odd", "odd text"), (11, "c.pdf", "1", "t11", "extraction_failed", "x"), (12, "d.pdf", "1", "t12", "partial", "whole"), (13, "d.pdf", "1", "t13", "partial_split1of2", "part"),
    ]),
    "embed_ready": ("seq int, document_id string, chunk_id string, title string, source_file string, text string", [
        (1, "d1", "c1", "t1", "a.pdf", "x"), (2, "d1", "c2", "t1", "z.pdf", "y"), (3, "d2", "c3", "t2", "a.pdf", "x"), (4, "d2", "c4", "t3", "a.pdf", "x"), (5, "d3", "c5", None, "b.pdf", "x"), (6, "d4", "c6", None, "b.pdf", "x"), (7, "d4", "c7", "t4", "b.pdf", "x"), (8, "d5", "c8", "t9", None, "x"),
    ]),
    "records": ("seq int, source_file string, title string, raw_text string", [
        (1, "a.pdf", "t1", "old"), (2, "a.pdf", "t1", "new"), (3, "b.pdf", None, "null title"), (4, None, "t9", "null source"), (5, "q.pdf", "t1", "other"),
    ]),
    "texts": ("id int, text string", [
        (1, "가나다\n표\n라마바\n\n\n\n끝"), (2, "표\n표"), (3, " 표 \n본문은"), (4, "- 1 -\n본문\n-2-\n- x -"), (5, "「「법」」 『『안』』 ｢｢업무｣｣ 【【제】】"), (6, "직원이 연번 지적사항 처분 이다"), (7, "연번\n지적사항\n처분"), (8, "연번  지적사항처분"),
        (9, "문장이 끝나지 않고"), (10, "처분 결과 주 의"), (11, "끝났다."), (12, "그리고"), (13, "hp:run hc:abc textpos= outlineS"), (14, "linkListNextIDRef= vertpos="), (15, "그는\n도 갔다\n을 보고\n끝.\n은 아니다"), (16, "표 | a | b | c"), (17, "[표] 하나"), (18, ""),
    ]),
    "years": ("id int, year string", [(1, "2019"), (2, "2019.0"), (3, "2020년"), (4, " 2021 "), (5, ""), (6, None), (7, "x")]),
    "slugs": ("id int, institution string, year int, title string", [
        (1, "가나 공사", 2016, "휴가 / 관리 #1"), (2, None, None, None), (3, "  ", None, "a?b%c"), (4, "기관", 2020, "x" * 150), (5, "/", None, "-"), (6, "a", 0, "b\\c"),
    ]),
    "marks": ("id int, text string, query string", [
        (1, "음주운전 조치와 음주 관리", "음주 음주운전 때 조치"), (2, "Audit of audits", "AUDIT of"), (3, "a.b a+b (c)", "a.b (c)"), (4, "본문", "때 은 및"), (5, "본문", "  "),
    ]),
    "searches": ("id int, query string, earlier array<string>", [(1, " b ", ["a", "b", "c"]), (2, " ", ["a"]), (3, "f", ["a", "b", "c", "d", "e"]), (4, "x", [])]),
    "tables": ("id int, cells array<array<string>>", [(1, [["a", "", "b"], ["", ""], ["c"]]), (2, []), (3, [["x", "y"]])]),
    "marked": ("id int, text string, tables array<string>", [
        (1, "앞 <표> 뒤 <그림>", ["t1"]), (2, "표 없음 <그림>", []), (3, "<표><표>", ["a", "b"]), (4, "<표> 하나", ["a", "b"]), (5, "표 없음", ["a"]), (6, "x<표>y<표>z", ["1"]),
    ]),
    "summaries": ("id int, quality string, summary string", [
        (1, "standard", "지적\n원인\n조치\n결과"), (2, "standard", " 지적사항 불분명\n\n원인 미기재\n조치사항 미기재\n처리결과 미기재 "), (3, "partial", "하나\n둘"), (4, "partial", "지적\n원인 미기재\n조치\n처리결과 미기재"), (5, "fallback", ""), (6, "fallback", "a\nb\nc\nd\ne"), (7, "standard", "원인 미기재\n원인 미기재\n원인 미기재\n원인 미기재"),
    ]),
    "summary_rows": ("doc_id int, summary_point string, summary_cause string, summary_action string, summary_result string, summary_failed boolean, summary_freeform string, freeform_failed boolean", [
        (1, None, None, None, None, False, None, False), (2, "p", "c", "", None, False, "f", False), (3, None, None, None, None, True, None, True), (4, None, None, None, None, False, "f", False),
    ]),
    "summary_results": ("doc_id int, point string, cause string, action string, result string, failed boolean", [(1, "P", "C", "A", "R", False), (4, "x", "x", "x", "x", True), (9, "n", "n", "n", "n", False)]),
    "reviews": ("id int, similarity double, bag double, old_len int, new_len int, error string", [
        (1, 0.95, 0.99, 100, 100, None), (2, 0.5, 0.98, 100, 104, None), (3, 0.72, 0.98, 100, 120, None), (4, 0.85, 0.5, 100, 80, None), (5, 0.1, 0.97, 200, 190, None), (6, None, None, 0, 10, "TimeoutExpired: Command 'x' timed out after 90 seconds while converting the file"), (7, None, None, 0, 0, "ValueError"), (8, 0.7, 0.2, 100, 110, "ValueError"), (9, 0.9, 0.0, 50, 45, None),
    ]),
    "pairs": ("pair_id int, a string, b string", [(1, "가나 다", "다나가"), (2, "", " "), (3, "aab", "abb"), (4, "x", ""), (5, "the cat", "act the")]),
    "usage": ("id int, input_tokens int, output_tokens int, seconds double", [(1, 900, 100, 1.5), (2, 1000, 110, 2.0), (3, 950, 105, 1.75)]),
    "originals": ("id int, original string, stored string", [(1, "<표> a <표>", "본문"), (2, "<표>", "본문 [표]"), (3, "없음", "본문"), (4, "<표>", "a|b|c|d"), (5, "<표>", "a|b")]),
    "incoming": ("seq int, region_key int, name string", [(1, 7, "first"), (2, 7, "second"), (3, 0, "clash"), (4, 8, "other")]),
    "done": ("doc_id long", [(3,), (5,), (900,)]),
}


#: Rows of the same columns from the given tables. Ids begin at 1000, behind those of the literal rows; OF( makes an array; {table} is a table.
SOURCE = "source || '_' || CAST(2010 + doc_id % 9 AS STRING) || '년 특정감사(' || CAST(doc_id % 4 AS STRING) || ')'"
REVIEW = "CAST(1000 + l_orderkey * 8 + l_linenumber AS INT)"
DERIVED: dict[str, str] = {
    "titles": "SELECT CAST(1000 + doc_id AS INT) AS id, CASE doc_id % 4 WHEN 0 THEN '제목: ' || text WHEN 1 THEN '제 목 ' || text WHEN 2 THEN '  제목：' || text ELSE text END AS text FROM {documents}",
    "sources": f"SELECT CAST(1000 + doc_id AS INT) AS id, CASE doc_id % 3 WHEN 0 THEN 'data_repo/' || lang || '/' WHEN 1 THEN lang || ' (a)/' ELSE '' END || {SOURCE} || CASE doc_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.HWP' WHEN 2 THEN '.hwpx' WHEN 3 THEN '.docx' ELSE '' END AS source_file FROM {{documents}}",
    # two records of four neighbours are a case; each case has records of two tiers, or two parts
    "tiers": """SELECT CAST(1000 + doc_id AS INT) AS seq, CASE WHEN doc_id % 40 = 3 THEN NULL ELSE 'cases/' || CAST(CAST(floor(doc_id / 4.0) AS INT) AS STRING) END AS source_file, CAST(doc_id % 2 AS STRING) AS case_number, left(text, 20) AS title,
      CASE CAST(floor(doc_id / 4.0) AS INT) % 5 * 4 + doc_id % 4 WHEN 0 THEN 'standard_split1of2' WHEN 1 THEN 'fallback' WHEN 2 THEN 'standard_split2of2' WHEN 3 THEN 'standard' WHEN 4 THEN 'partial_split2of2' WHEN 5 THEN 'extraction_failed' WHEN 6 THEN 'partial_split1of2'
      WHEN 7 THEN 'overview' WHEN 8 THEN 'partial' WHEN 9 THEN 'odd' WHEN 10 THEN 'standard' WHEN 11 THEN 'partial_split1of2' ELSE 'standard' END AS parse_tier, text AS raw_text FROM {documents}""",
    "embed_ready": f"SELECT CAST(1000 + doc_id AS INT) AS seq, 'x' || CAST(CAST(floor(doc_id / 3.0) AS INT) AS STRING) AS document_id, 'c' || CAST(doc_id AS STRING) AS chunk_id, CASE WHEN doc_id % 18 > 14 THEN NULL WHEN doc_id % 9 < 3 THEN lang ELSE 'report' END AS title, {SOURCE} || '.pdf' AS source_file, text FROM {{documents}}",
    "records": f"SELECT CAST(1000 + doc_id AS INT) AS seq, {SOURCE} || '.pdf' AS source_file, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN lang ELSE 'report' END AS title, text AS raw_text FROM {{documents}}",
    "texts": """SELECT CAST(1000 + doc_id AS INT) AS id, CASE doc_id % 14 WHEN 0 THEN '표' || chr(10) || text || chr(10) || ' 표 ' || chr(10) || chr(10) || chr(10) || '끝' WHEN 1 THEN text || chr(10) || '- 3 -' || chr(10) || '-12-' WHEN 2 THEN '「「' || text || '」」 『『안』』' WHEN 3 THEN text || ' 연번 지적사항 처분 이다'
      WHEN 4 THEN text || chr(10) || '연번' || chr(10) || '지적사항' || chr(10) || '처분' WHEN 5 THEN 'hp:run hc:abc ' || text || ' textpos=' WHEN 6 THEN 'outlineS ' || text || ' 때문에는' WHEN 7 THEN text || ' 처분 결과 주 의' WHEN 8 THEN replace(text, '. ', chr(10) || '은 ') WHEN 9 THEN text || ' 그리고'
      WHEN 10 THEN replace(text, ', ', ' | ') WHEN 11 THEN replace(text, ', ', chr(10) || '도 ') WHEN 12 THEN text || ' linkListNextIDRef= 및' ELSE text END AS text FROM {documents}""",
    "years": "SELECT CAST(1000 + o_orderkey AS INT) AS id, CASE o_orderkey % 6 WHEN 0 THEN CAST(year(o_orderdate) AS STRING) WHEN 1 THEN ' ' || CAST(year(o_orderdate) AS STRING) || ' ' WHEN 2 THEN CAST(year(o_orderdate) AS STRING) || '년' WHEN 3 THEN '' WHEN 4 THEN CAST(year(o_orderdate) AS STRING) || '.0' END AS year FROM {orders}",
    "slugs": "SELECT CAST(1000 + doc_id AS INT) AS id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE source END AS institution, CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE CAST(2010 + doc_id % 12 AS INT) END AS year, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE replace(left(text, 120), ',', '/') END AS title FROM {documents}",
    "marks": "SELECT CAST(1000 + doc_id AS INT) AS id, text, CASE doc_id % 4 WHEN 0 THEN 'the of THE' WHEN 1 THEN 'a.b (un) de der' WHEN 2 THEN ' ' || left(replace(text, chr(10), ' '), 12) ELSE ' 및 때 ' END AS query FROM {documents}",
    "searches": "SELECT CAST(1000 + doc_id AS INT) AS id, CASE doc_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN ' ' || lang || ' ' ELSE source END AS query, OF('en', lang, source, left(text, 5), 'fr') AS earlier FROM {documents}",
    "tables": "SELECT CAST(1000 + doc_id AS INT) AS id, OF(OF(lang, '', source), OF('', ''), OF(left(text, 20)), OF(CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'x' END)) AS cells FROM {documents}",
    "marked": "SELECT CAST(1000 + doc_id AS INT) AS id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN left(text, 50) || '<표>' || substr(text, 51) || '<그림>' WHEN 2 THEN '<표>' || text || '<표>' ELSE replace(text, '. ', ' <표> ') END AS text, CASE WHEN doc_id % 8 < 4 THEN OF(source) ELSE OF(source, lang) END AS tables FROM {documents}",
    "summaries": """SELECT CAST(1000 + doc_id AS INT) AS id, CASE doc_id % 3 WHEN 0 THEN 'standard' WHEN 1 THEN 'partial' ELSE 'fallback' END AS quality, CASE doc_id % 5 WHEN 0 THEN replace(left(text, 40), chr(10), ' ') || chr(10) || '원인 미기재' || chr(10) || chr(10) || lang || chr(10) || source
      WHEN 1 THEN '지적사항 불분명' || chr(10) || '원인 미기재' || chr(10) || ' ' || chr(10) || '조치사항 미기재' || chr(10) || '처리결과 미기재' WHEN 2 THEN text WHEN 3 THEN lang || chr(10) || source ELSE '지적사항 불분명' || chr(10) || lang || chr(10) || lang || chr(10) || '처리결과 미기재' END AS summary FROM {documents}""",
    "summary_rows": """SELECT CAST(1000 + doc_id AS INT) AS doc_id, CASE WHEN doc_id % 4 = 0 THEN left(text, 30) END AS summary_point, CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN '' END AS summary_cause, CASE WHEN doc_id % 4 = 0 THEN source END AS summary_action, CASE WHEN doc_id % 8 = 0 THEN lang END AS summary_result,
      doc_id % 5 = 1 AS summary_failed, CASE WHEN doc_id % 3 = 0 THEN left(text, 60) END AS summary_freeform, doc_id % 7 = 2 AS freeform_failed FROM {documents}""",
    "summary_results": "SELECT CAST(1000 + doc_id AS INT) AS doc_id, left(text, 10) AS point, lang AS cause, source AS action, lang || source AS result, doc_id % 9 = 4 AS failed FROM {documents} WHERE doc_id % 3 = 1",
    "reviews": f"SELECT {REVIEW} AS id, CASE WHEN l_linenumber = 5 THEN NULL ELSE 1 - l_discount * 6 END AS similarity, 1 - l_tax AS bag, CAST(l_quantity AS INT) - 1 AS old_len, CAST(l_quantity + l_linenumber - 3 AS INT) AS new_len, CASE l_linenumber WHEN 5 THEN 'TimeoutExpired: part ' || CAST(l_suppkey AS STRING) || ' timed out after 90 seconds while converting the file' WHEN 6 THEN 'ValueError' END AS error FROM {{lineitem}}",
    "pairs": "SELECT CAST(1000 + doc_id AS INT) AS pair_id, text AS a, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, 'e', 'a') WHEN 2 THEN left(text, 200) ELSE replace(text, ' ', '') || '.' END AS b FROM {documents}",
    "usage": "SELECT CAST(1000 + doc_id AS INT) AS id, CAST(length(text) AS INT) AS input_tokens, CAST(40 + doc_id % 90 AS INT) AS output_tokens, doc_id % 16 * 0.25E0 AS seconds FROM {documents}",
    "originals": "SELECT CAST(1000 + doc_id AS INT) AS id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN '<표>' || text ELSE replace(text, '. ', ' <표> ') END AS original, CASE doc_id % 5 WHEN 0 THEN text || ' [표]' WHEN 1 THEN replace(text, ', ', '|') ELSE text END AS stored FROM {documents}",
}
TABLES = ("documents", "orders", "lineitem")


def rows(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The derived rows of an input, and its literal ones."""
    schema, own = LITERALS[name]
    given = {t: spread(table(spark, d, t)) for t in TABLES if f"{{{t}}}" in DERIVED[name]}
    literals = spark.createDataFrame(own, schema)
    derived = spark.sql(DERIVED[name].replace("OF(", "array("), **given)
    return derived.select(*[F.col(f.name).cast(f.dataType) for f in literals.schema]).unionByName(literals)


def rows_sql(name: str) -> str:
    """The same rows as a parenthesised SQL query."""
    derived = DERIVED[name].replace("OF(", "list_value(")
    for t in TABLES:
        derived = derived.replace(f"{{{t}}}", t)
    return f"({derived} UNION ALL {literal_sql(name)[1:-1]})"


def literal(spark: SparkSession, name: str) -> DataFrame:
    schema, own = LITERALS[name]
    return spark.createDataFrame(own, schema)


def _sql(value, kind: str) -> str:
    if value is None:
        return f"CAST(NULL AS {kind})"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return f"CAST({value!r} AS {kind})"
    if isinstance(value, list):
        return f"CAST([{', '.join(_sql(v, kind[:-2]) for v in value)}] AS {kind})"
    return "'" + value.replace("'", "''") + "'"


def literal_sql(name: str) -> str:
    """The same rows as a parenthesised SQL query."""
    schema, rows = LITERALS[name]
    names, kinds = zip(*(x.split(" ", 1) for x in schema.split(", ")))
    kinds = [{"string": "VARCHAR", "long": "BIGINT", "array<string>": "VARCHAR[]", "array<array<string>>": "VARCHAR[][]"}.get(k, k.upper()) for k in kinds]
    body = ", ".join("(" + ", ".join(_sql(v, k) for v, k in zip(row, kinds)) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({', '.join(names)}))"
