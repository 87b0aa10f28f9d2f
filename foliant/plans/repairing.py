"""Text repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.functions.udfs import html_unescape
from foliant.functions.udfs import strip_markup as markup
from foliant.operators.upserts import changed_texts
from foliant.plans.literals import rows, rows_sql
from foliant.plans.registry import query
from foliant.sources.tables import spread, table


def full_fix_column(c):
    """Markup first, so that structure is clean; then doubled characters, digits, brackets; placeholders; the title label."""
    for step in (markup, X.dedup_chars, X.dedup_digits, X.dedup_brackets, X.strip_placeholder, X.title_colon):
        c = step(c)
    return c


CORRUPT = [
    (1, "감감사사 결결과과 보고"), (2, "22002244년 0000년 000000"), (3, "「「법」」 각각"), (4, "제목 장애인 주차"), (5, "제 목  : X"), (6, "가\n표\n나"),
    (7, 'hp:run charPrIDRef="1" 본문 / hasT 내용'), (8, "각각 종종"), (9, "○○○ 부서와 ●● 과"), (10, "제목\n2. 둘째"), (11, "제목: 첫째\n\n2. 둘째\n본문"), (12, "1. 제목\n2. 둘째"), (13, "가가가가나나나나"),
]


def corrupt(spark):
    return spark.createDataFrame(CORRUPT, "id int, text string")


CORRUPT_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t.replace(chr(39), chr(39) * 2)}')" for i, t in CORRUPT) + ") v(id, text))"
#: All documents, and texts that need each repair, under ids below 0.
REPAIRED_SQL = f"(SELECT doc_id AS id, text FROM documents UNION ALL SELECT -id, text FROM {CORRUPT_SQL})"


def damaged(spark, d):
    return spread(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")).unionByName(corrupt(spark).select((-F.col("id")).cast("long").alias("id"), "text"))


LABEL = r"^(제\s*목)"
COLON_SQL = rf"""CASE WHEN regexp_matches(text, '{LABEL}\s+([^\s:：]|$)') THEN regexp_replace(text, '{LABEL}\s+', '\1 : ')
  WHEN regexp_matches(text, '{LABEL}\s+\s[:：]') THEN regexp_replace(text, '{LABEL}\s+(\s[:：])', '\1 : \2') ELSE text END"""
GLYPHS_SQL = "text"
for _ch in X.MASK_GLYPHS:
    GLYPHS_SQL = f"regexp_replace({GLYPHS_SQL}, '{_ch}{{2,}}', '{X.DEPARTMENT}', 'g')"


#: Chains and runs digit by digit, as SQL's patterns cannot refer back.
CHAIN_SQL = "(?:(?:" + "|".join(f"{n}{{2,4}}" for n in range(10)) + ") ?){2,}"
_ONCE = "m"
for _n in range(10):
    _ONCE = f"regexp_replace({_ONCE}, '{_n}+', '{_n}', 'g')"
_PASS = f"""(SELECT id, array_to_string(list_transform(range(1, len(b) + 1), lambda i: b[i] || coalesce(f[i], '')), '') AS text FROM (SELECT id, b, list_transform(f, lambda m: CASE WHEN len(list_distinct(regexp_extract_all(m, '\\d'))) < 2 THEN m ELSE {_ONCE} END) AS f
  FROM (SELECT id, string_split_regex(text, '{CHAIN_SQL}') AS b, regexp_extract_all(text, '{CHAIN_SQL}') AS f FROM OWN)))"""
DIGITS_SQL = REPAIRED_SQL
for _n in range(5):
    DIGITS_SQL = _PASS.replace("OWN", DIGITS_SQL)
_bare = lambda x: f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"
TITLE_NUMBER_SQL = f"""WITH l AS (SELECT id, string_split(text, chr(10)) AS l FROM {REPAIRED_SQL}), k AS (SELECT *, coalesce(list_position(list_transform(l[1:5], lambda x: {_bare("x")} <> ''), true), 0) AS k FROM l),
t AS (SELECT *, {_bare("l[greatest(k, 1)]")} AS title, {_bare(f"list_filter(l[k + 1:k + 2], lambda x: {_bare('x')} <> '')[1]")} AS after FROM k)
SELECT id, CASE WHEN k > 0 AND regexp_matches(title, '{X.TITLE_WITHOUT_NUMBER.removeprefix("(?U)")}') AND NOT regexp_matches(title, '{X.NUMBERED_LINE.removeprefix("(?U)")}') AND coalesce(TRY_CAST(nullif(regexp_extract(after, '{X.NUMBERED_LINE.removeprefix("(?U)")}', 1), '') AS INTEGER), 0) >= 2
  THEN array_to_string(list_concat(l[1:k - 1], ['1. ' || title], l[k + 1:]), chr(10)) END AS fixed FROM t"""


def _each(name, f, sql=None):
    def run(spark, d):
        return damaged(spark, d).select("id", f(F.col("text")).alias("fixed"))

    run.__name__ = name
    return query(sql if sql is None or "SELECT" in sql else f"SELECT id, {sql} AS fixed FROM {REPAIRED_SQL}")(run)


for _name, _f, _sql in [
    ("dedup_chars", X.dedup_chars, None), ("dedup_digits", X.dedup_digits, f"SELECT id, text AS fixed FROM {DIGITS_SQL}"), ("title_colon", X.title_colon, COLON_SQL), ("strip_markup", markup, None), ("mask_glyphs", X.mask_glyphs, GLYPHS_SQL),
    ("title_number", X.title_number, TITLE_NUMBER_SQL), ("full_fix", full_fix_column, None),
]:
    globals()[_name] = _each(_name, _f, _sql)


BRACKETS_SQL = "text"
for _ch in X.BRACKETS:
    for _n in (4, 3, 2):
        BRACKETS_SQL = f"replace({BRACKETS_SQL}, '{_ch * _n}', '{_ch}')"


@query(f"SELECT id, {BRACKETS_SQL} AS fixed FROM {rows_sql('texts')}")
def dedup_brackets(spark, d):
    return rows(spark, d, "texts").select("id", X.dedup_brackets(F.col("text")).alias("fixed"))


@query("SELECT doc_id, md5(replace(text || chr(0) || 'x', chr(0), '')) AS digest FROM documents")
def nul_strip(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.nul_strip(F.concat("text", F.lit("\0x")))).alias("digest"))


@query(f"SELECT id, trim(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '표'), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10) || ' ') AS fixed FROM {rows_sql('texts')}")
def strip_placeholder(spark, d):
    return rows(spark, d, "texts").select("id", X.strip_placeholder(F.col("text")).alias("fixed"))


@query(f"SELECT id, regexp_replace(text || chr(57345) || chr(57346) || '<z' || chr(57347), '[\\x{{E000}}-\\x{{F8FF}}]+', '[코드]', 'g') AS fixed FROM {rows_sql('texts')}")
def pua_mask(spark, d):
    """Entities are resolved first, as they may stand for characters of private use."""
    return rows(spark, d, "texts").select("id", X.mask_private_use(html_unescape(F.concat("text", F.lit("\ue001\ue002&lt;z&#xE003;")))).alias("fixed"))


@query(f"SELECT id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(trim(x), '^-\\s*\\d+\\s*-$')), chr(10)) AS fixed FROM {rows_sql('texts')}")
def strip_footers(spark, d):
    return rows(spark, d, "texts").select("id", X.strip_footers(F.col("text")).alias("fixed"))


@query(f"SELECT id, array_to_string(list_transform(list_filter(cells, lambda r: len(list_filter(r, lambda x: x <> '')) > 0), lambda r: array_to_string(list_filter(r, lambda x: x <> ''), ' | ')), chr(10)) AS flat FROM {rows_sql('tables')}")
def table_flatten(spark, d):
    return rows(spark, d, "tables").select("id", X.table_flatten(F.col("cells")).alias("flat"))


@query(f"""WITH p AS (SELECT *, string_split(replace(text, '<그림>', '그림'), '<표>') AS parts, replace(replace(text, '<그림>', '그림'), '<표>', '') AS baseline FROM {rows_sql('marked')}), n AS (SELECT *, len(parts) - 1 AS k FROM p)
SELECT id, CASE WHEN k = 0 THEN baseline WHEN k = len(tables) THEN parts[1] || array_to_string(list_transform(range(1, k + 1), lambda i: chr(10) || tables[i] || chr(10) || parts[i + 1]), '') ELSE baseline END AS merged,
  baseline, CAST(k AS INTEGER) AS n_markers, k = 0 OR k = len(tables) AS ok FROM n""")
def marker_merge(spark, d):
    return rows(spark, d, "marked").select("id", X.merge_markers(F.col("text"), F.col("tables")).alias("m")).select("id", "m.*")


@query()
def reembed_list(spark, d):
    return changed_texts(damaged(spark, d), F.col("text"), full_fix_column(F.col("text")))
