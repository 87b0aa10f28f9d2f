"""Text expressions: titles, sources, repair, masks, quality tests. Every function takes and returns Columns.

Patterns carry (?U) where the input may hold white space beyond ASCII, as Java's classes are ASCII otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: labels, word lists and patterns whose results must agree with the reference's ---

HANGUL = "가-힣"
CHAR_CHAIN = rf"(?:([{HANGUL}])\1{{1,3}} ?){{2,}}"
CHAR_REPEAT = rf"([{HANGUL}])\1+"
DIGIT_CHAIN = r"(?:(\d)\1{1,3} ?){2,}"
DIGIT_REPEAT = r"(\d)\1+"
BRACKETS = "「」『』｢｣【】〔〕"
MASK_GLYPHS = "○◎□●■☆★△▲▽▼◇◆"
DEPARTMENT = "[부서]"
CODE = "[코드]"
PRIVATE_USE = r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]+"
PLACEHOLDER = "표"
TITLE_LINE = r"(?U)^\s*제\s*목(?:\s*[:：]\s*|\s+)(.+?)\s*\z"
TITLE_LABEL = r"(?U)^(제\s*목)\s+(?![:：])"
SOURCE_EXTENSION = r"(?i)\.(pdf|hwp|hwpx|doc|docx)\z"
SOURCE_YEAR = r"(?U)^(\d{4})년\s*(.*)\z"
SERIAL = r"(?U)[(（]\d+[)）]\s*\z"
TIER = r"^(.*?)_split(\d+)of(\d+)\z"
END_CLOSED = r"""[.!?。」』"')\]】>]\s*\z"""
END_OPEN = r"(및|에|은|는|이|가|을|를|로|와|과|의|하고|하며|또는|그리고)\s*\z"
DISPOSITIONS = "주의 경고 시정 견책 해임 파면 강등 정직 감봉 훈계 통보 권고 불가 효과 개선 증가 결과 협의 건의 완료".split()
LEADING_PARTICLES = "도 은 는 이 가 을 를 의 에 로 와 과 만 나 다 고 며 서 니 면 야 요".split()
LINE_CLOSED = r"[.!?。:：)\]】」』]\z"
TITLE_WITHOUT_NUMBER = r"(?U)^[\[【]?제\s*목\s*[\]】]?\s*[:：]?\s*\S"
NUMBERED_LINE = r"(?U)^(\d{1,2})[.)]\s+\S"
INTERLEAVED = r"연번[\s\n]*지적사항[\s\n]*처분"
TEMPLATE_MARKERS = ["연번 지적사항 처분", "연번\n지적사항\n처분"]
TAG_FAMILIES = {
    "runs": "hp:run|hp:linesegarray",
    "shapes": r"hc:\w+",
    "positions": "textpos=|vertpos=",
    "links": "linkListNextIDRef=",
    "outline": "outlineS",
}
STOPWORDS = (
    "이 가 은 는 을 를 의 에 에서 으로 로 와 과 도 만 까지 부터 이나 나 이란 란 이랑 랑 보다 처럼 "
    "때 때는 때가 때문 때문에 그 저 이런 저런 그런 어떻게 어케 했을 하다 합니다 했다 된다 됨 되나요 인가요 무엇 뭐 어디 언제 어떤 및 등 관련 경우"
).split()
FALLBACK_PHRASES = ["지적사항 불분명", "원인 미기재", "조치사항 미기재", "처리결과 미기재"]
CONFIDENT, PARTLY = "신뢰도 높음", "일부 참고"
UNTITLED, NOT_GIVEN = "사례", "미기재"
SUMMARY_LABELS = {"point": "지적사항", "cause": "원인", "action": "조치", "result": "결과"}
EMBEDDED_BULLET = r"(?U)\s[-–—□○◦▪‣·❍※•*①②③④⑤⑥⑦⑧⑨⑩]\s"

# --- small pieces --------------------------------------------------------------------------------------------------


#: White space as Unicode has it, and as (?U)\\s does.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at both ends, also beyond ASCII."""
    return F.btrim(c, F.lit(WHITE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE))


def squeezed(c: Column) -> Column:
    return F.translate(c, WHITE, "")


def bound(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that are computed once a row, however often what follows reads them: they come out of a generator, into which the optimizer copies nothing."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def filled_lines(c: Column) -> Column:
    return F.filter(lines(strip(c)), lambda x: strip(x) != "")


def none_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def any_of(words: list[str], test) -> Column:
    return reduce(lambda a, b: a | b, [test(w) for w in words])


# --- titles, sources, keys -----------------------------------------------------------------------------------------


def extract_title(raw: Column) -> Column:
    return none_if_empty(strip(F.regexp_extract(F.element_at(lines(raw), 1), TITLE_LINE, 1)))


def _quoted(segment: Column) -> Column:
    """Percent-encoding in which only letters, digits and _.-~ stand for themselves."""
    out = F.url_encode(segment)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def source_url(source: Column, base: str, prefix: str = "data_repo/") -> Column:
    path = strip(source)
    path = F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)
    path = F.regexp_replace(path, "^/+|/+$", "")
    return F.when(path != "", F.concat(F.lit(base), F.array_join(F.transform(F.split(path, "/"), _quoted), "/")))


def parse_source(source: Column) -> Column:
    """struct<institution, year, audit_type> of a file name ``institution_2016년 type(27).ext``."""
    name = F.regexp_replace(F.element_at(F.split(strip(source), "/"), -1), SOURCE_EXTENSION, "")
    has, at = name.contains("_"), F.instr(name, "_")
    rest = strip(F.substr(name, at + 1))
    year = F.regexp_extract(rest, SOURCE_YEAR, 1)
    kind = strip(F.regexp_replace(F.regexp_extract(rest, SOURCE_YEAR, 2), SERIAL, ""))
    given = F.when(F.coalesce(source, F.lit("")) != "", True)
    return F.struct(
        F.when(given, none_if_empty(strip(F.when(has, F.left(name, at - 1)).otherwise(name)))).alias("institution"),
        F.when(given & has, year.try_cast("int")).alias("year"),
        F.when(given & has & (year != ""), none_if_empty(kind)).alias("audit_type"),
    )


def parse_tier(tier: Column) -> Column:
    """struct<base, idx, total>; idx and total are null where the tier is no part of a split."""
    part = F.regexp_extract(tier, TIER, 2)
    return F.struct(
        F.when(part != "", F.regexp_extract(tier, TIER, 1)).otherwise(tier).alias("base"),
        F.when(part != "", part).cast("int").alias("idx"),
        F.when(part != "", F.regexp_extract(tier, TIER, 3)).cast("int").alias("total"),
    )


def nul_strip(c: Column) -> Column:
    return F.replace(c, F.lit("\0"), F.lit(""))


def safe_year(c: Column) -> Column:
    return c.try_cast("int")


def chunk_id(doc: Column, index: Column, text: Column) -> Column:
    seed = F.concat_ws("_", doc.cast("string"), index.cast("string"), F.substring(text, 1, 30))
    return F.concat_ws("_", doc.cast("string"), F.substring(F.md5(seed), 1, 8))


def case_slug(institution: Column, year: Column, title: Column, most: int = 100) -> Column:
    given = lambda c: F.when(strip(c) != "", c)
    number = F.when(year != 0, year.cast("string"))
    out = strip(F.concat_ws(" ", given(institution), number, given(title)))
    for pattern, by in ((r"(?U)\s+", "-"), (r"[/\\?#%]", "-"), ("-+", "-"), ("^-|-$", "")):
        out = F.regexp_replace(out, pattern, by)
    out = F.substring(out, 1, most)
    return F.when(out != "", out).otherwise(UNTITLED)


def case_path(doc: Column, slug: Column) -> Column:
    kept = lambda c: reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), [("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%2A", "*")], _quoted(c))
    return F.concat(F.lit("/cases/"), kept(doc.cast("string")), F.lit("/"), kept(slug))


# --- repair --------------------------------------------------------------------------------------------------------


def _within(c: Column, chain: str, change) -> Column:
    """The text with ``change`` applied to each match of ``chain``: what lies between the matches, and the matches, in turn.

    The text is bound to a variable, so that it is computed once however deep passes are nested.
    """

    def rewritten(x: Column) -> Column:
        between, found = F.split(x, chain, -1), F.regexp_extract_all(x, F.lit(chain), F.lit(0))
        joined = F.array_join(F.zip_with(between, F.transform(found, change), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        return F.when(x.rlike(chain), joined).otherwise(x)

    return F.get(F.transform(F.array(c), rewritten), F.lit(0))


def _passes(c: Column, chain: str, change, passes: int) -> Column:
    """:func:`_within` again and again. Texts without any match, most of them, are tested once and left alone."""

    def nested(x: Column) -> Column:
        for _ in range(passes):
            x = _within(x, chain, change)
        return x

    return F.get(F.transform(F.array(c), lambda x: F.when(x.rlike(chain), nested(x)).otherwise(x)), F.lit(0))


def dedup_chars(c: Column, passes: int = 5) -> Column:
    """Runs of doubled Hangul syllables, once each; repeated until nothing changes, five times at most."""
    return _passes(c, CHAR_CHAIN, lambda m: F.regexp_replace(m, CHAR_REPEAT, "$1"), passes)


def dedup_digits(c: Column, passes: int = 5) -> Column:
    """Runs of doubled digits, once each; a run of one digit only is a mask and stays."""
    one_digit = lambda m: F.size(F.array_distinct(F.regexp_extract_all(m, F.lit(r"\d"), F.lit(0)))) < 2
    return _passes(c, DIGIT_CHAIN, lambda m: F.when(one_digit(m), m).otherwise(F.regexp_replace(m, DIGIT_REPEAT, "$1")), passes)


def dedup_brackets(c: Column) -> Column:
    return F.regexp_replace(c, f"([{BRACKETS}])\\1+", "$1")


def title_colon(c: Column) -> Column:
    return F.regexp_replace(c, TITLE_LABEL, "$1 : ")


def strip_placeholder(c: Column) -> Column:
    kept = F.array_join(F.filter(lines(c), lambda x: strip(x) != PLACEHOLDER), "\n")
    return strip(F.regexp_replace(kept, "\n{3,}", "\n\n"))


def mask_private_use(c: Column) -> Column:
    return F.regexp_replace(c, PRIVATE_USE, CODE)


def mask_glyphs(c: Column) -> Column:
    return F.regexp_replace(c, f"([{MASK_GLYPHS}])\\1+", DEPARTMENT)


def strip_footers(c: Column) -> Column:
    footer = r"-\s*\d+\s*-"  # most texts have none anywhere, and are not taken apart
    return F.when(c.rlike(f"(?U){footer}"), F.array_join(F.filter(lines(c), lambda x: ~strip(x).rlike(rf"(?U)^{footer}\z")), "\n")).otherwise(c)


def title_number(c: Column) -> Column:
    """The text with ``1. `` before an unnumbered title that a line numbered 2 or more follows; null where that is not so."""
    all_lines = lines(c)
    first = F.array_position(F.transform(F.slice(all_lines, 1, 5), lambda x: strip(x) != ""), True)
    title = strip(F.element_at(all_lines, F.when(first > 0, first).otherwise(1).cast("int")))
    after = F.filter(F.slice(all_lines, (first + 1).cast("int"), 2), lambda x: strip(x) != "")
    number = F.regexp_extract(strip(F.get(after, F.lit(0))), NUMBERED_LINE, 1)
    lost = (first > 0) & title.rlike(TITLE_WITHOUT_NUMBER) & ~title.rlike(NUMBERED_LINE) & (F.coalesce(number.try_cast("int"), F.lit(0)) >= 2)
    repaired = F.transform(all_lines, lambda x, i: F.when(i + 1 == first, F.concat(F.lit("1. "), strip(x))).otherwise(x))
    return F.when(lost, F.array_join(repaired, "\n"))


# --- quality tests -------------------------------------------------------------------------------------------------


def looks_truncated(c: Column) -> Column:
    last = strip(F.element_at(lines(rstrip(c)), -1))
    bare = squeezed(last)
    return last.rlike("(?U)" + END_OPEN) & ~last.rlike("(?U)" + END_CLOSED) & ~any_of(DISPOSITIONS, bare.endswith)


def unrecoverable_reason(text: Column, quality: Column) -> Column:
    return (
        F.when((F.length(text) < 50) & (quality != "fallback"), "short_non_fallback")
        .when(text.contains("�"), "encoding_broken")
        .when(F.length(strip_placeholder(text)) < 300, "table_placeholder_only")
    )


def word_breaks(c: Column) -> Column:
    """How many lines begin with a lone particle though the line before does not end a sentence."""
    own = F.transform(lines(c), strip)
    particle = f"(?U)^({'|'.join(LEADING_PARTICLES)})(\\s|\\z)"
    pairs = F.transform(own, lambda x, i: F.struct(x.alias("line"), F.when(i > 0, F.get(own, i - 1)).otherwise("").alias("before")))
    hit = lambda p: p["line"].rlike(particle) & (p["before"] != "") & ~p["before"].rlike(LINE_CLOSED)
    return F.size(F.filter(pairs, hit))


def has_table_trace(c: Column) -> Column:
    bars = F.length(c) - F.length(F.replace(c, F.lit("|"), F.lit("")))
    return c.contains("<표>") | c.contains("[표]") | (bars >= 3)


def flattened_table(c: Column) -> Column:
    return (F.length(c) >= 500) & (F.regexp_count(c, F.lit(EMBEDDED_BULLET)) >= 5)


def table_flatten(table: Column) -> Column:
    """array<array<string>> as lines of filled cells."""
    rows = F.filter(F.transform(table, lambda r: F.filter(r, lambda x: x != "")), lambda r: F.size(r) > 0)
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ")), "\n")


def merge_markers(text: Column, tables: Column) -> Column:
    """struct<merged, baseline, n_markers, ok>: tables put where their markers stand, if there are as many of both."""
    plain = F.replace(text, F.lit("<그림>"), F.lit("그림"))
    baseline = F.replace(plain, F.lit("<표>"), F.lit(""))
    parts = F.split(plain, "<표>", -1)
    n = F.size(parts) - 1
    tail = F.zip_with(tables, F.slice(parts, 2, F.greatest(n, F.lit(1))), lambda t, p: F.concat(F.lit("\n"), t, F.lit("\n"), p))
    ok = (n == 0) | (n == F.size(tables))
    merged = F.when(n == 0, plain).when(ok, F.concat(F.element_at(parts, 1), F.array_join(tail, ""))).otherwise(baseline)
    return F.struct(merged.alias("merged"), baseline.alias("baseline"), n.alias("n_markers"), ok.alias("ok"))


# --- search results ------------------------------------------------------------------------------------------------


def confidence_label(quality: Column) -> Column:
    return F.when(quality == "standard", CONFIDENT).otherwise(PARTLY)


def highlight_terms(query: Column) -> Column:
    """Distinct terms of two or more characters that are no stopwords, longest first, else in their order."""
    kept = F.array_distinct(F.filter(F.split(strip(query), r"(?U)\s+"), lambda t: (F.length(t) >= 2) & ~t.isin(STOPWORDS)))
    keyed = F.transform(kept, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t")))
    return F.transform(F.array_sort(keyed), lambda x: x["t"])


def highlight(text: Column, query: Column) -> Column:
    terms = highlight_terms(query)
    pattern = F.concat(F.lit("(?iu)("), F.array_join(F.transform(terms, lambda t: F.regexp_replace(t, r"[.*+?^${}()|\[\]\\]", r"\\$0")), "|"), F.lit(")"))
    return F.when(F.size(terms) == 0, text).otherwise(F.regexp_replace(text, pattern, F.lit("<mark>$1</mark>")))


def recent_searches(query: Column, earlier: Column, most: int = 5) -> Column:
    new = strip(query)
    return F.when(new == "", earlier).otherwise(F.slice(F.concat(F.array(new), F.filter(earlier, lambda x: x != new)), 1, most))


# --- summaries -----------------------------------------------------------------------------------------------------


def parse_summary(text: Column) -> Column:
    """struct<point, cause, action, result> of four filled lines; null for any other number."""
    own = filled_lines(text)
    fields = [F.get(own, F.lit(i)).alias(n) for i, n in enumerate(SUMMARY_LABELS)]
    return F.when(F.size(own) == 4, F.struct(*fields))


def all_fallback(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [any_of(FALLBACK_PHRASES, c.contains) for c in parts])


def summary_issue(text: Column) -> Column:
    n = F.size(filled_lines(text))
    return F.when(n != 4, F.concat(F.lit("줄 수 불일치: "), n.cast("string"), F.lit("줄 (4줄이어야 함)")))


def summary_copy(fields: dict[str, Column]) -> Column:
    value = lambda c: F.coalesce(none_if_empty(c), F.lit(NOT_GIVEN))
    return F.concat_ws("\n", *[F.concat(F.lit(f"{SUMMARY_LABELS[n]}: "), value(c)) for n, c in fields.items()])


# --- gates ---------------------------------------------------------------------------------------------------------


def accept_first(ratio: Column) -> Column:
    return F.when(ratio >= 0.90, "apply").otherwise("review")


def accept_second(ratio: Column, bag: Column, length_ratio: Column) -> Column:
    """struct<decision, reason>"""
    reorder = (bag >= 0.97) & length_ratio.between(0.95, 1.05)
    reason = F.when(ratio >= 0.90, "sequence").when(reorder, "reorder")
    return F.struct(F.when(reason.isNotNull(), "apply").otherwise("review").alias("decision"), reason.alias("reason"))


def accept_third(ratio: Column, old: Column, new: Column) -> Column:
    return F.when(old == new, "unchanged").when(ratio >= 0.90, "apply").otherwise("review")


def table_gate(merge_ok: Column, ratio: Column) -> Column:
    """Null to apply, else why not."""
    return F.when(~merge_ok, "marker_table_count_mismatch").when(ratio < 0.90, "low_similarity_after_merge")


def length_ratio(old: Column, new: Column) -> Column:
    """New by old length; 0 for texts that were empty."""
    return F.when(old > 0, new / old).otherwise(F.lit(0.0))
