"""Golden cases for lines, blocks and tables."""

from foliant.operators import markup as M
from foliant.operators import structure as S


LINES = [
        ("", "blank"), ("가. 목적", "heading"), ("1. 업무개요", "heading"), ("Ⅰ. 개요", "heading"), ("IV 개요는 아님", "body"), ("[표 1] 현황", "heading"), ("(단위: 원)", "heading"),
        ("소관부서 : 총무팀", "field"), ("소관부서 :", "body"), ("자료: 제출자료", "caption"), ("ABC_DEF_0123456789_XYZ", "caption"), ("(cid:1)(cid:2)", "caption"), ("- 항목", "bullet"), ("q 항목", "bullet"), ("q item", "body"),
        ("C - 김씨", "bullet"), ("1. " + "가" * 30, "body"), ("1. 「법」 제3조에 따른 " + "가" * 20, "heading"), ("본문", "body"),
        ("소관부서 : 총무팀 (1) 과", "field"), ("조치기한 ", "body"), ("[시정] 조치", "heading"), ("[시정조치]", "heading"), ("3) 「법」 제3조(정의) '인용문'", "heading"), ("3) 규칙 '인용문' 그리고 매우 긴 설명이 뒤따른다", "body"),
]


def test_classes(spark):
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(LINES)], "doc_id long, text string")
    assert [r.kind for r in S.line_classes(rows).orderBy("doc_id").collect()] == [k for _, k in LINES]
    fields = {r.doc_id: (r.label, r.value) for r in S.field_labels(rows).collect()}
    assert fields == {i: {"소관부서 : 총무팀": ("소관부서", "총무팀"), "소관부서 : 총무팀 (1) 과": ("소관부서", "총무팀 (1) 과")}[x] for i, (x, k) in enumerate(LINES) if k == "field"}


FLAT = "- 가" + " □ 세부 사항을 적은 긴 내용이 이어진다" * 30
BLOCKS = {
    # footnotes take in lines of lists
    "규정1)을 지킨다.\n1) 취업규칙 제5조\n5. 항목": [("body", "규정1)을 지킨다."), ("footnote", "1) 취업규칙 제5조 5. 항목")],
    # a definition that goes on with a list is a heading
    "본문\n3) 업무\n4) 근거4)": [("body", "본문"), ("heading", "3) 업무"), ("heading", "4) 근거4)")],
    # citations and labels are split
    "3) 「법」 제3조(정의) '인용문'": [("heading", "3) 「법」 제3조(정의)"), ("body", "'인용문'")],
    "[통보] 조치할 것": [("heading", "[통보]"), ("body", "조치할 것")],
    "붙임 : 1. 문답서\n2. 확인서": [("heading", "붙임"), ("body", "1. 문답서 2. 확인서")],
    "붙임 :\n문답서\n2. 확인서\n\n3. 끝": [("heading", "붙임"), ("body", "문답서 2. 확인서"), ("heading", "3. 끝")],
    # the list of attachments may begin below its heading
    "본문\n붙임 :\n1. 문답서\n2. 확인서": [("body", "본문"), ("heading", "붙임"), ("body", "1. 문답서 2. 확인서")],
    "붙임 :\n\n1. 문답서\n2. 확인서": [("heading", "붙임"), ("heading", "1. 문답서"), ("heading", "2. 확인서")],
    # tables keep their lines
    "[표 1] 현황\n하나 1\n(단위)\n둘 2": [("heading", "[표 1] 현황"), ("table", "하나 1\n(단위)\n둘 2")],
    # titles, masks, glyphs, ornaments
    "제목: 휴가\n2. 개요": [("heading", "1. 제목: 휴가"), ("heading", "2. 개요")],
    "소관부서 : 총무팀": [("field", ("소관부서", "총무팀"))],
    "[부서] 직원": [("body", "○○○ 직원")],
    "□\n혼자": [("bullet", "□ 혼자")],
    "끝\n□\n\n-": [("body", "끝 □"), ("body", "-")],
    "m 하위": [("bullet", "○ 하위")],
    "a\n◤◢\nb": [("body", "a"), ("body", "b")],
    FLAT: [("table", FLAT)],
    "": [],
}
REASONS = {
    "위임2) 사항": ["footnotes: 1 references, definition missing"], "(통보1) 사항": [], "본문 " * 600: ["no heading in 1800"], "": [],
    "규정1)을 지킨다.\n1) 취업규칙 제5조 " + "가" * 600: ["long footnote: 1, up to 612"], "가3) 본문\n\n3) 「법」 제3조(정의) '인용'": [], "- " + "가" * 900: ["long bullet: 1, up to 902"],
}


def test_blocks(spark):
    texts, got = list(BLOCKS), {i: [] for i in range(len(BLOCKS))}
    for r in S.blocks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id", "pos").collect():
        assert r.pos == len(got[r.doc_id])
        got[r.doc_id].append((r.type, r.text if r.type != "field" else (r.label, r.value)))
    assert {texts[i]: x for i, x in got.items()} == BLOCKS


def test_anomalies(spark):
    texts = list(REASONS)
    got = {r.doc_id: r.reasons for r in S.render_anomalies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {t: got.get(i, []) for i, t in enumerate(texts)} == REASONS


def test_blocks_of_many_documents_and_of_none(spark):
    rows = spark.createDataFrame([(1, "가. 목적\n본문"), (2, None), (3, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.pos, r.type) for r in S.blocks(rows).collect()) == [(1, 0, "heading"), (1, 1, "body")]
    assert S.blocks(rows.limit(0)).count() == 0


def test_tables(spark):
    pages = [
        "<table><tr><th>a</th><td> b \n c </td></tr><tr><td>x<table><tr><td>in</td></tr></table></td></tr></table>",
        "<td>outside</td>", None, "<table><tr><td>open", "</table><TABLE class='x'><tr><td>a<b>b</b>&amp;<!-- no --> c</td><td></td></tr><tr></tr></table>t<table></table>",
    ]
    got = M.html_tables(spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")).collect()
    assert {(r.page_id, r.n): r.cells for r in got} == {(0, 0): [["a", "b c"], ["in"]], (4, 0): [["ab& c", ""], []], (4, 1): []}
    assert M.html_tables(spark.createDataFrame([], "page_id int, html string")).count() == 0 and dict(M.html_tables(spark.createDataFrame([(1, "")], "page_id int, html string")).dtypes)["n"] == "int"
