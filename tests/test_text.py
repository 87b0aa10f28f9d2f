"""Golden cases for text repair, previews, chunks and similarity."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.functions import udfs as V


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize(
    "f, before, after",
    [
        (X.dedup_chars, "감감사사 결결과과", "감사 결과"),
        (X.dedup_chars, "가 나", "가 나"),
        (X.dedup_chars, "감감 보고", "감감 보고"),
        (X.dedup_digits, "22002244년", "2024년"),
        (X.dedup_digits, "0000년", "0000년"),
        (X.dedup_brackets, "「「법」」", "「법」"),
        (X.title_colon, "제목 장애인", "제목 : 장애인"),
        (X.title_colon, "제목 : 장애인", "제목 : 장애인"),
        (X.title_colon, "제 목  : X", "제 목 :  : X"),
        (X.mask_glyphs, "○○ 부서 ● 과", "[부서] 부서 ● 과"),
        (X.strip_placeholder, "가\n표\n\n\n\n나", "가\n\n나"),
        (X.strip_footers, "- 1 -\n본문", "본문"),
        (X.title_number, "제목: 첫째\n\n2. 둘째", "1. 제목: 첫째\n\n2. 둘째"),
        (X.title_number, "제목: 첫째\n\n\n2. 둘째", None),
        (X.title_number, "1. 제목\n2. 둘째", None),
        (V.strip_markup, 'hp:run charPrIDRef="1" 본문', "본문"),
        (V.strip_markup, "그냥  본문 ", "그냥  본문 "),
        (X.dedup_chars, None, None),
        (X.extract_title, None, None),
    ],
)
def test_repairs(spark, f, before, after):
    assert one(spark, before, f) == after


def test_preview():
    assert V.preview_text("끝. 새 문장") == "…새 문장"
    assert V.preview_text("가" * 300) == "가" * 200 + "…"
    assert V.preview_text("가" * 150 + ". " + "나" * 200) == "가" * 150 + ".…"
    assert V.preview_text("2024. 1. 5 보고") == "2024. 1. 5 보고"
    assert V.preview_text("") == ""


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!\n。", max_size=9000))
def test_chunks_keep_all_characters(text):
    out = V.chunk_text(text)
    assert all(0 < len(c) <= V.MOST for c in out)
    assert "".join("".join(out).split()) == "".join(text.split())


def test_chunk_sizes():
    assert V.chunk_text("") == [] and V.chunk_text(" \n ") == []
    assert V.chunk_text("a" * 700 + "\n\n" + "b" * 700) == ["a" * 700, "b" * 700]
    assert V.chunk_text("a" * 600 + "\n\n" + "b" * 700) == ["a" * 600 + "\n\n" + "b" * 700]
    assert [len(c) for c in V.chunk_text("x" * 7000)] == [3000, 3000, 1000]
