"""Text and table functions against fixtures and small Python models."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filedeck.functions import tables as tb
from filedeck.functions import text as tx
from filedeck.functions.vectors import cosine


def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'string'}" for n, v in values.items())
    return spark.createDataFrame([tuple(values[n] for n in names)], schema).select(column).first()[0]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("<P>Data & Solution</P>", "<P>Data &amp; Solution</P>"),
        ("A &amp; B, 3 &lt; 5", "A &amp; B, 3 &lt; 5"),
        ("a &nbsp; b &#45; c &#x2d;", "a &amp;nbsp; b &#45; c &#x2d;"),
        ("<SPAN><주요자회사></SPAN>", "<SPAN>&lt;주요자회사></SPAN>"),
        ("<Wholesale 부문>", "&lt;Wholesale 부문>"),
        ("<table><TDX>", "<table>&lt;TDX>"),
        ("a<", "a&lt;"),
        ("", ""),
    ],
)
def test_sanitize(spark, raw, clean):
    assert one(spark, tx.sanitize_markup(F.col("t")), t=raw) == clean


def test_sanitize_is_linear(spark):
    assert one(spark, F.length(tx.sanitize_markup(F.col("t"))), t="<" * 40_000) == 160_000


@pytest.mark.parametrize(("token", "stem"), [("매출액은", "매출액"), ("회사로부터", "회사로"), ("서울에서부터", "서울"), ("나는", "나는"), ("은", "은"), ("2024년은", "2024년"), ("ABC", "ABC")])
def test_particles(spark, token, stem):
    """Longest first, one particle, two characters stay; '로부터' itself is no particle, '부터' is."""
    assert one(spark, tx.strip_particle(F.col("t")), t=token) == stem


def test_inputs(spark):
    both = F.struct(tx.embedding_input(F.lit("회사"), F.col("p"), F.col("t")), tx.lexical_input(F.lit("회사"), F.col("p"), F.col("t")))
    assert tuple(one(spark, both, p=["a", "b"], t="x")) == ("[회사] a > b\nx", "[회사] a > b\nx")
    assert tuple(one(spark, both, p=[], t="x")) == ("[회사]\nx", "[회사] \nx")
    assert len(one(spark, tx.embedding_input(F.lit("회사"), F.col("p"), F.col("t")), p=["a"], t="가" * 5000)) == 4000


@pytest.mark.parametrize(
    ("text", "metric", "negative", "value"),
    [
        ("구분 | 2024\n매출액 | 1,234,567", "매출액", False, "1,234,567"),
        ("Ⅰ. 매 출 액 (주석 3) | - | 12,345", "매출액", False, "12,345"),
        ("매출액 | (5,000) | 7,000", "매출액", False, "7,000"),
        ("영업이익 | (5,000) | 7,000", "영업이익", True, "(5,000)"),
        ("매출액총계 | 9,999", "매출액", False, None),
        ("매출액 | 12\n매출액 | 4,321", "매출액", False, "4,321"),
        ("매출액 4,321", "매출액", False, None),
    ],
)
def test_value_of(spark, text, metric, negative, value):
    assert one(spark, tx.value_of(F.col("t"), metric, negative), t=text) == value


def test_basis_and_grounding(spark):
    assert [one(spark, tx.statement_basis(F.col("p")), p=p) for p in (["Ⅲ", "2. 연 결 재무제표"], ["재무 상태표"], ["회사 소개"], [])] == ["연결", "별도", None, None]
    assert one(spark, tx.grounded(F.col("a"), F.col("c")), a="12,345원과 99,999원", c="x 99,999") is True
    assert one(spark, tx.grounded(F.col("a"), F.col("c")), a="12,345원", c="x") is False
    assert one(spark, tx.grounded(F.col("a"), F.col("c")), a=None, c=None) is True


def test_errors_and_marks(spark):
    assert tuple(one(spark, tx.error_fields(F.col("t")), t="<r><status>014</status><message>none</message></r>")) == ("014", "none")
    assert tuple(one(spark, tx.error_fields(F.col("t")), t="x" * 300)) == ("unknown", "x" * 200)
    assert one(spark, tx.highlight_numbers(F.col("t")), t="<a> 1,234 & 12") == "&lt;a&gt; <b>1,234</b> &amp; 12"


def split_model(text, most):
    if len(text) <= most:
        return [text]
    header, *rows = text.split("\n")
    parts, now = [], None
    for row in rows:
        if now is not None and len(now) + 1 + len(row) > most:
            parts.append(now)
            now = None
        now = f"{header if now is None else now}\n{row}"
    return parts + ([now] if now is not None else [])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("ab| ", min_size=0, max_size=12), min_size=1, max_size=12), st.integers(1, 40))
def test_split_table(spark, rows, most):
    text = "\n".join(rows)
    assert one(spark, tb.split_table(F.col("t"), most), t=text) == split_model(text, most)


def test_split_table_edges(spark):
    assert one(spark, tb.split_table(F.col("t"), 10), t="x" * 20) == []
    assert one(spark, tb.split_table(F.col("t"), 10, True), t="x" * 20) == ["x" * 20]
    assert one(spark, tb.split_table(F.col("t")), t=None) is None
    long = "head | a\n" + "\n".join(f"row {i} | {i}" for i in range(2000))
    parts = one(spark, tb.split_table(F.col("t"), 1500), t=long)
    assert all(p.startswith("head | a\n") and len(p) <= 1500 for p in parts)
    assert [r for p in parts for r in p.split("\n")[1:]] == long.split("\n")[1:]


@pytest.mark.parametrize(
    ("text", "out"),
    [
        ("과목 | 제57기\n | 2025년 12월말\n매출액 | 1,000", "매출액: 제57기 2025년 12월말=1,000"),
        ("과목 | 당기\n제 57 기 | 5", "제 57 기 | 5"),
        ("a | b | c\nx | 1 |", "x: b=1"),
        ("그냥 글", "그냥 글"),
        ("a | b", "a | b"),
        ("단위: 원\na | b\nx | 1\n주석", "단위: 원\nx: b=1"),
        ("a | b\nx | ", "x | "),
        ("단위: 원\na | b\n | c", "단위: 원"),
        ("a | b\n | c", ""),
    ],
)
def test_reformat(spark, text, out):
    assert one(spark, tb.reformat_table(F.col("t")), t=text) == out


def test_cosine_nulls(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0])], "a array<float>, b array<float>").select(cosine(F.col("a"), F.col("b"))).collect()
    assert [round(r[0], 6) if r[0] is not None else None for r in rows] == [0.707107, None, None]


def test_tokens_split_numbers(spark):
    assert one(spark, tx.terms(F.col("t")), t="매출액은 1,234원 ABC") == [re.sub("은$", "", "매출액은"), "1", "234원", "ABC"]
