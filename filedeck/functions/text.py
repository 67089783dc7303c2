"""Text as Column expressions: everything here stays in the JVM.

A null text gives a null result unless a function says otherwise; an empty text is an ordinary text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Particles a Korean token may end in, markup names that are real tags, cell tags,
# statement keywords, metric labels and numbers as filings write them.
PARTICLES = "으로부터 에서부터 이라면 까지 부터 에서 으로 이며 이나 와 과 의 은 는 이 가 을 를 에 로 도 만 나 며".split()
TAGS = """TD TE TR COL TH P TBODY TABLE COLGROUP TU THEAD SPAN PGBRK TITLE TABLE-GROUP SECTION-1 SECTION-2 SECTION-3 LIBRARY EXTRACTION
A IMAGE IMG IMG-CAPTION DOCUMENT DOCUMENT-NAME FORMULA-VERSION COMPANY-NAME SUMMARY BODY COVER COVER-TITLE CORRECTION""".split()
STATEMENTS = ("재무제표", "재무상태표", "손익계산서")
CONSOLIDATED = "연결"
METRICS = {"매출액": False, "영업이익": True, "당기순이익": True}  # whether a value may be in brackets, that is negative
TOKEN = "[0-9A-Za-z가-힣]+"
NUMBER = r"[\d,]{4,}"
PERIOD = r"\d{4}\s*년|제\s*\d+\s*\(?기"
INPUT_CHARS = 4000


def strip(c: Column) -> Column:
    """Without Unicode blanks at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Runs of ASCII letters, digits and Hangul syllables, case kept."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def strip_particle(token: Column) -> Column:
    """Without its longest particle that leaves at least two characters; one particle at most."""
    ends = "|".join(sorted(PARTICLES, key=len, reverse=True))
    ends_in_hangul = F.substring(token, -1, 1) >= "가"  # spares numbers and Latin words the pattern
    return F.when(ends_in_hangul, F.regexp_replace(token, f"^(.{{2,}}?)(?:{ends})$", "$1")).otherwise(token)


def terms(text: Column) -> Column:
    """The tokens of a text without particles."""
    return F.transform(tokens(text), strip_particle)


def path_text(path: Column) -> Column:
    return F.array_join(path, " > ")


def embedding_input(corp: Column, path: Column, text: Column, most: int = INPUT_CHARS) -> Column:
    """"[corp] a > b\\ntext", no blank after the name where the path is empty, cut to `most` characters in all.
    A null path counts as empty."""
    return F.substring(rerank_input(corp, path, text), 1, most)


def rerank_input(corp: Column, path: Column, text: Column) -> Column:
    """embedding_input without the cut."""
    tail = F.when(F.size(path) > 0, F.concat(F.lit(" "), path_text(path))).otherwise("")
    return F.concat(F.lit("["), corp, F.lit("]"), tail, F.lit("\n"), text)


def lexical_input(corp: Column, path: Column, text: Column) -> Column:
    """The same for word search: the blank after the name stays where the path is empty."""
    return F.concat(F.lit("["), corp, F.lit("] "), F.coalesce(path_text(path), F.lit("")), F.lit("\n"), text)


def label(cell: Column) -> Column:
    """A row label without a leading number and its stop, and without any blank."""
    return F.regexp_replace(F.regexp_replace(cell, r"(?U)^[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩIVX0-9]*[.)]?\s*", ""), r"(?U)\s+", "")


def cells(row: Column) -> Column:
    """The stripped cells of a table row."""
    return F.transform(F.split(row, "[|]", -1), strip)


def rows(text: Column) -> Column:
    """The lines of a text that hold a cell border."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.contains("|"))


def value_of(text: Column, metric: str, negative: bool) -> Column:
    """The first value in the row of a metric: the row's label is the metric, alone or before a bracket; the value
    is the first later cell that is a number of four or more digits and commas; bracketed numbers are
    skipped unless `negative`. The next such row is tried if one has no value; null without any."""
    ok = r"^\(?-?[\d,]{4,}\)?$" if negative else r"^-?[\d,]{4,}\)?$"
    named = F.filter(F.transform(rows(text), cells), lambda r: label(F.get(r, F.lit(0))).rlike(rf"^{metric}(\(|$)"))
    values = F.transform(named, lambda r: F.get(F.filter(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), lambda c: c.rlike(ok)), F.lit(0)))
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def statement_basis(path: Column) -> Column:
    """'연결' for consolidated statements, '별도' for other statements, null for other sections."""
    flat = F.regexp_replace(F.array_join(path, ""), r"(?U)\s+", "")
    other = F.lit(False)
    for word in STATEMENTS:
        other = other | flat.contains(word)
    return F.when(flat.contains(CONSOLIDATED), CONSOLIDATED).when(other, "별도")


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def grounded(answer: Column, context: Column) -> Column:
    """Whether the answer names no number, or at least one that the context holds. Nulls count as empty."""
    found = numbers(F.coalesce(answer, F.lit("")))
    return (F.size(found) == 0) | F.exists(found, lambda n: F.coalesce(context, F.lit("")).contains(n))


def escape_ampersands(markup: Column) -> Column:
    """Every & that starts none of XML's own references becomes &amp;."""
    return F.regexp_replace(markup, r"&(?!amp;|lt;|gt;|quot;|apos;|#\d+;|#x[0-9a-fA-F]+;)", "&amp;")


def sanitize_markup(markup: Column, tags: list[str] | None = None) -> Column:
    """Well-formed enough to parse: bare ampersands escaped, and every < that opens no known tag made text."""
    names = "|".join(sorted(tags or TAGS, key=len, reverse=True))
    return F.regexp_replace(escape_ampersands(markup), rf"<(?![/!?]|(?i:{names})(?![A-Za-z0-9_-]))", "&lt;")


def error_fields(body: Column) -> Column:
    """Status and message of an XML error body; "unknown" and the first 200 characters where they are absent."""
    status, message = F.regexp_extract(body, "<status>(.*?)</status>", 1), F.regexp_extract(body, "<message>(.*?)</message>", 1)
    return F.struct(F.when(status != "", status).otherwise("unknown").alias("status"), F.when(message != "", message).otherwise(F.substring(body, 1, 200)).alias("message"))


def highlight_numbers(text: Column, before: str = "<b>", after: str = "</b>") -> Column:
    """The text escaped for HTML with its longer numbers marked."""
    safe = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    return F.regexp_replace(safe, f"({NUMBER})", f"{before}$1{after}")


def preview(text: Column, n: int = 150) -> Column:
    return F.substring(text, 1, n)
