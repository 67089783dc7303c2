"""Filing markup to blocks: sections, paragraphs and tables in reading order.

Markup is made parseable by built-in expressions (functions.text.sanitize_markup); only the walk over one
document's tree runs in Python, a document at a time, without a shuffle."""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filedeck.functions.text import sanitize_markup

# Cells of a table row.
CELLS = ("TD", "TE", "TU", "TH")
TAG = re.compile(r"<!--.*?-->|<[?!][^>]*>|<(?P<end>/?)(?P<name>[A-Za-z][\w.:-]*)[^<>]*?(?P<empty>/?)>", re.DOTALL)
SCHEMA = "doc string, ordinal int, section_path array<string>, type string, text string"


def _words(e: ET.Element, without: str = "", between: str = " ") -> str:
    """Stripped text pieces of an element joined by blanks; elements named `without` are left out."""
    out = []

    def walk(x: ET.Element):
        out.append(x.text)
        for c in x:
            if c.tag != without:
                walk(c)
            out.append(c.tail)

    walk(e)
    return between.join(t.strip() for t in out if t and t.strip())


def _own(table: ET.Element, tag: str):
    """Elements of a name whose nearest table is this one."""
    for c in table:
        if c.tag == tag:
            yield c
        elif c.tag != "TABLE":
            yield from _own(c, tag)


def _cell(cell: ET.Element) -> str:
    """A cell's words, then after a blank its tables at any depth as [row; row] joined by " / ". A table inside
    such a table stands in its own cell and once more by itself."""
    inner = " / ".join(f"[{table_text(t)}]".replace("\n", "; ") for t in cell.iter("TABLE"))
    return f"{_words(cell, 'TABLE')} {inner}".strip()


def table_text(table: ET.Element) -> str:
    """Cells joined by " | ", rows by line, rows without any text left out."""
    rows = ([_cell(c) for c in row if c.tag in CELLS] for row in _own(table, "TR"))
    return "\n".join(" | ".join(r) for r in rows if any(r))


def blocks(markup: str) -> list[tuple[list[str], str, str]]:
    """(section path, type, text) of a document.

    Elements named SECTION... add their first TITLE, its pieces joined by nothing, to the path; TABLE and P are blocks, empty ones left out; text
    outside them is dropped; names count with their case."""
    out: list[tuple[list[str], str, str]] = []

    def walk(e: ET.Element, path: list[str]):
        for c in e:
            if c.tag.startswith("SECTION"):
                title = next((_words(x, between="") for x in c if x.tag == "TITLE"), "")
                walk(c, [*path, title] if title else path)
            elif c.tag in ("TABLE", "P"):
                text = table_text(c) if c.tag == "TABLE" else _words(c)
                if text:
                    out.append((path, "table" if c.tag == "TABLE" else "paragraph", text))
            elif c.tag != "TITLE":
                walk(c, path)

    root = ET.Element("root")
    try:
        root.append(ET.fromstring(markup))
    except ET.ParseError:
        root = recovered(markup)
    walk(root, [])
    return out


def recovered(markup: str) -> ET.Element:
    """The tree of broken markup: an end tag closes its element and all open ones inside, one without a
    start is dropped, and the end of the text closes what is open."""
    made = ET.TreeBuilder()
    made.start("root", {})
    open_, at = ["root"], 0
    for m in TAG.finditer(markup):
        made.data(html.unescape(markup[at : m.start()]))
        at, name = m.end(), m["name"]
        if name and not m["end"]:
            made.start(name, {})
            if m["empty"]:
                made.end(name)
            else:
                open_.append(name)
        elif name in open_[1:]:
            while True:
                made.end(last := open_.pop())
                if last == name:
                    break
    made.data(html.unescape(markup[at:]))
    while open_:
        made.end(open_.pop())
    return made.close()


def _parse(frames):
    for f in frames:
        rows = []
        for doc, markup in zip(f["doc"], f["markup"]):
            rows += [(doc, n, path, kind, text) for n, (path, kind, text) in enumerate(blocks(markup))] if markup else []
        yield pd.DataFrame(rows, columns=["doc", "ordinal", "section_path", "type", "text"])


def parsed(documents: DataFrame, doc: Column, markup: Column) -> DataFrame:
    """(doc, ordinal, section_path, type, text): the blocks of each document in order.

    Broken markup gives the blocks that can be recovered; null and empty markup give none."""
    return documents.select(doc.cast("string").alias("doc"), sanitize_markup(markup).alias("markup")).mapInPandas(_parse, SCHEMA)


def whole_text(found: DataFrame) -> DataFrame:
    """(doc, text): a document's blocks, in order, with a blank line between."""
    part = found.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("b"))  # one document
    return part.select("doc", F.array_join(F.transform("b", lambda x: x["text"]), "\n\n").alias("text"))


def filing_blocks(parts: DataFrame) -> DataFrame:
    """parts (path, part_no, text) of archives -> as parsed, doc being the path: the blocks of all parts of an archive as
    one document, in the order of the parts, numbered through."""
    key = F.to_json(F.struct("path", "part_no"))
    found = parsed(parts.filter("text is not null"), key, F.col("text"))
    own = F.from_json("doc", "path string, part_no int")
    rows = found.select(own["path"].alias("doc"), own["part_no"].alias("part_no"), "ordinal", "section_path", "type", "text")
    number = F.row_number().over(Window.partitionBy("doc").orderBy("part_no", "ordinal")) - 1
    return rows.select("doc", number.alias("ordinal"), "section_path", "type", "text")


def as_markup(path: Column, kind: Column, text: Column) -> Column:
    """One block as markup that parses back to it: nested sections around a P or a TABLE."""
    safe = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    rows = F.transform(F.split(safe, "\n", -1), lambda r: F.concat(F.lit("<TR><TD>"), F.array_join(F.split(r, r" \| ", -1), "</TD><TD>"), F.lit("</TD></TR>")))
    body = F.when(kind == "table", F.concat(F.lit("<TABLE>"), F.array_join(rows, ""), F.lit("</TABLE>"))).otherwise(F.concat(F.lit("<P>"), safe, F.lit("</P>")))
    escaped = F.transform(path, lambda p: F.replace(F.replace(p, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")))
    opened = F.array_join(F.transform(escaped, lambda p: F.concat(F.lit("<SECTION-1><TITLE>"), p, F.lit("</TITLE>"))), "")
    return F.concat(F.lit("<DOCUMENT>"), opened, body, F.repeat(F.lit("</SECTION-1>"), F.size(path)), F.lit("</DOCUMENT>"))


def nested_markup(name: Column, text: Column) -> Column:
    """Markup with a section in a section: the text's first line as a P, and its lines as the rows of a table in a table's cell.
    A title in pieces, a P that is never closed and a stray end tag are part of it."""
    safe = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    lines = F.split(safe, "\n", -1)
    rows = F.array_join(F.transform(lines, lambda r: F.concat(F.lit("<TR><TD>"), r, F.lit("</TD></TR>"))), "")
    head = F.concat(F.lit("<DOCUMENT><SECTION-1><TITLE>Ⅰ.<SPAN>"), F.coalesce(name, F.lit("")), F.lit("</SPAN></TITLE><P>"), F.get(lines, F.lit(0)), F.lit("</P></B>"))
    inner = F.concat(F.lit("<SECTION-2><TITLE>표</TITLE><TABLE><TR><TD>내용<TABLE>"), rows, F.lit("</TABLE></TD><TD>끝</TD></TR></TABLE></SECTION-2></SECTION-1>"))
    return F.concat(head, inner, F.lit("<P>"), F.size(lines).cast("string"))
