"""Table texts (cells by "|", rows by line) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filedeck.functions.text import PERIOD, cells, strip

TABLE_CHARS = 1500


def split_table(text: Column, most: int = TABLE_CHARS, keep_oversized: bool = False) -> Column:
    """Parts of a table of at most `most` characters, each starting with the header row.

    A text within the limit is one part. A row that does not fit beside the header stands alone with it. A
    longer table of a header alone gives no part, or itself with `keep_oversized`. Null gives null."""
    lines = F.split(text, "\n", -1)
    header, body = F.get(lines, F.lit(0)), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("n"))

    def step(s: Column, row: Column) -> Column:
        size = F.length(header) + s["n"] + 1 + F.length(row)
        begin = F.struct(s["done"].alias("done"), F.concat(header, F.lit("\n"), row).alias("open"), (1 + F.length(row)).alias("n"))
        close = F.struct(F.concat(s["done"], F.array(s["open"])).alias("done"), F.concat(header, F.lit("\n"), row).alias("open"), (1 + F.length(row)).alias("n"))
        grow = F.struct(s["done"].alias("done"), F.concat(s["open"], F.lit("\n"), row).alias("open"), (s["n"] + 1 + F.length(row)).alias("n"))
        return F.when(s["open"].isNull(), begin).when(size > most, close).otherwise(grow)

    def finish(s: Column) -> Column:
        none = F.array(text) if keep_oversized else s["done"]
        return F.when(s["open"].isNull(), none).otherwise(F.concat(s["done"], F.array(s["open"])))

    return F.when(F.length(text) <= most, F.array(text)).otherwise(F.aggregate(body, start, step, finish))


def reformat_table(text: Column) -> Column:
    """A table as "name: header=value, ..." lines, for a reader that loses track of columns.

    Texts with fewer than two table rows stay as they are. Text before the first row is kept, other
    lines between and after rows are not. Rows right below the header with an empty first cell and as many
    cells continue it. A row without a name, or named by a period, keeps its cells joined by " | "."""
    lines = F.split(text, "\n", -1)
    bordered = F.filter(lines, lambda x: x.contains("|"))
    table = F.transform(bordered, cells)
    first = F.array_position(F.transform(lines, lambda x: x.contains("|")), True)
    lead = F.array_join(F.slice(lines, 1, F.greatest(first.cast("int") - 1, F.lit(0))), "\n")
    begin = F.struct(F.get(table, F.lit(0)).alias("header"), F.lit(False).alias("closed"), F.array().cast("array<array<string>>").alias("body"))

    def step(s: Column, row: Column) -> Column:
        goes_on = ~s["closed"] & (F.get(row, F.lit(0)) == "") & (F.size(row) == F.size(s["header"]))
        merged = F.zip_with(s["header"], row, lambda a, b: strip(F.concat_ws(" ", F.when(a != "", a), F.when(b != "", b))))
        return F.when(goes_on, F.struct(merged.alias("header"), F.lit(False).alias("closed"), s["body"].alias("body"))).otherwise(
            F.struct(s["header"].alias("header"), F.lit(True).alias("closed"), F.concat(s["body"], F.array(row)).alias("body"))
        )

    def line(header: Column, row: Column) -> Column:
        name, n = F.get(row, F.lit(0)), F.least(F.size(header), F.size(row))
        pairs = F.zip_with(F.slice(header, 2, F.greatest(n - 1, F.lit(0))), F.slice(row, 2, F.greatest(n - 1, F.lit(0))), lambda h, v: F.when((h != "") & (v != ""), F.concat(h, F.lit("="), v)))
        pairs = F.filter(pairs, lambda p: p.isNotNull())
        return F.when((name == "") | name.rlike(PERIOD) | (F.size(pairs) == 0), F.array_join(row, " | ")).otherwise(F.concat(name, F.lit(": "), F.array_join(pairs, ", ")))

    def finish(s: Column) -> Column:
        return F.array_join(F.transform(s["body"], lambda r: line(s["header"], r)), "\n")

    body = F.aggregate(F.slice(table, 2, F.greatest(F.size(table) - 1, F.lit(0))), begin, step, finish)
    said = F.when(~lead.rlike(r"(?U)\S"), body).when(body == "", lead).otherwise(F.concat(lead, F.lit("\n"), body))
    return F.when(F.size(bordered) < 2, text).otherwise(said)
