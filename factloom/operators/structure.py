"""Headings, tables, footnotes and merged content of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import fixed
from factloom.functions import text as X


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(id_col, text_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))


def sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ord, title, level, start_position, end_position): lines that fit a heading pattern, first pattern wins.

    Position is that of the line's first occurrence in the text. Blank lines and lines over 200
    characters are no headings.
    """
    s = F.regexp_replace("line", r"^\s+|\s+$", "")
    p = [rf"(?i){x}" for x in fixed.HEADINGS]
    level = F.when(s.rlike(p[0]), F.length(F.regexp_extract(s, p[0], 1))).when(s.rlike(p[1]), F.length(F.regexp_replace(F.regexp_extract(s, p[1], 1), "[^.]", "")) + 1).when(s.rlike(p[2]) | s.rlike(p[3]), 1)
    found = _lines(docs, id_col, text_col).filter((s != "") & (F.length(s) <= 200)).withColumns({"title": s, "level": level}).filter("level is not null")
    at = F.instr(F.col(text_col), F.col("line")) - 1
    return found.select(id_col, F.row_number().over(Window.partitionBy(id_col).orderBy("line_no")).alias("ord"), "title", "level", at.alias("start_position"), (at + F.length("line")).alias("end_position"))


def flags(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, has_toc, has_bibliography, bibliography_position, has_index)."""
    t = F.col(text_col)
    at = X.bibliography_at(t)
    return docs.select(id_col, X.has_contents(t).alias("has_toc"), at.isNotNull().alias("has_bibliography"), at.alias("bibliography_position"), X.has_index(t).alias("has_index"))


def footnotes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, footnote_id, content) of lines '[n] text'."""
    pattern = r"^\[(\d+)\]\s+(.+)$"
    return _lines(docs, id_col, text_col).filter(F.col("line").rlike(pattern)).select(id_col, F.concat(F.lit("fn_"), F.regexp_extract("line", pattern, 1)).alias("footnote_id"), F.trim(F.regexp_extract("line", pattern, 2)).alias("content"), "line_no")


def tables(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, table_id, content_markdown): runs of at least two lines '|...|' with a separator line, numbered by document."""
    row = F.trim("line")
    rows = _lines(docs, id_col, text_col).withColumn("row", row).filter(F.col("row").startswith("|") & F.col("row").endswith("|"))
    w = Window.partitionBy(id_col).orderBy("line_no")
    runs = rows.withColumn("run", F.col("line_no") - F.row_number().over(w))
    blocks = runs.groupBy(id_col, "run").agg(F.count("*").alias("n"), F.min("line_no").alias("at"), F.max(F.col("row").rlike(r"^\|[\s\-:|]+\|$")).alias("ruled"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "row"))), lambda x: x["row"]), "\n").alias("content_markdown"))
    kept = blocks.filter("n >= 2 and ruled")
    return kept.select(id_col, F.format_string("tbl_%03d", F.row_number().over(Window.partitionBy(id_col).orderBy("at"))).alias("table_id"), "content_markdown")


def markdown_table(rows: Column) -> Column:
    """array<array<string>> to a markdown table, rows padded to the widest; the first row is the header."""
    width = F.array_max(F.transform(rows, F.size))
    cell = lambda c: F.trim(F.coalesce(c, F.lit("")))
    padded = F.transform(rows, lambda r: F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    body = F.transform(padded, line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, 2, F.size(body))), "\n")).otherwise("")


def block(kind: str, name: Column, description: Column) -> Column:
    """A marked image or table block."""
    return F.concat(F.lit(f"<<<{kind}_CONTENT id=\""), name, F.lit("\">>>\n"), description, F.lit(f"\n<<<END_{kind}_CONTENT>>>"))


def merge_content(text: Column, blocks: Column) -> Column:
    """Text and its blocks joined by blank lines; null and empty blocks are dropped."""
    return F.array_join(F.concat(F.array(text), F.filter(blocks, lambda b: b.isNotNull() & (b != ""))), "\n\n")
