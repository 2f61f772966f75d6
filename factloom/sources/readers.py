"""Documents from files: discovery, format routing, text of each format.

Paths are read by Spark's ``binaryFile``, so any file system that Spark knows will do.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import fixed
from factloom.functions.text import format_of

DOCUMENT = "path string, format string, raw_text string, images array<string>, error string"


def scan(spark: SparkSession, root: str, recursive: bool = True, formats: list[str] | None = None) -> DataFrame:
    """(path, format, size_bytes, modified, content) of files with a known extension. ``content`` is pruned where unselected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    out = files.select("path", format_of(F.col("path")).alias("format"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), "content").filter("format is not null")
    return out.filter(F.col("format").isin(formats)) if formats else out


def read_text(raw: bytes) -> str:
    """UTF-8; invalid bytes become replacement characters."""
    return raw.decode("utf-8", "replace")


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts: list[str] = []
        self.images: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head"):
            self.skip += 1
        elif tag == "img":
            found = dict(attrs)
            self.images.append(found.get("alt") or found.get("src") or "")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head") and self.skip:
            self.skip -= 1

    def handle_data(self, data):
        if not self.skip and data.strip():
            self.parts.append(data.strip())


def html_strings(html: str) -> tuple[str, list[str]]:
    """Visible strings, stripped, one a line; alternative texts or sources of images."""
    p = _Visible()
    p.feed(html)
    p.close()
    return "\n".join(p.parts), p.images


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _rows_to_markdown(rows: list[list[str]]) -> str:
    width = max(map(len, rows))
    full = [[c.strip() for c in r] + [""] * (width - len(r)) for r in rows]
    line = lambda r: "| " + " | ".join(r) + " |"
    return "\n".join([line(full[0]), line(["---"] * width), *map(line, full[1:])])


def docx_text(raw: bytes) -> str:
    """Paragraphs joined by blank lines, heading styles as ``#`` marks, tables of two or more rows as markdown."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    parts, tables = [], []
    for e in body:
        if e.tag == f"{_W}p" and text(e).strip():
            style = e.find(f"{_W}pPr/{_W}pStyle")
            level = re.match(r"(?i)heading\s*(\d)", style.get(f"{_W}val", "")) if style is not None else None
            parts.append("#" * int(level[1]) + " " + text(e) if level else text(e))
        elif e.tag == f"{_W}tbl":
            rows = [[text(c) for c in r.iter(f"{_W}tc")] for r in e.iter(f"{_W}tr")]
            if len(rows) >= 2:
                tables.append(_rows_to_markdown(rows))
    return "\n\n".join(parts + tables)


def epub_text(raw: bytes) -> tuple[str, list[str]]:
    """Visible strings of the book's pages in reading order."""
    texts, images = [], []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        order = [n for n in names if re.search(r"\.x?html?$", n, re.I)]
        opf = next((n for n in names if n.endswith(".opf")), None)
        if opf:
            root = ElementTree.fromstring(z.read(opf))
            base = opf.rpartition("/")[0]
            items = {e.get("id"): e.get("href") for e in root.iter() if e.tag.endswith("}item")}
            spine = [items.get(e.get("idref")) for e in root.iter() if e.tag.endswith("}itemref")]
            listed = [f"{base}/{h}" if base else h for h in spine if h]
            order = [n for n in listed if n in names] or order
        for n in order:
            t, i = html_strings(z.read(n).decode("utf-8", "replace"))
            texts.append(t)
            images += i
    return "\n\n".join(t for t in texts if t), images


def pdf_pages(pages) -> tuple[str, list[str]]:
    """(text, image names) of pages with ``text``, ``images`` (a number) and ``tables`` (rows of cells): page texts joined by line ends,
    each page's tables as markdown and a placeholder for each image behind its text."""
    texts, images = [], []
    for n, page in enumerate(pages, 1):
        names = [f"img_p{n}_{i:02d}" for i in range(1, page["images"] + 1)]
        tables = [_rows_to_markdown([[c or "" for c in r] for r in t]) for t in page["tables"] if len(t) >= 2]
        texts.append("\n".join(x for x in [page["text"], *tables, *(f"[image: {name}]" for name in names)] if x))
        images += names
    return "\n".join(texts), images


def pdf_text(raw: bytes) -> tuple[str, list[str]]:
    """Pages, tables and images by whichever PDF library is there; an error that says so where none is."""
    try:
        import fitz  # type: ignore
    except ImportError as e:
        raise RuntimeError("no PDF library on this executor") from e
    with fitz.open(stream=raw, filetype="pdf") as book:
        return pdf_pages({"text": p.get_text(), "images": len(p.get_images()), "tables": [t.extract() for t in p.find_tables().tables]} for p in book)


def image_text(path: str, raw: bytes) -> str:
    """The placeholder that stands for an image document."""
    ext = path.rpartition(".")[2].lower()
    return f"[image document]\nfile: {path.rpartition('/')[2]}\ntype: {fixed.MIME.get(ext, 'application/octet-stream')}\nbytes: {len(raw)}"


READERS: dict[str, Callable[[str, bytes], tuple[str, list[str]]]] = {
    "txt": lambda p, r: (read_text(r), []),
    "md": lambda p, r: (read_text(r), re.findall(r"!\[[^\]]*\]\(([^)]+)\)", read_text(r))),
    "docx": lambda p, r: (docx_text(r), []),
    "epub": lambda p, r: epub_text(r),
    "pdf": lambda p, r: pdf_text(r),
    "image": lambda p, r: (image_text(p, r), ["img_001"]),
}


def content_of(value) -> bytes:
    """Bytes of an input given as bytes, text, a path, or several paths (their bytes one after the other)."""
    if isinstance(value, bytes | bytearray):
        return bytes(value)
    if isinstance(value, str):
        return value.encode()
    if isinstance(value, Path):
        return value.read_bytes()
    if isinstance(value, list | tuple):
        return b"".join(Path(p).read_bytes() for p in value)
    raise TypeError(f"no document content: {type(value).__name__}")


def documents(spark: SparkSession, inputs: dict) -> DataFrame:
    """(path, format, content) of a few inputs handed over by name, as scanned files have them; unknown formats are null."""
    rows = [(name, content_of(value)) for name, value in inputs.items()]
    return spark.createDataFrame(rows, "path string, content binary").select("path", format_of(F.col("path")).alias("format"), "content")


def register_reader(name: str, reader: Callable[[str, bytes], tuple[str, list[str]]]) -> None:
    READERS[name] = reader


def extract(files: DataFrame, readers: dict | None = None, longest: int = 50 << 20) -> DataFrame:
    """(path, format, raw_text, images, error) of scanned files; a file that can't be read reports its error instead of failing the job."""
    known = dict(readers or READERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, fmt, raw in zip(pdf["path"], pdf["format"], pdf["content"], strict=True):
                try:
                    if len(raw) > longest:
                        raise ValueError(f"over {longest} bytes")
                    if fmt not in known:
                        raise ValueError(f"no reader for {fmt}")
                    text, images = known[fmt](path, bytes(raw))
                    rows.append((path, fmt, text, images, None))
                except Exception as e:  # noqa: BLE001 - reported in the row
                    rows.append((path, fmt, None, [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "format", "raw_text", "images", "error"])

    return files.select("path", "format", "content").mapInPandas(run, DOCUMENT)


def oversize(docs: DataFrame, text_col: str, most_tokens: int = 500_000, mode: str = "truncate") -> DataFrame:
    """Documents over the limit are dropped (reject), cut (truncate), or reduced to evenly spaced parts (sample)."""
    limit = most_tokens * fixed.CHARS_PER_TOKEN
    long = F.length(text_col) > limit
    if mode == "reject":
        return docs.filter(~long)
    if mode == "truncate":
        return docs.withColumn(text_col, F.when(long, F.substring(text_col, 1, limit)).otherwise(F.col(text_col)))
    if mode != "sample":
        raise ValueError(mode)
    part = max(limit // 10, 1)
    step = ((F.length(text_col) - part) / 9).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.substring(F.col(text_col), (i * step + 1).cast("int"), F.lit(part)))
    return docs.withColumn(text_col, F.when(long, F.array_join(pieces, "\n")).otherwise(F.col(text_col)))
