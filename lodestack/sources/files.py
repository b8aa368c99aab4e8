"""Files as documents: dispatch by extension, text, tables, mail boxes and office formats.

Every reader takes ``binaryFile`` rows through ``mapInPandas``; a file that cannot be read gives a
row with its error and no text, never a failed job.  Formats whose parser is no part of the
repository (images) are read by converters the caller registers.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from email import message_from_bytes, policy
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.sources import pdf

# Extensions by converter.
EXTENSIONS = {
    "text": ("txt", "md", "org", "adoc", "rst", "csv", "json", "html"), "pdf": ("pdf",), "docx": ("docx",), "slides": ("pptx", "odp"), "writer": ("odt",), "sheet": ("xlsx",),
    "book": ("epub",), "mail": ("mbox",), "image": ("png", "jpg", "jpeg", "webp"), "audio": ("mp3", "wav", "mp4", "mpeg"),
}
CONVERTERS: dict[str, Callable[[bytes], list[tuple[str, str]]]] = {}
FIELDS = "path string, part string, text string, error string"


def converter(column: Column) -> Column:
    """Name of the converter for a path or source; ``web`` for links, ``fallback`` for unknown extensions."""
    extension = F.regexp_extract(F.lower(column), r"\.([a-z0-9]+)$", 1)
    out = F.when(F.coalesce(column, F.lit("")).startswith("link://"), "web")
    for name, extensions in EXTENSIONS.items():
        out = out.when(extension.isin(*extensions), name)
    return out.otherwise("fallback")


def text_like(data: bytes) -> bool:
    """Under a tenth of the first 1,024 bytes are control characters; NUL counts twice."""
    head = data[:1024]
    odd = sum(b < 9 or b in (11, 12) or 14 <= b < 32 for b in head) + head.count(0)
    return odd < len(head) * 0.1 or not head


def _xml(data: bytes) -> ElementTree.Element:
    return ElementTree.fromstring(data)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _paragraphs(root: ElementTree.Element, block: tuple[str, ...], leaf: str | None) -> list[str]:
    out = []
    for node in root.iter():
        if _local(node.tag) in block:
            text = "".join(x.text or "" for x in node.iter() if leaf is None or _local(x.tag) == leaf) if leaf else "".join(node.itertext())
            if text.strip():
                out.append(text)
    return out


def docx(data: bytes) -> list[tuple[str, str]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [("", "\n\n".join(_paragraphs(_xml(z.read("word/document.xml")), ("p",), "t")))]


def slides(data: bytes) -> list[tuple[str, str]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n).group()))
        if not names:
            return writer(data)
        return [("", "\n\n".join(t for n in names for t in _paragraphs(_xml(z.read(n)), ("p",), "t")))]


def writer(data: bytes) -> list[tuple[str, str]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [("", "\n\n".join(_paragraphs(_xml(z.read("content.xml")), ("p", "h"), None)))]


def book(data: bytes) -> list[tuple[str, str]]:
    from lodestack.functions.html import to_markdown

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        container = _xml(z.read("META-INF/container.xml"))
        package = next(x.get("full-path") for x in container.iter() if _local(x.tag) == "rootfile")
        root, folder = _xml(z.read(package)), package.rpartition("/")[0]
        files = {x.get("id"): x.get("href") for x in root.iter() if _local(x.tag) == "item"}
        order = [files[x.get("idref")] for x in root.iter() if _local(x.tag) == "itemref"]
        return [("", "\n\n".join(to_markdown(z.read(f"{folder}/{h}" if folder else h).decode("utf-8", "replace")) for h in order))]


def _quoted(cell: str) -> str:
    return f'"{cell}"' if "," in cell else cell


def sheet(data: bytes) -> list[tuple[str, str]]:
    """One part per sheet as comma-separated text; only cells with a comma are quoted; empty sheets are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = [_joined(x) for x in _xml(z.read("xl/sharedStrings.xml")) if _local(x.tag) == "si"] if "xl/sharedStrings.xml" in z.namelist() else []
        book_ = _xml(z.read("xl/workbook.xml"))
        names = [x.get("name") for x in book_.iter() if _local(x.tag) == "sheet"]
        files = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n).group()))
        out = []
        for name, file in zip(names, files, strict=False):
            rows = []
            for row in (x for x in _xml(z.read(file)).iter() if _local(x.tag) == "row"):
                cells: dict[int, str] = {}
                for c in row:
                    value = next((x.text or "" for x in c if _local(x.tag) == "v"), "")
                    kind = c.get("t")
                    text = shared[int(value)] if kind == "s" and value else _joined(c) if kind == "inlineStr" else value
                    letters = re.match(r"[A-Z]+", c.get("r") or "")
                    place = sum((ord(ch) - 64) * 26**i for i, ch in enumerate(reversed(letters.group()))) - 1 if letters else len(cells)
                    cells[place] = text
                rows.append(",".join(_quoted(cells.get(i, "")) for i in range(max(cells, default=-1) + 1)))
            text = "\n".join(rows)
            if text.strip(", \n"):
                out.append((name, text))
        return out


def _joined(node: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x.tag) == "t")


def merge_sheets(parts: list[tuple[str, str]]) -> str:
    return "".join(f"\nSheet: {name}\n{text}" for name, text in parts)


def mail(data: bytes) -> list[tuple[str, str]]:
    """One part per message with text, titled by its subject; messages begin at lines ``From `` after a blank line."""
    out = []
    for part in re.split(rb"(?:^|(?<=\n\n)|(?<=\n\r\n))From [^\n]*\n", data)[1:]:
        message = message_from_bytes(re.sub(rb"^>(>*From )", rb"\1", part, flags=re.M), policy=policy.default)
        body = message.get_body(("plain", "html"))
        text = body.get_content().strip() if body else ""
        if text:
            out.append((str(message["subject"] or "no subject"), text))
    return out


def plain(data: bytes) -> list[tuple[str, str]]:
    return [("", data.decode("utf-8", "replace"))]


CONVERTERS.update(text=plain, pdf=pdf.convert, docx=docx, slides=slides, writer=writer, sheet=sheet, book=book, mail=mail)


def register(name: str, convert: Callable[[bytes], list[tuple[str, str]]], *extensions: str) -> None:
    """Add a converter (bytes -> [(part, text)]) for a format, such as images with a recogniser of the caller's choice."""
    CONVERTERS[name] = convert
    if extensions:
        EXTENSIONS[name] = tuple(extensions)


def convert(name: str, data: bytes) -> list[tuple[str, str]]:
    if name == "fallback":
        if not text_like(data):
            raise ValueError("unknown file type")
        name = "text"
    if name not in CONVERTERS:
        raise ValueError(f"no converter for {name}")
    return CONVERTERS[name](data)


def read_documents(spark: SparkSession, folder: str, pattern: str = "*", converters: dict | None = None) -> DataFrame:
    """(path, part, text, error) of the files of a folder; one file's failure is its own row."""
    given = CONVERTERS | (converters or {})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        CONVERTERS.update(given)
        for pdf in batches:
            out = []
            for path, kind, data in zip(pdf["path"], pdf["kind"], pdf["content"], strict=True):
                try:
                    out.extend((path, part, text, None) for part, text in convert(kind, bytes(data)))
                except Exception as e:  # noqa: BLE001  (any damaged file)
                    out.append((path, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "part", "text", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", converter(F.col("path")).alias("kind"), "content").mapInPandas(read, FIELDS)


def ingest_folders(spark: SparkSession, folders: dict[str, str], pattern: str = "*.{pdf,docx}") -> DataFrame:
    """Documents of several folders, each with its namespace."""
    out = None
    for namespace, folder in sorted(folders.items()):
        part = read_documents(spark, folder, pattern).withColumn("namespace", F.lit(namespace))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no folders")
    return out


def sniff(line: str) -> str:
    """Delimiter of a header line: the most frequent of , ; tab |, the earlier on equal counts."""
    return max(",;\t|", key=lambda d: (line.count(d), -",;\t|".index(d)))


def read_table(text: str) -> list[list[str]]:
    """Rows of delimited text; blank rows are dropped."""
    lines = text.splitlines()
    rows = csv.reader(io.StringIO(text), delimiter=sniff(lines[0] if lines else ""))
    return [r for r in rows if any(c.strip() for c in r)]
