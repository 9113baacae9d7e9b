"""Excel workbooks (.xlsx): the first sheet of each file, one file per task row."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.functions.columns import col
from tabsmith.sources.delimited import MISSING_TOKENS, TableLoadError, infer_types

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def _column(reference: str) -> int:
    """Zero-based column of a cell reference such as ``BC12``."""
    position = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        position = position * 26 + ord(letter) - 64
    return position - 1


def _text(node: ElementTree.Element | None) -> str:
    return "" if node is None else "".join(t.text or "" for t in node.iter(f"{MAIN}t"))


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet as texts. A sheet has at most 1,048,576 rows."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = [_text(item) for item in root.iter(f"{MAIN}si")]
        first = next(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet"))
        links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
        target = next(r.get("Target") for r in links.iter(f"{PACKAGE}Relationship") if r.get("Id") == first.get(f"{REL}id"))
        name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        for _, row in ElementTree.iterparse(book.open(name)):
            if row.tag != f"{MAIN}row":
                continue
            cells: list[str | None] = []
            for cell in row.iter(f"{MAIN}c"):
                at = _column(cell.get("r")) if cell.get("r") else len(cells)
                cells += [None] * (at - len(cells))
                kind, value = cell.get("t"), cell.find(f"{MAIN}v")
                if kind == "s" and value is not None:
                    cells.append(shared[int(value.text)])
                elif kind == "inlineStr":
                    cells.append(_text(cell.find(f"{MAIN}is")))
                elif kind == "b" and value is not None:
                    cells.append("True" if value.text == "1" else "False")
                else:
                    cells.append(None if value is None else value.text)
            yield cells
            row.clear()


def read_excel(spark: SparkSession, path: str | Sequence[str], *, infer: bool = True) -> DataFrame:
    """First sheets of all workbooks under ``path`` as one table; they share the header of the first."""
    paths = [path] if isinstance(path, str) else list(path)
    files = spark.read.format("binaryFile").load(paths)
    names_seen = files.orderBy("path").select("path", "content").limit(1)

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                first = next(sheet_rows(bytes(content)), [])
                yield pd.DataFrame({"names": [[c or f"Unnamed: {i}" for i, c in enumerate(first)]]})

    found = names_seen.mapInPandas(headers, "names array<string>").collect()
    if not found or not found[0]["names"]:
        raise TableLoadError("Could not parse dataset: no header.")
    names = list(found[0]["names"])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                chunk: list[list[str | None]] = []
                for i, cells in enumerate(sheet_rows(bytes(content))):
                    if i == 0:
                        own = [c or f"Unnamed: {k}" for k, c in enumerate(cells)]
                        if own != names:
                            raise ValueError(f"A workbook has the header {own}, another one {names}.")
                        continue
                    if any(c is not None for c in cells[len(names) :]):
                        raise ValueError(f"Row {i + 1} of a workbook has {len(cells)} cells under {len(names)} names.")
                    chunk.append((cells + [None] * len(names))[: len(names)])
                    if len(chunk) == 10_000:
                        yield pd.DataFrame(chunk, columns=range(len(names)), dtype=object)
                        chunk = []
                if chunk:
                    yield pd.DataFrame(chunk, columns=range(len(names)), dtype=object)

    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    named = lambda it: (part.set_axis(names, axis=1) for part in rows(it))
    table = files.select("content").mapInPandas(named, schema)
    table = table.select(*[F.when(~col(c).isin(list(MISSING_TOKENS)), col(c)).alias(c) for c in names])
    return infer_types(table) if infer else table
