"""Cells of HTML tables and headings, for any page: an Arrow stage that turns each page into rows."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse

_PLACES = ("tbl", "row", "col", "up", "up_row", "up_col")
_CELL = pa.list_(pa.struct([("section", pa.string()), *((x, pa.int32()) for x in _PLACES), ("kind", pa.string()), ("label", pa.string()), ("text", pa.string())]))
CELLS = f"array<struct<section:string,{','.join(f'{x}:int' for x in _PLACES)},kind:string,label:string,text:string>>"
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "title"}
_BLOCKS = {"p", "li", "div"}
_SILENT = {"script", "style", "noscript"}


class _Cells(HTMLParser):
    """Collects cells: headings, and divs of the header classes, open a section; th and td belong to the innermost table (tbl, row,
    col), which lies in a cell of another one (up, up_row, up_col), if it is nested; the second, fourth and so on of a row,
    if no header cells, have the text of the one before as their label; a new cell, row or block closes what is
    open, so unclosed tags do no harm."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cells: list[dict] = []
        self.section, self.tables = "", 0
        self.open = [dict.fromkeys(_PLACES, -1)]  # the places of the tables that are open; the first is none
        self.before: dict[int, str] = {}  # of each table, the cell before
        self.kind: str | None = None
        self.parts: list[str] = []
        self.silent = 0

    def close_cell(self) -> None:
        text = " ".join("".join(self.parts).split())
        if self.kind in ("heading", "sub-header", "title") and text:
            self.section = text
        if self.kind and (text or self.kind in ("td", "th")):
            place, label = dict.fromkeys(_PLACES, -1), None
            if self.kind in ("td", "th"):
                place = self.open[-1]
                label = self.before.get(place["tbl"]) if place["col"] % 2 and self.kind == "td" else None
                self.before[place["tbl"]] = text if self.kind == "td" else ""
            self.cells.append({"section": self.section, **place, "kind": self.kind, "label": label, "text": text})
        self.kind, self.parts = None, []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        names = (dict(attrs).get("class") or "").split()
        if tag in _SILENT:
            self.silent += 1
        elif tag == "table":
            self.close_cell()
            around = self.open[-1]
            self.open.append({"tbl": self.tables, "row": -1, "col": -1, "up": around["tbl"], "up_row": around["row"], "up_col": around["col"]})
            self.tables += 1
        elif tag == "tr":
            self.close_cell()
            self.open[-1]["row"] += 1
            self.open[-1]["col"] = -1
        elif tag in ("td", "th"):
            self.close_cell()
            self.kind = tag
            self.open[-1]["col"] += 1
        elif tag in _HEADINGS or tag == "div" and {"header", "sub-header", "table-header"} & set(names):
            self.close_cell()
            self.kind = "title" if tag == "title" else "sub-header" if "sub-header" in names else "heading"
        elif tag in _BLOCKS and self.kind not in ("td", "th"):
            self.close_cell()
            self.kind = "text"
        elif tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "table":
            self.close_cell()
            if len(self.open) > 1:
                self.open.pop()
        elif tag in ("td", "th", "tr") or tag in _HEADINGS or tag in _BLOCKS and self.kind not in ("td", "th"):
            self.close_cell()

    def handle_data(self, data: str) -> None:
        if self.kind and not self.silent:
            self.parts.append(data)


def cells_of(html: str) -> list[dict]:
    parser = _Cells()
    parser.feed(html)
    parser.close()
    parser.close_cell()
    return parser.cells


def with_cells(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages, without the raw page, with `cells`; null pages have none."""
    kept = [c for c in pages.columns if c not in (html, "cells")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(batch.schema.names.index("_html"))
            for a in range(0, len(batch), 128):
                made = pa.array([cells_of(x.as_py() or "") for x in raw.slice(a, 128)], _CELL)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, 128) for c in kept), made], names=[*kept, "cells"])

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept)
    return pages.select(*[f"`{c}`" for c in kept], F.col(html).alias("_html")).mapInArrow(run, f"{schema + ', ' if schema else ''}cells {CELLS}")


def vertical(cells: DataFrame, key: str) -> DataFrame:
    """(key, section, tbl, fields): of tables whose rows are label and value, a map; a later label wins."""
    rows = cells.where("tbl >= 0").groupBy(key, "section", "tbl", "row").agg(F.max_by("text", F.when(F.col("col") == 0, 1)).alias("label"), F.max_by("text", F.when(F.col("col") == 1, 1)).alias("value"), F.max("col").alias("last"))
    rows = rows.where("last = 1 AND label <> ''")
    last = rows.groupBy(key, "section", "tbl", "label").agg(F.max_by("value", "row").alias("value"))
    return last.groupBy(key, "section", "tbl").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "value")))).alias("fields"))


def horizontal(cells: DataFrame, key: str) -> DataFrame:
    """(key, section, tbl, row, fields): of tables with a header row, a map for each further row; cells without a header are
    left out."""
    heads = cells.where("tbl >= 0 AND row = 0").select(key, "tbl", "col", F.col("text").alias("head"))
    body = cells.where("tbl >= 0 AND row > 0").join(heads, [key, "tbl", "col"])
    last = body.groupBy(key, "section", "tbl", "row", "head").agg(F.max_by("text", "col").alias("text"))
    return last.groupBy(key, "section", "tbl", "row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("head", "text")))).alias("fields"))


def title_of(html: Column) -> Column:
    return collapse(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
