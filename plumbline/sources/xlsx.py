"""Workbooks as a Spark data source, read with the standard library.

`spark.read.format("workbook").load(path)` gives the first sheet that has cells: the first row names the columns, all
values are text, dates are ISO text, errors are empty. A workbook is one partition; several files are several.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: Built-in number formats that are dates or times.
_DATE_IDS = {*range(14, 23), *range(45, 48)}


def column_index(ref: str) -> int:
    """Zero-based column of a cell reference such as AB12."""
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def is_date_format(code: str) -> bool:
    """A format code with date or time letters outside quotes and brackets."""
    bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code.lower())
    return bool(re.search(r"[ymdhs]", bare)) and not re.search(r"[0#?]", re.sub(r"\.0+", "", bare))


def serial_to_iso(serial: float, date1904: bool = False) -> str:
    """A day number as ISO text; the time is left out at midnight. Day 60 of the 1900 system does not exist."""
    base = datetime(1904, 1, 1) if date1904 else datetime(1899, 12, 30) if serial >= 60 else datetime(1899, 12, 31)
    moment = base + timedelta(seconds=round(serial * 86400))
    return moment.strftime("%Y-%m-%d") if moment.time() == datetime.min.time() else moment.strftime("%Y-%m-%d %H:%M:%S")


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_NS}t"))


def rows(content: bytes) -> list[list[str]]:
    """The first sheet with cells, as rows of text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        parse = lambda n: ET.fromstring(z.read(n)) if n in names else None
        shared = [_text(x) for x in s.findall(f"{_NS}si")] if (s := parse("xl/sharedStrings.xml")) is not None else []
        dates, styles = set(), parse("xl/styles.xml")
        if styles is not None:
            own = {int(f.get("numFmtId")) for f in styles.iter(f"{_NS}numFmt") if is_date_format(f.get("formatCode", ""))}
            formats = styles.find(f"{_NS}cellXfs")
            dates = {i for i, x in enumerate(formats if formats is not None else []) if int(x.get("numFmtId", 0)) in _DATE_IDS | own}
        book = parse("xl/workbook.xml")
        props = book.find(f"{_NS}workbookPr") if book is not None else None
        old = props is not None and props.get("date1904") in ("1", "true")
        for sheet in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rpartition("/")[2])[0])):
            out = []
            for row in parse(sheet).iter(f"{_NS}row"):
                cells: dict[int, str] = {}
                for k, c in enumerate(row.findall(f"{_NS}c")):
                    at = column_index(c.get("r")) if c.get("r") else k
                    kind, v = c.get("t", "n"), c.find(f"{_NS}v")
                    raw = v.text or "" if v is not None else ""
                    if kind == "s":
                        raw = shared[int(raw)] if raw else ""
                    elif kind == "inlineStr":
                        raw = _text(c)
                    elif kind == "e":
                        raw = ""
                    elif kind == "b":
                        raw = "true" if raw == "1" else "false"
                    elif kind == "n" and raw and int(c.get("s", 0)) in dates:
                        raw = serial_to_iso(float(raw), old)
                    cells[at] = raw
                if cells:
                    out.append([cells.get(i, "") for i in range(max(cells) + 1)])
            if any(any(r) for r in out):
                width = max(map(len, out))
                return [r + [""] * (width - len(r)) for r in out]
    return []


def load(spark: SparkSession, path: str) -> DataFrame:
    """Workbooks through Spark's own file reader, so any store it can open will do."""
    files = spark.read.format("binaryFile").load(path).select("content")
    first = files.limit(1).collect()
    table = rows(bytes(first[0]["content"])) if first else []
    names = [n.strip() or f"column{i}" for i, n in enumerate(table[0])] if table else ["column0"]
    schema = ", ".join(f"`{n}` string" for n in names)

    def run(batches: Iterator):
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                body = rows(bytes(content))[1:]
                yield pd.DataFrame([[x if x != "" else None for x in (r + [""] * len(names))[: len(names)]] for r in body], columns=names, dtype="object")

    return files.mapInPandas(run, schema).select(*[F.col(f"`{n}`") for n in names])
