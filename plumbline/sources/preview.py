"""What the first lines of a delimited file say: delimiter, header, types."""

from __future__ import annotations

import csv
import re

DELIMITERS = (",", ";", "\t", "|")
_NUMBER = re.compile(r"^[+-]?(\d+(,\d{3})*|\d*)(\.\d+)?([eE][+-]?\d+)?$")
_DATE = re.compile(r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}([ T]\d{1,2}:\d{2}(:\d{2})?)?$")


def _cells(line: str, sep: str) -> list[str]:
    return next(csv.reader([line], delimiter=sep), [])


def delimiter(lines: list[str]) -> str:
    """The mark that cuts all lines into equally many cells; then the one that cuts most."""

    def worth(sep: str) -> tuple[int, int]:
        n = [len(_cells(x, sep)) for x in lines]
        return (1000 * (len(set(n)) == 1 and n[0] > 1) + max(n, default=0), -DELIMITERS.index(sep))

    return max(DELIMITERS, key=worth)


def is_number(x: str) -> bool:
    return bool(x) and x not in ("+", "-", ".") and bool(_NUMBER.match(x)) and any(c.isdigit() for c in x)


def column_type(values: list[str], least: float = 0.9) -> str:
    full = [v.strip() for v in values if v.strip()]
    if not full:
        return "string"
    share = lambda test: sum(map(bool, map(test, full))) / len(full)
    if share(lambda v: v.lower() in ("true", "false", "yes", "no")) >= least:
        return "boolean"
    if share(lambda v: re.fullmatch(r"[+-]?\d{1,18}", v)) >= least:
        return "bigint"
    if share(is_number) >= least:
        return "double"
    if share(_DATE.match) >= least:
        return "timestamp" if any(":" in v for v in full) else "date"
    return "string"


def sniff(text: str, rows: int = 20) -> dict:
    """delimiter, header (no cell of the first line is a number), names and types."""
    lines = [x for x in text.splitlines() if x.strip()][: rows + 1]
    sep = delimiter(lines) if lines else ","
    cells = [_cells(x, sep) for x in lines]
    header = bool(cells) and len(cells) > 1 and not any(is_number(c.strip()) for c in cells[0])
    names = [c.strip() for c in cells[0]] if header else [f"column{i}" for i in range(len(cells[0]) if cells else 0)]
    body = cells[1:] if header else cells
    return {"delimiter": sep, "header": header, "names": names, "types": [column_type([r[i] for r in body if i < len(r)]) for i in range(len(names))]}


def to_schema(found: dict, forced: dict[str, str] | None = None) -> str:
    """A schema string; `forced` overrides types by name."""
    return ", ".join(f"`{n}` {(forced or {}).get(n, t)}" for n, t in zip(found["names"], found["types"]))
