"""Spreadsheets (.xlsx), read with the standard library: a zip of XML files."""

from __future__ import annotations

import re
import zipfile
from collections import Counter
from datetime import date, datetime, timedelta
from itertools import accumulate, chain, count, zip_longest
from pathlib import Path
from typing import Any
from xml.etree import ElementTree

import pyarrow as pa

from ..errors import SourceError

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DATE_FORMATS = frozenset((*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))
SCAN = 20
_GUESS = object()


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(archive.read(name)) if name in archive.namelist() else None


def _is_date(code: str) -> bool:
    return bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code), re.IGNORECASE))


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def read_cells(path: str | Path, sheet: str | int | None = None) -> list[list[Any]]:
    """The rows of a sheet (by name, by place, or the first): text, numbers, booleans, datetimes, None."""
    if not Path(path).exists():
        raise SourceError(f"there is no file {path}")
    try:
        with zipfile.ZipFile(path) as archive:
            return _cells(archive, sheet)
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError) as e:
        raise SourceError(f"{path} is no readable .xlsx file: {e}") from e


def _cells(archive: zipfile.ZipFile, sheet: str | int | None) -> list[list[Any]]:
    book = _xml(archive, "xl/workbook.xml")
    names = [(s.get("name"), s.get(f"{REL}id")) for s in book.iter(f"{MAIN}sheet")]
    if isinstance(sheet, str):
        if sheet not in [n for n, _ in names]:
            raise SourceError(f"there is no sheet '{sheet}' - there are {', '.join(n for n, _ in names)}")
        rid = dict(names)[sheet]
    else:
        k = sheet or 0
        if not -len(names) <= k < len(names):
            raise SourceError(f"there is no sheet {k} - there are {len(names)}")
        rid = names[k][1]
    links = {r.get("Id"): r.get("Target") for r in _xml(archive, "xl/_rels/workbook.xml.rels")}
    target = links[rid].lstrip("/")
    root = _xml(archive, target if target.startswith("xl/") else f"xl/{target}")
    strings = [_runs(s) for s in shared] if (shared := _xml(archive, "xl/sharedStrings.xml")) is not None else []
    styles = _xml(archive, "xl/styles.xml")
    custom = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{MAIN}numFmt")} if styles is not None else {}
    formats = [int(x.get("numFmtId", 0)) for x in styles.find(f"{MAIN}cellXfs")] if styles is not None and styles.find(f"{MAIN}cellXfs") is not None else []
    dated = [f in DATE_FORMATS or f in custom and _is_date(custom[f]) for f in formats]
    epoch = datetime(1904, 1, 1) if any(p.get("date1904") in ("1", "true") for p in book.iter(f"{MAIN}workbookPr")) else datetime(1899, 12, 30)
    rows: list[list[Any]] = []
    for row in root.iter(f"{MAIN}row"):
        while len(rows) < int(row.get("r", len(rows) + 1)) - 1:
            rows.append([])
        cells: list[Any] = []
        for c in row.iter(f"{MAIN}c"):
            at = _column(c.get("r")) if c.get("r") else len(cells)
            cells += [None] * (at - len(cells))
            style = int(c.get("s", 0))
            cells.append(_value(c, strings, style < len(dated) and dated[style], epoch))
        rows.append(cells)
    width = max(map(len, rows), default=0)
    return [r + [None] * (width - len(r)) for r in rows]


def _runs(item: ElementTree.Element) -> str:
    """The text of a cell: its own or its formatted runs', without phonetic notes."""
    return "".join(t.text or "" for part in item for t in ([part] if part.tag == f"{MAIN}t" else part.iter(f"{MAIN}t") if part.tag == f"{MAIN}r" else []))


def _value(cell: ElementTree.Element, strings: list[str], dated: bool, epoch: datetime) -> Any:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        held = cell.find(f"{MAIN}is")
        return _runs(held) if held is not None else None
    raw = cell.findtext(f"{MAIN}v")
    if raw is None or raw == "" or kind == "e":
        return None
    if kind == "s":
        return strings[int(raw)]
    if kind == "str":
        return raw
    if kind == "b":
        return raw == "1"
    if kind == "d":
        return datetime.fromisoformat(raw)
    number = float(raw)
    return epoch + timedelta(microseconds=round(number * 86_400_000_000)) if dated else number


def _blank(v: Any) -> bool:
    return v is None or isinstance(v, str) and not v.strip()


def _likeness(row: list[Any]) -> float:
    """How much a row looks like names, from 0 to 1: the shares of cells that are filled, of these that are text, and that are unlike each other, multiplied."""
    said = [v for v in row if not _blank(v)]
    if len(said) < 2:
        return 0.0
    kinds = Counter(isinstance(v, str) for v in said)
    unlike = {str(v).strip().casefold() for v in said}
    return kinds[True] * len(unlike) / (len(row) * len(said))


def guess_header(rows: list[list[Any]]) -> int:
    """The row among the first SCAN that looks most like names, the upper one of equals; the last row is data."""
    likeness = [_likeness(row) for row in rows[:-1][:SCAN]]
    if not any(likeness):
        raise SourceError("no header row was found - pass header= with its number (from 0), or header=None")
    return likeness.index(max(likeness))


def _spread(row: list[Any]) -> list[Any]:
    """A row of group titles; each stands for its own cell and the blank ones behind it, as merged cells do."""
    return list(accumulate(row, lambda title, v: title if _blank(v) else v))


def column_names(header: list[list[Any]], width: int) -> list[str]:
    """One name a column: the titles above it and its own, joined; nameless ones are numbered, repeated ones get _2, _3 ..."""
    titles = [*map(_spread, header[:-1]), *header[-1:]]
    names: dict[str, None] = {}
    for i, column in enumerate(zip_longest(*titles, [None] * width)):
        if i == width:
            break
        name = " ".join(str(v).strip() for v in column if not _blank(v)) or f"col_{i}"
        names[next(n for n in chain([name], (f"{name}_{k}" for k in count(2))) if n not in names)] = None
    return list(names)


def _column_array(values: list[Any]) -> pa.Array:
    kinds = {type(v) for v in values if v is not None}
    if kinds == {datetime} and all(v.time() == datetime.min.time() for v in values if v is not None):
        return pa.array([v and v.date() for v in values], pa.date32())
    types = {float: pa.float64(), bool: pa.bool_(), datetime: pa.timestamp("us"), date: pa.date32()}
    if len(kinds) == 1 and (kind := next(iter(kinds))) in types:
        return pa.array(values, types[kind])
    # columns of several kinds are text, whole numbers in it without a point
    return pa.array([v if v is None else f"{v:.0f}" if isinstance(v, float) and v.is_integer() else str(v) for v in values], pa.string())


def read_sheet(path: str | Path, sheet: str | int | None = None, header: Any = _GUESS, skip_rows: int = 0) -> pa.Table:
    """A sheet as an Arrow table.  header: a row number (from 0), the first and last row of a range of them, None for no header, or left out (or "auto") to be guessed."""
    rows = read_cells(path, sheet)[skip_rows:]
    if not rows:
        return pa.table({})
    if header is _GUESS or header == "auto":
        header = guess_header(rows)
    lines = [] if header is None else [header] if isinstance(header, int) else [*range(min(header), max(header) + 1)]
    if any(not 0 <= h < len(rows) for h in lines):
        raise SourceError(f"the sheet has no row {max(lines)} to be a header - it has {len(rows)}")
    body = rows[max(lines) + 1 :] if lines else rows
    names = column_names([rows[h] for h in lines], len(rows[0])) if lines else [f"col_{i}" for i in range(len(rows[0]))]
    body = [[None if _blank(v) else v for v in r] for r in body]
    while body and not any(v is not None for v in body[-1]):
        body.pop()
    return pa.table({n: _column_array([r[i] for r in body]) for i, n in enumerate(names)})
