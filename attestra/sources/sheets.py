"""Workbooks (Office Open XML) without a library: the few parts of the format that tables use."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

# Names of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
DOCUMENT = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def _column(reference: str) -> int:
    n = 0
    for letter in re.match("[A-Z]+", reference).group():
        n = n * 26 + ord(letter) - 64
    return n - 1


def _letters(column: int) -> str:
    out = ""
    column += 1
    while column:
        column, rest = divmod(column - 1, 26)
        out = chr(65 + rest) + out
    return out


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t"))


def cells(content: bytes, sheet: str) -> Iterator[dict[int, str]]:
    """Every row of a sheet as column number -> text; empty cells are left out, rows that are not stored are empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = {s.get("name"): s.get(f"{{{DOCUMENT}}}id") for s in ET.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")}
        if sheet not in names:
            raise ValueError(f"no sheet {sheet}")
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        shared = [_text(x) for x in ET.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
        target = targets[names[sheet]]
        seen = 0
        for row in ET.fromstring(book.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter(f"{MAIN}row"):
            number = int(row.get("r", seen + 1))
            for _ in range(number - seen - 1):
                yield {}
            seen, out = number, {}
            for at, cell in enumerate(row.iter(f"{MAIN}c")):
                value = cell.find(f"{MAIN}v")
                kind = cell.get("t")
                text = _text(cell) if kind == "inlineStr" else None if value is None else value.text
                if text is not None and text != "" and kind != "e":
                    place = _column(cell.get("r")) if cell.get("r") else at
                    out[place] = shared[int(text)] if kind == "s" else {"0": "false", "1": "true"}[text] if kind == "b" else text
            yield out


def workbook(sheet: str, columns: Sequence[str], rows: Sequence[Sequence], above: int = 0) -> bytes:
    """A workbook of one sheet: the column names in row ``above`` (from 0), then the rows; nulls are empty cells."""
    def cell(at: int, n: int, v) -> str:
        if v is None:
            return ""
        where = f'r="{_letters(at)}{n}"'
        if isinstance(v, bool):
            return f'<c {where} t="b"><v>{int(v)}</v></c>'
        return f"<c {where}><v>{v!r}</v></c>" if isinstance(v, (int, float)) else f'<c {where} t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    body = "".join(f'<row r="{n}">{"".join(cell(at, n, v) for at, v in enumerate(r))}</row>' for n, r in enumerate([columns, *rows], above + 1))
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{DOCUMENT}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{DOCUMENT}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{DOCUMENT}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()
