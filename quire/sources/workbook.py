"""Workbooks of report sheets, written without a further library.

A workbook is a zip archive of XML parts; texts are inline strings.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Sequence
from dataclasses import dataclass, field
from xml.sax.saxutils import escape

# Colours of review sheets.
HEADER_FILL, HEADER_TEXT, OK_FILL, ERROR_FILL = "2F4F7F", "FFFFFF", "D6FFD6", "FFD6D6"

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml."
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: A sheet's greatest number of rows in the format.
MOST_ROWS = 1 << 20


@dataclass
class Sheet:
    """Rows of a sheet; fills has a row's colour by its place, heads the places of header rows, bold those in bold type."""

    name: str
    rows: list[Sequence] = field(default_factory=list)
    fills: dict[int, str] = field(default_factory=dict)
    heads: set[int] = field(default_factory=set)
    bold: set[int] = field(default_factory=set)
    widths: Sequence[float] = ()


def column_name(i: int) -> str:
    """A, B, ..., Z, AA, ... of a column's number from 0."""
    name = ""
    while i >= 0:
        i, letter = i // 26 - 1, i % 26
        name = chr(65 + letter) + name
    return name


def _cell(ref: str, value: object, style: int) -> str:
    if value is None or value == "":
        return f'<c r="{ref}" s="{style}"/>'
    if isinstance(value, bool) or not isinstance(value, int | float):
        text = "".join(c if c >= " " or c in "\t\n" else " " for c in str(value))
        return f'<c r="{ref}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'
    return f'<c r="{ref}" s="{style}"><v>{value!r}</v></c>'


def to_bytes(sheets: Sequence[Sheet]) -> bytes:
    """The workbook file; fails for a sheet of more rows than the format has."""
    colours = sorted({c for s in sheets for c in s.fills.values()})
    style = {None: 0, "head": 1, "bold": 2} | {c: 3 + i for i, c in enumerate(colours)}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for n, sheet in enumerate(sheets, 1):
            if len(sheet.rows) > MOST_ROWS:
                raise ValueError(f"sheet {sheet.name} has more than {MOST_ROWS} rows")
            cols = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(sheet.widths, 1))
            lines = [_HEAD, f'<worksheet xmlns="{_MAIN}">', f"<cols>{cols}</cols>" if cols else "", "<sheetData>"]
            for r, row in enumerate(sheet.rows):
                kind = style["head" if r in sheet.heads else "bold" if r in sheet.bold else sheet.fills.get(r)]
                lines.append(f'<row r="{r + 1}">' + "".join(_cell(f"{column_name(i)}{r + 1}", v, kind) for i, v in enumerate(row)) + "</row>")
            book.writestr(f"xl/worksheets/sheet{n}.xml", "".join([*lines, "</sheetData></worksheet>"]))
        numbers = range(1, len(sheets) + 1)
        listed = "".join(f'<sheet name="{escape(s.name[:31], {chr(34): "&quot;"})}" sheetId="{n}" r:id="rId{n}"/>' for n, s in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{n}" Type="{_REL}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in numbers)
        links += f'<Relationship Id="rId0" Type="{_REL}/styles" Target="styles.xml"/>'
        book.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>')
        book.writestr("xl/styles.xml", _styles(colours))
        book.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="{_TYPE}worksheet+xml"/>' for n in numbers)
        book.writestr(
            "[Content_Types].xml",
            f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_TYPE}sheet.main+xml"/>'
            f'<Override PartName="/xl/styles.xml" ContentType="{_TYPE}styles+xml"/>{parts}</Types>',
        )
    return out.getvalue()


def _styles(colours: Sequence[str]) -> str:
    """Cell formats: 0 plain, 1 header, 2 bold, then one for each fill colour."""
    solid = lambda c: f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>'
    fills = ['<fill><patternFill patternType="none"/></fill>', '<fill><patternFill patternType="gray125"/></fill>', solid(HEADER_FILL), *map(solid, colours)]
    fonts = ["<font><sz val=\"11\"/></font>", f'<font><b/><sz val="11"/><color rgb="FF{HEADER_TEXT}"/></font>', '<font><b/><sz val="11"/></font>']
    formats = [(0, 0), (1, 2), (2, 0), *((0, 3 + i) for i in range(len(colours)))]
    xfs = "".join(f'<xf numFmtId="0" fontId="{font}" fillId="{fill}" borderId="0" applyFont="1" applyFill="1"/>' for font, fill in formats)
    return (
        f'{_HEAD}<styleSheet xmlns="{_MAIN}"><fonts count="{len(fonts)}">{"".join(fonts)}</fonts><fills count="{len(fills)}">{"".join(fills)}</fills>'
        f'<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{len(formats)}">{xfs}</cellXfs></styleSheet>'
    )
