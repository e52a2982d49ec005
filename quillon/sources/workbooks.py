"""Workbooks of several sheets, written with the standard library."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

#: The rows that a sheet can hold, its header included.
SHEET_ROWS = 1_048_576
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def _letters(k: int) -> str:
    out = ""
    while k >= 0:
        out = chr(65 + k % 26) + out
        k = k // 26 - 1
    return out


def _cell(row: int, column: int, value) -> str:
    if value is None:
        return ""
    at = f'r="{_letters(column)}{row}"'
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f"<c {at}><v>{value}</v></c>"
    return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def _sheet(df: DataFrame) -> str:
    rows = [tuple(df.columns)]
    for row in df.limit(SHEET_ROWS).toLocalIterator():
        rows.append(tuple(row))
    if len(rows) > SHEET_ROWS:
        raise ValueError(f"a sheet holds at most {SHEET_ROWS - 1} rows")
    body = "".join(f'<row r="{i}">' + "".join(_cell(i, k, v) for k, v in enumerate(row)) + "</row>" for i, row in enumerate(rows, 1))
    return f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>'


def write_excel(sheets: dict[str, DataFrame], path: str) -> None:
    """One sheet a frame, in order.  A report's rows pass through the driver; more than a sheet holds raises."""
    names = list(sheets)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        book.writestr("[Content_Types].xml", f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')  # fmt: skip
        book.writestr("_rels/.rels", f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n[:31])}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}/relationships">{links}</Relationships>')
        for i, name in enumerate(names, 1):
            book.writestr(f"xl/worksheets/sheet{i}.xml", _sheet(sheets[name]))
    spark = next(iter(sheets.values())).sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(out.getvalue())
    finally:
        stream.close()
