"""Spreadsheet files: column widths as an aggregate, and a small XLSX writer."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_widths(df: DataFrame, most: int = 50) -> DataFrame:
    """For each column the width that fits its name and longest value, plus 2, at most ``most``; one pass."""
    widths = [F.least(F.greatest(F.coalesce(F.max(F.length(F.col(f"`{c}`").cast("string"))), F.lit(0)), F.lit(len(c))) + 2, F.lit(most))
        .alias(c) for c in df.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("long").alias("width")) for c in df.columns])
    return df.agg(*widths).select(F.explode(pairs).alias("w")).select("w.*")


def xlsx(df: DataFrame, rows: int = 1_000_000) -> bytes:
    """The bytes of a workbook with one sheet of at most ``rows`` rows, which the format bounds; for small results."""

    def line(values) -> str:
        return "<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>' for v in values) + "</row>"

    widths = "".join(f'<col min="{i}" max="{i}" width="{r["width"]}" customWidth="1"/>' for i, r in enumerate(column_widths(df).collect(), 1))
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    body = "".join(line(r) for r in [df.columns, *df.limit(rows).toLocalIterator()])
    files = {"[Content_Types].xml":
        '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" '
        'ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" '
        'ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override '
        'PartName="/xl/worksheets/sheet1.xml" '
        'ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>', "_rels/.rels":
        f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml":
        f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels":
        f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><cols>{widths}</cols><sheetData>{body}</sheetData></worksheet>',}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()
