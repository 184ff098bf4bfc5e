"""Workbooks (xlsx) as sources and sinks, in the plain part of the format: one sheet, texts and numbers.

A workbook is one file that one task writes, so a sheet holds at most the
format's number of rows; larger results take several workbooks.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format.
ROWS = 1_048_576
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELATIONS}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}
#: What XML can't hold.
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def column_letters(n: int) -> str:
    """A, B, ... Z, AA, ... of a column number from 0."""
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(value: object, at: str) -> str:
    if value is None or value != value:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{at}"><v>{value!r}</v></c>'
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(_CONTROL.sub("", str(value)))}</t></is></c>'


def workbook_bytes(names: list[str], rows: list[tuple]) -> bytes:
    """A workbook with a header row; control characters that XML can't hold are left out."""
    if len(rows) >= ROWS:
        raise ValueError(f"a sheet holds {ROWS - 1} rows and a header; write several workbooks")
    lines = "".join(f'<row r="{i}">' + "".join(_cell(v, f"{column_letters(k)}{i}") for k, v in enumerate(row)) + "</row>" for i, row in enumerate([tuple(names), *rows], 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in {**PARTS, "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{MAIN}"><sheetData>{lines}</sheetData></worksheet>'}.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text)
    return out.getvalue()


def workbook_rows(data: bytes) -> list[dict[str, str]]:
    """The first sheet's rows by the names of its first row; cells as text, empty ones left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = [] if "xl/sharedStrings.xml" not in z.namelist() else ["".join(t.text or "" for t in s.iter(f"{{{MAIN}}}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        sheet = ET.fromstring(z.read(min(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))))
    rows = []
    for row in sheet.iter(f"{{{MAIN}}}row"):
        cells = {}
        for c in row.iter(f"{{{MAIN}}}c"):
            value = c.find(f"{{{MAIN}}}v")
            text = "".join(t.text or "" for t in c.iter(f"{{{MAIN}}}t")) if c.get("t") == "inlineStr" else value.text if value is not None else None
            if text is not None:
                cells[re.match("[A-Z]+", c.get("r", "A"))[0]] = shared[int(text)] if c.get("t") == "s" else text
        rows.append(cells)
    names = rows[0] if rows else {}
    return [{names[k]: v for k, v in cells.items() if k in names} for cells in rows[1:]]


def write_workbook(df: DataFrame, path: str) -> None:
    """Write ``df`` as one workbook; for tables of a bounded size, such as a leaderboard: more rows than a sheet holds are an error."""
    rows = [tuple(r) for r in df.limit(ROWS).collect()]
    write_bytes(df.sparkSession, path, workbook_bytes(df.columns, rows))


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A file of any store that Spark reaches."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(data)
    finally:
        out.close()


def read_workbooks(spark: SparkSession, paths: str | list[str], fields: dict[str, str]) -> DataFrame:
    """(file, ordinal, fields...) of all workbooks that match; ``fields`` name columns and Spark types, missing cells are null."""

    @F.pandas_udf("array<map<string,string>>")
    def rows_of(contents: pd.Series) -> pd.Series:
        return pd.Series([workbook_rows(c) for c in contents], dtype=object)

    files = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), rows_of("content").alias("rows"))
    rows = files.select("file", F.posexplode("rows").alias("ordinal", "row"))
    return rows.select("file", F.col("ordinal").cast("long").alias("ordinal"), *[F.try_element_at("row", F.lit(n)).cast(kind).alias(n) for n, kind in fields.items()])


def merge_workbooks(spark: SparkSession, folder: str, fields: dict[str, str]) -> DataFrame:
    """All workbooks of a folder in one table, those of special and similar cases last, with their place as ``at``."""
    rows = read_workbooks(spark, f"{folder}/*.xlsx", fields)
    name = F.element_at(F.split("file", "/"), -1)
    last = (name.contains("special") | name.contains("similar")).cast("int")
    return rows.withColumn("at", F.struct(last.alias("last"), name.alias("name"), "ordinal"))
