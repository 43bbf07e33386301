"""Workbook sink: results placed among the cells of their sheets, and the cells of each file as one .xlsx.

Cells are rows (file, sheet, r, c, value, data_type) as the readers give them, plus `fill`, a colour or null. A workbook
is put together by one task: the format bounds its size. Sheets stand in the order of their names.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.operators.audit import FILLS, output_path, with_fill

# Titles of the two result columns, colour of their headers, widths.
RESULT, STATUS, HEADER_FILL = "Обезличенное наименование", "Статус", "D9EAF7"
WIDTHS = {RESULT: 40, STATUS: 15}
_COLOURS = (HEADER_FILL, *FILLS.values())
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


def place_results(cells: DataFrame, headers: DataFrame, results: DataFrame) -> DataFrame:
    """Cells plus results (file, sheet, r, text, status): result and status columns are reused or added, the factory is blanked."""
    key = ["file", "sheet"]
    width = cells.groupBy(*key).agg(F.max("c").alias("w"))
    anon = F.coalesce("anon", F.col("w") + 1)
    at = headers.join(width, key).select(
        *key, F.col("r").alias("h"), "code", "factory", anon.alias("result_c"), F.coalesce("status", F.greatest("w", anon) + 1).alias("status_c"),
        F.when(F.col("anon").isNull(), RESULT).alias("result_title"), F.when(F.col("status").isNull(), STATUS).alias("status_title"),
    )
    none = F.lit(None).cast("string")
    cell = lambda c, value, fill: F.struct(c.cast("int").alias("c"), value.alias("new"), fill.alias("fill"))
    head = at.select(*key, F.col("h").alias("r"), F.explode(F.array(cell(F.col("result_c"), F.col("result_title"), F.lit(HEADER_FILL)), cell(F.col("status_c"), F.col("status_title"), F.lit(HEADER_FILL)))).alias("x"))
    rows = with_fill(results.select(*key, "r", "text", "status")).join(at, key)
    body = rows.select(*key, "r", F.explode(F.array(
        cell(F.col("result_c"), F.col("text"), none), cell(F.col("status_c"), results["status"], F.col("fill")), cell(F.col("code"), none, F.col("fill")), cell(F.col("factory"), F.lit(""), none),
    )).alias("x"))
    put = head.unionByName(body).select(*key, "r", "x.*").where("c is not null")
    out = cells.select(*key, "r", "c", "value", "data_type").join(put, [*key, "r", "c"], "full")
    return out.select(*key, "r", "c", F.coalesce("new", "value").alias("value"), F.when(F.col("new").isNotNull(), "s").otherwise(F.coalesce("data_type", F.lit("s"))).alias("data_type"), "fill")


def _letters(c: int) -> str:
    out = ""
    while c:
        c, rest = divmod(c - 1, 26)
        out = chr(65 + rest) + out
    return out


def _cell(r: int, c: int, value: str | None, kind: str, fill: str | None) -> str:
    head = f'<c r="{_letters(c)}{r}"' + (f' s="{_COLOURS.index(fill) + 1}"' if fill in _COLOURS else "")
    if value is None or value == "":
        return head + "/>"
    text = escape(_ILLEGAL.sub("", value))
    if kind in ("n", "b", "e"):
        return head + (f' t="{kind}"' if kind != "n" else "") + f"><v>{text}</v></c>"
    return head + f' t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def _sheet(cells: pd.DataFrame) -> str:
    wide = {int(c): WIDTHS[v] for c, v, f in zip(cells["c"], cells["value"], cells["fill"]) if f == HEADER_FILL and v in WIDTHS}
    columns = "".join(f'<col min="{c}" max="{c}" width="{w}" customWidth="1"/>' for c, w in sorted(wide.items()))
    rows = []
    for r, row in cells.sort_values(["r", "c"]).groupby("r", sort=True):
        rows.append(f'<row r="{r}">' + "".join(_cell(int(r), int(c), v if isinstance(v, str) else None, k, f) for c, v, k, f in zip(row["c"], row["value"], row["data_type"], row["fill"])) + "</row>")
    return f'{_HEAD}<worksheet xmlns="{_MAIN}">' + (f"<cols>{columns}</cols>" if columns else "") + f'<sheetData>{"".join(rows)}</sheetData></worksheet>'


def workbook_bytes(cells: pd.DataFrame) -> bytes:
    """One .xlsx of the cells of one file."""
    names = sorted(cells["sheet"].unique())
    fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>' for c in _COLOURS)
    styles = "".join(f'<xf fontId="{int(n == 0)}" fillId="{n + 2}" borderId="0" applyFont="1" applyFill="1"' + (' applyAlignment="1"><alignment horizontal="center" vertical="center"/></xf>' if n == 0 else "/>") for n in range(len(_COLOURS)))
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(names) + 1)) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        + f'<Relationship Id="rId{len(names) + 1}" Type="{_REL}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{_MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="{len(_COLOURS) + 2}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fills}</fills>'
        f'<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{len(_COLOURS) + 1}"><xf/>{styles}</cellXfs></styleSheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in parts.items():
            z.writestr(name, xml if name.startswith("xl/worksheets") else _HEAD + xml)
        for i, name in enumerate(names, 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", _sheet(cells[cells["sheet"] == name]))
    return out.getvalue()


def workbooks(cells: DataFrame) -> DataFrame:
    """(path, content): one row a file, named as an output of it, ready for any store."""
    plain = cells if "fill" in cells.columns else cells.withColumn("fill", F.lit(None).cast("string"))
    made = plain.groupBy("file").applyInPandas(lambda key, part: pd.DataFrame({"file": [key[0]], "content": [workbook_bytes(part)]}), "file string, content binary")
    return made.select(output_path(F.col("file")).alias("path"), "content")


def save_workbooks(files: DataFrame, folder: str) -> None:
    """Write rows (path, content) under their base names to a folder that all executors share; a repeated task replaces its files."""

    def save(rows) -> None:
        import os
        import uuid

        for row in rows:
            target = os.path.join(folder, re.split(r"[/\\]", row["path"])[-1])
            part = f"{target}.{uuid.uuid4().hex}.part"
            with open(part, "wb") as out:
                out.write(row["content"])
            os.replace(part, target)

    files.foreachPartition(save)
