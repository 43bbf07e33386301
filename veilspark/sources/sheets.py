"""Sheets and delimited files as cell rows (file, sheet, r, c, value, data_type): readers, header discovery, sinks."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.dialect import stripped
from veilspark.functions.normalize import normalize_header, title_key

CELLS = "file string, sheet string, r int, c int, value string, data_type string"
# Header names of each role; the delimited reader knows fewer code names.
CODE_CSV = ("код autodocs", "код автодокс", "код", "autodocs", "код мтр")
ROLES = {
    "code": (*CODE_CSV, "код ресурса", "№ смет/ код ресурса", "№ смет / код ресурса"),
    "name": ("наименование", "наименование мтр", "мтр", "описание"),
    "factory": ("завод", "изготовитель", "производитель", "поставщик", "завод/изготовитель/поставщик"),
    "anon": ("обезличенное наименование", "обезличенное", "результат"),
    "status": ("статус", "статус обезличивания"),
}
HEADER_ROWS, HEADER_COLUMNS, SNIFFED = 30, 100, 5000
TITLES = ("готово", "выборка оборудования")
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def _xlsx_cells(data: bytes):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS):
            target = links[sheet.get(f"{{{_NS['r']}}}id")].lstrip("/")
            for cell in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{{{_NS['m']}}}c"):
                letters, row = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r")).groups()
                column = 0
                for ch in letters:
                    column = column * 26 + ord(ch) - 64
                kind, v = cell.get("t", "n"), cell.find("m:v", _NS)
                value = "".join(t.text or "" for t in cell.iter(f"{{{_NS['m']}}}t")) if kind == "inlineStr" else (v.text if v is not None else None)
                if value is not None:
                    yield sheet.get("name"), int(row), column, shared[int(value)] if kind == "s" else value, kind


def delimited_rows(data: bytes) -> tuple[list[list[str]], type[csv.Dialect]]:
    """(rows, dialect) of a delimited file: UTF-8 or cp1251, separator sniffed among ; , and tab."""
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = data.decode("cp1251")
    if not text.strip():
        raise ValueError("the file has no rows")
    dialect = csv.Sniffer().sniff(text[:SNIFFED], delimiters=";,\t")
    return list(csv.reader(text.splitlines(), dialect)), dialect


def _csv_cells(data: bytes):
    for r, row in enumerate(delimited_rows(data)[0], 1):
        for c, value in enumerate(row, 1):
            yield "", r, c, value, "s"


def raw_files(spark: SparkSession, path: str, pattern: str, outputs: bool = True) -> DataFrame:
    """(path, content) of the files under a path, with or without outputs of earlier runs."""
    name = F.regexp_extract("path", r"([^/\\]*)$", 1)
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return found if outputs else found.where(~F.lower(name).rlike(r"_обезличено\.[^.]*$"))


def _read(spark: SparkSession, path: str, pattern: str, parse, outputs: bool) -> DataFrame:
    files = raw_files(spark, path, pattern, outputs)

    def cells(batches):
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = [(file, *c) for c in parse(content)]
                except Exception as why:  # noqa: BLE001 - one bad file never stops the batch
                    rows = [(file, None, None, None, f"{type(why).__name__}: {why}", "failed")]
                yield pd.DataFrame(rows, columns=[f.split()[0] for f in CELLS.split(", ")])

    # the reader passes over files without a byte; its listing has them
    listed = spark.createDataFrame([(re.sub("^file:/+", "file:/", unquote(f)),) for f in files.inputFiles()], "file string")
    empty = listed.where(listed["file"].rlike(r"_обезличено\.[^.]*$") == F.lit(False)) if not outputs else listed
    empty = empty.join(files.select(F.col("path").alias("file")), "file", "left_anti")
    failed = empty.select("file", *(F.lit(None).cast(t).alias(c) for c, t in (("sheet", "string"), ("r", "int"), ("c", "int"))), F.lit("the file is empty").alias("value"), F.lit("failed").alias("data_type"))
    return files.mapInPandas(cells, CELLS).unionByName(failed)


def read_workbooks(spark: SparkSession, path: str, outputs: bool = True) -> DataFrame:
    """Cells of all .xlsx and .xlsm files; a file that fails gives one row of type 'failed'."""
    return _read(spark, path, "*.[xX][lL][sS][xXmM]", _xlsx_cells, outputs)


def read_delimited(spark: SparkSession, path: str, outputs: bool = True) -> DataFrame:
    """Cells of all .csv files: UTF-8 or cp1251, separator sniffed among ; , and tab."""
    return _read(spark, path, "*.[cC][sS][vV]", _csv_cells, outputs)


def select_sheets(cells: DataFrame) -> DataFrame:
    """Sheets that a file is processed by: 'готово', else 'выборка оборудования', else all."""
    key = title_key(F.col("sheet"))
    ranked = cells.select("file", "sheet").distinct().withColumn("rank", F.when(key == TITLES[0], 0).when(key == TITLES[1], 1).otherwise(2))
    best = ranked.groupBy("file").agg(F.min("rank").alias("rank"))
    return ranked.join(best, ["file", "rank"]).select("file", "sheet")


def find_headers(cells: DataFrame, code_names: tuple[str, ...] = ROLES["code"]) -> DataFrame:
    """(file, sheet, r, code, name, factory, anon, status): the first row with a name and a code or factory column."""
    h = normalize_header(F.col("value"))
    role = F.lit(None).cast("string")
    for kind, names in ROLES.items():
        role = F.when(h.isin(*(code_names if kind == "code" else names)), kind).otherwise(role)
    found = cells.where((F.col("r") <= HEADER_ROWS) & (F.col("c") <= HEADER_COLUMNS)).withColumn("role", role).where("role is not null")
    rows = found.groupBy("file", "sheet", "r").agg(*[F.min(F.when(F.col("role") == k, F.col("c"))).alias(k) for k in ROLES])
    rows = rows.where("name is not null and (code is not null or factory is not null)")
    return rows.groupBy("file", "sheet").agg(F.min(F.struct("r", *ROLES)).alias("h")).select("file", "sheet", "h.*")


def item_rows(cells: DataFrame, headers: DataFrame, workbook: bool = True) -> DataFrame:
    """Items (file, sheet, r, name, code, factory) below the header; skips blanks, errors and a second header of numbers."""
    below = cells.join(headers.select("file", "sheet", F.col("r").alias("h"), "code", "name", "factory"), ["file", "sheet"]).where("r > h")
    at = lambda role: stripped(F.coalesce(F.max(F.when(F.col("c") == F.col(role), F.col("value"))), F.lit("")))
    rows = below.groupBy("file", "sheet", "r", "h").agg(at("name").alias("item"), at("code").alias("item_code"), at("factory").alias("item_factory"), F.max(F.when(F.col("c") == F.col("name"), F.col("data_type"))).alias("kind"))
    rows = rows.where("item <> ''")
    if workbook:
        rows = rows.where(F.coalesce("kind", F.lit("")) != "e").where(~F.col("item").rlike(r"(?i)^#[A-Z0-9/?!._-]+$")).where(~((F.col("r") <= F.col("h") + 5) & F.col("item_code").isin("1", "2") & F.col("item").isin("3", "4")))
    return rows.select("file", "sheet", "r", F.col("item").alias("name"), F.col("item_code").alias("code"), F.col("item_factory").alias("factory"))
