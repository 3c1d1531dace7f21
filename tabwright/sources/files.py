"""File sources: CSV with encoding / separator detection, Excel workbooks, file admission.

- ``read_csv_auto``: one distributed pass decides the encoding (every line valid
  UTF-8 -> UTF-8, otherwise ISO-8859-1, which decodes any byte); the first
  line alone decides the separator (one column with ';' in the header -> ';').
- ``read_excel``: ``binaryFile`` + ``mapInPandas``, one workbook per task,
  parsed with the standard library (zip + XML) - first sheet, first row as
  header, values as text; ``infer_types`` applies the type advice.
- ``admit_files``: size and extension rules on ``binaryFile`` metadata only
  (``path``, ``length``; the content column is pruned from the scan).
"""

from __future__ import annotations

import io
import re
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.columns import normalize_nan

ALLOWED = ("csv", "xlsx", "xls")  # fixed value: accepted upload extensions
MAX_UPLOAD_MB = 500  # fixed value: upload size limit


def _ext(path: str) -> str:
    return path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""


def detect_encoding(spark: SparkSession, path: str) -> str:
    ok = spark.read.text(path).agg(F.bool_and(F.is_valid_utf8("value")).alias("ok")).first()["ok"]
    return "UTF-8" if ok in (True, None) else "ISO-8859-1"


def detect_separator(spark: SparkSession, path: str, encoding: str) -> str:
    first = spark.read.option("encoding", encoding).csv(path, sep="\u0001").limit(1).collect()
    head = first[0][0] if first and first[0][0] is not None else ""
    return ";" if ("," not in head and ";" in head) else ","


def read_csv_auto(spark: SparkSession, path: str, schema=None, multiline: bool = True) -> DataFrame:
    """CSV with encoding and separator found out; quotes are doubled inside quotes.

    ``multiline`` lets quoted values hold line ends, as uploaded files may; a file is then one task. Turn it off for
    large files without such values, which are then split.
    """
    enc = detect_encoding(spark, path)
    sep = detect_separator(spark, path, enc)
    r = (spark.read.option("header", True).option("encoding", enc).option("sep", sep).option("quote", '"')
         .option("escape", '"').option("multiLine", multiline))
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return normalize_nan(r.csv(path))


def load_file(spark: SparkSession, path: str) -> DataFrame:
    """Dispatch on the extension; unsupported types raise before any job runs."""
    e = _ext(path)
    if e == "csv":
        return read_csv_auto(spark, path)
    if e == "xlsx":
        return read_excel(spark, path)
    if e == "xls":
        raise ValueError("legacy .xls workbooks are not supported; save as .xlsx")
    raise ValueError(f"Unsupported file type: .{e}" if e else "Unsupported file type")


# ---------------------------------------------------------------- xlsx

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _first_sheet(z: zipfile.ZipFile) -> str | None:
    """Part name of the first sheet in the workbook's order (else the lowest-numbered sheet part)."""
    names = z.namelist()
    if "xl/workbook.xml" in names and "xl/_rels/workbook.xml.rels" in names:
        sheet = ET.fromstring(z.read("xl/workbook.xml")).find("m:sheets/m:sheet", _NS)
        rid = sheet.get(_REL_ID) if sheet is not None else None
        for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")):
            target = r.get("Target", "").lstrip("/")
            target = target if target.startswith("xl/") else f"xl/{target}"
            if r.get("Id") == rid and target in names:
                return target
    sheets = [n for n in names if re.match(r"xl/worksheets/sheet\d+\.xml$", n)]
    return min(sheets, key=lambda n: int(re.search(r"(\d+)\.xml$", n).group(1)), default=None)


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Cell styles whose number format is a date or time."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    dates = set(range(14, 23)) | {45, 46, 47}  # fixed values: built-in date and time formats
    for f in root.iter(f"{{{_NS['m']}}}numFmt"):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")).lower()
        if re.search(r"[ydhs]", code):
            dates.add(int(f.get("numFmtId")))
    xfs = root.find("m:cellXfs", _NS)
    return {i for i, x in enumerate(xfs if xfs is not None else []) if int(x.get("numFmtId", 0)) in dates}


def _serial_date(text: str) -> str:
    """A date serial number as text: days since 1899-12-30."""
    at = datetime(1899, 12, 30) + timedelta(seconds=round(float(text) * 86400))
    return at.strftime("%Y-%m-%d") if float(text).is_integer() else at.strftime("%Y-%m-%d %H:%M:%S")


def header_names(head: list[str | None]) -> list[str]:
    """Column names by position: blank ones by their number, repeats with a suffix."""
    out: list[str] = []
    for i, h in enumerate(head):
        base = name = str(h).strip() if h is not None and str(h).strip() else f"Unnamed: {i}"
        k = 0
        while name in out:
            k += 1
            name = f"{base}.{k}"
        out.append(name)
    return out


def parse_xlsx(content: bytes) -> list[list[str | None]]:
    """Rows of the workbook's first sheet as text (shared strings resolved, inline strings read, dates as ISO text)."""
    z = zipfile.ZipFile(io.BytesIO(content))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        root = ET.fromstring(z.read("xl/sharedStrings.xml"))
        for si in root.findall("m:si", _NS):
            shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
    first = _first_sheet(z)
    if first is None:
        return []
    dates = _date_styles(z)
    root = ET.fromstring(z.read(first))
    rows = []
    for row in root.iter(f"{{{_NS['m']}}}row"):
        cells: dict[int, str | None] = {}
        for c in row.findall("m:c", _NS):
            idx = _col_index(c.get("r", "A1"))
            t = c.get("t")
            v = c.find("m:v", _NS)
            if t == "s" and v is not None:
                val = shared[int(v.text)]
            elif t == "inlineStr":
                val = "".join(x.text or "" for x in c.iter(f"{{{_NS['m']}}}t"))
            else:
                val = v.text if v is not None else None
                if val is not None and t in (None, "n") and int(c.get("s", 0)) in dates:
                    val = _serial_date(val)
            cells[idx] = val
        if cells:
            width = max(cells) + 1
            rows.append([cells.get(i) for i in range(width)])
    return rows


def _widened(rows: list[list[str | None]]) -> list[str | None]:
    """The header row, as long as the longest row."""
    return rows[0] + [None] * (max(map(len, rows)) - len(rows[0]))


def read_excel(spark: SparkSession, path: str, infer_types: bool = True) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def headers(it):
        for pdf in it:
            for content in pdf["content"]:
                rows = parse_xlsx(bytes(content))
                yield pd.DataFrame({"h": [header_names(_widened(rows)) if rows else []]})

    hs = files.mapInPandas(headers, "h array<string>").collect()  # one header per workbook
    names: list[str] = []
    for r in hs:
        for h in r["h"]:
            if h not in names:
                names.append(h)
    if not names:
        raise ValueError("the workbook has no header")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])

    def body(it):
        for pdf in it:
            for content in pdf["content"]:
                rows = parse_xlsx(bytes(content))
                if not rows:
                    continue
                head = header_names(_widened(rows))
                data = {n: [] for n in names}
                for r in rows[1:]:
                    m = dict(zip(head, r, strict=False))
                    for n in names:
                        data[n].append(m.get(n))
                yield pd.DataFrame(data, columns=names)

    df = files.mapInPandas(body, schema)
    if infer_types:
        from tabwright.operators.types import apply_types, suggest_types
        df = apply_types(df, suggest_types(df))
    return df


def admit_files(spark: SparkSession, path: str, max_mb: float = MAX_UPLOAD_MB,
                allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """``(path, size_mb, extension, accepted, reason)`` for every file under ``path``."""
    meta = spark.read.format("binaryFile").load(path).select("path", "length")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    size = F.col("length") / F.lit(1024.0 * 1024.0)
    reason = (F.when(~ext.isin(list(allowed)), F.concat(F.lit("extension not allowed: "), ext))
              .when(size > F.lit(float(max_mb)), F.lit(f"file larger than {max_mb} MB")))
    return meta.select("path", size.alias("size_mb"), ext.alias("extension"), reason.isNull().alias("accepted"),
                       reason.alias("reason"))
