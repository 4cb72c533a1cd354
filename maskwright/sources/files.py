"""Sources and sinks: decoded texts, office documents as rows, redacted outputs, CSV reports."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Text extensions that are taken as raw source (fixed values).
TEXT_EXTENSIONS = ("txt", "md", "csv", "tsv", "json", "xml")
#: Uncompressed bytes of one part of an office file beyond which it is refused.
PART_LIMIT = 256 << 20


@F.pandas_udf(StringType())
def _cp1252(content: pd.Series) -> pd.Series:
    """Western single-byte text; bytes that code page leaves open are taken as Latin-1."""

    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        try:
            return bytes(b).decode("cp1252")
        except UnicodeDecodeError:
            return bytes(b).decode("latin-1")

    return content.map(one)


def decode_bytes(content: Column) -> Column:
    """``struct<text, encoding, bom>``: null text for binary content (a NUL in the first 4 KiB), else by byte order mark, UTF-8 or windows-1252."""
    hexed = F.hex(F.substring(content, 1, 3))
    bom = hexed == "EFBBBF"
    nul = F.hex(F.substring(content, 1, 4096)).rlike("^(?:..)*00")
    body = F.when(bom, F.substring(content, F.lit(4), F.length(content))).otherwise(content)
    utf8 = F.is_valid_utf8(body.cast("binary").cast("string"))
    text = F.coalesce(F.when(utf8, F.decode(body, "UTF-8")), _cp1252(F.when(~utf8 & ~nul, body)))
    return F.struct(F.when(~nul, text).alias("text"), F.when(nul, "binary").when(utf8, "utf-8").otherwise("cp1252").alias("encoding"), bom.alias("bom"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, text, encoding, bom`` of all text files under a path."""
    files = spark.read.format("binaryFile").load(path).where(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*TEXT_EXTENSIONS))
    return files.select("path", decode_bytes(F.col("content")).alias("d")).select("path", "d.*")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _part(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    if name not in z.namelist():
        return None
    if z.getinfo(name).file_size > PART_LIMIT:
        raise ValueError(f"{name} is larger than {PART_LIMIT} bytes")
    return ElementTree.fromstring(z.read(name))


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx_cells(content: bytes) -> Iterator[tuple[str, int, int, str, bool]]:
    """(sheet, row, col, text, is_text) of non-empty cells, sheets in the workbook's order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = [_text(si) for si in (_part(z, "xl/sharedStrings.xml") if "xl/sharedStrings.xml" in z.namelist() else [])]
        links = {r.get("Id"): r.get("Target") for r in _part(z, "xl/_rels/workbook.xml.rels")}
        for sheet in (s for s in _part(z, "xl/workbook.xml").iter() if _local(s.tag) == "sheet"):
            target = links[next(v for k, v in sheet.attrib.items() if _local(k) == "id")].lstrip("/")
            root = _part(z, target if target.startswith("xl/") else f"xl/{target}")
            for row in (r for r in root.iter() if _local(r.tag) == "row"):
                for c in (c for c in row if _local(c.tag) == "c"):
                    kind, value = c.get("t"), next((v.text or "" for v in c if _local(v.tag) == "v"), "")
                    text = shared[int(value)] if kind == "s" and value else _text(c) if kind == "inlineStr" else value
                    if text:
                        yield sheet.get("name"), int(row.get("r")), _column(c.get("r")), text, kind in ("s", "inlineStr", "str")


def docx_paragraphs(content: bytes) -> Iterator[tuple[str, int, str]]:
    """(part, number, text) of non-empty paragraphs of the body, headers, footers and notes."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in ["word/document.xml", *sorted(n for n in z.namelist() if re.fullmatch(r"word/(header|footer|footnotes|endnotes|comments)\d*\.xml", n))]:
            root = _part(z, name)
            for i, p in enumerate(p for p in (root.iter() if root is not None else []) if _local(p.tag) == "p"):
                if text := _text(p):
                    yield name, i, text


def pptx_paragraphs(content: bytes) -> Iterator[tuple[str, int, str]]:
    """(part, number, text) of non-empty paragraphs of slides, then notes, in number order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = [n for n in z.namelist() if re.fullmatch(r"ppt/(slides/slide|notesSlides/notesSlide)\d+\.xml", n)]
        for name in sorted(names, key=lambda n: ("notes" in n, int(re.search(r"(\d+)\.xml", n)[1]))):
            for i, p in enumerate(p for p in _part(z, name).iter() if _local(p.tag) == "p"):
                if text := _text(p):
                    yield name, i, text


_READERS = {
    "xlsx": (xlsx_cells, "sheet string, row int, col int, text string, is_text boolean", (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_())),
    "docx": (docx_paragraphs, "part string, number int, text string", (pa.string(), pa.int32(), pa.string())),
    "pptx": (pptx_paragraphs, "part string, number int, text string", (pa.string(), pa.int32(), pa.string())),
}


def office_rows(files: DataFrame, kind: str) -> DataFrame:
    """Rows of office files given as ``path, content``; a file that cannot be read gives one row with null text."""
    reader, schema, types = _READERS[kind]
    names = ["path", *(f.split()[0] for f in schema.split(", "))]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = list(reader(content))
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, TypeError):
                    rows = [(None,) * len(types)]
                for lo in range(0, len(rows), 4096):
                    part = rows[lo : lo + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), *(pa.array(x, type=t) for x, t in zip(zip(*part, strict=True), types, strict=True))], names=names)

    return files.select("path", "content").mapInArrow(kernel, f"path string, {schema}")


def read_office(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return office_rows(spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").load(path), kind)


def write_report(df: DataFrame, path: str) -> None:
    """A report as CSV: semicolons, header, quotes where needed, CRLF is left to the reader."""
    df.write.option("header", True).option("sep", ";").option("quote", '"').option("escape", '"').mode("errorifexists").csv(path)


def write_texts(df: DataFrame, path: str, text_col: str = "text") -> None:
    """Texts as UTF-8 lines files, one row a record."""
    df.select(F.col(text_col).alias("value")).write.mode("errorifexists").text(path)


def unwrap_redirect(url: Column, parameter: str = "uddg") -> Column:
    """The target of a redirect link that carries it as a parameter, else the link."""
    return F.coalesce(F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(parameter))), url)


def is_public_ipv4(ip: Column) -> Column:
    """Whether a dotted quad is a global address (private, loopback, link-local, shared, multicast and reserved ranges are not)."""
    p = [F.split(ip, r"\.")[i].cast("int") for i in range(4)]
    private = (p[0].isin(0, 10, 127)) | ((p[0] == 172) & p[1].between(16, 31)) | ((p[0] == 192) & (p[1] == 168)) | ((p[0] == 169) & (p[1] == 254)) | ((p[0] == 100) & p[1].between(64, 127)) | ((p[0] == 198) & p[1].between(18, 19)) | (p[0] >= 224)
    return F.coalesce(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & ~private, F.lit(False))
