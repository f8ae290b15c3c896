"""Files as a table: upload checks, hashes, and text of office documents by their type."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Types that may be uploaded, and the largest file.
TYPES = ("pdf", "docx", "hwpx", "png", "jpg", "jpeg")
MAX_BYTES = 10 * 1024 * 1024
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def file_name(path: Column) -> Column:
    """The last part of a path with either kind of slash; a name of dots is none."""
    name = F.trim(F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1))
    return F.when(~name.isin("", ".", ".."), name)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder: path, filename, file_type, size, content_hash, content. Spark leaves empty files out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.select(
        "path", file_name(F.col("path")).alias("filename"), kind.alias("file_type"), F.col("length").alias("size"), F.sha2("content", 256).alias("content_hash"), "content"
    )


def checked(files: DataFrame) -> DataFrame:
    """With ``problem``: null, or why a file can't be taken. Of equal files the first by path is taken."""
    again = F.min("path").over(_same_content()) != F.col("path")
    problem = (
        F.when(F.col("filename").isNull(), "NAME")
        .when(~F.col("file_type").isin(*TYPES), "TYPE")
        .when(F.col("size") == 0, "EMPTY")
        .when(F.col("size") > MAX_BYTES, "TOO_LARGE")
        .when(again, "DUPLICATE")
    )
    return files.withColumn("problem", problem)


def _same_content():
    from pyspark.sql import Window

    return Window.partitionBy("content_hash")


def docx_text(data: bytes) -> tuple[str, int]:
    """Paragraphs and table rows in the order of the body, and pages by explicit breaks."""
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    lines = []
    for part in body if body is not None else ():
        if part.tag == f"{_W}p":
            lines.append(text(part))
        elif part.tag == f"{_W}tbl":
            for row in part.iter(f"{_W}tr"):
                lines.append(" | ".join("\n".join(text(p) for p in cell.iter(f"{_W}p")) for cell in row.iter(f"{_W}tc")))
    breaks = sum(b.get(f"{_W}type") == "page" for b in body.iter(f"{_W}br")) if body is not None else 0
    return "\n".join(x for x in lines if x.strip()), breaks + 1


def hwpx_text(data: bytes) -> tuple[str, int]:
    """Paragraphs of all sections by their numbers, and pages by page breaks."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    sections = [n for n in archive.namelist() if re.fullmatch(r"Contents/section\d+\.xml", n)]
    lines, breaks = [], 0
    for name in sorted(sections, key=lambda n: int(re.search(r"\d+", n)[0])):
        for p in ET.fromstring(archive.read(name)).iter():
            if p.tag.endswith("}p"):
                breaks += p.get("pageBreak") == "1"
                lines.append("".join(t.text or "" for t in p.iter() if t.tag.endswith("}t")))
    return "\n".join(x for x in lines if x.strip()), breaks + 1


#: Extractors by file type; others, as for images, can be added.
EXTRACTORS: dict[str, Callable[[bytes], tuple[str, int]]] = {"docx": docx_text, "hwpx": hwpx_text}


def extract_text(files: DataFrame, extractors: dict[str, Callable[[bytes], tuple[str, int]]] | None = None) -> DataFrame:
    """With content replaced by ``text``, ``page_count`` and ``error``; a broken file breaks no job."""
    known = dict(extractors or EXTRACTORS)

    @F.pandas_udf("text string, page_count int, error string")
    def run(kinds: pd.Series, contents: pd.Series) -> pd.DataFrame:
        rows = []
        for kind, data in zip(kinds, contents):
            try:
                rows.append((*known[kind](data), None))
            except KeyError:
                rows.append((None, None, "UNSUPPORTED_TYPE"))
            except Exception as e:  # noqa: BLE001  whatever a file holds
                rows.append((None, None, type(e).__name__))
        return pd.DataFrame(rows, columns=["text", "page_count", "error"])

    return files.withColumn("found", run("file_type", "content")).select("*", "found.*").drop("content", "found")
