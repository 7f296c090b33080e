"""Files: intake of raw bytes, office documents, and the artifacts that stages leave."""

from __future__ import annotations

import csv
import io
import re
import threading
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from docloom.functions import encodings, mime
from docloom.functions.checks import stage_checks
from docloom.functions.text import language

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Two jobs of one process can store at once; a result's schema, and a log that both add to, are written by one at a time.
WRITES = threading.RLock()
BLOCKS = "path string, kind string, pos long, level int, text string, table_pos long, sheet string, headers array<string>, rows array<array<string>>, error string"


def raw_files(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Raw documents of a folder: path, length, modificationTime, content; as a stream, files that arrive."""
    reader = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if streaming else spark.read
    return reader.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def intake(files: DataFrame, tell: Callable[[Column], Column] = language) -> DataFrame:
    """Name, size, SHA-256, type, sub-structure, encoding and language (of text files, by `tell`) of each raw file, with its checks."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    df = files.select("path", name.alias("filename"), F.coalesce("length", F.lit(0)).alias("size_bytes"), F.sha2("content", 256).alias("sha256"), mime.extension(F.col("path")).alias("extension"), mime.mime(F.col("content"), F.col("path")).alias("mime"), "content")
    # office files and PDF tell their encoding by their type; of all others the text is read
    own = F.when(F.col("mime").contains("openxmlformats") | (F.col("mime") == "application/pdf"), mime.encoding(F.col("mime"), F.col("content")))
    df = df.withColumn("sub_structure", mime.sub_structure(F.col("mime"), F.col("content"))).withColumn("read", encodings.decoded(F.when(own.isNull(), F.col("content"))))
    df = df.withColumn("encoding", F.coalesce(own, "read.encoding", F.lit("unknown"))).withColumn("language", F.coalesce(tell(F.col("read.text")), F.lit("unknown"))).drop("content", "read")
    return df.withColumn("checks", F.concat(stage_checks("intake"), stage_checks("format")))


def _docx(book: zipfile.ZipFile):
    body = ElementTree.fromstring(book.read("word/document.xml")).find(f"{_W}body")
    pos = tables = 0
    for item in body if body is not None else ():
        if item.tag == f"{_W}p":
            text = "".join(t.text or "" for t in item.iter(f"{_W}t")).strip()
            style = item.find(f"{_W}pPr/{_W}pStyle")
            level = re.fullmatch(r"Heading ?(\d)", style.get(f"{_W}val", "")) if style is not None else None
            if text:
                yield {"kind": "block", "pos": pos, "level": int(level[1]) if level else 0, "text": text}
                pos += 1
        elif item.tag == f"{_W}tbl":
            rows = [["".join(t.text or "" for t in c.iter(f"{_W}t")) for c in r.findall(f"{_W}tc")] for r in item.findall(f"{_W}tr")]
            if rows:
                yield {"kind": "table", "table_pos": tables, "headers": rows[0], "rows": rows[1:]}
                tables += 1


def _pptx(book: zipfile.ZipFile):
    slides = sorted((int(m[1]), n) for n in book.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    for pos, (_, name) in enumerate(slides):
        paragraphs = ("".join(t.text or "" for t in p.iter(f"{_A}t")).strip() for p in ElementTree.fromstring(book.read(name)).iter(f"{_A}p"))
        if text := "\n".join(p for p in paragraphs if p):
            yield {"kind": "block", "pos": pos, "level": 0, "text": text}


def _xlsx(book: zipfile.ZipFile):
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    pos = 0
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_S}sheet"):
        path = targets[sheet.get(f"{_R}id")]
        root = ElementTree.fromstring(book.read(path.lstrip("/") if path.startswith("/") else f"xl/{path}"))
        for row in root.iter(f"{_S}row"):
            cells: list[str] = []
            for c in row.findall(f"{_S}c"):
                letters = re.match(r"[A-Z]*", c.get("r", ""))[0]
                at = 0
                for letter in letters:
                    at = at * 26 + ord(letter) - 64
                cells += [""] * ((at or len(cells) + 1) - 1 - len(cells))
                value = c.find(f"{_S}v")
                text = (value.text or "") if value is not None else "".join(t.text or "" for t in c.iter(f"{_S}t"))
                cells.append(shared[int(text)] if c.get("t") == "s" and text else text)
            yield {"kind": "sheet_row", "pos": int(row.get("r", pos + 1)), "sheet": sheet.get("name"), "rows": [cells]}
            pos += 1


_READERS = {"docx": _docx, "pptx": _pptx, "xlsx": _xlsx}


def office(files: DataFrame) -> DataFrame:
    """Blocks, tables and sheet rows of office files. A file that cannot be read gives one row with its error, and the others go on."""

    def run(batches):
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        for df in batches:
            for path, content in zip(df["path"], df["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as book:
                        found = list(_READERS[path.rpartition(".")[2].lower()](book))
                except (KeyError, ValueError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    found = [{"kind": "error", "error": f"{type(e).__name__}: {e}"[:200]}]
                if found:
                    out = pd.DataFrame({c: pd.Series([x.get(c) for x in found], dtype=object) for c in names})
                    out["path"] = path
                    yield out.astype({"pos": "Int64", "level": "Int32", "table_pos": "Int64"})

    return files.select("path", "content").mapInPandas(run, BLOCKS)


def _path(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delimited(files: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, table_pos, headers, rows) of files with separated values; the separator is told from the first lines. Rows beyond the header's width keep their cells, and a file of one column is no table."""

    def run(batches):
        for df in batches:
            out = []
            for k, t in zip(df["key"], df["text"], strict=True):
                try:
                    kind = csv.Sniffer().sniff((t or "")[:8192], ",;\t|")
                except csv.Error:
                    continue
                rows = [r for r in csv.reader(io.StringIO(t, newline=""), kind) if any(c.strip() for c in r)]
                if len(rows) > 1 and len(rows[0]) > 1:
                    out.append((k, 0, [c.strip() for c in rows[0]], [[c.strip() for c in r] for r in rows[1:]]))
            yield pd.DataFrame(out, columns=["key", "table_pos", "headers", "rows"])

    kind = dict(files.dtypes)[key]
    found = files.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInPandas(run, "key string, table_pos long, headers array<string>, rows array<array<string>>")
    return found.select(F.col("key").cast(kind).alias(key), "table_pos", "headers", "rows")


def write_artifact(df: DataFrame, root: str, key: str, job: str = "job_id", of: str | None = None) -> None:
    """Store a stage's result by job; a job's partition is replaced as a whole. With `of`, the one job that the rows are of, an empty result replaces its partition too.

    The schema is kept beside the rows, so a result without rows is read as one.
    """
    spark = df.sparkSession
    if of is not None:
        path, fs = _path(spark, f"{root}/{key}/{job}={of}")
        fs.delete(path, True)
    with WRITES:
        if _schema(spark, root, key) != df.schema:
            df.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{root}/_schemas/{key}")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(job).parquet(f"{root}/{key}")


def _schema(spark: SparkSession, root: str, key: str) -> StructType | None:
    kept, fs = _path(spark, f"{root}/_schemas/{key}")
    with WRITES:
        return spark.read.parquet(f"{root}/_schemas/{key}").schema if fs.exists(kept) else None


def has_artifact(spark: SparkSession, root: str, key: str) -> bool:
    """Whether a partition is there; Spark puts one in place as a whole when its job commits."""
    path, fs = _path(spark, f"{root}/{key}")
    return fs.exists(path) and any("=" in s.getPath().getName() for s in fs.listStatus(path))


def artifact_bytes(spark: SparkSession, root: str, key: str) -> int:
    path, fs = _path(spark, f"{root}/{key}")
    return fs.getContentSummary(path).getLength() if fs.exists(path) else 0


def append_artifact(df: DataFrame, root: str, key: str, job: str = "job_id") -> None:
    """Add rows to a stored result, as to a log."""
    with WRITES:
        df.write.mode("append").partitionBy(job).parquet(f"{root}/{key}")


def read_artifact(spark: SparkSession, root: str, key: str, job: str = "job_id") -> DataFrame | None:
    """A stored result, one without rows too, or None where there is none. The job's id is text, however it looks: 0012 is not 12."""
    schema = _schema(spark, root, key)
    if not has_artifact(spark, root, key):
        return None if schema is None else spark.createDataFrame([], schema)
    found = schema or spark.read.parquet(f"{root}/{key}").schema
    return spark.read.schema(StructType([StructField(f.name, StringType() if f.name == job else f.dataType) for f in found])).parquet(f"{root}/{key}")


def clear_artifact(spark: SparkSession, root: str, key: str) -> None:
    path, fs = _path(spark, f"{root}/{key}")
    fs.delete(path, True)
