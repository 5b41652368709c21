"""Sources: files of several kinds as payload rows, rejected ones with the reason, and the registry of kinds.

A payload has source (file name), content_type, content (text), ingest_ts, ingest_seq and error.  A CSV file gives a
payload per row, whose content is a JSON object of the row.  A source that can't be read is a row with `error`, so
that one bad file never ends a run.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from goldweave.plans.schemas import PAYLOAD

Reader = Callable[[SparkSession, list[str]], DataFrame]
READERS: dict[str, Reader] = {}
_NAMES = [c.split()[0] for c in PAYLOAD.split(", ")]
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def reader(*extensions: str) -> Callable[[Reader], Reader]:
    """Registers the decorated function for file extensions."""

    def add(f: Reader) -> Reader:
        READERS.update(dict.fromkeys(extensions, f))
        return f

    return add


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def extension_of(path: str) -> str:
    """The lower-cased extension; an unknown one is an error that lists the known."""
    found = (re.search(r"(\.[^./\\]+)$", path) or [""])[0].lower()
    if found not in READERS:
        raise ValueError(f"Unsupported file type '{found}' of {path}; supported: {', '.join(sorted(READERS))}")
    return found


def _payload(df: DataFrame, kind: str, content: Column, error: Column | None = None) -> DataFrame:
    """Payload columns, and `path`, the whole path, by which read() orders files of equal names."""
    return df.select(
        F.col("_metadata.file_path").alias("path"),
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source"),
        F.lit(kind).alias("content_type"),
        content.alias("content"),
        F.current_timestamp().alias("ingest_ts"),
        F.monotonically_increasing_id().alias("ingest_seq"),
        (error if error is not None else F.lit(None).cast("string")).alias("error"),
    )


def _whole(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Whole files as text, without a byte-order mark."""
    return spark.read.text(paths, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("value"), "_metadata")


def _header(spark: SparkSession, path: str) -> str:
    """The first line of a file, or of the first file with one in a folder; read by the driver without a job."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for one in fs.listStatus(top) if fs.getFileStatus(top).isDirectory() else [fs.getFileStatus(top)]:
        if one.isFile() and not one.getPath().getName().startswith(("_", ".")):
            lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(one.getPath()), "UTF-8"))
            try:
                if (line := lines.readLine()) is not None:
                    return line
            finally:
                lines.close()
    return ""


@reader(".csv")
def read_csv(spark: SparkSession, paths: list[str], first_row_only: bool = False) -> DataFrame:
    """A payload per row, all columns strings with lower-cased names; an empty file gives none.

    first_row_only: the first row of each file alone.  Files of one header are read together.
    """
    alike: dict[str, list[str]] = {}
    for path in paths:
        if header := _header(spark, path):
            alike.setdefault(header if not first_row_only else path, []).append(path)
    parts = []
    for own in alike.values():
        df = spark.read.options(header=True, multiLine=True, escape='"', encoding="UTF-8").csv(own[0])
        df = spark.read.options(header=True, multiLine=True, escape='"', encoding="UTF-8").schema(df.schema).csv(own) if len(own) > 1 else df
        named = [F.col(f"`{c}`").alias(c.strip().lower().lstrip("\ufeff")) for c in df.columns]
        parts.append(_payload(df.limit(1) if first_row_only else df, "csv", F.to_json(F.struct(*named))))
    return _union(spark, parts)


@reader(".json")
def read_json(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Whole documents; an empty file is {}; a malformed one has an error with line and column."""
    text = F.when(F.trim("value") == "", "{}").otherwise(F.col("value"))
    bad = F.try_parse_json(text).isNull() & (F.lower(F.trim(text)) != "null")
    return _payload(_whole(spark, paths), "json", text, F.when(bad, F.concat(F.lit("Malformed JSON: "), json_error(text))))


@F.pandas_udf(StringType())
def json_error(texts: pd.Series) -> pd.Series:
    """What is wrong with a JSON text and where; null for a good one."""
    import json

    def say(t: str | None) -> str | None:
        try:
            json.loads(t if t is not None else "")
        except json.JSONDecodeError as e:
            return f"{e.msg} at line {e.lineno}, column {e.colno}"

    return texts.map(say)


@reader(".txt", ".md", ".text")
def read_text(spark: SparkSession, paths: list[str]) -> DataFrame:
    return _payload(_whole(spark, paths), "txt", F.col("value"))


def docx_text(data: bytes) -> str:
    """Paragraphs of a document's body that aren't blank, a line each; tables are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    lines = ["".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in (body if body is not None else []) if p.tag == f"{_WORD}p"]
    return "\n".join(s for s in lines if s.strip())


def pdf_text(data: bytes) -> str:
    """Text of all pages around page marks: by the optional package pdfplumber, or else what simple content streams show."""
    try:
        import pdfplumber
    except ModuleNotFoundError:
        pages = shown_text(data)
    else:
        pages = []
        with pdfplumber.open(io.BytesIO(data)) as pdf:
            for page in pdf.pages:
                try:
                    pages.append(page.extract_text() or "")
                except Exception:  # a bad page costs its own text only
                    continue
    text = "\n--- PAGE BREAK ---\n".join(p for p in pages if p)
    return text or "[No text: the file may be a scanned image]"


_STRING = rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)"
_SHOWN = re.compile(rb"(" + _STRING + rb")\s*(Tj|'|\")|\[((?:" + _STRING + rb"|<[0-9A-Fa-f\s]*>|[^\]()])*)\]\s*TJ|<([0-9A-Fa-f\s]*)>\s*Tj|\b(T\*|Td|TD|Tm|ET)(?![A-Za-z*])", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(raw: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        c = m[1]
        return bytes([int(c, 8) & 255]) if c.isdigit() else b"" if c in (b"\n", b"\r\n") else _ESCAPES.get(c, c)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, raw[1:-1], flags=re.S)


def shown_text(data: bytes) -> list[str]:
    """The strings that each content stream shows, in its order and with its line steps; fonts of one byte a letter."""
    if not data.startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    pages = []
    for m in re.finditer(rb"<<((?:[^<>]|<<[^<>]*>>|<[0-9A-Fa-f\s]*>)*)>>\s*stream\r?\n", data):
        end = data.find(b"endstream", m.end())
        raw = data[m.end() : end if end >= 0 else len(data)]
        if b"/FlateDecode" in m[1]:
            try:
                raw = zlib.decompressobj().decompress(raw)
            except zlib.error:  # a bad stream costs its own text only
                continue
        elif b"/Filter" in m[1]:
            continue
        if b"BT" not in raw:
            continue
        out = b""
        for x in _SHOWN.finditer(raw):
            if x[5]:
                out += b"" if out.endswith(b"\n") or not out else b"\n"
            elif x[3] is not None:
                for piece in re.finditer(_STRING + rb"|<[0-9A-Fa-f\s]*>", x[3], re.S):
                    out += _literal(piece[0]) if piece[0][:1] == b"(" else bytes.fromhex(re.sub(rb"\s", b"", piece[0][1:-1]).decode().ljust(2, "0"))
            elif x[4] is not None:
                out += bytes.fromhex(re.sub(rb"\s", b"", x[4]).decode())
            else:
                out += (b"\n" if x[2] != b"Tj" and out and not out.endswith(b"\n") else b"") + _literal(x[1])
        if text := out.decode("cp1252", "replace").strip("\n"):
            pages.append(text)
    return pages


def _binary(spark: SparkSession, paths: list[str], kind: str, decode: Callable[[bytes], str]) -> DataFrame:
    def run(batches):
        for b in batches:
            texts, errors = [], []
            for data in b["content"]:
                try:
                    texts.append(decode(bytes(data)) if len(data) else "")
                    errors.append(None)
                except Exception as e:
                    texts.append(f"[Corrupt {kind} file]")
                    errors.append(f"{type(e).__name__}: {e}")
            yield b.assign(content=texts, error=errors)

    raw = spark.read.format("binaryFile").load(paths).select("path", F.element_at(F.split("path", "/"), -1).alias("source"), F.lit(kind).alias("content_type"), "content", F.current_timestamp().alias("ingest_ts"), F.monotonically_increasing_id().alias("ingest_seq"), F.lit(None).cast("string").alias("error"))
    return raw.mapInPandas(run, f"path string, {PAYLOAD}")


@reader(".docx")
def read_docx(spark: SparkSession, paths: list[str]) -> DataFrame:
    return _binary(spark, paths, "docx", docx_text)


@reader(".pdf")
def read_pdf(spark: SparkSession, paths: list[str]) -> DataFrame:
    return _binary(spark, paths, "pdf", pdf_text)


def in_memory(spark: SparkSession, items: list[tuple[str, str, str | bytes]]) -> DataFrame:
    """Payloads of (name, content type, text or bytes), in their order."""
    kinds = {"docx": docx_text, "pdf": pdf_text}
    rows = []
    for i, (name, kind, data) in enumerate(items):
        try:
            rows.append((name, kind, (kinds[kind](data) if kind in kinds else data.decode("utf-8", "replace")) if isinstance(data, bytes) else data, i, None))
        except Exception as e:
            rows.append((name, kind, None, i, f"{type(e).__name__}: {e}"))
    df = spark.createDataFrame(rows, "source string, content_type string, content string, ingest_seq bigint, error string")
    return df.withColumn("ingest_ts", F.current_timestamp()).select(*_NAMES)


def _union(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], PAYLOAD)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _plain(path: Column) -> Column:
    """A path as all readers write it: one slash after the scheme of local files, no marks for odd characters."""
    return F.try_url_decode(F.regexp_replace(F.replace(path, F.lit("+"), F.lit("%2B")), "^file:/+", "file:/"))


def read(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[str]]:
    """(payloads of all files in the order of `paths`, paths that don't exist): files of one kind are read together.

    Files are told apart by their whole paths, so two may have one name; a path may be a folder whose name has the extension.
    """
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    found, missing, order = {}, [], []
    for i, path in enumerate(paths):
        p = hadoop.Path(path)
        fs = p.getFileSystem(conf)
        if fs.exists(p):
            found.setdefault(extension_of(path), []).append(path)
            order.append((fs.makeQualified(p).toUri().getPath(), i))
        else:
            missing.append(path)
    if not found:
        return _union(spark, []), missing
    places = spark.createDataFrame(order, "at string, place bigint").groupBy("at").agg(F.min("place").alias("place"))
    all_rows = _union(spark, [READERS[ext](spark, own) for ext, own in found.items()]).withColumn("path", _plain(F.col("path")))
    # the path without scheme and host, as a file of its own or in a folder
    rows = all_rows.withColumn("path", F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")).withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    own, below = places.toDF("path", "own"), places.toDF("folder", "below")
    placed = rows.join(own, "path", "left").join(below, "folder", "left")
    return placed.withColumn("ingest_seq", F.coalesce("own", "below") * F.lit(1 << 40) + F.col("ingest_seq")).select(*_NAMES), missing
