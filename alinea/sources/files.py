"""File sources and sinks: CSV registers, JSON lines, marked text, PDF and downloaded pages, and keyed caches."""

from __future__ import annotations

import io
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from alinea.operators.records import encode

#: Answers that are final, tries, and seconds.
FINAL_STATUS, TRIES, TIMEOUT, PAUSE = {401, 403, 404, 410}, 3, 45, 2


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header as text columns; quoted line breaks, doubled quotes and a byte order mark are understood."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8", inferSchema=False)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``df`` as CSV with a header, encoded as text; committed as a whole by Spark's output committer."""
    encode(df).write.mode(mode).csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="")


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines by an explicit schema; blank lines give no row, a missing path raises, a line that is no JSON gives nulls."""
    return spark.read.schema(schema).json(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path, ignoreNullFields=False)


def read_marked_text(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, text`` of whole text files, named after their files."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("doc_id"), F.col("value").alias("text"))


def read_vectors(spark: SparkSession, path: str, key: str, vector: str) -> DataFrame:
    """Vectors kept as Parquet arrays: ``key`` and ``vector`` as an array of floats, null ones left out."""
    return spark.read.parquet(path).where(F.col(vector).isNotNull()).withColumn(vector, F.col(vector).cast("array<float>")).select(key, vector)


def _pdf_reader() -> Callable[[bytes], list[str]]:
    try:
        import pdfplumber

        def read(data: bytes) -> list[str]:
            with pdfplumber.open(io.BytesIO(data)) as pdf:
                return [p.extract_text() or "" for p in pdf.pages]
    except ImportError:
        try:
            import pypdf
        except ImportError as e:
            raise ImportError("reading PDF needs pdfplumber or pypdf") from e

        def read(data: bytes) -> list[str]:
            return [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(data)).pages]
    return read


def pdf_pages(files: DataFrame, reader: Callable[[], Callable[[bytes], list[str]]] = _pdf_reader) -> DataFrame:
    """``path, page, body`` of PDF files (``path, content``, as Spark's binary source gives them); unreadable ones give no rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = reader()
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    bodies = read(bytes(content))
                except Exception:
                    bodies = []
                if bodies:
                    yield pd.DataFrame({"path": [path] * len(bodies), "page": range(1, len(bodies) + 1), "body": bodies}).astype({"page": "int32"})

    return files.select("path", "content").mapInPandas(run, "path string, page int, body string")


def page_counts(files: DataFrame, reader: Callable[[], Callable[[bytes], list[str]]] = _pdf_reader) -> DataFrame:
    """``path, n_pages``, 0 for unreadable files."""
    counted = pdf_pages(files, reader).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return files.select("path").join(counted, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("n_pages"))


def _open(url: str) -> tuple[bytes, int, str]:
    with urllib.request.urlopen(url, timeout=TIMEOUT) as r:
        return r.read(), r.status, r.headers.get("Content-Type", "")


def download(rows: DataFrame, key: str, url: str, opener: Callable[[str], tuple[bytes, int, str]] = _open, pause: float = PAUSE) -> DataFrame:
    """``key, content, status, content_type, sha256`` of each URL: three tries with growing pauses, none after a final status.

    A failed row has null content and its last status, 0 without one. Null URLs are left out.
    """
    kind = dict(rows.dtypes)[key]

    def fetch(address: str):
        status = 0
        for t in range(1, TRIES + 1):
            try:
                return opener(address)
            except urllib.error.HTTPError as e:
                status = e.code
                if status in FINAL_STATUS:
                    break
            except OSError:
                status = 0
            if t < TRIES:
                time.sleep(pause * t)
        return None, status, ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [fetch(u) for u in pdf[url]]
            yield pd.DataFrame({key: pdf[key], "content": pd.Series([g[0] for g in got], dtype=object), "status": pd.Series([g[1] for g in got], dtype="int32"), "content_type": [g[2] for g in got]})

    out = rows.select(key, url).where(F.col(url).isNotNull()).mapInPandas(run, f"`{key}` {kind}, content binary, status int, content_type string")
    return out.withColumn("sha256", F.sha2("content", 256))


def fetch_states(fetched: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """``fetched`` (of ``download``) with ``state``: failed, drifted (another digest than the recorded one) or ok. ``recorded``: key, sha256."""
    before = recorded.select(key, F.col("sha256").alias("_before"))
    state = F.when(F.col("content").isNull(), "failed").when(F.col("_before").isNotNull() & (F.col("_before") != F.col("sha256")), "drifted").otherwise("ok")
    return fetched.join(before, key, "left").withColumn("state", state).drop("_before")


def keep_raw(rows: DataFrame, key: str, content: str, extension: str, folder: str) -> DataFrame:
    """``key, path, bytes`` of raw contents written as files to ``folder``, which all executors share, by the rows' ``extension`` (``bin`` for unknown ones).

    A file is written under another name and then moved, so that a repeated task leaves whole files. Null contents are left out.
    """
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, data, kind in zip(pdf[key], pdf[content], pdf[extension]):
                path = os.path.join(folder, f"{k}.{kind if isinstance(kind, str) and kind.isalnum() and kind != 'unknown' else 'bin'}")
                part = f"{path}.{os.getpid()}.part"
                with open(part, "wb") as f:
                    f.write(bytes(data))
                os.replace(part, path)
                out.append((k, path, len(data)))
            yield pd.DataFrame(out, columns=[key, "path", "bytes"])

    os.makedirs(folder, exist_ok=True)
    return rows.where(F.col(content).isNotNull()).select(key, content, extension).mapInPandas(run, f"`{key}` {kinds[key]}, path string, bytes bigint")


def still_to_fetch(rows: DataFrame, held: DataFrame, key: str, url: str, force: bool = False) -> DataFrame:
    """Rows with a URL whose key isn't held yet; all with a URL if forced."""
    there = rows.where(F.col(url).isNotNull() & (F.trim(url) != ""))
    return there if force else there.join(held.select(key), key, "left_anti")


def cached(make: Callable[[], DataFrame], root: str, fingerprint: str, spark: SparkSession) -> DataFrame:
    """The table under ``root`` for ``fingerprint``; made and written if it isn't complete there."""
    path = f"{root.rstrip('/')}/fingerprint={fingerprint}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    done = hadoop.Path(path, "_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
