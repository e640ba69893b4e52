"""Documents from files, one a line, bundled or alone, plain or gzipped; and documents to files."""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.lexical import dumps, loads

READ = "body string, context string, error string"


def _documents(name: str, raw: bytes) -> Iterator[tuple[str | None, str, str | None]]:
    """(body, context, error): the content tells whether it is one document, a bundle or lines."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        yield None, name, "is not UTF-8"
        return
    try:
        value = loads(text)
    except ValueError:
        at, i = 0, 0
        while at <= len(text):  # line feeds alone end a line: others may stand in JSON
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            line, at, i = text[at:end], end + 1, i + 1
            if line.strip(" \t\r"):
                yield line, f"{name}:{i}", None
        return
    if not isinstance(value, dict) or "resourceType" not in value:
        yield None, name, "has no resourceType"
    elif value["resourceType"] == "Bundle":
        for i, entry in enumerate(value.get("entry", [])):
            if isinstance(entry, dict) and "resource" in entry:
                yield dumps(entry["resource"]), f"{name}#{i}", None
    else:
        yield text, name, None


def read(spark: SparkSession, path: str) -> DataFrame:
    """(body, context, error) of the files at ``path``: any mix of single documents, bundles and lines.

    A file is one task's, which holds its content, of a bundle also its values, and some of its documents
    at a time; large line files are better read with read_lines(), which splits them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one file at a time
                rows = _documents(batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                while some := list(islice(rows, 1024)):
                    columns = list(zip(*some, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["body", "context", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, READ)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(body, context, error) of line files, split over tasks as text is; names ending in .gz are unpacked."""
    rows = spark.read.text(path).select(F.col("value").alias("body"), F.col("_metadata.file_path").alias("context"))
    return rows.where(F.trim("body") != "").withColumn("error", F.lit(None).cast("string"))


def export(current: DataFrame, path: str, kinds: list[str] | None = None, compress: bool = False) -> None:
    """One document a line, by type and id; every file holds a range of them, in order of the files' names."""
    rows = current if kinds is None else current.where(F.col("rtype").isin(kinds))
    rows.orderBy("rtype", "id").select(F.col("resource").alias("value")).write.text(path, compression="gzip" if compress else "none")
