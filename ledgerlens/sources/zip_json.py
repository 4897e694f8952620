"""JSON members of zip archives: one task reads an archive, which Spark's own reader opens."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def wanted(path: str) -> bool:
    """.json files outside any resource-fork folder, no dot-files."""
    return path.lower().endswith(".json") and "__MACOSX/" not in path and not path.rsplit("/", 1)[-1].startswith(".")


def _members(archive: str, content: bytes) -> Iterator[tuple[str, str | None, str | None]]:
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        yield archive, None, None
        return
    with z:
        for i in z.infolist():
            if i.file_size and wanted(i.filename):
                try:
                    text = z.read(i).decode("utf-8", "replace")
                except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError):  # damaged, locked or of an unknown kind
                    text = None
                yield archive, i.filename, text


def read_zip_json(spark: SparkSession, path: str) -> DataFrame:
    """(archive, path, text) of each JSON member that is not empty, read in one pass. A member that cannot be
    read has a null text; an archive that cannot be opened gives a row with a null path and text."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for archive, content in zip(b["path"], b["content"], strict=True):
                yield pd.DataFrame(list(_members(archive, content)), columns=["archive", "path", "text"], dtype=object)

    return files.mapInPandas(run, "archive string, path string, text string")
