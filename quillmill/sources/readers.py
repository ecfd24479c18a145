"""Inputs: texts, folders of notes, addresses; and Markdown output."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank
from . import html


def text_rows(rows: DataFrame, text: str) -> DataFrame:
    """Rows with text; null and blank ones are refused."""
    return rows.where(~is_blank(F.col(text)))


def is_web_address(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://[^\s/]+", 1)).isin("http", "https"), F.lit(False))


def in_folder(path: Column, folder: str, empty_means_all: bool = False) -> Column:
    """Whether a path is the folder or inside it; folders that only share a beginning don't count."""
    if not folder:
        return F.lit(empty_means_all)
    return (path == folder) | F.startswith(path, F.lit(folder + "/"))


def notes_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content, mtime) of Markdown and text files below a folder; the reader's glob keeps others out."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,txt}").text(folder)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("mtime"))


def fetched(rows: DataFrame, url: str, fetch: Callable[[str], str | None], render: Callable[[str], str | None] | None = None) -> DataFrame:
    """Rows with the read result of their address; ``fetch`` and ``render`` (a second try for pages that need scripts) run on the workers."""
    schema = rows.select("*", F.lit(None).cast(html.RESULT).alias("read")).schema

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            results = []
            for address in batch[url]:
                try:
                    result = html.extract(fetch(address))
                except OSError:
                    result = html.extract(None)
                if result["error_code"] == "REQUIRES_JS" and render and len((text := render(address) or "").strip()) > 50:
                    title, body = html.reader_text(text)
                    result = result | {"success": True, "content": body, "title": title or result["title"], "error_code": None}
                results.append(result)
            yield batch.assign(read=results)

    return rows.mapInPandas(load, schema)


def write_markdown(notes: DataFrame, file: str, body: str, folder: str) -> None:
    """One Markdown file per row with a name, in a folder that all executors share (an address of any file system that Arrow knows, or a
    path). Each file is written under a name of its own attempt and then moved, so tasks may be tried again. Rows without a name are left out."""

    def save(rows: Iterator) -> None:
        import uuid

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(root, recursive=True)
        for row in rows:
            trial = f"{root}/.{uuid.uuid4().hex}.part"
            with system.open_output_stream(trial) as out:
                out.write(row[body].encode("utf8"))
            system.move(trial, f"{root}/{row[file]}.md")

    notes.where(F.col(file).isNotNull()).select(file, body).foreachPartition(save)
