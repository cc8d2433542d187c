"""Loaders of documents and writers of results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.errors import DocumentLoadError

DOCUMENT = "source_file string, file_hash string, text string, title string, author string, creation_date string, page_count int, error string"


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """The ``.md`` files under ``path``, of any case, as ``source_file, file_hash, text``; one read gives text and hash.
    Spark lists no file of zero bytes, so an empty file gives no row; it would give no chunk either."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,MD,Md,mD}").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("source_file"), F.sha2("content", 256).alias("file_hash"), F.coalesce(F.decode("content", "UTF-8"), F.lit("")).alias("text"))


def read_pdf(spark: SparkSession, path: str, convert: Callable[[bytes], dict] | None = None) -> DataFrame:
    """The ``.pdf`` files under ``path`` by an injected converter from bytes to ``text`` and optional ``title``, ``author``,
    ``creation_date`` and ``page_count``. A blank conversion is an empty text, a failed one the row's ``error``."""
    if convert is None:
        raise DocumentLoadError("no converter for PDF files is given")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{pdf,PDF,Pdf}").load(path)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("source_file"), F.sha2("content", 256).alias("file_hash"), "content")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, digest, content in zip(frame["source_file"], frame["file_hash"], frame["content"]):
                try:
                    found, error = convert(bytes(content)), None
                except Exception as e:  # noqa: BLE001 - one broken file must not end the job
                    found, error = {}, str(e)
                rows.append((name, digest, found.get("text") or "", found.get("title"), found.get("author"), found.get("creation_date"), int(found.get("page_count") or 0), error))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in DOCUMENT.split(", ")])

    return files.mapInPandas(work, DOCUMENT)


def write_markdown(documents: DataFrame, path: str) -> None:
    """The documents' texts as rows of ``file_hash, text``: one file a document would be too many for any file system."""
    documents.select("file_hash", "text").write.mode("overwrite").parquet(path)


def chunks_json(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """``file_hash, json``: a document's metadata, the number of its chunks and the chunks in order."""
    held = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "text", "token_count", "start_char", "end_char", "heading_hierarchy")))
    rows = chunks.groupBy("file_hash").agg(held.alias("chunks"))
    told = F.struct(*[c for c in documents.columns if c != "text"])
    whole = documents.join(rows, "file_hash", "left")
    total = F.coalesce(F.size("chunks"), F.lit(0))
    return whole.select("file_hash", F.to_json(F.struct(told.alias("document_metadata"), F.greatest(total, F.lit(0)).alias("total_chunks"), "chunks")).alias("json"))


def write_tables(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Every table as parquet under ``path``; each is complete or absent, and overwriting clears the graph."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def read_stored(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that an ingest has left under ``path``; those that it did not write are missing."""
    found = {}
    for name in ("documents", "chunks", "next_chunk", "entities", "edges"):
        try:
            found[name] = spark.read.parquet(f"{path}/{name}")
        except AnalysisException:
            continue
    if "chunks" not in found:
        raise DocumentLoadError(f"nothing is stored under {path}")
    return found


def write_json(spark: SparkSession, path: str) -> None:
    """The exports: ``chunks_json``, a line a document, and of the graph ``entities_json`` and ``relationships_json``."""
    stored = read_stored(spark, path)
    chunks_json(stored["documents"], stored["chunks"]).select("json").write.mode("overwrite").text(f"{path}/chunks_json")
    for name, out in (("entities", "entities_json"), ("edges", "relationships_json")):
        if name in stored:
            stored[name].write.mode("overwrite").json(f"{path}/{out}")
