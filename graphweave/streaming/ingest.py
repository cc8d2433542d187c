"""Optional streaming ingest: the same projections on a stream of documents, with idempotent upserts of the results."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphweave.operators import clean, graph, metadata


def stream_documents(documents: DataFrame, delay: str = "1 day") -> DataFrame:
    """Cleaned and enriched documents; a file that is delivered again within ``delay`` is dropped."""
    once = documents.withWatermark("ingested_at", delay).dropDuplicatesWithinWatermark(["file_hash"])
    return metadata.enrich(clean.clean(once))


def finished(spark: SparkSession, path: str) -> DataFrame | None:
    """``version, stream, batch`` of the versions that are complete, or None."""
    try:
        return spark.read.parquet(f"{path}/finished")
    except AnalysisException:
        return None


def read_latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as its last complete version has it, or None."""
    done = finished(spark, path)
    return None if done is None else spark.read.parquet(f"{path}/version={done.agg(F.max('version')).first()[0]}")


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str) -> StreamingQuery:
    """Keeps the last row of each key in parquet under ``path``: every batch is merged into a new version, which counts once it is
    listed in the table ``finished``. A batch that is run again changes nothing, and a stream with a new checkpoint goes on
    from the last version. The whole table is written for every batch, so batches should be large."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = finished(spark, path)
        if batch.isEmpty():
            return
        if done is not None and not done.where((F.col("stream") == checkpoint) & (F.col("batch") == number)).isEmpty():
            return
        version = 0 if done is None else done.agg(F.max("version")).first()[0] + 1
        graph.upsert(read_latest(spark, path), batch, keys, order).write.mode("overwrite").parquet(f"{path}/version={version}")
        row = spark.createDataFrame([(version, checkpoint, number)], "version bigint, stream string, batch bigint")
        row.coalesce(1).write.mode("append").parquet(f"{path}/finished")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
