"""Files as a stream: new documents are chunked and put in place of their old chunks, exactly once, by Spark's own checkpoint."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import process_documents
from ..operators.manifest import without_files
from ..sources.files import exists, replace_types
from ..sources.workspace import written


def stream_markdown(spark: SparkSession, path: str, document_type: str) -> DataFrame:
    """New .md files of a directory as rows (text, source_file, document_type)."""
    files = spark.readStream.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return files.select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("source_file"), F.lit(document_type).alias("document_type"))


def upsert(table: str, entities: Sequence[str] = ()):
    """A batch function that puts a batch's chunks in place of those files' chunks. Only the partitions of the batch's document types are rewritten, and nothing is kept twice.

    A batch that is repeated gives the same table.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        types = [r[0] for r in batch.select("document_type").distinct().collect()]  # as many as streams feed the table
        chunks = process_documents(batch, entities)
        if exists(spark, table):
            gone = batch.select(F.concat_ws("/", "document_type", "source_file").alias("key")).distinct()
            old = spark.read.parquet(table).filter(F.col("document_type").isin(types))
            chunks = without_files(old, gone).unionByName(chunks, allowMissingColumns=True)
        replace_types(written(chunks, "batch"), table, types)

    return run


def ingest(documents: DataFrame, table: str, checkpoint: str, entities: Sequence[str] = (), available_now: bool = True) -> StreamingQuery:
    writer = documents.writeStream.foreachBatch(upsert(table, entities)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def windowed_counts(events: DataFrame, time_col: str = "ts", key: str = "event_type", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per time window and key of a stream or table, events later than the watermark left out of a stream."""
    return (
        events.withWatermark(time_col, late).groupBy(F.window(time_col, size), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), key, "n", "total")
    )
