"""Incremental maintenance: file facts, their differences to the manifest, and an idempotent refresh of the chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import exists
from ..sources.workspace import written

MANIFEST = "key string, mtime double, md5 string, chunk_count long, document_type string"


def diff_files(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """(key, status) of files that are new, deleted, modified or unmodified.

    Modified means that both the time and the digest differ: equal times are taken for equal files, and so are equal digests.
    """
    c, m = current.alias("c"), manifest.alias("m")
    status = (
        F.when(F.col("m.key").isNull(), "new").when(F.col("c.key").isNull(), "deleted")
        .when((F.col("c.mtime") != F.col("m.mtime")) & (F.col("c.md5") != F.col("m.md5")), "modified").otherwise("unmodified")
    )
    return c.join(m, F.col("c.key") == F.col("m.key"), "full_outer").select(F.coalesce("c.key", "m.key").alias("key"), status.alias("status"))


def counted_manifest(current: DataFrame, chunks: DataFrame) -> DataFrame:
    """The manifest of the files as they are now, with their chunks, 0 for those without."""
    counts = chunks.groupBy(F.concat_ws("/", "document_type", "source_file").alias("key")).agg(F.count(F.lit(1)).alias("chunk_count"))
    return current.join(counts, "key", "left").select("key", "mtime", "md5", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "document_type")


def without_files(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """Chunks of files that are not among the keys of ``gone``; a key without a slash names a file of any type."""
    typed, plain = gone.filter(F.contains("key", F.lit("/"))), gone.filter(~F.contains("key", F.lit("/")))
    left = chunks.join(typed.select("key"), F.concat_ws("/", "document_type", "source_file") == F.col("key"), "left_anti")
    return left.join(plain.select(F.col("key").alias("source_file")), "source_file", "left_anti").select(*chunks.columns)


def refreshed(chunks: DataFrame, changes: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """The chunk table after the changes: chunks of every changed file go, those made anew of new and modified files come.

    Also new files' old chunks go, so that running it twice, or without a manifest, gives the same table.
    """
    gone = changes.filter("status <> 'unmodified'").select("key")
    return without_files(chunks, gone).unionByName(new_chunks, allowMissingColumns=True)


def empty_manifest(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MANIFEST)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The stored manifest, empty where there is none."""
    return spark.read.schema(MANIFEST).parquet(path) if exists(spark, path) else empty_manifest(spark)


def write_manifest(files: DataFrame, path: str) -> None:
    """The manifest with the time of writing (UTC); it must not be read from ``path`` itself while it is written."""
    rows = written(files, "manifest").withColumn("indexed_at", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    rows.coalesce(1).write.mode("overwrite").parquet(path)


CACHE = "key string, value string"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored answers (key, value); nothing where there are none or where they cannot be read."""
    try:
        return spark.read.schema(CACHE).parquet(path) if exists(spark, path) and spark.read.schema(CACHE).parquet(path).head(1) else spark.createDataFrame([], CACHE)
    except Exception:  # a broken cache is an empty one, answers are asked for again
        return spark.createDataFrame([], CACHE)


def write_cache(cache: DataFrame, path: str) -> None:
    """Replaces the stored answers, one per key; Spark commits the files together."""
    written(cache.groupBy("key").agg(F.max("value").alias("value")), "cache").write.mode("overwrite").parquet(path)


def cached(rows: DataFrame, cache: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of rows against a cache (key, value) by the digest of their first 500 characters; hits have the value."""
    from ..functions.text import cache_key

    keyed = rows.withColumn("key", cache_key(F.col(text_col)))
    joined = keyed.join(cache, "key", "left")
    return joined.filter(F.col("value").isNotNull()), joined.filter(F.col("value").isNull()).drop("value")
