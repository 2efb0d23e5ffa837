"""Keeping the chunk table, its full-text index and its manifest up to date with the Markdown directories.

All three are one versioned table (see ``sources.chunktable``): a refresh reads the files whose time moved, writes their chunks, the names of the files whose earlier rows are gone, a
segment of the index and the manifest, and publishes all of it in one step. A run that is killed leaves the version before it, and is done again by the next one. What is written follows the
change; nothing that is stored is rewritten but by merges of the index and ``compact``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CorpusConfig
from ..operators import manifest, search, textindex
from ..operators.chunking import process_documents
from ..operators.enrich import embedded
from ..sources.chunktable import ChunkTable, file_key
from ..sources.files import scan_fingerprints, scan_markdown, scan_times
from ..sources.workspace import written


@dataclass(frozen=True)
class Report:
    """What a run found and did; ``applied`` is false for dry runs and where nothing had changed."""

    new: int
    modified: int
    deleted: int
    applied: bool
    chunks: int | None = None
    files: int | None = None


def chunked(spark: SparkSession, config: CorpusConfig, documents: DataFrame, encode: Callable | None = None) -> DataFrame:
    """Documents (text, source_file, document_type) as rows of the chunk table, with ids and vectors."""
    docs = config.extracted(documents)
    custom = [f.name for f in config.custom_fields]
    chunks = process_documents(docs, config.entity_names, config.skip_exact, config.skip_prefixes, keep=("source_file", "document_type", *custom))
    chunks = chunks.withColumn("chunk_id", F.xxhash64("document_type", "source_file", "chunk_index")).withColumn("context", F.lit("")).withColumn("is_summary", F.lit(False))
    return embedded(chunks, encode)


def place_of(config: CorpusConfig, base: str) -> str:
    return f"{base.rstrip('/')}/{config.table_name}"


def text_index(table: ChunkTable) -> search.TextIndex | None:
    """The full-text index that belongs to this version of the table."""
    kept = table.extra.get("index")
    return search.TextIndex(table.spark, f"{table.path}/index", table.version, **kept) if kept else None


def stored_manifest(spark: SparkSession, place: str) -> DataFrame:
    """The manifest of the newest version: key, mtime, md5, chunk_count, document_type; empty where there is none."""
    return ChunkTable.open(spark, place).manifest(manifest.MANIFEST)


def current_files(spark: SparkSession, directories: Mapping[str, str], stored: DataFrame) -> DataFrame:
    """(key, mtime, md5, document_type) of the files as they are now. Only files that are new or whose time moved are opened; the others' digests are the stored ones."""
    times = written(scan_times(spark, directories).join(stored.select("key", F.col("mtime").alias("_mtime"), F.col("md5").alias("_md5")), "key", "left"), "times")
    moved = times.filter("_mtime IS NULL OR _mtime <> mtime")
    digests = scan_fingerprints(spark, directories, only=moved.select("path", "document_type")).select("key", "md5")
    same = times.filter("_mtime = mtime").select("key", "mtime", F.col("_md5").alias("md5"), "document_type")
    return same.unionByName(moved.join(digests, "key").select("key", "mtime", "md5", "document_type"))


def incremental(spark: SparkSession, config: CorpusConfig, base: str, directories: Mapping[str, str] | None = None, encode: Callable | None = None, dry_run: bool = False) -> Report:
    """Indexes new and modified files and removes those of modified and deleted ones. Only their texts are read and only what is made of them is written.

    Without a version all files are new. A dry run, and a run without changes, writes nothing to the table.
    """
    table = ChunkTable.open(spark, place_of(config, base))
    directories = dict(directories if directories is not None else config.directories)
    stored = table.manifest(manifest.MANIFEST)
    current = written(current_files(spark, directories, stored), "files")
    changes = written(manifest.diff_files(current, stored).filter("status <> 'unmodified'"), "changes")
    found = {r.status: r["count"] for r in changes.groupBy("status").count().collect()}
    numbers = [found.get(k, 0) for k in ("new", "modified", "deleted")]
    if dry_run or not any(numbers):
        return Report(*numbers, applied=False)
    anew = changes.filter("status <> 'deleted'").select("key")
    fresh = chunked(spark, config, scan_markdown(spark, directories, only=anew), encode)
    index = text_index(table)
    gone = None
    if table.schema is not None:
        gone = written(table.rows().join(changes.select(F.col("key").alias("_key")), file_key() == F.col("_key"), "left_semi").select("chunk_id"), "gone")
        table.delete_files(changes)
    fresh = table.append(fresh)
    if index is None:
        index = search.write_index(table.rows(), f"{table.path}/index", publish=False)
    else:
        index = textindex.refresh_index(index, gone, fresh, publish=False)
    counts = fresh.groupBy(file_key().alias("key")).agg(F.count(F.lit(1)).alias("chunk_count"))
    kept = stored.join(changes.select("key"), "key", "left_anti").select("key", "chunk_count")
    return _published(table, index, current.join(kept.unionByName(counts), "key", "left"), numbers)


def full(spark: SparkSession, config: CorpusConfig, base: str, directories: Mapping[str, str] | None = None, encode: Callable | None = None) -> Report:
    """Indexes all files anew, as a new version."""
    before = ChunkTable.open(spark, place_of(config, base))
    table = ChunkTable(spark, before.path, before.version)
    directories = dict(directories if directories is not None else config.directories)
    current = written(scan_fingerprints(spark, directories), "files")
    chunks = table.append(chunked(spark, config, scan_markdown(spark, directories), encode))
    index = search.write_index(chunks, f"{table.path}/index", publish=False)
    return _published(table, index, manifest.counted_manifest(current, chunks), [current.count(), 0, 0])


def _published(table: ChunkTable, index: search.TextIndex, files: DataFrame, numbers: list[int]) -> Report:
    """Writes the manifest and makes rows, index and manifest the next version."""
    table.write_files(files.select("key", "mtime", "md5", F.coalesce("chunk_count", F.lit(0)).cast("long").alias("chunk_count"), "document_type"))
    table.extra = {**table.extra, "index": index.document()}
    table.publish()
    return Report(*numbers, applied=True, chunks=index.n, files=table.manifest(manifest.MANIFEST).count())


def rebuild_text_index(spark: SparkSession, config: CorpusConfig, base: str, sanity: str = "inundaciones", limit: int = 3) -> tuple[int, DataFrame]:
    """Builds the table's index anew, publishes it with the rows as they are, and tries it: the number of chunks, and the best of them for ``sanity``. ValueError without chunks."""
    table = ChunkTable.open(spark, place_of(config, base))
    if table.schema is None or not table.rows().select("chunk_id").head(1):
        raise ValueError("no chunks to index")
    index = search.write_index(table.rows(), f"{table.path}/index", publish=False)
    table.extra = {**table.extra, "index": index.document()}
    table.publish()
    return index.n, search.text_search(table.rows(), spark.createDataFrame([("0", sanity)], "query_id string, query string"), limit, text_index(table))


def compact(spark: SparkSession, config: CorpusConfig, base: str, vacuum: bool = False) -> int:
    """Rows as one commit without deletes and the index as one segment, as a new version, which is returned. With ``vacuum`` what older versions hold goes."""
    table = ChunkTable.open(spark, place_of(config, base))
    index = textindex.merge_segments(text_index(table), publish=False)
    table.extra = {**table.extra, "index": index.document()}
    table = table.compact()
    if vacuum:
        table.vacuum()
        textindex.vacuum_index(index)
    return table.version


def run(spark: SparkSession, config: CorpusConfig, base: str, full_run: bool = False, dry_run: bool = False, **options) -> Report:
    """One of the two; a dry run of a full one is a full one."""
    return full(spark, config, base, **options) if full_run else incremental(spark, config, base, dry_run=dry_run, **options)
