"""Scans and sinks: Markdown directories, file facts, samples, the chunk table, JSON data sets. All paths go through Spark's file systems."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "text string, source_file string, document_type string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in whatever store Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _per_type(spark: SparkSession, directories: Mapping[str, str], read) -> list[DataFrame]:
    return [read(path).withColumn("document_type", F.lit(name)) for name, path in directories.items() if exists(spark, path)]


def _union(parts: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Files of so many are named in one scan.
PORTION = 10_000


def _scans(spark: SparkSession, path: str, pattern: str, only: list[str] | None, read) -> list[DataFrame]:
    """Scans of a directory's files, or of the named ones alone, a portion of names each: a scan opens no other file."""
    if only is None:
        return [read(spark.read.option("pathGlobFilter", pattern), path)]
    return [read(spark.read, only[at : at + PORTION]) for at in range(0, len(only), PORTION)]


def _named(only: DataFrame | None, name: str, path: str) -> list[str] | None:
    """Paths of the files of type ``name`` among the keys or paths of ``only``. Names alone come to the driver, which lists directories anyway."""
    if only is None:
        return None
    if "path" in only.columns:
        return [r.path for r in only.filter(F.col("document_type") == name).select("path").toLocalIterator()]
    keys = only.filter(F.startswith(F.col("key"), F.lit(f"{name}/"))).select("key")
    return [f"{path.rstrip('/')}/{r.key[len(name) + 1 :]}" for r in keys.toLocalIterator()]


def scan_markdown(spark: SparkSession, directories: Mapping[str, str], only: DataFrame | None = None) -> DataFrame:
    """(text, source_file, document_type) of the .md files of each type's directory, not of those below it; a directory that is missing is passed over.

    With ``only`` (key: type/name) no other files are opened.
    """
    parts = []
    for name, path in directories.items():
        if exists(spark, path):
            read = lambda r, p: r.text(p, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("source_file"))
            parts += [x.withColumn("document_type", F.lit(name)) for x in _scans(spark, path, "*.md", _named(only, name, path), read)]
    return _union(parts, spark, DOCUMENT)


def scan_times(spark: SparkSession, directories: Mapping[str, str], pattern: str = "*.md") -> DataFrame:
    """(key, mtime, document_type, path) of files. None is opened."""

    def read(path: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
        return files.select(F.col("modificationTime").cast("double").alias("mtime"), "path", F.element_at(F.split("path", "/"), -1).alias("file_name"))

    out = _union(_per_type(spark, directories, read), spark, "mtime double, path string, file_name string, document_type string")
    return out.select(F.concat_ws("/", "document_type", "file_name").alias("key"), "mtime", "document_type", "path")


def scan_fingerprints(spark: SparkSession, directories: Mapping[str, str], pattern: str = "*.md", only: DataFrame | None = None) -> DataFrame:
    """(key, mtime, md5, document_type, file_name) of files; key is type/file. With ``only`` (path, document_type) no other files are opened."""
    parts = []
    for name, path in directories.items():
        if exists(spark, path):
            read = lambda r, p: r.format("binaryFile").load(p).select(F.col("modificationTime").cast("double").alias("mtime"), F.md5("content").alias("md5"), F.element_at(F.split("path", "/"), -1).alias("file_name"))
            parts += [x.withColumn("document_type", F.lit(name)) for x in _scans(spark, path, pattern, _named(only, name, path), read)]
    out = _union(parts, spark, "mtime double, md5 string, file_name string, document_type string")
    return out.select(F.concat_ws("/", "document_type", "file_name").alias("key"), "mtime", "md5", "document_type", "file_name")


def scan_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """The queries of an evaluation data set: id, query, category, difficulty and what is expected."""
    schema = "queries array<struct<id:string,query:string,category:string,difficulty:string,expected_document_types:array<string>,expected_entities:array<string>>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("queries").alias("q")).select(F.col("q.id").alias("query_id"), "q.*").drop("id")


def write_chunks(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The chunk table, partitioned by document type, which most filters name."""
    chunks.write.mode(mode).option("partitionOverwriteMode", "static" if mode == "overwrite" else "dynamic").partitionBy("document_type").parquet(path)


def overwrite_types(chunks: DataFrame, path: str) -> None:
    """Only the partitions of the document types that ``chunks`` has are replaced. ``chunks`` must not be read from ``path`` itself."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document_type").parquet(path)


def replace_types(chunks: DataFrame, path: str, types: Sequence[str]) -> None:
    """The partitions of ``types`` become ``chunks``; a type of which no chunk is left loses its partition. ``chunks`` must not be read from ``path`` itself."""
    spark = chunks.sparkSession
    left = {r[0] for r in chunks.select("document_type").distinct().collect()}
    overwrite_types(chunks, path)
    for name in set(types) - left:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/document_type={name}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def append_chunks(chunks: DataFrame, path: str) -> None:
    """Appends to the chunk table, columns by name: those that the table has and ``chunks`` has not are null, others are an error."""
    stored = chunks.sparkSession.read.parquet(path)
    if unknown := set(chunks.columns) - set(stored.columns):
        raise ValueError(f"the table has no column {', '.join(sorted(unknown))}")
    have = set(chunks.columns)
    rows = chunks.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in stored.schema.fields])
    rows.write.mode("append").partitionBy("document_type").parquet(path)


def sample_directory(spark: SparkSession, path: str, max_files: int = 5, max_words: int = 2000) -> DataFrame:
    """(file_name, directory, text) of the first files of a directory by name, cut to ``max_words`` words; bytes that are no UTF-8 are replaced. Nothing where there is no directory.

    Names are ranked before contents are read, so only these files are opened.
    """
    from ..operators.catalog import sampled_files

    if not exists(spark, path):
        return spark.createDataFrame([], "file_name string, directory string, text string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(path)
    names = [r.path for r in files.select("path").orderBy("path").limit(max_files).collect()]
    chosen = files.filter(F.col("path").isin(names)).select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return sampled_files(chosen, max_files, max_words).withColumn("directory", F.lit(path.rstrip("/").rsplit("/", 1)[-1]))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_markdown(documents: DataFrame, path: str) -> DataFrame:
    """(doc, md) as ``<doc>.md`` under ``path``, a file per document; gives (file_name, bytes)."""
    from .filesink import write_files

    return write_files(documents.select(F.concat(F.col("doc").cast("string"), F.lit(".md")).alias("file_name"), F.col("md").alias("content")), path)
