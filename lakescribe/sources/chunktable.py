"""The chunk table with versions: immutable commits, deletes by file that are merged when the table is read, one published document for rows, manifest and index together.

``data/commit=<n>`` holds rows, ``deletes/commit=<n>`` the files (type/name) whose rows of earlier commits are gone, ``files/<n>`` the manifest. A version names the commits it consists of
(see ``snapshots``), so a refresh writes what changed, and a run that is killed at any step leaves the old version as it was.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import snapshots


def file_key() -> Column:
    """A chunk's file: type/name."""
    return F.concat_ws("/", "document_type", "source_file")


@dataclass
class ChunkTable:
    """A version of the table at ``path``: commits of ``data`` and ``deletes`` in order, the ``files`` commit, the rows' ``schema``, and what others keep in the same document (``extra``)."""

    spark: SparkSession
    path: str
    version: int = -1
    data: list[str] = field(default_factory=list)
    deletes: list[str] = field(default_factory=list)
    files: str | None = None
    schema: dict | None = None
    extra: dict = field(default_factory=dict)

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> ChunkTable:
        """The newest version, or the one asked for; an empty table (version -1) where none is published."""
        found = snapshots.read(spark, path, version)
        return cls(spark, path, found[0], **found[1]) if found else cls(spark, path)

    def commit(self) -> str:
        """A name for a new commit: its number in order, and what keeps two writers apart."""
        known = [int(c[:10]) for c in (*self.data, *self.deletes)]
        return f"{max(known, default=0) + 1:010d}-{uuid.uuid4().hex}"

    def publish(self) -> ChunkTable:
        """Makes this the next version. ``snapshots.Conflict`` where another writer has made one since this was opened."""
        self.version = snapshots.publish(self.spark, self.path, self.version + 1, {"data": self.data, "deletes": self.deletes, "files": self.files, "schema": self.schema, "extra": self.extra})
        return self

    # -- reading --

    def rows(self) -> DataFrame:
        """The living rows. Deletes meet rows of earlier commits by their file; without deletes the scan is all there is."""
        if self.schema is None:
            raise ValueError(f"no version of the table at {self.path}")
        kind = T.StructType.fromJson(self.schema)
        if not self.data:
            return self.spark.createDataFrame([], kind)
        own = T.StructType([*kind.fields, T.StructField("_commit", T.StringType())])
        stored = self.spark.read.option("basePath", f"{self.path}/data").schema(own).parquet(*[f"{self.path}/data/_commit={c}" for c in self.data])
        if not self.deletes:
            return stored.select(*kind.names)
        gone = self.spark.read.schema("key string, _commit string").option("basePath", f"{self.path}/deletes").parquet(*[f"{self.path}/deletes/_commit={c}" for c in self.deletes])
        last = gone.groupBy("key").agg(F.max("_commit").alias("_gone")).withColumnRenamed("key", "_key")
        return stored.join(last, (file_key() == F.col("_key")) & (F.col("_commit") < F.col("_gone")), "left_anti").select(*kind.names)

    def manifest(self, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/files/{self.files}") if self.files else self.spark.createDataFrame([], schema)

    # -- writing: nothing is visible before publish() --

    def delete_files(self, keys: DataFrame) -> None:
        """Rows of these files (key: type/name) in the commits so far are gone."""
        name = self.commit()
        keys.select("key").distinct().write.parquet(f"{self.path}/deletes/_commit={name}")
        self.deletes = [*self.deletes, name]

    def append(self, rows: DataFrame) -> DataFrame:
        """Adds rows as a commit, and gives them back as they are stored. Columns that the table has not are added to it, null elsewhere."""
        name = self.commit()
        place = f"{self.path}/data/_commit={name}"
        rows.write.partitionBy("document_type").option("compression", "zstd").parquet(place)
        known = T.StructType.fromJson(self.schema).fields if self.schema else []
        have = {f.name for f in known}
        merged = T.StructType([*known, *[f for f in rows.schema.fields if f.name not in have]])
        self.schema, self.data = merged.jsonValue(), [*self.data, name]
        own = T.StructType([f for f in rows.schema.fields if f.name != "document_type"] + [rows.schema["document_type"]])
        return self.spark.read.schema(own).parquet(place)

    def write_files(self, files: DataFrame) -> None:
        self.files = uuid.uuid4().hex
        files.write.parquet(f"{self.path}/files/{self.files}")

    def compact(self) -> ChunkTable:
        """The same rows as one commit without deletes, as the next version."""
        rows = self.rows()
        compacted = ChunkTable(self.spark, self.path, self.version, [], [], self.files, self.schema, self.extra)
        name = self.commit()
        rows.write.partitionBy("document_type").option("compression", "zstd").parquet(f"{self.path}/data/_commit={name}")
        compacted.data = [name]
        return compacted.publish()

    def vacuum(self) -> None:
        """Deletes what this version does not name. No reader of an older version, and no writer, may be at work."""
        for name, keep in (("data", self.data), ("deletes", self.deletes)):
            for folder in snapshots.folders(self.spark, f"{self.path}/{name}"):
                if folder.removeprefix("_commit=") not in keep:
                    snapshots.delete(self.spark, f"{self.path}/{name}/{folder}")
        for folder in snapshots.folders(self.spark, f"{self.path}/files"):
            if folder != self.files:
                snapshots.delete(self.spark, f"{self.path}/files/{folder}")
