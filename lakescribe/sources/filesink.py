"""A file per row, written by the tasks that have the rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import written


def write_files(rows: DataFrame, base: str, name: str = "file_name", content: str = "content") -> DataFrame:
    """Writes each row's ``content`` (text as UTF-8, or bytes; null is an empty file) to the file ``name`` under ``base``; gives (file_name, bytes) of what was written.

    A file appears whole or not at all: it is written under a name of the task's attempt and moved, so tasks can be run again. Files that are there already are replaced, others stay. Names may have
    folders. A name that is null, empty, absolute or leads out of ``base``, and a name of several rows, are errors before anything is written. Stores are those of Arrow: local, hdfs, s3 (s3a), gs.
    """
    rows = rows.select(F.col(name).alias("file_name"), F.col(content).cast("binary").alias("content"))
    bad = rows.filter(F.col("file_name").isNull() | F.col("file_name").rlike(r"^$|^/|/$|(^|/)\.{1,2}(/|$)")).select("file_name").head(1)
    if bad:
        raise ValueError(f"{bad[0][0]!r} cannot be a file's name")
    if twice := rows.groupBy("file_name").count().filter("count > 1").head(1):
        raise ValueError(f"several rows have the name {twice[0].file_name!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", base))
        attempt, made = TaskContext.get().taskAttemptId(), set()
        for batch in batches:
            names, sizes = batch.column("file_name").to_pylist(), []
            for file, data in zip(names, batch.column("content")):
                folder, _, leaf = f"{root.rstrip('/')}/{file}".rpartition("/")
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                value = data.as_py() or b""
                with store.open_output_stream(f"{folder}/.{leaf}.{attempt}") as out:
                    out.write(value)
                store.move(f"{folder}/.{leaf}.{attempt}", f"{folder}/{leaf}")
                sizes.append(len(value))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["file_name", "bytes"])

    return written(rows.mapInArrow(run, "file_name string, bytes long"), "files")
