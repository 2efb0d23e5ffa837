"""Pages of PDF files as rows, and batches of files that can be taken up again.

The extractor is a function from a file's bytes to page dictionaries; recognising text in page images is a function too. Both run in Arrow batches, a page a row, and a file
or page that fails leaves a row with its error while the others go on. Everything after that is columns (see ``operators.pages``).
"""

from __future__ import annotations

import inspect
import uuid
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import snapshots

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
TABLE = f"struct<bbox:{BOX},header:array<string>,rows:array<array<string>>>"
IMAGE = "struct<xref:int,width:int,height:int,format:string,data:binary,is_chart:boolean>"
SPAN = "struct<text:string,x0:double,y0:double,x1:double,y1:double,font_size:double,is_bold:boolean,is_italic:boolean>"
#: A page: its text layer and spans, what a search for bordered and for borderless tables finds, images and their boxes (two lists that may differ in length), and its picture for recognition.
PAGE = (
    f"path string, doc string, page int, width double, height double, text string, spans array<{SPAN}>, bordered array<{TABLE}>, borderless array<{TABLE}>, "
    f"images array<{IMAGE}>, image_boxes array<{BOX}>, picture binary, error string"
)


def extract_pages(files: DataFrame, extractor: Callable[[bytes], Iterator[dict]]) -> DataFrame:
    """A row per page of (path, content), of the schema ``PAGE``; pages are numbered from 1. What a page dictionary leaves out is null.

    A file that fails has the pages before the failure and one row with page 0 and the error.
    """
    schema = T._parse_datatype_string(PAGE)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                doc = path.rsplit("/", 1)[-1].removesuffix(".pdf")
                try:
                    for number, page in enumerate(extractor(content), 1):
                        yield pa.RecordBatch.from_pylist([{**dict.fromkeys(names), "page": number, **page, "path": path, "doc": doc}], arrow)
                except Exception as e:  # a broken file must not stop the others
                    yield pa.RecordBatch.from_pylist([{**dict.fromkeys(names), "path": path, "doc": doc, "page": 0, "error": f"{type(e).__name__}: {e}"}], arrow)

    return files.select("path", "content").mapInArrow(run, schema)


def recognised(pages: DataFrame, recognise: Callable[[bytes, str], list[tuple[str, float]]], language: str = "spa") -> DataFrame:
    """(doc, page, words array<struct<text, confidence>>) of pages' pictures; a page that fails has no words."""
    kind = pa.list_(pa.struct([("text", pa.string()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = []
            for picture in batch.column("picture").to_pylist():
                try:
                    words.append([{"text": t, "confidence": float(c)} for t, c in recognise(picture, language)])
                except Exception:  # an empty result stands for a page that cannot be read
                    words.append([])
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("page"), pa.array(words, kind)], ["doc", "page", "words"])

    return pages.select("doc", "page", "picture").mapInArrow(run, "doc string, page int, words array<struct<text:string,confidence:double>>")


# ---- batches ----

STATE = "path string, status string, error string, pages long"


def batch_progress(spark: SparkSession, store: str) -> DataFrame:
    """(path, status, error, pages) of the files that a batch has begun: completed, failed, or partial with so many pages done. Only what is committed counts."""
    found = snapshots.read(spark, store)
    commits = found[1]["commits"] if found else []
    if not commits:
        return spark.createDataFrame([], STATE)
    rows = spark.read.schema(f"{STATE}, step long").parquet(*[f"{store}/state/{c}" for c in commits])
    return rows.groupBy("path").agg(F.max_by(F.struct("status", "error", "pages"), "step").alias("s")).select("path", "s.*")


def batch_state(spark: SparkSession, store: str) -> DataFrame:
    """(path, status, error, pages) of the files that earlier runs of a batch have completed or failed; empty where there was none."""
    return batch_progress(spark, store).filter("status <> 'partial'")


def pending(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files that are neither completed nor failed."""
    return files.join(state.select("path"), "path", "left_anti")


def _loaded(files: DataFrame, names: list[str]) -> DataFrame:
    """(path, content) of the named files. Of a scan of files only these are opened."""
    spark = files.sparkSession
    if files.inputFiles():
        return spark.read.format("binaryFile").load(names).select("path", "content")
    return files.join(F.broadcast(spark.createDataFrame([(n,) for n in names], "path string")), "path").select("path", "content")


def _next_pages(files: DataFrame, extractor: Callable[..., Iterator[dict]], step: int) -> DataFrame:
    """The next ``step`` pages at most of each of (path, content, start), with ``_done`` (whether the file has ended): a row per page, and one without a page number per file.

    Pages before ``start`` are passed over; an extractor that takes a second argument is asked to begin with that page.
    """
    schema = T._parse_datatype_string(f"{PAGE}, _done boolean")
    names = schema.names
    begins = len(inspect.signature(extractor).parameters) > 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for path, content, start in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), batch.column("start").to_pylist()):
                empty = {**dict.fromkeys(names), "path": path, "doc": path.rsplit("/", 1)[-1].removesuffix(".pdf")}
                found, done, error = 0, True, None
                try:
                    pages = extractor(content, start) if begins else islice(extractor(content), start - 1, None)
                    for page in islice(pages, step):
                        yield pa.RecordBatch.from_pylist([{**empty, "page": start + found, **page, "path": path, "doc": empty["doc"]}], arrow)
                        found += 1
                    done = found < step
                except Exception as e:  # a broken file must not stop the others
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_pylist([{**empty, "error": error, "_done": done}], arrow)

    return files.select("path", "content", "start").mapInArrow(run, schema)


def process_batch(spark: SparkSession, files: DataFrame, store: str, extractor: Callable[..., Iterator[dict]], resume: bool = True, per_run: int = 1000, step: int = 500) -> DataFrame:
    """Extracts the pending files of (path, content) into ``store`` and returns the batch's numbers (see ``batch_numbers``).

    Files go in portions of ``per_run``, and a portion advances by at most ``step`` pages of each file. What it extracts is written under a name of its own, the files' states beside it, and both are
    made valid by one published document: a run that is stopped goes on behind the last page that was committed, no page comes twice, whatever files are added or taken away between
    runs. A portion opens its own files only. ``resume=False`` forgets what was done. A file that fails keeps the pages before the failure.
    """
    if not resume:
        clear_batch(spark, store)
    while True:
        version, document = snapshots.read(spark, store) or (-1, {"commits": []})
        known = batch_progress(spark, store)
        left = pending(files.select("path"), known.filter("status <> 'partial'")).join(known.select("path", "pages"), "path", "left")
        own = [(r.path, r.start) for r in left.select("path", (F.coalesce("pages", F.lit(0)) + 1).alias("start")).dropDuplicates(["path"]).orderBy("path").limit(per_run).collect()]
        if not own:
            break
        commit = f"{version + 1:010d}-{uuid.uuid4().hex}"
        starts = F.broadcast(spark.createDataFrame(own, "path string, start long"))  # per_run rows at most
        _next_pages(_loaded(files, [p for p, _ in own]).join(starts, "path"), extractor, step).write.parquet(f"{store}/pages/{commit}")
        made = spark.read.parquet(f"{store}/pages/{commit}").groupBy("path").agg(F.max("error").alias("error"), F.count("page").alias("n"), F.max("_done").alias("done"))
        status = F.when(F.col("error").isNotNull(), "failed").when(F.col("done"), "completed").otherwise("partial")
        rows = made.join(starts, "path").select("path", status.alias("status"), "error", (F.col("start") - 1 + F.col("n")).alias("pages"), F.lit(version + 1).cast("long").alias("step"))
        rows.write.parquet(f"{store}/state/{commit}")
        if missing := spark.createDataFrame(own, "path string, start long").join(made, "path", "left_anti").head(1):
            raise FileNotFoundError(f"{missing[0].path} could not be read")
        snapshots.publish(spark, store, version + 1, {"commits": [*document["commits"], commit]})
    return batch_numbers(files, batch_state(spark, store))


def batch_pages(spark: SparkSession, store: str) -> DataFrame:
    """The committed pages of a batch's files, and a row with page 0 and the error for each that failed."""
    schema = T._parse_datatype_string(PAGE)
    found = snapshots.read(spark, store)
    if not found or not found[1]["commits"]:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*[f"{store}/pages/{c}" for c in found[1]["commits"]])
    return rows.filter("page IS NOT NULL OR error IS NOT NULL").withColumn("page", F.coalesce("page", F.lit(0))).select(*schema.names)


def batch_numbers(files: DataFrame, state: DataFrame) -> DataFrame:
    """One row: total, completed, failed and pending files, and the failures' errors by path."""
    rows = files.select("path").join(state, "path", "left")
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status").isNull()).alias("pending"),
        F.map_from_entries(F.collect_list(F.when(F.col("status") == "failed", F.struct("path", "error")))).alias("failures"),
    )


def clear_batch(spark: SparkSession, store: str) -> None:
    for name in ("state", "pages", snapshots.FOLDER):
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{name}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def state_json(state: DataFrame) -> DataFrame:
    """(json): a batch's state as text, a row per file."""
    return state.select(F.to_json(F.struct("path", "status", "error", "pages")).alias("json"))


def state_from_json(rows: DataFrame) -> DataFrame:
    """What ``state_json`` wrote; lines that cannot be read are left out."""
    return rows.select(F.from_json("json", STATE).alias("s")).select("s.*").filter("path IS NOT NULL")
