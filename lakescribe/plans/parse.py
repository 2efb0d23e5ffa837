"""PDF files to Markdown, JSON and images, all files of a directory or one, as one stage."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pages as ops
from ..sources import pages as source
from ..sources.filesink import write_files
from ..sources.pdf import scan_pdfs
from ..sources.workspace import written


def parse_files(
    spark: SparkSession, path: str, out: str, extractor: Callable[[bytes], Iterator[dict]], recognise: Callable[[bytes, str], list[tuple[str, float]]] | None = None, only: str | None = None,
    language: str = "spa", charts_only: bool = False, try_borderless: bool = True,
) -> DataFrame:
    """Writes ``<doc>.md``, ``<doc>.json`` and ``images/<doc>_p<page>_i<index>.<format>`` under ``out`` and gives a row per document: doc, pages, tables, images, charts, error.

    Each file is opened once: its pages are written to the shared folder and everything else is made of them. A file that fails gives the pages before the failure
    and its error, and the others go on; one without a page has no Markdown and no JSON. Pages of the kind scanned have the text that ``recognise`` finds, or none without it.
    """
    began = time.time()
    raw = written(source.extract_pages(scan_pdfs(spark, path, only), extractor), "pages")
    pages = ops.analysed(raw.filter("page > 0"))
    tables, images = ops.tables(pages, try_borderless), ops.images(pages, charts_only=charts_only)
    scanned = pages.filter("page_type = 'scanned'")
    words = source.recognised(scanned, recognise, language) if recognise else scanned.select("doc", "page", F.lit(None).cast("array<struct<text:string,confidence:double>>").alias("words"))
    texts = ops.processed(pages, words)
    markers = ops.section_markers(ops.layout.with_levels(ops.page_spans(pages)))
    markdown = ops.composed_markdown(pages, tables, images, texts)
    named = lambda rows, kind: rows.select(F.concat(F.col("doc"), F.lit(f".{kind}")).alias("file_name"), F.col("md" if kind == "md" else "json").alias("content"))
    write_files(named(markdown, "md"), out)
    write_files(ops.image_files(images), f"{out.rstrip('/')}/images")
    write_files(named(ops.document_json(pages, tables, images, markers, time.time() - began), "json"), out)
    done = raw.groupBy("doc").agg(F.count_if(F.col("page") > 0).alias("pages"), F.max("error").alias("error"))
    totals = done.join(ops.counts(tables, images), "doc", "left")
    return totals.select("doc", "pages", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tables", "images", "charts")], "error")
