"""Pages of documents as columns: kinds of pages, tables, images, recognised text, section markers, statistics and the document's JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import layout
from .layout import LEAST_IMAGE, header_names, image_coverage, is_table, ocr_confidence, page_type, section_type

#: How far beside, above and below an image its caption is looked for, how long it may be, and the parser's version.
CAPTION = (20, 20, 20, 60)
CAPTION_LENGTH = 200
PARSER_VERSION = "1.0.0"
#: A table of which more than this share of cells is missing should be looked at.
REVIEW_SHARE = 0.3


def analysed(pages: DataFrame) -> DataFrame:
    """``pages`` with text_length, n_images, coverage and page_type."""
    out = pages.withColumn("text_length", F.length(F.trim(F.coalesce("text", F.lit(""))))).withColumn("n_images", F.coalesce(F.size("images"), F.lit(0)))
    none = F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    out = out.withColumn("coverage", image_coverage(F.coalesce("image_boxes", none), F.col("width"), F.col("height")))
    return out.withColumn("page_type", page_type(F.col("text_length"), F.col("coverage"), F.col("n_images")))


def type_counts(pages: DataFrame) -> DataFrame:
    """(doc, page_type, n) of analysed pages."""
    return pages.groupBy("doc", "page_type").agg(F.count(F.lit(1)).alias("n"))


def pages_of_type(pages: DataFrame, kind: str) -> DataFrame:
    """(doc, page) of analysed pages of a type."""
    return pages.filter(F.col("page_type") == kind).select("doc", "page")


def tables(pages: DataFrame, try_borderless: bool = True) -> DataFrame:
    """A row per table: doc, page, table_index, bbox, rows, header_names, row_count, col_count, is_borderless, needs_review.

    Tables found without borders count only on pages without bordered ones, and only where they look like tables; table_index is the place in what was found.
    """

    def of(column: str, borderless: bool) -> Column:
        return F.transform(column, lambda t, i: F.struct(i.alias("table_index"), F.lit(borderless).alias("is_borderless"), t["bbox"].alias("bbox"), t["rows"].alias("rows"), t["header"].alias("header")))

    found = of("bordered", False)
    if try_borderless:  # one array, so that pages, which may be the work of a Python stage, are gone over once
        found = F.when(F.coalesce(F.size("bordered"), F.lit(0)) == 0, of("borderless", True)).otherwise(found)
    rows = pages.select("doc", "page", F.explode(found).alias("t")).select("doc", "page", "t.*")
    rows = rows.filter(~F.col("is_borderless") | F.coalesce(is_table(F.col("rows")), F.lit(False)))
    cells = F.flatten("rows")
    return rows.select(
        "doc", "page", "table_index", "bbox", "rows", header_names(F.when(F.size("header") > 0, F.col("header")), F.col("rows")).alias("header_names"),
        F.coalesce(F.size("rows"), F.lit(0)).alias("row_count"), F.coalesce(F.array_max(F.transform("rows", F.size)), F.lit(0)).alias("col_count"), "is_borderless",
        F.coalesce(F.size(F.filter(cells, lambda c: c.isNull())) > F.size(cells) * F.lit(REVIEW_SHARE), F.lit(False)).alias("needs_review"),
    )


def images(pages: DataFrame, least: int = LEAST_IMAGE, charts_only: bool = False) -> DataFrame:
    """A row per image of ``least`` points in both directions: doc, page, image_index, xref, bbox, width, height, format, data, is_chart, nearby_text.

    Boxes go with images by their place, zeros where there are fewer; nearby text is that of spans which meet the box widened as captions need, up to 200 characters.
    """
    zero = F.expr("named_struct('x0', 0D, 'y0', 0D, 'x1', 0D, 'y1', 0D)")
    rows = pages.select("doc", "page", "spans", "image_boxes", F.posexplode("images").alias("image_index", "i"))
    rows = rows.withColumn("bbox", F.coalesce(F.get("image_boxes", F.col("image_index")), zero)).filter((F.col("i.width") >= least) & (F.col("i.height") >= least))
    left, above, right, below = CAPTION
    b = F.col("bbox")

    def meets(s: Column) -> Column:
        return (s["x1"] > b["x0"] - left) & (s["x0"] < b["x1"] + right) & (s["y1"] > b["y0"] - above) & (s["y0"] < b["y1"] + below)

    near = F.array_join(F.transform(F.filter(F.coalesce("spans", F.array()), meets), lambda s: s["text"]), "\n")
    text = F.when(b == zero, "").otherwise(F.trim(F.substring(near, 1, CAPTION_LENGTH)))
    out = rows.select("doc", "page", "image_index", "i.xref", "bbox", "i.width", "i.height", "i.format", "i.data", F.coalesce("i.is_chart", F.lit(False)).alias("is_chart"), F.coalesce(text, F.lit("")).alias("nearby_text"))
    return out.filter("is_chart") if charts_only else out


def counts(found_tables: DataFrame, found_images: DataFrame) -> DataFrame:
    """(doc, tables, images, charts)."""
    t = found_tables.groupBy("doc").agg(F.count(F.lit(1)).alias("tables"))
    i = found_images.groupBy("doc").agg(F.count(F.lit(1)).alias("images"), F.count_if("is_chart").alias("charts"))
    return t.join(i, "doc", "full_outer").select("doc", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tables", "images", "charts")])


def processed(pages: DataFrame, words: DataFrame) -> DataFrame:
    """(doc, page, page_type, text, ocr_applied, confidence) of analysed pages: nothing of empty ones, recognised words of scanned ones, the text layer of the others."""
    w = words.select("doc", "page", F.col("words").alias("_w"))
    scanned = F.col("page_type") == "scanned"
    text = F.when(F.col("page_type") == "empty", "").when(scanned, F.coalesce(F.array_join(F.transform("_w", lambda x: x["text"]), " "), F.lit(""))).otherwise(F.coalesce("text", F.lit("")))
    confidence = F.when(scanned & (F.size("_w") > 0), ocr_confidence(F.transform("_w", lambda x: x["confidence"])))
    return pages.join(w, ["doc", "page"], "left").select("doc", "page", "page_type", text.alias("text"), scanned.alias("ocr_applied"), confidence.alias("confidence"))


def section_markers(spans: DataFrame, appendices_only: bool = False) -> DataFrame:
    """(doc, page, seq, section_type, title, heading_level, x0, y0, x1, y1) of headings: all, or those with a word for appendices. Body text is none, whatever it says."""
    found = spans.filter(F.col("heading_level") > 0).select("doc", "page", "seq", section_type(F.col("text")).alias("section_type"), F.trim("text").alias("title"), "heading_level", "x0", "y0", "x1", "y1")
    return found.filter("section_type <> 'main'") if appendices_only else found


def marked_headings(lines: DataFrame, markers: DataFrame) -> DataFrame:
    """``lines`` (doc, text, ...) with is_appendix: the heading has a word for appendices, or its text is a marker's title in the document."""
    titles = markers.select(F.col("doc").alias("_doc"), F.col("title").alias("_title")).distinct()
    joined = lines.join(titles, (F.col("doc") == F.col("_doc")) & (F.trim("text") == F.col("_title")), "left")
    return joined.withColumn("is_appendix", F.col("_title").isNotNull() | (section_type(F.col("text")) != "main")).drop("_doc", "_title")


def document_json(pages: DataFrame, found_tables: DataFrame, found_images: DataFrame, markers: DataFrame, seconds: float = 0.0) -> DataFrame:
    """(doc, json): metadata, statistics, sections, tables and images with their ids, of analysed pages. Lists are in the order of pages and places."""
    box = lambda b: F.array(b["x0"], b["y0"], b["x1"], b["y1"])
    t = found_tables.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(
        F.col("page").alias("page_number"), "table_index", F.format_string("p%d_t%d", "page", "table_index").alias("id"), box(F.col("bbox")).alias("bbox"), "is_borderless", "needs_review", F.col("header_names").alias("headers"), "rows", "row_count", "col_count",
    ))).alias("tables"))
    i = found_images.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(
        F.col("page").alias("page_number"), "image_index", F.format_string("p%d_i%d", "page", "image_index").alias("id"), image_name().alias("filename"), "is_chart", "nearby_text", F.struct("width", "height").alias("dimensions"), box(F.col("bbox")).alias("bbox"), "format",
    ))).alias("images"))
    s = markers.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(
        F.col("page").alias("page_number"), "seq", "section_type", "title", "heading_level", F.array("x0", "y0", "x1", "y1").alias("bbox"),
    ))).alias("sections"))
    p = pages.filter("page > 0").groupBy("doc").agg(
        F.count(F.lit(1)).alias("total_pages"), F.count_if(F.col("page_type") == "scanned").alias("scanned_pages"), F.count_if(F.col("page_type").isin("native_text", "mixed")).alias("native_pages"),
        F.sum(F.coalesce(F.size("spans"), F.lit(0))).alias("text_blocks"),
    )
    out = p.join(t, "doc", "left").join(i, "doc", "left").join(s, "doc", "left")
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    metadata = F.struct(F.col("doc").alias("source_pdf"), F.col("doc").alias("title"), "total_pages", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("processed_at"), F.lit(PARSER_VERSION).alias("parser_version"))
    statistics = F.struct(
        "text_blocks", count("tables").alias("tables"), count("images").alias("images"), count("sections").alias("sections"), "scanned_pages", "native_pages", F.lit(float(seconds)).alias("processing_time_seconds")
    )
    return out.select("doc", F.to_json(F.struct(metadata.alias("metadata"), statistics.alias("statistics"), "sections", "tables", "images")).alias("json"))


def image_name() -> Column:
    return F.format_string("%s_p%d_i%d.%s", "doc", "page", "image_index", "format")


def image_files(found_images: DataFrame) -> DataFrame:
    """(file_name, content) of images."""
    return found_images.select(image_name().alias("file_name"), F.col("data").alias("content"))


def table_markdown() -> Column:
    """A found table in Markdown: its column names, then its rows, but for a first row that the names were taken from. Cells are one line each, bars in them escaped, short rows filled up."""
    cell = lambda c: F.replace(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), F.lit("|"), F.lit("\\|"))
    filled = lambda r: F.transform(F.sequence(F.lit(0), F.col("col_count") - 1), lambda k: cell(F.get(r, k)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(filled(r), " | "), F.lit(" |"))
    first = F.transform(F.coalesce(F.get("rows", F.lit(0)), F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit("")))
    body = F.when(first == F.col("header_names"), F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0)))).otherwise(F.col("rows"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("col_count")))
    return F.when(F.col("col_count") > 0, F.array_join(F.concat(F.array(line(F.col("header_names")), rule), F.transform(body, line)), "\n"))


def page_spans(pages: DataFrame) -> DataFrame:
    """A row per span of pages: doc, page, seq, page_height and the span's fields."""
    return pages.filter("page > 0").select("doc", "page", F.col("height").alias("page_height"), F.posexplode("spans").alias("seq", "s")).select("doc", "page", F.col("seq").cast("long").alias("seq"), "page_height", "s.*")


def composed_markdown(pages: DataFrame, found_tables: DataFrame, found_images: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc, md) of analysed pages: each document's title, then every page under its marker with lines, tables, images and recognised text in reading order.

    ``texts`` is what ``processed`` gives. Running headers and footers and the spans inside tables are left out of the lines. A page with nothing has its marker only; a document without headings is titled by its name.
    """
    spans = layout.with_levels(page_spans(pages))
    body = layout.outside_tables(layout.without_running_text(spans), found_tables.select("doc", "page", "bbox.*"))
    lines = layout.lines_to_markdown(body).select("doc", "page", "y0", F.lit(0).alias("kind_no"), F.col("line").cast("long").alias("seq"), "md")
    place = lambda rows, kind, seq, md: rows.select("doc", "page", F.col("bbox.y0").alias("y0"), F.lit(kind).alias("kind_no"), F.col(seq).cast("long").alias("seq"), md.alias("md"))
    pictures = F.concat(F.lit("![Image "), (F.col("image_index") + 1).cast("string"), F.lit(", page "), F.col("page").cast("string"), F.lit("](images/"), image_name(), F.lit(")"))
    read = texts.filter("ocr_applied AND text <> ''").select("doc", "page", F.lit(0.0).alias("y0"), F.lit(0).alias("kind_no"), F.lit(-1).cast("long").alias("seq"), F.col("text").alias("md"))
    parts = layout.interleaved(lines, place(found_tables, 1, "table_index", table_markdown()).filter("md IS NOT NULL"), place(found_images, 2, "image_index", pictures), read)
    whole = pages.filter("page > 0").select("doc", "page").join(parts, ["doc", "page"], "left").withColumn("md", F.coalesce("md", F.lit("")))
    names = whole.select("doc").distinct().join(layout.titles(spans), "doc", "left").select("doc", F.coalesce("title", F.col("doc").cast("string")).alias("title"))
    return layout.documents_markdown(whole, names)
