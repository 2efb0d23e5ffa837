"""The relational part of turning extracted page content into Markdown: headings, running headers, tables, reading order.

Spans are (doc, page, seq, text, font_size, is_bold, is_italic, x0, y0, x1, y1, page_height). Extraction itself is a Python stage (see sources.pdf).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, strip, trimmed

# Zones, tolerances and limits in points, counts and characters.
ZONE = 72.0
SAME_LINE = 5.0
BOX_PADDING = 5.0
REPEATED = 3
LEVELS = 6
LEAST_IMAGE = 100
OPEN_STARTS = 32
SECTION_WORDS = {"anejo": r"(?iu)\bANEJOS?\b", "anexo": r"(?iu)\bANEXOS?\b", "apendice": r"(?iu)\bAP[EÉ]NDICES?\b"}

LEAST_WORD = 5


def rounded_size(size: Column) -> Column:
    """To half points, halves to even."""
    return F.bround(size * 2) / 2


def is_bold(flags: Column, font: Column) -> Column:
    return (flags.bitwiseAND(16) != 0) | font.contains("Bold")


def is_italic(flags: Column, font: Column) -> Column:
    return (flags.bitwiseAND(2) != 0) | font.contains("Italic") | font.contains("Oblique")


def heading_levels(spans: DataFrame) -> DataFrame:
    """(doc, font_size, chars, level): body is the size of most characters (the smallest of equals), larger sizes are levels from the largest down, at most six; others 0."""
    size = rounded_size(F.col("font_size"))
    counted = spans.withColumn("_n", F.length(trimmed(F.col("text")))).filter("_n > 0").groupBy("doc", size.alias("font_size")).agg(F.sum("_n").alias("chars"))
    body = F.first("font_size").over(Window.partitionBy("doc").orderBy(F.desc("chars"), "font_size"))
    larger = counted.withColumn("_body", body)
    rank = F.dense_rank().over(Window.partitionBy("doc").orderBy(F.desc("font_size")))
    return larger.withColumn("level", F.when(F.col("font_size") > F.col("_body"), F.least(rank, F.lit(LEVELS))).otherwise(0)).drop("_body")


def with_levels(spans: DataFrame) -> DataFrame:
    """Spans with their heading level, 0 where their size has none.

    The levels are those of ``heading_levels``. A document's spans are sorted once, by size, and windows over that order find the characters of each size, the body size and the
    rank; so spans that lie by document already do not move, and nothing is read twice.
    """
    n = F.length(trimmed(F.col("text")))
    s = spans.withColumn("_size", rounded_size(F.col("font_size"))).withColumn("_n", F.when(n > 0, n))
    s = s.withColumns({"_key": F.when(F.col("_n").isNotNull(), F.col("_size")), "_blank": F.col("_n").isNull()})
    # spans with text stand first of their size, so a size is counted where its first span has text, and blank spans see whether their size is counted
    by_size = Window.partitionBy("doc").orderBy(F.desc("_size"), "_blank")
    so_far = by_size.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumns({"_before": F.lag("_size").over(by_size), "_chars": F.sum("_n").over(by_size.rangeBetween(Window.currentRow, Window.currentRow))})
    s = s.withColumn("_opens", (~F.col("_blank") & ~F.col("_before").eqNullSafe(F.col("_size"))).cast("int"))
    s = s.withColumns({"_rank": F.sum("_opens").over(so_far), "_counted": F.last("_key", ignorenulls=True).over(so_far)})
    # the size of most characters, of equals the smallest, where a null size is smaller than all
    most = F.when(~F.col("_blank"), F.struct("_chars", F.col("_size").isNull().alias("none"), (-F.col("_size")).alias("minus")))
    s = s.withColumn("_body", F.max(most).over(Window.partitionBy("doc")))
    larger = (F.col("_size") > -F.col("_body.minus")) & (F.col("_size") == F.col("_counted")) & F.col("doc").isNotNull()
    level = F.when(larger, F.least(F.col("_rank").cast("int"), F.lit(LEVELS))).otherwise(0)
    return s.select(*spans.columns, level.alias("heading_level"))


def normalised(text: Column) -> Column:
    return trimmed(F.substring(trimmed(text), 1, 100))


def zone(y0: Column, y1: Column, height: Column) -> Column:
    """header within the upper 72 points, else footer within the lower, else null."""
    return F.when(y0 < ZONE, "header").when(y1 > height - ZONE, "footer")


def repeated_texts(spans: DataFrame) -> DataFrame:
    """(doc, zone, norm, n): texts that stand at least three times in a document's upper or lower zone."""
    rows = spans.select("doc", zone(F.col("y0"), F.col("y1"), F.col("page_height")).alias("zone"), normalised(F.col("text")).alias("norm"))
    return rows.filter("zone IS NOT NULL AND norm <> ''").groupBy("doc", "zone", "norm").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= REPEATED)


def without_running_text(spans: DataFrame) -> DataFrame:
    """Spans that are no repeated header or footer (see ``repeated_texts``); a span in both zones is tested for both.

    Each text of a document is counted by a window, so spans that lie by document already do not move, and nothing is read twice.
    """
    same = Window.partitionBy("doc", "_norm")
    s = spans.withColumn("_norm", normalised(F.col("text"))).withColumn("_zone", zone(F.col("y0"), F.col("y1"), F.col("page_height")))
    s = s.withColumns({"_headers": F.count_if(F.col("_zone") == "header").over(same), "_footers": F.count_if(F.col("_zone") == "footer").over(same)})
    repeated = ((F.col("_headers") >= REPEATED) & (F.col("y0") < ZONE)) | ((F.col("_footers") >= REPEATED) & (F.col("y1") > F.col("page_height") - ZONE))
    running = F.col("doc").isNotNull() & (F.col("_norm") != "") & repeated
    return s.filter(~F.coalesce(running, F.lit(False))).drop("_norm", "_zone", "_headers", "_footers")


def outside_tables(spans: DataFrame, tables: DataFrame) -> DataFrame:
    """Spans whose centre lies in no table (doc, page, x0, y0, x1, y1) of their page, with 5 points around it. An equi-join on the page carries the range test."""
    t = tables.select(F.col("doc").alias("_d"), F.col("page").alias("_p"), *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = x.between(F.col("_x0") - BOX_PADDING, F.col("_x1") + BOX_PADDING) & y.between(F.col("_y0") - BOX_PADDING, F.col("_y1") + BOX_PADDING)
    return spans.join(t, (F.col("doc") == F.col("_d")) & (F.col("page") == F.col("_p")) & inside, "left_anti")


def page_lines(spans: DataFrame, *columns: Column | str) -> DataFrame:
    """(doc, page, lines): a page's spans in order, as an array of lines, each an array of (seq, y0, columns).

    A line holds neighbours whose y0 is within 5 points of the y0 of the line's first span. This anchor makes it a fold over each page's spans. The fold collects the places
    at which lines start, some at a time, so that no long array is copied for each span; the lines are slices between these places.
    """
    starts = "array<int>"
    zero = F.struct(F.array().cast(f"array<{starts}>").alias("done"), F.array().cast(starts).alias("open"), F.lit(None).cast("double").alias("y"))

    def step(a: Column, x: Column) -> Column:
        full = F.size(a["open"]) >= OPEN_STARTS
        own = F.array(x["at"])
        opened = F.struct(F.when(full, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]).alias("done"), F.when(full, own).otherwise(F.concat(a["open"], own)).alias("open"), x["y"].alias("y"))
        return F.when(F.coalesce(F.abs(x["y"] - a["y"]) <= SAME_LINE, F.lit(False)), a).otherwise(opened)

    def cut(s: Column) -> Column:
        placed = F.transform(s, lambda x, i: F.struct((i + 1).alias("at"), x["y0"].cast("double").alias("y")))
        found = F.aggregate(placed, zero, step, lambda a: F.concat(F.flatten(a["done"]), a["open"]))
        return let(found, lambda begins: F.transform(begins, lambda at, k: F.slice(s, at, F.coalesce(F.get(begins, k + 1), F.size(s) + 1) - at)))

    pages = spans.groupBy("doc", "page").agg(F.sort_array(F.collect_list(F.struct("seq", "y0", *columns))).alias("_s"))
    return pages.select("doc", "page", cut(F.col("_s")).alias("lines"))


def line_groups(spans: DataFrame) -> DataFrame:
    """Spans with ``line``, the number of their line in the page (see ``page_lines``)."""
    others = [c for c in spans.columns if c not in ("doc", "page", "seq", "y0")]
    # a page has a line at least; the outer forms spare a test of the fold's result, which would compute it twice
    lines = page_lines(spans, *others).select("doc", "page", F.posexplode_outer("lines").alias("line", "_l"))
    return lines.select("doc", "page", "line", F.inline_outer("_l")).select(*spans.columns, "line")


def inline(text: Column, bold: Column, italic: Column, escape: bool = True) -> Column:
    """Body text in Markdown, blank text as it is."""
    safe = F.replace(F.replace(text, F.lit("*"), F.lit("\\*")), F.lit("_"), F.lit("\\_")) if escape else text
    mark = F.when(bold & italic, "***").when(bold, "**").when(italic, "*").otherwise("")
    return F.when(trimmed(text) == "", text).otherwise(F.concat(mark, safe, mark))


def section_type(text: Column) -> Column:
    """anejo, anexo or apendice where a heading has such a word, else main."""
    out = F.when(F.length(text) < LEAST_WORD, "main")
    for name, pattern in SECTION_WORDS.items():
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("main")


def lines_to_markdown(spans: DataFrame) -> DataFrame:
    """(doc, page, line, y0, md) of the lines of spans with heading_level: headings with their marks, appendices after a rule, body spans put together."""
    title, body = trimmed(F.col("text")).alias("title"), inline(F.col("text"), F.col("is_bold"), F.col("is_italic")).alias("body")
    of_line = lambda l: F.struct(
        F.array_min(l["y0"]).alias("y0"), F.element_at(l, 1)["heading_level"].alias("first"), F.array_join(F.array_remove(l["title"], ""), " ").alias("title"), F.array_join(l["body"], "").alias("body")
    )
    pages = page_lines(spans, "heading_level", title, body).select("doc", "page", F.posexplode_outer(F.transform("lines", of_line)).alias("line", "_l"))
    lines = pages.select("doc", "page", "line", "_l.*").filter((F.col("first") > 0) | (trimmed(F.col("body")) != ""))
    heading = F.concat(F.repeat(F.lit("#"), F.col("first")), F.lit(" "), F.col("title"))
    marked = F.when(section_type(F.col("title")) != "main", F.concat(F.lit("---\n\n"), heading, F.lit("\n\n*[Appendix section]*"))).otherwise(heading)
    md = F.when(F.col("first") > 0, marked).otherwise(F.col("body"))
    return lines.select("doc", "page", "line", "y0", md.alias("md"))


def interleaved(*parts: DataFrame) -> DataFrame:
    """(doc, page, md) of pages' parts (doc, page, y0, kind_no, seq, md) in reading order: by height, then kind, then order."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    ordered = F.sort_array(F.collect_list(F.struct("y0", "kind_no", "seq", "md")))
    return rows.groupBy("doc", "page").agg(F.array_join(F.transform(ordered, lambda r: r["md"]), "\n\n").alias("md"))


def documents_markdown(pages: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc, md): title, then each page under its marker."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "md"))), lambda p: F.concat(F.lit("<!-- Page "), p["page"].cast("string"), F.lit(" -->\n\n"), p["md"])), "\n\n")
    return pages.groupBy("doc").agg(text.alias("_md")).join(titles, "doc").select("doc", F.concat(F.lit("# "), "title", F.lit("\n\n"), "_md").alias("md"))


def titles(spans: DataFrame) -> DataFrame:
    """(doc, title): the first heading of level 1, else the document's name."""
    first = F.min(F.when(F.col("heading_level") == 1, F.struct("page", "seq", "text")))
    return spans.groupBy("doc").agg(first.alias("_t")).select("doc", F.coalesce(trimmed(F.col("_t.text")), F.col("doc").cast("string")).alias("title"))


def forward_filled(cells: DataFrame) -> DataFrame:
    """Table cells (table, row, col, value) with missing values taken from the left, then from above."""
    left = Window.partitionBy("table", "row").orderBy("col").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = Window.partitionBy("table", "col").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cells.withColumn("value", F.last("value", ignorenulls=True).over(left)).withColumn("value", F.last("value", ignorenulls=True).over(above))


def is_table(rows: Column) -> Column:
    """Whether cells found without borders make a table: two rows, two columns, a fifth of the cells filled, rows of nearly one width."""
    cells = F.flatten(rows)
    filled = F.size(F.filter(cells, lambda c: F.coalesce(strip(c), F.lit("")) != ""))
    widths = F.transform(rows, F.size)
    return (F.size(rows) >= 2) & (F.size(F.get(rows, F.lit(0))) >= 2) & (filled >= F.size(cells) * F.lit(0.2)) & (F.array_max(widths) - F.array_min(widths) <= 2)


def header_names(header: Column, rows: Column) -> Column:
    """A table's column names: its header, else its first row, missing names empty."""
    return F.transform(F.coalesce(header, F.get(rows, F.lit(0)), F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit("")))


def page_type(text_length: Column, image_coverage: Column, n_images: Column) -> Column:
    """empty, scanned, native_text or mixed by text (over 10 characters), images and the share of the page they cover."""
    has_text = text_length > 10
    return (
        F.when(has_text & (image_coverage < 0.5), "native_text").when(has_text, "mixed").when((image_coverage > 0.95) | (n_images > 0), "scanned").otherwise("empty")
    )


def image_coverage(boxes: Column, width: Column, height: Column) -> Column:
    """Share of the page under images, at most 1."""
    area = F.aggregate(boxes, F.lit(0.0), lambda s, b: s + (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]))
    return F.when(width * height > 0, F.least(area / (width * height), F.lit(1.0))).otherwise(0.0)


def ocr_confidence(words: Column) -> Column:
    """Mean confidence of recognised words, of those above 0, as a share."""
    good = F.filter(words, lambda c: c > 0)
    return F.when(F.size(good) > 0, F.aggregate(good, F.lit(0.0), lambda s, c: s + c) / F.size(good) / 100).otherwise(0.0)


def large_images(images: DataFrame) -> DataFrame:
    return images.filter((F.col("width") >= LEAST_IMAGE) & (F.col("height") >= LEAST_IMAGE))
