"""Chunks of documents: ordered folds over arrays, one document a row, no shuffle.

The folds carry indices only; texts are put together from slices at the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions import text as tx
from ..functions.text import let

RANGES = "array<struct<s:int,e:int>>"
PIECE = "array<struct<section_title:string,section_level:int,header:string,body:string>>"


def running_sums(sizes: Column, step: int = 256) -> Column:
    """0 and the sums of the first 1, 2, ... numbers of an array: sums of steps first, and within a step from its beginning, so that no long array is copied for each number."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, n: a + n)
    steps = F.transform(F.sequence(F.lit(0), F.floor(F.size(sizes) / step).cast("int")), lambda c: total(F.slice(sizes, c * step + 1, F.lit(step))))
    before = F.aggregate(steps, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))

    def upto(b: Column, i: Column) -> Column:
        c = F.floor(i / step).cast("int")
        return F.get(b, c) + total(F.slice(sizes, c * step + 1, i - c * step))

    return let(before, lambda b: F.transform(F.sequence(F.lit(0), F.size(sizes)), lambda i: upto(b, i)))


def split_paragraphs(text: Column, most: int = tx.MAX_SECTION_TOKENS, overlap: int = tx.OVERLAP_TOKENS) -> Column:
    """Runs of paragraphs of up to ``most`` tokens; each begins with those last paragraphs of the run before that have up to ``overlap`` tokens.

    A text without paragraphs is one run as it is. Every run is a range of paragraphs: with prefix sums, the fold's state is the ranges so far and the start of the open one.
    """
    parts = tx.paragraphs(text)

    def of(parts: Column) -> Column:
        sizes = F.transform(parts, tx.estimate_tokens)
        sums = let(sizes, running_sums)

        def ranges(sums: Column) -> Column:
            zero = F.struct(F.array().cast(RANGES).alias("out"), F.lit(0).alias("s"))

            def step(a: Column, j: Column) -> Column:
                full = (j > a["s"]) & (F.get(sums, j + 1) - F.get(sums, a["s"]) > most)
                again = F.coalesce(F.array_min(F.filter(F.sequence(a["s"], j), lambda s: F.get(sums, j) - F.get(sums, s) <= overlap)), j)
                closed = F.concat(a["out"], F.array(F.struct(a["s"].alias("s"), (j - 1).alias("e"))))
                return F.when(full, F.struct(closed.alias("out"), again.alias("s"))).otherwise(a)

            end = F.size(sums) - 1
            return F.aggregate(F.sequence(F.lit(0), end - 1), zero, step, lambda a: F.concat(a["out"], F.array(F.struct(a["s"].alias("s"), (end - 1).alias("e")))))

        found = F.flatten(F.transform(F.array(sums), ranges))
        return F.transform(found, lambda r: F.array_join(F.slice(parts, r["s"] + 1, r["e"] - r["s"] + 1), "\n\n"))

    return F.flatten(F.transform(F.array(parts), lambda p: F.when(F.size(p) == 0, F.array(text)).otherwise(of(p))))


def _pieces(sections: Column, skip_exact: Sequence[str], skip_prefixes: Sequence[str]) -> Column:
    """A section as a whole where it fits, else by subsections, else by paragraphs."""
    empty = F.array().cast(PIECE)

    def piece(title: Column, level: Column, header: Column, body: Column) -> Column:
        return F.struct(title.alias("section_title"), level.alias("section_level"), header.alias("header"), body.alias("body"))

    def fitted(title: Column, level: Column, header: Column, body: Column) -> Column:
        whole = F.array(piece(title, level, header, body))
        return F.when(tx.estimate_tokens(body) <= tx.MAX_SECTION_TOKENS, whole).otherwise(F.transform(split_paragraphs(body), lambda b: piece(title, level, header, b)))

    def of(x: Column) -> Column:
        s, full, tokens = x["s"], x["full"], x["tokens"]
        header = F.when(s["title"] != "", F.concat(F.lit("## "), s["title"], F.lit("\n\n"))).otherwise("")
        own = F.when(tx.strip(s["content"]) != "", fitted(s["title"], s["level"], header, tx.strip(s["content"]))).otherwise(empty)
        subs = F.flatten(
            F.transform(
                s["subsections"],
                lambda b: fitted(F.concat(s["title"], F.lit(" > "), b["title"]), b["level"], F.concat(F.lit("## "), s["title"], F.lit("\n### "), b["title"], F.lit("\n\n")), b["content"]),
            )
        )
        return (
            F.when(tx.skipped_title(s["title"], skip_exact, skip_prefixes) | (tokens < tx.MIN_CHUNK_TOKENS), empty)
            .when(tokens <= tx.MAX_SECTION_TOKENS, F.array(piece(s["title"], s["level"], header, full)))
            .when(F.size(s["subsections"]) > 0, F.concat(own, subs))
            .otherwise(F.transform(split_paragraphs(full), lambda b: piece(s["title"], s["level"], header, b)))
        )

    sized = F.transform(sections, lambda s: F.struct(s.alias("s"), md.full_text(s).alias("full")))
    sized = F.transform(sized, lambda x: F.struct(x["s"].alias("s"), x["full"].alias("full"), tx.estimate_tokens(x["full"]).alias("tokens")))
    return F.flatten(F.transform(sized, of))


def chunk_sections(sections: Column, context: Column, skip_exact: Sequence[str] = (), skip_prefixes: Sequence[str] = ()) -> Column:
    """Chunks (text, section_title, section_level, content_type, has_quantitative_data) of sections, in order, before small ones are merged."""
    return F.transform(
        _pieces(sections, skip_exact, skip_prefixes),
        lambda p: F.struct(
            F.concat(context, p["header"], p["body"]).alias("text"), p["section_title"].alias("section_title"), p["section_level"].alias("section_level"),
            tx.content_type(p["body"]).alias("content_type"), tx.has_quantity(p["body"]).alias("has_quantitative_data"),
        ),
    )


def merge_chunks(chunks: Column) -> Column:
    """Neighbouring small chunks of a document merged up to a section's size, oversized ones cut; numbered, with page ranges.

    The fold's state is the ranges so far, the start of the open run of small chunks (-1: none) and the words in it.
    """
    small, most = tx.MIN_CHUNK_TOKENS * 2, tx.MAX_SECTION_TOKENS
    sized = F.transform(chunks, lambda c: tx.n_words(c["text"]))
    tokens = lambda n: F.floor(n * F.lit(tx.TOKENS_PER_WORD)).cast("int")
    zero = F.struct(F.array().cast(RANGES).alias("out"), F.lit(-1).alias("s"), F.lit(0).alias("n"), F.lit(0).alias("i"))

    def step(a: Column, n: Column) -> Column:
        i, open_ = a["i"], a["s"] >= 0
        one = lambda s, e: F.array(F.struct(s.alias("s"), e.alias("e")))
        flushed = F.when(open_, F.concat(a["out"], one(a["s"], i - 1))).otherwise(a["out"])
        big = tokens(n) >= small
        fits = open_ & (tokens(a["n"]) + tokens(n) <= most)
        return F.struct(
            F.when(big, F.concat(flushed, one(i, i))).when(fits, a["out"]).otherwise(flushed).alias("out"),
            F.when(big, F.lit(-1)).when(fits, a["s"]).otherwise(i).alias("s"),
            F.when(big, F.lit(0)).when(fits, a["n"] + n).otherwise(n).alias("n"),
            (i + 1).alias("i"),
        )

    ranges = F.aggregate(sized, zero, step, lambda a: F.when(a["s"] >= 0, F.concat(a["out"], F.array(F.struct(a["s"].alias("s"), (a["i"] - 1).alias("e"))))).otherwise(a["out"]))

    def chunk(r: Column) -> Column:
        own = F.slice(chunks, r["s"] + 1, r["e"] - r["s"] + 1)
        return F.struct(own.alias("own"), F.array_join(F.transform(own, lambda c: c["text"]), "\n\n").alias("text"))

    def shaped(x: Column, i: Column) -> Column:
        own, first = x["own"], F.element_at(x["own"], 1)
        merged = F.size(own) > 1
        text = F.when(merged, x["text"]).otherwise(tx.truncated(x["text"]))
        titles = F.filter(F.transform(own, lambda c: c["section_title"]), lambda t: t != "")
        return F.struct(
            text.alias("text"), F.coalesce(F.get(titles, F.lit(0)), F.lit("")).alias("section_title"), first["section_level"].alias("section_level"),
            F.when(merged, tx.content_type(text)).otherwise(first["content_type"]).alias("content_type"),
            F.exists(own, lambda c: c["has_quantitative_data"]).alias("has_quantitative_data"), i.alias("chunk_index"),
            tx.page_range(text)["page_start"].alias("page_start"), tx.page_range(text)["page_end"].alias("page_end"),
        )

    return F.transform(F.transform(ranges, chunk), shaped)


def process_documents(
    documents: DataFrame, entities: Sequence[str] = (), skip_exact: Sequence[str] = (), skip_prefixes: Sequence[str] = (), text_col: str = "text", keep: Sequence[str] = ("source_file", "document_type"),
) -> DataFrame:
    """One row per chunk: ``keep`` and entity columns of its document, and the chunk's fields.

    Map-side only: cleaning, parsing, chunking and merging are expressions over one document.
    """
    text = md.clean_markdown(F.coalesce(F.col(text_col), F.lit("")))
    context = tx.context_line([(e, F.col(e)) for e in entities])
    docs = documents.select(*keep, *entities, context.alias("_context"), text.alias("_text"))
    docs = docs.select(*keep, *entities, "_context", md.sections(F.col("_text")).alias("_sections"))
    docs = docs.select(*keep, *entities, chunk_sections(F.col("_sections"), F.col("_context"), skip_exact, skip_prefixes).alias("_chunks"))
    return docs.select(*keep, *entities, F.explode(merge_chunks(F.col("_chunks"))).alias("_c")).select(*keep, *entities, "_c.*")
