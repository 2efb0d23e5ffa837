"""Markdown by columns: cleaning, and sections as arrays of structs. A document is one row throughout, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import MIN_CHUNK_TOKENS, estimate_tokens, let, strip

# Patterns whose matches decide results.
HEADING = r"(?Ud)^(#{1,4})\s+(.+)$"
IMAGE = r"(?Ud)^!\[([^\]]*)\]\([^)]+\)\s*$"
CAPTION = r"(?U)^Imagen\s+\d+\."
PAGE_NUMBER = r"(?U)^(?:[ivxlc]+|\d{1,3})$"
CONTENTS_TOKENS = 30
SECTION = "struct<title:string,level:int,content:string,subsections:array<struct<title:string,level:int,content:string>>>"


def clean_markdown(text: Column) -> Column:
    """Without image lines, the line after an image that repeats its description, captions and bare page numbers.

    Only the first line after an image that is not blank can repeat its description, so a line is compared with the line before it among those that are not blank.
    """
    lines = F.split(text, "\n")
    filled = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), strip(x).alias("line"))), lambda x: x["line"] != "")

    def dropped(line: Column, before: Column) -> Column:
        repeats = let(
            F.when(before.rlike(IMAGE), strip(F.regexp_extract(before, IMAGE, 1))),
            lambda alt: (alt != "")
            & ((line == alt) | ((F.length(alt) > 20) & F.contains(line, F.substring(alt, 1, 30))) | ((F.length(line) > 40) & F.contains(line, F.substring(alt, 1, 20)))),
        )
        return line.rlike(IMAGE) | F.coalesce(repeats, F.lit(False)) | line.rlike(CAPTION) | line.rlike(PAGE_NUMBER)

    marked = let(filled, lambda f: F.transform(f, lambda x, k: F.struct(x["at"].alias("at"), dropped(x["line"], F.get(f, k - 1)["line"]).alias("drop"))))
    drops = F.transform(F.filter(marked, lambda x: x["drop"]), lambda x: x["at"])
    # what stands between two dropped lines is a slice, so each line is looked at once
    ends = F.concat(F.array(F.lit(-1)), drops, F.array(F.size(lines)))
    between = lambda d: F.transform(F.sequence(F.lit(0), F.size(d) - 2), lambda k: F.slice(lines, F.get(d, k) + 2, F.get(d, k + 1) - F.get(d, k) - 1))
    return let(ends, lambda d: F.array_join(F.flatten(between(d)), "\n"))


def _blocks(text: Column) -> Column:
    """What stands before the first heading (level 0, no title) and under each heading, in order."""
    first = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("level"), F.lit("").alias("title"))

    def of(lines: Column) -> Column:
        found = F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.length(F.regexp_extract(x, HEADING, 1)).alias("level"), strip(F.regexp_extract(x, HEADING, 2)).alias("title")))
        return let(F.concat(F.array(first), F.filter(found, lambda h: h["level"] > 0)), lambda heads: F.transform(heads, lambda h, k: block(lines, heads, h, k)))

    def block(lines: Column, heads: Column, h: Column, k: Column) -> Column:
        end = F.coalesce(F.get(heads, k + 1)["at"], F.size(lines))
        return F.struct(h["title"].alias("title"), h["level"].alias("level"), strip(F.array_join(F.slice(lines, h["at"] + 2, end - h["at"] - 1), "\n")).alias("content"))

    return let(F.split(text, "\n"), of)


def _nested(blocks: Column) -> Column:
    """Headings of level 1 and 2 open a section, those of level 3 and 4 a subsection of the section that is open."""
    mains = F.filter(F.transform(blocks, lambda b, k: F.struct(k.alias("at"), b.alias("b"))), lambda x: (x["b"]["level"] > 0) & (x["b"]["level"] <= 2))

    def section(mains: Column, m: Column, j: Column) -> Column:
        end = F.coalesce(F.get(mains, j + 1)["at"], F.size(blocks))
        return F.struct(m["b"]["title"].alias("title"), m["b"]["level"].alias("level"), m["b"]["content"].alias("content"), F.slice(blocks, m["at"] + 2, end - m["at"] - 1).alias("subsections"))

    return let(mains, lambda a: F.transform(a, lambda m, j: section(a, m, j)))


def _flat(blocks: Column) -> Column:
    """Each heading opens a section of level 2; blocks before the first one of 30 tokens are a table of contents."""
    sized = F.transform(blocks, lambda b, k: F.struct(k.alias("at"), estimate_tokens(b["content"]).alias("tokens"), b.alias("b")))
    last = F.size(blocks) - 1
    none = F.array().cast("array<struct<title:string,level:int,content:string>>")

    def kept(x: Column, begins: Column) -> Column:
        inner = F.coalesce(x["at"] >= begins, F.lit(False))
        return (x["b"]["content"] != "") & F.when(x["at"] < last, inner).otherwise(begins.isNotNull() | (x["tokens"] >= MIN_CHUNK_TOKENS))

    def of(sized: Column) -> Column:
        begins = F.array_min(F.transform(F.filter(sized, lambda x: (x["at"] < last) & (x["tokens"] >= CONTENTS_TOKENS)), lambda x: x["at"]))
        return let(begins, lambda n: F.filter(sized, lambda x: kept(x, n)))

    return F.transform(let(sized, of), lambda x: F.struct(x["b"]["title"].alias("title"), F.lit(2).alias("level"), x["b"]["content"].alias("content"), none.alias("subsections")))


def is_flat(text: Column) -> Column:
    """Whether no line begins with ``## ``."""
    return ~text.rlike(r"(?md)^## ")


def sections(text: Column) -> Column:
    """The sections of a Markdown text: array of (title, level, content, subsections)."""
    kind = f"array<{SECTION}>"
    return let(_blocks(text), lambda blocks: F.when(is_flat(text), _flat(blocks).cast(kind)).otherwise(_nested(blocks).cast(kind)))


def full_text(section: Column) -> Column:
    """A section with its subsections, each under its title."""
    subs = F.transform(section["subsections"], lambda s: F.concat(F.lit("### "), s["title"], F.lit("\n\n"), s["content"]))
    own = F.when(section["content"] != "", F.array(section["content"])).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(own, subs), "\n\n")
