"""Column builders over text. All are built-in expressions, so they stay in the JVM and in the scan's stage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sizes that sections and chunks are measured against.
TOKENS_PER_WORD = 1.3
MAX_SECTION_TOKENS = 1500
MIN_CHUNK_TOKENS = 100
OVERLAP_TOKENS = 125
MAX_CHUNK_TOKENS = 1800
# Patterns whose matches decide results.
QUANTITIES = [
    r"\d+[.,]\d+\s*%",
    r"\d+\s*%",
    r"\$[\d,]+",
    r"\d{1,3}(?:,\d{3})+",
    r"\d+\s*(?:personas|residentes|habitantes|viviendas|hogares|familias)",
]
LIST_LINE = r"^[-*•]\s|^\d+[.)]\s"
PAGE_MARKER = r"<!--\s*Page\s+(\d+)\s*-->"
PARAGRAPH_BREAK = r"\n\s*\n"
#: White space as in Unicode, with the four separators that Java leaves out.
SPACE = r"[\s\x1c-\x1f]"
#: The same, character by character.
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def words(text: Column) -> Column:
    """Words between runs of white space."""
    return F.filter(F.split(text, f"(?U){SPACE}+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text))


def estimate_tokens(text: Column) -> Column:
    """Words times 1.3, rounded down."""
    return F.floor(n_words(text) * F.lit(TOKENS_PER_WORD)).cast("int")


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def trimmed(text: Column) -> Column:
    """``strip`` for short texts, many of them: the same characters go, without a regular expression, and texts between two visible ASCII characters stay untouched."""
    return F.when(F.ascii(text).between(33, 126) & F.ascii(F.substring(text, -1, 1)).between(33, 126), text).otherwise(F.btrim(text, F.lit(SPACES)))


def paragraphs(text: Column) -> Column:
    """Stripped paragraphs that are not empty, between blank lines."""
    return F.filter(F.transform(F.split(text, f"(?U){PARAGRAPH_BREAK}"), strip), lambda p: p != "")


def content_type(text: Column) -> Column:
    """table or list where more than 40 % of the non-blank lines are such (table first), mixed where any is, else prose."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    counts = let(
        lines,
        lambda x: F.struct(
            F.size(x).alias("n"), F.size(F.filter(x, lambda y: y.contains("|"))).alias("tables"), F.size(F.filter(x, lambda y: y.rlike(f"(?U){LIST_LINE}"))).alias("lists")
        ),
    )
    return let(
        counts,
        lambda c: F.when(c["n"] == 0, "prose").when(c["tables"] > c["n"] * F.lit(0.4), "table").when(c["lists"] > c["n"] * F.lit(0.4), "list")
        .when((c["tables"] > 0) | (c["lists"] > 0), "mixed").otherwise("prose"),
    )


def has_quantity(text: Column) -> Column:
    """Whether a percentage, an amount of money, a grouped number or a count of people or homes occurs."""
    out = F.lit(False)
    for pattern in QUANTITIES:
        out = out | text.rlike(f"(?U){pattern}")
    return out


def truncated(text: Column, max_tokens: int = MAX_CHUNK_TOKENS) -> Column:
    """The first words that fit, joined by single spaces, where the text has more; else the text as it is."""
    most = int(max_tokens / TOKENS_PER_WORD)
    return let(words(text), lambda w: F.when(F.size(w) > most, F.array_join(F.slice(w, 1, most), " ")).otherwise(text))


def page_range(text: Column) -> Column:
    """(page_start, page_end) of the page markers in a text, -1 where there are none."""
    pages = F.transform(F.regexp_extract_all(text, F.lit(PAGE_MARKER), F.lit(1)), lambda p: p.cast("int"))
    return let(pages, lambda p: F.struct(F.coalesce(F.array_min(p), F.lit(-1)).alias("page_start"), F.coalesce(F.array_max(p), F.lit(-1)).alias("page_end")))


def context_line(values: Sequence[tuple[str, Column]]) -> Column:
    """``name: value`` of the values that are not empty, comma-joined, and a blank line; empty where none is."""
    parts = F.filter(F.array(*[F.when(v != "", F.concat(F.lit(f"{k}: "), v)) for k, v in values]), lambda p: p.isNotNull()) if values else F.array().cast("array<string>")
    return let(parts, lambda p: F.when(F.size(p) > 0, F.concat(F.array_join(p, ", "), F.lit("\n\n"))).otherwise(""))


def extract(text: Column, pattern: str) -> Column:
    """The first match of a pattern: its first group if it took part, the whole match if none did, null without a match."""
    import re

    groups = re.compile(pattern).groups
    whole = F.regexp_substr(text, F.lit(pattern))
    if not groups:
        return F.when(text != "", whole)
    first = F.regexp_extract(text, pattern, 1)
    # an empty first group is told from one that took no part by the pattern itself only; an empty value is taken for the latter
    return F.when((text != "") & whole.isNotNull(), F.when(first != "", first).otherwise(whole) if groups == 1 else F.when(first != "", first))


def mapped(value: Column, mapping: Mapping[str, str]) -> Column:
    """The mapping's entry for a value, null without one."""
    if not mapping:
        return F.lit(None).cast("string")
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.try_element_at(table, value)


def escape_search(text: Column) -> Column:
    """Signs of a search syntax with a backslash before each."""
    return F.regexp_replace(text, r'([+\-!(){}\[\]^"~*?:\\/])', r"\\$1")


def cache_key(text: Column) -> Column:
    """MD5 of the first 500 characters."""
    return F.md5(F.substring(text, 1, 500))


def prefix_key(text: Column) -> Column:
    """The first 200 characters, by which results count as the same."""
    return F.substring(text, 1, 200)


def skipped_title(title: Column, exact: Sequence[str] = (), prefixes: Sequence[str] = ()) -> Column:
    """Whether a section's title is on the list of titles or of beginnings, in either case."""
    low = F.lower(title)
    out = low.isin([x.lower() for x in exact]) if exact else F.lit(False)
    for p in prefixes:
        out = out | low.startswith(p.lower())
    return out


def search_terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, the terms of full-text search."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def title_of_file(name: Column) -> Column:
    """A document's title from its file name."""
    return F.replace(F.replace(name, F.lit(".md"), F.lit("")), F.lit("_"), F.lit(" "))


def passage(text: Column, context: Column) -> Column:
    """What is embedded of a chunk."""
    return F.concat(F.lit("search_document: "), F.when(F.coalesce(context, F.lit("")) != "", F.concat(context, F.lit("\n\n"), text)).otherwise(text))


def readable_share(text: Column) -> Column:
    """Whether at most 1 % of the characters are replacement characters."""
    bad = F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))
    return (text == "") | (bad <= F.length(text) * F.lit(0.01))
