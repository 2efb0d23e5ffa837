"""The library's text functions for SQL users: temporary SQL functions and table functions whose bodies are the library's own column expressions.

A call is replaced by its body when a query is planned, so it runs in the JVM as the column functions do, and there is one definition of each result:

    register(spark)
    spark.sql("SELECT d.doc_id, c.* FROM documents d, LATERAL chunk_document(d.text) c WHERE content_kind(c.text) = 'table'")

Scalar functions: token_count, content_kind, quantitative, cut_text, clean_markdown, paragraph_runs, page_span, search_terms, sections_of, chunks_of.
Table functions: chunk_document (a row per chunk) and document_sections (a row per section). A null text has no chunks and no sections.
Documents without chunks are kept by ``LATERAL VIEW OUTER inline(chunks)`` over a column of chunks_of(text); Spark leaves them out of a LEFT JOIN LATERAL with a generator.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions import text as tx
from ..functions.text import let
from ..operators import chunking

_STRING = r"'(?:[^'\\]|\\.)*'"
_SIGNS = r"<=>|<=|>=|[-+*/%=<>!&|^~]"
_TOKEN = re.compile(rf"{_STRING}|`[^`]*`|(?<![\w.])\d+\.\d+(?:E-?\d+)?(?![\w.])|(?<=[\s(,])(?:{_SIGNS})\(|^(?:{_SIGNS})\(", re.S)


def sql_of(column: Column) -> str:
    """A column as SQL. Spark prints signs as the names of functions, which SQL takes in quotes, and doubles as decimals, which SQL takes for exact numbers."""

    def quoted(m: re.Match) -> str:
        token = m[0]
        return token if token[0] in "'`" else f"`{token[:-1]}`(" if token[-1] == "(" else f"{token}D"

    return _TOKEN.sub(quoted, str(column)[len("Column<'") : -len("'>")])


def _chunks(skip_exact: Sequence[str], skip_prefixes: Sequence[str]) -> Callable[[Column, Column], Column]:
    def chunks(text: Column, context: Column) -> Column:
        before = F.when(F.coalesce(context, F.lit("")) != "", F.concat(context, F.lit("\n\n"))).otherwise("")
        pieces = let(md.clean_markdown(text), lambda clean: chunking.chunk_sections(md.sections(clean), before, skip_exact, skip_prefixes))
        return let(pieces, chunking.merge_chunks)

    return chunks


def scalar_functions(skip_exact: Sequence[str] = (), skip_prefixes: Sequence[str] = ()) -> dict[str, tuple[str, Callable[..., Column]]]:
    """Parameters and body of each scalar function by name."""
    return {
        "token_count": ("text STRING", tx.estimate_tokens),
        "content_kind": ("text STRING", tx.content_type),
        "quantitative": ("text STRING", tx.has_quantity),
        "cut_text": ("text STRING", tx.truncated),
        "clean_markdown": ("text STRING", md.clean_markdown),
        "paragraph_runs": ("text STRING", chunking.split_paragraphs),
        "page_span": ("text STRING", tx.page_range),
        "search_terms": ("text STRING", tx.search_terms),
        "sections_of": ("text STRING", lambda text: let(md.clean_markdown(text), md.sections)),
        "chunks_of": ("text STRING, context STRING DEFAULT ''", _chunks(skip_exact, skip_prefixes)),
    }


#: Table functions, each by the scalar function whose array has its rows.
TABLES = {"chunk_document": "chunks_of", "document_sections": "sections_of"}
#: Rounds that the analyser may take: it resolves about one level of nested expressions in each.
ROUNDS = 1000


def register(spark: SparkSession, skip_exact: Sequence[str] = (), skip_prefixes: Sequence[str] = ()) -> None:
    """Creates the functions in the session; chunk_document leaves out sections by the titles given here. Registering again replaces them.

    The bodies are deep, so the session's limit of analyser rounds is raised to ROUNDS where it is lower. A table function's body is a generator over an
    expression and nothing else: a lateral call of it becomes that generator over the caller's rows, without a join.
    """
    limit = "spark.sql.analyzer.maxIterations"
    if int(spark.conf.get(limit)) < ROUNDS:
        spark.conf.set(limit, str(ROUNDS))
    tables = {source: name for name, source in TABLES.items()}
    for name, (params, body) in scalar_functions(skip_exact, skip_prefixes).items():
        plain = params.replace(" DEFAULT ''", "")
        empty = spark.createDataFrame([], plain)
        out = body(*(F.col(c) for c in empty.columns))
        kind, text = empty.select(out.alias("out")).schema["out"].dataType, sql_of(out)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind.simpleString()} RETURN {text}")
        if name in tables:
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind.elementType.fields)
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {tables[name]}({params}) RETURNS TABLE ({columns}) RETURN SELECT * FROM inline({text})")
