"""The engine's operators as queries over the driver's tables, each with its DuckDB equivalent where SQL can express it.

documents stand for Markdown files (source: document type, lang: entity), conversations for documents with sections, embeddings for vectors, benchmark for
queries, nation and region for a mapping chain, lineitem and part for page content and volume, events for changing files.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions import text as tx
from ..config import RESULT_DEFAULTS
from ..operators import catalog, chunking, enrich, evaluation, filters, layout, manifest, pages, search, tablefinding, textindex, vectors as vector_operators
from ..sources import pages as sources_pages
from ..sources.chunktable import ChunkTable
from ..sources.workspace import new_path
from ..streaming import changes as changes_stream
from . import sqlfunctions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BOOSTS = {"src0": 1.2, "src1": 1.1, "src2": 0.9}
BOOST_SQL = "CASE document_type WHEN 'src0' THEN 1.2::DOUBLE WHEN 'src1' THEN 1.1::DOUBLE WHEN 'src2' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def chunks_of(spark: SparkSession, d: str) -> DataFrame:
    """documents as a chunk table."""
    return t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("document_type"), "lang", F.col("doc_id").cast("string").alias("source_file"), F.lit(0).alias("chunk_index"))


CHUNKS = "chunks AS (SELECT doc_id AS chunk_id, text, source AS document_type, lang FROM documents)"
WORDS = "list_filter(regexp_split_to_array({0}, '[\\s]+'), lambda w: w <> '')"
TOKENS = "floor(len(" + WORDS + ") * 1.3::DOUBLE)::INT"


# ---- scalar functions ----


@query(f"SELECT doc_id, {TOKENS.format('text')} AS tokens FROM documents")
def token_estimate(spark, d):
    return t(spark, d, "documents").select("doc_id", tx.estimate_tokens(F.col("text")).alias("tokens"))


@query(r"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, E' \t\r')), lambda x: x <> '') AS l FROM documents),
c AS (SELECT doc_id, len(l) AS n, len(list_filter(l, lambda x: contains(x, '|'))) AS tb, len(list_filter(l, lambda x: regexp_matches(x, '^[-*•]\s|^\d+[.)]\s'))) AS ls FROM l)
SELECT doc_id, CASE WHEN n = 0 THEN 'prose' WHEN tb > n * 0.4::DOUBLE THEN 'table' WHEN ls > n * 0.4::DOUBLE THEN 'list' WHEN tb + ls > 0 THEN 'mixed' ELSE 'prose' END AS content_type FROM c
""")
def content_type(spark, d):
    return t(spark, d, "documents").select("doc_id", tx.content_type(F.col("text")).alias("content_type"))


@query(r"""
SELECT doc_id, regexp_matches(text, '\d+[.,]\d+\s*%') OR regexp_matches(text, '\d+\s*%') OR regexp_matches(text, '\$[\d,]+') OR regexp_matches(text, '\d{1,3}(?:,\d{3})+')
  OR regexp_matches(text, '\d+\s*(?:personas|residentes|habitantes|viviendas|hogares|familias)') AS quantitative FROM documents
""")
def quantitative_flag(spark, d):
    return t(spark, d, "documents").select("doc_id", tx.has_quantity(F.col("text")).alias("quantitative"))


@query(f"SELECT doc_id, CASE WHEN len({WORDS.format('text')}) > 1384 THEN array_to_string(({WORDS.format('text')})[:1384], ' ') ELSE text END AS text FROM documents")
def truncate_text(spark, d):
    return t(spark, d, "documents").select("doc_id", tx.truncated(F.col("text")).alias("text"))


def _pictured(spark, d):
    """Turns under an image line that describes them, with a caption and a page number."""
    turns = t(spark, d, "conversations")
    alt = F.substring(F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("]"), F.lit("")), 1, 40)
    return turns.select("conv_id", "turn", F.concat(F.lit("!["), alt, F.lit("](a.png)\n\n"), "text", F.lit("\nImagen 3. x\n"), F.col("turn").cast("string"), F.lit("\nend")).alias("text"))


@query(r"""
WITH s AS (SELECT conv_id, turn, '![' || substr(replace(replace(text, chr(10), ' '), ']', ''), 1, 40) || E'](a.png)\n\n' || text || E'\nImagen 3. x\n' || turn || E'\nend' AS text FROM conversations),
l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM s),
f AS (SELECT *, trim(line) AS st, CASE WHEN trim(line) <> '' THEN i END AS filled FROM l),
p AS (SELECT *, lag(st) OVER (PARTITION BY conv_id, turn, st <> '' ORDER BY i) AS prev FROM f),
a AS (SELECT *, CASE WHEN st <> '' AND regexp_matches(prev, '^!\[([^\]]*)\]\([^)]+\)\s*$') THEN trim(regexp_extract(prev, '^!\[([^\]]*)\]', 1)) ELSE '' END AS alt FROM p),
k AS (SELECT * FROM a WHERE NOT (regexp_matches(st, '^!\[([^\]]*)\]\([^)]+\)\s*$')
  OR (alt <> '' AND (st = alt OR (length(alt) > 20 AND contains(st, substr(alt, 1, 30))) OR (length(st) > 40 AND contains(st, substr(alt, 1, 20)))))
  OR regexp_matches(st, '^Imagen\s+\d+\.') OR regexp_matches(st, '^(?:[ivxlc]+|\d{1,3})$')))
SELECT conv_id, turn, string_agg(line, chr(10) ORDER BY i) AS text FROM k GROUP BY 1, 2
""")
def clean_markdown(spark, d):
    return _pictured(spark, d).select("conv_id", "turn", md.clean_markdown(F.col("text")).alias("text"))


# ---- sections and chunks ----


def conversations_md(spark, d):
    """A Markdown document per conversation: a section per user turn, answers as subsections, page markers."""
    turn = F.struct("turn", F.concat(F.when(F.col("role") == "user", "## ").otherwise("### "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n\n<!-- Page "), F.col("turn").cast("string"), F.lit(" -->\n\n"), F.trim("text")).alias("md"))
    grouped = t(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda x: x["md"]), "\n\n").alias("_md"))
    return grouped.select("conv_id", F.concat(F.lit("opening text\n\n"), "_md").alias("text"))


CONV = r"""c AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN 2 ELSE 3 END AS level, role || ' ' || turn AS title,
  trim(trim('<!-- Page ' || turn || E' -->\n\n' || trim(text), E' \n\r\t')) AS content FROM conversations),
n AS (SELECT *, sum((level = 2)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS main_no FROM c),
flat AS (SELECT conv_id FROM c GROUP BY 1 HAVING sum((level = 2)::INT) = 0)"""


@query(f"""
WITH {CONV}
SELECT conv_id, main_no::INT AS main_no, max(title) FILTER (level = 2) AS title, max(content) FILTER (level = 2) AS content,
       count(*) FILTER (level = 3) AS subsections, coalesce(string_agg(title, '|' ORDER BY turn) FILTER (level = 3), '') AS sub_titles
FROM n WHERE main_no > 0 GROUP BY 1, 2
""")
def sections_hierarchical(spark, d):
    s = conversations_md(spark, d).filter(~md.is_flat(F.col("text"))).select("conv_id", F.posexplode(md.sections(F.col("text"))).alias("i", "s"))
    return s.select("conv_id", (F.col("i") + 1).alias("main_no"), "s.title", "s.content", F.size("s.subsections").cast("long").alias("subsections"), F.array_join(F.transform("s.subsections", lambda x: x["title"]), "|").alias("sub_titles"))


def flat_md(spark, d):
    """Documents with a heading of level 1 before each line."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("# part "), i.cast("string"), F.lit("\n\n"), F.trim(x)))
    return t(spark, d, "documents").select("doc_id", F.concat(F.lit("front\n"), F.array_join(lines, "\n\n")).alias("text"))


@query(f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM documents),
s AS (SELECT doc_id, 'part ' || (i - 1) AS title, trim(content, E' \\t\\r') AS content, i, n FROM l UNION ALL SELECT doc_id, '', 'front', 0, max(n) FROM l GROUP BY doc_id),
k AS (SELECT *, {TOKENS.format('content')} AS tokens FROM s),
b AS (SELECT *, min(CASE WHEN i < n AND tokens >= 30 THEN i END) OVER (PARTITION BY doc_id) AS begins FROM k)
SELECT doc_id, title, 2 AS level, content FROM b WHERE content <> '' AND CASE WHEN i < n THEN coalesce(i >= begins, false) ELSE begins IS NOT NULL OR tokens >= 100 END
""")
def sections_flat(spark, d):
    return flat_md(spark, d).select("doc_id", F.explode(md.sections(F.col("text"))).alias("s")).select("doc_id", "s.title", "s.level", "s.content")


@query(f"""
WITH {CONV},
s AS (SELECT conv_id, main_no, max(title) FILTER (level = 2) AS title,
  string_agg(CASE WHEN level = 2 THEN content ELSE '### ' || title || E'\\n\\n' || content END, E'\\n\\n' ORDER BY turn) AS full_text FROM n WHERE main_no > 0 GROUP BY 1, 2)
SELECT conv_id, main_no::INT AS main_no, title, {TOKENS.format('full_text')} AS tokens FROM s
WHERE NOT (lower(title) = 'user 2' OR starts_with(lower(title), 'user 4')) AND {TOKENS.format('full_text')} >= 100
""")
def skip_sections(spark, d):
    s = conversations_md(spark, d).filter(~md.is_flat(F.col("text"))).select("conv_id", F.posexplode(md.sections(F.col("text"))).alias("i", "s"))
    s = s.select("conv_id", (F.col("i") + 1).alias("main_no"), "s.title", tx.estimate_tokens(md.full_text(F.col("s"))).alias("tokens"))
    return s.filter(~tx.skipped_title(F.col("title"), ["USER 2"], ["User 4"]) & (F.col("tokens") >= tx.MIN_CHUNK_TOKENS))


@query(f"""
WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, E' \\t\\r')), lambda x: x <> '') AS p FROM documents),
z AS (SELECT doc_id, p, list_transform(p, lambda x: {TOKENS.format('x')}) AS k FROM p WHERE len(p) > 0),
r AS (
  SELECT doc_id, 0 AS n, 1 AS s, 1 AS j, k, NULL::INT AS e, NULL::INT AS b FROM z
  UNION ALL
  SELECT doc_id, CASE WHEN fit THEN n ELSE n + 1 END, CASE WHEN fit THEN s ELSE again END, j + fit::INT, k, CASE WHEN NOT fit THEN j - 1 END, CASE WHEN NOT fit THEN s END
  FROM (SELECT *, (j = s OR forced OR coalesce(list_sum(k[s:j]), 0) <= 200) AS fit FROM (
    SELECT *, b IS NOT NULL AS forced, coalesce(list_min(list_filter(range(s, j + 1), lambda q: coalesce(list_sum(k[q:j - 1]), 0) <= 50)), j)::INT AS again FROM r)) WHERE j <= len(k)
)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1)::INT AS piece, array_to_string(p[b:e], E'\\n\\n') AS text
FROM (SELECT doc_id, n, b, e FROM r WHERE b IS NOT NULL UNION ALL SELECT doc_id, max(n) + 1, arg_max(s, j), arg_max(j, j) - 1 FROM r GROUP BY doc_id) JOIN z USING (doc_id)
""")
def split_paragraphs(spark, d):
    text = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return t(spark, d, "documents").select("doc_id", F.posexplode(chunking.split_paragraphs(text, 200, 50)).alias("piece", "text")).filter(tx.strip(F.col("text")) != "")


def _kind(body: str) -> str:
    """Content type of a text in SQL."""
    lines = f"list_filter(list_transform(string_split({body}, chr(10)), lambda x: trim(x, E' \\t\\r')), lambda x: x <> '')"
    tables, lists = f"len(list_filter({lines}, lambda x: contains(x, '|')))", f"len(list_filter({lines}, lambda x: regexp_matches(x, '^[-*•]\\s|^\\d+[.)]\\s')))"
    return f"CASE WHEN len({lines}) = 0 THEN 'prose' WHEN {tables} > len({lines}) * 0.4::DOUBLE THEN 'table' WHEN {lists} > len({lines}) * 0.4::DOUBLE THEN 'list' WHEN {tables} + {lists} > 0 THEN 'mixed' ELSE 'prose' END"


QUANTITY = r"""(regexp_matches({0}, '\d+[.,]\d+\s*%') OR regexp_matches({0}, '\d+\s*%') OR regexp_matches({0}, '\$[\d,]+') OR regexp_matches({0}, '\d{{1,3}}(?:,\d{{3}})+')
  OR regexp_matches({0}, '\d+\s*(?:personas|residentes|habitantes|viviendas|hogares|familias)'))"""
PAGES = r"list_transform(regexp_extract_all({0}, '<!--\s*Page\s+(\d+)\s*-->', 1), lambda p: p::INT)"


# sections of these documents are within a chunk's size, so none is cut: whole sections are chunks, small neighbours are merged
@query(f"""WITH RECURSIVE {CONV},
s AS (SELECT conv_id, main_no::INT AS pos, max(title) FILTER (level = 2) AS title,
  string_agg(CASE WHEN level = 2 THEN content ELSE '### ' || title || E'\\n\\n' || content END, E'\\n\\n' ORDER BY turn) FILTER (level = 3 OR content <> '') AS body FROM n WHERE main_no > 0 GROUP BY 1, 2),
b AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS pos, count(*) OVER (PARTITION BY conv_id) AS last, title, content AS body FROM c WHERE conv_id IN (SELECT conv_id FROM flat)),
fb AS (SELECT *, min(CASE WHEN pos < last AND {TOKENS.format('body')} >= 30 THEN pos END) OVER (PARTITION BY conv_id) AS begins FROM b),
sec AS (SELECT conv_id, pos, title, coalesce(body, '') AS body FROM s UNION ALL SELECT conv_id, pos, title, body FROM fb WHERE body <> '' AND CASE WHEN pos < last THEN coalesce(pos >= begins, false) ELSE begins IS NOT NULL OR {TOKENS.format('body')} >= 100 END),
pc AS (SELECT conv_id, title, body, 'city: c' || conv_id % 3 || E'\\n\\n## ' || title || E'\\n\\n' || body AS text, row_number() OVER (PARTITION BY conv_id ORDER BY pos)::INT AS i FROM sec WHERE lower(title) <> 'user 2' AND {TOKENS.format('body')} >= 100),
w AS (SELECT *, len({WORDS.format('text')}) AS words, {TOKENS.format('text')} AS tokens FROM pc),
r AS (
  SELECT conv_id, i, 1 AS run, tokens < 200 AS open, words AS held FROM w WHERE i = 1
  UNION ALL
  SELECT w.conv_id, w.i, CASE WHEN fits THEN run ELSE run + 1 END, w.tokens < 200, CASE WHEN fits THEN held + w.words ELSE w.words END
  FROM (SELECT r.*, n.tokens < 200 AND open AND floor(held * 1.3::DOUBLE)::INT + n.tokens <= 1500 AS fits FROM r JOIN w AS n ON n.conv_id = r.conv_id AND n.i = r.i + 1) AS r JOIN w ON w.conv_id = r.conv_id AND w.i = r.i + 1
),
m AS (SELECT conv_id, run, count(*) AS pieces, string_agg(text, E'\\n\\n' ORDER BY i) AS text, arg_min(title, i) AS title, arg_min(body, i) AS body, bool_or({QUANTITY.format('body')}) AS quantitative FROM w JOIN r USING (conv_id, i) GROUP BY 1, 2)
SELECT conv_id::VARCHAR AS source_file, 'talk' AS document_type, 'c' || conv_id % 3 AS city, text, title AS section_title, 2 AS section_level, CASE WHEN pieces > 1 THEN {_kind('text')} ELSE {_kind('body')} END AS content_type,
  quantitative AS has_quantitative_data, run - 1 AS chunk_index, coalesce(list_min({PAGES.format('text')}), -1) AS page_start, coalesce(list_max({PAGES.format('text')}), -1) AS page_end FROM m""")
def process_documents(spark, d):
    docs = conversations_md(spark, d).select("text", F.col("conv_id").cast("string").alias("source_file"), F.lit("talk").alias("document_type"), F.concat(F.lit("c"), F.col("conv_id") % 3).alias("city"))
    return chunking.process_documents(docs, ["city"], skip_exact=["user 2"])


@query(r"""
SELECT doc_id, coalesce(list_min(list_transform(regexp_extract_all(x, '<!--\s*Page\s+(\d+)\s*-->', 1), lambda p: p::INT)), -1) AS page_start,
  coalesce(list_max(list_transform(regexp_extract_all(x, '<!--\s*Page\s+(\d+)\s*-->', 1), lambda p: p::INT)), -1) AS page_end
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE '<!-- Page ' || doc_id % 17 || ' -->' || text || '<!--Page ' || doc_id % 11 || '-->' END AS x FROM documents)
""")
def page_range(spark, d):
    n = F.col("doc_id")
    x = F.when(n % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("<!-- Page "), n % 17, F.lit(" -->"), "text", F.lit("<!--Page "), n % 11, F.lit("-->")))
    return t(spark, d, "documents").select("doc_id", tx.page_range(x).alias("r")).select("doc_id", "r.*")


# ---- entities and configuration ----


@query(r"""SELECT page_id, nullif(regexp_extract(url, '://(?:www\.|blog\.|m\.)?([a-z]+)\.', 1), '') AS site, CASE WHEN regexp_matches(url, 'page=\d+') THEN regexp_extract(url, 'page=\d+', 0) END AS paging FROM pages""")
def entity_extract(spark, d):
    p = t(spark, d, "pages")
    return p.select("page_id", tx.extract(F.col("url"), r"://(?:www\.|blog\.|m\.)?([a-z]+)\.").alias("site"), tx.extract(F.col("url"), r"page=\d+").alias("paging"))


@query("""SELECT c_custkey, n_name AS nation, CASE n_name WHEN 'ALGERIA' THEN 'south' WHEN 'CANADA' THEN 'north' WHEN 'BRAZIL' THEN 'south' END AS half, r_name AS region
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def entity_mapping(spark, d):
    n = t(spark, d, "nation").join(F.broadcast(t(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    half = tx.mapped(F.col("n_name"), {"ALGERIA": "south", "CANADA": "north", "BRAZIL": "south"})
    return rows.select("c_custkey", F.col("n_name").alias("nation"), half.alias("half"), F.col("r_name").alias("region"))


@query(f"""SELECT doc_id, CASE WHEN lang = '' AND source = '' THEN '' ELSE concat_ws(', ', CASE WHEN lang <> '' THEN 'city: ' || lang END, CASE WHEN source <> '' THEN 'region: ' || source END) || E'\\n\\n' END AS context FROM documents""")
def context_line(spark, d):
    return t(spark, d, "documents").select("doc_id", tx.context_line([("city", F.col("lang")), ("region", F.col("source"))]).alias("context"))


@query(r"SELECT doc_id, md5(substr(text, 1, 500)) AS key, substr(text, 1, 200) AS prefix, regexp_replace(text, '([+\-!(){}\[\]^\"~*?:\\/])', '\\\1', 'g') AS escaped FROM documents")
def keys_and_escapes(spark, d):
    return t(spark, d, "documents").select("doc_id", tx.cache_key(F.col("text")).alias("key"), tx.prefix_key(F.col("text")).alias("prefix"), tx.escape_search(F.col("text")).alias("escaped"))



# ---- filters and listings ----


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND source = 'src3'")
def equality_filters(spark, d):
    return filters.filtered(t(spark, d, "documents"), {"lang": "en", "source": "src3", "nothing": "x", "n_chars": None}, {"lang", "source", "n_chars"}).select("doc_id", "lang", "source")


@query("""SELECT n_name AS nation, r_name AS region, list_sort(list_distinct(list(c_mktsegment))) AS document_types
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def list_entities(spark, d):
    n = t(spark, d, "nation").join(F.broadcast(t(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return catalog.list_entities(rows.select(F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.col("c_mktsegment").alias("document_type")), "nation", ["nation", "region"])


@query("SELECT o_orderstatus AS document_type, o_orderpriority AS deliverable_code, count(*) AS count FROM orders GROUP BY 1, 2")
def list_document_types(spark, d):
    o = t(spark, d, "orders")
    return catalog.list_document_types(o.select(F.col("o_orderstatus").alias("document_type"), F.col("o_orderpriority").alias("deliverable_code")))


@query("""WITH f AS (SELECT l_shipdate::DATE::VARCHAR AS section_title, l_linenumber::INT AS chunk_index, l_orderkey * 10 + l_linenumber AS seq FROM lineitem WHERE l_returnflag = 'R' ORDER BY seq LIMIT 500)
SELECT section_title, arg_min(chunk_index, seq) AS chunk_index FROM f GROUP BY 1""")
def get_sections(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_shipdate").cast("date").cast("string").alias("section_title"), F.col("l_linenumber").alias("chunk_index"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ingest_seq"))
    return catalog.get_sections(rows, "kind", "R")


@query("SELECT count(*) AS chunks, count(DISTINCT l_suppkey) AS distinct_l_suppkey, count(DISTINCT l_returnflag) AS distinct_l_returnflag FROM lineitem")
def corpus_statistics(spark, d):
    return catalog.corpus_statistics(t(spark, d, "lineitem"), ["l_suppkey", "l_returnflag"])


@query("SELECT lang, count(*) AS count FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def value_counts(spark, d):
    return catalog.value_counts(t(spark, d, "documents"), "lang")


@query("SELECT l_returnflag AS document_type, l_suppkey::VARCHAR AS source_file, count(*) AS chunk_count FROM lineitem GROUP BY 1, 2")
def chunk_counts(spark, d):
    return catalog.chunk_counts(t(spark, d, "lineitem").select(F.col("l_returnflag").alias("document_type"), F.col("l_suppkey").cast("string").alias("source_file")))


@query("""WITH s AS (SELECT role AS document_type, (conv_id % 50)::VARCHAR AS source_file, CASE WHEN turn % 3 = 0 THEN 'General' ELSE 'part ' || turn % 3 END AS section_title, (conv_id * 100 + turn)::INT AS chunk_index, text FROM conversations),
j AS (SELECT document_type, source_file, section_title, min(chunk_index) AS first_chunk, string_agg(text, E'\\n\\n' ORDER BY chunk_index) AS text FROM s GROUP BY 1, 2, 3) SELECT * FROM j WHERE length(text) > 200""")
def section_texts(spark, d):
    title = F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit("part "), F.col("turn") % 3))
    c = t(spark, d, "conversations").select(F.col("role").alias("document_type"), (F.col("conv_id") % 50).cast("string").alias("source_file"), title.alias("section_title"), (F.col("conv_id") * 100 + F.col("turn")).cast("int").alias("chunk_index"), "text")
    return catalog.section_texts(c)


@query(f"SELECT file_name, CASE WHEN len({WORDS.format('text')}) > 100 THEN array_to_string(({WORDS.format('text')})[:100], ' ') || E'\\n[... truncated]' ELSE text END AS text FROM (SELECT lpad(doc_id::VARCHAR, 9, '0') AS file_name, text FROM documents ORDER BY 1 LIMIT 5)")
def sample_files(spark, d):
    return catalog.sampled_files(t(spark, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("file_name"), "text"), 5, 100)


@query("SELECT p_brand, p_partkey, p_retailprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)::INT AS rank FROM part) WHERE rank <= 3")
def top_per_group(spark, d):
    return catalog.top_per_group(t(spark, d, "part"), "p_brand", "p_retailprice", 3, ["p_partkey"]).select("p_brand", "p_partkey", "p_retailprice", "rank")


# ---- search ----

# Query sets are every row whose id is divisible by 50.
VQ = "vq AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0)"
DOT = "list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE * q[i]::DOUBLE))"


def vectors(spark, d):
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("document_type"))


def vector_queries(spark, d):
    return t(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query(f"""WITH {VQ}, s AS (SELECT query_id, vec_id AS chunk_id, label::VARCHAR AS document_type, round({DOT}, 6) AS score FROM embeddings, vq)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s) WHERE rank <= 10""")
def vector_topk(spark, d):
    return search.vector_search(vectors(spark, d), vector_queries(spark, d), 10)


@query(f"""WITH {VQ}, s AS (SELECT query_id, vec_id AS chunk_id, label::VARCHAR AS document_type, round(2 * {DOT} - 1, 6) AS score FROM embeddings, vq WHERE label = 3)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s) WHERE rank <= 5""")
def vector_filtered(spark, d):
    return search.vector_search(filters.filtered(vectors(spark, d), {"document_type": "3"}, ["document_type"]), vector_queries(spark, d), 5, metric="l2sq")


@query(f"""WITH {VQ}, s AS (SELECT query_id, vec_id AS chunk_id, label::VARCHAR AS document_type, round({DOT}, 6) AS score FROM embeddings, vq)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s) WHERE rank <= 10""")
def vector_cells_all(spark, d):
    """The index of cells, with all cells looked into: equal to the exact search."""
    rows = vectors(spark, d)
    index = vector_operators.write_vector_index(rows, new_path(spark, "vector-index"))
    return search.vector_search(rows, vector_queries(spark, d), 10, index=index, probes=len(index.centres))


@query(f"""SELECT count(*) * 10 AS pairs, true AS reached FROM embeddings WHERE vec_id % 50 = 0""")
def vector_cells_recall(spark, d):
    """Whether the ten nearest of every query are found by the cells that the index looks into by itself, to nine tenths at least."""
    rows, asked = vectors(spark, d), vector_queries(spark, d)
    index = vector_operators.write_vector_index(rows, new_path(spark, "vector-index"))
    found = vector_operators.recall(search.vector_search(rows, asked, 10, index=index), search.vector_search(rows, asked, 10))
    return found.select("pairs", (F.col("recall") >= 0.9).alias("reached"))


def _bm25_sql(queries: str, where: str = "true") -> str:
    terms = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"""{CHUNKS}, bq AS ({queries}),
tk AS (SELECT chunk_id, {terms.format('text')} AS w FROM chunks), st AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM tk),
ps AS (SELECT term, chunk_id, dl, count(*) AS tf FROM (SELECT chunk_id, len(w) AS dl, unnest(w) AS term FROM tk) GROUP BY 1, 2, 3),
qt AS (SELECT query_id, unnest(list_distinct({terms.format('query')})) AS term FROM bq),
dfq AS (SELECT term, count(*) AS df FROM ps WHERE term IN (SELECT term FROM qt) GROUP BY 1),
sc AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_len)))), 9) AS score
  FROM ps JOIN dfq USING (term) JOIN qt USING (term), st GROUP BY 1, 2),
tr AS (SELECT * FROM (SELECT query_id, chunk_id, text, document_type, lang, score AS raw, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM sc JOIN chunks USING (chunk_id) WHERE {where})),
"""


BENCH = "SELECT item_id AS query_id, text AS query FROM benchmark WHERE item_id % 50 = 0"


def text_queries(spark, d):
    return t(spark, d, "benchmark").filter("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def indexed(spark, d):
    """The stored index of all chunks, built once for each version of the table and read from there by all queries."""
    return textindex.index_for(text_chunks(spark, d), f"{d}/documents.parquet")


def text_chunks(spark, d):
    return chunks_of(spark, d).select("chunk_id", "text", "document_type", "lang")


@query(f"WITH {_bm25_sql(BENCH)} x AS (SELECT * FROM tr WHERE rank <= 5) SELECT query_id, chunk_id, document_type, rank, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS score FROM x")
def fts_topk(spark, d):
    out = search.text_search(text_chunks(spark, d), text_queries(spark, d), 5, indexed(spark, d))
    return out.select("query_id", "chunk_id", "document_type", "rank", F.round("score", 6).alias("score"))


#: Documents after a refresh: a third came, every seventh of the others has another text, and of the rest every fifth is gone.
REFRESHED = """chunks AS (SELECT doc_id AS chunk_id, CASE WHEN doc_id % 3 <> 0 AND doc_id % 7 = 0 THEN text || ' license updated' ELSE text END AS text, source AS document_type, lang
FROM documents WHERE doc_id % 3 = 0 OR doc_id % 7 = 0 OR doc_id % 5 <> 0)"""


def before_and_after(spark, d):
    """(rows before, rows that are gone or have changed, rows that come)."""
    c = chunks_of(spark, d)
    n = F.col("chunk_id")
    changed = c.filter((n % 3 != 0) & (n % 7 == 0)).withColumn("text", F.concat("text", F.lit(" license updated")))
    return c.filter(n % 3 != 0), c.filter((n % 3 != 0) & ((n % 7 == 0) | (n % 5 == 0))), c.filter(n % 3 == 0).unionByName(changed)


@query(f"WITH {_bm25_sql(BENCH).replace(CHUNKS, REFRESHED, 1)} x AS (SELECT * FROM tr WHERE rank <= 5) SELECT query_id, chunk_id, document_type, rank, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS score FROM x")
def index_refresh(spark, d):
    """A search over an index to which a refresh has added a segment and tombstones: as if it had been built anew."""
    before, gone, fresh = before_and_after(spark, d)
    index = textindex.write_index(before, new_path(spark, "text-index"))
    index = textindex.refresh_index(index, gone, fresh)
    now = before.join(gone.select("chunk_id"), "chunk_id", "left_anti").unionByName(fresh)
    return search.text_search(now, text_queries(spark, d), 5, index).select("query_id", "chunk_id", "document_type", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {REFRESHED} SELECT chunk_id, document_type, lang, md5(text) AS digest FROM chunks")
def chunk_versions(spark, d):
    """The rows of a versioned table after a refresh: commits of rows, deletes by file that are merged when it is read."""
    before, gone, fresh = before_and_after(spark, d)
    table = ChunkTable(spark, new_path(spark, "chunk-table"))
    table.append(before)
    table.publish()
    table.delete_files(gone.select(F.concat_ws("/", "document_type", "source_file").alias("key")))
    table.append(fresh)
    table.publish()
    return ChunkTable.open(spark, table.path).rows().select("chunk_id", "document_type", "lang", F.md5("text").alias("digest"))


LANG = "lang = 'fr'"


@query(f"WITH {_bm25_sql(BENCH, LANG)} x AS (SELECT * FROM tr WHERE rank <= 5) SELECT query_id, chunk_id, lang, rank, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS score FROM x")
def fts_filtered(spark, d):
    c = text_chunks(spark, d)
    out = search.text_search(filters.filtered(c, {"lang": "fr"}, ["lang"]), text_queries(spark, d), 5, indexed(spark, d))
    return out.select("query_id", "chunk_id", "lang", "rank", F.round("score", 6).alias("score"))


SEM = f"""sr AS (SELECT * FROM (SELECT query_id, chunk_id, text, document_type, lang, row_number() OVER (PARTITION BY query_id ORDER BY round({DOT}, 6) DESC, chunk_id)::INT AS rank
  FROM embeddings JOIN chunks ON vec_id = chunk_id, vq) WHERE rank <= 15)"""


@query(f"""WITH {VQ}, {_bm25_sql(BENCH, "chunk_id IN (SELECT vec_id FROM embeddings)")} {SEM},
u AS (SELECT query_id, chunk_id, document_type, lang, substr(text, 1, 200) AS k, rank, 0 AS side, 0.6::DOUBLE / (60 + rank) AS part FROM sr
  UNION ALL SELECT query_id, chunk_id, document_type, lang, substr(text, 1, 200), rank, 1, 0.4::DOUBLE / (60 + rank) FROM tr WHERE rank <= 15),
f AS (SELECT query_id, lang, k, sum(part) AS s, coalesce(arg_max(chunk_id, rank) FILTER (side = 0), arg_min(chunk_id, rank)) AS chunk_id, min(rank) FILTER (side = 0) AS r0, min(rank) FILTER (side = 1) AS r1 FROM u GROUP BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, r0 NULLS LAST, r1 NULLS LAST)::INT AS rank FROM f),
x AS (SELECT * FROM b WHERE rank <= 5)
SELECT query_id, chunk_id, rank, round(s / max(s) OVER (PARTITION BY query_id), 6) AS score FROM x""")
def hybrid_rrf(spark, d):
    c = text_chunks(spark, d)
    both = c.join(vectors(spark, d).select("chunk_id", "vector"), "chunk_id")
    sem = search.vector_search(both, vector_queries(spark, d), 15)
    txt = search.text_search(both.drop("vector"), text_queries(spark, d), 15, indexed(spark, d))
    names = ["query_id", "chunk_id", "text", "document_type", "lang", "score", "rank"]
    out = search.fuse(sem.select(names), txt.select(names), [F.col("lang"), tx.prefix_key(F.col("text"))], 5, semantic_weight=0.6)
    return out.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH {_bm25_sql(BENCH)} x AS (SELECT * FROM tr WHERE rank <= 10), y AS (SELECT *, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS s FROM x),
z AS (SELECT query_id, chunk_id, s AS original_score, {BOOST_SQL} * CASE WHEN chunk_id % 7 = 0 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS precedence_boost, rank AS r FROM y)
SELECT query_id, chunk_id, original_score, precedence_boost, round(original_score * precedence_boost, 6) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY round(original_score * precedence_boost, 6) DESC, r)::INT AS rank FROM z""")
def precedence_boost(spark, d):
    found = search.text_search(text_chunks(spark, d), text_queries(spark, d), 10, indexed(spark, d))
    found = found.withColumn("score", F.round("score", 6)).withColumn("is_summary", F.col("chunk_id") % 7 == 0)
    return search.boosted(found, BOOSTS).select("query_id", "chunk_id", "original_score", "precedence_boost", "score", "rank")


@query(f"""WITH {_bm25_sql(BENCH)}
g AS (SELECT *, row_number() OVER (PARTITION BY query_id, lang ORDER BY raw DESC, chunk_id)::INT AS r FROM tr WHERE lang IN ('en', 'fr', 'es'))
SELECT query_id, lang, chunk_id, r AS rank, round(raw / max(raw) OVER (PARTITION BY query_id, lang), 6) AS score FROM g WHERE r <= 3""")
def search_batch(spark, d):
    c = text_chunks(spark, d)
    out = search.text_search(c.filter(F.col("lang").isin("en", "fr", "es")), text_queries(spark, d), 3, indexed(spark, d), by=("query_id", "lang"))
    return out.select("query_id", "lang", "chunk_id", "rank", F.round("score", 6).alias("score"))


KEYWORDS = "SELECT * FROM (VALUES (0, 'the of'), (1, 'ciónes'), (2, 'zzzzqq'), (3, 'license')) AS v(query_id, query)"


@query(f"""WITH {_bm25_sql(KEYWORDS)} e AS (SELECT query_id AS no, query, rank, text FROM tr JOIN bq USING (query_id) WHERE rank <= 3),
u AS (SELECT *, row_number() OVER (PARTITION BY substr(text, 1, 200) ORDER BY no, rank) AS n FROM e),
s AS (SELECT text, row_number() OVER (ORDER BY no, rank) AS n FROM u WHERE n = 1)
SELECT true AS found, (SELECT list(query ORDER BY no) FROM (SELECT DISTINCT no, query FROM e)) AS keywords_matched, (SELECT list(text ORDER BY n) FROM s WHERE n <= 3) AS evidence""")
def verify_absence(spark, d):
    words = spark.createDataFrame([(0, "the of"), (1, "ciónes"), (2, "zzzzqq"), (3, "license")], "query_id int, query string")
    found = search.text_search(text_chunks(spark, d), words, 3, indexed(spark, d)).drop("query").join(words.withColumnRenamed("query", "keyword"), "query_id")
    return search.absence(found.withColumn("keyword_no", F.col("query_id")).withColumn("query_id", F.lit(0)), 3).drop("query_id")


@query(f"""WITH {_bm25_sql(BENCH)} x AS (SELECT * FROM tr WHERE rank <= 8), s AS (SELECT query_id, chunk_id, rank, CASE WHEN (rank - 1) % 3 = 0 THEN ((rank * 5 + query_id) % 10)::DOUBLE ELSE 0 END AS rerank_score FROM x)
SELECT * FROM (SELECT query_id, chunk_id, rank, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank)::INT AS position FROM s) WHERE position <= 5""")
def rerank_apply(spark, d):
    found = search.text_search(text_chunks(spark, d), text_queries(spark, d), 8, indexed(spark, d))
    entry = lambda i: F.format_string('{"index": %d, "score": %d}', F.lit(i), ((F.lit(i + 1) * 5 + F.col("query_id")) % 10).cast("int"))
    answers = text_queries(spark, d).select("query_id", F.concat(F.lit("Scores: ["), F.concat_ws(", ", *map(entry, (0, 3, 6))), F.lit(", {")).alias("answer"))
    scores = answers.select("query_id", F.explode(search.parse_rerank_scores(F.col("answer"))).alias("index", "rerank_score"))
    return search.reranked(found, scores, 5).select("query_id", "chunk_id", "rank", "rerank_score", "position")


@query("""WITH e AS (SELECT text, doc_id, row_number() OVER (PARTITION BY substr(text, 1, 200) ORDER BY doc_id) AS n FROM documents) SELECT doc_id FROM e WHERE n = 1""")
def dedup_prefix(spark, d):
    first = Window.partitionBy(F.xxhash64(tx.prefix_key(F.col("text"))), tx.prefix_key(F.col("text"))).orderBy("doc_id")
    return t(spark, d, "documents").withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("doc_id")


@query(f"""WITH {_bm25_sql("SELECT item_id AS query_id, text AS query FROM benchmark")} x AS (SELECT query_id, rank, document_type, lang FROM tr WHERE rank <= 10),
q AS (SELECT item_id AS query_id, ['src0', 'src' || item_id % 5] AS types, CASE WHEN item_id % 2 = 0 THEN ['en', 'es'] ELSE [] END AS ents FROM benchmark),
h AS (SELECT *, (list_contains(types, document_type) AND (len(ents) = 0 OR list_contains(ents, lang)))::INT AS hit FROM x JOIN q USING (query_id)),
m AS (SELECT query_id, avg(hit) FILTER (rank <= 5) AS p_at_5, avg(hit) AS p_at_10,
  count(DISTINCT CASE WHEN hit = 1 THEN CASE WHEN len(ents) > 0 THEN lang ELSE document_type END END)::DOUBLE / max(CASE WHEN len(ents) > 0 THEN len(list_distinct(ents)) ELSE len(list_distinct(types)) END) AS recall_at_10,
  coalesce(1.0::DOUBLE / min(CASE WHEN hit = 1 THEN rank END), 0) AS mrr, coalesce(sum(hit) FILTER (rank <= 5), 0)::INT AS n5, sum(hit / log2(rank + 1)) FILTER (rank <= 5) AS dcg FROM h GROUP BY 1)
SELECT query_id, round(coalesce(p_at_5, 0), 6) AS p_at_5, round(coalesce(p_at_10, 0), 6) AS p_at_10, round(coalesce(recall_at_10, 0), 6) AS recall_at_10, round(coalesce(mrr, 0), 6) AS mrr,
  round(CASE WHEN n5 > 0 THEN dcg / list_sum(list_transform(range(1, n5 + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg_at_5 FROM q LEFT JOIN m USING (query_id)""")
def eval_metrics(spark, d):
    bench = t(spark, d, "benchmark")
    found = search.text_search(text_chunks(spark, d), bench.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), 10, indexed(spark, d))
    n = F.col("item_id")
    entities = F.when(n % 2 == 0, F.array(F.lit("en"), F.lit("es"))).otherwise(F.array().cast("array<string>"))
    expected = bench.select(n.alias("query_id"), F.array(F.lit("src0"), F.concat(F.lit("src"), n % 5)).alias("expected_document_types"), entities.alias("expected_entities"))
    out = evaluation.metrics(found, expected, ["lang"])
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in out.columns if c != "query_id"])


# ---- incremental maintenance ----

FILES = """cur AS (SELECT 'e/' || event_id AS key, value AS mtime, md5(props) AS md5 FROM events WHERE event_id % 10 <> 3),
man AS (SELECT 'e/' || event_id AS key, CASE WHEN event_id % 4 = 0 THEN value ELSE value + 1 END AS mtime, CASE WHEN event_id % 3 = 0 THEN md5(props) ELSE md5(props || 'x') END AS md5 FROM events WHERE event_id % 10 <> 5)"""


def _files(spark, d):
    e = t(spark, d, "events")
    key, n = F.concat(F.lit("e/"), "event_id").alias("key"), F.col("event_id")
    current = e.filter(n % 10 != 3).select(key, F.col("value").alias("mtime"), F.md5(F.col("props").cast("binary")).alias("md5"), F.lit("e").alias("document_type"))
    stored = e.filter(n % 10 != 5).select(
        key, F.when(n % 4 == 0, F.col("value")).otherwise(F.col("value") + 1).alias("mtime"), F.md5(F.when(n % 3 == 0, F.col("props")).otherwise(F.concat("props", F.lit("x"))).cast("binary")).alias("md5")
    )
    return current, stored


DIFF = "df AS (SELECT coalesce(c.key, m.key) AS key, CASE WHEN m.key IS NULL THEN 'new' WHEN c.key IS NULL THEN 'deleted' WHEN c.mtime <> m.mtime AND c.md5 <> m.md5 THEN 'modified' ELSE 'unmodified' END AS status FROM cur c FULL JOIN man m ON c.key = m.key)"


@query(f"WITH {FILES}, {DIFF} SELECT * FROM df")
def manifest_diff(spark, d):
    return manifest.diff_files(*_files(spark, d))


@query(f"""WITH {FILES}, {DIFF}, ch AS (SELECT 'e' AS document_type, event_id::VARCHAR AS source_file, event_type AS text FROM events WHERE event_id % 10 <> 5)
SELECT * FROM ch WHERE 'e/' || source_file IN (SELECT key FROM df WHERE status = 'unmodified')
UNION ALL SELECT 'e', event_id::VARCHAR, 'again ' || event_type FROM events WHERE 'e/' || event_id IN (SELECT key FROM df WHERE status IN ('new', 'modified'))""")
def incremental_upsert(spark, d):
    changes = manifest.diff_files(*_files(spark, d))
    e = t(spark, d, "events")
    old = e.filter("event_id % 10 <> 5").select(F.lit("e").alias("document_type"), F.col("event_id").cast("string").alias("source_file"), F.col("event_type").alias("text"))
    anew = changes.filter(F.col("status").isin("new", "modified")).select("key")
    new = e.withColumn("key", F.concat(F.lit("e/"), "event_id")).join(anew, "key", "left_semi").select(F.lit("e").alias("document_type"), F.col("event_id").cast("string").alias("source_file"), F.concat(F.lit("again "), "event_type").alias("text"))
    return manifest.refreshed(old, changes, new)


@query("""SELECT 'e/' || event_id AS key, value AS mtime, md5(props) AS md5, (CASE WHEN event_id % 2 = 0 THEN 3 ELSE 0 END)::BIGINT AS chunk_count, 'e' AS document_type FROM events WHERE event_id % 10 <> 3""")
def manifest_counts(spark, d):
    current, _ = _files(spark, d)
    c = t(spark, d, "events").filter("event_id % 2 = 0").select(F.lit("e").alias("document_type"), F.col("event_id").cast("string").alias("source_file"), F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("i"))
    return manifest.counted_manifest(current, c)


@query("""WITH c AS (SELECT md5(substr(text, 1, 500)) AS key, min(doc_id)::VARCHAR AS value FROM documents WHERE doc_id % 3 = 0 GROUP BY 1)
SELECT doc_id, md5(substr(text, 1, 500)) AS key, coalesce(value, 'miss') AS value FROM documents LEFT JOIN c ON key = md5(substr(text, 1, 500))""")
def cache_lookup(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "text")
    cache = docs.filter("doc_id % 3 = 0").groupBy(tx.cache_key(F.col("text")).alias("key")).agg(F.min("doc_id").cast("string").alias("value"))
    hits, misses = manifest.cached(docs, cache)
    return hits.select("doc_id", "key", "value").unionByName(misses.select("doc_id", "key", F.lit("miss").alias("value")))


# ---- page layout ----


def spans(spark, d):
    """lineitem as text spans: the supplier is the document, the line number the page. Rows move once, to their document."""
    size = 8 + F.round(F.col("l_discount") * 100) / 2
    keys = ["l_suppkey", "l_orderkey", "l_linenumber"]
    rows = t(spark, d, "lineitem").repartition("l_suppkey").groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax")])
    return rows.select(
        F.col("l_suppkey").alias("doc"), F.col("l_linenumber").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.concat("l_returnflag", "l_linestatus", F.col("l_quantity").cast("int") % 5).alias("text"),
        size.alias("font_size"), (F.col("l_quantity") > 25).alias("is_bold"), (F.col("l_tax") > 0.04).alias("is_italic"), (F.col("l_tax") * 1000).alias("x0"), (F.col("l_quantity") * 15).alias("y0"),
        (F.col("l_tax") * 1000 + 50).alias("x1"), (F.col("l_quantity") * 15 + 10).alias("y1"), F.lit(792.0).alias("page_height"),
    )


SPANS = """li AS (SELECT l_suppkey, l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus, max(l_quantity) AS l_quantity, max(l_discount) AS l_discount, max(l_tax) AS l_tax
  FROM lineitem GROUP BY 1, 2, 3), s AS (SELECT l_suppkey AS doc, l_linenumber AS page, l_orderkey * 10 + l_linenumber AS seq, l_returnflag || l_linestatus || (l_quantity::INT % 5) AS text, 8 + round(l_discount * 100) / 2 AS font_size,
  l_quantity > 25 AS is_bold, l_tax > 0.04::DOUBLE AS is_italic, l_tax * 1000 AS x0, l_quantity * 15 AS y0, l_tax * 1000 + 50 AS x1, l_quantity * 15 + 10 AS y1 FROM li)"""
LEVELS = """c AS (SELECT doc, font_size, sum(length(trim(text)))::BIGINT AS chars FROM s GROUP BY 1, 2),
b AS (SELECT *, first_value(font_size) OVER (PARTITION BY doc ORDER BY chars DESC, font_size) AS body FROM c),
lv AS (SELECT doc, font_size, chars, CASE WHEN font_size > body THEN least(dense_rank() OVER (PARTITION BY doc ORDER BY font_size DESC), 6) ELSE 0 END::INT AS level FROM b)"""


@query(f"WITH {SPANS}, {LEVELS} SELECT * FROM lv")
def heading_levels(spark, d):
    return layout.heading_levels(spans(spark, d))


@query(f"WITH {SPANS}, {LEVELS} SELECT doc, page, seq, level AS heading_level FROM s JOIN lv USING (doc, font_size)")
def heading_lookup(spark, d):
    return layout.with_levels(spans(spark, d)).select("doc", "page", "seq", "heading_level")


ZONES = "z AS (SELECT doc, CASE WHEN y0 < 72 THEN 'header' WHEN y1 > 720 THEN 'footer' END AS zone, text AS norm, count(*) AS n FROM s GROUP BY 1, 2, 3 HAVING zone IS NOT NULL AND count(*) >= 3)"


@query(f"WITH {SPANS}, {ZONES} SELECT * FROM z")
def repeated_lines(spark, d):
    return layout.repeated_texts(spans(spark, d))


@query(f"""WITH {SPANS}, {ZONES} SELECT doc, page, seq FROM s WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.doc = s.doc AND z.norm = s.text AND ((zone = 'header' AND y0 < 72) OR (zone = 'footer' AND y1 > 720)))""")
def running_text_removed(spark, d):
    return layout.without_running_text(spans(spark, d)).select("doc", "page", "seq")


def boxes(spark, d):
    s = t(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("doc"), F.lit(1).alias("page"), F.lit(0.0).alias("x0"), (F.col("s_suppkey") % 20 * 20.0).alias("y0"), F.lit(60.0).alias("x1"), (F.col("s_suppkey") % 20 * 20.0 + 150).alias("y1"))


@query(f"""WITH {SPANS}, x AS (SELECT s_suppkey AS doc, s_suppkey % 20 * 20.0::DOUBLE AS b0 FROM supplier) SELECT doc, page, seq FROM s WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.doc = s.doc AND s.page = 1
  AND (x0 + x1) / 2 BETWEEN -5 AND 65 AND (y0 + y1) / 2 BETWEEN b0 - 5 AND b0 + 155)""")
def bbox_anti(spark, d):
    return layout.outside_tables(spans(spark, d), boxes(spark, d)).select("doc", "page", "seq")


@query(f"""WITH RECURSIVE {SPANS}, o AS (SELECT doc, page, seq, y0, row_number() OVER (PARTITION BY doc, page ORDER BY seq) AS i FROM s),
r AS (SELECT doc, page, seq, i, y0 AS anchor, 0 AS line FROM o WHERE i = 1 UNION ALL
  SELECT o.doc, o.page, o.seq, o.i, CASE WHEN abs(o.y0 - r.anchor) <= 5 THEN r.anchor ELSE o.y0 END, CASE WHEN abs(o.y0 - r.anchor) <= 5 THEN r.line ELSE r.line + 1 END FROM r JOIN o ON o.doc = r.doc AND o.page = r.page AND o.i = r.i + 1)
SELECT doc, page, seq, line FROM r""")
def line_groups(spark, d):
    return layout.line_groups(spans(spark, d)).select("doc", "page", "seq", "line")


@query(f"""WITH RECURSIVE {SPANS}, {LEVELS}, {ZONES},
f AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.doc = s.doc AND z.norm = s.text AND ((zone = 'header' AND y0 < 72) OR (zone = 'footer' AND y1 > 720)))),
cf AS (SELECT doc, font_size, sum(length(trim(text)))::BIGINT AS chars FROM f GROUP BY 1, 2),
bf AS (SELECT *, first_value(font_size) OVER (PARTITION BY doc ORDER BY chars DESC, font_size) AS body FROM cf),
lf AS (SELECT doc, font_size, CASE WHEN font_size > body THEN least(dense_rank() OVER (PARTITION BY doc ORDER BY font_size DESC), 6) ELSE 0 END::INT AS level FROM bf),
o AS (SELECT f.*, lf.level, row_number() OVER (PARTITION BY doc, page ORDER BY seq) AS i FROM f JOIN lf USING (doc, font_size)),
r AS (SELECT doc, page, seq, i, y0 AS anchor, 0 AS line FROM o WHERE i = 1 UNION ALL
  SELECT o.doc, o.page, o.seq, o.i, CASE WHEN abs(o.y0 - r.anchor) <= 5 THEN r.anchor ELSE o.y0 END, CASE WHEN abs(o.y0 - r.anchor) <= 5 THEN r.line ELSE r.line + 1 END FROM r JOIN o ON o.doc = r.doc AND o.page = r.page AND o.i = r.i + 1),
k AS (SELECT *, CASE WHEN is_bold AND is_italic THEN '***' WHEN is_bold THEN '**' WHEN is_italic THEN '*' ELSE '' END AS mark FROM r JOIN o USING (doc, page, seq)),
g AS (SELECT doc, page, line, arg_min(level, seq) AS level, min(y0) AS y0, string_agg(trim(text), ' ' ORDER BY seq) AS heading, string_agg(mark || regexp_replace(text, '([*_])', '\\\\\\1', 'g') || mark, '' ORDER BY seq) AS body FROM k GROUP BY 1, 2, 3),
m AS (SELECT doc, page, y0, line, CASE WHEN level > 0 THEN repeat('#', level) || ' ' || heading ELSE body END AS md FROM g),
p AS (SELECT doc, page, string_agg(md, E'\\n\\n' ORDER BY y0, line, md) AS md FROM m WHERE trim(md) <> '' GROUP BY 1, 2),
h AS (SELECT doc, coalesce(trim(arg_min(text, page * 1000000000000 + seq) FILTER (level = 1)), doc::VARCHAR) AS title FROM s JOIN lv USING (doc, font_size) GROUP BY doc)
SELECT doc, '# ' || any_value(title) || E'\\n\\n' || string_agg('<!-- Page ' || page || ' -->' || E'\\n\\n' || md, E'\\n\\n' ORDER BY page) AS md FROM p JOIN h USING (doc) GROUP BY doc""")
def page_markdown(spark, d):
    s = layout.with_levels(layout.without_running_text(spans(spark, d)))
    parts = layout.lines_to_markdown(s).select("doc", "page", "y0", F.lit(0).alias("kind_no"), F.col("line").cast("long").alias("seq"), "md")
    return layout.documents_markdown(layout.interleaved(parts), layout.titles(layout.with_levels(spans(spark, d))))


@query(f"""WITH {SPANS}, u AS (SELECT doc, page, y0, 0 AS kind_no, seq, text AS md FROM s UNION ALL SELECT s_suppkey, 1, s_suppkey % 20 * 20.0::DOUBLE, 1, s_suppkey, 'table ' || s_suppkey FROM supplier)
SELECT doc, page, string_agg(md, E'\\n\\n' ORDER BY y0, kind_no, seq) AS md FROM u GROUP BY 1, 2""")
def interleave(spark, d):
    text = spans(spark, d).select("doc", "page", "y0", F.lit(0).alias("kind_no"), "seq", F.col("text").alias("md"))
    tables = boxes(spark, d).select("doc", "page", "y0", F.lit(1).alias("kind_no"), F.col("doc").alias("seq"), F.concat(F.lit("table "), "doc").alias("md"))
    return layout.interleaved(text, tables)



@query("""WITH c AS (SELECT l_suppkey AS "table", l_orderkey AS row, l_linenumber AS col, max(CASE WHEN l_quantity > 30 THEN l_returnflag END) AS value FROM lineitem GROUP BY 1, 2, 3),
h AS (SELECT "table", row, col, last_value(value IGNORE NULLS) OVER (PARTITION BY "table", row ORDER BY col ROWS UNBOUNDED PRECEDING) AS value FROM c)
SELECT "table", row, col, last_value(value IGNORE NULLS) OVER (PARTITION BY "table", col ORDER BY row ROWS UNBOUNDED PRECEDING) AS value FROM h""")
def forward_fill(spark, d):
    cells = t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("table"), F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"))
    return layout.forward_filled(cells.agg(F.max(F.when(F.col("l_quantity") > 30, F.col("l_returnflag"))).alias("value")))



@query("""SELECT p_partkey, CASE WHEN p_size % 20 > 10 AND cov < 0.5 THEN 'native_text' WHEN p_size % 20 > 10 THEN 'mixed' WHEN cov > 0.95 OR p_size % 3 > 0 THEN 'scanned' ELSE 'empty' END AS page_type
FROM (SELECT p_partkey, p_size, least(p_size * 30.0::DOUBLE / 1000, 1.0) AS cov FROM part)""")
def page_types(spark, d):
    box = F.array(F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("p_size").cast("double").alias("x1"), F.lit(30.0).alias("y1")))
    return t(spark, d, "part").select("p_partkey", layout.page_type(F.col("p_size") % 20, layout.image_coverage(box, F.lit(100.0), F.lit(10.0)), F.col("p_size") % 3).alias("page_type"))


# ---- pages of files ----

HEADS = "hd AS (SELECT p_size AS doc, 1 AS page, p_partkey AS seq, CASE WHEN p_partkey % 5 = 0 THEN ' Anexo ' || p_partkey ELSE p_name END AS text, p_partkey % 4 AS heading_level FROM part)"


def headings(spark, d):
    text = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit(" Anexo "), "p_partkey")).otherwise(F.col("p_name"))
    zero = [F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1")]
    return t(spark, d, "part").select(F.col("p_size").alias("doc"), F.lit(1).alias("page"), F.col("p_partkey").alias("seq"), text.alias("text"), (F.col("p_partkey") % 4).cast("int").alias("heading_level"), *zero)


@query(f"WITH {HEADS} SELECT doc, seq, CASE WHEN text LIKE ' Anexo%' THEN 'anexo' ELSE 'main' END AS section_type, trim(text) AS title, heading_level FROM hd WHERE heading_level > 0")
def section_markers(spark, d):
    return pages.section_markers(headings(spark, d)).select("doc", "seq", "section_type", "title", "heading_level")


@query(f"WITH {HEADS} SELECT doc, seq, text LIKE ' Anexo%' OR EXISTS (SELECT 1 FROM hd AS m WHERE m.doc = hd.doc AND m.heading_level = 3 AND trim(m.text) = trim(hd.text)) AS is_appendix FROM hd")
def marked_headings(spark, d):
    h = headings(spark, d)
    return pages.marked_headings(h, pages.section_markers(h.filter("heading_level = 3"))).select("doc", "seq", "is_appendix")


BATCH = "fl AS (SELECT DISTINCT 'f/' || event_id AS path FROM events), st AS (SELECT 'f/' || event_id AS path, CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'completed' END AS status FROM events WHERE event_id % 3 > 0)"


def _batch(spark, d):
    e = t(spark, d, "events").select(F.concat(F.lit("f/"), "event_id").alias("path"), "event_id")
    failed = F.col("event_id") % 5 == 0
    state = e.filter("event_id % 3 > 0").select("path", F.when(failed, "failed").otherwise("completed").alias("status"), F.when(failed, "broken").alias("error"), F.lit(1).cast("long").alias("pages"))
    return e.select("path").distinct(), state


@query(f"WITH {BATCH} SELECT path FROM fl WHERE path NOT IN (SELECT path FROM st)")
def batch_pending(spark, d):
    return sources_pages.pending(*_batch(spark, d))


@query(f"WITH {BATCH} SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status IS NULL) AS pending FROM fl LEFT JOIN st USING (path)")
def batch_numbers(spark, d):
    return sources_pages.batch_numbers(*_batch(spark, d)).drop("failures")


def order_pages(spark, d):
    """orders as pages: of each customer's documents, with text, images and tables made of order and line facts."""
    o, n = t(spark, d, "orders"), F.col("o_orderkey")
    box = lambda x: F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), x.cast("double").alias("x1"), F.lit(10.0).alias("y1"))
    image = lambda w: F.struct(F.lit(1).alias("xref"), w.cast("int").alias("width"), F.lit(120).alias("height"), F.lit("png").alias("format"), F.lit(None).cast("binary").alias("data"), (n % 2 == 0).alias("is_chart"))
    row = lambda *cells: F.array(*[c.cast("string") for c in cells])
    table = lambda rows: F.struct(box(F.lit(5)).alias("bbox"), F.lit(None).cast("array<string>").alias("header"), rows.alias("rows"))
    wide = table(F.array(row(n, F.lit(None)), row(F.col("o_custkey"), F.col("o_orderstatus"))))
    small = table(F.array(row(n)))
    spans_ = F.array(F.struct(F.lit("near").alias("text"), F.lit(0.0).alias("x0"), F.lit(20.0).alias("y0"), F.lit(5.0).alias("x1"), F.lit(30.0).alias("y1")))
    return o.select(
        F.col("o_custkey").alias("doc"), n.alias("page"), F.lit(100.0).alias("width"), F.lit(100.0).alias("height"), F.when(n % 3 > 0, F.concat(F.lit("order number "), n)).otherwise("").alias("text"),
        spans_.alias("spans"), F.when(n % 4 == 0, F.array(wide)).otherwise(F.array().cast(f"array<{sources_pages.TABLE}>")).alias("bordered"), F.array(wide, small).alias("borderless"),
        F.when(n % 5 < 3, F.array(image(n % 7 * 40), image(F.lit(200)))).otherwise(F.array().cast(f"array<{sources_pages.IMAGE}>")).alias("images"), F.array(box(n % 11 * 100)).alias("image_boxes"),
    )


COVER = "least(o_orderkey % 11 * 1000.0::DOUBLE / 10000, 1.0)"
KIND = f"CASE WHEN o_orderkey % 3 > 0 AND {COVER} < 0.5 THEN 'native_text' WHEN o_orderkey % 3 > 0 THEN 'mixed' WHEN {COVER} > 0.95 OR o_orderkey % 5 < 3 THEN 'scanned' ELSE 'empty' END"


@query(f"SELECT o_custkey AS doc, count(*) AS total, count(*) FILTER ({KIND} = 'scanned') AS scanned, count(*) FILTER ({KIND} IN ('native_text', 'mixed')) AS native FROM orders GROUP BY 1")
def document_totals(spark, d):
    p = pages.analysed(order_pages(spark, d))
    return p.groupBy("doc").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("page_type") == "scanned").alias("scanned"), F.count_if(F.col("page_type").isin("native_text", "mixed")).alias("native"))


@query(f"SELECT o_custkey AS doc, o_orderkey AS page FROM orders WHERE {KIND} = 'scanned'")
def pages_of_type(spark, d):
    return pages.pages_of_type(pages.analysed(order_pages(spark, d)), "scanned")


@query(f"""SELECT o_custkey AS doc, o_orderkey AS page, {KIND} AS page_type, CASE {KIND} WHEN 'empty' THEN '' WHEN 'scanned' THEN 'word ' || o_orderkey ELSE CASE WHEN o_orderkey % 3 > 0 THEN 'order number ' || o_orderkey ELSE '' END END AS text,
  {KIND} = 'scanned' AS ocr_applied, CASE WHEN {KIND} = 'scanned' THEN 0.5::DOUBLE END AS confidence FROM orders""")
def processed_pages(spark, d):
    p = pages.analysed(order_pages(spark, d))
    word = lambda x, c: F.struct(x.cast("string").alias("text"), F.lit(c).alias("confidence"))
    words = p.filter("page_type = 'scanned'").select("doc", "page", F.array(word(F.lit("word"), 50.0), word(F.col("page"), -1.0)).alias("words"))
    return pages.processed(p, words)


@query("""SELECT o_custkey AS doc, o_orderkey AS page, 0 AS table_index, o_orderkey % 4 > 0 AS is_borderless, [o_orderkey::VARCHAR, ''] AS header_names, 2 AS row_count, 2 AS col_count, false AS needs_review FROM orders""")
def page_tables(spark, d):
    return pages.tables(order_pages(spark, d)).drop("bbox", "rows")


@query("""SELECT o_custkey AS doc, o_orderkey AS page, i AS image_index, CASE WHEN i = 0 THEN o_orderkey % 7 * 40 ELSE 200 END::INT AS width, o_orderkey % 2 = 0 AS is_chart,
  CASE WHEN i = 0 THEN (o_orderkey % 11 * 100)::DOUBLE ELSE 0 END AS x1, CASE WHEN i = 0 THEN 'near' ELSE '' END AS nearby_text
FROM orders, range(2) r(i) WHERE o_orderkey % 5 < 3 AND (i = 1 OR o_orderkey % 7 * 40 >= 100)""")
def page_images(spark, d):
    return pages.images(order_pages(spark, d)).select("doc", "page", F.col("image_index").cast("long").alias("image_index"), "width", "is_chart", F.col("bbox.x1").alias("x1"), "nearby_text")


@query("""WITH i AS (SELECT o_custkey AS doc, count(*) AS images, count(*) FILTER (o_orderkey % 2 = 0) AS charts FROM orders, range(2) r(i) WHERE o_orderkey % 5 < 3 AND (i = 1 OR o_orderkey % 7 * 40 >= 100) GROUP BY 1),
t AS (SELECT o_custkey AS doc, count(*) AS tables FROM orders GROUP BY 1) SELECT doc, tables, coalesce(images, 0) AS images, coalesce(charts, 0) AS charts FROM t LEFT JOIN i USING (doc)""")
def content_counts(spark, d):
    p = order_pages(spark, d)
    return pages.counts(pages.tables(p), pages.images(p))


# ---- what scorers and callers are shown ----


@query("""SELECT doc_id, '[' || (doc_id % 7) || '] lang: ' || coalesce(lang, 'N/A') || ' | region: N/A | Tipo: ' || coalesce(source, 'N/A') || ' | Sección: part ' || doc_id % 3 || E'\\n' || substr(text, 1, 500) AS block FROM documents""")
def rerank_block(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "lang", F.col("source").alias("document_type"), F.concat(F.lit("part "), F.col("doc_id") % 3).alias("section_title"), "text", (F.col("doc_id") % 7 + 1).alias("rank"))
    return rows.select("doc_id", search.rerank_block(rows, ["lang", "region"]).alias("block"))


@query("""SELECT doc_id AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN '[RESUMEN IA] ' ELSE '' END || text AS text, coalesce(nullif(source, 'src1'), 'unknown') AS document_type, '' AS city, -1 AS page_start, doc_id % 3 = 0 AS is_summary, 1.0::DOUBLE / (1 + doc_id) AS score, doc_id + 1 AS rank FROM documents""")
def result_rows(spark, d):
    summary = F.col("doc_id") % 3 == 0
    rows = t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.nullif("source", F.lit("src1")).alias("document_type"), summary.alias("is_summary"), (1 / (1 + F.col("doc_id"))).alias("score"), (F.col("doc_id") + 1).alias("rank"))
    return search.shaped(rows, ["text", "document_type", "city", "page_start", "is_summary"], {"city": "", **RESULT_DEFAULTS})


@query(f"""SELECT count(*) AS queries, {', '.join(f'round(avg({m}), 6) AS {m}' for m in ('p_at_5', 'p_at_10', 'recall_at_10', 'mrr', 'ndcg_at_5'))} FROM ({ORACLES["eval_metrics"]})""")
def eval_report(spark, d):
    out = evaluation.averages(eval_metrics(spark, d))
    return out.select("queries", *[F.round(c, 6).alias(c) for c in out.columns if c != "queries"])


# ---- models and streams ----


@query()
def embed_stub(spark, d):
    return enrich.embedded(t(spark, d, "documents").select("doc_id", "text")).select("doc_id", "vector")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark, d):
    from ..streaming.ingest import windowed_counts

    return windowed_counts(t(spark, d, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT l_orderkey AS doc, l_orderkey % 2 = 1 AS is_borderless, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag) - 1)::INT AS row,
  'line ' || l_linenumber || '|' || l_quantity::INT || '|' || l_returnflag AS cells
FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey) > 1 OR l_orderkey % 2 = 0""")
def found_tables(spark, d):
    """Tables of drawn pages: each order's lines as words at their places, ruled on even orders and with gaps alone on odd ones, under a title."""
    word = lambda text, x, y: F.struct(text.alias("text"), F.lit(float(x)).alias("x0"), y.alias("y0"), (F.lit(float(x)) + 5.0 * F.length(text)).alias("x1"), (y + 10.0).alias("y1"))
    text = lambda r: (F.lit("line"), r["l_linenumber"].cast("string"), r["l_quantity"].cast("int").cast("string"), r["l_returnflag"])
    line = lambda r, n: F.array(*(word(w, x, 100.0 + 20.0 * n) for w, x in zip(text(r), (50, 72, 150, 250))))
    orders = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag"))).alias("lines"))
    words = orders.select("l_orderkey", F.flatten(F.transform("lines", line)).alias("spans"), F.size("lines").alias("rows"))
    title = F.array(word(F.lit("Order"), 50, F.lit(40.0)), word(F.col("l_orderkey").cast("string"), 77, F.lit(40.0)))
    box = lambda x0, y0, x1, y1: F.struct(*(v.cast("double").alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1))))
    low = 95 + 20 * F.col("rows")
    across = F.transform(F.sequence(F.lit(0), F.col("rows")), lambda k: box(F.lit(45), 95 + 20 * k, F.lit(345), 95 + 20 * k))
    down = F.array(*(box(F.lit(x), F.lit(95), F.lit(x), low) for x in (45, 145, 245, 345)))
    drawn = words.select(F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), F.concat(title, "spans").alias("spans"), F.when(F.col("l_orderkey") % 2 == 0, F.concat(across, down)).alias("rules"))
    found = pages.tables(tablefinding.find_tables(drawn, keep=("doc", "page")))
    return found.select("doc", "is_borderless", F.posexplode("rows").alias("row", "cells")).withColumn("cells", F.array_join("cells", "|"))


@query("""WITH o AS (SELECT DISTINCT 'user/' || user_id AS key, date_trunc('millisecond', ts) AS seen_at, md5(event_type) AS md5 FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL),
e AS (SELECT *, lag(seen_at) OVER w AS s, lag(md5) OVER w AS m, lead(seen_at) OVER w AS x FROM o WINDOW w AS (PARTITION BY key ORDER BY seen_at, md5)),
u AS (SELECT max(seen_at) - INTERVAL 1 HOUR AS until FROM o)
SELECT key, CASE WHEN s IS NULL OR seen_at > s + INTERVAL 36 HOUR THEN 'new' ELSE 'modified' END AS status, md5, epoch_ms(seen_at) AS at_ms FROM e WHERE s IS NULL OR seen_at > s + INTERVAL 36 HOUR OR md5 <> m
UNION ALL SELECT key, 'deleted', md5, epoch_ms(seen_at + INTERVAL 36 HOUR) FROM e, u WHERE x > seen_at + INTERVAL 36 HOUR OR (x IS NULL AND seen_at + INTERVAL 36 HOUR <= until)""")
def stream_changes(spark, d):
    """Users as files that events report: a stateful stream of what became new, changed or was not seen for 36 hours, run to its end."""
    events = t(spark, d, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/event[s].parquet")  # a pattern, as streams take folders and patterns only
    seen = stream.select(F.concat(F.lit("user/"), F.col("user_id")).alias("key"), F.col("ts").alias("seen_at"), F.md5(F.col("event_type").cast("binary")).alias("md5"))
    place = new_path(spark, "changes")
    changes_stream.file_changes(seen, timedelta(hours=36), "1 hour").writeStream.option("checkpointLocation", f"{place}/check").trigger(availableNow=True).format("parquet").start(f"{place}/rows").awaitTermination()
    return spark.read.parquet(f"{place}/rows").select("key", "status", "md5", F.unix_millis("at").alias("at_ms"))


@query("""WITH k AS (SELECT source AS document_type, lang AS entity, n_chars % 3 AS content_type FROM documents)
SELECT document_type, entity, content_type, (grouping(document_type) * 4 + grouping(entity) * 2 + grouping(content_type))::INT AS level, count(*) AS count FROM k GROUP BY CUBE (document_type, entity, content_type)""")
def type_cube(spark, d):
    c = t(spark, d, "documents").select(F.col("source").alias("document_type"), F.col("lang").alias("entity"), (F.col("n_chars") % 3).alias("content_type"))
    return catalog.cube_counts(c, ("document_type", "entity", "content_type"))


@query("""SELECT 'l_orderkey' AS "column", count(*) AS rows, true AS close FROM lineitem UNION ALL SELECT 'l_partkey', count(*), true FROM lineitem UNION ALL SELECT 'l_suppkey', count(*), true FROM lineitem""")
def merged_distinct(spark, d):
    """Distinct values by sketches that are kept for each flag and merged, held against exact counts: within five standard errors."""
    rows = t(spark, d, "lineitem")
    names = ["l_orderkey", "l_partkey", "l_suppkey"]
    kept = catalog.distinct_sketches(rows, names, by=("l_returnflag",))
    exact = rows.agg(*[F.count_distinct(c).alias(c) for c in names]).select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("exact")) for c in names])).alias("e")).select("e.*")
    found = catalog.merged_sketches(kept).join(exact, "column")
    return found.select("column", "rows", (F.abs(F.col("distinct") - F.col("exact")) <= 5 * 1.04 / 64 * F.col("exact")).alias("close"))


# a third of the documents as paragraphs of one section, a third as one paragraph, a third as paragraphs of a subsection: sections longer than a chunk are split, what is still too long is cut
@query(f"""WITH RECURSIVE p0 AS (SELECT doc_id, list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, E' \\t\\r')), lambda x: x <> ''), lambda x: 'x ' || x) AS p FROM documents),
z AS (SELECT doc_id, q AS p, array_to_string(q, E'\\n\\n') AS body, list_transform(q, lambda x: {TOKENS.format('x')}) AS k FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN [array_to_string(p, ' ')] ELSE p END AS q FROM p0 WHERE len(p) > 0)),
f AS (SELECT *, {TOKENS.format('body')} AS own, {TOKENS.format("(CASE WHEN doc_id % 3 = 2 THEN E'### One\\n\\n' ELSE '' END || body)")} AS whole FROM z),
r AS (
  SELECT doc_id, 0 AS n, 1 AS s, 1 AS j, k, NULL::INT AS e, NULL::INT AS b FROM f WHERE own > 1500
  UNION ALL
  SELECT doc_id, CASE WHEN fit THEN n ELSE n + 1 END, CASE WHEN fit THEN s ELSE again END, j + fit::INT, k, CASE WHEN NOT fit THEN j - 1 END, CASE WHEN NOT fit THEN s END
  FROM (SELECT *, (j = s OR forced OR coalesce(list_sum(k[s:j]), 0) <= 1500) AS fit FROM (
    SELECT *, b IS NOT NULL AS forced, coalesce(list_min(list_filter(range(s, j + 1), lambda q: coalesce(list_sum(k[q:j - 1]), 0) <= 125)), j)::INT AS again FROM r)) WHERE j <= len(k)
),
runs AS (SELECT doc_id, n, array_to_string(p[b:e], E'\\n\\n') AS part FROM (SELECT doc_id, n, b, e FROM r WHERE b IS NOT NULL UNION ALL SELECT doc_id, max(n) + 1, arg_max(s, j), arg_max(j, j) - 1 FROM r GROUP BY doc_id) JOIN z USING (doc_id)),
pieces AS (
  SELECT doc_id, 0 AS n, E'## Long\\n\\n' || CASE WHEN doc_id % 3 = 2 THEN E'### One\\n\\n' ELSE '' END || body AS text, 'Long' AS section_title, 2 AS section_level FROM f WHERE whole BETWEEN 100 AND 1500
  UNION ALL SELECT doc_id, 0, E'## Long\\n### One\\n\\n' || body, 'Long > One', 3 FROM f WHERE doc_id % 3 = 2 AND whole > 1500 AND own <= 1500
  UNION ALL SELECT doc_id, n, CASE WHEN doc_id % 3 = 2 THEN E'## Long\\n### One\\n\\n' ELSE E'## Long\\n\\n' END || part, CASE WHEN doc_id % 3 = 2 THEN 'Long > One' ELSE 'Long' END, CASE WHEN doc_id % 3 = 2 THEN 3 ELSE 2 END FROM runs
)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1)::INT AS chunk_index, section_title, section_level::INT AS section_level,
  CASE WHEN len({WORDS.format('text')}) > 1384 THEN array_to_string(({WORDS.format('text')})[:1384], ' ') ELSE text END AS text FROM pieces""")
def long_sections(spark, d):
    lines = F.transform(tx.paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n"))), lambda x: F.concat(F.lit("x "), x))
    n = F.col("doc_id") % 3
    body = F.array_join(lines, "\n\n")
    text = F.when(n == 1, F.concat(F.lit("## Long\n\n"), F.array_join(lines, " ")))
    text = text.when(n == 2, F.concat(F.lit("## Long\n\n### One\n\n"), body)).otherwise(F.concat(F.lit("## Long\n\n"), body))
    docs = t(spark, d, "documents").select("doc_id", text.alias("text"))
    return chunking.process_documents(docs, keep=("doc_id",)).select("doc_id", "chunk_index", "section_title", "section_level", "text")


@query(f"""SELECT * FROM ({ORACLES["token_estimate"]}) JOIN ({ORACLES["content_type"]}) USING (doc_id) JOIN ({ORACLES["quantitative_flag"]}) USING (doc_id) JOIN ({ORACLES["truncate_text"]}) USING (doc_id)""")
def sql_functions(spark, d):
    """Text functions called from SQL."""
    sqlfunctions.register(spark)
    return spark.sql("SELECT doc_id, token_count(text) AS tokens, content_kind(text) AS content_type, quantitative(text) AS quantitative, cut_text(text) AS text FROM {docs}", docs=t(spark, d, "documents"))


@query(ORACLES["process_documents"])
def chunk_document(spark, d):
    """Chunks by the table function, called laterally from SQL."""
    sqlfunctions.register(spark, skip_exact=["user 2"])
    return spark.sql(
        """SELECT CAST(d.conv_id AS STRING) AS source_file, 'talk' AS document_type, concat('c', d.conv_id % 3) AS city, c.*
        FROM {docs} d, LATERAL chunk_document(d.text, concat('city: c', d.conv_id % 3)) c""",
        docs=conversations_md(spark, d),
    )


@query(ORACLES["sections_hierarchical"])
def sql_sections(spark, d):
    """Sections as an array from SQL, numbered by position."""
    sqlfunctions.register(spark)
    return spark.sql(
        """SELECT conv_id, CAST(i + 1 AS INT) AS main_no, s.title, s.content, CAST(size(s.subsections) AS BIGINT) AS subsections, array_join(transform(s.subsections, x -> x.title), '|') AS sub_titles
        FROM (SELECT conv_id, sections_of(text) AS sections FROM {docs} WHERE text RLIKE '(?md)^## ') LATERAL VIEW posexplode(sections) AS i, s""",
        docs=conversations_md(spark, d),
    )


@query(r"""WITH l AS (SELECT l_orderkey AS doc, l_linenumber, l_partkey, CASE WHEN l_quantity <= 30 THEN l_returnflag || '|' || l_linestatus END AS flags FROM lineitem)
SELECT doc, '| line | part\|item | flags |' || E'\n| --- | --- | --- |\n' || string_agg('| ' || l_linenumber || ' | part ' || l_partkey || ' | ' || coalesce(replace(flags, '|', '\|'), '') || ' |', E'\n' ORDER BY l_linenumber, l_partkey, flags NULLS FIRST) AS md
FROM l GROUP BY doc""")
def table_markdown(spark, d):
    """Orders as tables of pages, rendered in Markdown; in every other one the names of columns are the first row."""
    rows = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.struct("l_linenumber", "l_partkey", F.when(F.col("l_quantity") <= 30, F.concat("l_returnflag", F.lit("|"), "l_linestatus")).alias("flags")).alias("x"))
    lines = F.transform(F.array_sort(F.collect_list("x")), lambda x: F.array(x["l_linenumber"].cast("string"), F.concat(F.lit("part\n "), x["l_partkey"]), x["flags"]))
    names = F.array(F.lit("line"), F.lit("part|item"), F.lit("flags"))
    first = F.col("doc") % 2 == 0
    orders = rows.groupBy("doc").agg(lines.alias("lines")).select("doc", F.struct(
        F.expr("named_struct('x0', 0D, 'y0', 0D, 'x1', 0D, 'y1', 0D)").alias("bbox"), F.when(~first, names).alias("header"), F.when(first, F.concat(F.array(names), "lines")).otherwise(F.col("lines")).alias("rows"),
    ).alias("found"))
    drawn = orders.select("doc", F.lit(1).alias("page"), F.array("found").alias("bordered"), F.array().cast(orders.select(F.array("found")).schema[0].dataType).alias("borderless"))
    return pages.tables(drawn, try_borderless=False).select("doc", pages.table_markdown().alias("md"))
