"""Exact vector search, BM25 full-text search and their fusion.

Queries are a small table (query_id, ...): one query or thousands run in one job. All of them end in the best rows per query by a window
with a rank limit, which Spark applies before the shuffle, so only a few rows per query and task are exchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.workspace import new_path
from .textindex import TextIndex, best_blocks, open_index, plan, write_index

from .vectors import top_k, vector_search

__all__ = ["TextIndex", "open_index", "top_k", "vector_search", "write_index"]
RRF_K = 60
SUMMARY_BOOST = 0.70
SUMMARY_MARK = "[RESUMEN IA] "


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """1 - distance of unit vectors: the cosine, or with the squared Euclidean distance 2 * cosine - 1, which orders alike."""
    d = dot(a, b)
    return d if metric == "cosine" else 2 * d - 1


def nearest(chunks: DataFrame, vector: Sequence[float], k: int, metric: str = "cosine") -> DataFrame:
    """The ``k`` chunks closest to one vector, which is a literal of the plan: a scan and a bounded sort."""
    score = similarity(F.col("vector"), F.array(*[F.lit(float(x)) for x in vector]), metric)
    return chunks.withColumn("score", score).drop("vector").orderBy(F.desc("score"), "chunk_id").limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))


def rebuild_index(chunks: DataFrame, path: str, sanity: str = "inundaciones", limit: int = 3) -> tuple[int, DataFrame]:
    """Builds the index anew and tries it: the number of chunks, and the best of them for ``sanity``. Without chunks there is nothing to build: ValueError."""
    if not chunks.select("chunk_id").head(1):
        raise ValueError("no chunks to index")
    index = write_index(chunks, path)
    queries = chunks.sparkSession.createDataFrame([("0", sanity)], "query_id string, query string")
    return index.n, text_search(chunks, queries, limit, index)


def text_search(chunks: DataFrame, queries: DataFrame, k: int, index: TextIndex | None = None, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """The ``k`` best chunks of each query by BM25; scores are divided by the best of the returned rows.

    ``index`` is that of the whole corpus (without one it is built in the shared folder); ``chunks`` may be filtered, the filter holds before the ranking. Only blocks of the index that can hold one
    of the best are scored (all of them for queries of many terms, and where ``by`` asks for the best of groups), ids alone are ranked, and the texts of the best rows are fetched then.
    """
    index = write_index(chunks, new_path(chunks.sparkSession, "text-index")) if index is None else index
    own = [c for c in by if c != "query_id"]
    search = plan(index, queries)
    if search is None:
        scored = queries.select("query_id").limit(0).crossJoin(chunks.select("chunk_id", *own).limit(0)).withColumn("score", F.lit(0.0))
    elif own or not search.prunes:
        scored = search.best(chunks.select("chunk_id", *own), k, own)
    else:
        scored = search.scored(best_blocks(search, chunks.select("chunk_id"), k)).join(chunks.select("chunk_id"), "chunk_id").filter("score > 0")
    best = top_k(scored, k, by)
    best = best.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy(*by)))
    return chunks.drop(*own).join(best, "chunk_id")


def marked(text: Column, is_summary: Column | None) -> Column:
    """A summary's text with its mark."""
    return text if is_summary is None else F.when(is_summary, F.concat(F.lit(SUMMARY_MARK), text)).otherwise(text)


def shaped(results: DataFrame, fields: Sequence[str], defaults: dict, extra: Sequence[str] = ("score", "rank")) -> DataFrame:
    """Result rows: the fields with their defaults where a column or a value is missing, the summary mark, and ``extra``."""
    has = set(results.columns)

    def one(name: str) -> Column:
        default = defaults.get(name, "")
        value = F.coalesce(F.col(name), F.lit(default)) if name in has else F.lit(default)
        return (marked(value, F.coalesce("is_summary", F.lit(False))) if name == "text" and "is_summary" in has else value).alias(name)

    return results.select(*[c for c in ("query_id", "chunk_id") if c in has], *map(one, fields), *extra)


def fuse(semantic: DataFrame, textual: DataFrame, key: Sequence[Column], limit: int, semantic_weight: float = 0.5, text_weight: float | None = None, rrf_k: int = RRF_K, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists with the same columns.

    A key's score is the sum of weight / (rrf_k + rank) over its rows. Of a key's rows the semantic one of the largest rank is shown, else the full-text one of the
    least. The best score of the returned rows becomes 1. Only ``limit``-sized lists are exchanged.
    """
    text_weight = 1 - semantic_weight if text_weight is None else text_weight
    columns = [c for c in semantic.columns if c not in (*by, "score", "rank")]
    keys = [k.alias(f"_key{i}") for i, k in enumerate(key)]
    side = lambda df, s, w: df.select(*by, *keys, F.lit(s).alias("_side"), F.col("rank").alias("_rank"), (F.lit(float(w)) / (F.lit(rrf_k) + F.col("rank"))).alias("_part"), F.struct(*columns).alias("_row"))
    both = side(semantic, 0, semantic_weight).unionByName(side(textual, 1, text_weight))
    names = [f"_key{i}" for i in range(len(key))]
    is_semantic = F.col("_side") == 0
    fused = both.groupBy(*by, *names).agg(
        F.sum("_part").alias("score"),
        F.coalesce(F.max_by("_row", F.when(is_semantic, F.col("_rank"))), F.min_by("_row", F.col("_rank"))).alias("_row"),
        F.min(F.when(is_semantic, F.col("_rank"))).alias("_first"), F.min(F.when(~is_semantic, F.col("_rank"))).alias("_second"),
    )
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("_first").asc_nulls_last(), F.col("_second").asc_nulls_last())
    best = fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    best = best.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy(*by)))
    return best.select(*by, "_row.*", "score", "rank")


def boosted(results: DataFrame, boosts: dict[str, float], by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Scores times the document type's boost (1 without one), summaries times 0.7, rounded to 6 digits; ranked anew among the rows at hand.

    Adds original_score and precedence_boost.
    """
    boost = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in boosts.items() for x in (k, float(v))]), F.col("document_type")), F.lit(1.0)) if boosts else F.lit(1.0)
    if "is_summary" in results.columns:
        boost = boost * F.when(F.col("is_summary"), SUMMARY_BOOST).otherwise(1.0)
    out = results.withColumn("original_score", F.col("score")).withColumn("precedence_boost", boost).withColumn("score", F.round(F.col("score") * F.col("precedence_boost"), 6))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "rank")))


def parse_rerank_scores(answer: Column) -> Column:
    """A scorer's answer as a map from position to score.

    From the first bracket to the last closing one; where the list was cut off, an entry that is not complete goes and the list is closed. Null where nothing can be read.
    """
    whole = F.regexp_extract(answer, r"(?s)\[.*\]", 0)
    rest = F.regexp_replace(F.regexp_extract(answer, r"(?s)\[.*", 0), r"[\s,]+\z", "")
    repaired = F.when(rest.endswith("{"), F.concat(F.regexp_replace(rest, r",?\s*\{\z", ""), F.lit("]"))).when(rest.endswith("}"), F.concat(rest, F.lit("]"))).when(rest != "", F.concat(rest, F.lit("}]")))
    scores = F.from_json(F.when(whole != "", whole).otherwise(repaired), "array<struct<index:int,score:double>>")
    return F.map_from_entries(F.filter(scores, lambda s: s["index"].isNotNull() & s["score"].isNotNull()))


def reranked(results: DataFrame, scores: DataFrame, k: int, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """The ``k`` rows with the best scores of (query_id, index, rerank_score), index being rank - 1; rows without one count 0, ties keep their order.

    Ranks stay as they were.
    """
    joined = results.withColumn("index", F.col("rank") - 1).join(scores, [*by, "index"], "left").drop("index")
    joined = joined.withColumn("rerank_score", F.coalesce("rerank_score", F.lit(0.0)))
    order = Window.partitionBy(*by).orderBy(F.desc("rerank_score"), "rank")
    return joined.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def rerank_block(results: DataFrame, entities: Sequence[str] = ()) -> Column:
    """A result as a scorer is shown it: number, entities (the type where there are none), type, section, and the first 500 characters."""
    shown = lambda name, label: F.concat(F.lit(f"{label}: "), F.coalesce(F.col(name).cast("string"), F.lit("N/A")) if name in results.columns else F.lit("N/A"))
    # fixed values: the labels that scorers are shown
    first = [shown(e, e) for e in entities] or [shown("document_type", "Type")]
    head = F.concat_ws(" | ", *first, shown("document_type", "Tipo"), shown("section_title", "Sección"))
    return F.concat(F.lit("["), (F.col("rank") - 1).cast("string"), F.lit("] "), head, F.lit("\n"), F.substring(F.coalesce("text", F.lit("")), 1, 500))


def absence(evidence: DataFrame, limit: int = 3, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Whether any of several keywords was found, per query: found, keywords_matched, and the first ``limit`` texts.

    ``evidence`` is (query_id, keyword_no, keyword, rank, text). Texts count as the same by their first 200 characters, the first stays.
    """
    first = Window.partitionBy(*by, F.xxhash64(tx.prefix_key(F.col("text"))), tx.prefix_key(F.col("text"))).orderBy("keyword_no", "rank")
    unique = evidence.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    found = evidence.groupBy(*by).agg(F.array_sort(F.collect_set(F.struct("keyword_no", "keyword"))).alias("_k"))
    order = Window.partitionBy(*by).orderBy("keyword_no", "rank")
    shown = unique.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit)
    texts = shown.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "text"))), lambda x: x["text"]).alias("evidence"))
    return found.join(texts, list(by)).select(*by, (F.size("_k") > 0).alias("found"), F.transform("_k", lambda x: x["keyword"]).alias("keywords_matched"), "evidence")
