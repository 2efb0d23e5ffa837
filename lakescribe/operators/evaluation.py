"""Retrieval-quality metrics of many queries in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that may hold a result's entity, the first that is not empty counts.
ENTITY_COLUMNS = ("entity", "comunidad", "community", "city", "department")


def entity_of(results: DataFrame, columns: Sequence[str] = ENTITY_COLUMNS) -> Column:
    have = [F.nullif(F.col(c), F.lit("")) for c in columns if c in results.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def hits(results: DataFrame, queries: DataFrame, entity_columns: Sequence[str] = ENTITY_COLUMNS) -> DataFrame:
    """Results (query_id, rank, document_type, ...) with ``hit``: an expected document type and, if any is expected, an expected entity."""
    rows = results.withColumn("_entity", entity_of(results, entity_columns)).join(queries.select("query_id", "expected_document_types", "expected_entities"), "query_id")
    right_type = F.coalesce(F.array_contains("expected_document_types", F.col("document_type")), F.lit(False))
    right_entity = (F.size(F.coalesce("expected_entities", F.array().cast("array<string>"))) == 0) | F.coalesce(F.array_contains("expected_entities", F.col("_entity")), F.lit(False))
    return rows.withColumn("hit", right_type & right_entity)


def metrics(results: DataFrame, queries: DataFrame, entity_columns: Sequence[str] = ENTITY_COLUMNS) -> DataFrame:
    """Per query: p_at_5, p_at_10, recall_at_10, mrr, ndcg_at_5.

    Precision divides by the rows that were returned; recall counts distinct expected entities that were hit, or types where no entities are expected; the ideal of NDCG is
    the query's own hits first. A query without results has zeros.
    """
    rows = hits(results, queries, entity_columns)
    hit, rank = F.col("hit").cast("int"), F.col("rank")
    within = lambda k, x: F.when(rank <= k, x)
    expected = F.coalesce("expected_entities", F.array().cast("array<string>"))
    by_entity = F.size(expected) > 0
    found = F.count_distinct(F.when(F.col("hit") & (rank <= 10), F.when(by_entity, F.col("_entity")).otherwise(F.col("document_type"))))
    wanted = F.max(F.when(by_entity, F.size(F.array_distinct(expected))).otherwise(F.size(F.array_distinct("expected_document_types"))))
    n5 = F.coalesce(F.sum(within(5, hit)), F.lit(0))
    ideal = F.aggregate(F.slice(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: 1 / F.log2(i + 1.0)), 1, n5.cast("int")), F.lit(0.0), lambda s, x: s + x)
    per_query = rows.groupBy("query_id").agg(
        F.avg(within(5, hit)).alias("p_at_5"), F.avg(within(10, hit)).alias("p_at_10"), F.when(wanted > 0, found / wanted).otherwise(0.0).alias("recall_at_10"),
        F.coalesce(1 / F.min(F.when(F.col("hit"), rank)), F.lit(0.0)).alias("mrr"),
        F.when(n5 > 0, F.sum(within(5, hit / F.log2(rank + 1.0))) / ideal).otherwise(0.0).alias("ndcg_at_5"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return queries.select("query_id").join(per_query, "query_id", "left").select("query_id", *map(zero, ("p_at_5", "p_at_10", "recall_at_10", "mrr", "ndcg_at_5")))


def averages(per_query: DataFrame) -> DataFrame:
    """One row: the mean of every metric over the queries, 0 without any, and their number."""
    names = [c for c in per_query.columns if c != "query_id"]
    return per_query.agg(F.count(F.lit(1)).alias("queries"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in names])
