"""Listings and counts over the chunk table: hash aggregations with partial sums, columns pruned at the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def list_entities(chunks: DataFrame, target: str, entities: Sequence[str]) -> DataFrame:
    """Combinations of all entity columns that occur, with their document types, by the target's name.

    A combination with a missing value is left out. ``document_type`` may be the target: then each type with the values it has.
    """
    have = [e for e in entities if e in chunks.columns]
    keys = [target] if target == "document_type" else have
    rows = chunks.dropna(subset=keys)
    if target == "document_type":
        return rows.groupBy(target).agg(*[F.sort_array(F.collect_set(e)).alias(e) for e in have]).orderBy(target)
    if "document_type" not in chunks.columns:
        return rows.select(*keys).distinct().withColumn("document_types", F.array().cast("array<string>")).orderBy(target, *keys)
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_set("document_type")).alias("document_types")).orderBy(target, *keys)


def list_document_types(chunks: DataFrame, extra: Sequence[str] = ("deliverable_code", "process_phase")) -> DataFrame:
    """Chunks per document type (and the extra columns that exist), most first; combinations with a missing value are left out."""
    keys = ["document_type", *[c for c in extra if c in chunks.columns]]
    return chunks.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), *keys)


def get_sections(chunks: DataFrame, entity: str, value: str, limit: int = 500, order: Sequence[str] = ("ingest_seq",)) -> DataFrame:
    """Distinct section titles of the first ``limit`` chunks of an entity's value, each with the index of its first chunk, in that order."""
    rows = chunks.filter(F.col(entity) == value).select("section_title", "chunk_index", *order).orderBy(*order).limit(limit)
    first = rows.groupBy("section_title").agg(F.min(F.struct(*order, "chunk_index")).alias("_first"))
    return first.select("section_title", F.col("_first.chunk_index").alias("chunk_index"), F.col(f"_first.{order[0]}").alias("_seq")).orderBy("chunk_index", "_seq", "section_title").drop("_seq")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_type", "source_file").agg(F.count(F.lit(1)).alias("chunk_count"))


def value_counts(chunks: DataFrame, column: str) -> DataFrame:
    return chunks.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), column)


def corpus_statistics(chunks: DataFrame, entities: Sequence[str], approximate: bool = False) -> DataFrame:
    """One row: chunks, and distinct values of each entity (by a sketch if asked for)."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), *[distinct(F.col(e)).alias(f"distinct_{e}") for e in entities])


def section_texts(chunks: DataFrame, least_chars: int = 200) -> DataFrame:
    """Text of each section of a document, its chunks joined by blank lines; an empty title counts as "General". Sections of up to ``least_chars`` go."""
    titled = chunks.withColumn("section_title", F.when(F.coalesce("section_title", F.lit("")) == "", "General").otherwise(F.col("section_title")))
    joined = titled.groupBy("document_type", "source_file", "section_title").agg(
        F.min("chunk_index").alias("first_chunk"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda c: c["text"]), "\n\n").alias("text")
    )
    return joined.filter(F.length("text") > least_chars)


def sampled_files(files: DataFrame, most: int = 5, most_words: int = 2000) -> DataFrame:
    """The first files by name with their first words; a cut text says so."""
    from ..functions import text as tx

    first = files.orderBy("file_name").limit(most)
    return first.select("file_name", tx.let(tx.words(F.col("text")), lambda w: F.when(F.size(w) > most_words, F.concat(F.array_join(F.slice(w, 1, most_words), " "), F.lit("\n[... truncated]"))).otherwise(F.col("text"))).alias("text"))


def top_per_group(df: DataFrame, group: str, score: str, k: int, ties: Sequence[str]) -> DataFrame:
    """The ``k`` best rows of each group with their rank."""
    order = Window.partitionBy(group).orderBy(F.desc(score), *ties)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def cube_counts(chunks: DataFrame, dimensions: Sequence[str] = ("document_type", "content_type")) -> DataFrame:
    """Chunks by all combinations of the dimensions, by fewer of them, and in all, in one pass: the dimensions, ``level`` (bit by bit, 1 where one is summed over) and ``count``.

    A null in a dimension where its bit is 0 is a group of rows without a value.
    """
    return chunks.cube(*dimensions).agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("count"))


#: Sketches have 2^12 registers: the standard error of a number of distinct values is 1.04 / 2^6, 1.6 %.
SKETCH_BITS = 12


def distinct_sketches(chunks: DataFrame, columns: Sequence[str], by: Sequence[str] = ("document_type",)) -> DataFrame:
    """(*by, column, sketch, rows): a HyperLogLog sketch of each column's values in each group, some kB each whatever the group's size. Nulls count as no value."""
    one = lambda c: F.struct(F.lit(c).alias("column"), F.hll_sketch_agg(F.col(c).cast("string"), SKETCH_BITS).alias("sketch"))
    rows = chunks.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *[one(c)["sketch"].alias(f"_s{k}") for k, c in enumerate(columns)])
    return rows.select(*by, "rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_s{k}").alias("sketch")) for k, c in enumerate(columns)])).alias("s")).select(*by, "s.*", "rows")


def merged_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, column, distinct, rows) from stored sketches, of one table or of several together: groups, commits or days are merged without looking at their rows again."""
    return sketches.groupBy(*by, "column").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"), F.sum("rows").alias("rows"))
