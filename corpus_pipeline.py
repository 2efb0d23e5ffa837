"""From raw documents to token files: quality, near-dedup, decontamination, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last return the columns of
documents; the last returns what the token files hold of each document.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakescribe.llm.common import fold_bucket, table, with_ids, written
from lakescribe.llm.decontaminate import decontaminate
from lakescribe.llm.mixing import WORD, mix
from lakescribe.llm.near_dedup import near_duplicates
from lakescribe.llm.quality import good_documents
from lakescribe.llm.queries import vocabulary
from lakescribe.llm.token_files import token_files


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Each row goes by its own text: null texts count as empty and are scored like any other, rows that repeat and rows with null ids are scored each, whole texts count however long,
    and other columns stay as they are. An empty table stays empty; without labels of both classes all rows stay. Rows do not move.
    """
    bucket = fold_bucket(F.col("_label_id"), 5)
    return good_documents(docs, table(spark, sf_dir, "labels"), learnable=bucket != 0, fitting=bucket != 4)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least id.

    Documents without words, or with a null text, are linked with nothing and stay, and so do rows with a null id. Rows that repeat an id are one document: all of
    them stay or go. An empty table stays empty; other columns stay as they are. Each row moves once to meet the decision on its id.
    """
    return with_ids(docs, near_duplicates(docs).filter("kept"))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages by the contamination rule go.

    Documents without words, or with a null text, stay. Of rows that repeat an id those stay, together, of which one is clean; with a null id likewise. An empty table, or an
    empty benchmark, takes nothing away; other columns stay as they are. Each row moves once to meet the decision on its id.
    """
    return with_ids(docs, decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("NOT contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Documents without words are never taken; a null source is a source of its own. Rows that repeat an id are queued each, and each comes as often as the most taken of
    them; rows with a null id are such rows too. An empty table stays empty; other columns stay as they are. Each row moves once to meet the number for its id.
    """
    own, times = "_taken_" + uuid4().hex, "_times_" + uuid4().hex  # whatever columns the rows have
    taken = mix(docs).filter("taken > 0").groupBy(F.col("doc_id").alias(own)).agg(F.max(F.expr("int(taken div size)")).alias(times))
    taken = written(taken, "taken")
    docs = docs.filter(F.col("text").rlike(WORD))  # a row without words is not taken, whatever rows share its id
    joined = docs.filter("doc_id IS NOT NULL").join(taken.hint("shuffle_hash"), F.col("doc_id") == F.col(own)).drop(own)
    if null := taken.filter(F.col(own).isNull()).head(1):
        joined = joined.unionByName(docs.filter("doc_id IS NULL").withColumn(times, F.lit(null[0][times])))
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(own)).drop(own)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: a row per row, in order of the ids, nulls first.

    Null texts are empty: they have the end id only. Rows that repeat are written each. An empty table writes empty files.
    """
    return token_files(docs, vocabulary(), end_id=2)


STAGES = [
    ("quality", keep_good),
    ("near_dedup", keep_one_of_near_copies),
    ("decontamination", keep_uncontaminated),
    ("mix", mix_sources),
    ("tokens", write_tokens),
]

#: The classifier cannot be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each stage's rows written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
