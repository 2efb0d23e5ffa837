"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workspace import shared_dir, written

__all__ = ["fold_bucket", "salts_for", "shared_dir", "slices", "table", "text_of", "with_ids", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The whole text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def fold_bucket(column: Column, fold: int) -> Column:
    """crc32 of the id as text, modulo ``fold``."""
    return F.crc32(column.cast("string").cast("binary")) % fold


def with_ids(df: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose id is among ``ids``, with all their columns.

    The same plan at every size: rows and ids meet by a shuffle on the id, in which each row moves once, and nothing is broadcast. Adaptive execution splits
    an id that very many rows repeat. Rows with a null id all stay or all go, as null is among ``ids`` or not; they do not move.
    """
    own = f"_kept_{uuid.uuid4().hex}"  # whatever columns the rows have
    ids = written(ids.select(F.col(id_col).alias(own)).distinct(), "kept")
    known = df.filter(F.col(id_col).isNotNull()).join(ids.hint("shuffle_hash"), F.col(id_col) == F.col(own), "left_semi")
    return known.unionByName(df.filter(F.col(id_col).isNull())) if ids.filter(F.col(own).isNull()).head(1) else known


def salts_for(rows: int, least: int = 64, each: int = 200_000, base: int = 2) -> int:
    """Into how many parts (a power of ``base``) rows are dealt so that a part of one key has about ``each`` rows, even where all rows have that key."""
    n = 1
    while n < least or n * each < rows:
        n *= base
    return n


def slices(batches, rows: int = 1000, limit: int = 4 << 20):
    """Arrow batches in slices of up to ``rows`` rows and about ``limit`` bytes of text or binary data (one row at least), so that few texts are Python objects at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.zeros(batch.num_rows, dtype=np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
                size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        upto, at = np.cumsum(size), 0
        while at < batch.num_rows:
            before = upto[at - 1] if at else 0
            end = min(at + rows, max(at + 1, int(np.searchsorted(upto, before + limit, "right"))))
            yield batch.slice(at, end - at)
            at = end
