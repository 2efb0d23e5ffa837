"""Nearest vectors: exact over all rows, and an index of cells with an exact way.

Ids and vectors alone are looked at. Queries are the stated set: they go to the tasks in blocks of a measured size, each Arrow batch of rows meets a block as one matrix product where it lies,
and only the best of a batch go on. The rows of the best are fetched last.

The index: cells by k-means, fitted on a bounded sample of the vectors; every row is assigned to its nearest centre and lies with its cell. A search looks into the ``probes`` cells whose
centres are nearest to a query and scores their rows exactly; with as many probes as cells it is the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import snapshots

#: Queries' vectors go to tasks in blocks of so many bytes; centres of an index take no more than that either.
QUERY_BLOCK = 16 << 20
#: The most vectors that centres are fitted on, those with the least hashes of their ids.
SAMPLE = 20_000
MOST_CELLS = 4096


def top_k(scored: DataFrame, k: int, by: Sequence[str] = ("query_id",), score: str = "score", ties: Sequence[str] = ("chunk_id",)) -> DataFrame:
    """The ``k`` best rows of each ``by`` group with their rank from 1; equal scores by ``ties``."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), *ties)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, vectors): the rows of a list column that have ``dim`` numbers, as one matrix. Null vectors, vectors with nulls and vectors of another length are left out."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = array.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    places = np.flatnonzero(sizes == dim)
    if not len(places) or not dim:
        return places[:0], np.zeros((0, dim))
    values = array.take(pa.array(places)).flatten().cast(pa.float64())
    vectors = values.to_numpy(zero_copy_only=False).reshape(len(places), dim)
    whole = ~np.isnan(vectors).any(axis=1)
    return places[whole], vectors[whole]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, equal ones by id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _query_blocks(queries: DataFrame, block_bytes: int) -> Iterator[tuple[list, np.ndarray, pa.DataType]]:
    """(ids, matrix, type of the ids) of the queries' vectors, by blocks of about ``block_bytes``. Queries without a vector are left out."""
    rows = queries.select("query_id", "query_vector").filter("query_vector IS NOT NULL")
    size, dim = rows.agg(F.coalesce(F.sum(F.size("query_vector").cast("long") * 8 + 64), F.lit(0)), F.coalesce(F.max(F.size("query_vector")), F.lit(0))).head()
    blocks = max(1, -(-size // block_bytes))
    for n in range(blocks):
        own = (rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n)).toArrow()
        places, vectors = matrix(own.column("query_vector"), dim)
        if len(places):
            ids = own.column("query_id")
            yield ids.take(pa.array(places)).to_pylist(), vectors, ids.type


def _scored(rows: DataFrame, ids: list, wanted: np.ndarray, id_type: pa.DataType, k: int, own: Sequence[str], metric: str, digits: int | None, probed: np.ndarray | None = None) -> DataFrame:
    """(query_id, chunk_id, *own, score): the best of each batch of (chunk_id, vector, *own) for each query. ``probed`` (queries x cells) says which cells a query looks into."""
    held = rows.sparkSession.sparkContext.broadcast((ids, wanted, probed))

    def run(batches):
        names, vectors, probe = held.value
        for batch in batches:
            places, found = matrix(batch.column("vector"), vectors.shape[1])
            if not len(places):
                continue
            chunk_ids = batch.column("chunk_id").take(pa.array(places))
            order = np.array(chunk_ids.to_pylist()) if not pa.types.is_integer(chunk_ids.type) else chunk_ids.to_numpy(zero_copy_only=False)
            groups = list(zip(*(batch.column(c).take(pa.array(places)).to_pylist() for c in own))) if own else None
            at_of = {}
            for place, g in enumerate(groups or ()):
                at_of.setdefault(g, []).append(place)
            parts = [np.array(x) for x in at_of.values()] if own else [np.arange(len(places))]
            cells = batch.column("cell").to_numpy(zero_copy_only=False)[places] if probe is not None else None
            query, place, score = [], [], []
            for at in range(0, len(names), 256):
                scores = vectors[at : at + 256] @ found.T
                scores = scores if metric == "cosine" else 2 * scores - 1
                scores = np.round(scores, digits) + 0.0 if digits is not None else scores
                for q in range(len(scores)):
                    for part in parts:
                        if probe is not None:
                            part = part[probe[at + q][cells[part]]]
                        best = part[_best(order[part], scores[q][part], k)] if len(part) else part
                        query.append(np.full(len(best), at + q))
                        place.append(best)
                        score.append(scores[q][best])
            q, p, s = np.concatenate(query), np.concatenate(place), np.concatenate(score)
            columns = [pa.array(names, id_type).take(pa.array(q)), chunk_ids.take(pa.array(p)), *(batch.column(c).take(pa.array(places[p])) for c in own), pa.array(s)]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "chunk_id", *own, "score"])

    from pyspark.sql.pandas.types import from_arrow_type

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([f"query_id {from_arrow_type(id_type).simpleString()}", f"chunk_id {kinds['chunk_id']}", *(f"`{c}` {kinds[c]}" for c in own), "score double"])
    return rows.mapInArrow(run, schema)


def vector_search(chunks: DataFrame, queries: DataFrame, k: int, by: Sequence[str] = ("query_id",), metric: str = "cosine", digits: int | None = 6, block_bytes: int = QUERY_BLOCK, index: VectorIndex | None = None, probes: int | None = None) -> DataFrame:
    """The ``k`` chunks (chunk_id, vector, ...) closest to each query (query_id, query_vector, ...), or to each query in each group of ``by``.

    Exact: one scan of the chunks' ids and vectors for each block of queries. With ``index`` the rows of each query's nearest cells are scored, and ``chunks`` says which rows may be
    found; ``probes`` is the index's own number where it is not given. Chunks without a vector, or with one of another length than the longest query's, are not found.
    """
    own = [c for c in by if c != "query_id"]
    found = None
    for ids, wanted, kind in _query_blocks(queries, block_bytes):
        if index is None:
            best = _scored(chunks.select("chunk_id", "vector", *own), ids, wanted, kind, k, own, metric, digits)
        else:
            rows, probed = index.rows_for(wanted, probes)
            if own:
                rows = rows.join(chunks.select("chunk_id", *own), "chunk_id")
            else:
                rows = rows.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
            best = _scored(rows, ids, wanted, kind, k, own, metric, digits, probed)
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = queries.select("query_id").crossJoin(chunks.select("chunk_id", *own)).withColumn("score", F.lit(0.0)).limit(0)
    best = top_k(found, k, by)
    return chunks.drop("vector", *own).join(best, "chunk_id").join(queries.drop("query_vector"), "query_id")


# ---- the index ----


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """Centres by k-means over the rows of ``sample``; a centre that nothing is nearest to moves to the row that is farthest from its own."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)].astype(np.float64)
    for _ in range(rounds):
        distance = (centres**2).sum(1) - 2 * sample @ centres.T
        own = distance.argmin(1)
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        moved = total / np.maximum(count, 1)[:, None]
        if len(empty := np.flatnonzero(count == 0)):
            far = np.argsort(-(distance[np.arange(len(sample)), own] + (sample**2).sum(1)))
            moved[empty] = sample[far[: len(empty)]]
        if np.allclose(moved, centres, atol=1e-9):
            break
        centres = moved
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray, aim: float, queries: int = 200, k: int = 10) -> int:
    """Into how many cells a search has to look so that the share ``aim`` of the ``k`` nearest of the sample's first rows is found among the sample."""
    asked = sample[:queries]
    scores = asked @ sample.T
    nearest = np.argpartition(-scores, min(k, len(sample)) - 1, axis=1)[:, : min(k, len(sample))]
    own = ((centres**2).sum(1) - 2 * sample @ centres.T).argmin(1)
    order = ((centres**2).sum(1) - 2 * asked @ centres.T).argsort(1).argsort(1)
    places = np.sort(np.take_along_axis(order, own[nearest], axis=1).ravel())
    return int(places[min(len(places) - 1, int(np.ceil(aim * len(places))))]) + 1


@dataclass(frozen=True)
class VectorIndex:
    """A version of the index at ``path``: the cells' centres, and rows (chunk_id, vector, cell) that lie by ranges of cells."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    probes: int
    shards: int

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def rows_for(self, wanted: np.ndarray, probes: int | None = None) -> tuple[DataFrame, np.ndarray]:
        """The rows of the cells that any of the queries looks into, and which query looks into which. Files of other shards of cells are not opened."""
        probes = min(len(self.centres), self.probes if probes is None else probes)
        distance = (self.centres**2).sum(1) - 2 * wanted @ self.centres.T
        nearest = np.argpartition(distance, probes - 1, axis=1)[:, :probes]
        probed = np.zeros((len(wanted), len(self.centres)), dtype=bool)
        np.put_along_axis(probed, nearest, True, axis=1)
        cells = np.flatnonzero(probed.any(0))
        if len(cells) == len(self.centres):
            return self.rows(), probed
        shards = sorted({int(c) % self.shards for c in cells})
        return self.rows().filter(F.col("shard").isin(shards) & F.col("cell").isin([int(c) for c in cells])), probed


def write_vector_index(chunks: DataFrame, path: str, cells: int | None = None, probes: int | None = None, sample: int = SAMPLE, shards: int = 32, aim: float = 0.96) -> VectorIndex:
    """The index of ``chunks`` (chunk_id, vector): centres fitted on at most ``sample`` vectors, every row assigned. ``cells`` is the root of the number of rows where it is not given (4096 at
    most), ``probes`` as many as find the share ``aim`` of the nearest within the sample. Rows whose vector is null, has a null or another length than most are in no cell, and are not found by any search either."""
    spark = chunks.sparkSession
    rows = chunks.select("chunk_id", "vector").filter("vector IS NOT NULL")
    dims = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim, n = (dims["d"], dims["count"]) if dims else (0, 0)
    cells = min(MOST_CELLS, cells or max(1, round(n**0.5)))
    fitted = rows.filter(F.size("vector") == dim).orderBy(F.xxhash64("chunk_id", F.lit(3)), "chunk_id").limit(sample).toArrow()
    known = matrix(fitted.column("vector"), dim)[1]
    centres = fit_centres(known, cells) if len(known) else np.zeros((0, dim))
    held = spark.sparkContext.broadcast(centres)

    def assign(batches):
        middle = held.value
        for batch in batches:
            places, vectors = matrix(batch.column("vector"), middle.shape[1])
            if not len(places) or not len(middle):
                continue
            own = ((middle**2).sum(1) - 2 * vectors @ middle.T).argmin(1)
            taken = batch.take(pa.array(places))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(own.astype(np.int32))], [*taken.schema.names, "cell"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = rows.mapInArrow(assign, f"{kinds}, cell int").withColumn("shard", F.col("cell") % shards)
    spread = F.pmod(F.xxhash64("chunk_id"), F.lit(1 + n // 1_000_000)).cast("int")  # a cell with very many rows is in several files
    placed.repartition(shards, "shard", spread).sortWithinPartitions("shard", "cell").write.partitionBy("shard").option("compression", "zstd").parquet(f"{path}/rows")
    probes = probes or (probes_for(known, centres, aim) if len(known) else 1)
    snapshots.publish(spark, path, 0, {"centres": centres.tolist(), "probes": probes, "shards": shards})
    return VectorIndex(spark, path, centres, probes, shards)


def open_vector_index(spark: SparkSession, path: str) -> VectorIndex | None:
    found = snapshots.read(spark, path)
    return VectorIndex(spark, path, np.array(found[1]["centres"]), found[1]["probes"], found[1]["shards"]) if found else None


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: of the (query_id, chunk_id) pairs of the exact result the share that was found."""
    hit = found.select("query_id", "chunk_id").withColumn("_hit", F.lit(1))
    return exact.join(hit, ["query_id", "chunk_id"], "left").agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.count("_hit") / F.count(F.lit(1)), F.lit(1.0)).alias("recall"))
