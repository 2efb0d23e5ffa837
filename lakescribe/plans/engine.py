"""The engine: search, listings and checks over one chunk table, as a library, as tools and as requests."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CorpusConfig
from ..functions import text as tx
from ..operators import catalog, filters, search
from ..operators.enrich import hashed_embedding, with_waits
from ..sources.chunktable import ChunkTable
from ..sources.workspace import new_path
from .reindex import text_index

MODES = ("semantic", "fts", "hybrid")
MOST_VALUES, MOST_KEYWORDS, HYBRID_FETCH, RERANK_FETCH = 40, 10, 3, 4


class InvalidRequest(ValueError):
    """A request that names what does not exist."""


class Engine:
    """Queries over chunks (chunk_id, text, vector, document_type, ...) with a full-text index and an encoder.

    ``encode`` turns texts into vectors; without one, a stand-in that only knows shared words. ``scorer`` answers a re-ranking prompt (query, shown results) with scores;
    ``second_scorer`` is asked where that fails. Without a configuration there are no entities, boosts or filters but those that every table has. ``index`` is the stored
    full-text index, built on first use where it is not given.
    """

    def __init__(
        self, chunks: DataFrame, config: CorpusConfig | None = None, encode: Callable | None = None, scorer: Callable[[str, list[str]], str] | None = None,
        index: search.TextIndex | None = None, second_scorer: Callable[[str, list[str]], str] | None = None,
    ):
        self.chunks, self.config, self.spark = chunks, config or CorpusConfig("", "chunks"), chunks.sparkSession
        # fixed values: what is shown of a chunk without a configuration
        plain = ["text", "context", "section_title", "content_type", "has_quantitative_data", "document_type", "page_start", "page_end", "is_summary"]
        self.result_fields = plain if config is None else config.result_fields
        self.encode, self.scorers = encode or hashed_embedding, [s for s in (scorer, second_scorer) if s is not None]
        self._index = index

    @classmethod
    def open(cls, spark: SparkSession, path: str | None = None, table: str | None = None, config: CorpusConfig | None = None, version: int | None = None, **options: Any) -> Engine:
        """The engine over a stored table: ``path``/``table``, where the path is the one given, else CORPUS_DB_PATH, else a folder of the user's home, and
        the table the one given, else the configuration's, else "chunks". A versioned table is opened at its newest version, or at ``version``, with the index that belongs to it; a plain
        Parquet table with the index beside it (``table``_fts), if any. Only metadata is read."""
        base = (path or os.environ.get("CORPUS_DB_PATH") or str(Path.home() / "lakescribe" / "data")).rstrip("/")
        place = f"{base}/{table or (config.table_name if config else 'chunks')}"
        stored = ChunkTable.open(spark, place, version)
        if stored.schema is not None:
            return cls(stored.rows(), config, **{"index": text_index(stored), **options})
        index = search.open_index(spark, f"{place}_fts") if "index" not in options else options.pop("index")
        return cls(spark.read.parquet(place), config, index=index, **options)

    @property
    def index(self) -> search.TextIndex:
        if self._index is None:
            self._index = search.write_index(self.chunks, new_path(self.spark, "text-index"))
        return self._index

    # -- search --

    def _checked(self, given: dict[str, Any]) -> dict[str, Any]:
        wanted = {k: v for k, v in given.items() if v is not None}
        if bad := filters.invalid_keys(wanted, self.config.valid_filters):
            raise InvalidRequest(f"invalid filters: {', '.join(bad)}; valid: {', '.join(sorted(self.config.valid_filters))}")
        return wanted

    def _queries(self, texts: Sequence[str]) -> DataFrame:
        vectors = self.encode([f"search_query: {t}" for t in texts])
        rows = [(str(i), t, [float(x) for x in v]) for i, (t, v) in enumerate(zip(texts, vectors))]
        return self.spark.createDataFrame(rows, "query_id string, query string, query_vector array<float>")

    def found(self, rows: DataFrame, queries: DataFrame, mode: str, limit: int, by: Sequence[str] = ("query_id",), boost: bool = True, semantic_weight: float = 0.5, text_weight: float | None = None, rrf_k: int = search.RRF_K) -> DataFrame:
        """The best of ``rows`` for each of (query_id, query, query_vector), all in one job."""
        vector = lambda k: search.vector_search(rows, queries, k, by)
        text = lambda k: search.text_search(rows, queries.select("query_id", "query"), k, self.index, by)
        if mode == "semantic":
            out = vector(limit).drop("query")
        elif mode == "fts":
            out = text(limit).drop("vector")
        else:
            names = self.config.entity_names
            key = [F.coalesce(F.col(names[0] if names and names[0] in rows.columns else "document_type"), F.lit("")), tx.prefix_key(search.marked(F.col("text"), F.col("is_summary") if "is_summary" in rows.columns else None))]
            left, right = vector(limit * HYBRID_FETCH).drop("query"), text(limit * HYBRID_FETCH).drop("vector", "query")
            out = search.fuse(left.select(right.columns), right, key, limit, semantic_weight, text_weight, rrf_k, by)
        return search.boosted(out, self.config.boosts, by) if boost else out

    def search(
        self, query: str, mode: str = "hybrid", limit: int = 5, apply_precedence: bool = True, rerank: bool = False, include_summaries: bool = False, semantic_weight: float = 0.5,
        text_weight: float | None = None, rrf_k: int = search.RRF_K, **given: Any,
    ) -> DataFrame:
        """The best chunks for a query. A blank query has no results; an unknown mode is hybrid."""
        wanted = self._checked(given)
        rows = filters.filtered(self.chunks, wanted, self.config.valid_filters, include_summaries)
        if not query.strip():
            return rows.limit(0)
        fetch = limit * RERANK_FETCH if rerank else limit
        found = self.found(rows, self._queries([query]), mode if mode in MODES else "hybrid", fetch, ("query_id",), apply_precedence, semantic_weight, text_weight, rrf_k)
        if rerank and self.scorers:
            found = self.reranked(query, found, limit)
        elif rerank:
            found = found.filter(F.col("rank") <= limit)
        extra = [c for c in ("score", "rank", "original_score", "precedence_boost", "rerank_score") if c in found.columns]
        return search.shaped(found, self.result_fields, self.config.defaults(), extra)

    def reranked(self, query: str, found: DataFrame, limit: int) -> DataFrame:
        """Scorers are asked in turn, each up to three times where it is rate-limited; where none gives an answer that can be read, the order stays as it is."""
        shown = [r.b for r in found.orderBy("rank").select(search.rerank_block(found, self.config.entity_names).alias("b")).collect()]
        for scorer in self.scorers:
            try:
                answer = with_waits(lambda q, ask=scorer: ask(q, shown), sleep=self.sleep)(query)
            except Exception:
                continue
            parsed = self.spark.createDataFrame([("0", answer)], "query_id string, answer string").select("query_id", search.parse_rerank_scores(F.col("answer")).alias("m"))
            if parsed.head().m is not None:
                return search.reranked(found, parsed.select("query_id", F.explode("m").alias("index", "rerank_score")), limit)
        return found.filter(F.col("rank") <= limit)

    sleep = staticmethod(time.sleep)

    def search_batch(self, query: str, entity: str, values: Sequence[str], mode: str = "hybrid", limit_per_entity: int = 3, document_type: str | None = None, apply_precedence: bool = True) -> DataFrame:
        """The best chunks of each of up to 40 values of an entity, or of any other valid filter, in one job; its column tells them apart. Summaries are included."""
        if entity not in self.config.valid_filters:
            raise InvalidRequest(f"'{entity}' is not a valid filter. Valid: {sorted(self.config.valid_filters)}")
        rows = filters.filtered(self.chunks, {"document_type": document_type}, self.config.valid_filters)
        if not query.strip() or not values:
            return rows.limit(0)
        rows = rows.filter(F.col(entity).isin(list(values)[:MOST_VALUES]))
        return self.found(rows, self._queries([query]), mode if mode in MODES else "hybrid", limit_per_entity, ("query_id", entity), apply_precedence, 0.5, None, search.RRF_K)

    def verify_absence(self, keywords: Sequence[str], limit: int = 3, entity: str | None = None, value: str | None = None) -> DataFrame:
        """Whether any of up to ten keywords occurs, with evidence: one row, none where nothing was found."""
        if entity is not None and self.config.entity(entity) is None:
            raise InvalidRequest(f"unknown entity {entity}")
        rows = self.chunks if entity is None else self.chunks.filter(F.col(entity) == value)
        words = [(str(i), i, k) for i, k in enumerate(list(keywords)[:MOST_KEYWORDS]) if k.strip()]
        queries = self.spark.createDataFrame(words, "query_id string, keyword_no int, keyword string")
        found = search.text_search(rows, queries.select("query_id", F.col("keyword").alias("query")), limit, self.index)
        return search.absence(found.join(queries, "query_id").withColumn("query_id", F.lit("0")), limit).drop("query_id")

    # -- listings --

    def list_entities(self, entity: str, **given: Any) -> DataFrame:
        names = self.config.entity_names
        if entity != "document_type" and entity not in names:
            raise InvalidRequest(f"unknown entity {entity}; known: {', '.join(names) or '(none)'}")
        usable = {k: v for k, v in given.items() if k in self.config.valid_filters and k in self.chunks.columns}
        return catalog.list_entities(filters.filtered(self.chunks, usable, self.config.valid_filters), entity, names)

    def list_document_types(self) -> DataFrame:
        return catalog.list_document_types(self.chunks)

    def get_sections(self, entity: str, value: str) -> DataFrame:
        if entity not in self.chunks.columns:
            raise InvalidRequest(f"unknown entity {entity}")
        return catalog.get_sections(self.chunks, entity, value, order=("chunk_id",))


def handle(engine: Engine, route: str, body: dict[str, Any] | None, key: str | None = None, api_key: str | None = None) -> tuple[int, Any]:
    """A request as (status, JSON value); the transport is not this library's part.

    401 without the key that is set, 400 for what cannot be read or does not exist, 404 for unknown routes.
    """
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    if route == "GET /health":
        return 200, {"status": "ok"}
    if api_key and key != api_key:
        return 401, {"error": "unauthorized"}
    if body is not None and not isinstance(body, dict):
        return 400, {"error": "the body must be an object"}
    body = dict(body or {})
    needed = {"POST /api/search": ["query"], "POST /api/search_batch": ["query", "entity_name", "entity_values"], "POST /api/verify_absence": ["keywords"], "GET /api/entities": ["entity_name"], "GET /api/document_types": []}
    if route not in needed:
        return 404, {"error": "no such route"}
    if missing := [k for k in needed[route] if not body.get(k)]:
        return 400, {"error": f"missing: {', '.join(missing)}"}
    try:
        if route == "POST /api/search":
            keep = ("mode", "limit", "apply_precedence", "rerank", "include_summaries")
            return 200, {"results": rows(engine.search(body["query"], **{k: body[k] for k in keep if k in body}, **(body.get("filters") or {})))}
        if route == "POST /api/search_batch":
            values = body["entity_values"]
            found = rows(engine.search_batch(body["query"], body["entity_name"], values, body.get("mode", "hybrid"), body.get("limit_per_entity", 3), body.get("document_type")))
            return 200, {"results": {v: [r for r in found if r[body["entity_name"]] == v] for v in values[:MOST_VALUES]}, "entities_searched": len(values)}
        if route == "POST /api/verify_absence":
            found = rows(engine.verify_absence(body["keywords"], body.get("limit", 3), body.get("entity_name"), body.get("entity_value")))
            return 200, found[0] if found else {"found": False, "keywords_matched": [], "evidence": []}
        if route == "GET /api/entities":
            return 200, {"entities": rows(engine.list_entities(body.pop("entity_name"), **body))}
        return 200, {"document_types": rows(engine.list_document_types())}
    except InvalidRequest as e:
        return 400, {"error": str(e)}
