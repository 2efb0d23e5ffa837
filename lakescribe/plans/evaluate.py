"""Retrieval quality of an engine over a data set of queries: all queries in one job, a report, and its file."""

from __future__ import annotations

import json
from datetime import datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation, search
from ..operators.enrich import with_waits
from ..sources.workspace import written
from .engine import MODES, RERANK_FETCH, Engine

METRICS = ("p_at_5", "p_at_10", "recall_at_10", "mrr", "ndcg_at_5")


def found_by(engine: Engine, queries: DataFrame, mode: str = "hybrid", limit: int = 10) -> DataFrame:
    """The results (query_id, rank, ...) of all of (query_id, query), without filters, so summaries are among them. A blank query has none."""
    asked = [r for r in queries.select("query_id", "query").collect() if (r.query or "").strip()]  # the stated query set
    vectors = engine.encode([f"search_query: {r.query}" for r in asked])
    rows = [(r.query_id, r.query, [float(x) for x in v]) for r, v in zip(asked, vectors)]
    frame = engine.spark.createDataFrame(rows, "query_id string, query string, query_vector array<float>")
    return engine.found(engine.chunks, frame, mode if mode in MODES else "hybrid", limit, ("query_id",))


def reranked(engine: Engine, found: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """``found`` ranked anew by the engine's scorers, query by query, with the new ranks: the search is run and what is shown is read once for all queries.

    The second scorer is asked where the first fails or cannot be read; a query that none answers keeps its order.
    """
    spark, found = engine.spark, written(found, "found")
    texts = {r.query_id: r.query or "" for r in queries.select("query_id", "query").collect()}  # the stated query set
    shown: dict[str, list[str]] = {}
    for r in found.select("query_id", "rank", search.rerank_block(found, engine.config.entity_names).alias("b")).orderBy("query_id", "rank").toLocalIterator():
        shown.setdefault(r.query_id, []).append(r.b)
    scores: list[tuple] = []
    for scorer in engine.scorers:
        answers = []
        for q, blocks in shown.items():
            try:
                answers.append((q, with_waits(lambda text, own=blocks: scorer(text, own), sleep=engine.sleep)(texts.get(q, ""))))
            except Exception:  # another scorer is asked, or the order stays
                continue
        parsed = spark.createDataFrame(answers, "query_id string, answer string").select("query_id", search.parse_rerank_scores(F.col("answer")).alias("m"))
        read = [(r.query_id, r.m) for r in parsed.filter("m IS NOT NULL").collect()]
        scores += [(q, k, v) for q, m in read for k, v in m.items()]
        shown = {q: b for q, b in shown.items() if q not in dict(read)}
    first = found.filter(F.col("rank") <= limit)
    if not scores:
        return first
    scored = spark.createDataFrame(scores, "query_id string, index int, rerank_score double")
    asked = scored.select("query_id").distinct()
    anew = search.reranked(found.join(asked, "query_id", "left_semi"), scored, limit)
    return anew.withColumn("rank", F.col("position")).select(*found.columns).unionByName(first.join(asked, "query_id", "left_anti").select(*found.columns))


def evaluate(engine: Engine, queries: DataFrame, mode: str = "hybrid", limit: int = 10, rerank: bool = False) -> DataFrame:
    """Per query: its fields, the metrics and n_results. With ``rerank`` four times as many results are fetched and each query's are ranked anew by the engine's scorers.

    A query that fails counts as one without results.
    """
    found = found_by(engine, queries, mode, limit * RERANK_FETCH if rerank else limit)
    if rerank:
        found = reranked(engine, found, queries, limit)
    names = engine.config.entity_names
    scores = evaluation.metrics(found, queries, [*names, *evaluation.ENTITY_COLUMNS])
    counted = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_results"))
    shown = queries.select("query_id", "query", "category", "difficulty")
    return shown.join(scores, "query_id").join(counted, "query_id", "left").withColumn("n_results", F.coalesce("n_results", F.lit(0)))


def report(per_query: DataFrame, mode: str = "hybrid", limit: int = 10, rerank: bool = False, provider: str | None = None) -> dict[str, Any]:
    """The averages over the queries, 0 without any, and each query's numbers."""
    rows = [r.asDict() for r in per_query.orderBy("query_id").collect()]
    n = len(rows) or 1
    details = [{"id": r["query_id"], **{k: r[k] for k in ("query", "category", "difficulty", *METRICS, "n_results")}} for r in rows]
    averages = {f"avg_{m}": sum(r[m] for r in rows) / n for m in METRICS}
    return {"mode": mode, "limit": limit, "rerank": rerank, "rerank_provider": provider if rerank else None, "n_queries": len(rows), **averages, "per_query": details}


def save_report(values: dict[str, Any], label: str, folder: str) -> Path:
    """Writes a report as ``label``_YYYYMMDD_HHMMSS.json (local time) into a folder of the driver."""
    place = Path(folder)
    place.mkdir(parents=True, exist_ok=True)
    path = place / f"{label}_{datetime.now().strftime('%Y%m%d_%H%M%S')}.json"
    path.write_text(json.dumps(values, ensure_ascii=False, indent=2), encoding="utf-8")
    return path
