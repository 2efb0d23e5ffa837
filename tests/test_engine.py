"""Configuration, engine, requests, enrichment, files and streams."""

import json

import pytest
from pyspark.sql import functions as F

from lakescribe.config import ConfigError, interpolated, load_config, parse_config, strip_fences
from lakescribe.operators import enrich, filters, layout, manifest, search
from lakescribe.operators.chunking import process_documents
from lakescribe.plans.engine import Engine, InvalidRequest, handle
from lakescribe.sources import files, pdf
from lakescribe.streaming.ingest import ingest, stream_markdown
from tests.oracle import session

RAW = {
    "project": {"name": "Cities", "description": "Reports", "table_name": "chunks"},
    "entities": [{"name": "city", "extract_from": "filename", "pattern": "^([A-Za-z]+)_"}, {"name": "region", "extract_from": "mapping", "mapping_source": "city", "mapping": {"Boston": "northeast", "Miami": "southeast"}}],
    "document_types": [{"name": "report", "directory": "reports", "precedence_boost": 1.1}, {"name": "memo", "precedence_boost": 1.0}],
    "custom_fields": [{"name": "year", "extract_from": "filename", "pattern": r"_(20\d{2})"}, {"name": "reviewed", "type": "bool", "extract_from": "content", "pattern": "REVIEWED"}],
    "filters": ["city", "region"],
    "skip_sections": {"exact": ["Contents"], "prefix": ["List of "]},
}


@pytest.fixture(scope="module")
def spark():
    return session()


@pytest.fixture(scope="module")
def config():
    return parse_config(RAW)


@pytest.fixture(scope="module")
def engine(spark, config):
    texts = [
        ("floods in the harbour of the city", "Boston", "report", False), ("harbour walls against floods", "Boston", "memo", False), ("beaches and hotels", "Miami", "report", False), ("hotels near the harbour", "Miami", "memo", False),
        ("a summary about floods", "Boston", "report", True), ("floods in the harbour of the city", "Boston", "memo", False), ("nothing of note", None, "memo", False),
    ]
    rows = [(i, t, f"s{i % 3}", i, "f.md", k, c, {"Boston": "northeast", "Miami": "southeast"}.get(c), s) for i, (t, c, k, s) in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string, section_title string, chunk_index int, source_file string, document_type string, city string, region string, is_summary boolean")
    return Engine(enrich.embedded(chunks).cache(), config, scorer=lambda q, blocks: json.dumps([{"index": len(blocks) - 1, "score": 9}]))


def test_config_errors(tmp_path):
    for raw in ("x", {}, {"project": 3}, {"project": {"table_name": "t"}}, {"project": {"name": "n"}}):
        with pytest.raises(ConfigError):
            parse_config(raw)
    with pytest.raises(ConfigError):
        load_config(str(tmp_path / "none.yaml"))
    (tmp_path / "c.yaml").write_text("project: {name: n, table_name: t}\nentities:\n  - {name: year, pattern: \"_(20\\\\d{2})_\"}\n")
    assert load_config(str(tmp_path / "c.yaml")).entities[0].pattern == r"_(20\d{2})_"


def test_extraction(spark, config):
    rows = spark.createDataFrame([("Boston_2024_x.md", "report", "REVIEWED"), ("Unknown.md", "report", "")], "source_file string, document_type string, text string")
    got = config.extracted(rows).collect()
    assert [(r.city, r.region, r.year, r.reviewed) for r in got] == [("Boston", "northeast", "2024", None), (None, None, None, None)]
    assert config.extracted(rows, content="text").collect()[0].reviewed == "REVIEWED"
    assert config.boosts == {"report": 1.1, "memo": 1.0} and config.directories == {"report": "reports"} and {"city", "is_summary"} <= config.valid_filters


def test_text_helpers(config):
    assert strip_fences("a\n```yaml\nx: 1\n```\nb") == strip_fences("```\nx: 1\n```") == strip_fences(" x: 1 ") == "x: 1"
    assert interpolated("{project_name}: {entity_names}; {document_types}", config) == "Cities: city, region; - report\n- memo"
    assert "(none)" in interpolated("{entity_names}", parse_config({"project": {"name": "n", "table_name": "t"}})) and "Cities" in interpolated("", config)


def test_filters(spark):
    rows = spark.createDataFrame([("O'Hare", True, 1), ("x", False, 2)], "city string, ok boolean, n int")
    f = lambda **k: [r.n for r in filters.filtered(rows, k, {"city", "ok", "n"}).collect()]
    assert f(city="O'Hare") == [1] and f(ok=False) == [2] and f(city=None, other="y") == [1, 2] and f(n=2) == [2] and f(city="x", ok=True) == []
    assert filters.predicate({"n": 2}, {"n"}, ["n"], strict_parity=True) is None


def test_search_modes(engine):
    for mode in ("semantic", "fts", "hybrid", "other"):
        rows = engine.search("floods harbour", mode=mode, limit=3).collect()
        assert 0 < len(rows) <= 3 and sorted(r["rank"] for r in rows) == list(range(1, len(rows) + 1)) and not any(r.is_summary for r in rows)
        assert {r.chunk_id for r in engine.search("floods harbour", mode=mode, limit=3, city="Miami").collect()} <= {2, 3}
    hybrid = engine.search("floods harbour", limit=6).collect()
    assert len({r.text[:200] + (r.city or "") for r in hybrid}) == len(hybrid)  # equal texts of one entity are one result
    assert engine.search(" ").count() == 0
    assert any(r.text.startswith("[RESUMEN IA] ") for r in engine.search("summary floods", include_summaries=True).collect())
    with pytest.raises(InvalidRequest):
        engine.search("x", colour="red")


def test_boost_and_rerank(engine):
    rows = engine.search("floods harbour", mode="fts", limit=5).collect()
    assert all(r.score == pytest.approx(r.original_score * r.precedence_boost, abs=1e-6) for r in rows)
    assert engine.search("floods harbour", mode="fts", limit=2, rerank=True).orderBy(F.desc("rerank_score")).head().rerank_score == 9


def test_batch_listing_absence(engine):
    got = engine.search_batch("harbour", "city", ["Boston", "Miami", "Nowhere"], limit_per_entity=1).collect()
    assert sorted(r.city for r in got) == ["Boston", "Miami"]
    assert [(r.city, r.region, r.document_types) for r in engine.list_entities("city").collect()] == [("Boston", "northeast", ["memo", "report"]), ("Miami", "southeast", ["memo", "report"])]
    assert [(r.document_type, r["count"]) for r in engine.list_document_types().collect()] == [("memo", 4), ("report", 3)]
    assert [r.section_title for r in engine.get_sections("city", "Boston").collect()] == ["s0", "s1", "s2"]
    row = engine.verify_absence(["floods", "unicorns"]).head()
    assert row.found and row.keywords_matched == ["floods"] and 1 <= len(row.evidence) <= 3
    assert engine.verify_absence(["unicorns"]).count() == 0


def test_requests(engine):
    assert handle(engine, "GET /health", None)[0] == 200
    assert handle(engine, "POST /api/search", {"query": "x"}, api_key="k")[0] == 401
    assert handle(engine, "POST /api/search", {})[0] == 400 and handle(engine, "POST /api/search", [])[0] == 400
    assert handle(engine, "POST /api/search", {"query": "x", "filters": {"bad": "1"}})[0] == 400 and handle(engine, "GET /none", None)[0] == 404
    status, body = handle(engine, "POST /api/search_batch", {"query": "harbour", "entity_name": "city", "entity_values": ["Boston", "Nowhere"]})
    assert status == 200 and body["entities_searched"] == 2 and body["results"]["Nowhere"] == []
    assert handle(engine, "POST /api/verify_absence", {"keywords": ["unicorns"]})[1] == {"found": False, "keywords_matched": [], "evidence": []}
    assert len(handle(engine, "GET /api/entities", {"entity_name": "city"})[1]["entities"]) == 2 and handle(engine, "GET /api/document_types", None)[0] == 200


def test_rerank_answers(spark):
    texts = ['[{"index": 0, "score": 8}, {"index": 1, "score": 5}]', 'Here: [{"index":0,"score":7}] done', '[{"index":0,"score":8},{"index":1,"sc', "none", '[{"index":0,"score":8},{', '[{"index":0,"score":8}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.m for r in rows.select("i", search.parse_rerank_scores(F.col("t")).alias("m")).orderBy("i").collect()]
    assert got[0] == {0: 8, 1: 5} and got[1] == {0: 7} and got[3] is None and got[4] == {0: 8} and got[5] == {0: 8}


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([(0, 1, "x", 0.9, 1), (0, 2, "y", 0.8, 2), (0, 3, "x", 0.7, 3)], "query_id int, chunk_id int, text string, score double, rank int")
    b = spark.createDataFrame([(0, 2, "y", 1.0, 1), (0, 4, "z", 0.5, 2)], "query_id int, chunk_id int, text string, score double, rank int")
    got = {r.text: r for r in search.fuse(a, b, [F.col("text")], 5, 0.3).collect()}
    swapped = {r.text: r for r in search.fuse(b, a, [F.col("text")], 5, 0.7).collect()}
    assert {k: r.score for k, r in got.items()} == pytest.approx({k: r.score for k, r in swapped.items()})
    assert got["x"].chunk_id == 3 and got["y"].chunk_id == 2  # the semantic row of the largest rank


def test_enrichment(spark):
    rows = spark.createDataFrame([("d", "a.md", "s", 0, "t " * 150), ("d", "a.md", "s", 1, "u"), ("d", "b.md", "", 0, "short")], "document_type string, source_file string, section_title string, chunk_index int, text string")
    cache = spark.createDataFrame([], "key string, value string")
    asked, cache2 = enrich.summary_chunks(rows, lambda p: "A summary.", cache)
    assert [(r.text, r.chunk_index, r.is_summary, r.content_type) for r in asked.collect()] == [("A summary.", -1, True, "summary")] and cache2.count() == 1

    def fails(prompt):
        raise RuntimeError

    done, cache3 = enrich.with_contexts(rows, rows.groupBy("document_type", "source_file").agg(F.first("text").alias("text")), fails, cache2)
    assert {r.context for r in done.collect()} <= {"", "A summary."} and cache3.count() == 1


def test_files_manifest_and_stream(spark, tmp_path):
    docs = tmp_path / "reports"
    docs.mkdir()
    body = "Words of the text. " * 60
    (docs / "Boston_1.md").write_text(f"## One\n\n{body}")
    (docs / "Miami_2.md").write_text(f"## Two\n\n{body}")
    (docs / "skip.txt").write_text("x")
    where = {"report": f"file://{docs}", "memo": f"file://{tmp_path}/none"}
    scanned = files.scan_markdown(spark, where)
    assert sorted(r.source_file for r in scanned.collect()) == ["Boston_1.md", "Miami_2.md"]
    facts = files.scan_fingerprints(spark, where)
    chunks = process_documents(scanned)
    stored = manifest.counted_manifest(facts, chunks)
    assert {r.key: r.chunk_count for r in stored.collect()} == {"report/Boston_1.md": 1, "report/Miami_2.md": 1}
    stored.write.parquet(f"{tmp_path}/manifest")
    files.write_chunks(chunks, f"{tmp_path}/chunks")
    (docs / "Boston_1.md").write_text(f"## Changed\n\n{body}")
    (docs / "Miami_2.md").unlink()
    (docs / "New_3.md").write_text(f"## Three\n\n{body}")
    changes = manifest.diff_files(files.scan_fingerprints(spark, where), manifest.read_manifest(spark, f"{tmp_path}/manifest"))
    assert {r.key.split("/")[1]: r.status for r in changes.collect()} == {"Boston_1.md": "modified", "Miami_2.md": "deleted", "New_3.md": "new"}
    assert manifest.read_manifest(spark, f"{tmp_path}/nothing").count() == 0
    query = ingest(stream_markdown(spark, f"file://{docs}", "report"), f"file://{tmp_path}/table", f"file://{tmp_path}/check")
    query.awaitTermination(120)
    assert {r.section_title for r in spark.read.parquet(f"{tmp_path}/table").collect()} == {"Changed", "Three"}
    assert files.exists(spark, f"file://{tmp_path}/chunks/document_type=report")


def test_layout_and_pdf_stage(spark):
    table = [["a", None], ["b", "c"], ["", "d"]]
    rows = spark.createDataFrame([(table,), ([["a"]],), ([["", ""], ["", "x"]],)], "rows array<array<string>>")
    assert [r[0] for r in rows.select(layout.is_table(F.col("rows"))).collect()] == [True, False, True]
    text = spark.createDataFrame([("ANEJO 1. Maps",), ("Los anexos",), ("APÉNDICE",), ("Anexionar",)], "t string")
    assert [r[0] for r in text.select(layout.section_type(F.col("t"))).collect()] == ["anejo", "anexo", "apendice", "main"]
    found = spark.createDataFrame([("/x/a.pdf", bytearray(b"one")), ("/x/b.pdf", bytearray(b""))], "path string, content binary")

    def extractor(content):
        if not content:
            raise ValueError("empty")
        yield {"page": 1, "text": content.decode(), "font_size": 10.0}

    got = {r.doc: r for r in pdf.extract_spans(found, extractor).collect()}
    assert got["a"].text == "one" and got["a"].error is None and got["b"].error == "ValueError: empty"
