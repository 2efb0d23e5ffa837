"""Page stage, batches, reindexing, evaluation reports, stored indexes and the messages that scorers and servers get."""

import json

import pytest
from pyspark.sql import functions as F

from lakescribe.config import ConfigError, interpolated, parse_config
from lakescribe.operators import enrich, manifest, pages, search
from lakescribe.plans import analyse, evaluate, reindex
from lakescribe.plans.engine import Engine, InvalidRequest
from lakescribe.sources import files, workspace
from lakescribe.sources import pages as source
from tests.oracle import session
from tests.test_engine import RAW


@pytest.fixture(scope="module")
def spark():
    return session()


BOX = {"x0": 0.0, "y0": 0.0, "x1": 50.0, "y1": 50.0}


def read_pdf(content):
    """A stand-in for a PDF library: each line of the file is a page as JSON."""
    for line in content.decode().splitlines():
        page = json.loads(line)
        if page.get("broken"):
            raise ValueError("broken page")
        for image in page.get("images", []):
            image["data"] = b"png"
        yield page


def span(text, y, size=10.0):
    return {"text": text, "x0": 0.0, "y0": y, "x1": 40.0, "y1": y + 10, "font_size": size, "is_bold": False, "is_italic": False}


TABLE = {"bbox": BOX, "header": None, "rows": [["a", None], ["1", "2"]]}
FIRST = [
    {"width": 100.0, "height": 100.0, "text": "a long native text", "spans": [span("caption", 55.0), span("far", 190.0)], "bordered": [TABLE], "borderless": [TABLE], "image_boxes": [BOX],
     "images": [{"xref": 1, "width": 200, "height": 200, "format": "png", "is_chart": True}, {"xref": 2, "width": 20, "height": 200, "format": "png"}, {"xref": 3, "width": 100, "height": 100, "format": "jpg"}]},
    {"width": 100.0, "height": 100.0, "text": "", "picture": None, "image_boxes": [{**BOX, "x1": 100.0, "y1": 100.0}], "images": [{"xref": 4, "width": 500, "height": 500, "format": "png"}], "borderless": [TABLE, {**TABLE, "rows": [["x"]]}]},
    {"width": 100.0, "height": 100.0, "text": " "},
]


@pytest.fixture(scope="module")
def pdfs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pdfs")
    (folder / "one.pdf").write_text("\n".join(map(json.dumps, FIRST)))
    (folder / "two.pdf").write_text(json.dumps({"text": "only page here", "width": 1.0, "height": 1.0}) + "\n" + json.dumps({"broken": True}))
    return spark.read.format("binaryFile").load(f"file://{folder}").select("path", "content")


def test_pages(spark, pdfs):
    rows = workspace.written(source.extract_pages(pdfs, read_pdf), "pages")
    bad = rows.filter("error IS NOT NULL").collect()
    assert [(r.doc, r.page, r.error) for r in bad] == [("two", 0, "ValueError: broken page")] and rows.filter("doc = 'two' AND page = 1").count() == 1
    one = pages.analysed(rows.filter("doc = 'one'"))
    assert [r.page_type for r in one.orderBy("page").collect()] == ["native_text", "scanned", "empty"]
    assert [r.page for r in pages.pages_of_type(one, "scanned").collect()] == [2] and pages.type_counts(one).count() == 3
    t = {(r.page, r.table_index): r for r in pages.tables(one).collect()}
    assert set(t) == {(1, 0), (2, 0)} and not t[1, 0].is_borderless and t[2, 0].is_borderless and t[1, 0].header_names == ["a", ""] and t[1, 0].row_count == 2 and t[1, 0].col_count == 2
    assert pages.tables(one, try_borderless=False).count() == 1
    images = pages.images(one)
    got = {(r.page, r.image_index): r for r in images.collect()}
    assert set(got) == {(1, 0), (1, 2), (2, 0)} and got[1, 0].nearby_text == "caption" and got[1, 2].nearby_text == "" and got[1, 2].bbox.x1 == 0
    assert [r.image_index for r in pages.images(one, charts_only=True).collect()] == [0]
    assert [tuple(r) for r in pages.counts(pages.tables(one), images).collect()] == [("one", 2, 3, 1)]

    words = source.recognised(one, lambda picture, language: [("hola", 90.0), ("mundo", -1.0)])
    done = {r.page: r for r in pages.processed(one, words).collect()}
    assert done[2].text == "hola mundo" and done[2].ocr_applied and done[2].confidence == pytest.approx(0.9) and done[1].text == "a long native text" and done[3].text == ""

    def fails(picture, language):
        raise RuntimeError

    assert {r.page: r.text for r in pages.processed(one, source.recognised(one, fails)).collect()}[2] == ""
    spans = one.select("doc", "page", F.posexplode("spans").alias("seq", "s")).select("doc", "page", "seq", "s.*").withColumn("heading_level", F.when(F.col("text") == "far", 2).otherwise(0))
    spans = spans.withColumn("text", F.when(F.col("text") == "far", " ANEXO II ").otherwise(F.concat(F.lit("ver anexo "), "text")))
    markers = pages.section_markers(spans, appendices_only=True)
    assert [(r.section_type, r.title) for r in markers.collect()] == [("anexo", "ANEXO II")] and pages.section_markers(spans).count() == 1
    lines = spark.createDataFrame([("one", "ANEXO II"), ("one", "plain"), ("two", "II"), ("one", "Special")], "doc string, text string")
    extra = markers.unionByName(markers.withColumn("title", F.lit("Special")))
    assert {r.text for r in pages.marked_headings(lines, extra).filter("is_appendix").collect()} == {"ANEXO II", "Special"}
    out = json.loads(pages.document_json(one, pages.tables(one), images, markers).head().json)
    assert out["statistics"] == {"text_blocks": 2, "tables": 2, "images": 3, "sections": 1, "scanned_pages": 1, "native_pages": 1, "processing_time_seconds": 0.0}
    assert [x["id"] for x in out["tables"]] == ["p1_t0", "p2_t0"] and out["images"][0]["filename"] == "one_p1_i0.png" and out["metadata"]["parser_version"] == "1.0.0"


def test_batches_go_on_where_they_stopped(spark, pdfs, tmp_path):
    store, calls = f"file://{tmp_path}/batch", spark.sparkContext.accumulator(0)

    def counted(content):
        calls.add(1)
        return read_pdf(content)

    numbers = source.process_batch(spark, pdfs, store, counted, per_run=1).head()
    assert (numbers.total, numbers.completed, numbers.failed, numbers.pending) == (2, 1, 1, 0) and [v for v in numbers.failures.values()] == ["ValueError: broken page"]
    assert source.batch_pages(spark, store).filter("page > 0").count() == 4
    before = calls.value
    source.process_batch(spark, pdfs, store, counted).head()
    assert calls.value == before and source.pending(pdfs, source.batch_state(spark, store)).count() == 0
    state = source.batch_state(spark, store)
    assert sorted(map(tuple, source.state_from_json(source.state_json(state)).collect())) == sorted(map(tuple, state.collect()))
    source.process_batch(spark, pdfs, store, counted, resume=False).head()
    assert calls.value > before and source.batch_state(spark, store).count() == 2


def test_a_batch_goes_on_behind_the_last_committed_page(spark, tmp_path, monkeypatch):
    from lakescribe.sources import snapshots

    (tmp_path / "in").mkdir()
    for name, n in (("b", 7), ("c", 2)):
        (tmp_path / "in" / f"{name}.pdf").write_text(str(n))
    store = f"file://{tmp_path}/store"
    seen = spark.sparkContext.accumulator(0)

    def extractor(content, first):
        for k in range(first, int(content) + 1):
            seen.add(1)
            yield {"text": f"page {k}"}

    files_ = lambda: spark.read.format("binaryFile").load(f"file://{tmp_path}/in/*.pdf")
    real, calls = snapshots.publish, []

    def once(*a):
        calls.append(a)
        if len(calls) > 1:
            raise KeyboardInterrupt
        return real(*a)

    monkeypatch.setattr(snapshots, "publish", once)
    with pytest.raises(KeyboardInterrupt):
        source.process_batch(spark, files_(), store, extractor, step=3)
    monkeypatch.undo()
    assert {(r.path[-5:], r.status, r.pages) for r in source.batch_progress(spark, store).collect()} == {("b.pdf", "partial", 3), ("c.pdf", "completed", 2)}
    (tmp_path / "in" / "a.pdf").write_text("1")
    (tmp_path / "in" / "d.pdf").write_text("broken")
    before = seen.value
    numbers = source.process_batch(spark, files_(), store, extractor, step=3, per_run=2).head()
    assert (numbers.total, numbers.completed, numbers.failed, numbers.pending) == (4, 3, 1, 0) and seen.value - before == 4 + 1  # pages 4 to 7 of b, page 1 of a
    pages_ = sorted((r.doc, r.page, r.text) for r in source.batch_pages(spark, store).filter("page > 0").collect())
    assert pages_ == [("a", 1, "page 1"), *[("b", k, f"page {k}") for k in range(1, 8)], ("c", 1, "page 1"), ("c", 2, "page 2")]
    assert source.batch_pages(spark, store).filter("page = 0").head().doc == "d"
    loaded = source._loaded(files_(), [f"file:{tmp_path}/in/a.pdf"])
    assert len(loaded.inputFiles()) == 1


def test_reindex(spark, tmp_path):
    docs, base = tmp_path / "reports", f"file://{tmp_path}/store"
    docs.mkdir()
    words = " ".join(["flood"] * 120)
    for name in ("Boston_2024_a.md", "Miami_2023_b.md"):
        (docs / name).write_text(f"# Title\n\n## Part\n\n{words} {name}\n")
    config, where = parse_config(RAW), {"report": f"file://{docs}", "memo": f"file://{tmp_path}/none"}
    assert reindex.run(spark, config, base, directories=where, dry_run=True) == reindex.Report(2, 0, 0, False)
    assert not files.exists(spark, f"{base}/chunks")
    first = reindex.incremental(spark, config, base, where)
    assert (first.new, first.applied, first.files) == (2, True, 2)
    stored = reindex.stored_manifest(spark, f"{base}/chunks")
    assert {r.key: r.chunk_count > 0 for r in stored.collect()} == {"report/Boston_2024_a.md": True, "report/Miami_2023_b.md": True}
    assert not reindex.incremental(spark, config, base, where).applied  # nothing has changed
    (docs / "Boston_2024_a.md").unlink()
    (docs / "Miami_2023_b.md").write_text(f"# Title\n\n## Part\n\n{words} drought {words}\n")
    import os

    os.utime(docs / "Miami_2023_b.md", (1, 1))
    again = reindex.incremental(spark, config, base, where)
    assert (again.new, again.modified, again.deleted) == (0, 1, 1)
    engine = Engine.open(spark, base, config=config)
    assert {r.source_file for r in engine.chunks.select("source_file").collect()} == {"Miami_2023_b.md"}
    assert engine.search("drought", mode="fts").count() >= 1 and engine.search("drought", mode="fts", city="Boston").count() == 0
    whole = reindex.run(spark, config, base, full_run=True, dry_run=True, directories=where)
    assert whole.applied and whole.files == 1 and whole.chunks == again.chunks
    (docs / "Miami_2023_b.md").unlink()
    assert reindex.incremental(spark, config, base, where).chunks == 0  # a type without files loses its partition


def test_a_model_is_asked_once_per_key(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def model(prompt):
        calls.add(1)
        return f"answer {len(prompt)}"

    rows = spark.createDataFrame([("one",), ("two",), ("one",)], "text string")
    done, cache = enrich.answered(rows, model, F.col("text"), spark.createDataFrame([], manifest.CACHE))
    assert done.count() == 3 and done.count() == 3 and cache.count() == 2 and calls.value == 2
    path = f"file://{tmp_path}/cache"
    assert manifest.read_cache(spark, path).count() == 0
    manifest.write_cache(cache, path)
    hits, misses = manifest.cached(rows, manifest.read_cache(spark, path))
    assert hits.count() == 3 and misses.count() == 0
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "x.parquet").write_text("no parquet")
    assert manifest.read_cache(spark, f"file://{tmp_path}/broken").count() == 0


def test_waits_where_a_model_is_rate_limited():
    waits, answers = [], iter([RuntimeError("429 slow down"), RuntimeError("error 429"), "ok"])

    def model(prompt):
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    assert enrich.with_waits(model, sleep=waits.append)("q") == "ok" and waits == [5, 10]
    answers = iter([RuntimeError("other")])
    with pytest.raises(RuntimeError):
        enrich.with_waits(model, sleep=waits.append)("q")


def chunk_table(spark):
    rows = [(i, f"{w} text {i}", "Intro" if i else None, i, "f.md", "report" if i % 2 else "memo", "Boston" if i < 3 else "Miami", False) for i, w in enumerate(["flood", "flood", "beach", "flood", "hotel"])]
    return enrich.embedded(spark.createDataFrame(rows, "chunk_id long, text string, section_title string, chunk_index int, source_file string, document_type string, city string, is_summary boolean"))


def test_engine_without_a_configuration_and_with_scorers(spark):
    chunks = workspace.written(chunk_table(spark), "chunks")
    plain = Engine(chunks)
    assert plain.search("flood", mode="fts").columns[2:11] == ["text", "context", "section_title", "content_type", "has_quantitative_data", "document_type", "page_start", "page_end", "is_summary"]
    with pytest.raises(InvalidRequest):
        plain.search("flood", city="Boston")
    seen = []

    def bad(query, blocks):
        raise RuntimeError("no")

    def good(query, blocks):
        seen.extend(blocks)
        return json.dumps([{"index": 1, "score": 9}])

    engine = Engine(chunks, parse_config(RAW), scorer=bad, second_scorer=good)
    rows = engine.search("flood", mode="fts", limit=2, rerank=True, apply_precedence=False).collect()
    assert sorted(r.rerank_score for r in rows) == [0.0, 9.0] and all("Tipo: " in b and "Sección: " in b and "city: Boston" in b or "city: Miami" in b for b in seen)
    assert any("region: N/A" in b for b in seen) and any("Sección: Intro" in b for b in seen)
    by_type = engine.search_batch("flood", "document_type", ["report", "memo"], mode="fts").collect()
    assert {r.document_type for r in by_type} == {"report", "memo"}
    with pytest.raises(InvalidRequest, match="not a valid filter"):
        engine.search_batch("flood", "nothing", ["x"])


def test_stored_index_is_rebuilt_and_ranks_alike(spark, tmp_path):
    chunks = workspace.written(chunk_table(spark), "chunks")
    n, sanity = search.rebuild_index(chunks, f"file://{tmp_path}/fts", sanity="beach")
    assert n == 5 and [r.chunk_id for r in sanity.collect()] == [2]
    queries = spark.createDataFrame([("a", "flood text")], "query_id string, query string")
    one, two = (sorted((r.chunk_id, r.rank, round(r.score, 9)) for r in search.text_search(chunks, queries, 4, i).collect()) for i in (None, search.open_index(spark, f"file://{tmp_path}/fts")))
    assert one == two and len(one) == 4
    with pytest.raises(ValueError):
        search.rebuild_index(chunks.limit(0), f"file://{tmp_path}/none")


def test_vector_queries_go_in_blocks(spark):
    chunks = workspace.written(chunk_table(spark), "chunks").select("chunk_id", "vector")
    queries = chunks.select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query_vector"))
    one, many = (sorted((r.query_id, r.chunk_id, r.rank) for r in search.vector_search(chunks, queries, 2, block_bytes=b).collect()) for b in (1 << 20, 600))
    assert one == many and len(one) == 10


def test_instructions_and_defaults():
    config = parse_config(RAW)
    assert interpolated("{entity_count} {filter_list}", config) == "2 " + ", ".join(sorted(config.valid_filters))
    assert interpolated("", config) == "RAG server for Cities. Reports\n\nAvailable filters: " + ", ".join(sorted(config.valid_filters)) + "\n\nDocument types:\n- report\n- memo"
    assert config.defaults()["document_type"] == "unknown" and config.defaults()["reviewed"] is False


def test_evaluation_report(spark, tmp_path):
    engine = Engine(workspace.written(chunk_table(spark), "chunks"), parse_config(RAW), scorer=lambda q, b: "[]")
    schema = "query_id string, query string, category string, difficulty string, expected_document_types array<string>, expected_entities array<string>"
    queries = spark.createDataFrame([("1", "flood", "c", "easy", ["report"], ["Boston"]), ("2", " ", "c", "hard", ["memo"], [])], schema)
    per_query = evaluate.evaluate(engine, queries, mode="fts")
    values = evaluate.report(per_query, "fts")
    by = {q["id"]: q for q in values["per_query"]}
    assert values["n_queries"] == 2 and by["1"]["n_results"] == 3 and by["1"]["mrr"] > 0 and by["2"]["n_results"] == 0 and values["avg_mrr"] == by["1"]["mrr"] / 2
    path = evaluate.save_report(values, "run", str(tmp_path / "r"))
    assert json.loads(path.read_text())["mode"] == "fts" and path.name.startswith("run_20")
    assert evaluate.evaluate(engine, queries, mode="fts", limit=2, rerank=True).count() == 2


def test_a_configuration_is_proposed(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "b.md").write_bytes(b"bad \xff byte")
    (tmp_path / "docs" / "a.md").write_text("word " * 2500)
    sample = files.sample_directory(spark, f"file://{tmp_path}/docs").orderBy("file_name").collect()
    assert sample[0].text.endswith("\n[... truncated]") and "�" in sample[1].text and sample[0].directory == "docs"
    asked = []
    text = analyse.propose_config(spark, [f"file://{tmp_path}/docs"], lambda p: asked.append(p) or "```yaml\nproject: {name: x}\n```", str(tmp_path / "c.yaml"))
    assert text == "project: {name: x}" and (tmp_path / "c.yaml").read_text() == text and "a.md" in asked[0]
    for directories, answer in ((["file:///none"], "x"), ([f"file://{tmp_path}/docs"], "a: [")):
        with pytest.raises(ConfigError):
            analyse.propose_config(spark, directories, lambda p, a=answer: a)


def test_append_aligns_columns_by_name(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    spark.createDataFrame([("a", 1, "t")], "text string, n int, document_type string").write.partitionBy("document_type").parquet(path)
    files.append_chunks(spark.createDataFrame([("u", "b")], "document_type string, text string"), path)
    assert sorted(((r.text, r.n, r.document_type) for r in spark.read.parquet(path).collect())) == [("a", 1, "t"), ("b", None, "u")]
    with pytest.raises(ValueError):
        files.append_chunks(spark.createDataFrame([("u", "b")], "document_type string, other string"), path)


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    import sys
    import types

    import yaml

    from lakescribe.__main__ import main

    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "Boston_1.md").write_text("## Part\n\n" + "inundaciones en la ciudad " * 60)
    raw = {**RAW, "document_types": [{"name": "report", "directory": f"file://{tmp_path}/docs"}]}
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(raw))
    common = ["--config", str(tmp_path / "c.yaml"), "--base", f"file://{tmp_path}/store"]
    assert main(["reindex", *common, "--dry-run"], spark) == 0 and "new=1" in capsys.readouterr().out
    assert main(["reindex", *common], spark) == 0 and "applied=True" in capsys.readouterr().out
    assert main(["rebuild-index", *common], spark) == 0 and "1 found" in capsys.readouterr().out
    (tmp_path / "q.json").write_text(json.dumps({"queries": [{"id": "1", "query": "inundaciones", "category": "c", "difficulty": "d", "expected_document_types": ["report"], "expected_entities": ["Boston"]}]}))
    assert main(["evaluate", str(tmp_path / "q.json"), *common, "--mode", "fts", "--output", str(tmp_path / "out")], spark) == 0
    assert '"avg_mrr": 1.0' in capsys.readouterr().out and list((tmp_path / "out").iterdir())
    asked = []
    module = types.ModuleType("own_scorers")
    module.score = lambda query, shown: asked.append(query) or json.dumps([{"index": 0, "score": 5}])
    module.model = lambda prompt: "```yaml\nproject: {name: p}\n```" if "Boston_1.md" in prompt else "no"
    monkeypatch.setitem(sys.modules, "own_scorers", module)
    assert main(["evaluate", str(tmp_path / "q.json"), *common, "--mode", "fts", "--output", str(tmp_path / "out"), "--rerank", "own_scorers:score"], spark) == 0
    assert '"rerank": true' in capsys.readouterr().out and asked == ["inundaciones"]
    assert main(["propose-config", f"file://{tmp_path}/docs", "--model", "own_scorers:model", "--output", str(tmp_path / "p.yaml")], spark) == 0 and "name: p" in (tmp_path / "p.yaml").read_text()
    assert main(["compact", *common, "--vacuum"], spark) == 0 and "version" in capsys.readouterr().out
    assert main(["reindex", "--config", str(tmp_path / "none.yaml")], spark) == 1


def test_an_encoder_sees_so_many_tokens_and_gives_unit_vectors():
    import types

    import numpy as np
    from tokenizers import Tokenizer, models, pre_tokenizers

    tokenizer = Tokenizer(models.WordLevel({"[UNK]": 0, "a": 1, "b": 2}, unk_token="[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    seen = []

    class Session:
        def get_inputs(self):
            return [types.SimpleNamespace(name=n) for n in ("input_ids", "attention_mask")]

        def run(self, _, inputs):
            seen.append({k: v.shape for k, v in inputs.items()})
            return [np.eye(3, dtype=np.float32)[inputs["input_ids"]]]

    vectors = enrich.pooled_encoder(Session(), tokenizer)(["a " * 5000, "b a"])
    assert seen == [{"input_ids": (2, 2048), "attention_mask": (2, 2048)}] and np.allclose(np.linalg.norm(vectors, axis=1), 1)
    assert np.allclose(vectors[0], [0, 1, 0]) and np.allclose(vectors[1], [0, 2**-0.5, 2**-0.5])


def test_layout_steps_read_spans_once_and_move_them_by_document(spark):
    """Odd spans: blank texts, a size that only blank texts have, no size, no document, both zones at once, equal heights; and plans without joins, with a shuffle at most."""
    import random

    from lakescribe.functions.text import SPACES, strip, trimmed
    from lakescribe.operators import layout

    rng = random.Random(4)
    texts = ["a", " b ", "", "  ", "Anexo", "*x_", "\u3000c\x1c", None, "running"]
    rows = []
    for i in range(1500):
        text, size = rng.choice(texts), rng.choice([8.0, 9.2, 9.3, 12.0, 14.0, 20.0, None, 16.0, 18.0, 22.0, 24.0])
        if size == 24.0:
            text = " "
        y0 = rng.choice([10.0, 60.0, 100.0, 104.0, 108.0, 300.0, None])
        rows.append((rng.choice([1, 2, 3, None]), rng.randint(1, 3), i, text, size, rng.random() < 0.5, rng.random() < 0.5, 0.0, y0, 5.0, None if y0 is None else y0 + 5, rng.choice([120.0, 792.0])))
    spans = spark.createDataFrame(rows, "doc long, page int, seq long, text string, font_size double, is_bold boolean, is_italic boolean, x0 double, y0 double, x1 double, y1 double, page_height double").cache()
    for step in (layout.with_levels, layout.without_running_text, layout.line_groups):
        plan = step(spans.repartition("doc"))._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("Repartition") == 1, plan

    key = lambda r: r["seq"]
    levels = {(r.doc, r.font_size): r.level for r in layout.heading_levels(spans).collect()}
    half = lambda x: None if x is None else round(x * 2) / 2
    want = {r[2]: levels.get((r[0], half(r[4])), 0) if r[0] is not None and r[4] is not None else 0 for r in rows}
    assert {r.seq: r.heading_level for r in layout.with_levels(spans).collect()} == want
    assert 6 in want.values()

    found = {(r.doc, r.zone, r.norm) for r in layout.repeated_texts(spans).collect() if r.doc is not None}
    bare = lambda t: None if t is None else t.strip(SPACES)[:100].strip(SPACES)
    dropped = lambda r: r[8] is not None and ((r[8] < 72 and (r[0], "header", bare(r[3])) in found) or (r[10] > r[11] - 72 and (r[0], "footer", bare(r[3])) in found))
    left = sorted(layout.without_running_text(spans).collect(), key=key)
    assert [r.seq for r in left] == [r[2] for r in rows if not dropped(r)] and 0 < len(left) < len(rows)

    lines, pages = {}, {}
    for r in rows:
        anchor, line = pages.get((r[0], r[1]), (None, -1))
        if anchor is None or r[8] is None or abs(r[8] - anchor) > 5:
            anchor, line = r[8], line + 1
        pages[r[0], r[1]], lines[r[2]] = (anchor, line), line
    grouped = layout.line_groups(spans)
    assert {r.seq: r.line for r in grouped.collect()} == lines and grouped.columns == [*spans.columns, "line"]

    signs = spark.createDataFrame([(a + b + c,) for a in [*SPACES, "", "x", "\x00", "\x7f", "\u200b"] for b in ("", "y z") for c in [*SPACES, "", "x", "\u180e", "\ufeff"]], "t string")
    assert signs.filter(~trimmed(F.col("t")).eqNullSafe(strip(F.col("t")))).count() == 0
