"""Segmented text index, block bounds, versioned chunk table, vector index: against what is built anew or by brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakescribe.config import parse_config
from lakescribe.operators import search, textindex, vectors
from lakescribe.plans import reindex
from lakescribe.plans.engine import Engine
from lakescribe.sources import files, snapshots
from lakescribe.sources.chunktable import ChunkTable
from tests.oracle import session

RNG = random.Random(4)
RAW = {
    "project": {"name": "p", "description": "d", "language": "en", "table_name": "chunks"},
    "entities": [{"name": "city", "extract_from": "filename", "pattern": r"^(.+?)_"}], "document_types": [{"name": "report", "directory": "x"}], "filters": ["city", "document_type"],
}


@pytest.fixture(scope="module")
def spark():
    return session()


def text_of(n):
    return " ".join(RNG.choice(["the", "of", "and", "a"]) if RNG.random() < 0.6 else f"w{int(RNG.paretovariate(0.7)) % 300}" for _ in range(n))


def corpus(spark, texts):
    return spark.createDataFrame(list(texts.items()), "chunk_id long, text string")


def brute(texts, query, k):
    words = {i: Counter(w for w in re.split(r"[^\w]+", (t or "").lower()) if w) for i, t in texts.items()}
    n, avg = len(words), sum(sum(w.values()) for w in words.values()) / max(1, len(words))
    scores = Counter()
    for term in {w for w in re.split(r"[^\w]+", query.lower()) if w}:
        df = sum(term in w for w in words.values())
        for i, w in words.items():
            if w[term]:
                scores[i] += math.log(1 + (n - df + 0.5) / (df + 0.5)) * w[term] * 2.2 / (w[term] + 1.2 * (0.25 + 0.75 * sum(w.values()) / avg))
    best = sorted(((-round(s, 9), i) for i, s in scores.items()))[:k]
    return [(i, round(s / best[0][0], 6)) for s, i in best]


QUERIES = {"a": "the w1 w7", "b": "W2 of w250 nothing", "c": "and", "d": "zzz"}


def found(spark, texts, index, k=5):
    asked = spark.createDataFrame(list(QUERIES.items()), "query_id string, query string")
    rows = search.text_search(corpus(spark, texts), asked, k, index).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score")).collect()
    return {q: [(r.chunk_id, r.score) for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == q] for q in QUERIES}


def wanted(texts, k=5):
    return {q: brute(texts, text, k) for q, text in QUERIES.items()}


def test_refreshed_index_equals_a_new_one(spark, tmp_path):
    texts = {i: text_of(RNG.randint(0, 60)) for i in range(150)} | {1000: None, 1001: "", 1002: text_of(20_000)}
    index = textindex.write_index(corpus(spark, texts), f"file://{tmp_path}/index")
    assert found(spark, texts, index) == wanted(texts)
    for step in range(4):
        gone = RNG.sample(sorted(texts), 12)
        fresh = {i: text_of(30) for i in [*gone[:5], *range(2000 + 10 * step, 2007 + 10 * step)]}
        for i in gone:
            texts.pop(i)
        texts |= fresh
        before = {s["id"] for s in index.segments}
        index = textindex.refresh_index(index, spark.createDataFrame([(i,) for i in [*gone, -5]], "chunk_id long"), corpus(spark, fresh), fan=3)
        added = [s for s in index.segments if s["id"] not in before]
        assert len(added) == 1 and added[0]["docs"] < 60  # the first segment is not written again
        assert (index.n, index.version) == (len(texts), step + 1)
        assert len(index.segments) <= 1 + 2 * 2
    assert found(spark, texts, textindex.open_index(spark, index.path)) == wanted(texts)
    whole = textindex.merge_segments(index)
    textindex.vacuum_index(whole)
    assert len(whole.segments) == 1 and not whole.dead and found(spark, texts, whole) == wanted(texts)
    assert snapshots.folders(spark, f"{index.path}/lists") == [f"segment={whole.segments[0]['id']}"]
    nothing = textindex.refresh_index(whole, corpus(spark, texts).select("chunk_id"), corpus(spark, {}).limit(0))
    assert nothing.n == 0 and found(spark, texts, nothing) == dict.fromkeys(QUERIES, [])


def test_blocks_that_cannot_win_are_passed_over(spark, tmp_path):
    texts = {i: "the of and " * RNG.randint(1, 40) + " ".join(f"w{RNG.randint(0, 400)}" for _ in range(3)) for i in range(6000)} | {9000: "rare1 rare2 the", 9001: "rare1 the", 9002: "rare1 rare2 rare3"}
    index = textindex.write_index(corpus(spark, texts), f"file://{tmp_path}/index")
    asked = spark.createDataFrame([("a", "the rare1 rare2"), ("b", "and the of")], "query_id string, query string")
    read = {r.query_id: r for r in textindex.postings_read(index, asked, 2).collect()}
    assert read["a"].held > 6000 and read["a"].wanted < 0.2 * read["a"].held and read["b"].wanted <= read["b"].held
    rows = search.text_search(corpus(spark, texts), asked.filter("query_id = 'a'"), 2, index).collect()
    assert [(r.chunk_id, round(r.score, 6)) for r in sorted(rows, key=lambda r: r["rank"])] == brute(texts, "the rare1 rare2", 2)
    half = corpus(spark, texts).filter("chunk_id % 2 = 1")
    rows = search.text_search(half, asked.filter("query_id = 'a'"), 3, index).collect()
    scores = [x for x in brute(texts, "the rare1 rare2", 6003) if x[0] % 2][:3]
    assert [r.chunk_id for r in sorted(rows, key=lambda r: r["rank"])] == [i for i, _ in scores]


def test_index_is_kept_by_the_tables_files(spark, tmp_path):
    place = f"file://{tmp_path}/t"
    corpus(spark, {1: "one two"}).write.parquet(place)
    first = textindex.index_for(spark.read.parquet(place), place)
    assert textindex.index_for(spark.read.parquet(place), place).segments == first.segments
    corpus(spark, {2: "two"}).write.mode("append").parquet(place)
    assert textindex.index_for(spark.read.parquet(place), place).n == 2


def test_a_run_that_is_killed_leaves_the_old_version(spark, tmp_path, monkeypatch):
    docs, base = tmp_path / "reports", f"file://{tmp_path}/store"
    docs.mkdir()
    for name in ("Boston_a.md", "Miami_b.md", "Rome_c.md"):
        (docs / name).write_text("## Part\n\n" + f"flood {name[:3]} " * 80)
    config, where = parse_config(RAW), {"report": f"file://{docs}"}
    reindex.incremental(spark, config, base, where)
    old = sorted(map(str, Engine.open(spark, base, config=config).chunks.collect()))
    (docs / "Boston_a.md").unlink()
    (docs / "Rome_c.md").write_text("## Part\n\n" + "drought " * 90)
    import os

    os.utime(docs / "Rome_c.md", (5, 5))

    for step in ("delete_files", "append", "write_files", "publish"):
        with monkeypatch.context() as m:
            done = getattr(ChunkTable, step)

            def killed(self, *a, done=done, step=step):
                if step != "publish":
                    done(self, *a)
                raise KeyboardInterrupt

            m.setattr(ChunkTable, step, killed)
            with pytest.raises(KeyboardInterrupt):
                reindex.incremental(spark, config, base, where)
        engine = Engine.open(spark, base, config=config)
        assert sorted(map(str, engine.chunks.collect())) == old and engine.search("drought", mode="fts").count() == 0
    report = reindex.incremental(spark, config, base, where)
    assert (report.new, report.modified, report.deleted, report.files) == (0, 1, 1, 2)
    engine = Engine.open(spark, base, config=config)
    rows = sorted(map(str, engine.chunks.collect()))
    assert {r.source_file for r in engine.chunks.collect()} == {"Miami_b.md", "Rome_c.md"} and engine.search("drought", mode="fts").count() >= 1
    assert sorted(map(str, Engine.open(spark, base, config=config, version=0).chunks.collect())) == old
    table = ChunkTable.open(spark, f"{base}/chunks")
    assert len(table.data) == 2 and len(table.deletes) == 1
    reindex.compact(spark, config, base, vacuum=True)
    assert sorted(map(str, Engine.open(spark, base, config=config).chunks.collect())) == rows
    assert len(snapshots.folders(spark, f"{base}/chunks/data")) == 1 and Engine.open(spark, base, config=config).search("drought", mode="fts").count() >= 1


def test_two_writers(spark, tmp_path):
    place = f"file://{tmp_path}/t"
    rows = spark.createDataFrame([("t", "f", 1), ("t", "g", 2), (None, "h", 3)], "document_type string, source_file string, n int")
    one, two = ChunkTable.open(spark, place), ChunkTable.open(spark, place)
    one.append(rows)
    two.append(rows)
    one.publish()
    with pytest.raises(snapshots.Conflict):
        two.publish()
    again = ChunkTable.open(spark, place)
    again.delete_files(spark.createDataFrame([("t/f",)], "key string"))
    again.append(spark.createDataFrame([("t", "f", 9, "x")], "document_type string, source_file string, n int, more string"))
    again.publish()
    assert sorted((r.source_file, r.n, r.more) for r in ChunkTable.open(spark, place).rows().collect()) == [("f", 9, "x"), ("g", 2, None), ("h", 3, None)]
    assert sorted(r.n for r in ChunkTable.open(spark, place, 0).rows().collect()) == [1, 2, 3]


def test_only_files_that_moved_are_opened(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for i in range(6):
        (tmp_path / "d" / f"f{i}.md").write_text(f"text {i}")
    where = {"memo": f"file://{tmp_path}/d"}
    only = spark.createDataFrame([("memo/f1.md",), ("memo/f4.md",), ("other/f0.md",)], "key string")
    some = files.scan_markdown(spark, where, only=only)
    assert sorted(r.text for r in some.collect()) == ["text 1", "text 4"] and len(some.inputFiles()) == 2
    times = files.scan_times(spark, where)
    assert times.count() == 6 and "content" not in times._jdf.queryExecution().executedPlan().toString()
    assert files.scan_fingerprints(spark, where, only=times.filter("key = 'memo/f2.md'")).select("key").collect()[0].key == "memo/f2.md"


def test_vector_search_and_index(spark, tmp_path):
    rng = np.random.default_rng(2)
    heart = rng.normal(size=(12, 16))
    rows = heart[rng.integers(0, 12, 2500)] + 0.4 * rng.normal(size=(2500, 16))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    data = [(i, [float(x) for x in v], "ab"[i % 2]) for i, v in enumerate(rows)] + [(9000, None, "a"), (9001, [1.0], "a"), (9002, [None] * 16, "b"), (9003, data0 := [float(x) for x in rows[50]], "b")]
    table = spark.createDataFrame(data, "chunk_id long, vector array<double>, kind string").repartition(5)
    asked = spark.createDataFrame([(i, [float(x) for x in rows[i]]) for i in range(0, 2500, 50)] + [(-1, None)], "query_id long, query_vector array<double>")
    every = np.vstack([rows, [data0]])
    ids = np.array([*range(2500), 9003])
    want = {}
    for q in range(0, 2500, 50):
        s = np.round(every @ rows[q], 6)
        want[q] = [int(ids[j]) for j in np.lexsort((ids, -s))[:10]]
    lists = lambda df: {q: [r.chunk_id for r in sorted(v, key=lambda r: r["rank"])] for q, v in group(df.collect()).items()}
    exact = search.vector_search(table, asked, 10)
    assert lists(exact) == want and lists(search.vector_search(table, asked, 10, block_bytes=2000)) == want
    grouped = search.vector_search(table, asked, 3, by=("query_id", "kind"))
    assert grouped.count() == 50 * 2 * 3 and grouped.filter("query_id = chunk_id AND rank = 1").count() >= 49
    index = vectors.write_vector_index(table.select("chunk_id", "vector"), f"file://{tmp_path}/v", sample=800)
    index = vectors.open_vector_index(spark, index.path)
    assert index.rows().count() == 2501 and len(index.centres) == 50
    assert lists(search.vector_search(table, asked, 10, index=index, probes=50)) == want
    assert vectors.recall(search.vector_search(table, asked, 10, index=index), exact).head().recall >= 0.9
    assert set(lists(search.vector_search(table.filter("kind = 'a'"), asked, 10, index=index, probes=50))[0]) <= set(range(0, 2500, 2))
    nothing = vectors.write_vector_index(table.limit(0).select("chunk_id", "vector"), f"file://{tmp_path}/w")
    assert search.vector_search(table.limit(0), asked, 3).count() == 0 and len(nothing.centres) == 0


def group(rows):
    out = {}
    for r in rows:
        out.setdefault(r.query_id, []).append(r)
    return out


def test_passages_are_scored_chunk_by_chunk_and_equal_all_lists(spark, tmp_path):
    rng = random.Random(3)
    texts = {i: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 2) for _ in range(rng.randint(0, 30))) for i in range(300)}
    index = textindex.write_index(corpus(spark, texts), str(tmp_path / "chunks"))
    index = textindex.refresh_index(index, corpus(spark, {i: "" for i in range(0, 300, 7)}), corpus(spark, {i: f"new a b {i}" for i in range(0, 300, 14)}))
    asked = spark.createDataFrame([(f"q{i}", " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60))) for i in range(12)] + [("none", "xyzzy")], "query_id string, query string")
    allowed = corpus(spark, {**texts, 999: "not in the index"}).select("chunk_id").filter("chunk_id % 3 > 0").withColumn("g", F.col("chunk_id") % 2)
    found = textindex.plan(index, asked)
    assert not found.prunes
    for by in (("query_id",), ("query_id", "g")):
        every = search.top_k(found.scored().join(allowed, "chunk_id").filter("score > 0"), 5, by)
        few = found.best(allowed, 5, by[1:])
        assert few.rdd.getNumPartitions() * 12 * 5 * len(by) >= few.count()
        assert "HashAggregate" not in few._jdf.queryExecution().executedPlan().toString()  # no row for each query and chunk is moved
        best = search.top_k(few, 5, by)
        rows = lambda df: sorted((r.query_id, r.chunk_id, r.g if len(by) > 1 else 0, round(r.score, 8), r["rank"]) for r in df.collect())
        assert rows(best) == rows(every) and rows(best)


def test_entries_of_lists_move_once(spark):
    rows = [(i, 3, i >> 1, [("a", 1), (f"t{i % 3}", 2)]) for i in range(9)] + [(9, 0, 4, [])]
    stored = spark.createDataFrame(rows, "chunk_id long, doc_len int, block long, terms array<struct<term:string,tf:int>>")
    lists = textindex._lists(stored, 2, 3)
    assert lists._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {(r.term, r.block): (r.ids, r.tfs, r.lens, r.n, r.max_tf, r.min_len) for r in lists.collect()}
    want = {}
    for i, length, block, terms in rows:
        for term, tf in terms:
            want.setdefault((term, block), []).append((i, tf, length))
    assert got == {k: ([x[0] for x in v], [x[1] for x in v], [x[2] for x in v], len(v), max(x[1] for x in v), min(x[2] for x in v)) for k, v in want.items()}
