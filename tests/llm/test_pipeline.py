"""Each stage of the pipeline against brute force over its own input, on the smallest tables."""

import collections
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lakescribe.llm.common import written
from tests.llm.test_operators import brute_near, brute_phrases
from tests.oracle import session

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_stages():
    spark = session()
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("_id", F.lit(1)).withColumn("taken", F.lit("x"))
    benchmark = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    inputs = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        inputs[name] = docs
        docs = written(stage(spark, docs, SF), "test")
        assert docs.columns == inputs[name].columns, name
    rows = {name: [(r.doc_id, r.text, r.source) for r in df.collect()] for name, df in (*inputs.items(), ("end", docs))}

    kept = {i for i, *_ in rows["near_dedup"]}
    good = [i for i, *_ in rows["quality"] if labels.get(i) == 1]
    bad = [i for i, *_ in rows["quality"] if labels.get(i) == 0]
    assert np.mean([i in kept for i in good]) > 0.97 and np.mean([i not in kept for i in bad]) > 0.6
    assert sorted(i for i, *_ in rows["decontamination"]) == sorted(r[0] for r in brute_near(rows["near_dedup"]) if r[3])
    dirty = {r[0] for r in brute_phrases([(i, t) for i, t, _ in rows["decontamination"]], benchmark) if r[5]}
    assert sorted(i for i, *_ in rows["mix"]) == sorted(i for i, *_ in rows["decontamination"] if i not in dirty)
    times = collections.Counter(i for i, *_ in rows["end"])
    words = {i: len((t or "").split()) for i, t, _ in rows["mix"]}
    assert set(times) <= set(words) and max(times.values()) <= 3
    assert abs(sum(words[i] * n for i, n in times.items()) - sum(words.values())) <= max(words.values())

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for i, t, _ in sorted(rows["end"]):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(map(tuple, corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()))
    assert got == want


def test_stages_on_edge_cases(tmp_path):
    """Null ids and texts, empty and long texts, repeated rows and ids, no labels, and an empty table, through every stage."""
    spark = session()
    passage, same = " ".join(f"q{i}" for i in range(20)), " ".join(f"w{i}" for i in range(40))
    rows = [(None, "alpha beta gamma delta eps zeta", "a"), (None, None, "a"), (1, None, None), (2, "", "b"), (3, same, "a"), (3, same, "a"), (5, same, "b"), (6, " ".join(f"l{i}" for i in range(30_000)), "b"), (7, passage, "c")]
    docs = spark.createDataFrame([(i, t, s, "en", 1, "x") for i, t, s in rows], "doc_id long, text string, source string, lang string, _id int, score string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {
        "quality": [None, None, 1, 2, 3, 3, 5, 6, 7],  # no labels: all stay
        "near_dedup": [None, None, 1, 2, 3, 3, 6, 7],
        "decontamination": [None, None, 1, 2, 3, 3, 6],
    }
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert stage(spark, none, str(tmp_path)).count() == 0, name
        if name == "tokens":
            assert out.count() == docs.count()
            break
        assert out.columns == docs.columns
        docs = written(out, "test")
        ids = sorted((r.doc_id for r in docs.collect()), key=lambda x: (x is not None, x or 0))
        if name in want:
            assert ids == want[name], name
        else:
            assert set(ids) <= {None, 3, 6} and all(r.text for r in docs.collect())
