"""The stateful stream of file changes against the batch form, with late, repeated and missing observations; versions of the table by micro-batch."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lakescribe.sources.chunktable import ChunkTable
from lakescribe.streaming.changes import changes_of, file_changes, versioned_upsert
from tests.oracle import session

START, GONE = datetime(2024, 1, 1), timedelta(hours=6)
SCHEMA = "key string, seen_at timestamp, md5 string, text string"


@pytest.fixture(scope="module")
def spark():
    return session()


def at(hours):
    return START + timedelta(hours=hours)


BATCHES = [
    [("memo/a", at(0), "1", "a one"), ("memo/b", at(0), "1", "b one"), ("memo/a", at(1), "1", "a one"), (None, at(1), "1", "x"), ("memo/n", at(1), None, "x")],
    [("memo/a", at(2), "2", "a two"), ("memo/a", at(2), "2", "a two"), ("memo/c", at(3), "1", "c one"), ("memo/a", at(1), "0", "older than what is known")],
    [("memo/c", at(9), "1", "c one"), ("memo/d", at(9), "1", "d one"), ("memo/d", at(9.5), "2", "d two"), ("memo/b", at(8.5), "1", "b is back")],
    [("memo/late", at(1), "1", "far too late"), ("memo/d", at(30), "2", "d two")],
]


def streamed(spark, tmp_path, sink):
    """All batches as files of a stream, one micro-batch each."""
    folder = tmp_path / "in"
    folder.mkdir()
    query = None
    for k, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"file://{folder}/{k}")
        stream = spark.readStream.schema(SCHEMA).parquet(f"file://{folder}/*")
        query = sink(file_changes(stream, GONE, "1 hour").writeStream.option("checkpointLocation", f"file://{tmp_path}/check")).trigger(availableNow=True).start()
        query.awaitTermination()
    return query


def test_stream_equals_batch(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    streamed(spark, tmp_path, lambda w: w.format("parquet").option("path", out))
    got = sorted((r.key, r.at, r.status, r.md5) for r in spark.read.parquet(out).collect())
    told = [r for rows in BATCHES for r in rows if r[0] != "memo/late" and r[3] != "older than what is known"]
    want = sorted((r.key, r.at, r.status, r.md5) for r in changes_of(spark.createDataFrame(told, SCHEMA), GONE, F.lit(at(29))).collect())
    assert got == want
    assert [s for k, _, s, _ in got if k == "memo/b"] == ["new", "deleted", "new", "deleted"] and [s for k, _, s, _ in got if k == "memo/a"] == ["new", "modified", "deleted"]
    assert [s for k, _, s, _ in got if k == "memo/d"] == ["new", "modified", "deleted", "new"]


def test_micro_batches_are_versions(spark, tmp_path):
    place = f"file://{tmp_path}/table"
    words = F.repeat(F.concat(F.col("text"), F.lit(" ")), 120)
    run = versioned_upsert(place)
    changes = changes_of(spark.createDataFrame([r for rows in BATCHES[:3] for r in rows], SCHEMA), GONE, F.lit(at(8))).withColumn("text", F.concat(F.lit("## Part\n\n"), words))
    run(changes, 0)
    rows = sorted((r.source_file, r.text) for r in ChunkTable.open(spark, place).rows().collect())
    assert {r[0] for r in rows} == {"b", "c", "d"} and "d two" in [t for s, t in rows if s == "d"][0]
    run(changes, 0)  # a repeated batch
    assert ChunkTable.open(spark, place).version == 0
    run(spark.createDataFrame([("memo/d", "deleted", "2", at(20), None)], "key string, status string, md5 string, at timestamp, text string"), 1)
    assert {r.source_file for r in ChunkTable.open(spark, place).rows().collect()} == {"b", "c"}
    assert sorted((r.source_file, r.text) for r in ChunkTable.open(spark, place, 0).rows().collect()) == rows
