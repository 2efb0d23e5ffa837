"""Changes of files from a stream of observations: state by file, upserts as they come, removals by timer.

An observation says that a file (key) was there at a time, with a digest and perhaps its text. Of each file the state holds when it was last seen and its digest, nothing else, so what is kept is
a few bytes a file in the state store. A digest that is new is a change; a file that is not seen again for ``gone_after`` is deleted, which a timer on event time says. ``changes_of`` gives
the same for a table of observations.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators.chunking import process_documents
from ..sources.chunktable import ChunkTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE = "key string, status string, md5 string, at timestamp, text string"
_STATE = T.StructType([T.StructField("seen", T.LongType()), T.StructField("md5", T.StringType())])


class FileState(StatefulProcessor):
    """Rows (key, seen_at, md5, text) of a file in any order within a batch; what is older than the state says nothing, and so does what repeats it."""

    def __init__(self, gone_after_ms: int):
        self.gone_after = gone_after_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("file", _STATE)

    def _rows(self, rows: list[tuple]):
        import pandas as pd

        frame = pd.DataFrame(rows, columns=["key", "status", "md5", "at", "text"])
        frame["at"] = pd.to_datetime(frame["at"], unit="ms")
        return frame

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        known = self.state.get() if self.state.exists() else None
        seen, digest = (known[0], known[1]) if known else (None, None)
        came = []
        for frame in rows:
            at = frame["seen_at"].astype("datetime64[ms]").astype("int64")
            came += list(zip(at.tolist(), frame["md5"].tolist(), frame["text"].tolist()))
        out = []
        for at, md5, text in sorted(came, key=lambda r: r[:2]):
            if seen is not None and (at, md5) <= (seen, digest):
                continue
            if seen is not None and at - seen > self.gone_after:
                out.append((key[0], "deleted", digest, seen + self.gone_after, None))
                digest = None
            if digest is None or md5 != digest:
                out.append((key[0], "new" if digest is None else "modified", md5, at, text))
            seen, digest = at, md5
        if came and seen is not None and digest is not None:
            self.state.update((seen, digest))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(seen + self.gone_after)
        if out:
            yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        if self.state.exists():
            seen, digest = self.state.get()
            self.state.clear()
            yield self._rows([(key[0], "deleted", digest, seen + self.gone_after, None)])

    def close(self) -> None:
        pass


def file_changes(observations: DataFrame, gone_after: timedelta, late: str = "1 hour") -> DataFrame:
    """(key, status, md5, at, text) of a stream of (key, seen_at, md5[, text]): new, modified and deleted files as they become so.

    Observations later than the watermark ``late`` are left out. Rows with a null in key, time or digest say nothing. The state store has to be RocksDB's, which is set where the session names none.
    """
    spark = observations.sparkSession
    if not spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = _observed(observations).withWatermark("seen_at", late)
    state = FileState(int(gone_after.total_seconds() * 1000))
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=state, outputStructType=CHANGE, outputMode="Append", timeMode="EventTime")


def _observed(observations: DataFrame) -> DataFrame:
    text = F.col("text") if "text" in observations.columns else F.lit(None)
    rows = observations.filter("key IS NOT NULL AND seen_at IS NOT NULL AND md5 IS NOT NULL")
    return rows.select(F.col("key").cast("string").alias("key"), F.date_trunc("millisecond", F.col("seen_at").cast("timestamp")).alias("seen_at"), "md5", text.cast("string").alias("text"))


def changes_of(observations: DataFrame, gone_after: timedelta, until) -> DataFrame:
    """What ``file_changes`` says of these observations, all of them in time, when its watermark stands at ``until`` (a timestamp or a column)."""
    gap = F.expr(f"INTERVAL '{gone_after.total_seconds()}' SECOND")
    order = Window.partitionBy("key").orderBy("seen_at", "md5")
    rows = _observed(observations).groupBy("key", "seen_at", "md5").agg(F.max("text").alias("text"))
    rows = rows.select("*", F.lag("seen_at").over(order).alias("_seen"), F.lag("md5").over(order).alias("_md5"), F.lead("seen_at").over(order).alias("_next"))
    again = F.col("seen_at") > F.col("_seen") + gap
    status = F.when(F.col("_seen").isNull() | again, "new").when(F.col("md5") != F.col("_md5"), "modified")
    changed = rows.select("key", status.alias("status"), "md5", F.col("seen_at").alias("at"), "text").filter("status IS NOT NULL")
    ends = (F.col("_next") > F.col("seen_at") + gap) | (F.col("_next").isNull() & (F.col("seen_at") + gap <= until))
    gone = rows.filter(ends).select("key", F.lit("deleted").alias("status"), "md5", (F.col("seen_at") + gap).alias("at"), F.lit(None).cast("string").alias("text"))
    return changed.unionByName(gone)


def versioned_upsert(table: str, entities: Sequence[str] = ()):
    """A batch function for changes (see ``file_changes``; keys are type/name): each micro-batch is one version of the chunk table at ``table``.

    The version's document holds the batch's number, so a batch that is repeated after a failure changes nothing.
    """

    def run(batch: DataFrame, number: int) -> None:
        stored = ChunkTable.open(batch.sparkSession, table)
        if stored.extra.get("batch", -1) >= number:
            return
        last = batch.groupBy("key").agg(F.max_by(F.struct("status", "text"), F.struct("at", F.col("status") != "deleted")).alias("s")).select("key", "s.*")
        docs = last.filter("status <> 'deleted'").select("text", F.regexp_extract("key", r"(?s)\A[^/]*/(.*)\z", 1).alias("source_file"), F.substring_index("key", "/", 1).alias("document_type"))
        fresh = process_documents(docs, entities)
        if stored.schema is not None:
            stored.delete_files(last)
        stored.append(fresh)
        stored.extra = {**stored.extra, "batch": number}
        stored.publish()

    return run
