"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source is a queue: its documents in an order shuffled by a hash, and after the last one the same
again, up to ``max_repeat`` times. The virtual finish time of a queued document is the number of words of its queue up
to it (its own counted half, so that rounding is to the nearest document) divided by the source's target.
All queues are merged by virtual time, and the merged queue is cut where the words reach the budget.

Running sums are two-level: a table of sums per (source, hash range) is summed up, and rows are summed only within
their own range, so a source with a third of all rows is spread over all ranges. Rows of equal source, id and size are one entry with a count until their places are known, so an id that very many rows
repeat is a few entries. The same is done
with ranges of virtual time, where queues are dense alike, for the cut at the budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import salts_for, written

WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """(_source, source_size) with each source's target added.

    Sources by code point, null last, weigh ``weights`` in turn. The total is shared by weight; no source gets more than
    ``max_repeat`` times its size, and what is above goes to the others by weight until none is above. In
    closed form: sources are capped in order of (cap / weight) as long as the share of the rest exceeds that ratio.
    """
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    w = sources.withColumn("_k", (F.row_number().over(by_name) - 1) % len(weights))
    w = w.withColumn("_w", F.element_at(F.array(*[F.lit(int(x)) for x in weights]), F.col("_k") + 1).cast("long"))
    w = w.withColumn("_cap", F.col("source_size") * max_repeat)
    by_ratio = Window.orderBy((F.col("_cap") / F.col("_w")), F.col("_source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = (
        w.withColumn("_left", F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_wleft", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
        .withColumn("_level", F.col("_left").cast("double") / F.col("_wleft"))
    )
    # the level of the first source in order that fits under its cap; those before it are at their caps
    w = w.withColumn("_fits", F.col("_level") * F.col("_w") <= F.col("_cap"))
    level = F.first(F.when(F.col("_fits"), F.col("_level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    w = w.withColumn("_at", level)
    return w.select("_source", "source_size", F.when(F.col("_cap") < F.col("_at") * F.col("_w"), F.col("_cap").cast("double")).otherwise(F.col("_at") * F.col("_w")).alias("target"))


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3, seed: str = "mix", ranges: int | None = None, time_ranges: int | None = None,
) -> DataFrame:
    """One row per document: id, size, source_size, target, taken.

    size is the number of words; a null or empty text has none and is never taken. A null source is a source of
    its own, the last. Documents whose shuffle hashes tie are ordered by id, then size. Rows that repeat an id are documents of their
    own, as each row is queued. ``taken`` counts the words that the mix takes, repeats counted, so it is size times 0 to ``max_repeat``. An
    empty table gives no rows; a table without words takes none. The numbers of ranges grow with the rows unless given; results do not depend on them. Other columns are ignored.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    hashed = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 12), 16, 10).cast("long")
    docs = df.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), size.alias("size"), hashed.alias("_h"))
    docs = written(docs, "sizes")
    if ranges is None:
        ranges = salts_for(docs.count(), least=1024)
    time_ranges = min(ranges, 1 << 16) if time_ranges is None else time_ranges
    units = docs.groupBy("_source", "_id", "_h", "size").agg(F.count(F.lit(1)).alias("_copies")).withColumn("_all", F.col("size") * F.col("_copies"))
    units = units.withColumn("_range", F.floor(F.col("_h") * F.lit(ranges) / F.lit(1 << 48)).cast("int"))

    sums = units.groupBy("_source", "_range").agg(F.sum("_all").alias("_words"))
    sources = sums.groupBy("_source").agg(F.sum("_words").alias("source_size"))
    goal = targets(sources, weights, max_repeat)
    before = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    starts = starts.join(goal.withColumnRenamed("_source", "_s2"), F.col("_source").eqNullSafe(F.col("_s2"))).select(
        F.col("_source").alias("_s"), F.col("_range").alias("_r"), "_start", "source_size", "target"
    )
    within = Window.partitionBy("_source", "_range").orderBy("_h", F.col("_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queued = (
        units.withColumn("_upto", F.sum("_all").over(within))
        .join(starts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
        .withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
        .select("_id", "_source", "_h", "size", "source_size", "target", (F.col("_start") + F.col("_upto") - F.col("_all") + F.col("size") * F.col("_copy") + F.col("size") / 2).alias("_mid"))
    )
    queued = written(queued, "queued")

    # a document stands in the merged queue once for each pass
    def time(p):
        return F.try_divide(F.col("_mid") + p * F.col("source_size"), F.col("target"))

    def slot(t):
        return F.least(F.floor(t * time_ranges), F.lit(time_ranges * 8)).cast("int")

    passes = F.array(*[time(F.lit(p)) for p in range(max_repeat)])
    merged = queued.filter("size > 0").select("_id", "_source", "size", F.posexplode(passes).alias("_pass", "_time")).withColumn("_slot", slot(F.col("_time")))
    slots = merged.groupBy("_slot").agg(F.sum("size").alias("_words"))
    # three numbers come to the driver: the budget, the slot in which the words pass it, and the last time in that slot that still fits
    budget = docs.agg(F.coalesce(F.sum("size"), F.lit(0))).head()[0]
    upto = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    crossing = slots.withColumn("_after", F.sum("_words").over(upto)).filter(F.col("_after") > budget).orderBy("_slot").head()
    if crossing is None:  # nothing is above the budget
        times = F.lit(max_repeat)
    else:
        cut, before = crossing["_slot"], crossing["_after"] - crossing["_words"]
        order = Window.partitionBy("_slot").orderBy("_time", F.col("_source").asc_nulls_last(), F.col("_id").asc_nulls_first(), "_pass")
        fits = F.sum("size").over(order) - F.col("size") / 2 <= budget - before
        last = merged.filter(F.col("_slot") == cut).select("_time", fits.alias("_fits")).filter("_fits").agg(F.max("_time")).head()[0]
        last = -1.0 if last is None else last
        taken = [((slot(time(F.lit(p))) < cut) | ((slot(time(F.lit(p))) == cut) & (time(F.lit(p)) <= last))).cast("long") for p in range(max_repeat)]
        times = sum(taken[1:], taken[0])
    return queued.select(
        F.col("_id").alias(id_col), "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"),
        F.when(F.col("size") > 0, F.col("size") * times).otherwise(F.lit(0)).cast("long").alias("taken"),
    )
