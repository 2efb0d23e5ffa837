"""Exact dedup by a tree merge of sorted digest runs, in DataFrame operations only.

Every row is dealt to one of ``runs`` runs by a hash of its id, so that copies of one text, however
many, are spread over all runs. Each run is reduced to one entry per digest, its head: the id to keep and the number of rows. Then runs exchange heads in
rounds: in a round, ``fan_in`` neighbouring runs (a power of two, so that a round does the work of log2(fan_in) binomial rounds) become one. A run is laid out in slices of
digest ranges, each sorted by digest; a task gets the same slice of the neighbours, has it in the order of digests, and goes over it once: entries of equal
digest stand next to each other, and the first of them, which has the id to keep, stays as the head with the sum of their rows. So no task ever holds a whole run, and nothing but heads moves on.
After the last round one run holds one entry per distinct text. The answers go the way back: an entry per (run, digest) gets the id to keep, and rows meet the entry of
their own run. So no task ever holds more than runs' entries of one digest or a run's share of its rows.

An entry's identity is (SHA-256, byte length, 64-bit hash): texts that only share a SHA-256 stay apart,
which is verified at each level as all three are keys of each merge. Only digests are shuffled, never texts.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import salts_for, text_of, written

KEYS = ["_sha", "_len", "_xx"]


def merge_runs(entries: DataFrame, keys: list[str], runs: int, fan_in: int, keep: str = "largest", slices: int = 64) -> DataFrame:
    """Entries (_run, *keys, _keep, _n) of ``runs`` runs merged to one row per key, in rounds of ``fan_in``; the first key is binary and evenly distributed, as digests are."""
    order = F.desc_nulls_last("_keep") if keep == "largest" else F.asc_nulls_last("_keep")
    # the digest's first four bytes as a number, in so many ranges: the same order as the digests' own
    lead = F.conv(F.hex(F.substring(keys[0], 1, 4)), 16, 10).cast("long")
    entries = entries.withColumn("_slice", F.floor(lead * slices / (1 << 32)).cast("int"))
    group = Window.partitionBy("_run", "_slice", *keys)
    while runs > 1:
        runs = -(-runs // fan_in)
        entries = entries.withColumn("_run", F.floor(F.col("_run") / fan_in).cast("int"))
        # both windows find the task's rows in their order: there is one exchange and one sort in a round
        entries = entries.repartition("_run", "_slice").sortWithinPartitions("_run", "_slice", *keys, order)
        entries = entries.withColumn("_place", F.row_number().over(group.orderBy(order))).withColumn("_n", F.sum("_n").over(group)).filter("_place = 1").drop("_place")
    return entries.drop("_run", "_slice")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", runs: int | None = None, fan_in: int = 8) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Equal means identical texts, null as empty (so null and "" are copies). ``keep`` is "largest" or
    "smallest": the id that stays. ``runs`` grows with the rows unless given. Rows with a null id count in group_size; such a row stays only where
    its group has no other id, and its keep_id is then null and kept is true. Rows that repeat both id and text cannot be told apart:
    each is returned and each has the same flags. An empty table gives no rows. Other columns are ignored.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    text = text_of(text_col)
    rows = written(
        df.select(
            F.col(id_col).alias("_id"),
            F.unhex(F.sha2(text, 256)).alias("_sha"),
            F.octet_length(text).cast("long").alias("_len"),
            F.xxhash64(text).alias("_xx"),
        ),
        "digests",
    )
    count = rows.count()
    runs = salts_for(count, base=fan_in) if runs is None else runs
    rows = rows.withColumn("_run", F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(runs)).cast("int"))
    pick = F.max if keep == "largest" else F.min
    first = rows.groupBy("_run", *KEYS).agg(pick("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    merged = merge_runs(first, KEYS, runs, fan_in, keep, slices=salts_for(count))
    down = first.select("_run", *KEYS).join(merged, KEYS)
    out = rows.join(down, ["_run", *KEYS])
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", **options) -> DataFrame:
    """The rows of ``df`` that stay, one per distinct text, with all their columns.

    Rows are told apart by id and text: ids that repeat, null ones too, lose no text. Of rows that repeat id and text one stays.
    """
    own = f"_{uuid4().hex}"  # whatever columns the rows have
    groups = exact_groups(df, id_col, text_col, keep=keep, **options).filter("kept").select(F.col(id_col).alias(own), F.col("text_sha256").alias(own + "s"))
    groups = written(groups.dropDuplicates([own, own + "s"]), "kept")
    rows = df.withColumn(own + "d", F.sha2(F.encode(text_of(text_col), "UTF-8"), 256))
    met = rows.join(groups.hint("shuffle_hash"), F.col(own + "d").eqNullSafe(F.col(own + "s")) & F.col(id_col).eqNullSafe(F.col(own)), "left_semi")
    return met.dropDuplicates([id_col, own + "d"]).drop(own + "d")
