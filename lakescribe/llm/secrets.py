"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Texts are read once: base patterns give their spans, and a wider pattern gives credential-looking tokens that no
base pattern covers. A text is split by each pattern once; the lengths of its parts and matches, summed up in order, are the places, so the work grows with the text's length
whatever the number of matches. Values are then known by their SHA-256 only. For each hash the distinct owners and repositories that hold it are counted over the
whole corpus: a value that many owners or many repositories hold is an example that is copied about, one that few of both hold looks
live. A wide token becomes a span of its own (kind ``owned``) only where it looks live, or where the same value is assigned to a
secret's name somewhere in the corpus. Base spans always stay; they are only marked as live or example.

A hash that a third of all rows hold is counted through partial sums per (hash, owner, repository), and the verdict goes back to
rows by (hash, salt), so no task gets all rows of one hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import salts_for, text_of, written

#: The base patterns, with the least length of a value and the regular expression's group that holds it.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
#: The same kinds where matches that are too short may be skipped at once: a run of one class either is long enough or holds no match.
SCAN = {"assign": BASE["assign"][0], "access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
#: Credential-looking tokens outside the base patterns; a lower-case letter, an upper-case letter and a digit must be among them.
WIDE = r"[A-Za-z0-9+_=-]{20,}"
KINDS = [*BASE, "owned"]
def _matches(text: str, pattern: str, group: int):
    """(gap, length, value) of all leftmost non-overlapping matches in order: the code points since the match before, those of the match, and its value."""
    found = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found(0).alias("m"), found(group).alias("value"))
    out = F.transform(F.filter(zipped, lambda x: x["m"].isNotNull()), lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["m"]).alias("length"), x["value"].alias("value")))
    return F.when(F.col(text).rlike(pattern), out).otherwise(F.expr("cast(array() AS array<struct<gap:int,length:int,value:string>>)"))


def secret_scan(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_cols: tuple[str, ...] = ("source", "lang"),
    few_owners: int = 1, few_repositories: int = 2, salts: int | None = None,
) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_live, n_example, max_owners, max_repositories.

    ``spans`` lists kind:start:end (code points, end exclusive) by start, then kind, comma-joined; ``base_sha256`` is the SHA-256 of the base spans listed so.
    n_live and n_example count base spans whose value has at most ``few_owners`` owners in at most ``few_repositories`` repositories, or more of either. max_owners and max_repositories are the
    most owners and repositories that a value of the row's spans has in the corpus, 0 without spans. A null text counts as empty and has no spans; a null owner or repository is one of its own.
    Rows that repeat have the same spans each; an empty table gives no rows. Other columns are ignored.
    """
    rows = df.select(
        F.col(id_col).alias("_id"), text_of(text_col).alias("_text"),
        F.xxhash64(F.col(owner_col), F.lit(3)).alias("_owner"), F.xxhash64(*[F.col(c) for c in repository_cols], F.lit(5)).alias("_repository"),
    )
    scans = [(k, SCAN[k], group, least) for k, (_, group, least) in BASE.items()] + [("wide", WIDE, 0, 20)]
    looks = lambda kind, value: value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]") if kind == len(BASE) else F.lit(True)

    def all_of(kind: int, name: str, pattern: str, group: int, least: int):
        """Matches of a kind; a value that fails is null, and its match only moves the places of those after it."""
        return F.transform(
            _matches("_text", pattern, group),
            lambda x: F.struct(F.lit(kind).alias("kind"), x["gap"].alias("gap"), x["length"].alias("length"), F.when((F.length(x["value"]) >= least) & looks(kind, x["value"]), F.sha2(x["value"], 256)).alias("hash")),
        )

    matches = F.concat(*[all_of(k, *scan) for k, scan in enumerate(scans)])
    found = written(rows.select(F.monotonically_increasing_id().alias("_row"), "_id", "_owner", "_repository", matches.alias("_matches")), "candidates")
    salts = salts_for(found.count()) if salts is None else salts
    each = found.select("_row", "_owner", "_repository", F.posexplode("_matches").alias("_pos", "m")).select("_row", "_owner", "_repository", "_pos", "m.*")
    upto = Window.partitionBy("_row", "kind").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(upto).cast("int")).withColumn("start", F.col("end") - F.col("length")).filter("hash IS NOT NULL")
    # a wide token that overlaps a base span is none: the furthest end of base spans that begin before it, and the next base span's start
    by_start = Window.partitionBy("_row").orderBy("start", "kind")
    base_only = lambda c: F.when(F.col("kind") < len(BASE), F.col(c))
    reach = F.max(base_only("end")).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    from_end = Window.partitionBy("_row").orderBy(F.desc("start"), F.desc("kind"))
    following = F.min(base_only("start")).over(from_end.rowsBetween(Window.unboundedPreceding, -1))
    clear = (F.coalesce(reach, F.lit(0)) <= F.col("start")) & (F.coalesce(following, F.col("end")) >= F.col("end"))
    candidates = placed.withColumn("_clear", (F.col("kind") < len(BASE)) | clear).filter("_clear").select(
        "_row", "_owner", "_repository", "kind", "start", "end", "hash", F.pmod(F.xxhash64("_row"), F.lit(salts)).alias("_salt")
    )
    candidates = written(candidates, "spans")
    # distinct owners and repositories of each hash, by partial counts
    held = candidates.groupBy("hash", "_owner", "_repository").agg(F.max((F.col("kind") == 0).cast("int")).alias("_assigned"))
    by_owner = held.groupBy("hash", "_owner").agg(F.count(F.lit(1)).alias("_n"), F.max("_assigned").alias("_assigned"))
    frequency = by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("_n").alias("repositories"), F.max("_assigned").alias("_assigned"))
    down = candidates.select("hash", "_salt").distinct().join(frequency, "hash")
    live = (F.col("owners") <= few_owners) & (F.col("repositories") <= few_repositories)
    judged = candidates.join(down, ["hash", "_salt"]).withColumn("_live", live)
    is_wide = F.col("kind") == len(BASE)
    kept = judged.filter(~is_wide | F.col("_live") | (F.col("_assigned") == 1))
    per_row = kept.groupBy("_row").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("_spans"),
        *[F.sum((F.col("kind") == i).cast("long")).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sum((~is_wide & F.col("_live")).cast("long")).alias("n_live"), F.sum((~is_wide & ~F.col("_live")).cast("long")).alias("n_example"),
        F.max("owners").alias("max_owners"), F.max("repositories").alias("max_repositories"),
    )

    names = F.array(*[F.lit(k) for k in KINDS])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    spans = F.coalesce("_spans", F.expr("cast(array() AS array<struct<start:int,kind:int,end:int>>)"))
    return found.select("_row", "_id").join(per_row, "_row", "left").select(
        F.col("_id").alias(id_col), *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(listed(F.filter(spans, lambda s: s["kind"] < len(BASE))), 256).alias("base_sha256"), listed(spans).alias("spans"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_owned", "n_live", "n_example", "max_owners", "max_repositories")],
    )
