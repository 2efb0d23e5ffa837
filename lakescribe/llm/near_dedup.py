"""MinHash near-dedup with sequential Bayesian verification.

1. Each document's set of five-word shingles becomes 64-bit hashes, of which a signature of 128 minima of 16 bits and a 128-bit digest are
   kept. Documents of equal digests are one class; only its representative (the least id) goes on.
2. A band is four minima; representatives that agree in a band meet in a bucket. Buckets of equal members are one.
3. In a bucket, pairs are compared by batches of 32 minima. With a uniform prior the posterior probability that a pair's similarity reaches the threshold is a binomial
   tail; a pair is given up as soon as that is less than ``miss``. What survives in a bucket is reported as a spanning forest, never as pairs.
4. Survivors' components are families. Full sets of a family's members are sent to its tasks, where surviving pairs are verified exactly, the likeliest first, and pairs that are
   connected already are left out; a task reports a spanning forest of links.
5. Components of the links, joined with classes, are the answer.

Buckets and families of more than ``block`` members are dealt to chunks of about that size, and to each chunk come ``PIVOTS`` members of the whole group besides. All pairs of a
chunk are compared. Where that leaves a group in several parts, the members outside its largest part, and only these, meet all members that are not in their own part, again by
chunks. So a group of copies is sent about once, what has been connected is not compared again, and every pair has met or is connected at the end. Nothing is capped or left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import salts_for, slices, text_of, written
from .components import components

SHINGLE = 5
MINIMA, ROWS, BATCH = 128, 4, 32
BANDS = MINIMA // ROWS
KEPT_WORDS = 100_000
#: Members of a group of several chunks that come to each of its chunks, on average.
PIVOTS = 16
_rng = np.random.default_rng(20)
_PLACE = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _rng.integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_C = _rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64)


class _Words(dict):
    """64-bit hashes of words; a bounded table of the worker."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word)
        if len(self) < KEPT_WORDS and len(word) <= 40:
            self[word] = h
        return h


_hash_of = _Words()


def shingle_set(data: bytes | None) -> np.ndarray:
    """Ascending distinct 64-bit hashes of a text's shingles: five words each, or all words where there are fewer."""
    words = data.lower().split() if data else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hash_of.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(SHINGLE, len(h))
    s = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        s += h[i : len(h) - n + 1 + i] * _PLACE[i]
    s ^= s >> np.uint64(31)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(29)
    return np.unique(s)


def signature(s: np.ndarray) -> np.ndarray:
    """MINIMA minima of 16 bits of a set of hashes that is not empty."""
    least = None
    for i in range(0, len(s), 512):
        m = ((s[i : i + 512, None] * _A + _C) >> np.uint64(32)).min(0)
        least = m if least is None else np.minimum(least, m)
    return least.astype("<u2")


@lru_cache(maxsize=8)
def least_matches(threshold: float, miss: float) -> tuple[int, ...]:
    """For each batch boundary, the matches from which a pair goes on.

    After k of m matches and with a uniform prior, P(similarity >= t) = P(Binomial(m + 1, t) <= k).
    """
    out = []
    for m in range(BATCH, MINIMA + 1, BATCH):
        tail, k = 0.0, 0
        while True:
            tail += math.comb(m + 1, k) * threshold**k * (1 - threshold) ** (m + 1 - k)
            if tail >= miss:
                break
            k += 1
        out.append(k)
    return tuple(out)


def survivors(sig: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, miss: float, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (x in left, y in right, matches) that sizes and signatures leave possible, most matches first; each unordered pair of members once. Pairs of one ``part`` are left out."""
    needed = least_matches(threshold, miss)
    found = []
    same = left is right
    step = max(1, (1 << 16) // max(1, len(right)))
    for i in range(0, len(left), step):
        a, b = np.repeat(left[i : i + step], len(right)), np.tile(right, len(left[i : i + step]))
        if same:
            keep = a < b
            a, b = a[keep], b[keep]
        if part is not None:
            keep = part[a] != part[b]
            a, b = a[keep], b[keep]
        # the union has at least the larger set's size, the intersection at most the smaller's
        keep = np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b]) - 1e-9
        a, b = a[keep], b[keep]
        matches = np.zeros(len(a), dtype=np.int32)
        for k, least in enumerate(needed):
            batch = slice(k * BATCH, (k + 1) * BATCH)
            matches += (sig[a, batch] == sig[b, batch]).sum(1, dtype=np.int32)
            keep = matches >= least
            a, b, matches = a[keep], b[keep], matches[keep]
        found.append((a, b, matches))
    a, b, matches = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(3))
    order = np.argsort(-matches, kind="stable")
    return a[order], b[order], matches[order]


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether the two were apart."""
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    forest = Forest(n)
    return [(x, y) for x, y in zip(a.tolist(), b.tolist()) if forest.join(x, y)]


def verified(sets: list[np.ndarray], sig: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, miss: float, part: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the exact links between members of ``left`` and ``right``; members of one ``part`` are connected already."""
    a, b, _ = survivors(sig, n, left, right, threshold, miss, part)
    percent = round(threshold * 100)
    forest, links = Forest(len(n)), []
    if part is not None:
        for members in np.split(np.argsort(part, kind="stable"), np.flatnonzero(np.diff(np.sort(part))) + 1):
            for i in members[1:].tolist():
                forest.join(int(members[0]), i)
    at = 0
    while at < len(a):
        # a chunk is taken at a time, without the pairs that earlier links connect
        x, y = a[at : at + 4096], b[at : at + 4096]
        at += 4096
        roots = np.array([forest.root(i) for i in range(len(n))])
        apart = roots[x] != roots[y]
        x, y = x[apart], y[apart]
        for i, j in zip(x.tolist(), y.tolist()):
            if forest.root(i) == forest.root(j):
                continue
            both = common(sets[i], sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                forest.join(i, j)
                links.append((i, j))
    return links


def common(s: np.ndarray, t: np.ndarray) -> int:
    """Members of both ascending sets."""
    if len(s) > len(t):
        s, t = t, s
    at = np.searchsorted(t, s)
    at[at == len(t)] = 0
    return int((t[at] == s).sum())


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]):
    """Lists of the columns of consecutive rows with equal keys; one group is held at a time."""
    last, group = None, None
    for batch in slices(batches):
        key_columns = [batch.column(k).to_pylist() for k in keys]
        data = [batch.column(c).to_pylist() for c in columns]
        for i, key in enumerate(zip(*key_columns)):
            if key != last:
                if group is not None:
                    yield last, group
                last, group = key, [[] for _ in columns]
            for column, values in zip(group, data):
                column.append(values[i])
    if group is not None:
        yield last, group


def own_chunk(size: str, block: int):
    """The chunk of a group of ``size`` members that a member is dealt to."""
    return F.pmod(F.xxhash64("_id", F.lit(77)), F.ceil(F.col(size) / block)).cast("int")


def first_chunks(members: DataFrame, block: int, pivots: int = PIVOTS) -> DataFrame:
    """Rows (key, _id, _size, ...) with _chunk and _pivot: each in a chunk of its group, pivots of groups of several chunks in all of these."""
    pivot = (F.col("_size") > block) & (F.pmod(F.xxhash64("_id", F.lit(78)), F.col("_size")) < pivots)
    chunks = F.when(F.col("_pivot"), F.sequence(F.lit(0), F.ceil(F.col("_size") / block).cast("int") - 1)).otherwise(F.array(own_chunk("_size", block)))
    return members.withColumn("_pivot", pivot).withColumn("_chunk", F.explode(chunks))


def second_chunks(large: DataFrame, key: str, block: int) -> DataFrame:
    """Rows (key, _id, _size, _part) of groups of several chunks, where _part is what the first pass has connected: those of groups in several parts, with _rest, _chunk and _other.

    Members outside their group's largest part are its rest (_rest 1), in chunks of their own; a chunk of the rest meets each chunk of all members (_rest 0). Groups in one part have no rows.
    """
    large = large.withColumn("_own", own_chunk("_size", block))
    counts = large.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"), F.max("_size").alias("_size"))
    several = counts.groupBy(key).agg(F.max(F.struct("_n", "_part")).alias("_most"), F.sum("_n").alias("_all"), F.max("_size").alias("_size")).filter("_most._n < _all")
    chunks = F.ceil(F.col("_size") / block).cast("int")
    several = several.select(F.col(key), F.col("_most._part").alias("_largest"), chunks.alias("_chunks"), F.ceil((F.col("_all") - F.col("_most._n")) / block).cast("int").alias("_rests"))
    # a group's row goes to each of its chunks, so that no task meets a whole group
    rows = large.join(several.withColumn("_own", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))), [key, "_own"])
    one, every = lambda c: F.array(c), lambda into: F.sequence(F.lit(0), F.col(into) - 1)
    side = lambda df, rest, chunk, other: df.withColumn("_rest", F.lit(rest)).withColumn("_chunk", F.explode(chunk)).withColumn("_other", F.explode(other))
    met = side(rows, 0, one(F.col("_own")), every("_rests")).unionByName(side(rows.filter("_part <> _largest"), 1, every("_chunks"), one(F.pmod(F.xxhash64("_id", F.lit(79)), F.col("_rests")).cast("int"))))
    return met.drop("_own", "_largest", "_chunks", "_rests")


LINK, LABEL, SAME = 0, 1, 2
FOUND = "kind int, grp long, size long, a long, b long"


def _found(rows) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["kind", "grp", "size", "a", "b"])


def roots_of(links: list[tuple[int, int]], n: int) -> list[int]:
    """The least member of each member's component; members are in the order of their ids."""
    forest = Forest(n)
    for x, y in links:
        forest.join(x, y)
    return [forest.root(i) for i in range(n)]


def parts_of_chunk(group: int, size: int, ids: list[int], pivot: list[bool], roots: list[int]) -> list[tuple]:
    """What a chunk of a group of several chunks says of its members' parts: the least pivot of a member's component in the chunk, else the least member, and which pivots are in one part."""
    pivots: dict[int, list[int]] = {}
    least: dict[int, int] = {}
    for i, r in enumerate(roots):
        least[r] = min(least.get(r, ids[i]), ids[i])
        if pivot[i]:
            pivots.setdefault(r, []).append(ids[i])
    out = [(LABEL, group, size, ids[i], min(pivots[r]) if r in pivots else least[r]) for i, r in enumerate(roots) if not pivot[i]]
    return out + [(SAME, group, size, p, min(own)) for own in pivots.values() for p in own]


def labelled_parts(found: DataFrame) -> DataFrame:
    """(grp, _id, _size, _part) of all members of groups of several chunks, from what their chunks say."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (groups, sizes, a, b) in _grouped(batches, ["grp"], ["grp", "size", "a", "b"]):
            ids = sorted({*a, *b})
            at = {x: i for i, x in enumerate(ids)}
            forest = Forest(len(ids))
            for x, y in zip(a, b):
                forest.join(at[x], at[y])
            yield _found([(SAME, groups[0], sizes[0], x, ids[forest.root(i)]) for i, x in enumerate(ids)])

    # a group has few pivots, however many members
    same = found.filter(F.col("kind") == SAME).select("grp", "size", "a", "b").distinct().repartition("grp").sortWithinPartitions("grp")
    pivots = written(same.mapInArrow(close, FOUND), "pivots").select("grp", "size", "a", "b")
    root = pivots.select("grp", F.col("a").alias("b"), F.col("b").alias("_root"))
    members = found.filter(F.col("kind") == LABEL).select("grp", "size", "a", "b").join(root, ["grp", "b"], "left").select("grp", "size", "a", F.coalesce("_root", "b").alias("b"))
    return members.unionByName(pivots).toDF("grp", "_size", "_id", "_part")


def connected(members: DataFrame, key: str, payload: DataFrame, links_of, block: int) -> DataFrame:
    """Links (a, b) that connect all members (key, _id, _size) of each group whose pairs ``links_of`` links, in two passes.

    ``links_of(columns of one task, left, right, part)`` are places of linked members; ``payload`` has the columns (_id, ...) that it needs.
    """
    columns = payload.columns
    members = members.withColumnRenamed(key, "grp")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[tuple] = set()
        for (group, _), own in _grouped(batches, ["grp", "_chunk"], [*columns, "_size", "_pivot"]):
            pivot, sizes = own.pop(), own.pop()
            ids, everyone = own[0], np.arange(len(own[0]))
            # a task's components are reported as stars, each member linked to the least one, which takes fewer rounds to put together than chains
            roots = roots_of(links_of(own, everyone, everyone, None), len(ids))
            out.update((LINK, 0, 0, ids[i], ids[r]) for i, r in enumerate(roots) if i != r)
            if sizes[0] > block:
                out.update(parts_of_chunk(group, sizes[0], ids, pivot, roots))
            if len(out) > 50_000:
                yield _found(out)
                out.clear()
        yield _found(out)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _grouped(batches, ["grp", "_chunk", "_other"], [*columns, "_part", "_rest"]):
            rest, part = np.array(own.pop()), np.array(own.pop())
            ids = own[0]
            roots = roots_of(links_of(own, np.flatnonzero(rest == 1), np.flatnonzero(rest == 0), part), len(ids))
            yield _edges([(ids[i], ids[r]) for i, r in enumerate(roots) if ids[i] != ids[r]])

    dealt = first_chunks(members.join(payload, "_id"), block).repartition("grp", "_chunk").sortWithinPartitions("grp", "_chunk", "_id")
    found = written(dealt.select("grp", "_chunk", *columns, "_size", "_pivot").mapInArrow(first, FOUND), "links")
    links = found.filter(F.col("kind") == LINK).select("a", "b")
    if not found.filter(F.col("kind") != LINK).head(1):
        return links
    again = second_chunks(written(labelled_parts(found), "parts"), "grp", block).join(payload, "_id").repartition("grp", "_chunk", "_other").sortWithinPartitions("grp", "_chunk", "_other", "_id")
    return links.unionByName(again.select("grp", "_chunk", "_other", *columns, "_part", "_rest").mapInArrow(second, "a long, b long"))


def signatures(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, n, k1, k2, sig): set size, 128-bit digest of the set, and the bands of the signature as 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches):
            n, digests, sigs = [], [], []
            for data in batch.column("_text").to_pylist():
                s = shingle_set(data)
                n.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                sigs.append(signature(s).view("<i8").tolist() if len(s) else None)
            d = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(sigs, pa.list_(pa.int64()))], ["_id", "n", "k1", "k2", "sig"]
            )

    rows = df.select(F.col(id_col).alias("_id"), text_of(text_col).cast("binary").alias("_text"))
    fields = [rows.schema["_id"]] + [T.StructField(c, T.LongType()) for c in ("n", "k1", "k2")] + [T.StructField("sig", T.ArrayType(T.LongType()))]
    return rows.mapInArrow(run, T.StructType(fields))


def candidate_forest(nodes: DataFrame, threshold: float, miss: float, block: int) -> DataFrame:
    """Links (a, b) that connect all pairs of ``nodes`` (_id, n, sig) which share a band and survive the signatures."""
    banded = nodes.select("_id", F.posexplode("sig").alias("_band", "_key")).select("_id", F.xxhash64("_band", "_key").alias("_bucket"))
    h1, h2 = F.xxhash64("_id", F.lit(1)), F.xxhash64("_id", F.lit(2))
    buckets = banded.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"), F.bit_xor(h1).alias("_x1"), F.bit_xor(h2).alias("_x2")).filter("_size > 1")
    # buckets of equal members (by size and a 128-bit fingerprint) do the same work: one of them is enough
    buckets = buckets.groupBy("_size", "_x1", "_x2").agg(F.min("_bucket").alias("_bucket")).select("_bucket", "_size")
    members = written(banded.join(buckets, "_bucket"), "members")

    def links_of(group, left, right, part):
        ids, n, sig = group
        a, b, _ = survivors(np.array(sig, dtype="<i8").view("<u2"), np.array(n), left, right, threshold, miss, part)
        return spanning(a, b, len(ids))

    return connected(members, "_bucket", nodes.select("_id", "n", "sig"), links_of, block)


def _edges(pairs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def exact_links(df: DataFrame, families: DataFrame, id_col: str, text_col: str, threshold: float, miss: float, block: int) -> DataFrame:
    """Links (a, b), a spanning forest of all pairs of a family that survive the signatures and whose full sets reach the threshold."""
    sizes = families.groupBy("component").agg(F.count(F.lit(1)).alias("_size"))
    families = written(families.join(sizes, "component").select(F.col("node").alias("_id"), "component", "_size"), "families")
    # each text moves once, at every size: texts and members of families meet by a shuffle on the id
    texts = df.select(F.col(id_col).alias("_id"), text_of(text_col).cast("binary").alias("_text")).filter("_id IS NOT NULL").join(families.select("_id").hint("shuffle_hash"), "_id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = [shingle_set(x) for x in batch.column("_text").to_pylist()]
            sig = [signature(x).tobytes() if len(x) else b"\0" * 2 * MINIMA for x in s]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(sig, pa.binary()), pa.array([x.tobytes() for x in s], pa.binary())], ["_id", "sig", "set"])

    with_sets = written(texts.mapInArrow(sets, "_id long, sig binary, set binary"), "sets", codec="uncompressed")

    def links_of(group, left, right, part):
        _, sig, data = group
        table = np.frombuffer(b"".join(sig), dtype="<u2").reshape(-1, MINIMA)
        s = [np.frombuffer(x, dtype=np.uint64) for x in data]
        return verified(s, table, np.array([len(x) for x in s]), left, right, threshold, miss, part)

    return connected(families, "component", with_sets, links_of, block)


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.75, miss: float = 1e-6, block: int = 256, salts: int | None = None,
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Linked are documents of which 100 * intersection >= 100 * ``threshold`` * union holds for their shingle sets (lower-cased A-Z, words between white space).
    A document without words, or with a null text, has an empty set and is linked with nothing. component_id is the least id reachable, the own one included; kept is id = component_id.
    Ids are integers. Rows that repeat an id are one document with all their texts' links; rows with a null id are kept, with a null component.
    An empty table gives no rows. Other columns are ignored.
    """
    table = written(signatures(df.withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col), "signatures")
    salts = salts_for(table.count()) if salts is None else salts
    classed = table.filter("n > 0 AND _id IS NOT NULL").withColumn("_salt", F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(salts)).cast("int"))
    partial = classed.groupBy("k1", "k2", "n", "_salt").agg(F.min("_id").alias("_least"))
    classes = partial.groupBy("k1", "k2", "n").agg(F.min("_least").alias("_rep"))
    nodes = written(classed.select("_id", "n", "k1", "k2", "sig").join(classes.withColumnRenamed("_rep", "_id"), ["_id", "k1", "k2", "n"]).select("_id", "n", "sig").dropDuplicates(["_id", "n", "sig"]), "nodes")

    families = components(candidate_forest(nodes, threshold, miss, block))
    links = exact_links(df.withColumn(id_col, F.col(id_col).cast("long")), families, id_col, text_col, threshold, miss, block)
    found = components(links)

    reached = classes.join(found, F.col("_rep") == F.col("node"), "left").select("k1", "k2", "n", F.coalesce("component", "_rep").alias("_component"))
    down = partial.select("k1", "k2", "n", "_salt").join(reached, ["k1", "k2", "n"])
    linked = classed.select("_id", "n", "k1", "k2", "_salt").join(down, ["k1", "k2", "n", "_salt"]).select("_id", "n", "_component")
    alone = table.filter("n = 0 OR _id IS NULL").select("_id", "n", F.col("_id").alias("_component"))
    return linked.unionByName(alone).select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("_component").alias("component_id"), F.col("_id").eqNullSafe(F.col("_component")).alias("kept")
    )
