"""Benchmark decontamination by a distributed positional inverted index.

The index has a row per term and shard: the term, the number of the shard's documents with it, and the ascending places of all its occurrences. A shard is a run
of documents of one task, about ``SHARD_WORDS`` words long, laid out one after another with gaps that no match can cross. Files are sorted by term, so that a reader of few terms skips
the rest. The corpus is read once, whatever the size of the benchmark. Only terms of the benchmark are indexed while its texts are below ``block_bytes``, since
others cannot take part in a match; beyond that all terms are.

A test window (13 consecutive words of an item) is looked up from its rarest terms: windows of an item with the same rarest word form one query. In a first round only the posting lists
of rarest and next rarest terms are read; they meet by shard, and offset-adjusted lists are intersected. What is left are candidates (shard, query, place). In a second
round the lists of all words of queries with candidates meet the candidates by shard, and each window is compared in full. A window whose words all stand within ``slop``
words of their places, as seen from the rarest one, is a proximity match; one without any difference is a phrase match.

The benchmark is the stated query set: it is searched in blocks of at most ``block_bytes`` of text, each a broadcast of that size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, text_of, written

WINDOW = 13
#: Terms whose lists are intersected before windows are compared in full.
RAREST = 3
#: Words of a shard, about; free places between its documents, more than a window and its slop reach.
SHARD_WORDS, GAP = 1 << 21, 64
BIG = 1 << 40
#: Bytes that are in words once A-Z are lower case: 0-9, a-z and all of other letters' UTF-8.
_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(data: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8."""
    return data.lower().translate(_WORDS).split() if data else []


class Queries:
    """The benchmark's items as terms, and, once document frequencies are known, as queries."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.ids, self.items, self.terms = [], [], {}
        for item_id, data in items:
            words = words_of(data)
            if words:
                self.ids.append(item_id)
                self.items.append(np.array([self.terms.setdefault(w, len(self.terms)) for w in words], dtype=np.int32))

    def plan(self, frequency: np.ndarray) -> None:
        """Queries (item, rarest place, next rarest shared places, first and last window), windows of the same rarest place together."""
        self.queries = []
        for i, terms in enumerate(self.items):
            n = min(WINDOW, len(terms))
            rarity = frequency[terms].astype(np.int64) * len(terms) + np.arange(len(terms))  # ties: the first
            last = None
            for w in range(len(terms) - n + 1):
                rarest = w + int(np.argmin(rarity[w : w + n]))
                if not frequency[terms[rarest]]:
                    continue  # no document has it
                if last is not None and last[0] == rarest:
                    last[2] = w
                else:
                    last = [rarest, w, w]
                    self.queries.append((i, last, n))
        done = []
        for i, (rarest, first, final), n in self.queries:
            shared = [j for j in range(final, first + n) if j != rarest]
            shared.sort(key=lambda j: (frequency[self.items[i][j]], j))
            done.append((i, rarest, tuple(shared[: RAREST - 1]), first, final, n))
        self.queries = done

    def first_terms(self) -> set[int]:
        return {int(self.items[i][j]) for i, rarest, shared, *_ in self.queries for j in (rarest, *shared)}

    def all_terms(self, queries: list[int]) -> set[int]:
        return {int(x) for k in queries for i, _, _, first, final, n in [self.queries[k]] for x in self.items[i][first : final + n]}


INDEX = "kind int, shard long, term binary, n long, places binary, ord int, n_words long"


def build_index(rows: DataFrame, vocabulary: set[bytes] | None, shard_words: int) -> tuple[DataFrame, DataFrame]:
    """The posting lists (shard, term, n, places) and the documents (shard, ord, _id, n_words) of ``rows`` (_id, _text), written in one pass.

    The empty term, which no text has, lists the first place of each of the shard's documents.
    """
    shared = None if vocabulary is None else rows.sparkSession.sparkContext.broadcast(vocabulary)
    kind = rows.schema["_id"].dataType

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if shared is None else shared.value
        shard = TaskContext.get().partitionId() << 24
        docs, codes, at, names = [], [], GAP, {}
        for batch in slices(batches):
            id_type = batch.column("_id").type
            for doc, data in zip(batch.column("_id").to_pylist(), batch.column("_text").to_pylist()):
                words = words_of(data)
                if known is None:
                    new = set(words).difference(names)
                else:
                    new = known.intersection(words).difference(names)
                names.update(zip(new, range(len(names), len(names) + len(new))))
                codes.append(np.fromiter(map(names.get, words, _absent), dtype=np.int32, count=len(words)))
                docs.append((doc, at, len(words)))
                at += len(words) + GAP
                if at >= shard_words:
                    yield from rows_of(shard, docs, codes, names, id_type)
                    shard, docs, codes, at, names = shard + 1, [], [], GAP, {}
        if docs:
            yield from rows_of(shard, docs, codes, names, id_type)

    def rows_of(shard: int, docs: list, codes: list, names: dict, id_type) -> Iterator[pa.RecordBatch]:
        n = len(docs)
        base = np.array([d[1] for d in docs], dtype="<i4")
        columns = [pa.array([0] * n, pa.int32()), pa.array([shard] * n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(range(n), pa.int32()), pa.array([d[2] for d in docs], pa.int64()), pa.array([d[0] for d in docs], id_type)]
        yield pa.RecordBatch.from_arrays(columns, header)
        code = np.concatenate(codes)
        doc = np.repeat(np.arange(n, dtype=np.int32), [len(c) for c in codes])
        place = np.concatenate([np.arange(b, b + len(c), dtype="<i4") for b, c in zip(base.tolist(), codes)])
        have = code >= 0
        code, doc, place = code[have], doc[have], place[have]
        order = np.argsort(code, kind="stable")
        code, doc, place = code[order], doc[order], place[order]
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        fresh = np.ones(len(code), dtype=np.int64)
        fresh[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
        own = list(names)  # in the order of their codes, all of which occur
        terms = [b"", *own]
        lists = np.concatenate([base, place]).astype("<i4")
        offsets = np.concatenate([[0], n + starts, [len(lists)]]).astype(np.int32) * 4
        places = pa.Array.from_buffers(pa.binary(), len(terms), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(lists.tobytes())])
        counts = np.concatenate([[n], np.add.reduceat(fresh, starts) if len(starts) else []]).astype(np.int64)
        k = len(terms)
        columns = [pa.array([1] * k, pa.int32()), pa.array([shard] * k, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts), places, pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, id_type)]
        yield pa.RecordBatch.from_arrays(columns, header)

    schema = T._parse_datatype_string(INDEX).add("_id", kind)
    header = schema.names
    index = written(rows.select("_id", "_text").mapInArrow(build, schema).sortWithinPartitions("kind", "term", "shard"), "index")
    return index.filter("kind = 1").select("shard", "term", "n", "places"), index.filter("kind = 0").select("shard", "ord", "_id", "n_words")


class _Absent:
    """An endless iterable of -1."""

    def __iter__(self):
        return self

    def __next__(self):
        return -1


_absent = _Absent()


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, np.ndarray], list[tuple[int, int]]]]:
    """(shard, lists by code, candidates) of consecutive rows (shard, code, places, query, at)."""
    last, lists, candidates = None, {}, []
    for batch in batches:
        for shard, code, places, query, at in zip(*(batch.column(c).to_pylist() for c in ("shard", "code", "places", "query", "at"))):
            if shard != last:
                if last is not None:
                    yield last, lists, candidates
                last, lists, candidates = shard, {}, []
            if places is not None:
                lists[code] = np.frombuffer(places, dtype="<i4").astype(np.int64)
            else:
                candidates.append((query, at))
    if last is not None:
        yield last, lists, candidates


def _within(places: np.ndarray | None, want: np.ndarray, slop: int) -> np.ndarray:
    """Whether a place is within ``slop`` of each wanted one."""
    if places is None:
        return np.zeros(len(want), dtype=bool)
    return np.searchsorted(places, want + slop, "right") > np.searchsorted(places, want - slop)


def candidates_of(q: Queries, lists: dict[int, np.ndarray], slop: int) -> Iterator[tuple[int, np.ndarray]]:
    """(query, places where the item's first word would be) after the rarest lists have been intersected."""
    for k, (i, rarest, shared, *_) in enumerate(q.queries):
        at = lists.get(int(q.items[i][rarest]))
        if at is None:
            continue
        at = at - rarest
        for j in shared:
            at = at[_within(lists.get(int(q.items[i][j])), at + j, slop)]
            if not len(at):
                break
        else:
            yield k, at


def matches_of(q: Queries, lists: dict[int, np.ndarray], candidates: list[tuple[int, int]], slop: int) -> Iterator[tuple[int, int, int, int, bool]]:
    """(document, start, end, item, whether exact) of all windows of the candidates that match, by whole words."""
    base = lists[-1]
    found = np.array(sorted(candidates), dtype=np.int64)
    for part in np.split(found, np.flatnonzero(np.diff(found[:, 0])) + 1):
        i, rarest, _, first, final, n = q.queries[int(part[0, 0])]
        at, item = part[:, 1], q.items[i]
        span = range(first, final + n)
        doc = np.searchsorted(base, at + rarest, "right") - 1
        for reach in {0, slop}:
            same = np.array([_within(lists.get(int(item[j])), at + j, reach) if j != rarest else np.ones(len(at), dtype=bool) for j in span], dtype=np.int32).T
            run = np.cumsum(np.concatenate([np.zeros((len(at), 1), np.int32), same], axis=1), axis=1)
            hit, window = np.nonzero(run[:, n:] - run[:, :-n] == n)
            start = at[hit] + first + window - base[doc[hit]]
            for d, s in zip(doc[hit].tolist(), start.tolist()):
                yield d, s, s + n, i, reach == 0


def _search(index: DataFrame, q: Queries, slop: int) -> DataFrame:
    """(shard, ord, start, end, item, exact): all matches of a block's queries."""
    spark = index.sparkSession
    names = list(q.terms)

    def lists(codes: set[int]) -> DataFrame:
        # at most as many bytes as the block's text; the empty term comes along
        table = pa.table({"term": pa.array([b"", *(names[c] for c in sorted(codes))], pa.binary()), "code": pa.array([-1, *sorted(codes)], pa.int32())})
        return index.select("shard", "term", "places").join(F.broadcast(spark.createDataFrame(table)), "term").select("shard", "code", "places", F.lit(None).cast("int").alias("query"), F.lit(None).cast("long").alias("at"))

    block = spark.createDataFrame(pa.table({"term": pa.array(names, pa.binary()), "code": pa.array(range(len(names)), pa.int32())}))
    frequency = np.zeros(len(names), dtype=np.int64)
    for r in index.select("term", "n").join(F.broadcast(block), "term").groupBy("code").agg(F.sum("n").alias("n")).toLocalIterator():
        frequency[r.code] = r.n
    q.plan(frequency)
    shared = spark.sparkContext.broadcast(q)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, own, _ in _by_shard(batches):
            for k, at in candidates_of(shared.value, own, slop):
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(at), pa.int64()), pa.array([k] * len(at), pa.int32()), pa.array(at)], ["shard", "query", "at"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, own, candidates in _by_shard(batches):
            if candidates:
                rows = list(matches_of(shared.value, own, candidates, slop))
                columns = list(zip(*rows)) or [[]] * 5
                ids = [shared.value.ids[i] for i in columns[3]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(rows), pa.int64()), *(pa.array(columns[c], pa.int32()) for c in range(3)), pa.array(ids, pa.string()), pa.array(columns[4], pa.bool_())],
                    ["shard", "ord", "start", "end", "item", "exact"],
                )

    meet = lambda df: df.repartition("shard").sortWithinPartitions("shard", "code")
    candidates = written(meet(lists(q.first_terms())).mapInArrow(first, "shard long, query int, at long"), "candidates")
    with_some = [r[0] for r in candidates.select("query").distinct().toLocalIterator()]  # at most one for each window of the block
    asked = candidates.select("shard", F.lit(None).cast("int").alias("code"), F.lit(None).cast("binary").alias("places"), "query", "at")
    return meet(lists(q.all_terms(with_some)).unionByName(asked)).mapInArrow(second, "shard long, ord int, start int, end int, item string, exact boolean")


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", slop: int = 3, block_bytes: int = 8 << 20, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """One row per input row: id, n_words, matches array<struct<start, end, item>>, near_items array<string>.

    ``matches`` are all windows that occur, as word places (end exclusive); ``near_items`` have a proximity match, exact ones among them. Null ids of items count as "". Items without
    words, and documents without words, match nothing. Rows that repeat, and rows with null ids, have their own matches each. An empty table gives no rows. Other columns are ignored.
    """
    if not 0 <= slop < GAP - 2 * WINDOW:
        raise ValueError(f"slop must be below {GAP - 2 * WINDOW}")
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).cast("binary").alias("_text"))
    items = written(benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), text_of().alias("text")).distinct(), "items")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    blocks = max(1, -(-size // block_bytes))

    def block(b: int) -> Queries:
        # of a size that has just been checked
        own = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).orderBy("item", "text").collect()
        return Queries([(r.item, r.text.encode()) for r in own])

    only = block(0) if blocks == 1 else None
    index, documents = build_index(rows, set(only.terms) if only else None, shard_words)
    found = None
    for b in range(blocks):
        part = written(_search(index, only or block(b), slop), "matches")
        found = part if found is None else found.unionByName(part)
    place = F.struct("start", "end", "item")
    found = found.groupBy("shard", "ord").agg(F.sort_array(F.collect_set(F.when(F.col("exact"), place))).alias("matches"), F.sort_array(F.collect_set("item")).alias("near_items"))
    out = documents.join(found, ["shard", "ord"], "left")
    none = F.expr("cast(array() AS array<struct<start:int,end:int,item:string>>)"), F.expr("cast(array() AS array<string>)")
    return out.select(F.col("_id").alias(id_col), "n_words", F.coalesce("matches", none[0]).alias("matches"), F.coalesce("near_items", none[1]).alias("near_items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per input row: id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items.

    A word is hit where a window of an item covers it; contaminated is n_hit > 0 and 20 * n_hit >= n_words. ``items_sha256`` is the SHA-256 of the
    ids of items with matches, as strings in order, comma-joined. Options and edge cases: see ``benchmark_matches``.
    """
    found = benchmark_matches(docs, benchmark, id_col, **options)
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"])))
    # matches are sorted by start: each adds what lies beyond the ones before it
    zero = F.expr("named_struct('n', 0, 'reach', 0)")
    fold = F.aggregate(F.array_sort("matches"), zero, lambda a, m: F.struct((a["n"] + F.greatest(F.lit(0), m["end"] - F.greatest(m["start"], a["reach"]))).alias("n"), F.greatest(a["reach"], m["end"]).alias("reach")))
    out = found.select(F.col(id_col), "n_words", fold["n"].cast("long").alias("n_hit"), ids.alias("_items"), F.size("near_items").cast("long").alias("n_near_items"))
    return out.select(
        id_col, "n_words", "n_hit", F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "n_near_items",
    )
