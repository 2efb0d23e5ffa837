"""Closed frequent itemsets and their rules, by prefix-preserving closure extension.

Items are ranked by support, the rarest first, so that the items that most baskets hold have few that come after them. A closed set is found by its *stem*, its first item in that
order: the stem's conditional database has, for each basket with the stem, the items after it (what sets may grow by) and those before it (what must not be common to all baskets of a
set, or the set belongs to another stem). Occurrence delivery: one pass over the baskets hands each to the stems of its items, and baskets that agree in the items after a stem are merged at
once, their counts added and the items before it intersected. Each stem's database is then mined depth-first by itself; a closed set comes from one stem, so no results are kept to
compare with.

Where rows go: lines meet their item's row on (item, salt), databases go by stem. A stem whose merged database has more than ``heavy`` entries is split again: it is delivered to the
stems of two items, then three, until none is heavy; whether the split stem itself is closed is counted beside that. Baskets far larger than others (fewer of them than the least support)
are never gathered: a pair of items that is frequent with them is in an ordinary basket too, so their rows meet the pairs of ordinary baskets, and only the items that can matter for a stem go
to its database. The driver gets the number of baskets, sizes by powers of two and whether a stem is heavy; nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salts_for, written

LONGS = pa.list_(pa.int64())
DATABASE = "stem array<long>, suffix array<long>, before array<long>, weight long"


def _meet(rows: DataFrame, side: DataFrame, key: str, by: str, salts: int) -> DataFrame:
    """``rows`` with the rows of ``side`` that have their ``key``. A key is dealt to ``salts`` parts by ``by``; its rows of ``side`` go to the parts that there are."""
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(by, F.lit(7)), F.lit(salts)).cast("int"))
    parts = rows.select(key, "_salt").distinct().join(side.hint("merge"), key)
    return rows.join(parts.hint("shuffle_hash"), [key, "_salt"]).drop("_salt")


class Merged:
    """Entries of conditional databases, those with equal stem and suffix merged."""

    def __init__(self):
        self.entries: dict = {}

    def deliver(self, stem: tuple, suffix: list, before: frozenset, weight: int) -> None:
        """A basket, or a merged entry of a stem, handed to the stems that are one item longer."""
        for k, x in enumerate(suffix):
            self.add((*stem, x), tuple(suffix[k + 1 :]), before.union(suffix[:k]), weight)

    def add(self, stem: tuple, suffix: tuple, before: frozenset, weight: int) -> None:
        found = self.entries.get((stem, suffix))
        if found is None:
            self.entries[stem, suffix] = [weight, before]
        else:
            found[0] += weight
            found[1] &= before

    def batch(self) -> pa.RecordBatch:
        keys, values = list(self.entries), list(self.entries.values())
        self.entries = {}
        columns = [pa.array([k[0] for k in keys], LONGS), pa.array([k[1] for k in keys], LONGS), pa.array([sorted(v[1]) for v in values], LONGS), pa.array([v[0] for v in values], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["stem", "suffix", "before", "weight"])


def _delivered(batches, most: int = 200_000):
    """Entries (stem, suffix, before, weight) handed on and merged, at most ``most`` (and one entry's) at a time."""
    merged = Merged()
    for batch in batches:
        for part in (batch.slice(at, 5000) for at in range(0, batch.num_rows, 5000)):
            for stem, suffix, before, weight in zip(*(part.column(c).to_pylist() for c in ("stem", "suffix", "before", "weight"))):
                merged.deliver(tuple(stem), suffix, frozenset(before), weight)
                if len(merged.entries) >= most:
                    yield merged.batch()
    if merged.entries:
        yield merged.batch()


def mine(stem: tuple, entries: list[tuple[tuple, frozenset, int]], least: int) -> Iterator[tuple[list, int]]:
    """(items, support) of the closed sets with this stem, from its merged database [(suffix, before, weight)]."""
    stack = [(list(stem), entries)]
    while stack:
        items, entries = stack.pop()
        total = sum(e[2] for e in entries)
        if total < least:
            continue
        common = entries[0][1]
        for e in entries:
            common = common & e[1]
            if not common:
                break
        if common:
            continue  # an earlier item is in all baskets: the set and all that grow from it have another stem
        counts: dict = {}
        for suffix, _, weight in entries:
            for x in suffix:
                counts[x] = counts.get(x, 0) + weight
        closed = sorted(items + [x for x, n in counts.items() if n == total])
        yield closed, total
        grows = {x for x, n in counts.items() if least <= n < total}
        if not grows:
            continue
        merged = Merged()
        for suffix, before, weight in entries:
            if rest := [x for x in suffix if x in grows]:
                merged.deliver((), rest, before, weight)
        databases: dict = {}
        for ((x,), suffix), (weight, before) in merged.entries.items():
            databases.setdefault(x, []).append((suffix, before, weight))
        stack += [(closed + [x], rows) for x, rows in databases.items()]


def _by_stem(batches):
    """(stem, entries, questions) of the rows of each stem, which come together, entries before questions. Entries are merged; questions are an iterator."""

    def rows():
        for batch in batches:
            for part in (batch.slice(at, 5000) for at in range(0, batch.num_rows, 5000)):
                ask = part.column("ask").to_pylist() if "ask" in part.schema.names else [None] * part.num_rows
                yield from zip(*(part.column(c).to_pylist() for c in ("stem", "suffix", "before", "weight")), ask)

    row, source = None, rows()

    def step():
        nonlocal row
        row = next(source, None)

    step()
    while row is not None:
        stem, merged = row[0], Merged()
        while row is not None and row[0] == stem and row[4] is None:
            merged.add((), tuple(row[1]), frozenset(row[2]), row[3])
            step()

        def asked(stem=stem):
            while row is not None and row[0] == stem:
                yield row[4]
                step()

        yield tuple(stem), [(suffix, before, weight) for (_, suffix), (weight, before) in merged.entries.items()], asked()
        while row is not None and row[0] == stem:
            step()


def _mined(least: int):
    def run(batches):
        found: list = []

        def made():
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], LONGS), pa.array([f[1] for f in found], pa.int64())], ["ranks", "support"])

        for stem, entries, _ in _by_stem(batches):
            for one in mine(stem, entries, least) if entries else ():
                found.append(one)
                if len(found) >= 10_000:
                    yield made()
                    found = []
        if found:
            yield made()

    return run


def _counted(batches):
    """(ask, a): how many baskets hold all items of each question, by the database of its stem. A stem without a database answers nothing."""
    answers: list = []

    def made():
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in answers], LONGS), pa.array([x[1] for x in answers], pa.int64())], ["ask", "a"])

    for stem, entries, questions in _by_stem(batches):
        if not entries:
            continue
        places: dict = {}
        for k, (suffix, _, _) in enumerate(entries):
            for x in suffix:
                places.setdefault(x, set()).add(k)
        for ask in questions:
            lists = sorted((places.get(x, set()) for x in ask[len(stem) :]), key=len)
            n = sum(entries[k][2] for k in set.intersection(*lists)) if lists else sum(e[2] for e in entries)
            answers.append((ask, n))
            if len(answers) >= 10_000:
                yield made()
                answers = []
    if answers:
        yield made()


class Itemsets:
    """The databases of one table: ``items`` (rank, item, support), ``leaves`` (databases that are mined), ``split`` (heavy stems with support and whether closed)."""

    def __init__(self, lines: DataFrame, basket_col: str, item_col: str, least: int, share: int, heavy: int, ordinary: int):
        spark = lines.sparkSession
        rows = lines.filter(F.col(basket_col).isNotNull() & F.col(item_col).isNotNull()).select(F.col(basket_col).alias("basket"), F.col(item_col).alias("item"))
        self.baskets = rows.select("basket").distinct().count()
        self.least = max(least, -(-self.baskets // share))
        self.salts = salts_for(lines.count(), least=16)
        self.parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), self.salts)
        self.heavy = heavy
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64("basket", F.lit(7)), F.lit(self.salts)).cast("int"))
        counted = written(salted.groupBy("item", "_salt").agg(F.count("*").alias("_n")), "item-lines")
        often = counted.groupBy("item").agg(F.sum("_n").alias("_n")).filter(F.col("_n") >= self.least).select("item")  # as many lines at least as baskets
        often = counted.select("item", "_salt").join(often.hint("shuffle_hash"), "item")
        rows = written(salted.join(often.hint("shuffle_hash"), ["item", "_salt"]).select("basket", "item").distinct(), "basket-items")
        supports = rows.groupBy("item").agg(F.count("*").alias("support")).filter(F.col("support") >= self.least)
        self.items = written(supports.orderBy("support", "item").withColumn("rank", F.monotonically_increasing_id()), "ranked-items")  # ascending in that order
        rows = written(_meet(rows, self.items.select("item", "rank"), "item", "basket", self.salts).select("basket", "rank"), "basket-ranks")
        sizes = rows.groupBy("basket").agg(F.count("*").alias("n"))
        limit = self._limit(sizes, ordinary)
        giants = written(sizes.filter(F.col("n") > limit).select("basket"), "giants")
        huge = giants.count()
        rest = rows
        if huge:
            marked = written(_meet_left(rows, giants, self.salts), "marked")
            rest = marked.filter("NOT giant").select("basket", "rank")
        empty = F.array().cast("array<long>")
        baskets = rest.groupBy("basket").agg(F.array_sort(F.collect_list("rank")).alias("suffix")).filter(F.size("suffix") > 1)
        first = written(baskets.select(empty.alias("stem"), "suffix", empty.alias("before"), F.lit(1).cast("long").alias("weight")).mapInArrow(_delivered, DATABASE), "databases")
        if huge:
            first = written(first.unionByName(self._giant_entries(first, marked.filter("giant").select("basket", "rank"), huge)), "databases")
        shipped = first.groupBy(F.col("stem")[0].alias("rank")).agg(F.sum("weight").alias("_w"))
        alone = self.items.join(shipped.hint("merge"), "rank", "left").withColumn("weight", F.col("support") - F.coalesce("_w", F.lit(0))).filter("weight > 0")
        self._split(first.unionByName(alone.select(F.array("rank").alias("stem"), empty.alias("suffix"), empty.alias("before"), "weight")))

    def _limit(self, sizes: DataFrame, ordinary: int) -> int:
        """The size (``ordinary`` times a power of two) that fewer baskets exceed than the least support."""
        power = F.greatest(F.ceil(F.log2(F.col("n") / ordinary)), F.lit(0)).cast("int")
        above, limit = 0, ordinary
        for k, n in sorted(map(tuple, sizes.groupBy(power.alias("k")).agg(F.count("*")).collect()), reverse=True):  # 64 rows at most
            above += n
            if above >= self.least:
                return ordinary << k
        return limit

    def _giant_entries(self, first: DataFrame, giants: DataFrame, huge: int) -> DataFrame:
        """Entries of the largest baskets: of their items those that ordinary baskets join to a stem often enough to be frequent with it."""
        pairs = first.select(F.col("stem")[0].alias("a"), F.explode("suffix").alias("b"), "weight").groupBy("a", "b").agg(F.sum("weight").alias("n")).filter(F.col("n") >= self.least - huge)
        a = _meet(pairs, giants.select(F.col("rank").alias("a"), "basket"), "a", "b", self.salts)
        both = a.join(giants.select(F.col("rank").alias("b"), "basket").hint("merge"), ["b", "basket"], "left_semi").select("basket", "a", "b")
        both = written(both, "giant-pairs")
        sides = both.select("basket", F.col("a").alias("stem"), F.col("b").alias("after"), F.lit(None).cast("long").alias("first")).unionByName(both.select("basket", F.col("b").alias("stem"), F.lit(None).cast("long").alias("after"), F.col("a").alias("first")))
        entries = sides.groupBy("basket", "stem").agg(F.array_sort(F.collect_list("after")).alias("suffix"), F.array_sort(F.collect_list("first")).alias("before"))
        return entries.select(F.array("stem").alias("stem"), "suffix", "before", F.lit(1).cast("long").alias("weight"))

    def _split(self, entries: DataFrame) -> None:
        """Heavy stems are delivered to longer ones until none is left."""
        self.depth, self.leaves, self.split = 1, None, None
        entries = written(entries, "entries")
        while True:
            size = F.sum(F.size("suffix") + F.size("before") + 1)
            stems = entries.groupBy("stem").agg(size.alias("_size"), F.sum("weight").alias("support"), F.max(F.size("suffix")).alias("_longest"))
            heavy = written(stems.filter((F.col("_size") > self.heavy) & (F.col("_longest") > 0)).select("stem", "support"), "heavy")
            any_heavy = heavy.head(1)
            tagged = _meet_stems(entries, heavy, self.salts) if any_heavy else None
            leaves = entries if tagged is None else written(tagged.filter("_support IS NULL").select(*entries.columns), "leaves")
            self.leaves = leaves if self.leaves is None else self.leaves.unionByName(leaves)
            if tagged is None:
                break
            large = tagged.filter("_support IS NOT NULL")
            held = large.select("stem", "_support", "weight", F.explode(F.concat("suffix", "before")).alias("x")).groupBy("stem", "_support", "x").agg(F.sum("weight").alias("n"))
            common = held.filter("n = _support").select("stem").distinct()
            split = written(heavy.join(common.withColumn("_common", F.lit(True)), "stem", "left").select("stem", "support", F.col("_common").isNull().alias("closed")), "split")
            self.split = split if self.split is None else self.split.unionByName(split)
            longer = written(large.select(*entries.columns).mapInArrow(_delivered, DATABASE), "entries")
            often = longer.groupBy("stem").agg(F.sum("weight").alias("support")).filter(F.col("support") >= self.least)
            entries = written(_meet_stems(longer, often, self.salts).filter("_support IS NOT NULL").select(*longer.columns), "entries")
            self.depth += 1

    def closed(self) -> DataFrame:
        """(ranks, support) of the closed sets, ranks ascending."""
        rows = self.leaves.repartition(self.parts, "stem").sortWithinPartitions("stem").mapInArrow(_mined(self.least), "ranks array<long>, support long")
        return rows if self.split is None else rows.unionByName(self.split.filter("closed").select(F.col("stem").alias("ranks"), "support"))

    def supports(self, asks: DataFrame) -> DataFrame:
        """(ask, a): the support of each distinct ``ask`` (ranks ascending, at least one, all of them frequent together)."""
        asks = asks.select("ask").distinct()
        starts = F.transform(F.sequence(F.lit(1), F.least(F.size("ask"), F.lit(self.depth))), lambda k: F.slice("ask", 1, k))
        routed = asks.select(F.explode(starts).alias("stem"), "ask")
        none = F.lit(None)
        rows = self.leaves.withColumn("ask", none.cast("array<long>")).unionByName(routed.select("stem", none.cast("array<long>").alias("suffix"), none.cast("array<long>").alias("before"), none.cast("long").alias("weight"), "ask"))
        found = rows.repartition(self.parts, "stem").sortWithinPartitions("stem", F.col("ask").asc_nulls_first()).mapInArrow(_counted, "ask array<long>, a long")
        if self.split is None:
            return found
        return found.unionByName(asks.join(self.split.select(F.col("stem").alias("ask"), F.col("support").alias("a")), "ask"))


def _meet_left(rows: DataFrame, giants: DataFrame, salts: int) -> DataFrame:
    """(basket, rank, giant) of all rows; a basket is dealt to ``salts`` parts by its items."""
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("rank", F.lit(7)), F.lit(salts)).cast("int"))
    parts = giants.select("basket", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"), F.lit(True).alias("giant"))
    return rows.join(parts.hint("shuffle_hash"), ["basket", "_salt"], "left").select("basket", "rank", F.coalesce("giant", F.lit(False)).alias("giant"))


def _meet_stems(entries: DataFrame, stems: DataFrame, salts: int) -> DataFrame:
    """``entries`` with ``_support``, that of their stem in ``stems`` or null; a stem is dealt to ``salts`` parts by the items after it."""
    parts = stems.select("stem", F.col("support").alias("_support"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    return entries.withColumn("_salt", F.pmod(F.xxhash64("suffix", F.lit(7)), F.lit(salts)).cast("int")).join(parts.hint("merge"), ["stem", "_salt"], "left").drop("_salt")


def closed_itemsets(
    lines: DataFrame, *, basket_col: str = "sale_id", item_col: str = "item_id", least: int = 5, share: int = 20_000, confidence: tuple[int, int] = (60, 100), heavy: int = 2_000_000, ordinary: int = 64
) -> DataFrame:
    """Closed frequent itemsets with their rules: items (ascending), support, rules (array of c, a, s, ascending by c).

    A basket is the distinct items of one ``basket_col``; lines with a null in either column say nothing, lines that repeat count once, other columns are not read. A set is frequent with
    ``least`` baskets and one of ``share`` at least, and closed if all larger sets have fewer baskets. A rule of a set takes one item c from it: with a the support of the rest and s that of c
    it holds if the set's support is ``confidence`` of a at least and more than a * s / baskets. An empty table has no sets. Baskets of any size, and items in any share of the baskets, are
    whole: ``heavy`` (entries of one database) and ``ordinary`` (items of a basket) only say how the work is dealt. A basket that is not among the largest (fewer
    than the least support) is delivered in one task, at a cost that grows with the square of its number of frequent items.
    """
    sets = Itemsets(lines, basket_col, item_col, least, share, heavy, ordinary)
    closed = written(sets.closed(), "closed")
    each = closed.withColumn("rank", F.explode("ranks"))
    rest = F.filter("ranks", lambda x: x != F.col("rank"))
    own = sets.items.select("rank", "item", F.col("support").alias("s"))
    each = written(_meet(each.withColumn("ask", rest), own, "rank", "ranks", sets.salts).select("ranks", "support", "ask", "item", "s"), "set-items")
    answers = sets.supports(each.filter(F.size("ask") > 0))
    asked = each.join(written(answers, "answers").hint("merge"), "ask", "left")
    wide = "decimal(38,0)"
    holds = (confidence[1] * F.col("support").cast(wide) >= confidence[0] * F.col("a").cast(wide)) & (F.col("support").cast(wide) * sets.baskets > F.col("a").cast(wide) * F.col("s").cast(wide))
    rule = F.when(F.col("a").isNotNull() & holds, F.struct(F.col("item").alias("c"), "a", "s"))
    return asked.groupBy("ranks", "support").agg(F.array_sort(F.collect_list("item")).alias("items"), F.array_sort(F.collect_list(rule)).alias("rules")).select("items", "support", "rules")
