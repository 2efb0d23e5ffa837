"""Repair of conversations by an edit automaton that is determinised lazily, with costs.

A repaired conversation has the role initials ``(s?(ua)+)?``. Each row is kept (cost 0), given the role user or assistant (3) or deleted (4); rows of empty text are
inserted anywhere (3); a row that is cut off costs 3 more where it stays; blank and repeated rows must go. Texts do not matter beyond that, so a row is one of nine symbols and a
conversation is read by an automaton of four states (nothing yet, after s, after u, after a).

The least costs to the end from the four states are one vector. Less its least entry it takes few values: each is a state of the determinised automaton, made when first met, and
what a symbol makes of it is looked up in a table of the worker. A scan from the last row to the first adds the table's weights and gives the cost; a trace in the opposite direction
follows arcs whose cost equals the difference of the entries, the ASCII-least edit first, and gives the audit. From a state each edit leads to one state, so the trace never
has to go back.

Where rows go: texts move once to be numbered and once to be edited; the automaton reads a byte a row. The rows of a conversation are streams of a task in both passes, sorted on disk where
memory ends: a task holds a byte a row and the audit, which is one value of the result anyway, and no texts. Conversations with any number of rows work; one is not shared between tasks, as
its audit and its digest are single values that must be made in order.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import slices, written

SPACE = " \t\n\x0b\f\r"
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
MUST_GO = 8
#: Costs to the end where no row is left: from nothing, after s, after u, after a.
END = (0, 2 * INSERT, INSERT, 0)
#: Where an inserted or re-roled row leads: user first, user after s, assistant after u, user after a.
NEXT = (2, 2, 3, 2)
#: Where a kept row leads from a state, by the row's initial s, u, a, another.
KEEP = ((1, None, None, None), (2, 2, None, 2), (None, None, 3, None), (None, None, None, None))


class Determinised:
    """States (vectors of costs, least entry 0) and transitions, made when first asked for."""

    def __init__(self):
        self.vectors, self.ids, self.table, self.arcs = [END], {END: 0}, {}, {}

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """The state before a row of this symbol, when ``state`` is the one after it, and the weight."""
        found = self.table.get((state, symbol))
        if found is None:
            after = self.vectors[state]
            v = [DELETE + x for x in after]
            if symbol != MUST_GO:
                more = CUT if symbol >= 4 else 0
                for q in range(4):
                    v[q] = min(v[q], REROLE + more + after[NEXT[q]])
                    if (to := KEEP[symbol % 4][q]) is not None:
                        v[q] = min(v[q], more + after[to])
            for _ in range(2):
                v = [min(v[q], INSERT + v[NEXT[q]]) for q in range(4)]
            least = min(v)
            vector = tuple(x - least for x in v)
            if vector not in self.ids:
                self.ids[vector] = len(self.vectors)
                self.vectors.append(vector)
            found = self.table[state, symbol] = self.ids[vector], least
        return found

    def arc(self, before: int, after: int, symbol: int, q: int) -> tuple[str, int]:
        """The ASCII-least edit whose cost is the whole difference of the entries, and where it leads."""
        key = before, after, symbol, q
        if key not in self.arcs:
            here, there = self.vectors[before], self.vectors[after]
            rest = here[q] + self.step(after, symbol)[1]
            more, to = (CUT if symbol >= 4 else 0), KEEP[symbol % 4][q]
            if rest == DELETE + there[q]:
                self.arcs[key] = "D", q
            elif here[q] == INSERT + here[NEXT[q]]:
                self.arcs[key] = "I", NEXT[q]
            elif to is not None and rest == more + there[to]:
                self.arcs[key] = "K", to
            else:
                self.arcs[key] = "R", NEXT[q]
        return self.arcs[key]

    def audit(self, backwards: bytes | bytearray) -> tuple[int, str]:
        """Cost and audit of the rows with these symbols, the last row first."""
        states, cost, state = [0], 0, 0
        for symbol in backwards:
            state, weight = self.step(state, symbol)
            states.append(state)
            cost += weight
        cost += self.vectors[state][0]
        letters, q, k = [], 0, len(backwards)
        while k:
            letter, q = self.arc(states[k], states[k - 1], backwards[k - 1], q)
            letters.append(letter)
            k -= letter != "I"
        while END[q]:
            letters.append("I")
            q = NEXT[q]
        return cost, "".join(letters)


def numbered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows in order with what is wrong with them: conv, pos (from 1), turn, role, text, fault, symbol, illegal, new_turn; written to the shared folder.

    Order is by turn, nulls first, then role and text. Null roles and texts count as one space. ``fault`` is the first of blank, duplicate and truncated, or null.
    """
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"), F.coalesce(text_col, F.lit(" ")).alias("text"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("pos", F.row_number().over(order).cast("long"))
    place = Window.partitionBy("conv").orderBy("pos")
    initial = F.substring("role", 1, 1)
    rows = rows.select("*", F.lag(initial).over(place).alias("_before"), F.lag("turn").over(place).alias("_turn"), F.sha2(F.encode("text", "UTF-8"), 256).alias("_text"))
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("conv", "role", "_text").orderBy("pos")))
    bare = F.rtrim("text", F.lit(SPACE))
    fault = F.when(bare == "", "blank").when(F.col("_nth") > 1, "duplicate").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated")
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", kind + 4).otherwise(kind)
    pair = F.concat("_before", initial)
    rows = rows.withColumn("fault", fault).withColumn("symbol", symbol.cast("byte"))
    rows = rows.withColumn("illegal", F.coalesce((F.col("pos") > 1) & ~pair.isin("su", "ua", "au"), F.lit(False)))
    rows = rows.withColumn("new_turn", F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_turn")))
    return written(rows.select("conv", "pos", "turn", "role", "text", "fault", "symbol", "illegal", "new_turn"), "turns")


def audits(numbered: DataFrame) -> DataFrame:
    """(conv, cost, audit) of each conversation of ``numbered_turns``."""

    def scan(batches):
        automaton, now, symbols, started = Determinised(), None, bytearray(), False
        for batch in batches:
            out = []
            for conv, symbol in zip(batch.column("conv").to_pylist(), batch.column("symbol").to_pylist()):
                if not started or conv != now:
                    if started:
                        out.append((now, *automaton.audit(symbols)))
                    now, symbols, started = conv, bytearray(), True
                symbols.append(symbol)
            kind = batch.schema.field("conv").type
            yield made(out, kind)
        if started:
            yield made([(now, *automaton.audit(symbols))], kind)

    def made(rows, kind):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["conv", "cost", "audit"])

    rows = numbered.select("conv", "pos", "symbol").repartition("conv").sortWithinPartitions("conv", F.col("pos").desc())
    kind = numbered.schema["conv"].dataType.simpleString()
    return rows.mapInArrow(scan, f"conv {kind}, cost long, audit string")


def faults(numbered: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal): counts of each conversation of ``numbered_turns``."""
    wide = [F.max("turn").cast("decimal(38,0)"), F.min("turn").cast("decimal(38,0)")]
    missing = F.coalesce(wide[0] - wide[1] + 1 - F.count_if("new_turn"), F.lit(0))
    gaps = F.least(missing, F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    counts = [F.count_if(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")]
    return numbered.groupBy("conv").agg(gaps.alias("gaps"), *counts, F.count_if("illegal").alias("illegal"))


def _edited(numbered: DataFrame, audit: DataFrame) -> DataFrame:
    """The rows of each conversation in order, behind a row of place 0 that holds its audit as text."""
    heads = audit.select("conv", F.lit(0).cast("long").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text"))
    return numbered.select("conv", "pos", "role", "text").unionByName(heads).repartition("conv").sortWithinPartitions("conv", "pos")


def _edits(batches):
    """(conv, head, pos, letter, role, text) of each edit, whose rows come behind their audit; ``head`` edits have pos 0, and only say that a conversation begins.

    The texts of one slice are Python objects at a time.
    """
    conv, letters, q, at, roles = None, "", 0, 0, ("", "", "user", "assistant")

    def inserts():
        nonlocal at, q
        while at < len(letters) and letters[at] == "I":
            q, at = NEXT[q], at + 1
            yield conv, False, None, "I", roles[q], ""

    for batch in slices(batches):
        for conv_, pos, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "pos", "role", "text"))):
            if pos == 0:
                yield from inserts()
                conv, letters, q, at = conv_, text, 0, 0
                yield conv, True, 0, "", "", ""
                yield from inserts()
                continue
            letter, at = letters[at], at + 1
            if letter == "K":
                q = 1 if role[:1] == "s" else 2 if role[:1] == "u" else 3
            elif letter == "R":
                q, role = NEXT[q], roles[NEXT[q]]
            yield conv, False, pos, letter, role, text
            yield from inserts()


def repaired_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations and their audit, a row an edit: the conversation, step (from 0), pos (the row's place before the repair; null where one is inserted), edit
    (K, R, D, I), role and text (as repaired; as found where deleted).

    Null conversation ids are a conversation; null turns come first, then ties by role and text; null roles and texts are one space. Empty tables give no rows; other columns are
    not read. Conversations and texts may be of any length.
    """
    numbered = numbered_turns(turns, conv_col, turn_col, role_col, text_col)
    kind = numbered.schema["conv"].dataType.simpleString()

    def rows(batches):
        kept, size, step, kinds = [], 0, 0, None

        def made():
            columns = list(zip(*kept)) or [()] * 6
            types = [kinds, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv", "step", "pos", "edit", "role", "text"])

        def typed():
            nonlocal kinds
            for batch in batches:
                kinds = batch.schema.field("conv").type
                yield batch

        for conv, head, pos, letter, role, text in _edits(typed()):
            if head:
                step = 0
                continue
            kept.append((conv, step, pos, letter, role, text))
            step, size = step + 1, size + len(text)
            if len(kept) >= 1000 or size >= 4 << 20:
                yield made()
                kept, size = [], 0
        if kept:
            yield made()

    edited = _edited(numbered, audits(numbered)).mapInArrow(rows, f"conv {kind}, step long, pos long, edit string, role string, text string")
    return edited.withColumnRenamed("conv", conv_col)


def conversation_reports(turns: DataFrame, originals: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row for each conversation of ``originals``: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (of the repaired ``role:text``, newline-joined).

    A conversation without rows in ``turns`` has zeros, an empty audit and the digest of the empty string. Null ids, repeated rows, ties and long texts as in ``repaired_turns``.
    """
    numbered = numbered_turns(turns, conv_col)
    kind = numbered.schema["conv"].dataType.simpleString()
    audit = written(audits(numbered), "audits")

    def digests(batches):
        kinds, done, now, digest, first = None, [], None, None, True

        def typed():
            nonlocal kinds
            for batch in batches:
                kinds = batch.schema.field("conv").type
                yield batch

        def made():
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kinds), pa.array([d[1] for d in done], pa.string())], ["conv", "repaired_sha256"])

        for conv, head, _, letter, role, text in _edits(typed()):
            if head:
                if digest is not None:
                    done.append((now, digest.hexdigest()))
                if len(done) >= 1000:
                    yield made()
                    done = []
                now, digest, first = conv, hashlib.sha256(), True
            elif letter != "D":
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
        if digest is not None:
            done.append((now, digest.hexdigest()))
            yield made()

    sha = _edited(numbered, audit).mapInArrow(digests, f"conv {kind}, repaired_sha256 string")
    counted = faults(numbered).join(audit.withColumnRenamed("conv", "_a"), F.col("conv").eqNullSafe(F.col("_a"))).drop("_a").join(sha.withColumnRenamed("conv", "_s"), F.col("conv").eqNullSafe(F.col("_s"))).drop("_s")
    all_ids = originals.select(F.col(conv_col).alias("_id")).distinct()
    out = all_ids.join(counted, F.col("_id").eqNullSafe(F.col("conv")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("_id").alias(conv_col), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def damaged(turns: DataFrame, conv: Column | str = "conv_id", turn: Column | str = "turn") -> DataFrame:
    """Rows damaged by crc32 of ``conversation:turn`` modulo 20 (nulls are one space): 0 drops a row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes it the user's."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn)))
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_d"))
    rows = rows.filter("_d <> 0").withColumn("text", F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("_n", F.explode(F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_d", "_n")
