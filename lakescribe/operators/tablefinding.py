"""Tables from a page's geometry: grids of ruling lines, and columns of tables without borders from the gaps between words.

Pages have ``spans`` (text and box) and ``rules`` (boxes of drawn lines and rectangles). The result fills the columns ``bordered`` and ``borderless`` that ``operators.pages.tables`` reads. A page is
one row and is looked at by itself, so nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.pages import TABLE

#: Coordinates that differ by no more than so many points are one.
NEAR = 2.0
#: A gap between words is a column's where it is as wide as so many characters.
GAP_CHARACTERS = 2.0
RULE = "struct<x0:double,y0:double,x1:double,y1:double>"
Box = tuple[float, float, float, float]


def _snapped(values: list[float]) -> list[float]:
    """The values' clusters, by their means, ascending."""
    out: list[list[float]] = []
    for v in sorted(values):
        if out and v - out[-1][-1] <= NEAR:
            out[-1].append(v)
        else:
            out.append([v])
    return [sum(c) / len(c) for c in out]


def _edges(rules: list[Box]) -> tuple[list[tuple[float, float, float]], list[tuple[float, float, float]]]:
    """Horizontal (y, x0, x1) and vertical (x, y0, y1) lines; a rectangle has four. Pieces of one line that touch are one."""
    across, down = [], []
    for x0, y0, x1, y1 in rules:
        x0, x1, y0, y1 = min(x0, x1), max(x0, x1), min(y0, y1), max(y0, y1)
        wide, high = x1 - x0 > NEAR, y1 - y0 > NEAR
        if wide:
            across += [(y0, x0, x1), (y1, x0, x1)] if high else [((y0 + y1) / 2, x0, x1)]
        if high:
            down += [(x0, y0, y1), (x1, y0, y1)] if wide else [((x0 + x1) / 2, y0, y1)]

    def joined(lines):
        places = _snapped([a for a, _, _ in lines])
        snap = lambda a: min(places[max(0, bisect_left(places, a) - 1) : bisect_left(places, a) + 1], key=lambda p: abs(p - a))
        out: list[list[float]] = []
        for a, b, c in sorted((snap(a), b, c) for a, b, c in lines):
            if out and out[-1][0] == a and b <= out[-1][2] + NEAR:
                out[-1][2] = max(out[-1][2], c)
            else:
                out.append([a, b, c])
        return [tuple(x) for x in out]

    return joined(across), joined(down)


def _grids(rules: list[Box]) -> list[tuple[list, list]]:
    """Lines that cross, directly or through others, as (horizontal, vertical), with two of each at least."""
    across, down = _edges(rules)
    down.sort()
    xs, above = [d[0] for d in down], list(range(len(across) + len(down)))

    def top(k):
        while above[k] != k:
            above[k] = k = above[above[k]]
        return k

    for i, (y, x0, x1) in enumerate(across):
        for j in range(bisect_left(xs, x0 - NEAR), bisect_right(xs, x1 + NEAR)):
            if down[j][1] - NEAR <= y <= down[j][2] + NEAR:
                above[top(i)] = top(len(across) + j)
    groups: dict[int, tuple[list, list]] = {}
    for i, line in enumerate(across):
        groups.setdefault(top(i), ([], []))[0].append(line)
    for j, line in enumerate(down):
        groups.setdefault(top(len(across) + j), ([], []))[1].append(line)
    return [(a, d) for a, d in groups.values() if len({y for y, _, _ in a}) > 1 and len({x for x, _, _ in d}) > 1]


def _text(words: list[tuple]) -> str:
    """Words of a cell line by line."""
    return " ".join(w[0] for line in _lines(words) for w in line)


def _lines(words: list[tuple]) -> list[list[tuple]]:
    """Words (text, x0, y0, x1, y1) as lines from top to bottom, each from left to right."""
    out: list[list[tuple]] = []
    for w in sorted(words, key=lambda w: (w[2] + w[4], w[1])):
        middle = (w[2] + w[4]) / 2
        if out and abs((out[-1][0][2] + out[-1][0][4]) / 2 - middle) <= max(NEAR, (w[4] - w[2]) / 2):
            out[-1].append(w)
        else:
            out.append([w])
    return [sorted(line, key=lambda w: (w[1], w[0])) for line in out]


def _by_place(lines: list[tuple]) -> dict[float, list[tuple]]:
    out: dict[float, list[tuple]] = {}
    for a, b, c in lines:
        out.setdefault(a, []).append((b, c))
    return out


def bordered(words: list[tuple], rules: list[Box]) -> list[dict]:
    """Tables of crossing lines. A cell has the words whose middle is in it; cells without a line between them are one, of which the first has the text and the others are null."""
    out = []
    for across, down in _grids(rules):
        xs, ys = sorted({x for x, _, _ in down}), sorted({y for y, _, _ in across})
        rows: list[list] = [[[] for _ in xs[1:]] for _ in ys[1:]]
        beside, between = _by_place(down), _by_place(across)
        parted = lambda lines, at, middle: any(b - NEAR <= middle <= c + NEAR for b, c in lines[at])
        first = [[(i, j) for j in range(len(xs) - 1)] for i in range(len(ys) - 1)]
        for i in range(len(ys) - 1):
            for j in range(len(xs) - 1):
                if j and not parted(beside, xs[j], (ys[i] + ys[i + 1]) / 2):
                    first[i][j] = first[i][j - 1]
                elif i and not parted(between, ys[i], (xs[j] + xs[j + 1]) / 2):
                    first[i][j] = first[i - 1][j]
        for w in words:
            i, j = bisect_right(ys, (w[2] + w[4]) / 2) - 1, bisect_right(xs, (w[1] + w[3]) / 2) - 1
            if 0 <= i < len(ys) - 1 and 0 <= j < len(xs) - 1:
                i, j = first[i][j]
                rows[i][j].append(w)
        cells = [[_text(c) if first[i][j] == (i, j) else None for j, c in enumerate(row)] for i, row in enumerate(rows)]
        out.append({"bbox": {"x0": xs[0], "y0": ys[0], "x1": xs[-1], "y1": ys[-1]}, "header": [c or "" for c in cells[0]], "rows": cells})
    return sorted(out, key=lambda t: (t["bbox"]["y0"], t["bbox"]["x0"]))


def borderless(words: list[tuple], least_rows: int = 2) -> list[dict]:
    """Tables of lines one below the other whose words leave the same gaps free. A line of one piece ends a table, and so does one that closes more than half of its gaps."""
    out, run, free = [], [], []

    def pieces(line):
        wide = GAP_CHARACTERS * sorted((w[3] - w[1]) / max(1, len(w[0])) for w in line)[len(line) // 2]
        got: list[list] = []
        for w in line:
            if got and w[1] - got[-1][1] < wide:
                got[-1][1] = max(got[-1][1], w[3])
                got[-1][2].append(w)
            else:
                got.append([w[1], w[3], [w]])
        return got

    def close():
        if len(run) >= least_rows and free:
            cuts = [(a + b) / 2 for a, b in free]
            rows = [[""] * (len(cuts) + 1) for _ in run]
            for row, line in zip(rows, run):
                for x0, x1, own in line:
                    k = bisect_right(cuts, (x0 + x1) / 2)
                    row[k] = " ".join([*filter(None, [row[k]]), *(w[0] for w in own)])
            every = [w for line in run for piece in line for w in piece[2]]
            box = {"x0": min(w[1] for w in every), "y0": min(w[2] for w in every), "x1": max(w[3] for w in every), "y1": max(w[4] for w in every)}
            out.append({"bbox": box, "header": rows[0], "rows": rows})

    for line in _lines(words):
        own = pieces(line)
        if len(own) < 2:
            close()
            run, free = [], []
            continue
        gaps = [(a[1], b[0]) for a, b in zip(own, own[1:])]
        kept = [(max(a, c), min(b, d)) for a, b in free for c, d in gaps if min(b, d) - max(a, c) > 0] if run else gaps
        if run and 2 * len(kept) < len(free) or not kept:
            close()
            run, kept = [], gaps
        run.append(own)
        free = kept
    close()
    return out


def _entries(column: pa.ListArray, fields: Sequence[str]) -> list[list[tuple]]:
    """The fields of each row's structs as tuples, without structs that are null or lack one. Values are read a column at a time."""
    flat = column.flatten()
    values = dict(zip((f.name for f in flat.type), flat.flatten()))  # null where the struct is
    entries = list(zip(*(values[f].to_pylist() for f in fields)))
    lengths, at, out = pc.fill_null(pc.list_value_length(column), 0).to_pylist(), 0, []
    for n in lengths:
        out.append([e for e in entries[at : at + n] if None not in e])
        at += n
    return out


def _nested(lists: list[list], values: pa.Array, kind: pa.DataType) -> pa.ListArray:
    offsets = [0]
    for x in lists:
        offsets.append(offsets[-1] + len(x))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, type=kind)


def _tables(found: list[list[dict]], kind: pa.DataType) -> pa.ListArray:
    """Tables as a column of ``kind``, put together field by field."""
    every = [t for own in found for t in own]
    one = kind.value_type
    cells, names = one.field("rows").type, one.field("header").type
    rows = [row for t in every for row in t["rows"]]
    box = pa.StructArray.from_arrays([pa.array([t["bbox"][f.name] for t in every], f.type) for f in one.field("bbox").type], fields=list(one.field("bbox").type))
    fields = {
        "bbox": box, "header": _nested([t["header"] for t in every], pa.array([c for t in every for c in t["header"]], names.value_type), names),
        "rows": _nested([t["rows"] for t in every], _nested(rows, pa.array([c for row in rows for c in row], cells.value_type.value_type), cells.value_type), cells),
    }
    return _nested(found, pa.StructArray.from_arrays([fields[f.name] for f in one], fields=list(one)), kind)


def find_tables(pages: DataFrame, spans_col: str = "spans", rules_col: str = "rules", keep: Sequence[str] | None = None) -> DataFrame:
    """``pages`` with ``bordered`` and ``borderless``, found from their spans and rules. Words inside bordered tables are in no borderless one.

    Pages without spans or rules, null ones and spans without text or box have no tables; all other columns, or those of ``keep``, stay as they are.
    """
    kept = [c for c in (pages.columns if keep is None else keep) if c not in ("bordered", "borderless")]
    schema = T.StructType([*[pages.schema[c] for c in kept], *T._parse_datatype_string(f"bordered array<{TABLE}>, borderless array<{TABLE}>").fields])
    box = ("x0", "y0", "x1", "y1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(schema["bordered"].dataType)
        for batch in batches:
            found: tuple[list, list] = ([], [])
            for spans, rules in zip(_entries(batch.column(spans_col), ("text", *box)), _entries(batch.column(rules_col), box)):
                words = [(text, *b) for s, *b in spans if (text := s.strip())]
                grids = bordered(words, rules)
                found[0].append(grids)
                if grids:
                    boxes = [tuple(t["bbox"][k] for k in box) for t in grids]
                    words = [w for w in words if not any(x0 <= (w[1] + w[3]) / 2 <= x1 and y0 <= (w[2] + w[4]) / 2 <= y1 for x0, y0, x1, y1 in boxes)]
                found[1].append(borderless(words))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(_tables(own, kind) for own in found)], [*kept, "bordered", "borderless"])

    return pages.select(*dict.fromkeys([*kept, spans_col, rules_col])).mapInArrow(run, schema)
