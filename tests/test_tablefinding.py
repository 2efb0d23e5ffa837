"""Tables from geometry: drawn grids and gaps against the cells that were drawn."""

import random

import pytest
from pyspark.sql import functions as F

from lakescribe.operators.pages import tables
from lakescribe.operators.tablefinding import RULE, bordered, borderless, find_tables
from lakescribe.sources.pages import SPAN
from tests.oracle import session


def word(text, x, y):
    return (text, x, y, x + 5.0 * len(text), y + 10.0)


def drawn(rng, rows, cols, ruled):
    """Cells of one or two words at jittered places, and the grid's lines in pieces, or none."""
    cells = [[" ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 2))) for _ in range(cols)] for _ in range(rows)]
    words, rules = [("A", 40.0, 20.0, 45.0, 30.0), ("title", 48.0, 20.0, 73.0, 30.0)], []
    for i, row in enumerate(cells):
        for j, text in enumerate(row):
            x = 50 + 110.0 * j + rng.uniform(0, 6)
            for part in text.split():
                words.append(word(part, x, 100 + 20.0 * i + rng.uniform(-1, 1)))
                x += 5.0 * len(part) + 4
    if ruled:
        for i in range(rows + 1):
            y = 95 + 20.0 * i
            rules += [(44.0 + 110 * j, y + rng.uniform(-0.5, 0.5), 44.0 + 110 * (j + 1), y) for j in range(cols)]
        rules += [(44.0 + 110 * j, 95.0, 44.0 + 110 * j + rng.uniform(0, 0.5), 95 + 20.0 * rows) for j in range(cols + 1)]
    rng.shuffle(words)
    rng.shuffle(rules)
    return cells, words, rules


@pytest.mark.parametrize("ruled", [True, False])
def test_drawn_tables_are_found_cell_by_cell(ruled):
    rng = random.Random(6)
    for _ in range(200):
        cells, words, rules = drawn(rng, rng.randint(2, 12), rng.randint(2, 5), ruled)
        found = bordered(words, rules) if ruled else borderless(words)
        assert [t["rows"] for t in found] == [cells]


def test_merged_cells_and_what_is_no_table():
    words = [word("both", 60, 102), word("l", 60, 122), word("r", 160, 122)]
    rules = [(50, 95, 250, 95), (50, 115, 250, 115), (50, 135, 250, 135), (50, 95, 50, 135), (250, 95, 250, 135), (150, 115, 150, 135)]
    assert bordered(words, rules)[0]["rows"] == [["both", None], ["l", "r"]]
    assert bordered(words, [(50, 95, 250, 95), (50, 135, 250, 135)]) == [] and bordered([], []) == []
    two = bordered([word("x", 60, 102), word("y", 410, 102)], [(50, 95, 100, 115), (75, 95, 75, 115), (400, 95, 450, 115)])
    assert [t["rows"] for t in two] == [[["x", ""]], [["y"]]]
    prose = [word(w, 50 + 5.0 * sum(map(len, row[:k])) + 4 * k, 100 + 12.0 * line) for line in range(6) for row in [["some", "words" * (line % 3), "that", "run"]] for k, w in enumerate(row) if w]
    assert borderless(prose) == [] and borderless([]) == []


def test_pages_with_nulls():
    spark = session()
    span = lambda text, x, y: (text, x, y, x + 5.0 * len(text or ""), y + 10.0, 9.0, False, False)
    spans = [span(t, 50.0 + 100 * j, 100.0 + 20 * i) for i, row in enumerate((("a", "b"), ("c", "d"))) for j, t in enumerate(row)]
    rows = [("x", 1, spans, None, 7), ("x", 2, [*spans, None, (None, 1.0, 1.0, 2.0, 2.0, 9.0, False, False), (" ", None, None, None, None, 9.0, False, False)], [None], 7), ("y", 1, None, None, 7), ("y", 2, [], [], None)]
    pages = spark.createDataFrame(rows, f"doc string, page int, spans array<{SPAN}>, rules array<{RULE}>, bordered int")
    found = find_tables(pages)
    assert {(r.doc, r.page): r.n for r in found.select("doc", "page", F.size("borderless").alias("n")).collect()} == {("x", 1): 1, ("x", 2): 1, ("y", 1): 0, ("y", 2): 0}
    assert [r["rows"] for r in tables(found).collect()] == [[["a", "b"], ["c", "d"]]] * 2
    assert find_tables(pages.limit(0)).count() == 0


def test_pages_are_looked_at_once_and_keep_what_is_asked():
    spark = session()
    at = lambda text, x, y: (text, x, y, x + 5.0, y + 10.0, 9.0, False, False)
    spans = [at(t, 60.0 + 100 * j, 102.0 + 20 * i) for i, row in enumerate(("ab", "cd")) for j, t in enumerate(row)]
    ruled = [(50.0, y, 250.0, y) for y in (95.0, 115.0, 135.0)] + [(x, 95.0, x, 135.0) for x in (50.0, 150.0, 250.0)]
    below = [at(t, 60.0 + 100 * j, 302.0 + 20 * i) for i, row in enumerate(("ef", "gh")) for j, t in enumerate(row)]
    rows = [("x", 1, spans + below, ruled, 7), ("x", 2, [at("alone", 60.0, 20.0), *spans, at("end", 60.0, 200.0), *below], None, 8), ("x", 3, [], ruled, 9)]
    pages = spark.createDataFrame(rows, f"doc string, page int, spans array<{SPAN}>, rules array<{RULE}>, more int")
    found = tables(find_tables(pages, keep=("doc", "page")))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = {(r.page, r.table_index): (r.is_borderless, r.rows, r.header_names, r.row_count, r.col_count, r.needs_review) for r in found.collect()}
    first = (False, [["a", "b"], ["c", "d"]], ["a", "b"], 2, 2, False)
    assert got == {(1, 0): first, (2, 0): (True, *first[1:]), (2, 1): (True, [["e", "f"], ["g", "h"]], ["e", "f"], 2, 2, False), (3, 0): (False, [["", ""], ["", ""]], ["", ""], 2, 2, False)}
    assert find_tables(pages).columns == ["doc", "page", "spans", "rules", "more", "bordered", "borderless"] and [r.more for r in find_tables(pages).orderBy("page").collect()] == [7, 8, 9]
    assert {r.page for r in tables(find_tables(pages), try_borderless=False).collect()} == {1, 3}
