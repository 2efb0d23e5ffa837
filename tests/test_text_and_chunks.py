"""Text columns, Markdown and chunking against the expected values and a row-at-a-time model."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lakescribe.functions import markdown as md
from lakescribe.functions import text as tx
from lakescribe.operators import chunking
from tests.oracle import session


@pytest.fixture(scope="module")
def spark():
    return session()


def values(spark, texts, build):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in rows.select("i", build(F.col("t")).alias("v")).orderBy("i").collect()]


def test_tokens(spark):
    assert values(spark, ["", "word", "one two three four five", "a b　c\x1cd"], tx.estimate_tokens) == [0, 1, 6, 5]


def test_content_type(spark):
    table = "| a | b |\n" * 5
    texts = ["Plain prose.\nMore of it.", table, "- a\n- b\n* c\n• d\n- e", "one | two\nx\ny\nz", "", "1. a\n2) b\n3. c"]
    assert values(spark, texts, tx.content_type) == ["prose", "table", "list", "mixed", "prose", "list"]


def test_quantities(spark):
    assert values(spark, ["15%", "costs $5,000", "500 personas", "no numbers", "1,000,000", "12.5 %"], tx.has_quantity) == [True, True, True, False, True, True]


def test_page_range_and_context(spark):
    assert [tuple(r) for r in values(spark, ["<!-- Page 5 --> x <!-- Page 8 -->", "<!--Page 12-->", "none"], tx.page_range)] == [(5, 8), (12, 12), (-1, -1)]
    line = lambda t: tx.context_line([("city", t), ("region", F.lit("northeast")), ("empty", F.lit("")), ("null", F.lit(None))])
    assert values(spark, ["Boston", ""], line) == ["city: Boston, region: northeast\n\n", "region: northeast\n\n"]
    assert values(spark, ["x"], lambda t: tx.context_line([])) == [""]


def test_extract(spark):
    assert values(spark, ["Boston_Report.md", "x", "", None], lambda t: tx.extract(t, r"^([A-Z][a-z]+)_")) == ["Boston", None, None, None]
    assert values(spark, ["memo_2024_Q1"], lambda t: tx.extract(t, r"20\d{2}")) == ["2024"]
    assert values(spark, ["ab", "b"], lambda t: tx.mapped(t, {"ab": "north"})) == ["north", None]


def test_clean_markdown(spark):
    text = "keep\n![A chart of things](a.png)\n\nA chart of things\nnext\n42\nxiv\nImagen 1. photo\ncivil\n1234\n![x](b)\nother"
    assert values(spark, [text], md.clean_markdown) == ["keep\n\nnext\n1234\nother"]


def test_sections(spark):
    texts = ["## A\n\nalpha\n\n### Sub\n\ninner\n\n## B\n\nbeta", "# Only\n\n" + "word " * 120, "", "front\n# a\nx\n# b\n" + "w " * 40 + "\n# c\nend", "### lost\n\nx\n## Kept\n##### body\ny"]
    got = [[(s.title, s.level, s.content, [(x.title, x.content) for x in s.subsections]) for s in r] for r in values(spark, texts, md.sections)]
    assert got[0] == [("A", 2, "alpha", [("Sub", "inner")]), ("B", 2, "beta", [])]
    assert [s[:2] for s in got[1]] == [("Only", 2)] and got[2] == []
    assert [(s[0], s[2]) for s in got[3]] == [("b", ("w " * 40).strip()), ("c", "end")]
    assert got[4] == [("Kept", 2, "##### body\ny", [])]


def tokens(text):
    return int(len(text.split()) * 1.3)


def model_split(text, most, overlap):
    parts = [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]
    if not parts:
        return [text]
    out, start = [], 0
    for j, p in enumerate(parts):
        if j > start and sum(map(tokens, parts[start : j + 1])) > most:
            out.append((start, j))
            start = next(s for s in range(start, j + 1) if sum(map(tokens, parts[s:j])) <= overlap)
    return ["\n\n".join(parts[a:b]) for a, b in [*out, (start, len(parts))]]


def test_split_paragraphs(spark):
    rng = random.Random(4)
    texts = ["", " \n\n ", "one"] + ["\n\n".join(" ".join("w" for _ in range(rng.choice([1, 5, 20, 60, 200]))) for _ in range(rng.randint(1, 25))) for _ in range(30)]
    got = values(spark, texts, lambda t: chunking.split_paragraphs(t, 150, 40))
    assert got == [model_split(t, 150, 40) for t in texts]


def model_merge(chunks):
    """(text, title) of chunks merged one after another."""
    out, open_ = [], None
    for text, title in chunks:
        n = tokens(text)
        if n >= 200:
            if open_:
                out.append(open_)
            open_ = None
            words = text.split()
            out.append((" ".join(words[:1384]) if n > 1800 and len(words) > 1384 else text, title))
        elif open_ and tokens(open_[0]) + n <= 1500:
            open_ = (f"{open_[0]}\n\n{text}", open_[1] or title)
        else:
            if open_:
                out.append(open_)
            open_ = (text, title)
    return out + ([open_] if open_ else [])


def test_merge_chunks(spark):
    rng = random.Random(6)
    docs = [[("w " * rng.choice([10, 60, 120, 150, 200, 1500, 1600]), rng.choice(["", "t", "u"])) for _ in range(rng.randint(0, 14))] for _ in range(25)]
    kind = "array<struct<text:string,section_title:string,section_level:int,content_type:string,has_quantitative_data:boolean>>"
    rows = spark.createDataFrame([(i, [(t.strip(), title, 2, "prose", k % 5 == 0) for k, (t, title) in enumerate(d)]) for i, d in enumerate(docs)], f"i int, c {kind}")
    got = rows.select("i", chunking.merge_chunks(F.col("c")).alias("m")).orderBy("i").collect()
    for r, d in zip(got, docs):
        assert [(c.text, c.section_title) for c in r.m] == model_merge([(t.strip(), title) for t, title in d])
        assert [c.chunk_index for c in r.m] == list(range(len(r.m)))


def test_process_documents(spark):
    body = "Words of a section. " * 40
    text = f"# Introduction\n\n{body}\n\n## Demographics\n\n{body}\n\n### Housing\n\n{body}\n\n## TABLE OF CONTENTS\n\n{body}\n\n## LIST OF FIGURES\n\n{body}\n\n## Short\n\nfew"
    rows = spark.createDataFrame([(text, "Boston_Report.md", "report", "Boston")], "text string, source_file string, document_type string, city string")
    got = chunking.process_documents(rows, ["city"], skip_exact=["table of contents"], skip_prefixes=["list of "]).collect()
    assert [c.section_title for c in got] == ["Introduction", "Demographics"]
    assert got[0].text.startswith("city: Boston\n\n## Introduction\n\n") and "### Housing" in got[1].text and got[1].page_start == -1
    long = "\n\n".join("Sentence number. " * 50 for _ in range(20))
    rows = spark.createDataFrame([(f"## Data\n\n{long}\n\n### Part\n\nfew words", "a.md", "report")], "text string, source_file string, document_type string")
    titles = [c.section_title for c in chunking.process_documents(rows).collect()]
    assert titles[0] == "Data" and titles[-1] == "Data > Part" and len(titles) > 2
