"""Files per document, Markdown of pages with tables and images, and the stage that makes them."""

import json

import pytest
from pyspark.sql import functions as F

from lakescribe.__main__ import main
from lakescribe.config import optional_config
from lakescribe.operators import pages
from lakescribe.plans.parse import parse_files
from lakescribe.sources import files
from lakescribe.sources.filesink import write_files
from lakescribe.sources.pdf import scan_pdfs
from tests.oracle import session
from tests.test_pages_and_reindex import FIRST, read_pdf, span


@pytest.fixture(scope="module")
def spark():
    return session()


def test_files_are_whole_and_written_again(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.txt", "é\n"), ("y.txt", None), ("z.txt", "z" * 300_000)], "file_name string, content string").repartition(3)
    for _ in range(2):
        got = {r.file_name: r.bytes for r in write_files(rows, str(tmp_path / "out")).collect()}
        assert got == {"a/x.txt": 3, "y.txt": 0, "z.txt": 300_000}
    assert (tmp_path / "out/a/x.txt").read_text() == "é\n" and (tmp_path / "out/y.txt").read_bytes() == b"" and (tmp_path / "out/z.txt").stat().st_size == 300_000
    assert sorted(p.name for p in (tmp_path / "out").rglob("*") if p.is_file()) == ["x.txt", "y.txt", "z.txt"]
    assert write_files(rows.limit(0), f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("names", [[None], [""], ["/etc/x"], ["a/../../x"], ["a", "a"], ["folder/"], [".."]])
def test_names_that_are_no_files(spark, tmp_path, names):
    with pytest.raises(ValueError):
        write_files(spark.createDataFrame([(n, b"x") for n in names], "file_name string, content binary"), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_a_task_that_fails_leaves_no_half_file(spark, tmp_path):
    rows = spark.range(4).repartition(1).sortWithinPartitions("id").select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("file_name"), F.when(F.col("id") < 3, "x").otherwise(F.raise_error(F.lit("stop"))).alias("content"))
    with pytest.raises(Exception, match="stop"):
        write_files(rows, str(tmp_path / "out"))
    write_files(rows.filter("file_name < 'f3'"), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["f0", "f1", "f2"]


def test_markdown_file_per_document(spark, tmp_path):
    files.write_markdown(spark.createDataFrame([(1, "# a"), (2, "# b")], "doc int, md string"), str(tmp_path))
    assert (tmp_path / "1.md").read_text() == "# a" and (tmp_path / "2.md").read_text() == "# b"


def test_table_markdown(spark):
    kind = "rows array<array<string>>, header_names array<string>, col_count int"
    cases = [
        ([["a", None], ["1|2", "x\n y"], ["3"]], ["a", ""], 2, "| a |  |\n| --- | --- |\n| 1\\|2 | x y |\n| 3 |  |"),
        ([["1", "2"]], ["h", "g"], 2, "| h | g |\n| --- | --- |\n| 1 | 2 |"),
        ([["only"]], ["only"], 1, "| only |\n| --- |"),
        ([], [], 0, None),
    ]
    got = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], f"i int, {kind}").select("i", pages.table_markdown().alias("md"))
    assert [r.md for r in got.orderBy("i").collect()] == [c[3] for c in cases]


@pytest.fixture
def folder(tmp_path):
    place = tmp_path / "in"
    place.mkdir()
    first = json.loads(json.dumps(FIRST))
    first[0] |= {"height": 800.0, "width": 800.0, "spans": [span("Title ", 200.0, 20.0), span("before", 300.0), span("in the table", 20.0), span("after", 500.0)]}
    (place / "one.pdf").write_text("\n".join(map(json.dumps, first)))
    (place / "two.pdf").write_text(json.dumps({"text": "only page here", "width": 1.0, "height": 1.0}) + "\n" + json.dumps({"broken": True}))
    (place / "three.pdf").write_text(json.dumps({"broken": True}))
    (place / "other.txt").write_text("no")
    return place


def test_parse_files(spark, folder, tmp_path):
    got = {r.doc: r for r in parse_files(spark, str(folder), str(tmp_path / "out"), read_pdf, lambda picture, language: [("hola", 90.0), ("mundo", 80.0)]).collect()}
    assert {d: (r.pages, r.tables, r.images, r.charts, r.error) for d, r in got.items()} == {
        "one": (3, 2, 3, 1, None), "two": (1, 0, 0, 0, "ValueError: broken page"), "three": (0, 0, 0, 0, "ValueError: broken page"),
    }
    out = tmp_path / "out"
    assert sorted(str(p.relative_to(out)) for p in out.rglob("*") if p.is_file()) == ["images/one_p1_i0.png", "images/one_p1_i2.jpg", "images/one_p2_i0.png", "one.json", "one.md", "two.json", "two.md"]
    table = "| a |  |\n| --- | --- |\n| 1 | 2 |"
    page_1 = [table, "![Image 1, page 1](images/one_p1_i0.png)", "![Image 3, page 1](images/one_p1_i2.jpg)", "# Title", "before", "after"]
    text = (out / "one.md").read_text()
    assert text.startswith("# Title\n\n<!-- Page 1 -->\n\n") and "in the table" not in text
    assert sorted(text.split("<!-- Page 1 -->\n\n")[1].split("\n\n<!-- Page 2")[0].split("\n\n")) == sorted(page_1)
    first, second = text.index("before"), text.index("after")
    assert text.index(table) < text.index("# Title\n\nbefore") < first < second < text.index("<!-- Page 2 -->\n\nhola mundo") < text.index("<!-- Page 3 -->")
    assert (out / "two.md").read_text() == "# two\n\n<!-- Page 1 -->\n\n"
    assert json.loads((out / "one.json").read_text())["statistics"]["tables"] == 2 and (out / "images/one_p2_i0.png").read_bytes() == b"png"


def test_one_file_only(spark, folder, tmp_path):
    assert [r.path.rsplit("/", 1)[-1] for r in scan_pdfs(spark, str(folder), only="two").collect()] == ["two.pdf"] and scan_pdfs(spark, str(folder), only="two.pdf").count() == 1
    assert [r.doc for r in parse_files(spark, str(folder), str(tmp_path / "out"), read_pdf, only="two").collect()] == ["two"]
    assert not list((tmp_path / "out").rglob("one*"))


def test_optional_config(tmp_path):
    (tmp_path / "c.yaml").write_text("project: {name: x}")
    assert optional_config(str(tmp_path / "c.yaml")) == {"project": {"name": "x"}} and optional_config(str(tmp_path / "none.yaml")) is None and optional_config(None) is None


def test_command_line(spark, folder, tmp_path, capsys):
    given = ["parse", str(folder), str(tmp_path / "out"), "--extractor", "tests.test_pages_and_reindex:read_pdf"]
    assert main([*given, "--file", "one.pdf"], spark) == 0 and "one" in capsys.readouterr().out and (tmp_path / "out/one.json").exists()
    assert main([*given, "--file", "three"], spark) == 1
