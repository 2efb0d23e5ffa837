"""SQL functions and table functions give what the column functions give, in one stage."""

import pytest
from pyspark.sql import functions as F

from lakescribe.operators import chunking
from lakescribe.plans import sqlfunctions
from tests.oracle import session

LONG = "\n\n".join(f"paragraph {i} " + "word " * 90 for i in range(40))
TEXTS = [
    None, "", " \n ", "plain words", "# A\n\n" + "it's a \\ back`slash \"quote\" = (1.5) " * 40, "## Long\n\n" + LONG, "## S\n\n" + "w " * 90 + "\n\n### One\n\n" + LONG + "\n\n## T\n\n" + "z " * 2500,
    "## Skip me\n\n" + "a " * 300 + "\n\n## Kept\n\n<!-- Page 3 -->\n| a | b |\n" * 60, "![alt text](a.png)\n\nalt text\n\n## H\n\n" + "- item 5,5 %\n" * 120,
]


@pytest.fixture(scope="module")
def spark():
    return session()


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, x, f"c{i % 2}" if i % 3 else "") for i, x in enumerate([*TEXTS, TEXTS[5]])], "id int, text string, city string")


def same(a, b):
    assert sorted(map(repr, a.select(*b.columns).collect())) == sorted(map(repr, b.collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("skip", [(), ("Skip me",)])
def test_chunk_document_equals_process_documents_in_one_stage(spark, docs, skip):
    sqlfunctions.register(spark, skip_exact=skip)
    found = spark.sql("SELECT d.id, d.city, c.* FROM {docs} d, LATERAL chunk_document(d.text, CASE WHEN d.city <> '' THEN concat('city: ', d.city) END) c", docs=docs)
    want = chunking.process_documents(docs, ["city"], skip_exact=skip, keep=("id",))
    assert want.count() > 15
    same(found, want)
    assert "Join" not in plan(found) and "Exchange" not in plan(found) and "Aggregate" not in plan(found)


def test_context_can_be_left_out_and_null_texts_have_no_chunks(spark, docs):
    sqlfunctions.register(spark)
    found = spark.sql("SELECT d.id, c.chunk_index, c.text FROM {docs} d, LATERAL chunk_document(d.text) c", docs=docs)
    same(found, chunking.process_documents(docs, keep=("id",)).select("id", "chunk_index", "text"))
    assert found.filter("id = 0").count() == 0
    outer = spark.sql("SELECT id, c.text FROM (SELECT id, chunks_of(text) AS chunks FROM {docs}) LATERAL VIEW OUTER inline(chunks) c", docs=docs)
    assert {r.id for r in outer.collect()} == set(range(len(TEXTS) + 1))
    assert spark.sql("SELECT * FROM chunk_document(repeat('## A\n\nb c ', 3))").count() == 0


def test_scalar_functions_equal_their_columns(spark, docs):
    sqlfunctions.register(spark, ["skip ME"], ["kep"])
    for name, (params, body) in sqlfunctions.scalar_functions(["skip ME"], ["kep"]).items():
        if name == "chunks_of":
            continue
        one = docs.select("id", body(F.col("text")).alias("out"))
        same(spark.sql(f"SELECT id, {name}(text) AS out FROM {{docs}}", docs=docs), one)


def test_sections_function(spark, docs):
    sqlfunctions.register(spark)
    found = spark.sql("SELECT d.id, s.title, s.level, size(s.subsections) AS n FROM {docs} d, LATERAL document_sections(d.text) s", docs=docs)
    assert {(r.title, r.level, r.n) for r in found.filter("id = 6").collect()} == {("S", 2, 1), ("T", 2, 0)}
    assert "Join" not in plan(found) and "Exchange" not in plan(found)


def test_signs_inside_strings_stay(spark):
    text = F.lit("a =( '1.5' \\ +(\n`*(` 2.5")
    column = F.concat(text, F.when(F.length(text) * F.lit(1.3) >= F.lit(2.5), F.lit(" -(")).otherwise("x"), (-F.length(text) - 1).cast("string"))
    rows = spark.range(1)
    assert rows.selectExpr(sqlfunctions.sql_of(column)).head()[0] == rows.select(column).head()[0]
    assert rows.selectExpr(sqlfunctions.sql_of(F.lit(3) * F.lit(1.1))).schema[0].dataType.simpleString() == "double"


def test_tables_with_clashing_names(spark, docs):
    sqlfunctions.register(spark)
    clash = docs.withColumnsRenamed({"city": "context"}).withColumn("chunk_index", F.lit(-1)).withColumn("x_1", F.lit("y"))
    found = spark.sql("SELECT d.id, d.chunk_index AS own, c.chunk_index FROM {d} d, LATERAL chunk_document(d.text) c", d=clash)
    assert {r.own for r in found.collect()} == {-1} and found.filter("chunk_index > 0").count() > 5
    assert spark.sql("SELECT d.id, c.* FROM {d} d, LATERAL chunk_document(d.text) c", d=clash.limit(0)).count() == 0
