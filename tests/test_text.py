from pyspark.sql import functions as F

from tarn.functions import text as X
from tarn.functions.chunk_rules import with_chunk_type

CASES = {
    "heading_only": "# Plan\n\n## Part two",
    "json": '{"colour": "teal", "n": 3}',
    "code": "```sh\nmake all\n```",
    "table": "| fruit | price |\n|---|---|\n| pear | 2 |\n| plum | 3 |",
    "faq": "Q: Is it open?\nA: On weekdays.",
    "transcript": "Ada:\nshall we begin\nBen:\nyes please",
    "quote": '"Measure twice, cut once."\n— an old joiner',
    "contact": "Write to us\nphone: 555 0100",
    "address": "12 Harbour Road\nLeeds",
    "appendix": "Appendix B: tables\nrows follow",
    "glossary": "Keel: the spine of a hull\nBoom: the spar below a sail",
    "structured_list": "1. boil water\n2. add salt",
    "list": "- tea\n- milk\n- [x] sugar",
    "content": "A plain sentence about the tide, without any marks.",
}


def test_types(spark):
    rows = with_chunk_type(spark.createDataFrame([(k, v) for k, v in CASES.items()], "want string, text string"), "text", "got").collect()
    assert {r["want"]: r["got"] for r in rows} == {k: k for k in CASES}


def test_blank_and_null_are_content(spark):
    rows = with_chunk_type(spark.createDataFrame([(None,), ("",), ("  \n ",)], "text string"), "text", "t").collect()
    assert [r["t"] for r in rows] == ["content"] * 3


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tables(spark):
    t = F.lit("| fruit | price |\n|---|---|\n| pear | 2 |")
    assert one(spark, X.described_table(t, F.lit("Shop"))) == "Table from section: Shop. Columns: fruit, price. Contains 1 row. fruit pear, price 2."
    assert one(spark, X.table_headers(t)) == ["fruit", "price"]
    assert one(spark, X.table_cells(t)) == ["pear", "2"]
    assert one(spark, X.described_table(F.lit("no table"))) == ""


def test_scalars(spark):
    assert one(spark, X.repair_hyphenation(F.lit("har-\n bour"))) == "harbour"
    assert one(spark, X.stem(F.lit("berries"))) == "berry"
    assert one(spark, X.invented_numbers(F.lit("in 1999 and 7%"), F.lit("what of 1999"))) == ["7%"]
    assert one(spark, X.contextualised(F.lit("when?"), F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == "b\nc\nwhen?"
    assert one(spark, X.question_list(F.lit("- Is it so?\n- Why does it rain\n2) How"))) == ["Why does it rain?", "How?"]
    assert one(spark, X.preview(F.lit("x" * 300))) == "x" * 237 + "..."
    assert one(spark, X.without_headings(F.lit("# A\nbody\n## B\nmore"))) == "body\nmore"
    assert one(spark, X.service_of(F.lit("kube.backend.log"))) == "backend"
    assert one(spark, X.date_precision(F.lit("3 May 2020"))) == "day"
