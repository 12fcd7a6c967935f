"""Edits at a path, gold at a place, workbook columns, p values of large counts."""

import io
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import parse, stats
from tallyforge.operators import selection
from tallyforge.sources import adapters


def test_edits_at_a_path(spark):
    rows = [
        ('{"b": [1.50, {"t": "old and é"}], "a": null}', ["b", "1", "t"], "old", "new"), ('{"b": "old old"}', ["b"], "old", "new"), ('{"b": 3}', ["b"], "3", "4"), ('{"b": "x"}', ["c"], "x", "y"), ('["x"]', ["1"], "x", "y"), ("plain old text", [], "old", "new"),
        ("plain", None, "zz", "new"), ('{"b": "x"}', ["b"], " ", "y"), ('{"b": "x"}', ["b"], "x", "x"), (None, ["b"], "x", "y"), ('{"b": "x"}', ["b", "c"], "x", "y"),
    ]
    df = spark.createDataFrame(rows, "s string, p array<string>, a string, b string")
    got = [r["e"] for r in df.select(parse.edit_at("s", "p", "a", "b").alias("e")).collect()]
    assert got == ['{"b": [1.5, {"t": "new and é"}], "a": null}', None, None, None, None, "plain new text", None, None, None, None, None]


def test_gold_lies_at_its_place(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], "c", 0), (["a", "b", "c", "d"], "a", 2), (["a", "b"], "b", 9), (["a"], "z", 0)], "c array<string>, g string, p int")
    got = [r["x"] for r in df.select(parse.gold_at(F.col("c"), F.col("g"), F.col("p"), F.lit("r"), 1).alias("x")).collect()]
    assert got[0][0] == "c" and got[1][2] == "a" and got[2] == ["a", "b"] and got[3] is None and sorted(got[1]) == ["a", "b", "c", "d"]


def book():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = '<row r="1"><c r="C1" t="s"><v>0</v></c></row><row r="2"><c r="B2"><v>9</v></c><c r="C2" t="s"><v>1</v></c></row><row r="3"><c r="C3"/></row><row r="4"><c r="C4" t="inlineStr"><is><t>in</t></is></c></row><row r="5"><c r="C5"><v>2.5</v></c></row><row r="62"><c r="C62"><v>1</v></c></row>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>head</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")
    return data.getvalue()


def test_sheet_columns(spark, tmp_path):
    (tmp_path / "b.xlsx").write_bytes(book())
    got = adapters.read_sheet_column(spark, str(tmp_path / "b.xlsx")).orderBy("row").collect()
    assert [(r["row"], r["value"]) for r in got] == [(2, "two runs"), (4, "in"), (5, "2.5")]
    assert adapters.read_sheet_column(spark, str(tmp_path / "b.xlsx"), "Z").count() == 0


def test_p_values_of_small_and_large_counts(spark):
    def exact(a, b):
        n, k = a + b, min(a, b)
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)

    cases = [(0, 0), (0, 1), (1, 1), (2, 9), (30, 30), (0, 60), (15, 16), (16, 40), (500, 600), (4900, 5100)]
    df = spark.createDataFrame([*cases, (49_990_000, 50_010_000)], "a long, b long")
    for r in df.select("a", "b", stats.mcnemar(F.col("a"), F.col("b")).alias("p")).collect():
        expected = exact(r["a"], r["b"]) if r["a"] < 10_000 else math.erfc(abs(r["a"] - r["b"] + 1) / math.sqrt(2 * (r["a"] + r["b"])))
        assert abs(r["p"] - expected) <= (1e-12 if r["a"] < 10_000 else 1e-6) * max(expected, 1e-300)


def test_sources_by_attempts_and_by_acceptance(spark):
    schema = "b string, s string, a int, g int, f int, o int, z int, a0 int, g0 int"
    rows = [("early", "x", 2, 2, 0, 3, 5, 0, 0), ("early", "y", 1, 0, 9, 3, 5, 0, 0), ("rate", "x", 9, 8, 0, 6, 5, None, None), ("rate", "y", 1, 0, 0, 6, 5, 0, 0), ("window", "x", 9, 8, 0, 6, 5, 9, 8), ("window", "y", 3, 2, 0, 6, 5, 0, 0), ("turn", "x", 9, 8, 0, 9, 5, 0, 0), ("turn", "y", 1, 0, 0, 9, 5, 0, 0), ("none", "y", 1, 0, 0, 9, None, 0, 0), ("none", "x", 1, 0, 0, 9, None, 0, 0)]
    df = spark.createDataFrame(rows, schema)
    choose = lambda d: {r["b"]: r["s"] for r in selection.choose_source(d, ["b"], "s", "a", "g", "f", "o", "z", "a0", "g0").collect()}
    assert choose(df) == {"early": "y", "rate": "x", "window": "y", "turn": "y", "none": "x"}
    with pytest.raises(Exception, match="does not fit"):
        choose(df.withColumn("a0", F.lit(99)))
