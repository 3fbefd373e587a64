"""Known answers of the text expressions."""

import pytest
from pyspark.sql import functions as F

from loamgrid.functions import dates
from loamgrid.functions import markup
from loamgrid.functions import text as tx


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("text", "value", "percent"),
    [("1,234", 1234.0, False), ("12.5", 12.5, False), ("១២,០០០", 12000.0, False), ("(123)", -123.0, False), ("-5", -5.0, False), ("(-5)", -5.0, False), ("31.16%", 31.16, True), ("hello", None, False), ("", None, False), ("+5", None, False), ("1 234", 1234.0, False)],
)
def test_parse_number(spark, text, value, percent):
    got = one(spark, text, tx.parse_number)
    assert (got["value"], got["is_percent"]) == (value, percent)


@pytest.mark.parametrize(("text", "illegal"), [("ស្", True), ("ា", True), ("ស្ក", False), ("សាា", True), ("abc", False), ("", False)])
def test_sequence_illegal(spark, text, illegal):
    assert one(spark, text, tx.sequence_illegal) is illegal


def test_flags(spark):
    rows = [("12៣", 0.9, ["digit_mixed"]), ("x", 0.4, ["low_conf"]), ("x", 0.95, []), ("", 0.0, []), ("x", None, []), (None, 0.1, [])]
    df = spark.createDataFrame(rows, "t string, c double, want array<string>")
    assert all(r["f"] == r["want"] for r in df.select(tx.cell_flags(F.col("t"), F.col("c")).alias("f"), "want").collect())


@pytest.mark.parametrize(("text", "want"), [("អគ.ក", "៛/គ.ក"), ("#គ.ក", "៛/គ.ក"), ("វ/គ.ក", "៛/គ.ក"), ("អគៈក", "៛/គ.ក"), ("អគ:ក", "៛/គ.ក"), ("អគ.ក extra", "អគ.ក extra"), ("០.០០%", "0.00%"), ("-០.៥%", "-0.5%"), ("១", "១")])
def test_cell_rules(spark, text, want):
    assert one(spark, text, tx.cell_rules) == want


@pytest.mark.parametrize(("text", "bad"), [("7,8000", True), ("8333%", True), ("4,000", False), ("8.33%", False), ("5%", False), ("0.00%", False), ("៧,៨០០០", True)])
def test_malformed_number(spark, text, bad):
    assert one(spark, text, tx.malformed_number) is bad


def test_capped_confidence(spark):
    df = spark.createDataFrame([("7,8000", 0.97), ("8333%", None), ("4,000", 0.97)], "t string, c double")
    assert [r[0] for r in df.select(tx.capped_confidence(F.col("t"), F.col("c"))).collect()] == [0.4, 0.4, 0.97]


@pytest.mark.parametrize(("text", "want"), [("$1,250", True), ("(12.5)", True), ("7,8000", False), ("7,8000 USD", True), ("០,៧១១៧", True), ("12 kilogrammes of", False), ("7 800", True), ("abc", False)])
def test_is_numeric(spark, text, want):
    assert one(spark, text, tx.is_numeric) is want


def test_composition_and_spaces(spark):
    assert one(spark, " é  x ", tx.normalize) == "é x"
    assert one(spark, "សាច់គោ (សាច់សម្ល ) x y", tx.fold_spaces) == "សាច់គោ (សាច់សម្ល) x y"
    assert one(spark, "a​b\n  c\t\td", tx.clean_khmer) == "ab\n c d"


def test_cer(spark):
    df = spark.createDataFrame([("abc", "abd"), ("", "x"), ("", ""), ("a", "abcd")], "a string, b string")
    assert [round(r[0], 4) for r in df.select(tx.cer(F.col("a"), F.col("b"))).collect()] == [0.3333, 1.0, 0.0, 3.0]


def test_json_regions(spark):
    label = lambda raw: one(spark, raw, lambda c: F.transform(markup.parse_regions(c), lambda r: r["label"]))
    assert label('[{"label":"A"}]') == ["A"]
    assert label('{"label":"A"}') is None
    assert label("garbage") is None
    assert label('[{"label":"A"},{"label":"B"}') == ["A", "B"]
    assert label('{"label":"A"},{"label":"B"}') == ["A", "B"]
    assert label('[{"label":"A') is None


def test_markdown_and_html(spark):
    grid = [["a|b", "x  y"], ["only"], ["<1>", "&"]]
    md = one(spark, grid, markup.to_markdown, "array<array<string>>")
    assert md.splitlines()[0] == "| a\\|b | x y |" and md.splitlines()[1] == "| --- | --- |"
    assert one(spark, md, markup.from_markdown) == [["a|b", "x y"], ["only", ""], ["<1>", "&"]]
    html = one(spark, grid, markup.to_html, "array<array<string>>")
    assert '<tr><td colspan="2">only</td></tr>' in html and "&lt;1&gt;" in html
    cells = markup.html_cells(spark.createDataFrame([(1, html)], "k long, h string"), "k", "h").collect()
    assert {(c["row"], c["col"]): (c["text"], c["col_span"]) for c in cells}[(1, 0)] == ("only", 2)
    assert one(spark, [], markup.to_csv, "array<array<string>>") == "﻿"
    assert one(spark, [['a"b', "c,d"]], markup.to_csv, "array<array<string>>") == '﻿"a""b","c,d"\r\n'


def test_dates(spark):
    assert str(one(spark, "prices-03.02.24.pdf", dates.of_file_name)) == "2024-02-03"
    assert one(spark, "prices-32.02.24.pdf", dates.of_file_name) is None
    assert str(one(spark, "from 01-01-24 to 02-01-24 and 01-01-24", dates.of_heading)) == "2024-01-02"


def test_ctc(spark):
    assert one(spark, ["a", "a", "-", "a", "b", "b"], lambda c: tx.ctc_collapse(c, F.lit("-")), "array<string>") == ["a", "a", "b"]
