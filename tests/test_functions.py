"""Scalar, text and vector expressions on literal rows."""

import pytest
from pyspark.sql import functions as F

from shelfscope.functions import scalars as X
from shelfscope.functions import text as TX
from shelfscope.functions.vectors import unit
from shelfscope.functions.scalars import safe_column


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression.alias("o")).first()["o"]


@pytest.mark.parametrize("positive, total, expected", [(30, 30, 0.8865), (950, 1000, 0.9347), (0, 0, 0.0), (None, 10, 0.0)])
def test_wilson(spark, positive, total, expected):
    row = spark.createDataFrame([(positive, total)], "p long, n long")
    assert row.select(X.wilson_lower_bound("p", "n")).first()[0] == pytest.approx(expected, abs=1e-4)


@pytest.mark.parametrize("text, lower, mid", [
    ("100000 - 200000", 100000.0, 150000.0), ("20,000 - 50,000", 20000.0, 35000.0), ("0 - 20000", 0.0, 10000.0),
    ("unknown", None, 10000.0), (None, None, 10000.0), ("1 - 2 - 3", 1.0, 10000.0)])
def test_owner_ranges(spark, text, lower, mid):
    assert one(spark, text, X.owners_lower("v")) == lower
    assert one(spark, text, X.owners_mid("v")) == mid


@pytest.mark.parametrize("text, items", [
    ("{'Survival': 14838, 'FPS': 12}", ["Survival", "FPS"]), ("['A', \"B's\"]", ["A", "B's"]), ("['it\\'s']", ["it's"]),
    ("['A', 'B',]", ["A", "B"]), ("['A', None]", ["A", None]), ("['None of us']", ["None of us"]), ("{'A': None,}", ["A"]),
    ("{'A': 1, 'A': 2}", ["A"]), ("[1, 2]", ["1", "2"]), (None, []), ("nan", []), ("['broken", []), ("5", []), ("", []), ("[]", []), ("{}", [])])
def test_parse_list(spark, text, items):
    assert one(spark, text, X.parse_list("v")) == items


@pytest.mark.parametrize("text, day", [
    ("2020-02-29", "2020-02-29"), ("Oct 21, 2008", "2008-10-21"), ("21 Oct, 2008", "2008-10-21"), ("Oct 2008", "2008-10-01"),
    ("2008/10/21", "2008-10-21"), ("2008-10-21 10:00:00", "2008-10-21"), ("soon", None), (None, None), ("2020-02-31", None)])
def test_dates(spark, text, day):
    assert one(spark, text, X.parse_release_date("v").cast("date").cast("string")) == day


@pytest.mark.parametrize("value, year", [("-2", 2015), ("18", 2018), ("2020", 2020), ("2019.0", 2019), ("x", None), (None, None)])
def test_repair_year(spark, value, year):
    assert one(spark, value, X.repair_year("v")) == year


def test_numbers_and_clips(spark):
    assert one(spark, "12.5", X.to_number("v")) == 12.5
    assert one(spark, "free", X.to_number("v")) == 0.0
    assert one(spark, None, X.clip(F.col("v").cast("double"), 0.0, 21.0)) is None
    assert one(spark, 99.0, X.clip("v", 0.0, 21.0), "double") == 21.0


def test_safe_name_matches_python_twin(spark):
    text = "Action-RPG / Co op with a very long tail"
    assert one(spark, text, X.safe_name("v")) == safe_column(text) == "action_rpg___co_op_with_a_very"


@pytest.mark.parametrize("text, words", [("", 0), ("  ", 0), ("one", 1), (" a  b\tc\n", 3)])
def test_word_count(spark, text, words):
    assert one(spark, text, X.word_count("v")) == words


def test_missing_calendar_fields_follow_the_date(spark):
    made = X.calendar("d")
    row = spark.sql("SELECT DATE'2024-12-02' AS d").select(*[c.alias(n) for n, c in made.items()]).first()
    assert (row["release_year"], row["release_month"], row["release_dow"], row["is_q4_release"]) == (2024, 12, 0, 1)
    assert row["month_cos"] == pytest.approx(1.0)


def test_term_counts(spark):
    got = one(spark, "The red Fox and the red fox: a red_1 x", TX.term_counts("v"))
    assert {r["term"]: r["tf"] for r in got} == {
        "red": 2, "fox": 2, "red fox": 2, "fox red": 1, "red_1": 1, "fox red_1": 1}
    assert one(spark, None, TX.term_counts("v")) == []
    assert [r["term"] for r in one(spark, "alone", TX.term_counts("v"))] == ["alone"]
    threes = one(spark, "aa bb cc dd", TX.term_counts("v", 3))
    assert {r["term"] for r in threes} == {"aa", "bb", "cc", "dd", "aa bb", "bb cc", "cc dd", "aa bb cc", "bb cc dd"}


def test_unit(spark):
    assert one(spark, [3.0, 4.0], unit("v"), "array<double>") == [0.6, 0.8]
    assert one(spark, [0.0, 0.0], unit("v"), "array<double>") == [0.0, 0.0]
