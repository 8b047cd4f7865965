import datetime as dt

import pytest
from pyspark.sql import functions as F

from remitgraph.functions import columns as c


def evaluate(spark, column, *values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def test_leading_zeros_and_bad_numbers(spark):
    assert evaluate(spark, c.long("v"), "010", "10", "abc", "", None) == [10, 10, None, None, None]
    assert evaluate(spark, c.double("v"), "1.5", "x", None) == [1.5, None, None]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_raw_time_ignores_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # 02:30 on 2022-03-13 does not exist in New York.
        got = evaluate(spark, c.raw_time("v"), "2022/09/01 00:20", "2022/03/13 02:30")
        assert got == [dt.datetime(2022, 9, 1, 0, 20), dt.datetime(2022, 3, 13, 2, 30)]
        text = evaluate(spark, c.iso_time(c.raw_time("v")), "2022/03/13 02:30")
        assert text == ["2022-03-13T02:30:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_raw_time_of_other_text_is_null(spark):
    bad = ["2022-09-01 00:20", "2022/9/1 0:20", "2022/13/01 00:20", "2022/09/01 25:00", "not-a-time", "", None]
    assert evaluate(spark, c.raw_time("v"), *bad) == [None] * len(bad)


def test_local_time(spark):
    at = dt.datetime(2022, 9, 1, 0, 20)
    got = evaluate(spark, c.local_time("v"), "2022-09-01T00:20:00", " 2022-09-01 00:20:00 ", "", "  ", "x", None)
    assert got == [at, at, None, None, None, None]


def test_account_key_is_whole_or_null(spark):
    df = spark.createDataFrame([(1, "a"), (None, "a"), (1, None), (1, " ")], "b bigint, n string")
    assert [r.k for r in df.select(c.account_key("b", "n").alias("k")).collect()] == ["1|a", None, None, None]


def test_label_rules_differ_between_raw_and_load(spark):
    assert evaluate(spark, c.code_flag("v"), "1", "0", "2", None, "x") == [True, False, False, None, None]
    texts = ["1", "TRUE", " true ", "yes", "", None]
    assert evaluate(spark, c.text_flag("v"), *texts) == [True, True, True, False, False, False]


def test_missing_with_and_without_trim(spark):
    assert evaluate(spark, c.missing("v"), None, "", " ", "a") == [True, True, True, False]
    assert evaluate(spark, c.missing("v", trim=False), None, "", " ", "a") == [True, True, False, False]


def test_row_id_marks_nulls(spark):
    import hashlib

    expected = hashlib.sha256(b"a||<NULL>||1.23456789E7").hexdigest()
    got = evaluate(spark, c.row_id(F.lit("a"), F.lit(None), F.col("v")), 12345678.9, kind="double")
    assert got == [expected]


def test_clamp_and_cap(spark):
    assert evaluate(spark, c.clamp("v"), None, 0, 5, 99, kind="int") == [5, 1, 5, 20]
    assert evaluate(spark, c.result_cap("v"), None, 10, 99, kind="int") == [50, 10, 50]


def test_total_of_nothing_is_zero(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert df.agg(c.money_total("v").alias("t")).first().t == 0.0


def test_total_keeps_small_amounts(spark):
    df = spark.createDataFrame([(0.000034,), (0.1,), (0.2,)], "v double")
    assert df.agg(c.money_total("v").alias("t")).first().t == 0.300034


def test_same_name_and_direction(spark):
    df = spark.createDataFrame([("Ab", "aB"), ("a", "b"), (None, "b")], "x string, y string")
    assert [r.s for r in df.select(c.same_name("x", "y").alias("s")).collect()] == [True, False, None]
    got = [r.d for r in df.select(c.direction("x", "x", "OUTGOING", "INCOMING").alias("d")).collect()]
    assert got == ["OUTGOING", "OUTGOING", "INCOMING"]
