from datetime import date

import pytest
from pyspark.sql import functions as F

from spanwise.functions import dates, logic, numbers

C = lambda name: F.col(name)


def test_unknown_condition_gives_unknown(values):
    got = values([(True,), (False,), (None,)], "c boolean", lambda: logic.if_known(C("c"), F.lit(1), F.lit(0)))
    assert got == [1, 0, None]


def test_three_valued_and_short_circuits_to_false(values):
    rows = [(None, 0), (None, 1), (3, 1), (3, 0)]
    got = values(rows, "days int, admitted int", lambda: logic.if_known((C("days") > 0) & (C("admitted") == 1), F.lit(1), F.lit(0)))
    assert got == [0, None, 1, 0]


def test_first_label_passes_over_unknown_rules(values):
    build = lambda: logic.first_label((C("x") > 10, "big"), (C("y") > 0, "y"), default="other")
    assert values([(11, 1), (None, 1), (None, None), (1, 0)], "x int, y int", build) == ["big", "y", "other", "other"]


def test_bands_are_left_closed_and_open_ended(values):
    build = lambda: logic.band(C("x"), [16, 70, 80, float("inf")], ["16-69", "70-79", "80+"])
    got = values([(15,), (16,), (69,), (70,), (79,), (80,), (120,), (None,)], "x int", build)
    assert got == [None, "16-69", "16-69", "70-79", "70-79", "80+", "80+", None]
    with pytest.raises(ValueError):
        logic.band(C("x"), [1, 2], ["a", "b"])


def test_level_order(values):
    assert values([("b",), ("z",), (None,)], "x string", lambda: logic.label_order(C("x"), ["a", "b"])) == [2, None, None]


def test_strict_and_lenient_row_minimum(values):
    rows = [(3, 1), (None, 2), (None, None)]
    assert values(rows, "a int, b int", lambda: logic.row_min(C("a"), C("b"))) == [1, 2, None]
    assert values(rows, "a int, b int", lambda: logic.row_min_strict(C("a"), C("b"))) == [1, None, None]


def test_satisfying_counts_unknown_as_false(values):
    rows = [(True, None), (True, True), (None, False), (True, False)]
    assert values(rows, "a boolean, b boolean", lambda: logic.satisfying([C("a")], [C("b")])) == [True, False, False, True]


def test_window_bounds_are_inclusive_and_unknown_bounds_match_nothing(values):
    d = lambda n: date(2021, 1, n)
    rows = [(d(1), d(1), d(3)), (d(3), d(1), d(3)), (d(4), d(1), d(3)), (d(2), None, d(3)), (None, d(1), d(3))]
    schema, inside = "e date, lo date, hi date", lambda: dates.within(C("e"), C("lo"), C("hi"))
    assert values(rows, schema, inside) == [True, True, False, None, False]
    assert values(rows, schema, lambda: F.when(inside(), 1).otherwise(0)) == [1, 1, 0, 0, 0]


def test_an_unknown_window_bound_passes_no_filter(spark):
    df = spark.createDataFrame([(date(2021, 1, 2), None), (date(2021, 1, 2), date(2021, 1, 1))], "e date, lo date")
    assert df.where(dates.within(C("e"), C("lo"))).count() == 1


def test_time_to_event_skips_unknown(values):
    d = lambda n: date(2021, 1, n)
    rows = [(d(1), d(5), d(9)), (d(1), d(9), d(5)), (d(1), None, d(5)), (d(1), d(5), None), (None, d(5), d(5))]
    schema = "o date, e date, c date"
    assert values(rows, schema, lambda: dates.time_to_event(C("o"), C("e"), C("c"))) == [4, 4, 4, 4, None]
    assert values(rows, schema, lambda: dates.time_to_event(C("o"), C("e"), C("c"), True)) == [4, 8, None, 4, None]


def test_completed_years_and_leap_day(values):
    rows = [(date(1950, 4, 1), date(2021, 3, 31)), (date(1950, 3, 31), date(2021, 3, 31))]
    assert values(rows, "b date, o date", lambda: dates.completed_years(C("b"), C("o"))) == [70, 71]
    assert values([(date(2020, 2, 29),)], "d date", lambda: dates.years_before(C("d"), 1)) == [date(2019, 2, 28)]


def test_rounding_is_half_even(values):
    assert values([(2.5,), (3.5,), (-2.5,), (None,)], "x double", lambda: numbers.round_half_even(C("x"))) == [2.0, 4.0, -2.0, None]
    assert values([(12.0,), (12.5,), (13.0,), (17.5,)], "x double", lambda: numbers.round_to_base(C("x"), 5.0)) == [10.0, 10.0, 15.0, 20.0]


def test_percentage_of_nothing_is_unknown(values):
    assert values([(1, 8), (1, 0)], "a int, b int", lambda: numbers.percent_of(C("a"), C("b"))) == [12.0, None]


def test_number_text_and_cells(values):
    assert values([(98.06,), (4.8,), (149.0,), (5912498.0,), (0.0,), (100.0,), (None,)], "x double", lambda: numbers.number_text(C("x"))) == [
        "98.06", "4.8", "149", "5912498", "0", "100", None]
    got = values([(4.77, 4.74, 4.8), (None, None, None)], "r double, l double, u double", lambda: numbers.rate_cell(C("r"), C("l"), C("u")))
    assert got == ["4.77 (4.74-4.8)", "[REDACTED] ([REDACTED]-[REDACTED])"]


def test_masks_and_parsing(values):
    assert values([(7,), (8,)], "n int", lambda: numbers.mask_text(C("n"))) == ["<8", "8"]
    assert values([(0,), (7,), (8,)], "n int", lambda: numbers.mask_between(C("n"))) == [None, None, 8]
    assert values([("1,234 (5.6%)",), ("12 345 (1%)",), ("Unknown",)], "c string", lambda: numbers.parse_count_cell(C("c"))) == [1234.0, 12345.0, None]
    assert values([("group=80+ (priority group 2)",), ("a=b=c",)], "c string", lambda: numbers.strata_label(C("c"))) == ["80+ (priority group 2)", "c"]
