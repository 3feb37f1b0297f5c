"""Column functions on hand-made inputs."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewatch import functions as fn


def apply(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_norm_text(spark):
    got = apply(spark, [(None,), ("  Solu-Medrol (IV)/x+ ",), ("a\t\tb",), ("éa",)], "s string", fn.norm_text("s"))
    assert got == ["", "SOLU-MEDROL IV X+", "A B", "A"]


def test_safe_double_rejects_java_spellings(spark):
    got = apply(spark, [("12d",), ("1e2",), (" 3 ",), ("NaN",), ("",), (None,), ("-.5",)], "s string", fn.safe_double("s"))
    assert got == [None, 100.0, 3.0, None, None, None, -0.5]


@pytest.mark.parametrize("unit, factor", [
    (None, 1), ("", 1), ("yr", 1), ("YEARS", 1), ("MON", 1 / 12), ("WK", 1 / 52), ("DY", 1 / 365.25), ("DECADE", 10),
])
def test_age_units(spark, unit, factor):
    (got,) = apply(spark, [("18", unit)], "a string, u string", fn.age_to_years("a", "u"))
    assert got == pytest.approx(18 * factor)


def test_age_bad_input(spark):
    got = apply(spark, [("12x", "YR"), ("", "YR"), (None, "YR"), ("5", "HR")], "a string, u string", fn.age_to_years("a", "u"))
    assert got == [None] * 4


def test_age_bands(spark):
    ages = [None, -1.0, 0.0, 17.9, 18.0, 39.0, 39.5, 40.0, 64.0, 64.5, 65.0]
    rows = [(a,) for a in ages]
    assert apply(spark, rows, "a double", fn.age_band("a")) == [
        None, None, None, "<18", "18-39", "18-39", None, "40-64", "40-64", None, "65+"]
    assert apply(spark, rows, "a double", fn.age_band_cut("a"))[3:] == [
        "<18", "18-39", "18-39", "18-39", "40-64", "40-64", "40-64", "65+"]


def test_onset_bins(spark):
    days = [None, -3.0, 0.0, 7.0, 8.0, 30.0, 31.0, 90.0, 91.0, 365.0, 366.0]
    assert apply(spark, [(d,) for d in days], "d double", fn.tto_bin("d")) == [
        "Missing", "0-7d", "0-7d", "0-7d", "8-30d", "8-30d", "31-90d", "31-90d", "91-365d", "91-365d", ">365d"]


@pytest.mark.parametrize("values, dtype, want", [
    (["1", "Y", "y", "YES", "true", "TRUE", "1.0", None], T.StringType(), [1, 1, 0, 1, 0, 1, 0, 0]),
    ([1.0, 0.0, 2.0, None], T.DoubleType(), [1, 0, 0, 0]),
    ([True, False, None], T.BooleanType(), [1, 0, 0]),
])
def test_truthy(spark, values, dtype, want):
    schema = T.StructType([T.StructField("v", dtype)])
    assert apply(spark, [(v,) for v in values], schema, fn.truthy("v", dtype)) == want


def test_indication_fragments_and_whole_words(spark):
    rows = [("MIGRAINE",), ("RA",), ("KIDNEY TRANSPLANT IN LUPUS",), ("hsct",), (None,), ("",)]
    assert apply(spark, rows, "s string", fn.indication_group("s")) == [
        "Autoimmune diseases", "Autoimmune diseases", "Transplantation", "Transplantation", "Other", "Other"]
    assert apply(spark, rows, "s string", fn.indication_group("s", whole_word=True))[:2] == [
        "Other", "Autoimmune diseases"]


def test_shortest_words_keep_the_same_matches():
    from casewatch import defaults as D
    from casewatch.functions.text import shortest_words

    for words in (D.TRANSPLANT_WORDS, D.AUTOIMMUNE_WORDS):
        kept = shortest_words(words)
        assert all(any(k in w for k in kept) for w in words)
        assert set(kept) <= set(words)


def test_sex_dummies(spark):
    rows = [("M",), ("f",), ("X",), (None,), (" male ",)]
    assert apply(spark, rows, "s string", fn.sex_male("s")) == [1, 0, 0, 0, 1]
    assert apply(spark, rows, "s string", fn.sex_unknown("s")) == [0, 0, 1, 0, 0]


def test_risk_categories(spark):
    rows = [(p,) for p in (0.0, 0.0199, 0.02, 0.05, 1.0, None)]
    assert apply(spark, rows, "p double", fn.risk_category("p")) == ["Low", "Low", "Moderate", "High", "High", None]


@pytest.mark.parametrize("p", [1.0, 0.5, 0.05, 0.0123456, 0.00099999, 1e-4, 9.9996e-5, 2.5e-5, 1.2345e-17, 0.0])
def test_p_value_text(spark, p):
    assert apply(spark, [(p,)], "p double", fn.format_p("p")) == [f"{p:.3g}"]


TABLES = {"plain": (10, 20, 30, 40), "one zero": (0, 5, 7, 9), "all zero": (0, 0, 0, 0)}


@pytest.mark.parametrize("cells", TABLES.values(), ids=TABLES)
def test_event_major_measures(spark, cells):
    row = fn.with_metrics(spark.createDataFrame([cells], "a long, b long, c long, d long"), "event_major").first()
    a, b, c, d = (x if x else 0.5 for x in cells)
    ror, se, n = (a / c) / (b / d), math.sqrt(1 / a + 1 / b + 1 / c + 1 / d), a + b + c + d
    assert row["N"] == n
    assert row["ROR"] == pytest.approx(ror)
    assert row["LCL_ROR"] == pytest.approx(math.exp(math.log(ror) - 1.96 * se))
    assert row["PRR"] == pytest.approx((a / (a + c)) / (b / (b + d)))
    assert row["chi2"] == pytest.approx(n * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d)))
    assert (row["a"], row["b"], row["c"], row["d"]) == cells


@pytest.mark.parametrize("cells", TABLES.values(), ids=TABLES)
def test_exposure_major_measures(spark, cells):
    row = fn.with_metrics(spark.createDataFrame([cells], "a long, b long, c long, d long"), "exposure_major").first()
    h = 0.5 if min(cells) == 0 else 0
    a, b, c, d = (x + h for x in cells)
    n = a + b + c + d
    ic = math.log2(a * n / ((a + b) * (a + c)))
    var = max((1 / a - 1 / (a + b) - 1 / (a + c) + 1 / n) / math.log(2) ** 2, 0)
    assert row["ROR"] == pytest.approx(a * d / (b * c))
    assert row["PRR"] == pytest.approx((a / (a + b)) / (c / (c + d)))
    assert row["IC"] == pytest.approx(ic)
    assert row["IC025"] == pytest.approx(ic - 1.96 * math.sqrt(var))


def test_unknown_modes_are_errors(spark):
    df = spark.createDataFrame([(1, 1, 1, 1)], "a int, b int, c int, d int")
    with pytest.raises(ValueError):
        fn.with_metrics(df, "sideways")
    with pytest.raises(ValueError):
        fn.with_metrics(df, correction="none")


def test_flag_names():
    assert fn.flag_name("mTOR inhibitors") == "flag_mtor_inhibitors"
    assert fn.flag_name("(A)/b", "x_") == "x_a_b"


def test_order_key(spark):
    assert apply(spark, [("b",), ("a",), ("z",), (None,)], "s string", fn.order_key("s", ["a", "b"])) == [2, 1, 3, 3]


def test_zero_fill(spark):
    df = spark.createDataFrame([(None, "x"), (2, "3")], "a int, b string")
    assert [tuple(r) for r in fn.zero_fill(df, ["a", "b", "c.d"]).collect()] == [(0.0, 0.0, 0.0), (2.0, 3.0, 0.0)]
