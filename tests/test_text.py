"""Cleaning rules X4-X25 and the lookups J1-J3, W15 on FIXTURES.md rows."""

import pytest
from pyspark.sql import functions as F

from ordersight.functions import text as X
from ordersight.operators import enrich as EN


def _one(spark, col_type, values, fn):
    df = spark.createDataFrame([(v,) for v in values], f"v {col_type}")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_phone_and_area_code(spark):
    vals = ["503-555-0100", "1 503 555 0100", "12", None, "abc", "+44 20 7946 0958"]
    std = _one(spark, "string", vals, X.standardize_phone)
    assert std == ["+1 (503) 555-0100", "+1 (503) 555-0100", "12", "", "", "442079460958"]
    codes = _one(spark, "string", std, X.area_code)
    assert codes == ["503", "503", "UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
    assert _one(spark, "string", codes, X.blank_unknown) == ["503", "503", "", "", "", ""]


def test_postcode_and_state(spark):
    vals = ["97209-1234", " 97209-12 ", "97209", None, "02139-123456"]
    assert _one(spark, "string", vals, X.zip_main) == ["97209", "97209", "97209", None, "02139"]
    assert _one(spark, "string", vals, X.zip_extra) == ["1234", "12", None, None, "1234"]
    assert _one(spark, "string", vals, X.zip5) == ["97209", " 9720", "97209", None, "02139"]
    states = [" New York ", "oregon", "CA", "Ontario", "dc", None]
    assert _one(spark, "string", states, X.state_code) == ["NY", "OR", "CA", "ONTARIO", "DC", None]


def test_email(spark):
    vals = ["a@gmail.com", "a@u.edu", "b@shop.com", "x.example.org", None, "a@b@c.net", "z@web.de"]
    dom = _one(spark, "string", vals, X.email_domain)
    assert dom == ["gmail.com", "u.edu", "shop.com", "UNKNOWN", "UNKNOWN", "b", "web.de"]
    cat = _one(spark, "string", dom, X.email_category)
    assert cat == ["PERSONAL", "EDUCATION", "CORPORATE", "UNKNOWN", "UNKNOWN", "OTHER", "OTHER"]


def test_company(spark):
    vals = [None, "  ", "Retired", "Guest", "self employed llc", "Title (optional)", "Acme", "unknown"]
    assert _one(spark, "string", vals, X.company_category) == [
        "UNKNOWN", "UNKNOWN", "RETIREMENT", "PERSONAL", "PERSONAL", "UNKNOWN", "BUSINESS", "UNKNOWN"]
    assert _one(spark, "string", vals, X.has_company) == [False, False, True, True, True, True, True, True]


def test_person_keys(spark):
    df = spark.createDataFrame([("Ana ", "TEST", "97209"), (None, "Solo", None), ("ana", "Test", None)],
                               "f string, l string, z string")
    r = df.select(X.customer_identifier("f", "l", "z").alias("c"), X.person_key("f", "l", "z").alias("p")).collect()
    assert [x["c"] for x in r] == ["ana _test_97209", None, "ana_test_nan"]
    assert [x["p"] for x in r] == ["ana test 97209", None, "ana test "]


def test_income_and_margins(spark):
    inc = ["61234", "80,500", "250,000+", "2,500-", "-", "N", "(X)", None]
    assert _one(spark, "string", inc, X.income) == [61234.0, 80500.0, 250000.0, 2500.0, None, None, None, None]
    moe = ["3000", "***", "**", "-", "N", "1,234", None]
    assert _one(spark, "string", moe, X.margin) == [3000.0, None, None, None, None, 1234.0, None]
    df = spark.createDataFrame([("***", "1"), ("1", "***"), ("1", None), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(X.income_censored("a", "b")).collect()] == [True, True, False, False]


def test_flags(spark):
    assert _one(spark, "string", ["9", "", None], X.used_coupon) == [1, 0, 0]
    assert _one(spark, "string", ["M", "F", "Unknown", None], X.gender_binary) == [1, 0, None, None]
    assert _one(spark, "double", [0.3773, 0.3772], X.yes_no) == ["Yes", "No"]


def test_gender_lookup(spark):
    names = spark.createDataFrame([(" Ana ", "F", 0.9), ("ana", "M", 0.1), ("Sam", "M", 0.5),
                                   ("sam", "F", 0.5)], "Name string, Gender string, Probability double")
    best = {r["name_key"]: (r["gender"], r["probability_of_gender"]) for r in EN.best_gender(names).collect()}
    assert best == {"ana": ("F", 0.9), "sam": ("F", 0.5)}
    orders = spark.createDataFrame([("Ana",), (" ana",), (None,), ("Bob",)], "billing_first_name string")
    g = [(r["gender"], r["probability_of_gender"]) for r in
         EN.add_gender(orders, EN.best_gender(names)).collect()]
    assert sorted(g, key=str) == sorted([("F", 0.9), ("Unknown", None), ("Unknown", None), ("Unknown", None)], key=str)


def test_census_join_and_counts(spark):
    orders = spark.createDataFrame([("97209-1234", "c1", "Portland"), ("10001", "c1", None),
                                    (None, "c2", "Portland")],
                                   "billing_postcode string, customer_identifier string, billing_city string")
    census = spark.createDataFrame([("97209", "61234", "3000", "80,500", "4000"),
                                    ("10001", "250,000+", "***", "300000", "9000")],
                                   "zip string, median_household_income string, moe_median_household_income string, "
                                   "mean_household_income string, moe_mean_household_income string")
    j = EN.join_census(orders, census).collect()
    assert sorted([(r["zip"], r["median_household_income"]) for r in j], key=str) == sorted(
        [("97209", "61234"), ("10001", "250,000+"), (None, None)], key=str)
    pc = EN.purchase_counts(orders).collect()
    assert sorted((r["customer_identifier"], r["purchase_count"], r["repeat_purchase"]) for r in pc) == [
        ("c1", 2, 1), ("c1", 2, 1), ("c2", 1, 0)]
    cf = EN.city_frequency(orders, ["billing_city"]).collect()
    assert sorted((r["billing_city"] or "", r["billing_city_frequency"] or 0) for r in cf) == [
        ("", 0), ("Portland", 2), ("Portland", 2)]


def test_census_zip_must_be_unique(spark):
    orders = spark.createDataFrame([("97209",)], "billing_postcode string")
    census = spark.createDataFrame([("97209", "1", "1", "1", "1"), ("97209", "2", "2", "2", "2")],
                                   "zip string, median_household_income string, moe_median_household_income string, "
                                   "mean_household_income string, moe_mean_household_income string")
    with pytest.raises(ValueError):
        EN.join_census(orders, census)
    assert EN.join_census(orders, census, check_unique=False).count() == 2
