"""Scalar rules and their edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from steepgrid.functions import columns as c, scores
from steepgrid.sources.observations import observation_defaults, parse_observations


def one(spark, **exprs):
    return spark.range(1).select(*[e.alias(k) for k, e in exprs.items()]).first()


def test_rounding_rules(spark):
    row = one(
        spark,
        a=c.round_half_up(F.lit(-0.25), 1), b=c.round_half_up(F.lit(0.25), 1), h=c.round_int(F.lit(61.5)),
        n=c.round_int(F.lit(71.9)), z=c.round_half_up(F.lit(62.5)),
    )
    assert tuple(row) == (-0.2, 0.3, 62, 72, 63.0)


def test_clamp_turns_nan_into_the_upper_limit(spark):
    row = one(spark, a=c.clamp(F.lit(float("nan")), 0.0, 1.0), b=c.clamp(F.lit(-3.0), 0.0, 1.0), d=c.clamp(F.lit(0.4), 0.0, 1.0))
    assert tuple(row) == (1.0, 0.0, 0.4)


def test_tolerance_includes_its_bounds(spark):
    row = one(spark, a=c.within(F.lit(5.0), F.lit(10.0), 5.0), b=c.within(F.lit(5.0), F.lit(10.1), 5.0))
    assert tuple(row) == (1, 0)


def test_lookups_fall_back_on_unknown_and_null(spark):
    null = F.lit(None).cast("string")
    row = one(spark, a=c.normalise_weather(F.lit("くもり/雪")), b=c.normalise_weather(null), d=c.map_api_weather(F.lit("Fog")))
    assert tuple(row) == ("晴れ", "晴れ", "曇り")


def test_numbers_and_keys(spark):
    row = one(
        spark, a=c.to_number(F.lit(" 12.5 ")), b=c.to_number(F.lit("12x")), d=c.to_number(F.lit("7"), "int"),
        e=c.safe_key(F.lit("a b/c")), f=c.parse_day(F.lit("2024年2月30日")), g=c.default_role(F.lit(None).cast("string")),
    )
    assert tuple(row) == (12.5, None, 7, "a_b_c", None, "ROLE_USER")


def test_validation_rules(spark):
    null = F.lit(None).cast("string")
    row = one(
        spark, a=c.is_blank(F.lit("  ")), b=c.is_blank(null), d=c.too_long(F.lit("x" * 51)), e=c.too_long(F.lit("x" * 50)),
        f=c.bad_email(F.lit("a@b.c")), g=c.bad_email(F.lit("a b@c.d")), h=c.short_password(F.lit("12345")),
    )
    assert tuple(row) == (True, True, True, False, False, True, True)


def test_observations_take_defaults(spark):
    df = spark.createDataFrame(
        [
            (1, '{"main":{"temp":3.5,"humidity":80,"pressure":1001},"weather":[{"main":"Snow","description":"light"}]}'),
            (2, '{"main":{"temp":3.5},"weather":[]}'),
            (3, "not json"),
        ],
        "id int, j string",
    )
    rows = observation_defaults(parse_observations(df, "j")).orderBy("id").drop("j").collect()
    assert [tuple(r) for r in rows] == [
        (1, 3.5, 80.0, 1001.0, "Snow", "light"),
        (2, 3.5, 60.0, 1013.25, "Clear", ""),
        (3, 20.0, 60.0, 1013.25, "Clear", ""),
    ]


def r2(spark, n, s, ss, e):
    lit = lambda v: F.lit(float(v))
    return one(spark, r=scores.r2_from_sums(F.lit(n), lit(s), lit(ss), lit(e))).r


def test_r2_edges(spark):
    assert math.isnan(r2(spark, 1, 5, 25, 0))
    assert r2(spark, 3, 15, 75, 0) == 1.0
    assert r2(spark, 3, 15, 75, 2) == 0.0
    assert r2(spark, 3, 6, 14, 1) == pytest.approx(0.5)


@pytest.mark.parametrize("mean", [-5.0, 0.0, 0.7, 1.0, float("nan")])
@pytest.mark.parametrize("spread", [0.0, 1.0, 1e6])
@pytest.mark.parametrize("n", [1, 10, 500])
def test_confidence_stays_in_its_range(spark, mean, spread, n):
    lit = lambda v: F.lit(float(v))
    value = one(spark, v=scores.confidence(lit(mean), lit(0.1), lit(mean), lit(spread), F.lit(n))).v
    assert 0.3 <= value <= 0.95


def test_confidence_value(spark):
    value = one(spark, v=scores.confidence(F.lit(0.4), F.lit(0.2), F.lit(0.8), F.lit(0.5), F.lit(25))).v
    assert value == pytest.approx(0.6 * 0.4 + 0.75 * 0.3 + 0.5 * 0.2 + 0.8 * 0.1)


def test_simple_confidences(spark):
    row = one(
        spark, a=scores.fallback_confidence(F.lit(2)), b=scores.fallback_confidence(F.lit(100)),
        d=scores.saved_confidence(F.lit(50)), e=scores.saved_confidence(F.lit(None).cast("int")),
    )
    assert tuple(row) == pytest.approx((0.14, 0.95, 0.8, 0.85))
