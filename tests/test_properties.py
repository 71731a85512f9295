"""Property tests: breakdowns add up to the KPI total, shares sum to one, exact numerics."""

from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ridepulse.functions.numeric import avg2, rnd, sum2
from ridepulse.plans.catalog import REGISTRY
from tests.conftest import SF_SMALL


def _q(spark, name):
    return REGISTRY[name][0](spark, SF_SMALL)


def test_breakdowns_add_up_to_kpi_total(spark):
    total = _q(spark, "Q1_kpis").first().total_rides
    for name in ["Q4_rides_by_vehicle_type", "Q5_rides_by_payment"]:
        assert _q(spark, name).agg(F.sum("total_rides")).first()[0] == total, name
    hours = _q(spark, "A3_surge_patterns").agg(F.sum("total_rides")).first()[0]
    assert hours <= total
    revenue = _q(spark, "A6_kpi_dashboard").first().total_revenue
    by_region = _q(spark, "Q8_revenue_by_region").agg(F.sum("total_revenue")).first()[0]
    assert abs(by_region - revenue) < 1e-6  # every ride has a region by id in the test map


def test_shares_sum_to_one(spark):
    share = _q(spark, "P8_vehicle_type_share").agg(F.sum("share")).first()[0]
    assert abs(share - 1.0) < 1e-12
    drift = _q(spark, "G6_share_drift").groupBy("dimension").agg(
        F.sum("observed_share").alias("o"), F.sum("expected_share").alias("e")).collect()
    for r in drift:
        assert abs(r.o - 1.0) < 1e-12 and abs(r.e - 1.0) < 1e-12


def test_band_histogram_counts_every_non_null_value(spark):
    obt = REGISTRY["T6_silver_obt"][0](spark, SF_SMALL)
    bands = {r.measure: r.n for r in _q(spark, "G7_band_histograms")
             .groupBy("measure").agg(F.sum("observed_rides").alias("n")).collect()}
    for m in ["distance_miles", "surge_multiplier", "rating"]:
        assert bands[m] == obt.where(F.col(m).isNotNull()).count()


money = st.decimals(min_value=Decimal("0.00"), max_value=Decimal("9999.99"), places=2,
                    allow_nan=False, allow_infinity=False)


@settings(max_examples=8, deadline=None)
@given(st.lists(money, min_size=1, max_size=40))
def test_exact_sum_and_half_up_average(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    r = df.agg(sum2("x").alias("s"), rnd(avg2("x")).alias("a")).first()
    exact_sum = sum(values)
    assert r.s == float(exact_sum)
    exact_avg = (exact_sum / len(values)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)
    cents, n = int(exact_sum * 100), len(values)
    if 2 * (cents % n) == n:  # an exact half-cent tie: double division may land either side
        assert abs(r.a - float(exact_avg)) <= 0.01 + 1e-9
    else:
        assert abs(r.a - float(exact_avg)) < 1e-9
