"""Registered queries: id -> (Spark callable, oracle SQL or None).

Every callable takes ``(spark, sf_dir)``, reads the whole test tables through
the ride binding and returns a DataFrame; the SQL computes the same result
from the same tables.  Parameters are the ones the reference's dashboard and
tools use by default, unless noted.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ridepulse.functions.dates import BOOKING_MONTH
from ridepulse.operators import star as Q
from ridepulse.functions.params import validate_city, validate_hour_range, validate_limit
from ridepulse.plans import oracle_values as V
from ridepulse.plans.lakehouse import Lakehouse, materialized, staged
from ridepulse.plans.oracle import AVG2, CNT_IF, H, PCT, RND, SUM2, _obt_select, _q
from ridepulse.session import checkpoint_dir
from ridepulse.sources.lake import Lake
from ridepulse.sources.markets import CITY_BOXES, CITY_WEIGHTS, city_boxes

Spark = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Spark, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: Spark) -> Spark:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def lake(spark: SparkSession, sf_dir: str, **kw) -> Lakehouse:
    """The session's lakehouse of ``sf_dir``: built (written) once, then read."""
    return materialized(spark, sf_dir, **kw)


# ---------------------------------------------------------------- Q1-Q9 (star)

@register("Q1_kpis", _q(f"""
SELECT COUNT(*) AS total_rides, {SUM2('f.total_fare')} AS total_revenue,
  {RND(AVG2('f.total_fare'))} AS avg_fare, {RND(AVG2('f.surge_multiplier'))} AS avg_surge,
  {RND(AVG2('f.rating'))} AS avg_rating, {RND(AVG2('f.distance_miles'))} AS avg_distance,
  {PCT(CNT_IF('b.ride_status_id = 2'), 'COUNT(*)')} AS cancellation_rate
FROM fact f LEFT JOIN dim_booking b ON f.ride_id = b.ride_id"""))
def q1(spark, sf_dir):
    return Q.kpis(lake(spark, sf_dir).star)


# The newest rides first, then one lookup per label.
_FEED_SQL = """
SELECT newest.ride_id, newest.booking_timestamp,
  (SELECT passenger_name FROM dim_passenger p WHERE p.passenger_id = newest.passenger_id) AS passenger_name,
  dr.driver_name, dr.driver_rating,
  (SELECT vehicle_type FROM dim_vehicle ve WHERE ve.vehicle_id = newest.vehicle_id) AS vehicle_type,
  place.pickup_city, newest.total_fare, newest.distance_miles, newest.duration_minutes,
  newest.surge_multiplier, newest.rating
FROM (SELECT * FROM base WHERE ride_id IS NOT NULL
      QUALIFY ROW_NUMBER() OVER (ORDER BY booking_timestamp DESC NULLS LAST, ride_id) <= {limit}) newest
LEFT JOIN dim_driver dr USING (driver_id)
LEFT JOIN {loc} place ON place.pickup_city_id = newest.pickup_city_id"""


@register("Q2_live_feed", _q(_FEED_SQL.format(loc="loc_cur", limit=10)))
def q2(spark, sf_dir):
    return Q.live_feed(lake(spark, sf_dir).star, 10)


_BY_CITY_SQL = f"""
SELECT l.pickup_city AS city, COUNT(*) AS total_rides, {SUM2('f.total_fare')} AS total_revenue
FROM fact f LEFT JOIN {{loc}} l ON f.pickup_city_id = l.pickup_city_id
GROUP BY l.pickup_city ORDER BY total_rides DESC, city ASC NULLS FIRST LIMIT 10"""


@register("Q3_rides_by_city", _q(_BY_CITY_SQL.format(loc="loc_cur")))
def q3(spark, sf_dir):
    return Q.rides_by_city(lake(spark, sf_dir).star)


@register("Q3_rides_by_city_all_versions", _q(_BY_CITY_SQL.format(loc="dim_location")))
def q3_all(spark, sf_dir):
    """D4 literal mode: no current-row filter, a two-version city counts twice."""
    return Q.rides_by_city(lake(spark, sf_dir).star, location_mode="all_versions")


@register("Q4_rides_by_vehicle_type", _q(f"""
SELECT v.vehicle_type, COUNT(*) AS total_rides, {RND(AVG2('f.total_fare'))} AS avg_fare
FROM fact f LEFT JOIN dim_vehicle v ON f.vehicle_id = v.vehicle_id
GROUP BY v.vehicle_type"""))
def q4(spark, sf_dir):
    return Q.rides_by_vehicle_type(lake(spark, sf_dir).star)


@register("Q5_rides_by_payment", _q("""
SELECT pm.payment_method, COUNT(*) AS total_rides
FROM fact f LEFT JOIN dim_payment pm ON f.payment_method_id = pm.payment_method_id
GROUP BY pm.payment_method"""))
def q5(spark, sf_dir):
    return Q.rides_by_payment(lake(spark, sf_dir).star)


@register("Q6_surge_distribution", _q(f"""
SELECT {RND('surge_multiplier', 1)} AS surge_bucket, COUNT(*) AS ride_count
FROM fact WHERE surge_multiplier IS NOT NULL GROUP BY 1"""))
def q6(spark, sf_dir):
    return Q.surge_distribution(lake(spark, sf_dir).star)


@register("Q7_top_drivers", _q(f"""
SELECT d.driver_name, {RND(AVG2('d.driver_rating'))} AS driver_rating, COUNT(*) AS total_rides,
  {SUM2('COALESCE(f.total_fare, 0)')} AS total_revenue,
  {RND(AVG2('COALESCE(f.tip_amount, 0)'))} AS avg_tip
FROM fact f LEFT JOIN dim_driver d ON f.driver_id = d.driver_id
WHERE d.driver_name IS NOT NULL
GROUP BY d.driver_name ORDER BY total_rides DESC, d.driver_name ASC LIMIT 5"""))
def q7(spark, sf_dir):
    return Q.top_drivers(lake(spark, sf_dir).star, 5)


_REGION_SQL = f"""
SELECT mc.region, COUNT(*) AS total_rides, {SUM2('COALESCE(f.total_fare, 0)')} AS total_revenue
FROM fact f LEFT JOIN loc_cur l ON f.pickup_city_id = l.pickup_city_id
LEFT JOIN cur_cities mc ON {{on}}
WHERE mc.region IS NOT NULL GROUP BY mc.region"""


@register("Q8_revenue_by_region", _q(_REGION_SQL.format(on="f.pickup_city_id = mc.city_id")))
def q8(spark, sf_dir):
    lh = lake(spark, sf_dir)
    return Q.revenue_by_region(lh.star, lh.maps["map_cities"])


@register("Q8_revenue_by_region_by_name", _q(_REGION_SQL.format(on="l.pickup_city = mc.city")))
def q8_name(spark, sf_dir):
    """D5 literal mode: region found through the city *name*."""
    lh = lake(spark, sf_dir)
    return Q.revenue_by_region(lh.star, lh.maps["map_cities"], join_on="name")


@register("Q9_pickup_locations", _q("""
SELECT pickup_latitude, pickup_longitude, pickup_address, total_fare FROM base
WHERE ABS(pickup_latitude) <= 90 AND ABS(pickup_longitude) <= 180 AND ride_id IS NOT NULL
QUALIFY ROW_NUMBER() OVER (ORDER BY ride_id) <= 200"""))
def q9(spark, sf_dir):
    return Q.pickup_locations(lake(spark, sf_dir).star, 200)


# ---------------------------------------------------------------- A1-A11 (curated)

from ridepulse.operators import curated as A  # noqa: E402
from ridepulse.operators import forecast as FC  # noqa: E402
from ridepulse.plans.oracle import D, _lit  # noqa: E402

_F0, _S1 = "COALESCE(f.total_fare, 0)", "COALESCE(f.surge_multiplier, 1)"
_CITY_MEASURES = (f"COUNT(*) AS total_rides, {SUM2(_F0)} AS total_revenue, "
                  f"{RND(AVG2(_F0))} AS avg_fare, {RND(AVG2(_S1))} AS avg_surge, "
                  f"{RND(AVG2('f.rating'))} AS avg_rating")


@register("A1_revenue_by_city", _q(f"""
SELECT l.pickup_city AS city, {_CITY_MEASURES}
FROM fact f LEFT JOIN loc_cur l ON f.pickup_city_id = l.pickup_city_id
WHERE lower(l.pickup_city) = lower('nation_3') GROUP BY l.pickup_city"""))
def a1(spark, sf_dir):
    return A.revenue_by_city(lake(spark, sf_dir).star, "nation_3")


@register("A2_top_cities_by_revenue", _q(f"""
SELECT CAST(ROW_NUMBER() OVER (ORDER BY total_revenue DESC, city ASC) AS BIGINT) AS rank, t.*
FROM (SELECT l.pickup_city AS city, {_CITY_MEASURES}
  FROM fact f LEFT JOIN loc_cur l ON f.pickup_city_id = l.pickup_city_id
  WHERE l.pickup_city IS NOT NULL GROUP BY l.pickup_city
  ORDER BY total_revenue DESC, city ASC LIMIT 10) t"""))
def a2(spark, sf_dir):
    return A.top_cities_by_revenue(lake(spark, sf_dir).star, 10)


@register("A3_surge_patterns", _q(f"""
SELECT CAST(hour(b.booking_timestamp) AS BIGINT) AS booking_hour, COUNT(*) AS total_rides,
  {RND(AVG2(_S1))} AS avg_surge, {RND(f'MAX({_S1})')} AS peak_surge,
  {SUM2(_F0)} AS total_revenue
FROM fact f LEFT JOIN dim_booking b ON f.ride_id = b.ride_id
WHERE b.booking_timestamp IS NOT NULL AND hour(b.booking_timestamp) BETWEEN 4 AND 20
GROUP BY 1"""))
def a3(spark, sf_dir):
    """Hours given reversed (20, 4): the guard swaps them to 4..20."""
    return A.surge_patterns(lake(spark, sf_dir).star, 20, 4)


@register("A4_city_surge_comparison", _q(f"""
SELECT l.pickup_city AS city, COUNT(*) AS total_rides, {RND(AVG2(_S1))} AS avg_surge,
  {RND(f'MAX({_S1})')} AS peak_surge, {SUM2(_F0)} AS total_revenue
FROM fact f LEFT JOIN loc_cur l ON f.pickup_city_id = l.pickup_city_id
WHERE lower(l.pickup_city) IN ('nation_1', 'nation_2', 'nation_7 metro')
GROUP BY l.pickup_city"""))
def a4(spark, sf_dir):
    return A.city_surge_comparison(lake(spark, sf_dir).star,
                                   "NATION_1, nation_2,Nation_1, NATION_7 METRO")


@register("A5_demand_by_city", _q(f"""
SELECT city, CAST(SUM(n) AS BIGINT) AS total_rides, CAST(COALESCE(SUM(n) FILTER (cancelled), 0) AS BIGINT) AS cancelled_rides,
  CAST(COALESCE(SUM(n) FILTER (NOT cancelled), 0) AS BIGINT) AS non_cancelled_rides,
  {PCT('COALESCE(SUM(n) FILTER (cancelled), 0)', 'SUM(n)')} AS cancellation_rate,
  {RND('CAST(SUM(surge) AS DOUBLE) / SUM(n)')} AS avg_surge
FROM (SELECT place.pickup_city AS city, COALESCE(base.ride_status_id, 0) = 2 AS cancelled, COUNT(*) AS n,
    SUM(CAST(COALESCE(base.surge_multiplier, 1) AS DECIMAL(18, 6))) AS surge
  FROM base JOIN loc_cur place USING (pickup_city_id) WHERE UPPER(place.pickup_city) = 'NATION_3' GROUP BY 1, 2)
GROUP BY city"""))
def a5(spark, sf_dir):
    return A.demand_by_city(lake(spark, sf_dir).star, "NATION_3")


@register("A6_kpi_dashboard", _q(f"""
SELECT COUNT(*) AS total_rides, {SUM2(_F0)} AS total_revenue, {RND(AVG2(_F0))} AS avg_fare,
  {RND(AVG2(_S1))} AS avg_surge, {RND(AVG2('f.rating'))} AS avg_rating,
  {RND(AVG2('f.distance_miles'))} AS avg_distance,
  {PCT(CNT_IF('b.ride_status_id = 2'), 'COUNT(*)')} AS cancellation_rate
FROM fact f LEFT JOIN dim_booking b ON f.ride_id = b.ride_id"""))
def a6(spark, sf_dir):
    return A.kpi_dashboard(lake(spark, sf_dir).star)


_OF0, _OS1 = "COALESCE(total_fare, 0)", "COALESCE(surge_multiplier, 1)"


@register("A7a_silver_city_overview", _q(f"""
SELECT pickup_city AS city, state, region, COUNT(*) AS total_rides, {SUM2(_OF0)} AS total_revenue,
  {RND(AVG2('COALESCE(distance_miles, 0)'))} AS avg_distance_miles,
  {RND('CAST(SUM(COALESCE(duration_minutes, 0)) AS DOUBLE) / COUNT(COALESCE(duration_minutes, 0))')}
    AS avg_duration_minutes,
  {RND(AVG2(_OS1))} AS avg_surge, {RND(AVG2('rating'))} AS avg_rating,
  {RND(AVG2('driver_rating'))} AS avg_driver_rating
FROM obt WHERE lower(pickup_city) = 'nation_3' GROUP BY pickup_city, state, region"""))
def a7a(spark, sf_dir):
    """Both cities named NATION_3 are returned (one row per city, state, region)."""
    lh = lake(spark, sf_dir)
    return A.silver_city_overview(lh.obt, "NATION_3")


@register("A7b_silver_vehicle_mix", _q(f"""
SELECT vehicle_type, COUNT(*) AS rides, {RND(AVG2(_OF0))} AS avg_fare, {RND(AVG2(_OS1))} AS avg_surge
FROM obt WHERE lower(pickup_city) = 'nation_3' AND vehicle_type IS NOT NULL
GROUP BY vehicle_type ORDER BY rides DESC, vehicle_type ASC LIMIT 8"""))
def a7b(spark, sf_dir):
    lh = lake(spark, sf_dir)
    return A.silver_vehicle_mix(lh.obt, "NATION_3")


@register("A7c_silver_payment_mix", _q("""
SELECT payment_method, COUNT(*) AS rides
FROM obt WHERE lower(pickup_city) = 'nation_3' AND payment_method IS NOT NULL
GROUP BY payment_method ORDER BY rides DESC, payment_method ASC LIMIT 8"""))
def a7c(spark, sf_dir):
    lh = lake(spark, sf_dir)
    return A.silver_payment_mix(lh.obt, "NATION_3")


@register("A7d_silver_status_mix", _q("""
SELECT COALESCE(ride_status, 'Unknown') AS ride_status,
  COALESCE(cancellation_reason, 'None') AS cancellation_reason, COUNT(*) AS rides
FROM obt WHERE lower(pickup_city) = 'nation_3'
GROUP BY 1, 2 ORDER BY rides DESC, ride_status ASC, cancellation_reason ASC LIMIT 8"""))
def a7d(spark, sf_dir):
    lh = lake(spark, sf_dir)
    return A.silver_status_mix(lh.obt, "NATION_3")


@register("A8_recent_signals", _q(f"""
SELECT booking_timestamp, pickup_city, state, region, vehicle_type, ride_status,
  cancellation_reason, {RND(_OF0)} AS total_fare, {RND('COALESCE(distance_miles, 0)')} AS distance_miles,
  duration_minutes, {RND(_OS1)} AS surge_multiplier, rating
FROM obt WHERE booking_timestamp IS NOT NULL
ORDER BY booking_timestamp DESC, ride_id ASC LIMIT 10"""))
def a8(spark, sf_dir):
    return A.recent_signals(lake(spark, sf_dir).obt, 10)


# Trailing-window operators: at test density 6 hours hold almost nothing, so the
# registered forms use a fixed as-of time and a 90-day window.
AS_OF, WINDOW_H, HORIZON = "2001-07-01 00:00:00", 2160, 3

_WIN = (f"booking_timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL {WINDOW_H} HOUR "
        f"AND booking_timestamp < TIMESTAMP '{AS_OF}'")
_FEATURES = (f"COUNT(*) AS rides_last_6h, {RND(f'COUNT(*) / {D(WINDOW_H)}')} AS avg_rides_per_hour, "
             f"{RND(AVG2(_OS1))} AS avg_surge_last_6h, {RND(f'MAX({_OS1})')} AS peak_surge_last_6h, "
             f"{PCT(CNT_IF('ride_status_id = 2'), 'GREATEST(COUNT(*), 1)')} AS cancellation_rate_last_6h")


def _demand_sql(src: str, city_cols: str) -> str:
    per_hour = "COALESCE(avg_rides_per_hour, 0)"
    return (f"SELECT {city_cols}, CAST({HORIZON} AS BIGINT) AS horizon_hours, rides_last_6h, "
            f"avg_rides_per_hour, avg_surge_last_6h, cancellation_rate_last_6h, "
            f"{RND(f'{per_hour} * {D(HORIZON)}', 1)} AS predicted_rides, "
            f"CASE WHEN {per_hour} = 0 THEN 'low' ELSE 'medium' END AS confidence FROM {src}")


def _pressure_sql(src: str, city_cols: str) -> str:
    a = f"CASE WHEN avg_surge_last_6h IS NULL OR avg_surge_last_6h = 0 THEN {D(1)} ELSE avg_surge_last_6h END"
    p = f"CASE WHEN peak_surge_last_6h IS NULL OR peak_surge_last_6h = 0 THEN ({a}) ELSE peak_surge_last_6h END"
    c = (f"CASE WHEN cancellation_rate_last_6h IS NULL OR cancellation_rate_last_6h = 0 THEN {D(0)} "
         f"ELSE cancellation_rate_last_6h END")
    score = RND(f"(({a}) - {D(1)}) * {D(55)} + (({p}) - {D(1)}) * {D(25)} + ({c}) * {D(0.2)}", 1)
    return (f"SELECT {city_cols}, rides_last_6h, avg_surge_last_6h, peak_surge_last_6h, "
            f"cancellation_rate_last_6h, pressure_score, CASE WHEN pressure_score >= 45 THEN 'high' "
            f"WHEN pressure_score >= 20 THEN 'medium' ELSE 'low' END AS pressure_band "
            f"FROM (SELECT *, {score} AS pressure_score FROM {src})")


_ONE = f"(SELECT {_FEATURES} FROM obt WHERE lower(pickup_city) = 'nation_5' AND {_WIN})"
_ALL = (f"(SELECT c.city_id, c.city, COALESCE(w.rides_last_6h, 0) AS rides_last_6h, "
        f"COALESCE(w.avg_rides_per_hour, {D(0)}) AS avg_rides_per_hour, w.avg_surge_last_6h, "
        f"w.peak_surge_last_6h, COALESCE(w.cancellation_rate_last_6h, {D(0)}) AS cancellation_rate_last_6h "
        f"FROM cur_cities c LEFT JOIN (SELECT pickup_city_id, {_FEATURES} FROM obt "
        f"WHERE {_WIN} AND pickup_city_id IS NOT NULL GROUP BY pickup_city_id) w "
        f"ON c.city_id = w.pickup_city_id)")


@register("A9_predict_city_demand", _q(_demand_sql(_ONE, "'NATION_5' AS city")))
def a9(spark, sf_dir):
    lh = lake(spark, sf_dir)
    return FC.predict_city_demand(lh.obt, "NATION_5", HORIZON, AS_OF, WINDOW_H)


@register("A9b_predict_demand_all_cities", _q(_demand_sql(_ALL, "city_id, city")))
def a9b(spark, sf_dir):
    lh = lake(spark, sf_dir)
    return FC.predict_demand_all_cities(lh.obt, lh.cities, HORIZON, AS_OF, WINDOW_H)


@register("A10_predict_surge_pressure", _q(_pressure_sql(_ONE, "'NATION_5' AS city")))
def a10(spark, sf_dir):
    lh = lake(spark, sf_dir)
    return FC.predict_surge_pressure(lh.obt, "NATION_5", AS_OF, WINDOW_H)


@register("A10b_predict_pressure_all_cities", _q(_pressure_sql(_ALL, "city_id, city")))
def a10b(spark, sf_dir):
    lh = lake(spark, sf_dir)
    return FC.predict_pressure_all_cities(lh.obt, lh.cities, AS_OF, WINDOW_H)


def _a11_sql() -> str:
    arch = ", ".join(f"({_lit(c)}, {_lit(a)})" for c, a in V.ARCHETYPES)
    sig = ", ".join(f"({_lit(c)}, {_lit(t)})" for c, t in V.SIGNALS)
    return _q(f"""
SELECT c.city, c.state, c.region,
  COALESCE(a.market_archetype, COALESCE(c.region, 'general') || ' regional market') AS market_archetype,
  COALESCE(s.sig, COALESCE(c.region, 'regional') || ' demand patterns | local event and commute sensitivity')
    AS context_signals
FROM cur_cities c
LEFT JOIN (VALUES {arch}) AS a(a_city, market_archetype) ON lower(c.city) = a.a_city
LEFT JOIN (VALUES {sig}) AS s(s_city, sig) ON c.city = s.s_city""")


@register("A11_market_context", _a11_sql())
def a11(spark, sf_dir):
    """Every current city's context; the signal list is shown joined by ' | '."""
    from pyspark.sql import functions as F
    out = A.market_context_all(spark, lake(spark, sf_dir).cities)
    return out.withColumn("context_signals", F.array_join("context_signals", " | "))


@register("A11_market_context_one_city", f"SELECT * FROM ({_a11_sql()}) WHERE UPPER(city) = 'NATION_3'")
def a11_one(spark, sf_dir):
    """Both cities of that name, in any case."""
    from pyspark.sql import functions as F
    out = A.market_context(spark, lake(spark, sf_dir).cities, " nation_3 ")
    return out.withColumn("context_signals", F.array_join("context_signals", " | "))


_NOW = f"(SELECT {_FEATURES.replace(D(WINDOW_H), D(6))} FROM obt WHERE lower(pickup_city) = 'nation_5' AND booking_timestamp >= NOW() - INTERVAL 6 HOUR)"


@register("A9_predict_city_demand_now", _q(_demand_sql(_NOW, "'NATION_5' AS city")))
def a9_now(spark, sf_dir):
    """The default window: the last six hours, without an upper bound."""
    lh = lake(spark, sf_dir)
    return FC.predict_city_demand(lh.obt, "NATION_5", HORIZON)


@register("A10_predict_surge_pressure_now", _q(_pressure_sql(_NOW, "'NATION_5' AS city")))
def a10_now(spark, sf_dir):
    lh = lake(spark, sf_dir)
    return FC.predict_surge_pressure(lh.obt, "NATION_5")


# ---------------------------------------------------------------- P1-P9 (shaping)

from pyspark.sql import functions as F  # noqa: E402

from ridepulse.operators import shaping as P  # noqa: E402


def _dashboard_slices(lh: Lakehouse):
    """Slices of the dashboard snapshot: one scan of the rides for all aggregates (written, since
    seven reports read it), one for the newest rides."""
    st = lh.star
    scratch = Lake(st.fact.sparkSession, posixpath.join(checkpoint_dir(st.fact.sparkSession), "ridepulse-snapshot", uuid.uuid4().hex))
    scratch.write_overwrite(Q.summaries(st), "gold", "summaries")
    done = scratch.read("gold", "summaries")
    pre = {k: done.where(F.col("by") == k) for k in Q.SUMMARY_KEYS}
    by_city = pre["pickup_city_id"].drop("vehicle_id", "driver_id").join(st.location_lookup(), "pickup_city_id", "left")
    slices = {
        "kpis": Q.kpis(st, done.where(F.col("by").isNull())),
        "rides_by_city": Q.rides_by_city(st, by_city=by_city),
        "rides_by_vehicle_type": Q.rides_by_vehicle_type(st, pre["vehicle_id"]),
        "rides_by_payment_method": Q.rides_by_payment(st, pre["payment_method_id"]),
        "surge_distribution": Q.surge_distribution(st, pre["surge_bucket"]),
        "revenue_by_region": Q.revenue_by_region(st, lh.maps["map_cities"], by_city=by_city),
        "top_drivers": Q.top_drivers(st, 10, pre["driver_id"]),
        "recent_rides": Q.live_feed(st, 15),
    }
    orders = {
        "rides_by_city": [F.col("total_rides").desc(), F.col("city").asc_nulls_first()],
        "rides_by_vehicle_type": [F.col("total_rides").desc(), F.col("vehicle_type").asc_nulls_first()],
        "rides_by_payment_method": [F.col("total_rides").desc(), F.col("payment_method").asc_nulls_first()],
        "surge_distribution": [F.col("surge_bucket").asc()],
        "revenue_by_region": [F.col("total_revenue").desc(), F.col("region").asc()],
        "top_drivers": [F.col("total_rides").desc(), F.col("driver_name").asc()],
        "recent_rides": [F.col("booking_timestamp").desc(), F.col("ride_id").asc()],
    }
    return slices, orders


_ISO = ("CASE WHEN epoch_us(booking_timestamp) % 1000000 = 0 "
        "THEN strftime(booking_timestamp, '%Y-%m-%dT%H:%M:%S') "
        "ELSE strftime(booking_timestamp, '%Y-%m-%dT%H:%M:%S.%f') END")


def _snapshot_sql() -> str:
    def body(name: str) -> str:
        return REGISTRY[name][1].removeprefix(_q(""))

    slices = [  # name, rows, order, number fields, text fields
        ("kpis", body("Q1_kpis"), "1", ["total_rides", "total_revenue", "avg_fare", "avg_surge", "avg_rating",
                                        "avg_distance", "cancellation_rate"], {}),
        ("rides_by_city", body("Q3_rides_by_city"), "total_rides DESC, city NULLS FIRST", ["total_rides", "total_revenue"], {"city": "city"}),
        ("rides_by_vehicle_type", body("Q4_rides_by_vehicle_type"), "total_rides DESC, vehicle_type NULLS FIRST",
         ["total_rides", "avg_fare"], {"vehicle_type": "vehicle_type"}),
        ("rides_by_payment_method", body("Q5_rides_by_payment"), "total_rides DESC, payment_method NULLS FIRST",
         ["total_rides"], {"payment_method": "payment_method"}),
        ("surge_distribution", body("Q6_surge_distribution"), "surge_bucket", ["surge_bucket", "ride_count"], {}),
        ("revenue_by_region", body("Q8_revenue_by_region"), "total_revenue DESC, region", ["total_rides", "total_revenue"], {"region": "region"}),
        ("top_drivers", _DRIVERS10, "total_rides DESC, driver_name", ["driver_rating", "total_rides", "total_revenue", "avg_tip"], {}),
        ("recent_rides", _FEED_SQL.format(loc="loc_cur", limit=15), "booking_timestamp DESC, ride_id",
         [c for c in V.SHOWN if c not in ("booking_timestamp", "vehicle_type", "pickup_city")],
         {"booking_timestamp": _ISO, "vehicle_type": "vehicle_type", "pickup_city": "pickup_city"}),
    ]
    most = {"kpis": 1, "rides_by_city": 25, "recent_rides": 25, "surge_distribution": 20}
    parts = []
    for name, rows, order, numbers, texts in slices:
        cells = [f"('{c}', CAST({c} AS DOUBLE), CAST(NULL AS VARCHAR))" for c in numbers]
        cells += [f"('{c}', CAST(NULL AS DOUBLE), CAST({e} AS VARCHAR))" for c, e in texts.items()]
        parts.append(f"SELECT '{name}' AS slice, pos, field, number, text FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY {order}) AS pos "
                     f"FROM ({rows}) QUALIFY pos <= {most.get(name, 15)}) r, LATERAL (VALUES {', '.join(cells)}) AS c(field, number, text)")
    return _q("\nUNION ALL ".join(parts))


_ALLOWED = ", ".join(V.SHOWN)


@register("P2_sanitized_recent_rides", _q(f"SELECT {_ALLOWED} FROM ({_FEED_SQL.format(loc='loc_cur', limit=15)})"))
def p2(spark, sf_dir):
    return P.sanitize(Q.live_feed(lake(spark, sf_dir).star, 15))


@register("P3_clean_values", _q(f"""
SELECT {_ISO} AS booking_timestamp, pickup_city, state, region, vehicle_type, ride_status,
  cancellation_reason, {RND(_OF0)} AS total_fare, {RND('COALESCE(distance_miles, 0)')} AS distance_miles,
  duration_minutes, {RND(_OS1)} AS surge_multiplier, rating
FROM obt WHERE booking_timestamp IS NOT NULL
ORDER BY obt.booking_timestamp DESC, ride_id ASC LIMIT 10"""))
def p3(spark, sf_dir):
    return P.clean_values(A.recent_signals(lake(spark, sf_dir).obt, 10))


def _fmt_sql(x: str, pattern: str, n: int | None) -> str:
    v = RND(x, n) if n is not None else x
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE printf('{pattern}', {v}) END"


@register("P4_formatted_feed", _q(f"""
SELECT strftime(booking_timestamp, '%m/%d %H:%M') AS "Time", passenger_name AS "Passenger",
  driver_name AS "Driver", {_fmt_sql('driver_rating', '%.2f', 2)} AS "Driver Rating",
  vehicle_type AS "Vehicle", pickup_city AS "City", {_fmt_sql('total_fare', '$%.2f', 2)} AS "Fare",
  {_fmt_sql('distance_miles', '%.1fmi', 1)} AS "Dist",
  {_fmt_sql('duration_minutes', '%dmin', None)} AS "Min",
  {_fmt_sql('surge_multiplier', '%.2fx', 2)} AS "Surge", {_fmt_sql('rating', '%.2f', 2)} AS "Rating"
FROM ({_FEED_SQL.format(loc='loc_cur', limit=15)})"""))
def p4(spark, sf_dir):
    return P.format_feed(Q.live_feed(lake(spark, sf_dir).star, 15))


_DRIVERS10 = f"""
SELECT d.driver_name, {RND(AVG2('d.driver_rating'))} AS driver_rating, COUNT(*) AS total_rides,
  {SUM2('COALESCE(f.total_fare, 0)')} AS total_revenue,
  {RND(AVG2('COALESCE(f.tip_amount, 0)'))} AS avg_tip
FROM fact f LEFT JOIN dim_driver d ON f.driver_id = d.driver_id
WHERE d.driver_name IS NOT NULL
GROUP BY d.driver_name ORDER BY total_rides DESC, d.driver_name ASC LIMIT 10"""


@register("P1_dashboard_snapshot", _snapshot_sql())
def p1(spark, sf_dir):
    """Bounded snapshot in long form: one row per slice, position and field."""
    return P.snapshot_fields(*_dashboard_slices(lake(spark, sf_dir)))


@register("P5_driver_leaderboard", _q(f"""
SELECT '#' || CAST(ROW_NUMBER() OVER (ORDER BY total_rides DESC, driver_name ASC) AS VARCHAR) AS "Rank",
  driver_name AS "Driver", driver_rating AS "Rating", total_rides AS "Rides",
  total_revenue AS "Revenue ($)", avg_tip AS "Avg Tip ($)"
FROM ({_DRIVERS10})"""))
def p5(spark, sf_dir):
    return P.leaderboard(Q.top_drivers(lake(spark, sf_dir).star, 10))


def _compact_sql(x: str) -> str:
    v = f"TRY_CAST({x} AS DOUBLE)"
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {v} IS NULL THEN CAST({x} AS VARCHAR) "
            f"WHEN ABS({v}) >= 1000000 THEN printf('%.1fM', {RND(f'{v} / {D(1000000)}', 1)}) "
            f"WHEN ABS({v}) >= 1000 THEN printf('%.1fK', {RND(f'{v} / {D(1000)}', 1)}) "
            f"WHEN {v} = FLOOR({v}) THEN printf('%d', CAST({v} AS BIGINT)) "
            f"ELSE printf('%.1f', {RND(v, 1)}) END")


@register("P6_compact_numbers", _q(f"""
SELECT city, {_compact_sql('total_rides')} AS total_rides, {_compact_sql('total_revenue')} AS total_revenue,
  {_compact_sql('avg_fare')} AS avg_fare
FROM (SELECT l.pickup_city AS city, COUNT(*) AS total_rides, {SUM2('f.total_fare')} AS total_revenue,
  {RND(AVG2('f.total_fare'))} AS avg_fare
  FROM fact f LEFT JOIN loc_cur l ON f.pickup_city_id = l.pickup_city_id GROUP BY l.pickup_city)"""))
def p6(spark, sf_dir):
    """Per-city rides, revenue and average fare as compact display text."""
    st = lake(spark, sf_dir).star
    g = Q._by_city(st, "current").groupBy(F.col("pickup_city").alias("city")).agg(
        F.sum("n").alias("total_rides"), Q.value(Q.sum_again("fare_h")).alias("total_revenue"),
        Q.rnd(Q.value(Q.sum_again("fare_h")) / F.sum("fare_n")).alias("avg_fare"))
    return g.select("city", *[P.compact_number(F.col(c)).alias(c)
                              for c in ["total_rides", "total_revenue", "avg_fare"]])


@register("P7_kpi_cards", _q(f"""
SELECT CAST(TRUNC(COALESCE(CAST(total_rides AS DOUBLE), 0)) AS BIGINT) AS total_rides,
  CAST(TRUNC(COALESCE(total_revenue, 0)) AS BIGINT) AS total_revenue,
  COALESCE(avg_fare, {D(0)}) AS avg_fare, COALESCE(avg_surge, {D(0)}) AS avg_surge,
  COALESCE(avg_rating, {D(0)}) AS avg_rating, COALESCE(avg_distance, {D(0)}) AS avg_distance,
  COALESCE(cancellation_rate, {D(0)}) AS cancellation_rate
FROM (SELECT COUNT(*) AS total_rides, {SUM2('f.total_fare')} AS total_revenue,
  {RND(AVG2('f.total_fare'))} AS avg_fare, {RND(AVG2('f.surge_multiplier'))} AS avg_surge,
  {RND(AVG2('f.rating'))} AS avg_rating, {RND(AVG2('f.distance_miles'))} AS avg_distance,
  {PCT(CNT_IF('b.ride_status_id = 2'), 'COUNT(*)')} AS cancellation_rate
  FROM fact f LEFT JOIN dim_booking b ON f.ride_id = b.ride_id)"""))
def p7(spark, sf_dir):
    return P.kpi_cards(Q.kpis(lake(spark, sf_dir).star))


@register("P8_vehicle_type_share", _q(f"""
SELECT vehicle_type, total_rides, avg_fare, total_rides / SUM(total_rides) OVER () AS share
FROM (SELECT v.vehicle_type, COUNT(*) AS total_rides, {RND(AVG2('f.total_fare'))} AS avg_fare
  FROM fact f LEFT JOIN dim_vehicle v ON f.vehicle_id = v.vehicle_id GROUP BY v.vehicle_type)"""))
def p8(spark, sf_dir):
    return P.with_share(Q.rides_by_vehicle_type(lake(spark, sf_dir).star), "total_rides")


@register("P9_pickup_density", _q(f"""
SELECT FLOOR(b.pickup_latitude / {D(0.25)}) * {D(0.25)} AS cell_lat,
  FLOOR(b.pickup_longitude / {D(0.25)}) * {D(0.25)} AS cell_lon,
  COUNT(*) AS rides, {SUM2('COALESCE(f.total_fare, 0)')} AS total_revenue
FROM fact f LEFT JOIN dim_booking b ON f.ride_id = b.ride_id
WHERE b.pickup_latitude IS NOT NULL AND b.pickup_longitude IS NOT NULL
  AND b.pickup_latitude BETWEEN -90 AND 90 AND b.pickup_longitude BETWEEN -180 AND 180
GROUP BY 1, 2"""))
def p9(spark, sf_dir):
    st = lake(spark, sf_dir).star
    return P.pickup_density(st.fact_with_booking(["total_fare"], ["pickup_latitude", "pickup_longitude"]))


# ---------------------------------------------------------------- G1-G7 (quality)

from ridepulse.operators import quality as G  # noqa: E402


def _summary_sql(src: str, rules: dict[str, tuple[str, str]]) -> str:
    parts = [f"SELECT '{n}' AS rule, CAST(COALESCE(SUM(CASE WHEN {c} THEN 1 ELSE 0 END), 0) AS BIGINT) AS checked, "
             f"CAST(COALESCE(SUM(CASE WHEN ({c}) AND ({b}) THEN 1 ELSE 0 END), 0) AS BIGINT) AS violations "
             f"FROM {src}" for n, (c, b) in rules.items()]
    return "\nUNION ALL ".join(parts)


def _off(a: str, e: str) -> str:
    return f"ABS({H(a)} - {H(e)}) > 1"


def _nn_sql(*cols: str) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in cols)


_FARE_RULES = {
    "base_fare": (_nn_sql("base_fare", "base_rate"), _off("base_fare", "base_rate")),
    "distance_fare": (_nn_sql("distance_fare", "distance_miles", "per_mile"),
                      _off("distance_fare", RND("distance_miles * per_mile"))),
    "time_fare": (_nn_sql("time_fare", "duration_minutes", "per_minute"),
                  _off("time_fare", RND("CAST(duration_minutes AS DOUBLE) * per_minute"))),
    "subtotal": (_nn_sql("subtotal", "base_fare", "distance_fare", "time_fare", "surge_multiplier"),
                 _off("subtotal", RND("(base_fare + distance_fare + time_fare) * surge_multiplier"))),
    "total_fare": (_nn_sql("total_fare", "subtotal"),
                   _off("total_fare", RND(f"subtotal + COALESCE(tip_amount, {D(0)})"))),
}


@register("G1_fare_audit", _q(_summary_sql("obt", _FARE_RULES)))
def g1(spark, sf_dir):
    return G.fare_audit(lake(spark, sf_dir).obt)


def _rows_sql(src: str, rules: dict[str, tuple[str, str]], key: str = "ride_id") -> str:
    """The rides that fail a rule, with the rules they fail."""
    failed = ", ".join(f"CASE WHEN ({c}) AND ({b}) THEN '{n}' END" for n, (c, b) in rules.items())
    return _q(f"SELECT ride_id, failed_rules FROM (SELECT {key} AS ride_id, CONCAT_WS(',', {failed}) AS failed_rules FROM {src}) "
              "WHERE failed_rules <> ''")


def _failed(df: DataFrame) -> DataFrame:
    return df.select("ride_id", F.array_join("failed_rules", ",").alias("failed_rules"))


@register("G1_fare_violations", _rows_sql("obt", _FARE_RULES))
def g1_rows(spark, sf_dir):
    return _failed(G.fare_violations(lake(spark, sf_dir).obt))


_BOXES = (f"(SELECT DISTINCT city_id, {D(20)} + CAST(city_id AS DOUBLE) AS lat_min, "
          f"{D(20)} + CAST(city_id AS DOUBLE) + {D(0.5)} AS lat_max, "
          f"{D(-100)} - CAST(city_id AS DOUBLE) AS lon_min, "
          f"{D(-100)} - CAST(city_id AS DOUBLE) + {D(0.5)} AS lon_max FROM map_cities)")


def _in_box_sql(lat, lon, p):
    return f"({lat} BETWEEN {p}.lat_min AND {p}.lat_max AND {lon} BETWEEN {p}.lon_min AND {p}.lon_max)"


_COORD_RULES = {
    "pickup_in_city_box": ("pb.city_id IS NOT NULL",
                           f"o.pickup_latitude IS NULL OR o.pickup_longitude IS NULL OR NOT "
                           f"{_in_box_sql('o.pickup_latitude', 'o.pickup_longitude', 'pb')}"),
    "dropoff_in_city_box": ("db.city_id IS NOT NULL",
                            f"o.dropoff_latitude IS NULL OR o.dropoff_longitude IS NULL OR NOT "
                            f"{_in_box_sql('o.dropoff_latitude', 'o.dropoff_longitude', 'db')}"),
    "pickup_valid_range": ("TRUE", "o.pickup_latitude IS NULL OR o.pickup_longitude IS NULL OR "
                                   "NOT o.pickup_latitude BETWEEN -90 AND 90 OR "
                                   "NOT o.pickup_longitude BETWEEN -180 AND 180"),
}
_WITH_BOXES = (f"(obt o LEFT JOIN {_BOXES} pb ON o.pickup_city_id = pb.city_id "
               f"LEFT JOIN {_BOXES} db ON o.dropoff_city_id = db.city_id)")


@register("G2_coordinate_check", _q(_summary_sql(_WITH_BOXES, _COORD_RULES)))
def g2(spark, sf_dir):
    lh = lake(spark, sf_dir)
    return G.coordinate_check(lh.obt, G.boxes_by_rule(lh.maps["map_cities"]))


@register("G2_coordinate_violations", _rows_sql(_WITH_BOXES, _COORD_RULES, "o.ride_id"))
def g2_rows(spark, sf_dir):
    lh = lake(spark, sf_dir)
    return _failed(G.coordinate_violations(lh.obt, G.boxes_by_rule(lh.maps["map_cities"])))


_REAL = "(SELECT * FROM (VALUES " + ", ".join(
    f"({b[0]}, {', '.join(D(x) for x in b[1:])})" for b in CITY_BOXES) + ") AS t(city_id, lat_min, lat_max, lon_min, lon_max))"


@register("G2_coordinate_check_model_boxes", _q(_summary_sql(_WITH_BOXES.replace(_BOXES, _REAL), _COORD_RULES)))
def g2_model(spark, sf_dir):
    """The ride model's own 57 boxes."""
    return G.coordinate_check(lake(spark, sf_dir).obt, city_boxes(spark))


@register("G2b_locate_pickup_city", _q(f"""
SELECT o.pickup_city_id, b.city_id AS located_city_id, COUNT(*) AS rides
FROM obt o LEFT JOIN {_BOXES} b
  ON o.pickup_latitude BETWEEN b.lat_min AND b.lat_max AND o.pickup_longitude BETWEEN b.lon_min AND b.lon_max
GROUP BY 1, 2"""))
def g2b(spark, sf_dir):
    """Reverse lookup point -> city for every ride, counted per (claimed, located) city."""
    lh = lake(spark, sf_dir)
    located = G.locate_city(lh.obt.select("pickup_city_id", "pickup_latitude", "pickup_longitude"),
                            G.boxes_by_rule(lh.maps["map_cities"]))
    return located.groupBy("pickup_city_id", "located_city_id").agg(F.count(F.lit(1)).alias("rides"))


_PICK, _DROP = "TRY_CAST(pickup_timestamp AS TIMESTAMP)", "TRY_CAST(dropoff_timestamp AS TIMESTAMP)"
_TIME_RULES = {
    "booking_1_to_5_min_before_pickup": (
        f"booking_timestamp IS NOT NULL AND {_PICK} IS NOT NULL",
        f"date_diff('second', booking_timestamp, {_PICK}) < 60 OR "
        f"date_diff('second', booking_timestamp, {_PICK}) > 300"),
    "dropoff_is_pickup_plus_duration": (
        f"{_PICK} IS NOT NULL AND {_DROP} IS NOT NULL AND duration_minutes IS NOT NULL",
        f"date_diff('second', {_PICK}, {_DROP}) != duration_minutes * 60"),
    "duration_at_least_4_min": ("duration_minutes IS NOT NULL", "duration_minutes < 4"),
    "timestamps_parse": ("pickup_timestamp IS NOT NULL OR dropoff_timestamp IS NOT NULL",
                         f"(pickup_timestamp IS NOT NULL AND {_PICK} IS NULL) OR "
                         f"(dropoff_timestamp IS NOT NULL AND {_DROP} IS NULL)"),
}


@register("G3_time_order_check", _q(_summary_sql("obt", _TIME_RULES)))
def g3(spark, sf_dir):
    return G.time_order_check(lake(spark, sf_dir).obt)


@register("G3_time_order_violations", _rows_sql("obt", _TIME_RULES))
def g3_rows(spark, sf_dir):
    return _failed(G.time_order_violations(lake(spark, sf_dir).obt))


_STATUS_RULES = {
    "status_known": ("TRUE", "ride_status_id IS NULL OR ride_status_id NOT IN (1, 2)"),
    "cancelled_has_reason_1_to_3": ("ride_status_id = 2", "cancellation_reason_id IS NULL OR "
                                                          "cancellation_reason_id NOT IN (1, 2, 3)"),
    "cancelled_has_no_rating": ("ride_status_id = 2", "rating IS NOT NULL"),
    "completed_has_reason_4": ("ride_status_id = 1", "cancellation_reason_id IS NULL OR "
                                                     "cancellation_reason_id != 4"),
    "completed_has_rating": ("ride_status_id = 1", "rating IS NULL"),
}


@register("G4_status_check", _q(_summary_sql("obt", _STATUS_RULES)))
def g4(spark, sf_dir):
    return G.status_check(lake(spark, sf_dir).obt)


@register("G4_status_violations", _rows_sql("obt", _STATUS_RULES))
def g4_rows(spark, sf_dir):
    return _failed(G.status_violations(lake(spark, sf_dir).obt))


_KEY_JOINS = " ".join(f"LEFT JOIN (SELECT DISTINCT {key} AS k{i} FROM {name}) m{i} ON o.{col} = m{i}.k{i}"
                      for i, (col, name, key) in enumerate(V.KEYS))
_KEY_RULES = {col: (f"o.{col} IS NOT NULL", f"m{i}.k{i} IS NULL") for i, (col, _, _) in enumerate(V.KEYS)}


@register("G5_key_integrity", _q(_summary_sql(f"(obt o {_KEY_JOINS})", _KEY_RULES)))
def g5(spark, sf_dir):
    lh = lake(spark, sf_dir)
    return G.key_integrity(lh.obt, lh.maps)


@register("G5_key_violations", _rows_sql(f"(obt o {_KEY_JOINS})", _KEY_RULES, "o.ride_id"))
def g5_rows(spark, sf_dir):
    lh = lake(spark, sf_dir)
    return _failed(G.key_violations(lh.obt, lh.maps))


def _share_sql() -> str:
    weights = V.WEIGHTS | {"pickup_city_id": CITY_WEIGHTS}
    obs = " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, CAST({d} AS BIGINT) AS category_id, COUNT(*) AS observed_rides "
        f"FROM obt GROUP BY 2" for d in weights)
    vals = ", ".join(f"('{d}', {i}, {float(w)})" for d, ws in weights.items() for i, w in ws)
    return _q(f"""
SELECT COALESCE(o.dimension, e.dimension) AS dimension, COALESCE(o.category_id, e.category_id) AS category_id,
  COALESCE(o.observed_rides, 0) AS observed_rides, COALESCE(o.observed_share, {D(0)}) AS observed_share,
  COALESCE(e.expected_share, {D(0)}) AS expected_share,
  COALESCE(o.observed_share, {D(0)}) - COALESCE(e.expected_share, {D(0)}) AS drift
FROM (SELECT *, observed_rides / SUM(observed_rides) OVER (PARTITION BY dimension) AS observed_share
      FROM ({obs})) o
FULL OUTER JOIN (SELECT dimension, CAST(category_id AS BIGINT) AS category_id,
      CAST(weight AS DOUBLE) / SUM(CAST(weight AS DOUBLE)) OVER (PARTITION BY dimension) AS expected_share
      FROM (VALUES {vals}) AS t(dimension, category_id, weight)) e
  ON o.dimension = e.dimension AND o.category_id = e.category_id""")


@register("G6_share_drift", _share_sql())
def g6(spark, sf_dir):
    return G.share_drift(spark, lake(spark, sf_dir).obt)


def _bands_sql() -> str:
    sel = []
    for m, (edges, _) in V.BANDS.items():
        last = len(edges) - 2
        whens = " ".join(
            f"WHEN {m} >= {D(edges[i])} AND {m} {'<=' if i == last else '<'} {D(edges[i + 1])} THEN {i}"
            for i in range(len(edges) - 1))
        sel.append(f"SELECT '{m}' AS measure, CASE WHEN {m} IS NULL THEN NULL {whens} ELSE -1 END AS band FROM obt")
    vals = []
    for m, (edges, ws) in V.BANDS.items():
        tot = float(sum(ws))
        vals += [f"('{m}', {i}, {float(edges[i])}, {float(edges[i + 1])}, {w / tot!r})" for i, w in enumerate(ws)]
    return _q(f"""
SELECT COALESCE(o.measure, e.measure) AS measure, CAST(COALESCE(o.band, e.band) AS BIGINT) AS band,
  CAST(e.band_lo AS DOUBLE) AS band_lo, CAST(e.band_hi AS DOUBLE) AS band_hi,
  COALESCE(o.observed_rides, 0) AS observed_rides, COALESCE(o.observed_share, {D(0)}) AS observed_share,
  COALESCE(CAST(e.expected_share AS DOUBLE), {D(0)}) AS expected_share
FROM (SELECT measure, band, COUNT(*) AS observed_rides,
        COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY measure) AS observed_share
      FROM ({' UNION ALL '.join(sel)}) WHERE band IS NOT NULL GROUP BY measure, band) o
FULL OUTER JOIN (VALUES {', '.join(vals)}) AS e(measure, band, band_lo, band_hi, expected_share)
  ON o.measure = e.measure AND o.band = e.band""")


@register("G7_band_histograms", _bands_sql())
def g7(spark, sf_dir):
    return G.band_histograms(spark, lake(spark, sf_dir).obt)


# ---------------------------------------------------------------- T1-T13, S8 (pipeline)

from ridepulse.operators import scd as SCD  # noqa: E402
from ridepulse.operators import silver as SV  # noqa: E402
from ridepulse.schemas import DIM_COLUMNS, MAP_SCHEMAS, RIDE_COLUMNS, RIDES  # noqa: E402
from ridepulse.sources import events as EV  # noqa: E402
from ridepulse.sources.binding import read_table  # noqa: E402
from ridepulse.sources.lookups import load_map  # noqa: E402
from ridepulse.streaming import dimensions, flows, windows  # noqa: E402

_RIDES = ", ".join(RIDE_COLUMNS)


@register("T1_parse_event_props", """
SELECT event_type, COUNT(*) AS events,
  CAST(SUM(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k,
  COUNT(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS parsed
FROM events GROUP BY event_type""")
def t1_props(spark, sf_dir):
    """T1 on the events table: JSON text column -> typed struct field."""
    ev = SV.parse_rides(read_table(spark, sf_dir, "events"), "props", keep=["event_type"], schema="k BIGINT")
    k = F.col("k")
    return ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"),
                                        F.sum(k).alias("sum_k"), F.count(k).alias("parsed"))


@register("T1_ride_json_roundtrip", _q(f"SELECT {_RIDES} FROM rides"))
def t1_rides(spark, sf_dir):
    """S8 payload -> S2/T1/T2/T3: every ride of the staging table through its JSON
    event and back."""
    events = EV.ride_events(lake(spark, sf_dir).stg).withColumnRenamed("value", "rides")
    return SV.normalise_ts(SV.parse_rides(events))


def _three_sources(spark, sf_dir):
    """Bulk, live and archive sources that overlap on purpose.

    Every ride is in at least one source: key digits 0-5 bulk, 4-8 live, 8-9
    archive, so rides ending in 4, 5 or 8 arrive twice.  Bulk keeps its
    booking time as text (normalised by T3), live arrives as JSON events.
    """
    rides = lake(spark, sf_dir).stg  # the written ride table (one row per order)
    digit = F.col("ride_id").cast("long") % 10
    bulk = rides.where(digit.between(0, 5)) \
        .withColumn("booking_timestamp", F.date_format("booking_timestamp", "yyyy-MM-dd'T'HH:mm:ss"))
    live = SV.parse_rides(EV.ride_events(rides.where(digit.between(4, 8)))
                          .withColumnRenamed("value", "rides"))
    archive = rides.where(digit.between(8, 9))
    return bulk, live, archive


_THREE_SQL = " UNION ALL ".join(
    f"SELECT {_RIDES} FROM rides WHERE CAST(ride_id AS BIGINT) % 10 BETWEEN {a} AND {b}"
    for a, b in [(0, 5), (4, 8), (8, 9)])


@register("T4_stg_append_three_sources", _q(_THREE_SQL))
def t4(spark, sf_dir):
    """Literal append of the three sources (duplicates kept)."""
    return SV.build_stg(*_three_sources(spark, sf_dir), dedup=False)


@register("T5_stg_dedup", _q(f"SELECT {_RIDES} FROM rides"))
def t5(spark, sf_dir):
    """The same three sources with the promised dedup by ride_id."""
    return SV.build_stg(*_three_sources(spark, sf_dir), dedup=True)


@register("T6_silver_obt", _q("SELECT * FROM obt"))
def t6(spark, sf_dir):
    return lake(spark, sf_dir).obt.drop(BOOKING_MONTH)


@register("T6_silver_obt_literal_city", _q(_obt_select("rides", "r.pickup_city_id = cv.city_id")))
def t6_literal(spark, sf_dir):
    """Plain equi-join on the city id: a city with two versions doubles its rides."""
    lh = lake(spark, sf_dir)
    return SV.build_obt(lh.stg, lh.maps, city_mode="literal")


_GOLD_SQL = {
    "T9a_dim_passenger": "dim_passenger", "T9b_dim_driver": "dim_driver",
    "T9c_dim_vehicle": "dim_vehicle", "T9d_dim_payment": "dim_payment",
    "T9e_dim_booking": "dim_booking", "T9f_dim_location_scd2": "dim_location",
    "T9g_fact": "fact",
}


def _gold_query(table: str):
    def run(spark, sf_dir):
        return getattr(lake(spark, sf_dir).star, table)
    return run


for _qid, _tbl in _GOLD_SQL.items():
    register(_qid, _q(f"SELECT * FROM {_tbl}"))(_gold_query(_tbl))


_DRIVER_SEQ = ["driver_id", "driver_name", "driver_rating", "booking_timestamp"]


@register("T11_scd1_latest_driver", _q("""
SELECT driver_id, driver_name, driver_rating, booking_timestamp FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY driver_id ORDER BY booking_timestamp DESC NULLS LAST,
    driver_name ASC NULLS FIRST, driver_rating ASC NULLS FIRST, booking_timestamp ASC NULLS FIRST) AS rn
  FROM obt WHERE driver_id IS NOT NULL) WHERE rn = 1"""))
def t11(spark, sf_dir):
    """SCD-1 with ``sequence_by=booking_timestamp``: a driver's latest row wins."""
    upd = lake(spark, sf_dir).obt.select(*_DRIVER_SEQ)
    return SCD.scd1(None, upd, ["driver_id"], "booking_timestamp")


@register("T11_scd1_two_batches", REGISTRY["T11_scd1_latest_driver"][1])
def t11b(spark, sf_dir):
    """The same upsert applied in two batches (before / from 1998): same table."""
    upd = lake(spark, sf_dir).obt.select(*_DRIVER_SEQ)
    cut = F.lit("1998-01-01 00:00:00").cast("timestamp")
    first = SCD.scd1(None, upd.where(F.col("booking_timestamp") < cut), ["driver_id"], "booking_timestamp")
    return SCD.scd1(first, upd.where(F.col("booking_timestamp") >= cut), ["driver_id"], "booking_timestamp")


@register("T12_scd2_late_versions", _q("SELECT * FROM dim_location"))
def t12(spark, sf_dir):
    """SCD-2 where the newer city versions arrive first and the older ones late."""
    obt = lake(spark, sf_dir).obt
    loc = obt.select(*DIM_COLUMNS["dim_location"]).where("pickup_city_id IS NOT NULL")
    cut = F.lit("1998-01-01 00:00:00").cast("timestamp")
    first = SCD.scd2(None, loc.where(F.col("city_updated_at") >= cut), ["pickup_city_id"], "city_updated_at")
    return SCD.scd2(first, loc.where(F.col("city_updated_at") < cut), ["pickup_city_id"], "city_updated_at")


@register("T13_as_of_location", _q("""
SELECT f.pickup_city_id, l.pickup_city, COUNT(*) AS rides
FROM fact f LEFT JOIN dim_booking b ON f.ride_id = b.ride_id
LEFT JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY pickup_city_id ORDER BY __START_AT) = 1 AS first_v
           FROM dim_location) l
  ON f.pickup_city_id = l.pickup_city_id
 AND (l.__END_AT IS NULL OR b.booking_timestamp < l.__END_AT)
 AND (l.first_v OR b.booking_timestamp >= l.__START_AT)
GROUP BY 1, 2"""))
def t13(spark, sf_dir):
    """Rides per city *as named when booked* (temporal join to the SCD-2 history)."""
    st = lake(spark, sf_dir).star
    fb = st.fact_with_booking(["pickup_city_id"], ["booking_timestamp"])
    j = SCD.as_of_join(fb, st.dim_location.select("pickup_city_id", "pickup_city", "__START_AT", "__END_AT"),
                       "pickup_city_id", "pickup_city_id", "booking_timestamp")
    return j.groupBy("pickup_city_id", "pickup_city").agg(F.count(F.lit(1)).alias("rides"))


def _scratch(spark, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return posixpath.join(checkpoint_dir(spark), "ridepulse-rows", f"{name}-{uuid.uuid4().hex}")


@register("S8_ride_events", _q("""
SELECT ride_id AS key, CAST(43 AS INTEGER) AS n_fields, total_fare, duration_minutes, passenger_name,
  strftime(booking_timestamp, '%Y-%m-%dT%H:%M:%S.%f') AS booking_timestamp, rating IS NULL AS rating_is_null
FROM rides"""))
def s8(spark, sf_dir):
    """Every ride as a (key, JSON value) event; the payload is read back field by field."""
    events = EV.ride_events(lake(spark, sf_dir).stg)
    field = lambda f: F.get_json_object("value", f"$.{f}")
    return events.select("key", F.size(F.json_object_keys("value")).alias("n_fields"), field("total_fare").cast("double").alias("total_fare"),
                         field("duration_minutes").cast("long").alias("duration_minutes"), field("passenger_name").alias("passenger_name"),
                         field("booking_timestamp").alias("booking_timestamp"), field("rating").isNull().alias("rating_is_null"))


@register("S2_payload_text", _q(f"SELECT {_RIDES} FROM rides"))
def s2(spark, sf_dir):
    """Binary broker values -> text -> rides."""
    broker = EV.ride_events(lake(spark, sf_dir).stg).select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
    return SV.normalise_ts(SV.parse_rides(EV.with_payload(broker)))


@register("S3_city_map", _q("SELECT city_id, city, state, region, updated_at FROM map_cities"))
def s3(spark, sf_dir):
    """The city map written as one JSON array, as lookup files are, and loaded with its schema."""
    path = _scratch(spark, "map")
    rows = lake(spark, sf_dir).maps["map_cities"].withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"))
    rows.agg(F.to_json(F.collect_list(F.struct("city_id", "city", "state", "region", "updated_at"))).alias("value")).write.text(path)
    return load_map(spark, "map_cities", path)


def _bulk_files(spark, sf_dir) -> str:
    path = _scratch(spark, "bulk")
    lake(spark, sf_dir).stg.withColumn("booking_timestamp", F.date_format("booking_timestamp", "yyyy-MM-dd'T'HH:mm:ss")).write.parquet(path)
    return path


@register("S5_bulk_rides", _q(f"SELECT {_RIDES} FROM rides"))
def s5(spark, sf_dir):
    """Bulk history with its booking time as text, picked up as a stream and normalised."""
    out = _scratch(spark, "bulk-read")
    (EV.bulk_source(spark, _bulk_files(spark, sf_dir), fmt="parquet").writeStream.format("parquet").trigger(availableNow=True)
     .option("checkpointLocation", out + "-checkpoint").start(out).awaitTermination())
    return spark.read.schema(RIDES).parquet(out)


def _in_three_triggers(spark, parts: list[DataFrame], name: str, start) -> None:
    """Feed ``parts`` to a streaming query file by file: two triggers, then a restart from the checkpoint with the third
    part and the first one again.  ``start(stream, checkpoint)`` starts the query."""
    path = _scratch(spark, name)
    for part in [parts[0], parts[1], [parts[2], parts[0]]]:
        new = part if isinstance(part, list) else [part]
        for p in new:
            p.coalesce(1).write.mode("append").parquet(f"{path}/in")
        if part is not parts[0]:
            stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
            start(stream, f"{path}/checkpoint").awaitTermination()


@register("T11_stream_scd1", REGISTRY["T11_scd1_latest_driver"][1])
def t11_stream(spark, sf_dir):
    """Drivers' latest rows from a streaming aggregate, merged into a table partition by partition."""
    rows = lake(spark, sf_dir).obt.select(*_DRIVER_SEQ)
    out = Lake(spark, _scratch(spark, "scd1"))
    put = dimensions.replace_keys(out, "gold", "t", ["driver_id"], rows.schema, buckets=8)
    part = F.pmod(F.xxhash64(*_DRIVER_SEQ), F.lit(3))
    _in_three_triggers(spark, [rows.where(part == i) for i in range(3)], "scd1-in", lambda stream, checkpoint: (
        dimensions.latest(stream, ["driver_id"], "booking_timestamp").writeStream.outputMode("update").foreachBatch(put)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()))
    return out.read("gold", "t").drop(dimensions.BUCKET)


@register("T12_stream_scd2", _q("SELECT * FROM dim_location"))
def t12_stream(spark, sf_dir):
    """City versions from streaming dedup state; newer versions arrive first, older ones late, some twice."""
    rows = lake(spark, sf_dir).obt.select(*DIM_COLUMNS["dim_location"])
    late = F.col("city_updated_at") < F.lit("1998-01-01 00:00:00").cast("timestamp")
    half = F.pmod(F.xxhash64(*rows.columns), F.lit(2)) == 0
    out = _scratch(spark, "scd2")
    keys = ["pickup_city_id", "city_updated_at"]
    _in_three_triggers(spark, [rows.where(~late & half), rows.where(~late & ~half), rows.where(late)], "scd2-in", lambda stream, checkpoint: (
        dimensions.first_seen(stream, keys).writeStream.format("parquet").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(out)))
    return SCD.with_end_at(spark.read.schema(rows.schema).parquet(out), ["pickup_city_id"], "city_updated_at")


_UPDATES: dict[tuple, tuple] = {}


def streamed(spark, sf_dir) -> tuple[Lake, dict]:
    """Two streaming updates over the rides as JSON events, run once per session: rides with an even id, then the others
    with copies of the first ones that carry another booking time or none.  The lake and the updates' quality counts.

    An update's events are kept until the archive holds them (the topic's retention); silver and gold read the archive."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _UPDATES:
        lh, out, counts = staged(spark, sf_dir), Lake(spark, _scratch(spark, "stream")), {}
        rides = lh.stg.select(*RIDE_COLUMNS)
        even = F.col("ride_id").cast("long") % 2 == 0
        moved = F.when(F.col("ride_id").cast("long") % 4 == 0, F.col("booking_timestamp") + F.make_dt_interval(F.lit(40)))
        for number, new in enumerate([rides.where(even), rides.where(~even).unionByName(rides.where(even).withColumn("booking_timestamp", moved))]):
            EV.publish_rides_files(new, f"{out.root}/events/{number}")
            found: dict = {}
            flows.run_update(spark, out, lh.maps, EV.raw_event_files(spark, f"{out.root}/events/*"), quality=found,
                             archived=lambda: out.remove(f"{out.root}/events/{number}"))
            counts = {k: (c + counts.get(k, (0, 0))[0], v + counts.get(k, (0, 0))[1]) for k, (c, v) in found.items()}
        _UPDATES[key] = out, counts
    return _UPDATES[key]


_MOVED = """SELECT * REPLACE (CASE WHEN CAST(ride_id AS BIGINT) % 4 = 0 THEN booking_timestamp + INTERVAL 40 DAY END AS booking_timestamp)
  FROM rides WHERE CAST(ride_id AS BIGINT) % 2 = 0"""


@register("S6_stream_archive", _q(f"SELECT {_RIDES} FROM rides UNION ALL SELECT {_RIDES} FROM ({_MOVED})"))
def s6_stream(spark, sf_dir):
    """Every event that came, copies too, in the parsed archive."""
    return streamed(spark, sf_dir)[0].read(*flows.ARCHIVE, RIDES)


@register("T5_stream_dedup", _q(f"SELECT {_RIDES} FROM rides"))
def t5_stream(spark, sf_dir):
    """Silver rides of the streaming updates: copies are dropped whatever their booking time says."""
    return flows.read_obt(streamed(spark, sf_dir)[0]).select(*RIDE_COLUMNS)


@register("S7_stream_fact", REGISTRY["T9g_fact"][1])
def s7_fact(spark, sf_dir):
    return flows.read_star(streamed(spark, sf_dir)[0]).fact


@register("S7_stream_dim_driver", REGISTRY["T9b_dim_driver"][1])
def s7_driver(spark, sf_dir):
    return flows.read_star(streamed(spark, sf_dir)[0]).dim_driver


@register("S9_stream_dim_location", REGISTRY["T12_stream_scd2"][1])
def s9_location(spark, sf_dir):
    return flows.read_star(streamed(spark, sf_dir)[0]).dim_location


@register("S9_stream_revenue_by_city", REGISTRY["Q3_rides_by_city"][1])
def s9_city(spark, sf_dir):
    """A dashboard query on the tables that the streams keep."""
    return Q.rides_by_city(flows.read_star(streamed(spark, sf_dir)[0]))


@register("G1_G4_stream_metrics", " UNION ALL ".join(f"SELECT * FROM ({REGISTRY[k][1]})" for k in (
    "G1_fare_audit", "G3_time_order_check", "G4_status_check")))
def g_stream(spark, sf_dir):
    """Rule counts that the streaming updates observed on the way, without a scan."""
    found = streamed(spark, sf_dir)[1]
    rows = [(k, c, v) for k, (c, v) in found.items() if k != "has_ride_id"]
    return spark.createDataFrame(rows, "rule string, checked long, violations long")


@register("T7_stream_demand_windows", _q(f"""
SELECT w.as_of, w.pickup_city_id, w.rides_last_6h, w.avg_rides_per_hour, w.avg_surge_last_6h, w.cancellation_rate_last_6h,
  {RND(f"COALESCE(avg_rides_per_hour, 0) * {D(1)}", 1)} AS predicted_rides FROM (
  SELECT as_of, pickup_city_id, {_FEATURES.replace(D(WINDOW_H), D(6))} FROM (
    SELECT *, date_trunc('hour', booking_timestamp) + to_hours(n) AS as_of FROM obt, (SELECT UNNEST(range(1, 7)) AS n)
    WHERE booking_timestamp IS NOT NULL AND pickup_city_id IS NOT NULL)
  GROUP BY as_of, pickup_city_id) w
WHERE w.as_of <= (SELECT MAX(booking_timestamp) - INTERVAL 3 MINUTE FROM obt WHERE pickup_city_id IS NOT NULL)"""))
def t7_stream(spark, sf_dir):
    """A9 for every window that has closed, from a stream in booking order (three triggers and the one that closes windows)."""
    rows = lake(spark, sf_dir).obt.select("booking_timestamp", "pickup_city_id", "surge_multiplier", "ride_status_id")
    path = _scratch(spark, "windows")
    for low, high in ((None, "1994-01-01"), ("1994-01-01", "1996-01-01"), ("1996-01-01", None)):
        part = rows.where(F.col("booking_timestamp") >= F.lit(low).cast("timestamp")) if low else rows
        part = part.where(F.col("booking_timestamp") < F.lit(high).cast("timestamp")) if high else part
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    (windows.demand_windows(stream, horizon_hours=1).writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint")
     .trigger(availableNow=True).start(f"{path}/out").awaitTermination())
    return spark.read.parquet(f"{path}/out").select("as_of", "pickup_city_id", "rides_last_6h", "avg_rides_per_hour", "avg_surge_last_6h",
                                                     "cancellation_rate_last_6h", "predicted_rides")


_VERSIONS = """SELECT driver_id, date_trunc('day', booking_timestamp) AS start_at, MAX(driver_rating) AS driver_rating FROM obt
  WHERE driver_id IS NOT NULL AND booking_timestamp IS NOT NULL GROUP BY 1, 2"""


@register("T13_as_of_many_versions", _q(f"""
SELECT * FROM (WITH v AS ({_VERSIONS}), f AS (SELECT ride_id, driver_id, booking_timestamp - INTERVAL 36 HOUR AS at FROM obt WHERE ride_id IS NOT NULL),
  first_v AS (SELECT driver_id, MIN(start_at) AS start_at, arg_min(driver_rating, start_at) AS driver_rating FROM v GROUP BY 1),
  many AS (SELECT driver_id FROM v GROUP BY 1 HAVING COUNT(*) > 1)
SELECT f.ride_id, CASE WHEN f.at IS NULL AND m.driver_id IS NOT NULL THEN NULL ELSE COALESCE(v.start_at, o.start_at) END AS version_start,
  CASE WHEN f.at IS NULL AND m.driver_id IS NOT NULL THEN NULL WHEN v.start_at IS NOT NULL THEN v.driver_rating ELSE o.driver_rating END AS rating
FROM f ASOF LEFT JOIN v ON f.driver_id = v.driver_id AND f.at >= v.start_at
LEFT JOIN first_v o ON f.driver_id = o.driver_id LEFT JOIN many m ON f.driver_id = m.driver_id)"""))
def t13_many(spark, sf_dir):
    """Each ride with its driver's daily version 36 hours before booking: a history of many versions per key."""
    obt = lake(spark, sf_dir).obt
    versions = obt.where("driver_id IS NOT NULL AND booking_timestamp IS NOT NULL").groupBy(
        "driver_id", F.date_trunc("day", "booking_timestamp").alias("seen")).agg(F.max("driver_rating").alias("rating"))
    history = SCD.with_end_at(versions, ["driver_id"], "seen")
    facts = obt.where("ride_id IS NOT NULL").select("ride_id", "driver_id", (F.col("booking_timestamp") - F.make_dt_interval(
        F.lit(0), F.lit(36))).alias("at"))
    return SCD.as_of_sorted(facts, history, "driver_id", "driver_id", "at").select("ride_id", F.col("seen").alias("version_start"), "rating")


@register("S4_manifest_load", _q("SELECT city_id, city, state, region, updated_at FROM map_cities"))
def s4(spark, sf_dir):
    """All six maps and the bulk rides loaded by a manifest; the city map as it lies in the lake."""
    path, lh = _scratch(spark, "manifest"), staged(spark, sf_dir)
    for name, rows in lh.maps.items():  # a fixed map's rows, as one array
        if name == "map_cities":
            rows = rows.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"))
        rows = rows.select(*MAP_SCHEMAS[name].fieldNames())
        rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")).write.text(f"{path}/{name}.json")
    EV.publish_rides_files(lh.stg, f"{path}/bulk_rides.json")
    files = [{"file": name} for name in lh.maps] + [{"file": "bulk_rides", "lines": True}]
    spark.createDataFrame([(json.dumps(files),)], "value string").coalesce(1).write.text(f"{path}/files.json")
    out = Lake(spark, f"{path}/lake")
    EV.load_manifest(spark, f"{path}/files.json", path, out)
    return out.read("bronze", "map_cities")


_GUARDED = [("NATION_3", 5, 20, 4), ("  nation_5 ", 25, 0, 23), ("x", 5, 1, 2), ("NATION_1", 26, 1, 2), ("NATION_1", 5, -1, 2)]


@register("V1_V4_guarded_calls", _q(f"""
SELECT CAST(0 AS INTEGER) AS call, l.pickup_city AS city, COUNT(*) AS rides FROM fact f JOIN loc_cur l USING (pickup_city_id)
  JOIN dim_booking b USING (ride_id) WHERE l.pickup_city = 'NATION_3' AND hour(b.booking_timestamp) BETWEEN 4 AND 20 GROUP BY 2
UNION ALL SELECT 1, l.pickup_city, COUNT(*) FROM fact f JOIN loc_cur l USING (pickup_city_id)
  JOIN dim_booking b USING (ride_id) WHERE l.pickup_city = 'NATION_5' AND b.booking_timestamp IS NOT NULL GROUP BY 2
UNION ALL SELECT 2, 'rejected', 0 UNION ALL SELECT 3, 'rejected', 0 UNION ALL SELECT 4, 'rejected', 0"""))
def guarded(spark, sf_dir):
    """Rides of a city in an hour range; each call's city, limit and hours are guarded, and bad ones are rejected."""
    st, parts = lake(spark, sf_dir).star, []
    for call, (city, limit, first, last) in enumerate(_GUARDED):
        try:
            name, most, (low, high) = validate_city(city), validate_limit(limit), validate_hour_range(first, last)
        except ValueError:
            parts.append(spark.createDataFrame([(call, "rejected", 0)], "call int, city string, rides long"))
            continue
        rides = st.fact_with_booking(["pickup_city_id"], ["booking_timestamp"]).join(st.location_lookup(), "pickup_city_id")
        rides = rides.where((F.lower("pickup_city") == F.lit(name.lower())) & F.hour("booking_timestamp").between(low, high))
        parts.append(rides.groupBy(F.col("pickup_city").alias("city")).agg(F.count(F.lit(1)).alias("rides")).limit(most)
                     .select(F.lit(call).alias("call"), "city", "rides"))
    out = parts[0]
    for q in parts[1:]:
        out = out.unionByName(q)
    return out


_BOUND = [("NATION_5", 3), (" nation_1 ", 1), ("x' OR '1'='1", 2), ("NATION_5'; DROP TABLE rides; --", 24), ("NATION_5", 0), ("NATION_5", 25),
          ("NATION_5", None), ("NATION_5", "1 OR 1=1"), ("", 1)]


def _bound_sql(call: int, city: str, horizon: int) -> str:
    return (f"SELECT CAST({call} AS INTEGER) AS call, {_lit(city)} AS city, CAST({horizon} AS BIGINT) AS horizon_hours, COUNT(*) AS rides, "
            f"{RND(f'COUNT(*) / {D(WINDOW_H)} * {D(horizon)}', 1)} AS predicted_rides FROM obt WHERE lower(pickup_city) = lower({_lit(city)}) AND {_WIN}")


@register("V5_V6_bound_parameters", _q(" UNION ALL ".join(
    [_bound_sql(i, c.strip(), h) for i, (c, h) in enumerate(_BOUND[:4])]
    + [f"SELECT {i}, 'rejected', NULL, NULL, NULL" for i in range(4, len(_BOUND))])))
def bound(spark, sf_dir):
    """A9's window as SQL text with named parameters: good, bad and injecting values."""
    obt, parts = lake(spark, sf_dir).obt, []
    columns = "call int, city string, horizon_hours long, rides long, predicted_rides double"
    for call, (city, horizon) in enumerate(_BOUND):
        try:
            parts.append(FC.bound_city_demand(obt, city, horizon, AS_OF, WINDOW_H).select(F.lit(call).alias("call"), "*"))
        except ValueError:
            parts.append(spark.createDataFrame([(call, "rejected", None, None, None)], columns))
    out = parts[0]
    for q in parts[1:]:
        out = out.unionByName(q)
    return out
