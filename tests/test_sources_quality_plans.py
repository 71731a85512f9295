"""Sources and sinks, seeded quality violations, and plan-shape checks."""

import json
import os

from pyspark.sql import functions as F

from ridepulse.operators import quality as G
from ridepulse.operators import silver as SV
from ridepulse.operators.gold import build_star
from ridepulse.operators import star as Q
from ridepulse.plans.catalog import REGISTRY
from ridepulse.plans.lakehouse import materialized
from ridepulse.sources import events as EV
from ridepulse.sources.lake import Lake
from ridepulse.sources.lookups import builtin_map, load_map
from tests.conftest import SF_SMALL, ride, rides_df, small_maps


def test_kafka_options_carry_rate_limit_and_auth():
    o = EV.kafka_options("host:9093", "rides", "$ConnectionString", "secret")
    assert o["subscribe"] == "rides" and o["maxOffsetsPerTrigger"] == "10000"
    assert o["failOnDataLoss"] == "false" and o["startingOffsets"] == "earliest"
    assert 'password="secret"' in o["kafka.sasl.jaas.config"]
    assert EV.kafka_options("h", "t", "u", "p", maxOffsetsPerTrigger=5)["maxOffsetsPerTrigger"] == "5"


def test_payload_round_trip_and_with_payload(spark):
    rows = [ride(ride_id="a", rating=None), ride(ride_id="b")]
    ev = EV.ride_events(rides_df(spark, rows))
    payload = json.loads(ev.where("key = 'a'").first().value)
    assert payload["rating"] is None and payload["booking_timestamp"].startswith("2024-01-01T12:00:00")
    kafka_like = ev.select(F.col("value").cast("binary").alias("value"), F.lit(0).alias("partition"))
    parsed = SV.parse_rides(EV.with_payload(kafka_like), keep=["partition"])
    assert sorted(r.ride_id for r in parsed.collect()) == ["a", "b"]


def test_lookup_loader_and_manifest(spark, tmpdir_fresh):
    d = os.path.join(tmpdir_fresh, "data")
    os.makedirs(d)
    with open(os.path.join(d, "map_cities.json"), "w") as f:
        json.dump([{"city_id": 27, "city": "Portland", "state": "ME", "region": "Northeast",
                    "updated_at": "2026-01-02T05:30:00.000+00:00"}], f)
    with open(os.path.join(d, "map_ride_statuses.json"), "w") as f:
        json.dump([{"ride_status_id": 1, "ride_status": "Completed", "is_completed": True}], f)
    with open(os.path.join(d, "files.json"), "w") as f:
        json.dump([{"file": "map_cities"}, {"file": "map_ride_statuses"}], f)
    cities = load_map(spark, "map_cities", os.path.join(d, "map_cities.json")).first()
    assert cities.city == "Portland" and cities.updated_at is not None
    lake = Lake(spark, os.path.join(tmpdir_fresh, "lake"))
    assert EV.load_manifest(spark, os.path.join(d, "files.json"), d, lake) == ["map_cities", "map_ride_statuses"]
    assert lake.read("bronze", "map_ride_statuses").count() == 1


def test_manifest_query_loads_every_map_and_all_bulk_rides(spark, monkeypatch):
    lakes, load = [], EV.load_manifest
    monkeypatch.setattr(EV, "load_manifest", lambda *a, **k: lakes.append(a[3]) or load(*a, **k))
    assert REGISTRY["S4_manifest_load"][0](spark, SF_SMALL).columns == ["city_id", "city", "state", "region", "updated_at"]
    lh = materialized(spark, SF_SMALL)
    for name, rows in {**lh.maps, "bulk_rides": lh.stg}.items():
        got = lakes[0].read("bronze", name).select(*rows.columns)
        assert rows.count() == got.count() > 0 and rows.exceptAll(got).isEmpty(), name


def test_manifest_of_lines_and_bulk_rides_by_line(spark, tmpdir_fresh):
    """A manifest with an entry per line names all its files, and rides that lie one per line are all loaded."""
    for name in ("new", "old"):
        EV.publish_rides_files(rides_df(spark, [ride(ride_id=f"{name}{i}") for i in range(5)]).coalesce(1), f"{tmpdir_fresh}/{name}.json", 2)
    with open(f"{tmpdir_fresh}/third.json", "w") as f:
        json.dump([{"ride_id": "x"}, {"ride_id": "y"}], f)
    with open(f"{tmpdir_fresh}/files.json", "w") as f:
        f.write('{"file": "new", "lines": true}\n{"file": "old", "lines": true}\n\n{"file": "third"}\n')
    lake = Lake(spark, f"{tmpdir_fresh}/lake")
    assert EV.load_manifest(spark, f"{tmpdir_fresh}/files.json", tmpdir_fresh, lake) == ["new", "old", "third"]
    assert [lake.read("bronze", name).count() for name in ("new", "old", "third")] == [5, 5, 2]
    assert lake.read("bronze", "old").where("booking_timestamp IS NOT NULL").count() == 5


def test_bulk_source_stream_normalises_time(spark, tmpdir_fresh):
    d = os.path.join(tmpdir_fresh, "bulk")
    os.makedirs(d)
    with open(os.path.join(d, "b.json"), "w") as f:
        json.dump([{"ride_id": "x", "booking_timestamp": "2024-01-01T00:00:07"},
                   {"ride_id": "y", "booking_timestamp": "garbage"}], f)
    stream = EV.bulk_source(spark, d)
    assert stream.isStreaming and dict(stream.dtypes)["booking_timestamp"] == "timestamp"
    batch = EV.bulk_rides(spark, d).orderBy("ride_id").collect()
    assert batch[0].booking_timestamp is not None and batch[1].booking_timestamp is None


def test_quality_finds_seeded_violations(spark):
    good = ride(ride_id="ok", vehicle_type_id=1, distance_miles=3.0, duration_minutes=10,
                base_fare=2.5, distance_fare=5.25, time_fare=3.5, surge_multiplier=1.0,
                subtotal=11.25, tip_amount=0.0, total_fare=11.25)
    bad = ride(ride_id="bad", total_fare=12.0, ride_status_id=2, cancellation_reason_id=4,
               rating=4.0, duration_minutes=2, vehicle_make_id=99,
               pickup_timestamp="2024-01-01T12:30:00")
    obt = SV.build_obt(rides_df(spark, [good, bad]), small_maps(spark))
    fares = {r.rule: r.violations for r in G.fare_audit(obt).collect()}
    assert fares["total_fare"] == 1 and fares["distance_fare"] == 0
    assert [r.ride_id for r in G.fare_violations(obt).collect()] == ["bad"]
    st = {r.rule: r.violations for r in G.status_check(obt).collect()}
    assert st["cancelled_has_reason_1_to_3"] == 1 and st["cancelled_has_no_rating"] == 1
    tm = {r.rule: r.violations for r in G.time_order_check(obt).collect()}
    assert tm["booking_1_to_5_min_before_pickup"] == 1 and tm["duration_at_least_4_min"] == 1
    keys = {r.rule: (r.checked, r.violations) for r in G.key_integrity(obt, small_maps(spark)).collect()}
    assert keys["vehicle_make_id"] == (2, 1) and keys["payment_method_id"] == (2, 0)


def test_quality_clean_fixture_has_no_violations(spark):
    obt = SV.build_obt(rides_df(spark, [ride()]), small_maps(spark))
    for summary in [G.fare_audit(obt), G.status_check(obt), G.time_order_check(obt)]:
        assert sum(r.violations for r in summary.collect()) == 0


def test_locate_city_grid_join(spark):
    boxes = spark.createDataFrame([(1, 40.0, 41.5, -75.0, -73.0), (2, 33.0, 34.0, -119.0, -118.0)],
                                  "city_id long, lat_min double, lat_max double, lon_min double, lon_max double")
    pts = spark.createDataFrame([("a", 40.7, -74.0), ("b", 33.5, -118.5), ("c", 0.0, 0.0)],
                                "id string, pickup_latitude double, pickup_longitude double")
    got = {r.id: r.located_city_id for r in G.locate_city(pts, boxes).collect()}
    assert got == {"a": 1, "b": 2, "c": None}
    plan = G.locate_city(pts, boxes)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_stay_jvm_side_and_broadcast_lookups(spark):
    for name in ["Q1_kpis", "Q3_rides_by_city", "A1_revenue_by_city", "G5_key_integrity", "T6_silver_obt"]:
        p = _plan(REGISTRY[name][0](spark, SF_SMALL))
        assert "CartesianProduct" not in p and "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    obt = SV.build_obt(rides_df(spark, [ride()]), small_maps(spark))
    p = _plan(obt)
    assert p.count("BroadcastHashJoin") == 6 and "SortMergeJoin" not in p


def test_top_k_and_pushdown(spark):
    st = build_star(SV.build_obt(rides_df(spark, [ride()]), small_maps(spark)))
    assert "TakeOrderedAndProject" in _plan(Q.rides_by_city(st))
    df = spark.read.parquet(f"{SF_SMALL}/orders.parquet").where("o_orderstatus = 'P'").select("o_orderkey")
    p = _plan(df)
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,P)]" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in p


def test_builtin_lookups_sizes(spark):
    sizes = {n: builtin_map(spark, n).count() for n in ["map_vehicle_types", "map_vehicle_makes",
                                                        "map_payment_methods", "map_ride_statuses",
                                                        "map_cancellation_reasons"]}
    assert sizes == {"map_vehicle_types": 5, "map_vehicle_makes": 7, "map_payment_methods": 4,
                     "map_ride_statuses": 2, "map_cancellation_reasons": 4}


def test_join_elimination_and_single_fact_scan(spark):
    q1 = REGISTRY["Q1_kpis"][0](spark, SF_SMALL)
    q1.write.format("noop").mode("overwrite").save()
    p = _plan(q1)
    assert "Join" not in p and p.count("FileScan parquet") == 1  # fact x booking skipped
    feed = REGISTRY["Q2_live_feed"][0](spark, SF_SMALL)
    feed.write.format("noop").mode("overwrite").save()
    assert "SortMergeJoin" not in _plan(feed) and "ShuffledHashJoin" not in _plan(feed)


def test_no_job_runs_before_an_action(spark):
    from ridepulse.plans.catalog import lake
    lake(spark, SF_SMALL).star.location_lookup()  # its size is checked once per star
    spark.sparkContext.setJobGroup("build", "plans only")
    for name in ["Q1_kpis", "Q2_live_feed", "Q3_rides_by_city", "Q6_surge_distribution", "A7a_silver_city_overview", "A8_recent_signals",
                 "A9_predict_city_demand"]:
        REGISTRY[name][0](spark, SF_SMALL)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("build"), name
    spark.sparkContext.setJobGroup("other", "")


def test_newest_rides_open_no_older_month(spark, tmpdir_fresh):
    """A broken file in an older month is noticed only when the older month is needed."""
    import glob
    from datetime import datetime

    import pytest
    from ridepulse.functions.dates import by_month, newest
    rows = [(f"r{m}{i}", datetime(2024, m, 1 + i)) for m in (1, 2, 3) for i in range(6)] + [("none", None)]
    by_month(spark.createDataFrame(rows, "ride_id string, booking_timestamp timestamp")).write.partitionBy("booking_month").parquet(f"{tmpdir_fresh}/t")

    def top(k, keep="true"):
        df = newest(spark.read.schema("ride_id string, booking_timestamp timestamp, booking_month date").parquet(f"{tmpdir_fresh}/t").where(keep), k)
        return [r.ride_id for r in df.orderBy(F.col("booking_timestamp").desc_nulls_last(), "ride_id").limit(k).collect()]

    want = [r[0] for r in sorted(rows, key=lambda r: r[1] or datetime(1, 1, 1), reverse=True)]
    for k in (1, 3, 6, 7, 18, 19, 25):
        assert top(k) == want[:k]
    assert top(1, "ride_id < 'r3'") == ["r25"]  # all of the newest month's rides are filtered away
    for f in glob.glob(f"{tmpdir_fresh}/t/booking_month=2024-01-01/*.parquet"):
        with open(f, "wb") as out:
            out.write(b"broken")
    assert top(1) == want[:1]
    with pytest.raises(Exception):
        top(18)


def test_trailing_windows_prune_months(spark):
    for name in ["A8_recent_signals", "A9_predict_city_demand", "A9b_predict_demand_all_cities", "A10_predict_surge_pressure",
                 "A10b_predict_pressure_all_cities"]:
        plan = _plan(REGISTRY[name][0](spark, SF_SMALL))
        assert any("PartitionFilters: [" in x and "booking_month" in x.split("PartitionFilters: [")[1].split("]")[0]
                   for x in plan.split("\n")), name


def test_snapshot_scans_the_rides_once_for_all_reports(spark):
    from ridepulse.plans.catalog import lake
    plan = Q.summaries(lake(spark, SF_SMALL).star)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Expand") == 1


def test_first_per_key_plans(spark):
    from ridepulse.operators import scd as SCD
    df = spark.createDataFrame([("a", 1, "x")], "k string, n int, v string").repartition(3)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        near, many, seq = (_plan(SV.first_per_key(df, ["k"], near_unique=True)), _plan(SV.first_per_key(df, ["k"])),
                           _plan(SCD.scd1(None, df, ["k"], "n")))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert near.count("Sort [") == 1 and near.count("hashpartitioning") == 1 and "SortAggregate" not in near
    assert "HashAggregate" in many and "SortAggregate" not in many and many.count("Sort [") == 1
    assert "HashAggregate" in seq and "SortAggregate" not in seq


def test_checkpoint_folder_rules(spark):
    from types import SimpleNamespace

    from ridepulse.session import checkpoint_dir

    def session(conf=None, held=None, master="local[2]"):
        made = []
        option = SimpleNamespace(isDefined=lambda: held is not None, get=lambda: held)
        sc = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: option)), master=master,
                             applicationId=f"app-{conf}-{held}-{master}", setCheckpointDir=made.append)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf), sparkContext=sc)

    assert checkpoint_dir(session("hdfs://x/c")) == "hdfs://x/c"
    assert checkpoint_dir(session(held="hdfs://x/held", master="yarn")) == "hdfs://x/held"
    assert checkpoint_dir(session()).startswith("/")
    import pytest
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            checkpoint_dir(session(master=master))


def test_model_boxes_and_weights(spark):
    from ridepulse.sources.markets import CITY_BOXES, CITY_WEIGHTS, city_boxes
    assert [b[0] for b in CITY_BOXES] == [c for c, _ in CITY_WEIGHTS] == list(range(1, 58))
    assert all(b[1] < b[2] and b[3] < b[4] for b in CITY_BOXES)
    pts = spark.createDataFrame([(40.7, -74.0), (47.6, -122.3), (0.0, 0.0)], "pickup_latitude double, pickup_longitude double")
    assert {r.located_city_id for r in G.locate_city(pts, city_boxes(spark)).collect()} == {1, 54, None}


def test_sums_beyond_a_long_are_exact_and_order_free(spark):
    from ridepulse.functions.numeric import avg2, exact_sum, sum2, sum_again, value
    big = 8_000_000_000_000.25
    df = spark.createDataFrame([(i % 3, big, -0.01) for i in range(9)] + [(7, None, None)], "k int, x double, y double")
    for parts in (1, 4, 9):
        r = df.repartition(parts).agg(sum2("x").alias("s"), avg2("x").alias("a"), sum2("y").alias("y")).first()
        assert r.s == 72_000_000_000_002.25 and r.a == big and r.y == -0.09
        two = df.repartition(parts).groupBy("k").agg(exact_sum("x").alias("h"), exact_sum("y").alias("l")) \
            .agg(value(sum_again("h")).alias("s"), value(sum_again("l")).alias("y")).first()
        assert two.s == r.s and two.y == r.y
    assert df.where("k = 7").agg(sum2("x").alias("s")).first().s is None
