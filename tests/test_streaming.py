"""Batch = stream: rides pushed as JSON event files through the streaming pipeline
give the same star schema as the batch build; replays and restarts change nothing."""

import glob
import json
import os
import shutil
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ridepulse import session
from ridepulse.llm.common import written
from ridepulse.operators import forecast as FC
from ridepulse.operators import quality as G
from ridepulse.operators import scd as SCD
from ridepulse.plans import catalog, lakehouse
from ridepulse.plans.lakehouse import Lakehouse
from ridepulse.sources.binding import maps_from_tables, rides_from_tables
from ridepulse.functions.dates import by_month
from ridepulse.schemas import RIDE_COLUMNS, RIDES
from ridepulse.sources.events import bulk_source, publish_rides_files, raw_event_files, ride_events
from ridepulse.sources.lake import Lake
from ridepulse.streaming import dimensions, flows, windows
from tests.conftest import SF_SMALL, ride, rides_df, small_maps

TABLES = ["fact", "dim_passenger", "dim_driver", "dim_vehicle", "dim_payment", "dim_booking",
          "dim_location"]


def _same(a, b):
    cols = sorted(b.columns)
    a, b = a.select(*cols), b.select(*cols)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _write_events(spark, rides, path, chunks):
    ev = ride_events(rides)
    digit = F.col("key").cast("long") % chunks
    for i in range(chunks):
        ev.where(digit == i).select("value").coalesce(1).write.text(f"{path}/part{i}")


@pytest.mark.parametrize("chunks", [1, 3])
def test_stream_equals_batch(spark, tmpdir_fresh, chunks):
    rides = rides_from_tables(spark, SF_SMALL)
    _write_events(spark, rides, f"{tmpdir_fresh}/events", chunks)
    lake = Lake(spark, f"{tmpdir_fresh}/lake")
    maps, seen = maps_from_tables(spark, SF_SMALL), {}
    star = flows.run_update(spark, lake, maps, raw_event_files(spark, f"{tmpdir_fresh}/events/*", 1), quality=seen)
    lh = Lakehouse(spark, [rides], maps)
    for t in TABLES:
        assert _same(getattr(star, t), getattr(lh.star, t)), t
    # G rules are counted inside the update: the same numbers as a scan
    want = {r.rule: (r.checked, r.violations) for f in (G.fare_audit, G.time_order_check, G.status_check) for r in f(lh.obt).collect()}
    assert {k: v for k, v in seen.items() if k != "has_ride_id"} == want and seen["has_ride_id"] == (rides.count(), 0)
    # a second update (restart from the checkpoints, nothing new) changes nothing
    again: dict = {}
    star = flows.run_update(spark, lake, maps, raw_event_files(spark, f"{tmpdir_fresh}/events/*"), quality=again)
    assert _same(star.fact, lh.star.fact) and not any(c for c, _ in again.values())


def test_batch_update_sorts_repeated_rides_only(spark, tmpdir_fresh):
    """Without repeated ids the written rides are not shuffled by id again; with some, one row each stays, the smallest."""
    rows = [ride(ride_id=f"r{i}", driver_id=f"d{i}") for i in range(20)]
    odd = [ride(ride_id="r3", driver_id="a"), ride(ride_id="r3", driver_id="d3"), ride(ride_id=None), ride(ride_id=None)]
    for name, given, repeated in (("once", rows, 0), ("twice", rows + odd, 1)):
        lake = Lake(spark, f"{tmpdir_fresh}/{name}")
        lh = Lakehouse(spark, [rides_df(spark, given)], small_maps(spark)).materialize(lake)
        assert lake.read("silver", "repeated_ids").count() == repeated
        assert lake.exists(lake.path("silver", "stg_rides_unique")) == bool(repeated)
        want = Lakehouse(spark, [rides_df(spark, given)], small_maps(spark))
        for t in ("stg", "obt"):
            assert _same(getattr(lh, t).drop("booking_month"), getattr(want, t)), (name, t)
        assert lh.obt.count() == len(rows) + 2 * repeated
    assert [r.driver_id for r in lh.stg.where("ride_id = 'r3'").collect()] == ["a"]


def test_months_are_shuffled_without_the_lookups(spark, tmpdir_fresh, monkeypatch):
    """Only ride columns are dealt by month, in batch; the lookups' columns come behind the shuffle."""
    from ridepulse.plans import lakehouse
    dealt = []
    monkeypatch.setattr(lakehouse, "by_month", lambda df: dealt.append(df.columns) or by_month(df))
    lh = Lakehouse(spark, [rides_df(spark, [ride()])], small_maps(spark)).materialize(Lake(spark, f"{tmpdir_fresh}/lake"))
    assert dealt == [RIDE_COLUMNS] and lh.obt.columns[-1] == "booking_month"


def test_published_events_are_compressed_in_bounded_files(spark, tmpdir_fresh):
    rides = rides_df(spark, [ride(ride_id=f"r{i}") for i in range(25)]).coalesce(1)
    publish_rides_files(rides, f"{tmpdir_fresh}/events", rows_per_file=10)
    assert len(glob.glob(f"{tmpdir_fresh}/events/*.txt.gz")) == 3
    lines = spark.read.text(f"{tmpdir_fresh}/events").withColumnRenamed("value", "rides")
    assert _same(flows.parsed_events(lines), rides)


def test_archived_events_may_go_before_silver_and_gold(spark, tmpdir_fresh):
    """An update needs its events until they are in the archive; the next one goes on without them."""
    rides = [ride(ride_id=str(i), driver_id=f"d{i % 7}", booking_timestamp=datetime(2024, 1 + i % 3, 1)) for i in range(60)]
    lake = Lake(spark, f"{tmpdir_fresh}/lake")
    for number, part in enumerate([rides[:40], rides[30:]]):
        publish_rides_files(rides_df(spark, part), f"{lake.root}/events/{number}")
        star = flows.run_update(spark, lake, small_maps(spark), raw_event_files(spark, f"{lake.root}/events/*"),
                                archived=lambda: lake.remove(f"{lake.root}/events/{number}"))
        assert not lake.exists(f"{lake.root}/events/{number}")
    assert lake.read(*flows.ARCHIVE, RIDES).count() == 70
    assert _same(star.fact.select("ride_id"), rides_df(spark, rides).select("ride_id")) and star.dim_driver.count() == 7


def _shuffle_files(spark):
    """The shuffle files that the session's application holds on this machine."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(len(glob.glob(f"{d}/*/shuffle_*.data")) for d in (f.getPath() for f in folders))


def test_builds_and_updates_drop_their_shuffle_files(spark, tmpdir_fresh):
    """Tables and streams of an update leave no shuffle file behind, and the session keeps its own setting."""
    lake, setting = Lake(spark, f"{tmpdir_fresh}/lake"), spark.conf.get(session._FREED, None)
    rides = [ride(ride_id=str(i), driver_id=f"d{i % 7}") for i in range(40)]
    publish_rides_files(rides_df(spark, rides), f"{lake.root}/events/0")

    def left(run):
        before = _shuffle_files(spark)
        run()
        for _ in range(100):  # files go in the background
            if _shuffle_files(spark) <= before:
                return 0
            time.sleep(0.1)
        return _shuffle_files(spark) - before

    counted = rides_df(spark, rides).repartition(3, "ride_id").groupBy("driver_id").count()
    assert left(lambda: lake.write_overwrite(counted, "gold", "t")) == 0 and lake.read("gold", "t").count() == 7
    assert left(lambda: written(counted, "t")) == 0
    assert left(lambda: flows.run_update(spark, lake, small_maps(spark), raw_event_files(spark, f"{lake.root}/events/*"))) == 0
    assert spark.conf.get(session._FREED, None) == setting


def test_silver_takes_bronze_in_bounded_batches(spark, tmpdir_fresh, monkeypatch):
    """Rows and rule counts of an update are whole, however many batches it takes."""
    rides = [ride(ride_id=str(i % 50), driver_id=f"d{i % 7}", booking_timestamp=datetime(2024, 1 + i % 50 % 3, 1)) for i in range(60)]
    lake, quality, kept = Lake(spark, f"{tmpdir_fresh}/lake"), {}, "spark.sql.streaming.numRecentProgressUpdates"
    publish_rides_files(rides_df(spark, rides).coalesce(1), f"{lake.root}/events/0", rows_per_file=20)
    monkeypatch.setattr(flows, "BATCH_BYTES", 1)
    spark.conf.set(kept, "1")
    try:
        star = flows.run_update(spark, lake, small_maps(spark), raw_event_files(spark, f"{lake.root}/events/*", 1), quality=quality)
        assert spark.conf.get(kept) == "1"
    finally:
        spark.conf.unset(kept)
    assert len(glob.glob(f"{flows.checkpoint(lake, 'silver')}/commits/[0-9]*")) == 3
    assert lake.read(*flows.ARCHIVE, RIDES).count() == 60 and quality["has_ride_id"] == (50, 0)
    assert _same(star.fact.select("ride_id"), rides_df(spark, rides).select("ride_id").distinct()) and star.dim_driver.count() == 7


def test_flows_keep_state_on_disk_in_a_bounded_number_of_stores(spark, tmpdir_fresh, monkeypatch):
    """Keys are held by RocksDB, in no more stores than a batch has use for; the session keeps its own settings."""
    lake, names = Lake(spark, f"{tmpdir_fresh}/lake"), [*dimensions.STATE, flows.SHUFFLE_PARTITIONS]
    before = {k: spark.conf.get(k, None) for k in names}
    monkeypatch.setattr(flows, "BATCH_PARTITIONS", 3)
    for number, ids in enumerate([range(40), range(30, 50)]):
        publish_rides_files(rides_df(spark, [ride(ride_id=str(i), driver_id=f"d{i % 7}") for i in ids]), f"{tmpdir_fresh}/events/{number}")
        star = flows.run_update(spark, lake, small_maps(spark), raw_event_files(spark, f"{tmpdir_fresh}/events/*"))
    assert star.fact.count() == 50 and star.dim_driver.count() == 7
    for flow in ("silver", "dim_driver", "dim_location"):
        stores = [d for d in glob.glob(f"{flows.checkpoint(lake, flow)}/state/0/[0-9]*")]
        assert len(stores) == 3 and any(glob.glob(f"{d}/*.changelog") for d in stores), flow
    assert {k: spark.conf.get(k, None) for k in names} == before


def test_streams_start_from_rides_that_a_full_build_goes_on_from(spark, tmpdir_fresh, monkeypatch):
    monkeypatch.setattr(lakehouse, "_MEMO", {})
    monkeypatch.setattr(lakehouse, "checkpoint_dir", lambda spark: tmpdir_fresh)
    tables = lambda: sorted(os.path.basename(p) for p in glob.glob(f"{tmpdir_fresh}/ridepulse-lake/*/*/*/*"))
    rides = lakehouse.staged(spark, SF_SMALL)
    assert tables() == ["repeated_ids", "stg_rides"] and lakehouse.staged(spark, SF_SMALL) is rides
    full = lakehouse.materialized(spark, SF_SMALL)
    assert tables().count("stg_rides") == 1 and {"silver_obt", "fact"} <= set(tables())
    want = rides_from_tables(spark, SF_SMALL)
    assert _same(rides.stg, want) and _same(full.stg, want) and full.star.fact.count() == full.obt.count() == want.count()
    built = tables()
    monkeypatch.setattr(lakehouse, "_MEMO", {})  # another session
    assert _same(lakehouse.staged(spark, SF_SMALL).stg, want) and _same(lakehouse.materialized(spark, SF_SMALL).stg, want)
    assert lakehouse.staged(spark, SF_SMALL) is lakehouse.materialized(spark, SF_SMALL) and tables() == built
    assert lakehouse.materialized(spark, SF_SMALL, reuse=False).stg.count() == want.count() and tables().count("stg_rides") == 2


def test_streamed_queries_keep_no_events(spark, monkeypatch):
    gone = []
    monkeypatch.setattr(catalog, "_UPDATES", {})
    monkeypatch.setattr(Lake, "remove", lambda self, path, remove=Lake.remove: (gone.append(path), remove(self, path)))
    out, _ = catalog.streamed(spark, SF_SMALL)
    assert gone == [f"{out.root}/events/0", f"{out.root}/events/1"] and not any(map(out.exists, gone))


def test_batch_update_counts_the_rules_on_the_way(spark, tmpdir_fresh):
    lh = Lakehouse.from_tables(spark, SF_SMALL).materialize(Lake(spark, f"{tmpdir_fresh}/lake"))
    want = {r.rule: (r.checked, r.violations) for f in (G.fare_audit, G.time_order_check, G.status_check) for r in f(lh.obt).collect()}
    assert lh.quality == want


def _events(tmp, name, rides):
    d = os.path.join(tmp, name)
    os.makedirs(d, exist_ok=True)
    if rides:
        with open(os.path.join(d, f"{len(os.listdir(d)):03d}.txt"), "w") as f:
            f.write("\n".join(json.dumps(r) for r in rides) + "\n")
    return d


def _ride(i, at="2024-01-01T00:00:00", **kw):
    return {"ride_id": i, "pickup_city_id": 1, "passenger_id": "p", "booking_timestamp": at, "total_fare": 1.0, **kw}


@pytest.mark.parametrize("triggers", [1, 3, 10])
def test_dedup_is_exact_over_all_months(spark, tmpdir_fresh, triggers):
    """A copy with another or no booking time is dropped, however many triggers lie between the two."""
    files = [[_ride(f"r{i}") for i in range(6)], [_ride(f"r{i}", "2019-07-01T00:00:00") for i in range(3)],
             [_ride("r4", None), _ride("r5", "garbage"), _ride("new", "2024-03-01T00:00:00")]]
    files += [[_ride("r0", f"2024-0{m}-01T00:00:00"), _ride(f"m{m}", f"2024-0{m}-01T00:00:00")] for m in range(1, 8)]
    per_trigger = -(-len(files) // triggers)
    lake, rides = Lake(spark, f"{tmpdir_fresh}/lake"), None
    for i in range(0, len(files), per_trigger):
        rides = _events(tmpdir_fresh, "ev", [r for f in files[i:i + per_trigger] for r in f])
    flows.archive_flow(raw_event_files(spark, rides, 1), lake).awaitTermination()
    flows.silver_flow(spark, lake, small_maps(spark), max_files_per_trigger=1).awaitTermination()
    got = {r.ride_id: r for r in flows.read_obt(lake).collect()}
    assert sorted(got) == sorted([f"r{i}" for i in range(6)] + ["new"] + [f"m{m}" for m in range(1, 8)])
    assert flows.read_obt(lake).count() == len(got)
    if triggers == 10:  # the first to come stays
        assert all(got[f"r{i}"].booking_timestamp == datetime(2024, 1, 1) for i in range(6))


def test_watermark_on_stateless_enrichment_drops_nothing(spark, tmpdir_fresh):
    """A 3-minute event-time watermark before the stateless lookups keeps
    late (30-day-old) rides; only stateful steps would drop them."""
    from ridepulse.operators.silver import build_obt, with_event_time
    from ridepulse.sources.events import RAW_RIDES
    d = os.path.join(tmpdir_fresh, "in")
    os.makedirs(d)
    now = datetime(2024, 2, 1, 12)
    for i, age in enumerate([timedelta(0), timedelta(days=30), timedelta(minutes=1)]):
        with open(os.path.join(d, f"f{i}.json"), "w") as f:
            f.write(json.dumps({"ride_id": f"r{i}", "pickup_city_id": 1,
                                "booking_timestamp": (now - age).isoformat()}) + "\n")
    stream = spark.readStream.schema(RAW_RIDES).option("maxFilesPerTrigger", 1).json(d)
    stream = stream.withColumn("booking_timestamp", F.col("booking_timestamp").cast("timestamp"))
    obt = build_obt(with_event_time(stream, "3 minutes"), small_maps(spark))
    q = (obt.writeStream.format("memory").queryName("wm_obt").trigger(availableNow=True)
         .option("checkpointLocation", os.path.join(tmpdir_fresh, "ck")).start())
    q.awaitTermination()
    assert sorted(r.ride_id for r in spark.table("wm_obt").collect()) == ["r0", "r1", "r2"]


def test_windows_close_late_rides_are_counted_and_the_last_equals_batch(spark, tmpdir_fresh):
    """T7 with A9 / A10: the closed window that ends at ``as_of`` is the batch forecast's row."""
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(minutes=17 * i), 1 + i % 2, 1.0 + i % 4 / 4, 1 + i % 3) for i in range(60)]
    late = [(start + timedelta(hours=1), 1, 9.0, 2)]
    last = [(start + timedelta(hours=30), 1, 1.0, 1)]
    schema = "booking_timestamp timestamp, pickup_city_id long, surge_multiplier double, ride_status_id long"
    for part in (rows[:30], rows[30:], last, late):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmpdir_fresh}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmpdir_fresh}/in")
    got, late_seen = {}, []
    for name, make in (("demand", windows.demand_windows), ("pressure", windows.pressure_windows)):
        q = make(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmpdir_fresh}/{name}-ck") \
            .trigger(availableNow=True).start(f"{tmpdir_fresh}/{name}")
        q.awaitTermination()
        late_seen.append(windows.late_rows(q))
        got[name] = {(r.as_of, r.pickup_city_id): r for r in spark.read.parquet(f"{tmpdir_fresh}/{name}").collect()}
    assert late_seen == [6, 6]  # one ride, six windows, all closed
    cities = spark.createDataFrame([(1, "One"), (2, "Two")], "city_id long, city string")
    obt = spark.createDataFrame(rows + last, schema)
    for as_of in (start + timedelta(hours=6), start + timedelta(hours=17)):
        for r in FC.predict_demand_all_cities(obt, cities, 1, as_of).collect():
            w = got["demand"][as_of, r.city_id]
            assert all(w[c] == r[c] for c in ("rides_last_6h", "avg_rides_per_hour", "avg_surge_last_6h", "predicted_rides", "confidence"))
        for r in FC.predict_pressure_all_cities(obt, cities, as_of).collect():
            w = got["pressure"][as_of, r.city_id]
            assert all(w[c] == r[c] for c in ("peak_surge_last_6h", "cancellation_rate_last_6h", "pressure_score", "pressure_band"))
    assert max(a for a, _ in got["demand"]) <= start + timedelta(hours=30)  # later windows are still open


def test_run_update_with_bulk_stream(spark, tmpdir_fresh):
    """S5 through the pipeline: bulk files + live events overlapping on one ride."""
    bulk_dir = os.path.join(tmpdir_fresh, "bulk")
    os.makedirs(bulk_dir)
    with open(os.path.join(bulk_dir, "b.json"), "w") as f:
        json.dump([_ride("a", total_fare=10.0), _ride("b", "2024-01-01T01:00:00", pickup_city_id=2)], f)
    events = _events(tmpdir_fresh, "ev", [_ride("b", "2024-01-01T01:00:00", pickup_city_id=2)])
    lake = Lake(spark, os.path.join(tmpdir_fresh, "lake"))
    star = flows.run_update(spark, lake, small_maps(spark), raw_event_files(spark, events), bulk=bulk_source(spark, bulk_dir))
    assert sorted(r.ride_id for r in star.fact.collect()) == ["a", "b"]
    assert star.dim_passenger.count() == 1


def test_first_update_of_an_empty_topic(spark, tmpdir_fresh):
    lake = Lake(spark, f"{tmpdir_fresh}/lake")
    events = _events(tmpdir_fresh, "ev", [])
    star = flows.run_update(spark, lake, small_maps(spark), raw_event_files(spark, events))
    assert star.fact.count() == 0 and star.dim_driver.count() == 0 and star.dim_location.count() == 0
    _events(tmpdir_fresh, "ev", [_ride("a")])
    star = flows.run_update(spark, lake, small_maps(spark), raw_event_files(spark, events))
    assert star.fact.count() == 1 and star.dim_location.count() == 1


def test_source_added_later_and_rides_without_an_id(spark, tmpdir_fresh):
    """Bulk first, live events later; rides without an id all pass silver, gold leaves them out."""
    lake = Lake(spark, f"{tmpdir_fresh}/lake")
    bulk = os.path.join(tmpdir_fresh, "bulk")
    os.makedirs(bulk)
    with open(os.path.join(bulk, "b.json"), "w") as f:
        json.dump([_ride("a"), _ride("b", "2023-05-01T00:00:00")], f)
    maps, seen = small_maps(spark), {}
    assert flows.run_update(spark, lake, maps, None, bulk=bulk_source(spark, bulk)).fact.count() == 2
    events = _events(tmpdir_fresh, "ev", [_ride("b", "2023-05-01T00:00:00"), _ride("c"), _ride(None), _ride(None, total_fare=2.0)])
    star = flows.run_update(spark, lake, maps, raw_event_files(spark, events), bulk=bulk_source(spark, bulk), quality=seen)
    assert sorted(r.ride_id for r in star.fact.collect()) == ["a", "b", "c"]
    obt = flows.read_obt(lake)
    assert obt.where("ride_id IS NOT NULL").count() == 3 and obt.where("ride_id IS NULL").count() == 2
    assert seen["has_ride_id"] == (3, 2)  # rejects of the star are counted


def test_restart_in_the_middle(spark, tmpdir_fresh):
    """A batch whose rows were written but whose commit was lost comes again, and nothing is written twice."""
    maps, lake = small_maps(spark), Lake(spark, f"{tmpdir_fresh}/lake")
    events = _events(tmpdir_fresh, "ev", [_ride(f"r{i}", f"2024-0{1 + i % 3}-01T00:00:00") for i in range(9)])
    flows.run_update(spark, lake, maps, raw_event_files(spark, events))
    before = {t: flows.read_star(lake).__getattribute__(t).count() for t in TABLES}
    whole = f"{tmpdir_fresh}/lake/_checkpoints"
    shutil.copytree(whole, f"{tmpdir_fresh}/cut", ignore=lambda d, names: names if os.path.basename(d) == "commits" else [])
    real = flows.checkpoint
    flows.checkpoint = lambda lake, flow: f"{tmpdir_fresh}/cut/{flow}"
    try:
        star = flows.run_update(spark, lake, maps, raw_event_files(spark, events))
        _events(tmpdir_fresh, "ev", [_ride("r0"), _ride("r99")])
        more = flows.run_update(spark, lake, maps, raw_event_files(spark, events))
    finally:
        flows.checkpoint = real
    assert {t: star.__getattribute__(t).count() for t in TABLES} == before
    assert more.fact.count() == before["fact"] + 1


def test_literal_append_keeps_copies_in_silver_only(spark, tmpdir_fresh):
    lake = Lake(spark, f"{tmpdir_fresh}/lake")
    events = _events(tmpdir_fresh, "ev", [_ride("a"), _ride("b")])
    star = flows.run_update(spark, lake, small_maps(spark), raw_event_files(spark, events), dedup=False)
    assert flows.read_obt(lake).count() == 4  # live and archive
    assert star.fact.count() == 2


def _feed(spark, tmp, schema, parts, start):
    """Each part is a file and a trigger; the query restarts from its checkpoint after every part but the first."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp}/in")
        if i:
            start(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in")).awaitTermination()


def test_scd1_on_a_stream_replaces_changed_keys_only(spark, tmpdir_fresh):
    """Late and tied rows, rows without key or sequence, an untouched partition; RocksDB state."""
    old = {k: spark.conf.get(k, None) for k in dimensions.STATE}
    for k, v in dimensions.STATE.items():
        spark.conf.set(k, v)
    schema = "k string, s timestamp, v string"
    at = lambda d: datetime(2024, 1, d)
    parts = [[(f"k{i}", at(2), "b") for i in range(40)] + [(None, at(9), "x")],
             [("k3", at(3), "c"), ("k3", at(3), None), ("k4", at(1), "old"), ("k5", at(2), "a"), ("k6", None, "none"), ("n", None, "q")],
             [("k3", at(3), "c"), ("n", None, "p"), ("z", at(1), "z")]]
    lake = Lake(spark, f"{tmpdir_fresh}/lake")
    rows = spark.createDataFrame([r for p in parts for r in p], schema)
    put = dimensions.replace_keys(lake, "gold", "t", ["k"], rows.schema, buckets=16, files=2)
    try:
        _feed(spark, tmpdir_fresh, schema, parts, lambda stream: dimensions.latest(stream, ["k"], "s").writeStream.outputMode("update")
              .foreachBatch(put).option("checkpointLocation", f"{tmpdir_fresh}/ck").trigger(availableNow=True).start())
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    got = lake.read("gold", "t").drop(dimensions.BUCKET)
    assert _same(got, SCD.scd1(None, rows, ["k"], "s"))
    assert {r.k: r.v for r in got.collect()}["k3"] is None and got.count() == 42


def test_scd1_batch_that_comes_again_writes_the_same(spark, tmpdir_fresh):
    lake = Lake(spark, f"{tmpdir_fresh}/lake")
    schema = spark.createDataFrame([("a", 1)], "k string, v int").schema
    put = dimensions.replace_keys(lake, "gold", "t", ["k"], schema, buckets=2)
    put(spark.createDataFrame([(f"k{i}", 1) for i in range(9)], schema), 0)
    for _ in range(2):
        put(spark.createDataFrame([("k1", 2), ("new", 3)], schema), 1)
    put(spark.createDataFrame([], schema), 2)
    assert {r.k: r.v for r in lake.read("gold", "t").collect()} == {**{f"k{i}": 1 for i in range(9)}, "k1": 2, "new": 3}


def test_scd1_rewrites_only_the_batch_s_partitions(spark, tmpdir_fresh):
    lake = Lake(spark, f"{tmpdir_fresh}/lake")
    df = spark.createDataFrame([(f"k{i}", 1) for i in range(50)], "k string, v int")
    put = dimensions.replace_keys(lake, "gold", "t", ["k"], df.schema, buckets=8, files=3)
    put(df, 0)
    before = set(glob.glob(f"{tmpdir_fresh}/lake/gold/t/key_bucket=*/part-*"))
    assert len(before) > 16  # a partition is written by several tasks
    put(spark.createDataFrame([("k7", 2)], df.schema), 1)
    gone = {os.path.dirname(f) for f in before - set(glob.glob(f"{tmpdir_fresh}/lake/gold/t/key_bucket=*/part-*"))}
    assert len(gone) == 1 and lake.read("gold", "t").where("v = 2").count() == 1 and lake.read("gold", "t").count() == 50


def test_scd1_needs_an_ordered_sequence(spark):
    with pytest.raises(TypeError, match="cannot order"):
        dimensions.latest(spark.createDataFrame([("a", "x")], "k string, s string"), ["k"], "s")


def test_scd2_on_a_stream_takes_late_versions_and_replays(spark, tmpdir_fresh):
    schema = "id int, ts timestamp, name string"
    parts = [[(1, datetime(2024, 1, 5), "new"), (2, datetime(2024, 1, 1), "x"), (None, datetime(2024, 1, 1), "no"), (3, None, "no")],
             [(1, datetime(2024, 1, 1), "old"), (1, datetime(2024, 1, 5), "new")], [(1, datetime(2024, 1, 5), "new"), (2, datetime(2024, 2, 1), "y")]]
    keys = ["id", "ts"]
    _feed(spark, tmpdir_fresh, schema, parts, lambda stream: dimensions.first_seen(stream, keys).writeStream.format("parquet")
          .option("checkpointLocation", f"{tmpdir_fresh}/ck").trigger(availableNow=True).start(f"{tmpdir_fresh}/out"))
    got = SCD.with_end_at(spark.read.parquet(f"{tmpdir_fresh}/out"), ["id"], "ts")
    rows = spark.createDataFrame([r for p in parts for r in p], schema).where("id IS NOT NULL")
    assert _same(got, SCD.scd2(None, rows, ["id"], "ts")) and got.count() == 4


@pytest.mark.parametrize("salts", [1, 4])
def test_as_of_by_one_sort_equals_the_join(spark, salts):
    at = lambda d: datetime(2024, 1, d) if d else None
    dim = SCD.with_end_at(spark.createDataFrame([(k, at(d), f"{k}{d}") for k in (1, 2) for d in range(5, 25, 3)] + [(3, at(9), "only")],
                                                "id int, ts timestamp, name string"), ["id"], "ts").withColumnRenamed("id", "k")
    facts = spark.createDataFrame([(i, [1, 1, 1, 2, 3, 4, None][i % 7], at(i % 29)) for i in range(120)], "fact int, id int, at timestamp")
    facts = facts.unionAll(facts.limit(5))
    want = SCD.as_of_join(facts, dim, "id", "k", "at").select("fact", "id", "at", "k", "ts", "name", "__START_AT", "__END_AT")
    got = SCD.as_of_sorted(facts, dim, "id", "k", "at", salts=salts)
    assert _same(got, want) and got.count() == 125
    same_key = dim.withColumnRenamed("k", "id")
    assert _same(SCD.as_of_sorted(facts, same_key, "id", "id", "at", salts=salts), SCD.as_of_join(facts, same_key, "id", "id", "at"))


def test_streaming_star_queries_do_not_shuffle_rides(spark, tmpdir_fresh):
    from ridepulse.operators import curated as A
    from ridepulse.operators import shaping as P
    from ridepulse.operators import star as Q
    lake = Lake(spark, f"{tmpdir_fresh}/lake")
    events = _events(tmpdir_fresh, "ev", [_ride(f"r{i}", f"2024-0{1 + i % 5}-01T00:00:00", pickup_latitude=1.0, pickup_longitude=2.0)
                                          for i in range(20)])
    st = flows.run_update(spark, lake, small_maps(spark), raw_event_files(spark, events))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        density = P.pickup_density(st.fact_with_booking(["total_fare"], ["pickup_latitude", "pickup_longitude"]))
        for df in (Q.kpis(st), A.surge_patterns(st), A.demand_by_city(st, "New York"), A.kpi_dashboard(st), Q.pickup_locations(st), density):
            df.collect()
            plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
            assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        feed = Q.live_feed(st, 3)
        assert [r.booking_timestamp.month for r in feed.collect()] == [5, 5, 5]  # newest first without any broadcast
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_quality_checks_inside_foreach_batch(spark, tmpdir_fresh):
    from ridepulse.operators import silver as SV
    events = _events(tmpdir_fresh, "ev", [_ride("a", ride_status_id=2, cancellation_reason_id=4), _ride("b", duration_minutes=1)])
    got, maps = {}, small_maps(spark)

    def check(batch, number):
        obt = SV.build_obt(SV.conform(batch), maps)
        for summary in (G.fare_audit(obt), G.status_check(obt), G.time_order_check(obt), G.key_integrity(obt, maps)):
            for r in summary.collect():
                got[r.rule] = got.get(r.rule, 0) + r.violations
    (flows.parsed_events(raw_event_files(spark, events)).writeStream.foreachBatch(check).trigger(availableNow=True)
     .option("checkpointLocation", f"{tmpdir_fresh}/ck").start().awaitTermination())
    assert got["cancelled_has_reason_1_to_3"] == 1 and got["duration_at_least_4_min"] == 1
