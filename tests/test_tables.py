"""Row ids, the result table and the clustered outlines."""

from conftest import SMALL
from pyspark.sql import functions as F

from placehull.plans import queries as q
from placehull.sources import resulttable, spatial
from placehull.sources.poi import read_poi_csv


def test_row_ids_do_not_depend_on_the_splits(spark, tmp_path):
    path = str(tmp_path / "csv")
    rows = spark.range(30_000).select(F.concat(F.lit("place, "), "id").alias("name"), (F.col("id") / 7).alias("lng"), F.lit(1.5).alias("lat"))
    rows.repartitionByRange(3, "lng").sortWithinPartitions("lng").write.csv(path, header=True)
    found = []
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size, cost in ((40_000, 0), (300_000, 1 << 20), (1 << 27, 0)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", cost)
            found.append({r.poi_id: r.name for r in read_poi_csv(spark, path).collect()})
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert found[0] == found[1] == found[2]
    assert found[0] == {i: f"place, {i}" for i in range(30_000)}


def test_row_ids_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "name string, lng double, lat double").write.csv(str(tmp_path / "e"), header=True)
    assert read_poi_csv(spark, str(tmp_path / "e"), header=["name", "lng", "lat"]).count() == 0


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.range(1000).select(F.col("id").alias("poi_id"), F.when(F.col("id") < 500, "Matched").alias("status"), F.lit("a").alias("uid_name"))
    resulttable.create(rows, path, buckets=32)
    files = lambda: {str(p.relative_to(path)) for p in (tmp_path / "table").rglob("*.parquet")}
    before = files()
    changes = spark.createDataFrame([(700, "No Uid", "b"), (3, None, "c"), (5000, "Matched", "d")], "poi_id long, status string, uid_name string")
    touched = resulttable.upsert(changes, path, buckets=32)
    gone = {f.split("/")[0] for f in before - files()}
    assert 1 <= len(touched) <= 3 and gone == {f"bucket={b}" for b in touched}
    after = {r.poi_id: (r.status, r.uid_name) for r in resulttable.read(spark, path).collect()}
    want = {i: ("Matched" if i < 500 else None, "a") for i in range(1000)} | {700: ("No Uid", "b"), 3: (None, "c"), 5000: ("Matched", "d")}
    assert after == want
    assert resulttable.upsert(changes.limit(0), path, buckets=32) == []
    still = {r.poi_id for r in resulttable.still_open(rows.select("poi_id"), resulttable.read(spark, path)).collect()}
    assert still == {i for i in range(1000) if want[i][0] is None}


def test_curve_keeps_bits_in_order(spark):
    points = [(0.0, 0.0), (-180.0, -90.0), (179.9999, 89.9999), (116.3, 39.9), (200.0, 100.0)]
    rows = spark.createDataFrame(points, "lng double, lat double").select("lng", "lat", spatial.curve_place(F.col("lng"), F.col("lat")).alias("z")).collect()
    for r in rows:
        x, y = (min(max(int((v - low) / width * 65536), 0), 65535) for v, low, width in ((r.lng, -180, 360), (r.lat, -90, 180)))
        assert r.z == sum(((x >> k & 1) << 2 * k) | ((y >> k & 1) << 2 * k + 1) for k in range(16))


def test_box_query_skips_row_groups(spark, tmp_path):
    path = str(tmp_path / "rings")
    rings = q._rounded_rings(spark, SMALL).withColumnRenamed("ring", "geometry")
    # a grid of copies, so that there are many row groups
    shifts = spark.range(64).select((F.col("id") % 8).alias("dx"), F.floor(F.col("id") / 8).alias("dy"))
    moved = rings.limit(500).crossJoin(F.broadcast(shifts)).select(
        "poi_id", "uid", F.transform("geometry", lambda v: F.struct((v["lng"] + F.col("dx")).alias("lng"), (v["lat"] + F.col("dy")).alias("lat"))).alias("geometry")
    )
    spatial.write_outlines(moved, path, row_group=1 << 16)
    box = (118.0, 41.0, 118.9, 41.9)
    found = spatial.outlines_in_box(spark, path, *box)
    everything = spatial.with_box(moved)
    want = everything.where((F.col("min_lng") <= box[2]) & (F.col("max_lng") >= box[0]) & (F.col("min_lat") <= box[3]) & (F.col("max_lat") >= box[1]))
    assert sorted((r.uid, r.min_lng) for r in found.collect()) == sorted((r.uid, r.min_lng) for r in want.collect()) != []
    plan = found._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().apply(0)
    assert all(c in scan.metadata().get("PushedFilters").get() for c in spatial.BOX)
    assert scan.metrics().get("numOutputRows").get().value() < 0.5 * moved.count()  # of the rows, few were read
