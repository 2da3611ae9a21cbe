"""Views made of one grouped table, answers attached after the join, rings converted whole."""

from conftest import SMALL
from pyspark.sql import functions as F

from placehull.functions.rings import rings_wgs84, vertices_wgs84, with_ring_numbers
from placehull.operators.outlines import attach_answers, attach_boundaries, boundaries_once
from placehull.plans import derived
from placehull.sources.responses import decode_boundaries

RING = "4|1|1-12948000,4838000,12948100,4838000,12948100,4838100,12948000,4838000;"
VIEWS = ("search_result", "search_response", "boundary_response", "boundary_request")


def tables(spark, folder):
    nation = [(0, "CHINA"), (1, "PERU")]
    customer = [(1, "a", 0, "X"), (2, "b", 1, "Y"), (2, "c", 0, "Z"), (None, "d", 0, "X"), (50, "e", 1, "Y"), (6, "f", 7, "Y"), (7, None, 0, "X")]
    orders = [(10, 1), (11, 2), (12, None), (13, 50), (None, 1), (14, 7), (14, 1)]
    lines = [(o, n, 5 * n, n % 4, "R", 1.5, 2.0) for o in (10, 11, 12, 13, 14, None) for n in range(1, 10)] + [(10, 1, 5, 1, "R", 1.5, 2.0), (11, 2, None, 2, None, None, 1.0)]
    for name, rows, schema in (
        ("nation", nation, "n_nationkey int, n_name string"),
        ("customer", customer, "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string"),
        ("orders", orders, "o_orderkey bigint, o_custkey bigint"),
        ("lineitem", lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_returnflag string, l_extendedprice double, l_quantity double"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_views_of_groups_are_the_views(spark, tmp_path):
    folder = tables(spark, tmp_path)
    groups = derived.search_groups(spark, folder).cache()
    for name in VIEWS:
        old, new = derived.view(spark, folder, name), derived.from_groups(groups, name)
        assert old.schema == new.schema
        assert sorted(map(repr, old.collect())) == sorted(map(repr, new.collect())), name


def test_views_of_groups_shuffle_nothing(spark, tmp_path):
    folder = tables(spark, tmp_path)
    derived.search_groups(spark, folder).write.parquet(f"{folder}/groups")
    groups = spark.read.parquet(f"{folder}/groups")
    for name in VIEWS:
        plan = derived.from_groups(groups, name)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, name


def test_answers_after_the_join_are_those_before_it(spark):
    key = F.struct("poi_id", "uid").alias("aoi_key")
    accepted = spark.createDataFrame([(1, "u", 1, "n"), (1, "v", 2, "n"), (2, "u", 1, None), (3, "w", 1, "n")], "poi_id bigint, uid string, search_rank int, uid_name string")
    accepted = accepted.select(key, "*")
    rows = [(1, "u", RING), (1, "u", None), (1, "u", "4|bad"), (1, "v", None), (2, "u", RING), (2, "u", RING), (None, "u", RING), (9, "x", RING)]
    answers = spark.createDataFrame(rows, "poi_id bigint, uid string, geo string")
    body = F.to_json(F.struct(F.struct("geo").alias("content"))).alias("body")
    decoded = decode_boundaries(answers.select("poi_id", "uid", body))
    old = attach_boundaries(accepted, boundaries_once(decoded))
    new = attach_answers(accepted, decoded).select(*old.columns)
    assert sorted(map(repr, old.collect())) == sorted(map(repr, new.collect()))


def test_rings_of_repeated_keys_and_no_filter_on_the_decoding(spark):
    df = spark.createDataFrame([(1, RING), (2, RING), (2, RING), (3, None), (4, RING.replace("4838100", "-5"))], "k int, geo string")
    rings = {r.k: r.ring for r in rings_wgs84(df, ["k"]).collect()}
    assert set(rings) == {1, 2, 4} and rings[4] is None
    assert rings[2] == [v for v in rings[1] for _ in range(2)]
    rows = vertices_wgs84(with_ring_numbers(df), keep=["k"])
    assert [(r.lng, r.lat) for r in rows.where("k = 1").orderBy("pos").collect()] == [(v.lng, v.lat) for v in rings[1]]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "split" in line for line in plan.splitlines())


def test_one_shuffle_of_the_answers(spark, monkeypatch, tmp_path):
    """Outlines of the winners come from the staged candidates; a job without outlines stages none."""
    from placehull.plans import match
    from placehull.plans import queries as q

    staged, real = {}, match.stage

    def spy(df, name):
        staged[name] = df
        return real(df, name)

    monkeypatch.setattr(match, "stage", spy)
    rows = q.match_job(spark, SMALL).result()
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan and rows.where("geometry is not null").count() == rows.where("status = 'Matched'").count() > 0
    assert "geo" in staged["aois"].columns and "min_lng" not in staged["aois"].columns
    staged.clear()
    q.match_job(spark, SMALL).result(with_geometry=False)
    assert "geo" not in staged["aois"].columns


def test_views_of_keys_are_not_stored_nor_broadcast(spark):
    from placehull.plans import queries as q

    poi = q.view(spark, SMALL, "poi").select("poi_id", "name")
    plan = q.captured(spark, SMALL, "search_result").join(poi, "poi_id")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan.split("FileScan")[0]
    assert all("/groups" in f for f in q.captured(spark, SMALL, "boundary_response").inputFiles())
