import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from placehull.functions.text import name_similarity
from placehull.operators.ordered import hot_groups, row_numbers, running_totals
from placehull.operators.ranking import best_per_poi, candidate_lists, score_aois
from placehull.options import MatchOptions

AOI = "poi_id bigint, uid string, search_rank int, area_km2 double, distance_m double, similarity double"


def test_documented_mean_ranks(spark):
    # ranks 1,2,3 / 2,3,1 / 3,1,2 / 3,2,1 give means 9/4, 8/4, 7/4: the third wins
    rows = [(1, "a", 1, 2.0, 30.0, 0.1), (1, "b", 2, 3.0, 10.0, 0.5), (1, "c", 3, 1.0, 20.0, 0.9)]
    scored = score_aois(spark.createDataFrame(rows, AOI), MatchOptions(sort_by_area=1))
    assert {r.uid: r.score for r in scored.collect()} == {"a": 1.25, "b": 1.0, "c": 0.75}
    assert best_per_poi(scored).first().uid == "c"


def test_area_sign_only_turns_the_order(spark):
    rows = [(1, c, i, a, 0.0, 0.0) for i, (c, a) in enumerate([("a", 1.0), ("b", 2.0), ("c", 3.0)])]
    df = spark.createDataFrame(rows, AOI)
    only = dict(sort_by_search_rank=0, sort_by_distance=0, sort_by_similarity=0)
    assert best_per_poi(score_aois(df, MatchOptions(sort_by_area=1, **only))).first().uid == "a"
    assert best_per_poi(score_aois(df, MatchOptions(sort_by_area=-1, **only))).first().uid == "c"


def test_ties_go_to_search_rank_then_uid(spark):
    rows = [(1, "z", 2, 1.0, 0.0, 0.5), (1, "y", 1, 1.0, 0.0, 0.5), (1, "x", 2, 1.0, 0.0, 0.5)]
    scored = score_aois(spark.createDataFrame(rows, AOI), MatchOptions())
    ranks = {r.uid: r.rank_distance for r in scored.collect()}
    assert ranks == {"y": 0, "x": 1, "z": 2}


def skewed(spark, n=3000):
    rng = random.Random(3)
    rows = [
        (7 if rng.random() < 0.6 else rng.randrange(40), f"u{i}", i,
         rng.choice([0.5, 1.0, 2.0]), float(rng.randrange(20)), rng.random())
        for i in range(n)
    ]
    return spark.createDataFrame(rows, AOI)


def test_hot_groups_rank_like_small_ones(spark):
    df = skewed(spark)
    options = MatchOptions(sort_by_area=-1)
    assert [r.poi_id for r in hot_groups(df, ["poi_id"], 200).collect()] == [7]
    assert hot_groups(df, ["poi_id"]) is None
    plain = sorted(score_aois(df, options).collect())
    split = sorted(score_aois(df, options, hot_rows=50).collect())
    assert plain == split


def test_row_numbers_are_a_permutation(spark):
    rows = row_numbers(skewed(spark), ["poi_id"], {"n": [F.col("distance_m"), F.col("uid")]}, 100).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.poi_id, []).append(r.n)
    assert all(sorted(g) == list(range(1, len(g) + 1)) for g in groups.values())
    assert len(rows) == 3000


def test_running_totals_match_a_plain_scan(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(5), i, rng.randrange(3)) for i in range(2000)]
    df = spark.createDataFrame(rows, "ts int, id int, v int").repartition(7)
    got = running_totals(df, ["ts", "id"], {"s": F.col("v").cast("long")}, part_rows=100).collect()
    want, total = {}, 0
    for ts, i, v in sorted(rows):
        total += v
        want[ts, i] = total
    assert {(r.ts, r.id): r.s for r in got} == want
    assert len({r["__bucket"] for r in got}) > 5


def test_list_pages_keep_every_item(spark):
    df = skewed(spark, 500)
    pages = candidate_lists(df, ["uid"], page_size=50, hot_rows=60).collect()
    seen = [(p.poi_id, a.uid) for p in pages for a in p.aois]
    assert len(seen) == len(set(seen)) == 500
    assert max(len(p.aois) for p in pages) <= 50
    for p in pages:
        assert [a.position for a in p.aois] == sorted(a.position for a in p.aois)


def test_similarity_is_difflib(spark):
    rng = random.Random(2)
    alphabet = "望京西园一二三区里楼号院abc ()"
    names = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 12))) for _ in range(80)]
    names += ["", "x" * 250 + "y", "ab" * 150, "望京西园(一区)", "望京西园一区"]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(300)] + [("ab" * 150, "x" * 250 + "y")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.withColumn("s", name_similarity(F.col("a"), F.col("b"))).collect():
        assert abs(r.s - SequenceMatcher(None, r.a, r.b).ratio()) < 1e-12
    golden = spark.createDataFrame(
        [("望京西园(一区)", "望京西园一区"), ("月华轩小区", "北太平庄路2号院"), (None, "a")], "a string, b string"
    )
    got = [r[0] for r in golden.select(name_similarity(F.col("a"), F.col("b"))).collect()]
    assert round(got[0], 4) == 0.8571 and got[1] == 0.0 and got[2] is None


def test_a_small_limit_makes_no_more_parts_than_a_shuffle(spark, monkeypatch):
    from placehull.operators import ordered

    rows = [(k % 300, f"u{k}", k, 1.0, 0.0, 0.5) for k in range(900)]
    df = spark.createDataFrame(rows, AOI)
    used, number = [], ordered._number_hot
    monkeypatch.setattr(ordered, "_number_hot", lambda *a: used.append(a[-1]) or number(*a))
    found = row_numbers(df, ["poi_id"], {"n": [F.col("uid")]}, 2)
    whole = row_numbers(df, ["poi_id"], {"n": [F.col("uid")]})
    assert sorted(found.collect()) == sorted(whole.collect())
    assert used == [int(spark.conf.get("spark.sql.shuffle.partitions"))]
