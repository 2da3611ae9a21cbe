from pyspark.sql import functions as F

from conftest import SMALL
from placehull.operators.candidates import accept
from placehull.operators.outlines import aoi_metrics, attach_boundaries, boundaries_once
from placehull.operators.validity import judge_aois
from placehull.plans.derived import from_groups, search_groups, view
from placehull.plans.queries import NO_NAMES, _judged
from placehull.session import stage
from placehull.sources.responses import decode_boundaries
from placehull.streaming import completion as stream


def test_repeats_replays_and_order_give_the_batch_result(spark, tmp_path):
    """Empty answers first, good ones after them, everything once more: the result is the batch job's."""
    poi_ids = [1, 2, 4, 5, 6, 8]
    accepted = accept(_judged(spark, SMALL, NO_NAMES).where(F.col("poi_id").isin(poi_ids)), NO_NAMES)
    responses = view(spark, SMALL, "boundary_response").where(F.col("poi_id").isin(poi_ids))
    responses = responses.select("poi_id", "uid", "body")
    broken = responses.withColumn("body", F.lit('{"content":{}}'))
    boundaries = boundaries_once(decode_boundaries(responses))
    measured = judge_aois(aoi_metrics(attach_boundaries(accepted, boundaries), NO_NAMES), NO_NAMES)
    complete = measured.groupBy("poi_id").agg(F.every("called").alias("all")).where("all").select("poi_id")
    batch = stream.results(stage(measured.join(complete, "poi_id"), "batch"), NO_NAMES)
    want = {r.poi_id: (r.status, r.uid, r.score) for r in batch.collect()}
    assert any(s == "Matched" for s, _, _ in want.values())
    for run, parts in enumerate([(broken, responses, responses), (responses, broken)]):
        folder, source = f"{tmp_path}/{run}", f"{tmp_path}/in{run}"
        for part in parts:
            part.coalesce(1).write.mode("append").parquet(source)
            arriving = stream.read_responses(spark, source)
            stream.measure(arriving, accepted, NO_NAMES, folder).awaitTermination()
            stream.finish(spark, NO_NAMES, folder).awaitTermination()
        got = [(r.poi_id, (r.status, r.uid, r.score)) for r in stream.read_results(spark, folder).collect()]
        assert len(got) == len(want) and dict(got) == want


def test_stop_and_resume(spark, tmp_path):
    """Half of the responses, then the rest after a restart from the same checkpoints."""
    folder, source = str(tmp_path), f"{tmp_path}/in"
    poi_ids = [1, 2, 4, 5, 6, 8]
    accepted = accept(_judged(spark, SMALL, NO_NAMES).where(F.col("poi_id").isin(poi_ids)), NO_NAMES)
    responses = view(spark, SMALL, "boundary_response").where(F.col("poi_id").isin(poi_ids))
    responses = responses.select("poi_id", "uid", "body")
    first = F.pmod(F.crc32("uid"), F.lit(2)) == 0

    def run():
        arriving = stream.read_responses(spark, source)
        stream.measure(arriving, accepted, NO_NAMES, folder).awaitTermination()
        stream.finish(spark, NO_NAMES, folder).awaitTermination()

    responses.where(first).coalesce(1).write.parquet(source)
    run()
    responses.where(~first).coalesce(1).write.mode("append").parquet(source)
    run()
    got = {r.poi_id: (r.status, r.uid) for r in stream.read_results(spark, folder).collect()}

    once = f"{tmp_path}/once"
    stream.measure(stream.read_responses(spark, source), accepted, NO_NAMES, once).awaitTermination()
    stream.finish(spark, NO_NAMES, once).awaitTermination()
    want = {r.poi_id: (r.status, r.uid) for r in stream.read_results(spark, once).collect()}
    assert got == want and got
    open_pois = {r.poi_id for r in stream.still_open(accepted, stream.read_results(spark, folder)).collect()}
    every_poi = {r.poi_id for r in accepted.select("poi_id").collect()}
    assert open_pois == every_poi - set(got)


def test_measured_areas_are_narrow_and_of_the_least_answer(spark, tmp_path):
    """What only the judgement reads is not written; of several answers in a batch the one by the rule of the batch job counts."""
    accepted = accept(_judged(spark, SMALL, NO_NAMES).where("poi_id in (1, 2, 4)"), NO_NAMES)
    responses = view(spark, SMALL, "boundary_response").where("poi_id in (1, 2, 4, 5)").select("poi_id", "uid", "body")
    broken = responses.withColumn("body", F.lit('{"content":{}}'))
    broken.unionByName(responses).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream.measure(stream.read_responses(spark, f"{tmp_path}/in"), accepted, NO_NAMES, f"{tmp_path}/out").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out/aois")
    assert set(got.columns) == {"poi_id", "uid", "search_rank", "uid_name", "called", "area_km2", "distance_m", "pick", "valid", "batch_id"}
    boundaries = boundaries_once(decode_boundaries(responses))
    want = judge_aois(aoi_metrics(attach_boundaries(accepted, boundaries), NO_NAMES), NO_NAMES).where("called")
    fields = ("poi_id", "uid", "search_rank", "uid_name", "area_km2", "distance_m", "valid")
    rows = {tuple(r) for r in got.select(*fields).collect()}
    assert rows == {tuple(r) for r in want.select(*fields).collect()} and len(rows) == got.count()


def test_responses_dealt_out_as_keys_are_the_same(spark):
    want = view(spark, SMALL, "boundary_response")
    got = from_groups(search_groups(spark, SMALL), "boundary_response", by_uid=3)
    assert got.rdd.getNumPartitions() == 3 and got.columns == want.columns
    assert not got.exceptAll(want).count() and got.count() == want.count()
    homes = got.select("uid", F.spark_partition_id().alias("n")).groupBy("uid").agg(F.count_distinct("n").alias("n")).where("n > 1")
    assert homes.isEmpty()
