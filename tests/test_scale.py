"""Steps that grow with the table: what goes through Python, and what is shuffled after it."""

import json

from pyspark.sql import functions as F

from tests.compare import DATA
from tests.test_trajectories import MOVE, layers
from waymark.functions.jsontext import respell, text

DECIDED = ("idx", "decision", "member_no", "seen_no", "from_no", "closes_no", "end_reason", "dest_cum_path_m")


def test_nothing_is_shuffled_or_sorted_again_after_the_fold(spark):
    above, _ = layers(spark, MOVE).folded._jdf.queryExecution().executedPlan().toString().split("MapInArrow", 1)
    assert "Exchange" not in above and "Window" not in above
    narrow = layers(spark, MOVE).folded._jdf.queryExecution().analyzed().toString().split("MapInArrow")[1].split("\n")[0]
    assert "geohash" not in narrow and "track_id" not in narrow  # identifiers are made afterwards, where they are asked for


def test_batches_of_one_row_decide_the_same(spark):
    decided = lambda: [tuple(r) for r in layers(spark, MOVE).folded.select(*DECIDED).orderBy("idx").collect()]
    whole, was = decided(), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        assert decided() == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    # The anchors, rows 1 and 4, are members of the presences that rows 2 and 5 confirm.
    assert [r[2] for r in whole] == [1, 1, None, 2, 2, 2] and [r[3] for r in whole] == [1, 1, 1, 2, 2, 2]


def test_json_of_spark_is_respelt_as_member_by_member():
    for value in ('{"a":1.0,"b":{"c":1.0E-7,"d":-5,"e":"x"},"f":true,"g":1.2345678E7}', '{"a":"q\\":5","b":2.50}', '{"a":"<5>","b":2.50}', '{"a":"","b":-0.0,"c":1.0E22}'):
        assert respell(value) == text(json.loads(value))


def test_breaks_need_no_fold(spark):
    plan = layers(spark, MOVE).events.where(F.col("event_type") == "DISCONTINUITY")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan


def test_questions_on_breaks_run_no_state_machine(spark):
    from waymark.plans.queries import QUERIES

    for name in ("disc_events", "get_events", "nearest_observations", "asof_previous", "top_entities_in_cell"):
        assert "MapInArrow" not in QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString(), name


def _plan(spark, name):
    from waymark.plans.queries import QUERIES

    return QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


def _through_python(plan):
    """The columns that the first fold of a plan gives back."""
    return plan.split("MapInArrow", 1)[1].split("\n")[0]


def test_presences_read_the_fold_once_and_keep_nothing(spark):
    plan = _plan(spark, "presence_intervals")
    assert plan.count("MapInArrow") == 1 and "InMemoryRelation" not in plan and "Join" not in plan
    assert "step_distance_m" not in _through_python(plan) and "decision" not in _through_python(plan)


def test_median_radius_of_even_odd_and_no_counts(spark):
    for radii, median in (((5.0, 1.0, 4.0), 4.0), ((8.0, 1.0, 4.0, 2.0), 3.0), ((None, 7.0, None), 7.0), ((None, None), None)):
        found = layers(spark, [(i, 50.0, ha) for i, ha in enumerate(radii)]).presence.first()
        assert found["median_ha_m"] == median and found["observation_count"] == len(radii) and found["observations_with_ha"] == sum(r is not None for r in radii)


def test_rows_in_no_presence_are_left_out_for_presences_alone(spark):
    L = layers(spark, MOVE)
    whole, L.reads = [tuple(r) for r in L.presence.orderBy("no").collect()], ()
    for made in ("folded", "presence", "moves"):
        L.__dict__.pop(made, None)
    assert [tuple(r) for r in L.presence.orderBy("no").collect()] == whole and L.folded.count() < L.normalized.count()


def test_tracks_pass_what_they_read_and_make_no_group_of_each_cell(spark):
    plan = _plan(spark, "tracks")
    assert "step_dt_s" not in _through_python(plan) and "from_no" in _through_python(plan)
    assert "count(distinct" not in plan and plan.split("InMemoryRelation", 1)[0].count("Join") <= 2
