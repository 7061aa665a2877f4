"""Scenarios of the state machine and the layers, on a few hand-made rows each."""

import json

import pytest
from pyspark.sql import functions as F

from waymark.config import Config
from waymark.operators import diagnostics as D
from waymark.operators.layers import Layers, decisions

T0 = 1788256800  # 2026-09-01T10:00:00Z
SCHEMA = "entity_id string, ts_s long, ts_ns int, source_row long, lat double, lon double, ha double, lat_places int, lon_places int"


def layers(spark, rows, **settings):
    """rows: (minutes, lat, ha[, lon[, entity]])."""
    made = []
    for i, (minutes, lat, ha, *more) in enumerate(rows):
        lon, entity = (more + [-0.1, "a"][len(more):])[:2]
        made.append((entity, T0 + int(minutes * 60), 0, i + 2, float(lat), float(lon), ha, len(str(lat).partition(".")[2]), len(str(lon).partition(".")[2])))
    return Layers(spark.createDataFrame(made, SCHEMA), Config(source="test", **settings))


def events(L):
    return [r["event_type"] for r in L.events.orderBy("event_time", F.expr("case event_type when 'START' then 0 when 'ENTER' then 1 when 'LEAVE' then 3 when 'GAP' then 4 when 'DISCONTINUITY' then 5 when 'END' then 6 else 2 end")).collect()]


def counters(L):
    return decisions(L.folded).first().asDict()


MOVE = [(0, 51.5, 5.0), (5, 51.5, 5.0), (10, 51.505, 5.0), (12, 51.506, 5.0), (14, 51.506, 5.0), (20, 51.506, 5.0)]


def test_stationary_is_a_dwell_without_boundaries(spark):
    L = layers(spark, [(m, 51.5, 10.0) for m in (0, 10, 20)])
    assert events(L) == ["START", "DWELL", "END"]
    assert L.presence_intervals.first()["duration_s"] == 1200


def test_confirmed_move(spark):
    L = layers(spark, MOVE)
    assert events(L) == ["START", "STAY", "LEAVE", "ENTER", "STAY", "END"]
    t = L.transitions.first()
    assert (t["duration_s"], t["observation_count"], t["observations_with_ha"]) == (420, 3, 3)
    second = L.presence_intervals.orderBy("start_ts").collect()[1]
    assert second["start_reason"] == "movement_arrival" and second["enter_event_id"].startswith("evt:")


def test_gap_ends_presence_but_not_the_segment(spark):
    L = layers(spark, [(0, 51.5, 5.0), (10, 51.5, 5.0), (180, 51.5, 5.0)])
    assert events(L) == ["START", "STAY", "GAP", "END"]
    s = L.segments.collect()
    assert len(s) == 1 and s[0]["gap_count"] == 1 and s[0]["path_component_count"] == 2


def test_discontinuity_splits_segments(spark):
    L = layers(spark, [(0, 51.5, 5.0), (1, 51.5, 5.0), (61 / 60, 52.0, 5.0)])
    assert [s["end_reason"] for s in L.segments.orderBy("segment_index").collect()] == ["discontinuity", "track_end"]
    step = D.steps(L.normalized, L.cfg).where("is_discontinuity").first()
    assert (step["reason"], step["step_accuracy_state"]) == ("jump_and_speed", "both_known")


def test_best_row_of_an_instant(spark):
    L = layers(spark, [(0, 51.5, 50.0), (0, 51.5001, 5.0), (1, 51.5, 5.0)])
    first = L.normalized.where("idx = 1").first()
    assert (first["ha"], first["source_row"], first["sample_count"]) == (5.0, 3, 2) and 11 < first["same_ts_scatter_m"] < 11.2
    assert layers(spark, [(0, 51.5, None), (0, 51.5, 500.0)]).normalized.first()["ha"] == 500.0


def test_missing_radius_is_not_subtracted(spark):
    step = layers(spark, [(0, 51.5, 50.0), (1, 51.501, None)]).normalized.where("idx = 2").first()
    assert step["step_accuracy_state"] == "current_missing" and step["effective_distance_m"] == pytest.approx(step["step_distance_m"] - 50)


def test_candidate_presence_suppresses_enter(spark):
    L = layers(spark, [(0, 51.5, 5.0), (5, 51.502, 5.0), (10, 51.502, 5.0)])
    assert "ENTER" not in events(L) and counters(L)["enter_suppressed_no_pending_transition"] == 1


@pytest.mark.parametrize(("rows", "outcome"), [
    ([(0, 51.5, 5.0), (5, 51.5, 5.0), (10, 51.505, 5.0), (180, 51.505, 5.0)], "departure_candidates_cancelled_gap"),
    ([(0, 51.5, 5.0), (5, 51.5, 5.0), (10, 51.505, 5.0), (10.1, 52.5, 5.0)], "departure_candidates_cancelled_discontinuity"),
    ([(0, 51.5, 5.0), (5, 51.5, 5.0), (10, 51.505, 5.0)], "departure_candidates_cancelled_eof"),
    ([(0, 51.5, 5.0), (5, 51.5, 5.0), (10, 51.505, 5.0), (12, 51.5, 5.0)], "departure_candidates_returned_inside"),
])
def test_every_candidate_has_an_outcome(spark, rows, outcome):
    c = counters(layers(spark, rows))
    assert c[outcome] == 1 and c["departure_candidate_sequences"] == 1 and c["departure_candidate_unaccounted"] == 0


def test_pending_departure_cancelled_by_a_gap(spark):
    c = counters(layers(spark, [(0, 51.5, 5.0), (5, 51.5, 5.0), (10, 51.505, 5.0), (12, 51.506, 5.0), (180, 51.506, 5.0)]))
    assert (c["pending_transitions_started"], c["transitions_cancelled_gap"], c["transitions_confirmed"], c["pending_transition_unaccounted"]) == (1, 1, 0, 0)


def test_immediate_departures(spark):
    L = layers(spark, [(0, 51.5, 5.0), (5, 51.5, 5.0), (10, 51.505, 5.0), (12, 51.505, 5.0)], confirm_moves=False)
    assert events(L) == ["START", "STAY", "LEAVE", "ENTER", "STAY", "END"]


def test_scopes_of_support(spark):
    rows = [r if i != 3 else (12, 51.506, None) for i, r in enumerate(MOVE)]
    L = layers(spark, rows)
    t = L.transitions.first()
    assert (t["origin_accuracy_support"], t["movement_accuracy_support"], t["destination_accuracy_support"]) == ("all_known", "mixed", "mixed")
    assert L.entities.first()["ha_class"] == "mixed"


def test_one_row_entity(spark):
    L = layers(spark, [(0, 51.5, 5.0)])
    assert events(L) == ["START", "END"] and L.presence_intervals.count() == 0
    assert L.tracks.first()["event_count"] == 2


def test_identifiers_do_not_depend_on_the_order_of_rows(spark):
    first = layers(spark, MOVE)
    again = Layers(first.source.orderBy(F.desc("ts_s")).withColumn("source_row", F.col("source_row") + 100), first.cfg)
    ids = lambda L: {r[0] for r in L.events.select("event_id").collect()} | {r[0] for r in L.observations.select("observation_id").collect()}
    assert ids(first) == ids(again)


def test_edges_close(spark):
    L = layers(spark, [(0, 51.5, 5.0), (1, 51.5, None), (2, 51.5, None), (3, 51.5, 5.0)])
    states = {r["step_accuracy_state"]: r["edges"] for r in D.edge_totals(D.steps(L.normalized, L.cfg), "step_accuracy_state").collect()}
    assert states == {"current_missing": 1, "both_missing": 1, "previous_missing": 1}
    assert set(D.closure(D.steps(L.normalized, L.cfg), decisions(L.folded), 4, 1).values()) == {0}


def test_nanoseconds_stay_apart(spark):
    rows = [("a", T0, n, n, 51.5, 0.0, 1.0, 1, 1) for n in (1, 2)]
    L = Layers(spark.createDataFrame(rows, SCHEMA), Config(source="test"))
    assert L.normalized.count() == 2
    assert {r[0] for r in L.normalized.select("ts_text").collect()} == {"2026-09-01T10:00:00.000000001Z", "2026-09-01T10:00:00.000000002Z"}


def test_known_identifiers(spark):
    """Values worked out by hand from the recipes."""
    L = layers(spark, [(0, 51.5, 10.0), (5, 51.5, 10.0), (10, 51.505, 10.0), (12, 51.505, 10.0)])
    row = L.normalized.first()
    assert (row["track_id"], row["segment_id"]) == ("trk:e872c78578f916c2c4d4835d", "seg:e8fa966743e2d6e75945e6c4")
    assert L.presence_intervals.orderBy("start_ts").first()["presence_interval_id"] == "prs:d6d091b4ef1064195d73ddab"
    context = json.loads(L.events.where("event_type = 'START'").first()["context_json"])
    assert list(context) == sorted(context) and context["accuracy_m"] == 10


def test_empty_input(spark):
    L = Layers(spark.createDataFrame([], SCHEMA), Config(source="test"))
    assert [x.count() for x in (L.events, L.observations, L.segments, L.entities, L.transitions)] == [0] * 5
