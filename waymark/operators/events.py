"""The canonical event stream: START, ENTER, STAY or DWELL, LEAVE, GAP, DISCONTINUITY, END."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from waymark.config import EVENTIZER_VERSION, MODALITY, PRODUCER, PROFILE_ID, VERSION, WIRE_VERSION, Config, plain_number
from waymark.functions import expressions as X
from waymark.functions.jsontext import number, quoted, respell, spell, text
from waymark.functions.wkb import wkb_point

# Fixed values of the event format: feature, action, state, polarity by type, and the order of events at one instant.
KINDS = {
    "START": ("xq:track", "xq:start", "xq:active", 1),
    "STAY": ("xq:presence", "xq.mob:stay", "xq:present", 0),
    "DWELL": ("xq:presence", "xq.mob:dwell", "xq:present", 0),
    "LEAVE": ("xq:presence", "xq:leave", "xq:absent", -1),
    "ENTER": ("xq:presence", "xq:enter", "xq:present", 1),
    "GAP": ("xq:observation", "xq:gap", "xq:interrupted", 0),
    "DISCONTINUITY": ("xq:trajectory", "xq:discontinuity", "xq:discontinuous", 0),
    "END": ("xq:track", "xq:end", "xq:inactive", -1),
}
RANK = {"START": 0, "ENTER": 1, "STAY": 2, "DWELL": 2, "LEAVE": 3, "GAP": 4, "DISCONTINUITY": 5, "END": 6}


def _of_kind(kind: Column, k: int) -> Column:
    table = F.create_map(*[x for name, values in KINDS.items() for x in (F.lit(name), F.lit(values[k]))])
    return F.element_at(table, kind)


def rank(kind: Column) -> Column:
    return F.element_at(F.create_map(*[x for name, n in RANK.items() for x in (F.lit(name), F.lit(n))]), kind)


def _place(lat: str, lon: str, ha: str) -> Column:
    return F.struct(F.col(ha).alias("accuracy_m"), X.ha_state(F.col(ha)).alias("accuracy_state"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))


def _rows(*rows: Column) -> Column:
    return F.array_distinct(F.array(*[F.concat(F.lit("row:"), r.cast("string")) for r in rows]))


_COLUMNS = ("entity_id", "subject", "event_type", "ts_s", "ts_ns", "ts_text", "end_s", "end_ns", "end_text", "magnitude", "unit", "lat", "lon", "accuracy_m", "accuracy_state", "accuracy_known_count", "accuracy_missing_count", "track_id", "segment_id", "presence_interval_id", "source_records", "event_id", "context")


def _shape(rows: DataFrame, **columns: Column) -> DataFrame:
    empty = {"end_s": F.lit(None).cast("long"), "end_ns": F.lit(None).cast("int"), "end_text": F.lit(None).cast("string"), "magnitude": F.lit(None).cast("double"), "unit": F.lit(""), "presence_interval_id": F.lit("")}
    given = {**empty, **columns}
    return rows.select(*[given[c].alias(c) if c in given else F.col(c) for c in _COLUMNS])


def _context(kind: str | Column, **members: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    named = {"source_event": kind, **members}
    return F.to_json(F.struct(*[named[k].alias(k) for k in sorted(named)]))


def _at_fix(kind: str, rows: DataFrame, event_id: Column, presence_id: Column | None = None) -> DataFrame:
    """Events at one observation: START, END, ENTER, LEAVE."""
    known = F.col("ha").isNotNull()
    members = {"track_id": F.col("track_id"), "segment_id": F.col("segment_id"), "cell": F.col("geohash"), "accuracy_state": X.ha_state(F.col("ha")), "accuracy_m": F.col("ha")}
    if presence_id is not None:
        members["presence_interval_id"] = presence_id
    return _shape(
        rows, event_type=F.lit(kind), accuracy_m=F.col("ha"), accuracy_state=X.ha_state(F.col("ha")), accuracy_known_count=known.cast("long"), accuracy_missing_count=(~known).cast("long"),
        presence_interval_id=presence_id if presence_id is not None else F.lit(""), source_records=_rows(F.col("source_row")), event_id=event_id, context=_context(kind, **members),
    )


def start_end(normalized: DataFrame, cfg: Config) -> DataFrame:
    last = F.col("run_ends") & F.col("next_gap").isNull()
    identity = lambda kind: X.stable_id("evt", F.lit(cfg.source), F.col("subject"), F.lit(kind), F.col("ts_text"), F.col("track_id"))
    return _at_fix("START", normalized.where("idx = 1"), identity("START")).unionByName(_at_fix("END", normalized.where(last), identity("END")))


def _previous_fix(rows: DataFrame, cfg: Config) -> DataFrame:
    """Rows at continuity breaks, with the row before them as identifiers and contexts need it."""
    return rows.where("is_gap or is_discontinuity").withColumns({"fix": X.fix_id(), "prev_fix": X.fix_id("prev_"), "prev_geohash": X.geohash(F.col("prev_lat"), F.col("prev_lon"), cfg.geohash_precision)})


def breaks(folded: DataFrame, cfg: Config) -> DataFrame:
    """GAP and DISCONTINUITY events: at the row after the break, with its step as evidence."""
    rows = _previous_fix(folded, cfg)
    state = F.col("step_accuracy_state")
    known = F.when(state == "both_known", 2).when(state == "both_missing", 0).otherwise(1).cast("long")
    bearing = X.bearing_deg(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon"))
    shared = {
        "track_id": F.col("track_id"), "segment_id": F.col("segment_id"), "from_cell": F.col("prev_geohash"), "to_cell": F.col("geohash"), "from_location": _place("prev_lat", "prev_lon", "prev_ha"), "to_location": _place("lat", "lon", "ha"),
        "travel_seconds": F.col("step_dt_s"), "distance_m": F.col("step_distance_m"), "accuracy_state": X.ha_state(F.col("ha")), "accuracy_m": F.col("ha"), "edge_accuracy_state": state,
    }
    further = {"effective_distance_m": F.col("effective_distance_m"), "implied_speed_mps": F.col("implied_speed_mps"), "bearing_deg": bearing, "bearing_8": X.sector(bearing)}
    identity = lambda kind: X.stable_id("evt", F.lit(cfg.source), F.col("subject"), F.lit(kind), F.col("ts_text"), F.col("prev_fix"), F.col("fix"))

    def made(kind: str, flag: str, magnitude: str, unit: str, members: dict[str, Column]) -> DataFrame:
        return _shape(
            rows.where(flag), event_type=F.lit(kind), magnitude=F.col(magnitude), unit=F.lit(unit), accuracy_m=F.col("ha"), accuracy_state=X.ha_state(F.col("ha")), accuracy_known_count=known, accuracy_missing_count=2 - known,
            source_records=_rows(F.col("prev_source_row"), F.col("source_row")), event_id=identity(kind), context=_context(kind, **members),
        )

    return made("GAP", "is_gap", "step_dt_s", "s", {**shared, "cell": F.col("geohash")}).unionByName(made("DISCONTINUITY", "is_discontinuity", "step_distance_m", "m", {**shared, **further}))


def stays(presence: DataFrame, cfg: Config) -> DataFrame:
    """STAY and DWELL events: the interval, at its centroid."""
    kind = F.upper("classification")
    members = {
        "track_id": F.col("track_id"), "segment_id": F.col("segment_id"), "presence_interval_id": F.col("presence_interval_id"), "cell": X.geohash(F.col("centroid_lat"), F.col("centroid_lon"), cfg.geohash_precision),
        "state_seconds": F.col("duration_s"), "observation_samples": F.col("observation_count"), "observation_scatter_m": F.col("scatter_m"), "observations_with_ha": F.col("observations_with_ha"), "observations_without_ha": F.col("observations_without_ha"),
        "ha_coverage_pct": F.col("ha_coverage_pct"), "accuracy_support": F.col("accuracy_support"), "start_reason": F.col("start_reason"), "end_reason": F.col("end_reason"), "median_accuracy_m": F.col("median_ha_m"),
        "closed_by_confirmed_movement": F.when(F.col("left"), F.lit(True)),
    }
    return _shape(
        presence, event_type=kind, ts_s=F.col("a.ts_s"), ts_ns=F.col("a.ts_ns"), ts_text=F.col("a.ts_text"), end_s=F.col("z.ts_s"), end_ns=F.col("z.ts_ns"), end_text=F.col("z.ts_text"), magnitude=F.col("duration_s"), unit=F.lit("s"),
        lat=F.col("centroid_lat"), lon=F.col("centroid_lon"), accuracy_m=F.lit(None).cast("double"), accuracy_state=F.lit("not_asserted"), accuracy_known_count=F.col("observations_with_ha"), accuracy_missing_count=F.col("observations_without_ha"),
        presence_interval_id=F.col("presence_interval_id"), source_records=_rows(F.col("a.source_row"), F.col("z.source_row")), event_id=F.col("interval_event_id"), context=_context(kind, **members),
    )


def enters_leaves(presence: DataFrame) -> DataFrame:
    """ENTER at the anchor of a confirmed arrival, LEAVE at the last row inside before a confirmed departure."""
    def at(side: str) -> DataFrame:
        return presence.select("entity_id", "subject", "track_id", "segment_id", "presence_interval_id", "enter_event_id", "leave_event_id", "entered", "left", *[F.col(f"{side}.{c}").alias(c) for c in ("ts_s", "ts_ns", "ts_text", "lat", "lon", "ha", "geohash", "source_row")])

    enter = _at_fix("ENTER", at("a").where("entered"), F.col("enter_event_id"), F.col("presence_interval_id"))
    return enter.unionByName(_at_fix("LEAVE", at("z").where("left"), F.col("leave_event_id"), F.col("presence_interval_id")))


def stream(normalized: DataFrame | None, folded: DataFrame | None, presence: DataFrame | None, cfg: Config) -> DataFrame:
    """All events with `seq`, their order within the entity: by time, then kind, then identifier. Without `presence`, or rows, those that do not come from it."""
    parts = [] if normalized is None else [start_end(normalized, cfg), breaks(folded, cfg)]
    parts += [] if presence is None else [enters_leaves(presence), stays(presence, cfg)]
    every = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("entity_id").orderBy("ts_s", "ts_ns", rank(F.col("event_type")), "event_id")
    return every.withColumn("seq", F.row_number().over(order))


def parameters_json(cfg: Config) -> str:
    return text({k: plain_number(v) for k, v in cfg.parameters().items()})


def events(normalized: DataFrame | None, folded: DataFrame | None, presence: DataFrame | None, cfg: Config, geometry: bool = False) -> DataFrame:
    """The events layer in its file schema. Times and magnitudes that an event lacks are the epoch and 0, with has_ flags to tell."""
    rows = stream(normalized, folded, presence, cfg)
    kind = F.col("event_type")
    out = rows.select(
        "event_id", "entity_id", "subject", "event_type", X.millis(F.col("ts_s"), F.col("ts_ns")).alias("event_time"), F.col("end_s").isNotNull().alias("has_end_time"),
        X.millis(F.coalesce("end_s", F.lit(0).cast("long")), F.coalesce("end_ns", F.lit(0))).alias("end_time"), F.lit(cfg.source).alias("source"), F.lit(MODALITY).alias("modality"), F.lit("transition").alias("class"), F.lit(PROFILE_ID).alias("profile"),
        _of_kind(kind, 0).alias("feature"), _of_kind(kind, 1).alias("action"), _of_kind(kind, 2).alias("state"), _of_kind(kind, 3).cast("long").alias("polarity"),
        F.col("magnitude").isNotNull().alias("has_magnitude"), F.coalesce("magnitude", F.lit(0.0)).alias("magnitude"), "unit", "lat", "lon", "accuracy_m", "accuracy_state",
        X.support_class(F.col("accuracy_known_count"), F.col("accuracy_missing_count")).alias("accuracy_support"), "accuracy_known_count", "accuracy_missing_count", F.lit(None).cast("string").alias("h3_cell"),
        "track_id", "segment_id", "presence_interval_id", spell(F.col("context")).alias("context_json"), F.lit(parameters_json(cfg)).alias("parameters_json"), F.lit(EVENTIZER_VERSION).alias("eventizer_version"),
    )
    return out.withColumn("geometry", wkb_point(F.col("lon"), F.col("lat"))) if geometry else out


def canonical(rows: DataFrame, cfg: Config) -> DataFrame:
    """(entity_id, seq, value): each event of `stream` as one JSON line. What all events of a kind share is spelt once."""
    member = lambda **given: ",".join(f"{text(k)}:{text(v)}" for k, v in given.items())
    head = "{" + member(xq_version=WIRE_VERSION)
    sender = {"source": cfg.source, "modality": MODALITY, "class": "transition", "profile": PROFILE_ID}
    kinds = {k: member(feature=v[0], action=v[1], state=v[2], polarity=v[3]) for k, v in KINDS.items()}
    fixed, provenance, parameters = member(**sender), member(producer=PRODUCER, producer_version=VERSION, method="algorithmic"), parameters_json(cfg)

    @F.arrow_udf(StringType())
    def line(ids: pa.Array, at: pa.Array, until: pa.Array, subjects: pa.Array, of: pa.Array, magnitudes: pa.Array, units: pa.Array, lats: pa.Array, lons: pa.Array, radii: pa.Array, records: pa.Array, contexts: pa.Array) -> pa.Array:
        def one(i: str, t: str, end: str | None, subject: str, kind: str, magnitude: float | None, unit: str, lat: float | None, lon: float | None, ha: float | None, record: str, context: str) -> str:
            span = "" if end is None else f',"end_time":"{end}"'
            size = "" if magnitude is None else f',"magnitude":{number(magnitude)}'
            measure = f',"unit":"{unit}"' if unit else ""
            place = ",".join([f'"{k}":{number(v)}' for k, v in (("lat", lat), ("lon", lon), ("accuracy_m", ha)) if v is not None])
            return f'{head},"id":"{i}","event_time":"{t}"{span},{fixed},"subject":{quoted(subject)},{kinds[kind]}{size}{measure},"location":{{{place}}},"provenance":{{{provenance},"source_records":{record},"parameters":{parameters}}},"context":{respell(context)}}}'

        return pa.array([one(*row) for row in zip(*[c.to_pylist() for c in (ids, at, until, subjects, of, magnitudes, units, lats, lons, radii, records, contexts)])], pa.string())

    records = F.concat(F.lit('["'), F.array_join("source_records", '","'), F.lit('"]'))
    return rows.select("entity_id", "seq", line("event_id", "ts_text", "end_text", "subject", "event_type", "magnitude", "unit", "lat", "lon", "accuracy_m", records, "context").alias("value"))
