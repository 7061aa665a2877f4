"""The analyst's questions: bounded, paginated queries over the layers of a dataset.

Each question is one plan of fixed shape; inputs become predicates on columns, so Spark pushes them down to the files. Results
are evidence and interpretations: derived objects are not proof of travel, and gaps and discontinuities are not movement.
"""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.config import ANALYSIS_CONTRACT, Config

DEFAULT_LIMIT, MOST_ROWS, DEFAULT_FLOWS, MOST_FLOWS = 100, 1000, 10, 50
LAYERS = ("observations", "events", "presence_intervals", "transitions", "segments", "entities")
SORT_FIELDS = ("observation_count", "transition_count", "discontinuity_count", "presence_count", "total_dwell_s", "first_seen", "last_seen")
#: Columns that datasets of the first contract lack; views show them as nulls.
LATER_COLUMNS = {
    "observations": {"h3_cell": "string"},
    "events": {"h3_cell": "string"},
    "presence_intervals": {"h3_cell": "string"},
    "transitions": {"origin_h3_cell": "string", "destination_h3_cell": "string", "same_h3_cell": "boolean"},
    "segments": {"start_h3_cell": "string", "end_h3_cell": "string"},
    "tracks": {"start_h3_cell": "string", "end_h3_cell": "string", "unique_h3_cells": "long"},
    "entities": {"start_h3_cell": "string", "end_h3_cell": "string", "unique_h3_cells": "long"},
}
# The notes that answers carry, word for word.
EVIDENCE_NOTE = "Observations are source evidence; events, presence, segments, and transitions are algorithmically derived interpretations."
DISCONTINUITY_NOTE = "A discontinuity means the adjacent observations violated the configured continuity model; it does not prove physical travel between the two positions."


@dataclass
class Page:
    rows: list[dict[str, Any]]
    has_more: bool = False
    next_cursor: str = ""
    limit: int = DEFAULT_LIMIT


def limit_of(limit: int | None, default: int = DEFAULT_LIMIT, most: int = MOST_ROWS) -> int:
    return default if not limit or limit <= 0 else min(limit, most)


def encode_cursor(offset: int) -> str:
    return base64.urlsafe_b64encode(str(offset).encode()).rstrip(b"=").decode()


def decode_cursor(cursor: str) -> int:
    if not cursor:
        return 0
    try:
        offset = int(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)).decode())
    except Exception as e:
        raise ValueError("invalid cursor") from e
    if offset < 0:
        raise ValueError("invalid cursor")
    return offset


def parse_time(text: str) -> datetime:
    try:
        value = datetime.fromisoformat(text)
    except ValueError as e:
        raise ValueError(f"invalid time {text!r}: RFC 3339 is needed") from e
    if "T" not in text.upper() or value.tzinfo is None:
        raise ValueError(f"invalid time {text!r}: RFC 3339 is needed")
    return value.astimezone(UTC)


def between(column: str, entity_id: str = "", start: str = "", end: str = "") -> list[Column]:
    """Predicates for an entity and an inclusive range of times."""
    conditions = [F.col("entity_id") == entity_id] if entity_id else []
    low, high = parse_time(start) if start else None, parse_time(end) if end else None
    if low and high and low > high:
        raise ValueError("from must not be after to")
    conditions += [F.col(column) >= F.lit(low)] if low else []
    conditions += [F.col(column) <= F.lit(high)] if high else []
    return conditions


def _where(df: DataFrame, conditions: list[Column]) -> DataFrame:
    for c in conditions:
        df = df.where(c)
    return df


def plain(value: Any) -> Any:
    """A value as JSON shows it: times in RFC 3339, bytes as text."""
    if isinstance(value, datetime):
        value = value if value.tzinfo else value.replace(tzinfo=UTC)
        value = value.astimezone(UTC)
        fraction = f".{value.microsecond:06d}".rstrip("0").rstrip(".")
        return value.strftime("%Y-%m-%dT%H:%M:%S") + fraction + "Z"
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).decode("utf-8", "replace")
    return value


@dataclass
class Dataset:
    """Layers to ask questions of; `spark.sql.session.timeZone` must be UTC."""

    layers: dict[str, DataFrame]
    cfg: Config = field(default_factory=Config)
    manifest: dict[str, Any] = field(default_factory=dict)
    has_h3: bool = False

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Dataset:
        """A written dataset, by its folder or its manifest.json. ValueError if its contract is another one or a layer is missing."""
        from waymark.sources.dataset import read_manifest, read_layers

        manifest, base = read_manifest(root)
        if manifest.get("analysis_contract") != ANALYSIS_CONTRACT:
            raise ValueError(f"unsupported analysis contract {manifest.get('analysis_contract')!r}")
        settings = {k: tuple(v) if isinstance(v, list) else v for k, v in manifest.get("config", {}).items() if k in Config.__dataclass_fields__}
        return cls(read_layers(spark, base), Config(**settings), manifest, bool(manifest.get("h3_available", False)))

    def view(self, name: str) -> DataFrame:
        df = self.layers[name]
        for column, kind in LATER_COLUMNS.get(name, {}).items():
            if column not in df.columns:
                df = df.withColumn(column, F.lit(None).cast(kind))
        return df

    def require_h3(self) -> None:
        if not self.has_h3:
            raise ValueError("this dataset has no H3 cells")

    def _cell(self, column: str, cell: str) -> list[Column]:
        if not cell:
            return []
        self.require_h3()
        return [F.col(column) == cell]

    # Plans

    def search_entities(self, *, min_observations: int = 0, min_presence_intervals: int = 0, min_transitions: int = 0, min_discontinuities: int = 0, min_dwell_seconds: float = 0, ha_class: str = "", min_ha_coverage_pct: float = 0, sort_by: str = "", ascending: bool = False) -> DataFrame:
        sort_by = sort_by or "observation_count"
        if sort_by not in SORT_FIELDS:
            raise ValueError(f"unsupported sort_by {sort_by!r}")
        least = {"observation_count": min_observations, "presence_count": min_presence_intervals, "transition_count": min_transitions, "discontinuity_count": min_discontinuities, "total_dwell_s": min_dwell_seconds, "ha_coverage_pct": min_ha_coverage_pct}
        conditions = [F.col(c) >= v for c, v in least.items() if v > 0] + ([F.col("ha_class") == ha_class] if ha_class else [])
        columns = "entity_id subject first_seen last_seen coverage_s observation_count segment_count presence_count transition_count stay_count dwell_count gap_count discontinuity_count total_observed_path_m total_presence_s total_dwell_s unique_geohash_cells unique_h3_cells median_ha_m observations_with_ha observations_without_ha ha_coverage_pct ha_class start_h3_cell end_h3_cell"
        order = F.col(sort_by).asc() if ascending else F.col(sort_by).desc()
        return _where(self.view("entities"), conditions).select(*columns.split()).orderBy(order, "entity_id")

    def entity(self, entity_id: str) -> DataFrame:
        if not entity_id.strip():
            raise ValueError("entity_id is required")
        return self.view("entities").where(F.col("entity_id") == entity_id).drop("eventizer_version").limit(1)

    def presence(self, *, entity_id: str = "", start: str = "", end: str = "", h3_cell: str = "", classification: str = "") -> DataFrame:
        conditions = between("start_ts", entity_id, start, end) + self._cell("h3_cell", h3_cell) + ([F.col("classification") == classification] if classification else [])
        columns = "presence_interval_id track_id segment_id entity_id start_ts end_ts duration_s classification centroid_lat centroid_lon h3_cell observation_count scatter_m median_ha_m min_ha_m max_ha_m observations_with_ha observations_without_ha ha_coverage_pct accuracy_support start_reason end_reason interval_event_id enter_event_id leave_event_id"
        return _where(self.view("presence_intervals"), conditions).select(*columns.split()).orderBy("start_ts", "presence_interval_id")

    def transitions(self, *, entity_id: str = "", start: str = "", end: str = "", origin_h3_cell: str = "", destination_h3_cell: str = "", accuracy_support: str = "") -> DataFrame:
        conditions = between("depart_ts", entity_id, start, end) + self._cell("origin_h3_cell", origin_h3_cell) + self._cell("destination_h3_cell", destination_h3_cell) + ([F.col("accuracy_support") == accuracy_support] if accuracy_support else [])
        columns = "transition_id entity_id track_id segment_id origin_presence_id destination_presence_id depart_ts arrive_ts duration_s origin_lat origin_lon destination_lat destination_lon origin_h3_cell destination_h3_cell same_h3_cell straight_line_distance_m observed_path_distance_m observation_count observations_with_ha observations_without_ha ha_coverage_pct accuracy_support origin_accuracy_support movement_accuracy_support destination_accuracy_support"
        return _where(self.view("transitions"), conditions).select(*columns.split()).orderBy("depart_ts", "transition_id")

    def segments(self, *, entity_id: str = "", start: str = "", end: str = "") -> DataFrame:
        columns = "segment_id track_id entity_id segment_index start_ts end_ts observation_count gap_count duration_s observed_path_m displacement_m mean_observed_speed_mps max_implied_speed_mps start_lat start_lon end_lat end_lon start_h3_cell end_h3_cell start_reason end_reason observations_with_ha observations_without_ha ha_coverage_pct accuracy_support edge_both_known_count edge_previous_missing_count edge_current_missing_count edge_both_missing_count path_component_count"
        return _where(self.view("segments"), between("start_ts", entity_id, start, end)).select(*columns.split()).orderBy("start_ts", "segment_id")

    def events(self, *, entity_id: str = "", start: str = "", end: str = "", event_type: str = "", h3_cell: str = "") -> DataFrame:
        conditions = between("event_time", entity_id, start, end) + ([F.col("event_type") == event_type] if event_type else []) + self._cell("h3_cell", h3_cell)
        columns = "event_id entity_id subject event_type event_time has_end_time end_time source modality class profile feature action state polarity has_magnitude magnitude unit lat lon accuracy_m accuracy_state accuracy_support accuracy_known_count accuracy_missing_count h3_cell track_id segment_id presence_interval_id context_json parameters_json"
        return _where(self.view("events"), conditions).select(*columns.split()).orderBy("event_time", "event_id")

    def observations(self, *, entity_id: str = "", start: str = "", end: str = "", h3_cell: str = "") -> DataFrame:
        if not entity_id and not h3_cell:
            raise ValueError("get_observations requires entity_id or h3_cell")
        columns = "observation_id entity_id subject ts lat lon ha_m ha_state step_accuracy_state geohash h3_cell track_id segment_id presence_interval_id sample_count same_ts_scatter_m has_step step_dt_s step_distance_m effective_distance_m implied_speed_mps is_gap is_discontinuity movement_state speed_class source_row"
        return _where(self.view("observations"), between("ts", entity_id, start, end) + self._cell("h3_cell", h3_cell)).select(*columns.split()).orderBy("ts", "observation_id")

    def timeline(self, entity_id: str, *, start: str = "", end: str = "") -> DataFrame:
        """Events, presence intervals and transitions of an entity in one order of time."""
        if not entity_id:
            raise ValueError("entity_id is required")
        null = F.lit(None).cast("string")
        events = _where(self.view("events"), between("event_time", entity_id, start, end)).select(
            F.col("event_time").alias("ts"), F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("event_type").alias("label"), F.when(F.col("has_end_time"), F.col("end_time")).alias("end_ts"),
            F.when(F.col("has_magnitude") & (F.col("unit") == "s"), F.col("magnitude")).alias("duration_s"), "h3_cell", null.alias("destination_h3_cell"), "segment_id", "presence_interval_id", "accuracy_support")
        presence = _where(self.view("presence_intervals"), between("start_ts", entity_id, start, end)).select(
            F.col("start_ts").alias("ts"), F.lit("presence").alias("kind"), F.col("presence_interval_id").alias("id"), F.col("classification").alias("label"), "end_ts", "duration_s", "h3_cell", null.alias("destination_h3_cell"), "segment_id", "presence_interval_id", "accuracy_support")
        moves = _where(self.view("transitions"), between("depart_ts", entity_id, start, end)).select(
            F.col("depart_ts").alias("ts"), F.lit("transition").alias("kind"), F.col("transition_id").alias("id"), F.lit("transition").alias("label"), F.col("arrive_ts").alias("end_ts"), "duration_s", F.col("origin_h3_cell").alias("h3_cell"), "destination_h3_cell", "segment_id", F.col("destination_presence_id").alias("presence_interval_id"), "accuracy_support")
        return events.unionByName(presence).unionByName(moves).orderBy("ts", "kind", "id")

    def cell_summary(self, cell: str, column: str = "h3_cell") -> DataFrame:
        """Observations and entities in a cell, first and last time."""
        return self.view("observations").where(F.col(column) == cell).agg(F.count("*").alias("observation_count"), F.count_distinct("entity_id").alias("entity_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))

    def cell_presence(self, cell: str, column: str = "h3_cell") -> DataFrame:
        dwell = F.col("classification") == "dwell"
        return self.view("presence_intervals").where(F.col(column) == cell).agg(
            F.count("*").alias("presence_count"), F.count_if(dwell).alias("dwell_count"), F.coalesce(F.sum("duration_s"), F.lit(0.0)).alias("total_presence_s"), F.coalesce(F.sum(F.when(dwell, F.col("duration_s"))), F.lit(0.0)).alias("total_dwell_s"))

    def cell_flows(self, cell: str, origin: str = "origin_h3_cell", destination: str = "destination_h3_cell") -> DataFrame:
        return self.view("transitions").where((F.col(origin) == cell) | (F.col(destination) == cell)).agg(F.count_if(F.col(destination) == cell).alias("incoming"), F.count_if(F.col(origin) == cell).alias("outgoing"))

    def top_flows(self, cell: str, limit: int = DEFAULT_FLOWS, *, given: str = "destination_h3_cell", counted: str = "origin_h3_cell") -> DataFrame:
        """Cells at the other end of transitions that touch a cell, with the most first."""
        flows = self.view("transitions").where(F.col(given) == cell).groupBy(F.col(counted).alias("h3_cell")).agg(F.count("*").alias("transition_count"), F.count_distinct("entity_id").alias("entity_count"))
        return flows.orderBy(F.desc("transition_count"), "h3_cell").limit(limit_of(limit, DEFAULT_FLOWS, MOST_FLOWS))

    def top_entities(self, cell: str, column: str = "h3_cell") -> DataFrame:
        return self.view("observations").where(F.col(column) == cell).groupBy("entity_id").agg(F.count("*").alias("observation_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")).orderBy(F.desc("observation_count"), "entity_id")

    def nearest_observations(self, entity_id: str, at_ms: int, limit: int = 6) -> DataFrame:
        columns = "observation_id entity_id ts lat lon ha_m ha_state step_accuracy_state geohash h3_cell track_id segment_id presence_interval_id step_dt_s step_distance_m effective_distance_m implied_speed_mps is_gap is_discontinuity"
        away = F.abs(F.unix_millis("ts") - at_ms)
        return self.view("observations").where(F.col("entity_id") == entity_id).orderBy(away, "ts", "observation_id").limit(limit).select(*columns.split())

    def last_observations(self, entity_id: str, at_ms: int, limit: int = 2) -> DataFrame:
        """The last rows at or before a time, latest first."""
        columns = "observation_id entity_id ts lat lon ha_m ha_state step_accuracy_state geohash h3_cell track_id segment_id step_dt_s step_distance_m effective_distance_m implied_speed_mps is_gap is_discontinuity"
        return self.view("observations").where((F.col("entity_id") == entity_id) & (F.unix_millis("ts") <= at_ms)).orderBy(F.desc("ts"), F.desc("observation_id")).limit(limit).select(*columns.split())

    # Bounded results

    @staticmethod
    def rows(df: DataFrame) -> list[dict[str, Any]]:
        return [{k: plain(v) for k, v in r.asDict(True).items()} for r in df.collect()]

    def page(self, plan: DataFrame, limit: int | None = None, cursor: str = "") -> Page:
        """One page of an ordered plan: a row more than asked for tells whether there is another."""
        n, offset = limit_of(limit), decode_cursor(cursor)
        rows = self.rows(plan.offset(offset).limit(n + 1))
        more = len(rows) > n
        return Page(rows[:n], more, encode_cursor(offset + n) if more else "", n)

    def _one(self, plan: DataFrame, what: str) -> dict[str, Any]:
        found = self.rows(plan.limit(1))
        if not found:
            raise LookupError(f"{what} not found")
        return found[0]

    def get_entity(self, entity_id: str) -> dict[str, Any]:
        return self._one(self.entity(entity_id), f"entity {entity_id!r}")

    def summary(self) -> dict[str, Any]:
        m, stats = self.manifest, self.manifest.get("stats", {})
        names = {"input_rows": "input_rows", "normalized_observations": "normalized_rows", "entities": "entity_count", "events": "event_count", "segments": "segment_count", "presence_intervals": "presence_count", "transitions": "transition_count", "gaps": "gap_count", "discontinuities": "discontinuity_count", "ha_coverage_pct": "normalized_ha_coverage_pct"}
        storage = m.get("storage", {})
        return {k: m.get(k) for k in ("tool", "tool_version", "eventizer", "analysis_contract", "source")} | {k: stats.get(v) for k, v in names.items()} | {
            "h3_available": self.has_h3, "h3_resolution": self.cfg.h3_resolution if self.has_h3 else -1, "geohash_precision": self.cfg.geohash_precision,
            "analysis_bytes": storage.get("analysis_bytes"), "canonical_bytes": storage.get("canonical_bytes"), "analysis_expansion_ratio": storage.get("analysis_expansion_ratio"),
        }

    def describe_h3_cell(self, cell: str, flow_limit: int = 0) -> dict[str, Any]:
        self.require_h3()
        if not cell.strip():
            raise ValueError("h3_cell is required")
        n = limit_of(flow_limit, DEFAULT_FLOWS, MOST_FLOWS)
        return {
            "h3_cell": cell, "h3_resolution": self.cfg.h3_resolution, **self.rows(self.cell_summary(cell))[0], **self.rows(self.cell_presence(cell))[0],
            **{f"{k}_transitions": v for k, v in self.rows(self.cell_flows(cell))[0].items()},
            "top_origins": self.rows(self.top_flows(cell, n)), "top_destinations": self.rows(self.top_flows(cell, n, given="origin_h3_cell", counted="destination_h3_cell")), "top_entities": self.page(self.top_entities(cell), n),
        }

    def explain_event(self, event_id: str) -> dict[str, Any]:
        if not event_id:
            raise ValueError("event_id is required")
        wanted = self.view("events").where(F.col("event_id") == event_id).withColumn("event_time_ms", F.unix_millis("event_time")).drop("geometry", "eventizer_version")
        event = self._one(wanted, f"event {event_id!r}")
        out = {"event": event, "nearby_observations": self.rows(self.nearest_observations(event["entity_id"], event["event_time_ms"])), "evidence_note": EVIDENCE_NOTE}
        for key, layer, column in (("presence", "presence_intervals", "presence_interval_id"), ("segment", "segments", "segment_id")):
            if event.get(column):
                found = self.rows(self.view(layer).where(F.col(column) == event[column]).drop("geometry", "eventizer_version").limit(1))
                if found:
                    out[key] = found[0]
        return out

    def explain_discontinuity(self, event_id: str) -> dict[str, Any]:
        event = self.explain_event(event_id)["event"]
        if event["event_type"] != "DISCONTINUITY":
            raise ValueError(f"event {event_id!r} is {event['event_type']}, not DISCONTINUITY")
        context = json.loads(event["context_json"] or "{}")
        effective, speed, dt = (float(context.get(k) or 0) for k in ("effective_distance_m", "implied_speed_mps", "travel_seconds"))
        jump, fast = effective > self.cfg.max_jump_m, dt > 0 and speed > self.cfg.max_speed_mps
        near = self.rows(self.last_observations(event["entity_id"], event["event_time_ms"])) + [None, None]
        return {
            "event": event, "current_observation": near[0], "previous_observation": near[1], "reason": "jump_and_speed" if jump and fast else "jump_only" if jump else "speed_only" if fast else "unknown",
            "jump_threshold_m": self.cfg.max_jump_m, "speed_threshold_mps": self.cfg.max_speed_mps, "effective_distance_m": effective, "implied_speed_mps": speed, "dt_s": dt,
            "edge_accuracy_state": context.get("edge_accuracy_state", ""), "interpretation": DISCONTINUITY_NOTE,
        }


def _up_to(events: DataFrame, observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Observations (entity_id, observation_id, o_ms), and events (entity_id, event_id, e_ms) with the number of their entity's observations at or before them."""
    rows = observations.select("entity_id", "observation_id", F.unix_millis("ts").alias("o_ms"))
    asked = events.select("entity_id", "event_id", F.unix_millis("event_time").alias("e_ms"))
    none = F.lit(None).cast("string")
    both = rows.select("entity_id", F.col("o_ms").alias("ms"), F.lit(1).alias("seen"), none.alias("event_id")).unionByName(asked.select("entity_id", F.col("e_ms").alias("ms"), F.lit(0).alias("seen"), "event_id"))
    upto = F.sum("seen").over(Window.partitionBy("entity_id").orderBy("ms").rangeBetween(Window.unboundedPreceding, 0))
    return rows, both.withColumn("upto", upto).where("event_id is not null").select("entity_id", "event_id", F.col("ms").alias("e_ms"), "upto")


def batch_last(events: DataFrame, observations: DataFrame, limit: int = 2) -> DataFrame:
    """For every event the last `limit` observations at or before its time, latest first: the batch form of `last_observations`."""
    rows, counted = _up_to(events, observations)
    numbered = rows.withColumn("number", F.row_number().over(Window.partitionBy("entity_id").orderBy("o_ms", "observation_id")).cast("long"))
    wanted = counted.where("upto > 0").select("entity_id", "event_id", "upto", F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("upto") - limit + 1), F.col("upto"))).alias("number"))
    return wanted.join(numbered, ["entity_id", "number"]).select("event_id", (F.col("upto") - F.col("number") + 1).alias("nth"), "observation_id")


def batch_nearest(events: DataFrame, observations: DataFrame, limit: int = 6) -> DataFrame:
    """For every event its nearest observations in time, by distance, then time, then identifier.

    Both sides are sorted together once to count the observations up to each event. The nearest are among the last `limit` up to it
    and the first `limit` after it, which come by equi-joins on their numbers: the work grows with the events, not with all pairs.
    """
    rows, counted = _up_to(events, observations)
    # Equal times are numbered so that the smaller identifiers are nearer on both sides.
    before = rows.withColumn("number", F.row_number().over(Window.partitionBy("entity_id").orderBy("o_ms", F.desc("observation_id"))).cast("long"))
    after = rows.withColumn("number", F.row_number().over(Window.partitionBy("entity_id").orderBy("o_ms", "observation_id")).cast("long"))

    def near(numbered: DataFrame, first: Column, last: Column) -> DataFrame:
        return counted.select("entity_id", "event_id", "e_ms", F.explode(F.sequence(first, last)).alias("number")).join(numbered, ["entity_id", "number"])

    found = near(before, F.col("upto") - limit + 1, F.col("upto")).unionByName(near(after, F.col("upto") + 1, F.col("upto") + limit))
    by_event = Window.partitionBy("entity_id", "event_id").orderBy(F.abs(F.col("o_ms") - F.col("e_ms")), "o_ms", "observation_id")
    return found.withColumn("nth", F.row_number().over(by_event)).where(F.col("nth") <= limit).select("event_id", "nth", "observation_id")


def batch_previous(events: DataFrame, observations: DataFrame) -> DataFrame:
    """As-of join: for every event the last observation before its time, by one sort of both sides together instead of a join."""
    both = observations.select("entity_id", F.unix_millis("ts").alias("ms"), F.lit(1).alias("side"), F.lit(None).cast("string").alias("event_id"), "observation_id").unionByName(
        events.select("entity_id", F.unix_millis("event_time").alias("ms"), F.lit(0).alias("side"), "event_id", F.lit(None).cast("string").alias("observation_id")))
    before = Window.partitionBy("entity_id").orderBy("ms", "side", "observation_id").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("previous_id", F.last("observation_id", True).over(before)).where("side = 0").select("event_id", "previous_id")


