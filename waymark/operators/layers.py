"""The analysis layers: observations, presence intervals, transitions, segments, tracks, entities, in their file schemas.

H3 cells need a library that is not part of this environment. The layers carry the columns as nulls, and the dataset says so.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.config import EVENTIZER_VERSION, Config
from waymark.functions import expressions as X
from waymark.functions.wkb import wkb_line, wkb_path, wkb_point
from waymark.operators import events as E
from waymark.operators import normalize as N
from waymark.operators import presence as P


def no_cell(name: str) -> Column:
    return F.lit(None).cast("string").alias(name)


def _support(prefix: str = "") -> list[str]:
    return [f"{prefix}observations_with_ha", f"{prefix}observations_without_ha", f"{prefix}ha_coverage_pct", f"{prefix}accuracy_support"]


def _long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


@dataclass
class Layers:
    """All layers of one set of observations, each a DataFrame planned from the same normalized rows.

    `geometry` adds the WKB columns. `keep` keeps the folded rows and the presence intervals in memory or on disk once they are
    made: most layers read them several times, and the fold runs in Python. `release` gives them up. `reads` narrows the folded rows to
    what a plan reads (see `fold`); with no name in it layers of presences alone are there, for which the folded rows are read once.
    """

    source: DataFrame
    cfg: Config
    geometry: bool = False
    keep: bool = False
    reads: tuple[str, ...] | None = None

    def _kept(self, df: DataFrame) -> DataFrame:
        if self.keep:
            self.__dict__.setdefault("_held", []).append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    def release(self) -> None:
        for df in self.__dict__.pop("_held", []):
            df.unpersist()

    @cached_property
    def normalized(self) -> DataFrame:
        return N.identify(N.normalize(self.source, self.cfg), self.cfg)

    @cached_property
    def folded(self) -> DataFrame:
        return P.fold(self.normalized, self.cfg, self._kept if self.reads != () else lambda df: df, self.reads)

    @property
    def rows(self) -> DataFrame:
        """Normalized rows for layers that need the fold as well: the kept ones, if they are kept."""
        return self.folded if self.keep else self.normalized

    @cached_property
    def presence(self) -> DataFrame:
        return P.intervals(self.folded, self.cfg, self._kept)

    @cached_property
    def moves(self) -> DataFrame:
        return P.transitions(self.presence)

    @cached_property
    def placed(self) -> DataFrame:
        """Normalized rows for plans that read them several times and need no fold; kept, if rows are kept."""
        narrow = self._kept(self.normalized.drop(*N.LABELS, *N.IDENTIFIERS))
        return N.identify(N.label(narrow, self.cfg), self.cfg)

    def observed(self, rows: DataFrame) -> DataFrame:
        """Of the observations layer what `rows` tell without the presence that holds them."""
        return rows.select(X.observation_id().alias("observation_id"), "entity_id", X.millis(F.col("ts_s"), F.col("ts_ns")).alias("ts"), "lat", "lon")

    def break_events(self, rows: DataFrame) -> DataFrame:
        """GAP and DISCONTINUITY of the events layer, by `rows` that need not be folded."""
        return E.events(rows, rows, None, self.cfg, self.geometry).where(F.col("event_type").isin("GAP", "DISCONTINUITY"))

    @cached_property
    def observations(self) -> DataFrame:
        rows = P.assign(self.folded, self.presence, self.cfg)
        out = rows.select(
            X.observation_id().alias("observation_id"),
            "entity_id", "subject", X.millis(F.col("ts_s"), F.col("ts_ns")).alias("ts"), "lat", "lon", F.col("ha").alias("ha_m"), "ha_state", "step_accuracy_state", "geohash", no_cell("h3_cell"),
            "track_id", "segment_id", "presence_interval_id", *_long("sample_count"), "same_ts_scatter_m", "has_step", "step_dt_s", "step_distance_m", "effective_distance_m", "implied_speed_mps",
            "is_gap", "is_discontinuity", "movement_state", "speed_class", *_long("source_row"), F.lit(EVENTIZER_VERSION).alias("eventizer_version"),
        )
        return out.withColumn("geometry", wkb_point(F.col("lon"), F.col("lat"))) if self.geometry else out

    @cached_property
    def presence_intervals(self) -> DataFrame:
        out = self.presence.select(
            "presence_interval_id", "track_id", "segment_id", "entity_id",
            X.millis(F.col("a.ts_s"), F.col("a.ts_ns")).alias("start_ts"), X.millis(F.col("z.ts_s"), F.col("z.ts_ns")).alias("end_ts"), "duration_s", "classification", "centroid_lat", "centroid_lon", no_cell("h3_cell"),
            *_long("observation_count"), "scatter_m", "median_ha_m", "min_ha_m", "max_ha_m", *_support(), F.col("a.ha_state").alias("start_ha_state"), F.col("z.ha_state").alias("end_ha_state"),
            "start_reason", "end_reason", "interval_event_id", "enter_event_id", "leave_event_id", F.lit(EVENTIZER_VERSION).alias("eventizer_version"),
        )
        return out.withColumn("geometry", wkb_point(F.col("centroid_lon"), F.col("centroid_lat"))) if self.geometry else out

    @cached_property
    def transitions(self) -> DataFrame:
        movement = [F.col(c).alias(f"movement_{c}") for c in _support()]
        out = self.moves.select(
            "transition_id", "entity_id", "track_id", "segment_id", "origin_presence_id", "destination_presence_id",
            X.millis(F.col("depart.ts_s"), F.col("depart.ts_ns")).alias("depart_ts"), X.millis(F.col("arrive.ts_s"), F.col("arrive.ts_ns")).alias("arrive_ts"), "duration_s",
            "origin_lat", "origin_lon", F.col("arrive.lat").alias("destination_lat"), F.col("arrive.lon").alias("destination_lon"),
            no_cell("origin_h3_cell"), no_cell("destination_h3_cell"), F.lit(None).cast("boolean").alias("same_h3_cell"), "straight_line_distance_m", "observed_path_distance_m",
            *_long("observation_count"), *_support(), *_support("origin_"), *movement, *_support("destination_"), F.lit(EVENTIZER_VERSION).alias("eventizer_version"),
        )
        return out.withColumn("geometry", wkb_line(F.col("origin_lon"), F.col("origin_lat"), F.col("destination_lon"), F.col("destination_lat"))) if self.geometry else out

    @cached_property
    def segments(self) -> DataFrame:
        return segments(self.normalized, self.geometry)

    @cached_property
    def tracks(self) -> DataFrame:
        return tracks(self.rows, self.presence, self.geometry)

    @cached_property
    def entities(self) -> DataFrame:
        return entities(self.folded, self.presence)

    @cached_property
    def events(self) -> DataFrame:
        return E.events(self.rows, self.rows, self.presence, self.cfg, self.geometry)

    @property
    def presence_events(self) -> DataFrame:
        """STAY, DWELL, ENTER and LEAVE of the events layer, by presences alone."""
        return E.events(None, None, self.presence, self.cfg, self.geometry)


def segments(normalized: DataFrame, geometry: bool = False) -> DataFrame:
    """One row for each stretch between discontinuities. Its first row's own step belongs to no segment; gaps inside count, but not their distance."""
    inner = ~(F.col("is_discontinuity") | (F.col("idx") == 1))
    walked = inner & ~F.col("is_gap")
    edge = F.struct("idx", "ts_s", "ts_ns", "lat", "lon", "ha_state")
    counts = {f"edge_{s}_count": F.count_if(inner & (F.col("step_accuracy_state") == s)) for s in ("both_known", "previous_missing", "current_missing", "both_missing")}
    key = ["entity_id", "segment_index"]
    rows = normalized
    extra = []
    if geometry:
        part = F.sum((inner & F.col("is_gap")).cast("int")).over(Window.partitionBy(*key).orderBy("idx"))
        rows = rows.withColumn("_part", part)
        extra = [F.sort_array(F.collect_list(F.struct("idx", F.col("_part").alias("part"), "lon", "lat"))).alias("_points")]
    made = rows.groupBy(*key).agg(
        F.first("segment_id").alias("segment_id"), F.first("track_id").alias("track_id"), F.min(edge).alias("a"), F.max(edge).alias("z"),
        F.count("*").alias("observation_count"), F.count_if(inner & F.col("is_gap")).alias("gap_count"),
        F.sum(F.when(walked, F.col("step_distance_m")).otherwise(F.lit(0.0))).alias("observed_path_m"), F.sum(F.when(walked, F.col("step_dt_s")).otherwise(F.lit(0.0))).alias("_observed_s"),
        F.max(F.when(inner, F.col("implied_speed_mps")).otherwise(F.lit(0.0))).alias("max_implied_speed_mps"),
        F.min("lat").alias("min_lat"), F.min("lon").alias("min_lon"), F.max("lat").alias("max_lat"), F.max("lon").alias("max_lon"),
        F.count("ha").alias("observations_with_ha"), F.bool_or(F.coalesce("next_discontinuity", F.lit(False))).alias("_more"), *[v.alias(k) for k, v in counts.items()], *extra,
    )
    made = made.withColumn("observations_without_ha", F.col("observation_count") - F.col("observations_with_ha"))
    out = made.select(
        "segment_id", "track_id", "entity_id", *_long("segment_index"), X.millis(F.col("a.ts_s"), F.col("a.ts_ns")).alias("start_ts"), X.millis(F.col("z.ts_s"), F.col("z.ts_ns")).alias("end_ts"),
        "observation_count", "gap_count", X.seconds_between(F.col("a.ts_s"), F.col("a.ts_ns"), F.col("z.ts_s"), F.col("z.ts_ns")).alias("duration_s"), "observed_path_m",
        X.distance_m(F.col("a.lat"), F.col("a.lon"), F.col("z.lat"), F.col("z.lon")).alias("displacement_m"),
        F.when(F.col("_observed_s") > 0, F.col("observed_path_m") / F.col("_observed_s")).otherwise(F.lit(0.0)).alias("mean_observed_speed_mps"), "max_implied_speed_mps",
        F.col("a.lat").alias("start_lat"), F.col("a.lon").alias("start_lon"), F.col("z.lat").alias("end_lat"), F.col("z.lon").alias("end_lon"), no_cell("start_h3_cell"), no_cell("end_h3_cell"),
        "min_lat", "min_lon", "max_lat", "max_lon", F.when(F.col("segment_index") == 1, "track_start").otherwise("discontinuity").alias("start_reason"), F.when(F.col("_more"), "discontinuity").otherwise("track_end").alias("end_reason"),
        "observations_with_ha", "observations_without_ha", X.coverage_pct(F.col("observations_with_ha"), F.col("observation_count")).alias("ha_coverage_pct"),
        X.support_class(F.col("observations_with_ha"), F.col("observations_without_ha")).alias("accuracy_support"), F.col("a.ha_state").alias("start_ha_state"), F.col("z.ha_state").alias("end_ha_state"),
        *counts, (F.col("gap_count") + 1).alias("path_component_count"), F.lit(EVENTIZER_VERSION).alias("eventizer_version"), *(["_points"] if geometry else []),
    )
    return out.withColumn("geometry", wkb_path(F.col("_points"))).drop("_points") if geometry else out


def _per_entity(normalized: DataFrame, *extra: Column) -> DataFrame:
    is_break = F.col("is_gap") | F.col("is_discontinuity")
    edge = F.struct("idx", "ts_s", "ts_ns", "lat", "lon", "source_row")
    # Cells are counted beside the rest: a distinct count among them would make a group, median and all, of each entity and cell.
    cells = normalized.select(F.col("entity_id").alias("_of"), "geohash").distinct().groupBy("_of").agg(F.count("geohash").alias("unique_geohash_cells"))
    made = normalized.groupBy("entity_id").agg(
        F.first("track_id").alias("track_id"), F.first("subject").alias("subject"), F.min(edge).alias("a"), F.max(edge).alias("z"), F.count("*").alias("observation_count"),
        F.max("segment_index").cast("long").alias("segment_count"), F.count_if("is_gap").alias("gap_count"), F.count_if("is_discontinuity").alias("discontinuity_count"), F.count_if(is_break).alias("_breaks"),
        F.sum(F.when(is_break, F.lit(0.0)).otherwise(F.col("step_distance_m"))).alias("observed_path_m"),
        F.median("ha").alias("median_ha_m"), F.count("ha").alias("observations_with_ha"), F.sum(F.col("sample_count") - 1).alias("same_timestamp_collapsed"), *extra,
    ).withColumn("observations_without_ha", F.col("observation_count") - F.col("observations_with_ha"))
    return made.join(cells, F.col("entity_id").eqNullSafe(F.col("_of")), "left").drop("_of")


def _presence_totals(presence: DataFrame) -> DataFrame:
    dwell = F.col("classification") == "dwell"
    place = F.format_string("%.5f,%.5f", "centroid_lat", "centroid_lon")
    return presence.groupBy("entity_id").agg(
        F.count("*").alias("presence_count"), F.count_if(dwell).alias("dwell_count"), F.count_if(~dwell).alias("stay_count"), F.sum("duration_s").alias("total_presence_s"),
        F.sum(F.when(dwell, F.col("duration_s")).otherwise(F.lit(0.0))).alias("total_dwell_s"), F.count_distinct(place).alias("unique_presence_locations"), F.count_if("entered").alias("transition_count"), F.count_if("left").alias("_leaves"),
    )


def _zero(*names: str) -> list[Column]:
    return [F.coalesce(F.col(n), F.lit(0).cast("double" if n.endswith("_s") else "long")).alias(n) for n in names]


def tracks(normalized: DataFrame, presence: DataFrame, geometry: bool = False) -> DataFrame:
    """One row for each entity: its whole trajectory."""
    points = [F.sort_array(F.collect_list(F.struct("idx", F.col("run").alias("part"), "lon", "lat"))).alias("_points")] if geometry else []
    joined = _per_entity(normalized, *points).join(_presence_totals(presence), "entity_id", "left")
    zero = lambda n: F.coalesce(F.col(n), F.lit(0))
    out = joined.select(
        "track_id", "entity_id", "subject", X.millis(F.col("a.ts_s"), F.col("a.ts_ns")).alias("start_ts"), X.millis(F.col("z.ts_s"), F.col("z.ts_ns")).alias("end_ts"),
        X.seconds_between(F.col("a.ts_s"), F.col("a.ts_ns"), F.col("z.ts_s"), F.col("z.ts_ns")).alias("coverage_s"), "observation_count",
        (F.lit(2) + F.col("gap_count") + F.col("discontinuity_count") + zero("presence_count") + zero("transition_count") + zero("_leaves")).cast("long").alias("event_count"),
        "segment_count", zero("presence_count").cast("long").alias("presence_interval_count"), *_zero("transition_count"), "gap_count", "discontinuity_count", "observed_path_m", "unique_geohash_cells", F.lit(None).cast("long").alias("unique_h3_cells"),
        *_zero("dwell_count", "stay_count", "total_dwell_s"), "median_ha_m", "observations_with_ha", "observations_without_ha", X.coverage_pct(F.col("observations_with_ha"), F.col("observation_count")).alias("ha_coverage_pct"),
        X.support_class(F.col("observations_with_ha"), F.col("observations_without_ha")).alias("ha_class"), F.col("a.lat").alias("start_lat"), F.col("a.lon").alias("start_lon"), F.col("z.lat").alias("end_lat"), F.col("z.lon").alias("end_lon"),
        no_cell("start_h3_cell"), no_cell("end_h3_cell"), (F.col("_breaks") + 1).alias("path_component_count"), F.lit(EVENTIZER_VERSION).alias("eventizer_version"), *(["_points"] if geometry else []),
    )
    return out.withColumn("geometry", wkb_path(F.col("_points"))).drop("_points") if geometry else out


def _counters() -> list[Column]:
    cancelled = F.coalesce("candidate_open_at_end", F.lit(False))
    # A departure is pending after the last row of a stretch unless that row resolved it.
    pending = F.col("run_ends") & F.col("pending_after")
    disc, gap = F.coalesce("next_discontinuity", F.lit(False)), F.coalesce("next_gap", F.lit(False))
    started = F.col("opens_no").isNotNull()
    return [
        F.count_if(started).alias("presence_confirmations"),
        *[F.count_if(started & (F.col("start_reason") == r)).alias(f"presence_start_{n}") for r, n in (("dataset_start", "dataset"), ("continuity_reset", "continuity_reset"), ("candidate_presence", "candidate"), ("movement_arrival", "movement_arrival"))],
        *[F.count_if(F.col("end_reason") == r).alias(f"presence_end_{r}") for r in ("dataset_end", "gap", "discontinuity", "confirmed_movement")],
        F.count_if("candidate_outside").alias("departure_candidate_outside_fixes"),
        F.count_if("candidate_started").alias("departure_candidate_sequences"),
        F.count_if("candidate_expired").alias("departure_candidate_window_expired"),
        F.count_if("candidate_returned").alias("departure_candidates_returned_inside"),
        F.count_if(cancelled & gap & ~disc).alias("departure_candidates_cancelled_gap"),
        F.count_if(cancelled & disc).alias("departure_candidates_cancelled_discontinuity"),
        F.count_if(cancelled & ~gap & ~disc).alias("departure_candidates_cancelled_eof"),
        F.count_if(F.col("decision") == "presence_confirmed_enter_suppressed").alias("enter_suppressed_no_pending_transition"),
        F.count_if(F.col("end_reason") == "confirmed_movement").alias("departures_confirmed"),
        F.count_if(F.col("end_reason") == "confirmed_movement").alias("pending_transitions_started"),
        F.count_if(F.col("from_no").isNotNull()).alias("transitions_confirmed"),
        F.count_if(pending & gap & ~disc).alias("transitions_cancelled_gap"),
        F.count_if(pending & disc).alias("transitions_cancelled_discontinuity"),
        F.count_if(pending & ~gap & ~disc).alias("transitions_unresolved_eof"),
    ]


def _accounted(counted: DataFrame) -> DataFrame:
    return counted.withColumns({
        "departure_candidate_unaccounted": F.col("departure_candidate_sequences") - F.col("departure_candidates_returned_inside") - F.col("departure_candidate_window_expired") - F.col("departures_confirmed") - F.col("departure_candidates_cancelled_gap") - F.col("departure_candidates_cancelled_discontinuity") - F.col("departure_candidates_cancelled_eof"),
        "pending_transition_unaccounted": F.col("pending_transitions_started") - F.col("transitions_confirmed") - F.col("transitions_cancelled_gap") - F.col("transitions_cancelled_discontinuity") - F.col("transitions_unresolved_eof"),
    })


def decisions(folded: DataFrame, *by: str) -> DataFrame:
    """Counters of what the state machine decided, by the given columns."""
    return _accounted(folded.groupBy(*by).agg(*_counters()))


def support_by(rows: DataFrame, *key: str) -> DataFrame:
    """Accuracy class of each group of rows by what is known in it."""
    counted = rows.groupBy(*key).agg(F.count("ha").alias("known"), F.count("*").alias("n"))
    return counted.select(X.support_class(F.col("known"), F.col("n") - F.col("known")).alias("class"))


def entities(folded: DataFrame, presence: DataFrame) -> DataFrame:
    """One row for each entity: totals and the counters of its decisions."""
    joined = _accounted(_per_entity(folded, *_counters())).join(_presence_totals(presence), "entity_id", "left")
    return joined.select(
        "entity_id", "subject", X.millis(F.col("a.ts_s"), F.col("a.ts_ns")).alias("first_seen"), X.millis(F.col("z.ts_s"), F.col("z.ts_ns")).alias("last_seen"),
        X.seconds_between(F.col("a.ts_s"), F.col("a.ts_ns"), F.col("z.ts_s"), F.col("z.ts_ns")).alias("coverage_s"), "observation_count", F.lit(1).cast("long").alias("track_count"), "segment_count",
        *_zero("presence_count", "transition_count", "stay_count", "dwell_count"), "gap_count", "discontinuity_count", F.col("observed_path_m").alias("total_observed_path_m"),
        *_zero("total_presence_s", "total_dwell_s", "unique_presence_locations"), "unique_geohash_cells", F.lit(None).cast("long").alias("unique_h3_cells"), "median_ha_m", "observations_with_ha", "observations_without_ha",
        X.coverage_pct(F.col("observations_with_ha"), F.col("observation_count")).alias("ha_coverage_pct"), X.support_class(F.col("observations_with_ha"), F.col("observations_without_ha")).alias("ha_class"),
        F.col("a.lat").alias("start_lat"), F.col("a.lon").alias("start_lon"), F.col("z.lat").alias("end_lat"), F.col("z.lon").alias("end_lon"), no_cell("start_h3_cell"), no_cell("end_h3_cell"),
        "same_timestamp_collapsed", "presence_end_gap", "presence_end_discontinuity", "presence_end_confirmed_movement", "departure_candidate_sequences", "departure_candidate_window_expired",
        "departure_candidates_cancelled_gap", "departure_candidates_cancelled_discontinuity", "departure_candidates_cancelled_eof", "departure_candidate_unaccounted", "enter_suppressed_no_pending_transition",
        "departures_confirmed", "pending_transitions_started", "transitions_confirmed", "transitions_cancelled_gap", "transitions_cancelled_discontinuity", "transitions_unresolved_eof", "pending_transition_unaccounted",
        F.lit(EVENTIZER_VERSION).alias("eventizer_version"),
    )
