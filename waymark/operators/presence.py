"""Presence detection: the one order-dependent step, and what follows from it.

Presence is decided by a state machine with a fixed anchor, which window frames cannot express. A continuity break resets the
machine, so it runs over stretches between breaks (entity, run): a busy entity is spread over as many tasks as it has
stretches. Rows stream through in order with a state of fixed size, so no stretch needs to fit in memory. Everything else
(intervals, transitions, assignment) is joins and aggregates in Spark's own engine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import asin, cos, radians, sin, sqrt

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.config import Config
from waymark.functions import expressions as X
from waymark.operators import normalize as N

_NEEDED = ("entity_id", "run", "idx", "ts_s", "ts_ns", "lat", "lon", "ha", "run_ends", "cum_path_m", "cum_known")
#: What intervals and transitions need beside it, and what only the machine reads.
_OF_PRESENCE = ("source_row", "segment_index", "next_gap", "next_discontinuity")
_MACHINE_ONLY = ("run_ends", "cum_path_m", "cum_known")
#: Columns that follow from the others of their row; they do not go through Python but are made anew where a plan asks for them.
_FOLLOWS = frozenset((*N.LABELS, *N.IDENTIFIERS))
_MADE = pa.schema([
    ("decision", pa.string()), ("phase_after", pa.string()), ("candidates_after", pa.int32()), ("pending_after", pa.bool_()),
    ("member_no", pa.int32()), ("seen_no", pa.int32()), ("opens_no", pa.int32()), ("start_reason", pa.string()),
    ("from_no", pa.int32()), ("depart_idx", pa.int64()), ("depart_cum_path_m", pa.float64()), ("depart_cum_known", pa.int64()), ("dest_cum_path_m", pa.float64()), ("dest_cum_known", pa.int64()),
    ("closes_no", pa.int32()), ("end_reason", pa.string()),
    ("candidate_started", pa.bool_()), ("candidate_returned", pa.bool_()), ("candidate_expired", pa.bool_()), ("candidate_outside", pa.bool_()), ("candidate_open_at_end", pa.bool_()),
])
#: Of these what intervals and transitions are made of.
_DECIDES = ("member_no", "opens_no", "start_reason", "from_no", "depart_idx", "depart_cum_path_m", "depart_cum_known", "dest_cum_path_m", "dest_cum_known", "closes_no", "end_reason")
_DDL = dict(string="string", int32="int", int64="long", double="double", bool="boolean")


class Machine:
    """The state between two rows of one stretch. `step` takes a row and returns what it decides."""

    __slots__ = ("cfg", "phase", "anchor", "reason", "no", "last", "candidate", "pending")

    def __init__(self, cfg: Config):
        self.cfg = cfg
        self.phase, self.anchor, self.reason, self.no = "seeking", None, "", 0
        self.last = self.candidate = self.pending = None

    def start(self, row: tuple, run: int) -> dict:
        self.phase, self.anchor, self.reason, self.no = "seeking", row, "continuity_reset" if run else "dataset_start", 0
        self.last = self.candidate = self.pending = None
        return {"decision": "continuity_break" if run else "dataset_start"}

    def within(self, row: tuple) -> bool:
        _, _, _, lat1, lon1, ha1, *_ = self.anchor
        _, _, _, lat2, lon2, ha2, *_ = row
        a, b = sin(radians(lat2 - lat1) / 2), sin(radians(lon2 - lon1) / 2)
        h = a * a + cos(radians(lat1)) * cos(radians(lat2)) * b * b
        raw = 2 * X.EARTH_RADIUS_M * asin(min(1.0, sqrt(h)))
        return max(0.0, raw - (ha1 or 0.0) - (ha2 or 0.0)) <= self.cfg.move_radius_m

    def leave(self, row: tuple, out: dict) -> None:
        out |= {"closes_no": self.no, "end_reason": "confirmed_movement"}
        self.pending = (self.no, self.last)
        self.phase, self.anchor, self.reason, self.candidate = "seeking", row, "movement_arrival", None

    def step(self, row: tuple) -> dict:
        if self.phase == "seeking":
            return self._seek(row)
        out: dict = {}
        if self.within(row):
            out["decision"] = "departure_candidate_returned_inside" if self.candidate else "presence_inside"
            out["candidate_returned"] = self.candidate is not None
            out["member_no"], self.last, self.candidate = self.no, row, None
        elif not self.cfg.confirm_moves:
            out["decision"] = "departure_confirmed_unconfirmed_mode"
            self.leave(row, out)
        else:
            out["candidate_outside"] = True
            if self.candidate is None:
                out |= {"decision": "departure_candidate_started", "candidate_started": True}
                self.candidate = row
            elif (row[1] - self.candidate[1]) + (row[2] - self.candidate[2]) / 1e9 > self.cfg.confirm_window_s:
                out |= {"decision": "departure_candidate_window_expired_restart", "candidate_started": True, "candidate_expired": True}
                self.candidate = row
            else:
                out["decision"] = "departure_confirmed"
                self.leave(row, out)
        return out

    def _seek(self, row: tuple) -> dict:
        if not self.within(row):
            self.anchor = row
            self.reason = "movement_arrival" if self.pending else "candidate_presence"
            return {"decision": "presence_candidate_reanchored"}
        self.no += 1
        self.phase, self.last = "present", row
        out = {"member_no": self.no, "opens_no": self.no, "start_reason": self.reason, "decision": f"presence_confirmed_{self.reason}"}
        if self.reason == "movement_arrival" and self.pending:
            origin, depart = self.pending
            out |= {"decision": "presence_confirmed_arrival_transition", "from_no": origin, "depart_idx": depart[0], "depart_cum_path_m": depart[6], "depart_cum_known": depart[7]}
            out |= {"dest_cum_path_m": self.anchor[6], "dest_cum_known": self.anchor[7]}
            self.pending = None
        elif self.reason in ("movement_arrival", "candidate_presence"):
            out["decision"] = "presence_confirmed_enter_suppressed"
        return out

    def end(self, out: dict) -> None:
        """The stretch ends after the row of `out`: an open presence closes there. Why it ends is known to the row itself."""
        if self.phase == "present":
            out |= {"closes_no": self.no, "end_reason": "run_end", "candidate_open_at_end": self.candidate is not None}


def _values(column: pa.Array) -> list:
    return column.to_pylist() if column.null_count or not pa.types.is_primitive(column.type) or pa.types.is_boolean(column.type) else column.to_numpy(zero_copy_only=False).tolist()


def fold(rows: DataFrame, cfg: Config, keep: Callable[[DataFrame], DataFrame] = lambda df: df, reads: tuple[str, ...] | None = None) -> DataFrame:
    """`rows`, as normalized and identified, with the decision of each row. `keep` may persist what Python returns.

    `reads` names what a plan reads beside the columns of intervals and transitions: only these go through Python, with identifiers made
    after it. With no name in it rows that are in no presence and close none are left out. Catalyst cannot find either by itself.

    seen_no is the last presence that has a member at or before the row. The anchor of a presence is the row before the one that
    confirms it, so a batch is given out when the first row of the next one is known.
    """
    kept = [c for c in rows.columns if c not in _FOLLOWS and (reads is None or c in (*_NEEDED, *_OF_PRESENCE, *reads))]
    passed = [c for c in kept if reads is None or c in reads or c not in _MACHINE_ONLY]
    told = [f for f in _MADE if reads is None or f.name in _DECIDES or f.name in reads]
    presences_alone = reads is not None and not reads
    narrow = rows.select(*kept)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, for the size of the shuffle does not tell what Python takes
    ordered = narrow.repartition(tasks, F.col("entity_id"), F.col("run")).sortWithinPartitions("entity_id", "run", "idx")
    typed = ", ".join([*[f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in passed], *[f"{f.name} {_DDL[str(f.type)]}" for f in told]])

    def run_machine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, key = Machine(cfg), None
        held: tuple[pa.RecordBatch, dict[str, list]] | None = None

        def given(batch: pa.RecordBatch, made: dict[str, list]) -> pa.RecordBatch:
            out = pa.record_batch([*[batch.column(kept.index(c)) for c in passed], *[pa.array(made[f.name], f.type) for f in told]], names=[*passed, *[f.name for f in told]])
            return out.filter(pc.or_(out.column("member_no").is_valid(), out.column("closes_no").is_valid())) if presences_alone else out

        for batch in batches:
            if not batch.num_rows:
                continue
            made: dict[str, list] = {n: [None] * batch.num_rows for n in _MADE.names}
            members, seen, phases, candidates, pendings = (made[n] for n in ("member_no", "seen_no", "phase_after", "candidates_after", "pending_after"))
            columns = [_values(batch.column(kept.index(c))) for c in _NEEDED]
            for i, (entity, run, idx, s, ns, lat, lon, ha, ends, path, known) in enumerate(zip(*columns)):
                row = (idx, s, ns, lat, lon, ha, path, known)
                if (entity, run) != key:
                    key = (entity, run)
                    out = machine.start(row, run)
                else:
                    out = machine.step(row)
                    if "opens_no" in out:  # the anchor is a member, too
                        at, before = (i - 1, made) if i else (-1, held[1])
                        before["member_no"][at] = before["seen_no"][at] = machine.no
                phases[i], candidates[i], pendings[i] = machine.phase, int(machine.candidate is not None), machine.pending is not None
                seen[i] = machine.no or None
                if ends:
                    machine.end(out)
                for n, v in out.items():
                    made[n][i] = v
            if held:
                yield given(*held)
            held = (batch, made)
        if held:
            yield given(*held)

    folded = keep(ordered.mapInArrow(run_machine, typed))
    why = F.when(F.col("end_reason") != "run_end", F.col("end_reason")).when(F.col("end_reason").isNull(), F.lit(None)).when(F.col("next_discontinuity"), "discontinuity").when(F.col("next_gap"), "gap").otherwise("dataset_end")
    folded = folded.withColumn("end_reason", why)
    return N.identify(N.label(folded, cfg) if reads is None else folded, cfg)


def intervals(folded: DataFrame, cfg: Config, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """One row for each presence, keyed by (entity_id, run, no): members from the anchor to the last inside, centroid, scatter, radii, reasons.

    Texts and identifiers are made of the first and last members alone. `keep` may persist the rows; further identifiers follow from them.
    Members and the row that closes a presence meet in one shuffle, where their order by radius gives the median. from_no is the presence
    before a confirmed arrival; observations, path and known radii of the way from it, to the anchor, are counted by the confirming row.
    """
    key = ["entity_id", "run", "no"]
    by_radius = Window.partitionBy(*key).orderBy(F.col("ha").asc_nulls_last())
    of_presence = by_radius.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x, y, z = X.ecef(F.col("lat"), F.col("lon"))
    edge = ("idx", "ts_s", "ts_ns", "lat", "lon", "ha", "source_row")
    way = {"way_count": F.col("idx") - F.col("depart_idx"), "way_path_m": F.col("dest_cum_path_m") - F.col("depart_cum_path_m"), "way_known": F.col("dest_cum_known") - F.col("depart_cum_known")}
    part = lambda no, ends: F.struct(F.col(no).alias("no"), ends.cast("string").alias("ends"))
    parts = folded.withColumns({**way, "_part": F.explode(F.array(part("member_no", F.lit(None)), part("closes_no", F.col("end_reason"))))}).where("_part.no is not null")
    member = F.col("_part.ends").isNull()
    rows = parts.select("entity_id", "run", F.col("_part.no").alias("no"), F.col("_part.ends").alias("end_reason"), "segment_index", *[F.when(member, F.col(c)).alias(c) for c in (*edge, "start_reason", "from_no", *way)])
    placed = rows.withColumns({"_x": F.avg(x).over(of_presence), "_y": F.avg(y).over(of_presence), "_z": F.avg(z).over(of_presence), "_nth": F.row_number().over(by_radius), "_known": F.count("ha").over(of_presence)})
    lat, lon = X.centroid(F.col("_x"), F.col("_y"), F.col("_z"))
    placed = placed.withColumns({"centroid_lat": lat, "centroid_lon": lon}).withColumns({
        "_away": X.distance_m(F.col("centroid_lat"), F.col("centroid_lon"), F.col("lat"), F.col("lon")),
        "_middle": F.when((2 * F.col("_nth")).between(F.col("_known"), F.col("_known") + 2), F.col("ha")),
        "_edge": F.when(F.col("end_reason").isNull(), F.struct(*edge)),
    })
    made = placed.groupBy(*key).agg(
        F.max("segment_index").alias("segment_index"), F.min("_edge").alias("a"), F.max("_edge").alias("z"),
        F.first("centroid_lat").alias("centroid_lat"), F.first("centroid_lon").alias("centroid_lon"),
        F.count("_edge").alias("observation_count"), F.max("_away").alias("scatter_m"),
        (F.min("_middle") * 0.5 + F.max("_middle") * 0.5).alias("median_ha_m"), F.min("ha").alias("min_ha_m"), F.max("ha").alias("max_ha_m"),
        F.count("ha").alias("observations_with_ha"), F.first("start_reason", True).alias("start_reason"), F.max("end_reason").alias("end_reason"),
        *[F.max(c).alias(c) for c in ("from_no", *way)],
    )
    first = X.stable_id("fix", F.col("entity_id"), X.rfc3339(F.col("a.ts_s"), F.col("a.ts_ns")), X.spelled(F.col("a.lat"), F.col("a.lon"), F.col("a.ha")))
    made = N.identify_entity(made, cfg).withColumn("first_fix", first).withColumns({
        "presence_interval_id": X.stable_id("prs", F.col("track_id"), F.col("first_fix")),
        "duration_s": X.seconds_between(F.col("a.ts_s"), F.col("a.ts_ns"), F.col("z.ts_s"), F.col("z.ts_ns")),
        "observations_without_ha": F.col("observation_count") - F.col("observations_with_ha"),
        "entered": F.col("from_no").isNotNull(),
    })
    made = keep(made)
    side = lambda e: F.struct(*[F.col(f"{e}.{c}").alias(c) for c in edge], X.rfc3339(F.col(f"{e}.ts_s"), F.col(f"{e}.ts_ns")).alias("ts_text"), X.ha_state(F.col(f"{e}.ha")).alias("ha_state"), X.geohash(F.col(f"{e}.lat"), F.col(f"{e}.lon"), cfg.geohash_precision).alias("geohash"))
    made = made.withColumns({"a": side("a"), "z": side("z")})
    kind = F.when(F.col("duration_s") >= cfg.dwell_threshold_s, "dwell").otherwise("stay")
    made = made.withColumns({
        "classification": kind,
        "ha_coverage_pct": X.coverage_pct(F.col("observations_with_ha"), F.col("observation_count")),
        "accuracy_support": X.support_class(F.col("observations_with_ha"), F.col("observations_without_ha")),
        "left": F.col("end_reason") == "confirmed_movement",
    })
    source, subject = F.lit(cfg.source), F.col("subject")
    return made.withColumns({
        "interval_event_id": X.stable_id("evt", source, subject, F.upper("classification"), F.col("a.ts_text"), F.col("z.ts_text"), F.col("presence_interval_id")),
        "enter_event_id": F.when(F.col("entered"), X.stable_id("evt", source, subject, F.lit("ENTER"), F.col("a.ts_text"), F.col("segment_id"), F.col("first_fix"))).otherwise(F.lit("")),
        "leave_event_id": F.when(F.col("left"), X.stable_id("evt", source, subject, F.lit("LEAVE"), F.col("z.ts_text"), F.col("presence_interval_id"))).otherwise(F.lit("")),
    })


def transitions(presence: DataFrame) -> DataFrame:
    """One row for each arrival confirmed after a confirmed departure in the same stretch, from the last row inside the origin to the anchor of the destination."""
    support = ["observations_with_ha", "observations_without_ha", "ha_coverage_pct", "accuracy_support"]
    origin = presence.select("entity_id", "run", F.col("no").alias("from_no"), F.col("presence_interval_id").alias("origin_presence_id"), F.col("z").alias("depart"), F.col("centroid_lat").alias("origin_lat"), F.col("centroid_lon").alias("origin_lon"), *[F.col(c).alias(f"origin_{c}") for c in support])
    target = presence.where("from_no is not null").select("entity_id", "run", "from_no", F.col("way_count").alias("observation_count"), F.col("way_path_m").alias("observed_path_distance_m"), F.col("way_known").alias("_known_after"), "track_id", "segment_id", F.col("presence_interval_id").alias("destination_presence_id"), F.col("a").alias("arrive"), *[F.col(c).alias(f"destination_{c}") for c in support])
    joined = target.join(origin, ["entity_id", "run", "from_no"])
    known = F.col("_known_after") + F.col("depart.ha").isNotNull().cast("int")
    joined = joined.withColumns({
        "transition_id": X.stable_id("trn", F.col("track_id"), F.col("origin_presence_id"), F.col("destination_presence_id")),
        "duration_s": X.seconds_between(F.col("depart.ts_s"), F.col("depart.ts_ns"), F.col("arrive.ts_s"), F.col("arrive.ts_ns")),
        "straight_line_distance_m": X.distance_m(F.col("origin_lat"), F.col("origin_lon"), F.col("arrive.lat"), F.col("arrive.lon")),
        "observations_with_ha": known.cast("long"),
        "observations_without_ha": (F.col("observation_count") - known).cast("long"),
    })
    return joined.withColumns({
        "ha_coverage_pct": X.coverage_pct(F.col("observations_with_ha"), F.col("observation_count")),
        "accuracy_support": X.support_class(F.col("observations_with_ha"), F.col("observations_without_ha")),
    }).drop("_known_after")


def assign(folded: DataFrame, presence: DataFrame, cfg: Config) -> DataFrame:
    """`folded` with presence_interval_id: rows between a presence's first and last member, near enough to its centroid; else empty."""
    known = presence.select("entity_id", "run", F.col("no").alias("seen_no"), F.col("z.idx").alias("_last"), F.col("presence_interval_id").alias("_id"), F.col("centroid_lat").alias("_lat"), F.col("centroid_lon").alias("_lon"))
    near = X.distance_m(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")) <= F.lit(cfg.move_radius_m) + F.coalesce("ha", F.lit(0.0))
    joined = folded.join(known, ["entity_id", "run", "seen_no"], "left")
    inside = F.col("_id").isNotNull() & (F.col("idx") <= F.col("_last")) & near
    return joined.withColumn("presence_interval_id", F.when(inside, F.col("_id")).otherwise(F.lit(""))).drop("_id", "_last", "_lat", "_lon")
