"""Presence on streams: windowed counts by watermark, and the same state machine as in batch, one state for each entity.

Rows may come late within the watermark: each entity keeps its rows until the watermark has passed them, then runs them in order
of time. The state holds those rows and the machine, so it is bounded by what arrives within the delay.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from waymark.config import Config
from waymark.functions import expressions as X
from waymark.operators.presence import Machine

OUTPUT = "entity_id string, ts timestamp, lat double, lon double, kind string, decision string"
STATE = "kept string"
_KINDS = {"departure_confirmed": "LEAVE", "departure_confirmed_unconfirmed_mode": "LEAVE", "presence_confirmed_arrival_transition": "ENTER"}


def windowed_counts(observations: DataFrame, cfg: Config, window: str = "10 minutes", delay: str = "30 minutes") -> DataFrame:
    """Observations and entities (approximate) by tumbling window and geohash cell; rows later than the watermark are left out."""
    cell = X.geohash(F.col("lat"), F.col("lon"), cfg.geohash_precision)
    counted = observations.withWatermark("ts", delay).withColumn("cell", cell).groupBy(F.window("ts", window).alias("w"), "cell").agg(F.count("*").alias("observation_count"), F.approx_count_distinct("entity_id").alias("entity_count"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "cell", "observation_count", "entity_count")


def sessions(observations: DataFrame, cfg: Config, delay: str = "30 minutes") -> DataFrame:
    """Sessions of each entity that end after a gap: a cross-check of gap breaks."""
    grouped = observations.withWatermark("ts", delay).groupBy("entity_id", F.session_window("ts", f"{int(cfg.gap_threshold_s)} seconds").alias("s")).agg(F.count("*").alias("observation_count"))
    return grouped.select("entity_id", F.col("s.start").alias("start_ts"), F.col("s.end").alias("end_ts"), "observation_count")


class _Kept:
    """What an entity keeps between batches, as JSON: rows not run yet, the last row run, the machine."""

    def __init__(self, text: str | None):
        self.rows, self.last, self.machine = json.loads(text) if text else ([], None, None)

    def text(self, machine: Machine | None) -> str:
        fields = None if machine is None else [machine.phase, machine.anchor, machine.reason, machine.no, machine.last, machine.candidate, machine.pending]
        return json.dumps([self.rows, self.last, fields])

    def revive(self, cfg: Config) -> Machine:
        machine = Machine(cfg)
        if self.machine:
            phase, anchor, reason, no, last, candidate, pending = self.machine
            machine.phase, machine.reason, machine.no = phase, reason, no
            machine.anchor, machine.last, machine.candidate = (tuple(x) if x else None for x in (anchor, last, candidate))
            machine.pending = (pending[0], tuple(pending[1])) if pending else None
        return machine


def _advance(kept: _Kept, machine: Machine, upto_ms: int, cfg: Config) -> list[tuple]:
    """Runs the rows up to a time and returns (us, lat, lon, kind, decision) of each."""
    import math

    due = sorted((r for r in kept.rows if r[0] // 1000 <= upto_ms), key=lambda r: (r[0], r[3] is None, r[3] or 0, r[1], r[2]))
    kept.rows = [r for r in kept.rows if r[0] // 1000 > upto_ms]
    out = []
    for us, lat, lon, ha in due:
        if kept.last and kept.last[0] >= us:
            continue  # the best row of an instant stays; later duplicates go
        row = (kept.last[4] + 1 if kept.last else 1, us // 1000000, us % 1000000 * 1000, lat, lon, ha, 0.0, 0)
        kind = "START"
        if kept.last is None:
            decided = machine.start(row, 0)
        else:
            p_us, p_lat, p_lon, p_ha, _ = kept.last
            a, b = math.sin(math.radians(lat - p_lat) / 2), math.sin(math.radians(lon - p_lon) / 2)
            raw = 2 * X.EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(a * a + math.cos(math.radians(p_lat)) * math.cos(math.radians(lat)) * b * b)))
            dt, eff = (us - p_us) / 1e6, max(0.0, raw - (p_ha or 0.0) - (ha or 0.0))
            gap, jump = dt > cfg.gap_threshold_s, eff > cfg.max_jump_m or (dt > 0 and eff / dt > cfg.max_speed_mps)
            if gap or jump:
                decided, kind = machine.start(row, 1), "DISCONTINUITY" if jump else "GAP"
            else:
                decided = machine.step(row)
                kind = _KINDS.get(decided["decision"], "")
        kept.last = [us, lat, lon, ha, row[0]]
        out.append((us, lat, lon, kind, decided["decision"]))
    return out


def presence_decisions(observations: DataFrame, cfg: Config, delay: str = "30 minutes") -> DataFrame:
    """The machine's decision for each row of a stream (entity_id, ts, lat, lon, ha), emitted when the watermark has passed it."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = _Kept(state.get[0] if state.exists else None)
        machine = kept.revive(cfg)
        for batch in batches:
            us = (batch["ts"].astype("int64") // (1000 if str(batch["ts"].dtype).startswith("datetime64[ns") else 1)).tolist()
            kept.rows += [[t, a, b, None if pd.isna(h) else h] for t, a, b, h in zip(us, batch["lat"].tolist(), batch["lon"].tolist(), batch["ha"].tolist())]
        mark = state.getCurrentWatermarkMs()
        out = _advance(kept, machine, mark, cfg)
        state.update((kept.text(machine if kept.last else None),))
        if kept.rows:
            state.setTimeoutTimestamp(max(mark + 1, min(r[0] for r in kept.rows) // 1000 + 1))
        if out:
            yield pd.DataFrame({"entity_id": key[0], "ts": pd.to_datetime([o[0] for o in out], unit="us"), "lat": [o[1] for o in out], "lon": [o[2] for o in out], "kind": [o[3] for o in out], "decision": [o[4] for o in out]})

    marked = observations.withWatermark("ts", delay)
    return marked.groupBy("entity_id").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
