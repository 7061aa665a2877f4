"""From a CSV file to a dataset: ingest, eventize, write the layers, the event stream, diagnostics and the manifest."""

from __future__ import annotations

import json
import os
import time
from datetime import UTC, datetime
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from waymark.config import ANALYSIS_CONTRACT, EVENTIZER_VERSION, PRODUCER, PROFILE_ID, VERSION, WIRE_VERSION, Config
from waymark.operators import conformance as C
from waymark.operators import diagnostics as D
from waymark.operators import events as E
from waymark.operators import presence as P
from waymark.operators.layers import Layers, decisions
from waymark.sources import sinks as S
from waymark.sources.csv_input import read_observations

NOTES = (
    "Events are in canonical/events.jsonl; Parquet files are analytical projections of them and of the observations.",
    "Spatial layers follow GeoParquet 1.1.0 with WKB geometry in longitude and latitude.",
    "H3 columns are null: no H3 library is part of this build, and cells are never made up.",
    "A gap does not end a segment; steps over gaps are left out of path lengths.",
    "Quantiles of step distributions are exact.",
    "Diagnostics describe decisions; they change no threshold and no event.",
    "A missing radius of uncertainty stays missing; only known radii are subtracted from distances.",
    "ENTER needs a confirmed departure before it and stable presence after it.",
)


def _input_bytes(path: str) -> int:
    return os.path.getsize(path) if os.path.isfile(path) else 0


def eventize(spark: SparkSession, path: str, out: str, cfg: Config) -> dict[str, Any]:
    """Writes the dataset and returns its manifest.

    Normalized and folded rows are kept on disk or in memory for the run, as all layers start from them. Old output goes only
    after the input was read. Events that break a rule of the format stop the run before anything is written.
    """
    cfg = cfg.validate()
    S.guard(out, cfg)
    begun, phases = time.time(), {}

    def phase(name: str, start: float) -> None:
        phases[name] = round(time.time() - start, 3)

    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MILLIS")
    at = time.time()
    ingested = read_observations(spark, path, cfg)
    ingested.rows = ingested.rows.persist(StorageLevel.MEMORY_AND_DISK)
    blank = F.col("ha") == ""
    totals = ingested.rows.agg(F.count("*").alias("input_rows"), F.count_if(F.col("reject_code").isNull()).alias("valid_rows"), F.count_if(F.col("reject_code").isNotNull()).alias("rejected_rows"), F.count_if(F.col("parse_ok") & blank).alias("input_ha_missing_rows"), F.count_if(F.col("parse_ok") & ~blank).alias("input_ha_present_rows"), F.count_if(F.expr("reject_code is null and ha_value is not null")).alias("accepted_with_ha")).first().asDict()
    reasons = {r[0]: r[1] for r in ingested.rows.where("reject_code is not null").groupBy("reject_code").count().collect()}
    phase("ingest", at)
    at = time.time()
    layers = Layers(ingested.accepted, cfg, geometry=True, keep=True)
    layers.normalized = layers.folded
    stream = E.stream(layers.normalized, layers.folded, layers.presence, cfg).persist(StorageLevel.MEMORY_AND_DISK)
    lines = E.canonical(stream, cfg)
    broken = C.errors(C.parse(lines)).select("event_id", "error").head(1)
    if broken:
        raise ValueError(f"event {broken[0]['event_id']} does not conform: {broken[0]['error']}")
    phase("eventize", at)
    at = time.time()
    os.makedirs(out, exist_ok=True)
    S.clear(out)
    S.write_rejects(ingested.rejects, out)
    names = ["observations", "events", "presence_intervals", "transitions", "segments", "entities"] + ["tracks"] * (cfg.output_profile == "full")
    files = {name: S.parquet_stats(S.write_layer(getattr(layers, name), out, name, cfg)) for name in names}
    S.write_events_jsonl(lines, out)
    phase("write", at)
    at = time.time()
    traced: list[str] = []
    if cfg.trace_ids:
        closed = layers.presence.select("entity_id", "run", F.col("no").alias("closes_no"), F.upper("classification").alias("closed_kind"))
        chosen = layers.folded.where(F.col("entity_id").isin(*cfg.trace_ids))
        assigned = P.assign(chosen, layers.presence, cfg).join(closed, ["entity_id", "run", "closes_no"], "left")
        traced = S.write_traces(S.traces(assigned), out, cfg.trace_ids)
    steps = D.steps(layers.normalized, cfg)
    entity_count = files["entities"]["rows"]
    rows = files["observations"]["rows"]
    known = layers.normalized.agg(F.count("ha"), F.sum("sample_count")).first()
    kinds = {r[0]: r[1] for r in stream.groupBy("event_type").count().collect()}
    table = lambda df: [r.asDict() for r in df.collect()]
    decided = decisions(layers.folded)
    diagnostics = {
        "counters": decided.first().asDict(), "edges": D.edge_totals(steps).first().asDict(), "edges_by_accuracy": table(D.edge_totals(steps, "step_accuracy_state")), "departures_by_accuracy": table(decisions(layers.folded, "step_accuracy_state").select("step_accuracy_state", "departure_candidate_sequences", "departures_confirmed")),
        "transitions_by_support": table(layers.moves.groupBy("accuracy_support").count()), "presence_by_support": table(layers.presence.groupBy("accuracy_support").count()), "entities_by_support": table(layers.entities.groupBy("ha_class").count()), "segments_by_support": table(layers.segments.groupBy("accuracy_support").count()),
        "closure": D.closure(steps, decided, rows, entity_count),
        "step_distributions": table(D.distributions(steps)), "edge_dt_bands": table(D.edge_bands(steps)), "discontinuity_cube": table(D.discontinuity_cube(steps)), "speed_only": table(D.speed_only_matrix(steps)), "speed_only_distances": table(D.speed_only_distances(steps)),
        "target_population": {c: {str(r[0]): r[1] for r in D.target_population(steps).groupBy(c).count().collect()} for c in ("bearing_16", "distance_1m", "vector_10m", "previous_precision", "precision", "precision_transition")}, "reversals": D.reversals(steps).first().asDict(),
        "target_distributions": table(D.target_distributions(D.target_population(steps))), "target_cross_tabs": table(D.target_cross_tabs(D.target_population(steps))), "precision_triplets": table(D.precision_triplets(steps)),
    }
    phase("diagnose", at)
    elapsed = time.time() - begun
    stats = totals | {
        "reject_reasons": reasons, "normalized_rows": rows, "same_timestamp_collapsed": int((known[1] or 0) - rows), "entity_count": entity_count, "event_count": sum(kinds.values()), "events_by_type": kinds, "segment_count": files["segments"]["rows"], "presence_count": files["presence_intervals"]["rows"],
        "transition_count": files["transitions"]["rows"], "gap_count": kinds.get("GAP", 0), "discontinuity_count": kinds.get("DISCONTINUITY", 0), "normalized_ha_coverage_pct": 100 * known[0] / rows if rows else 0.0, "parquet": files, "diagnostics": diagnostics, "trace_files": traced,
        "performance": {"elapsed_s": round(elapsed, 3), "rows_per_s": totals["input_rows"] / elapsed, "events_per_s": sum(kinds.values()) / elapsed, "phases_s": phases, "master": spark.sparkContext.master, "spark_version": spark.version},
    }
    manifest = {
        "tool": PRODUCER, "tool_version": VERSION, "eventizer": EVENTIZER_VERSION, "event_model_wire": WIRE_VERSION, "mobility_profile": PROFILE_ID, "analysis_contract": ANALYSIS_CONTRACT, "created_utc": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "input": os.path.basename(path), "source": cfg.source,
        "config": cfg.as_dict(), "h3_available": False, "stats": stats, "storage": S.storage(out, _input_bytes(path), rows), "canonical": ["canonical/events.jsonl"], "analysis": [f"analysis/{n}.parquet" for n in names], "rejects": "rejects.csv", "traces": traced, "notes": list(NOTES),
    }
    with open(os.path.join(out, "manifest.json"), "w", encoding="utf-8") as f:
        json.dump(manifest, f, indent=2, default=str)
    layers.release()
    for df in (stream, ingested.rows):
        df.unpersist()
    return manifest
