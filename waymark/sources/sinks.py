"""Writing a dataset: Parquet layers with file metadata, the event stream, rejects, traces, the manifest."""

from __future__ import annotations

import csv
import hashlib
import json
import os
import shutil
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.config import ANALYSIS_CONTRACT, EVENTIZER_VERSION, Config
from waymark.functions import expressions as X

GEOMETRY_TYPES = {"observations": ["Point"], "events": ["Point"], "tracks": ["Point", "LineString", "MultiLineString"], "segments": ["Point", "LineString", "MultiLineString"], "presence_intervals": ["Point"], "transitions": ["LineString"]}
SORT = {"observations": ("entity_id", "ts"), "events": ("entity_id", "event_time"), "presence_intervals": ("entity_id", "start_ts"), "transitions": ("entity_id", "depart_ts"), "segments": ("entity_id", "segment_index"), "tracks": ("entity_id",), "entities": ("entity_id",)}
KNOWN = ("canonical", "analysis", "diagnostics", "rejects.csv", "manifest.json")
TRACE_COLUMNS = (
    "entity_id", "observation_index", "source_row", "ts", "lat", "lon", "ha_m", "ha_state", "step_accuracy_state", "sample_count", "segment_id", "presence_interval_id", "step_dt_s", "step_distance_m", "effective_distance_m", "implied_speed_mps",
    "is_gap", "is_discontinuity", "phase_before", "phase_after", "move_candidates_before", "move_candidates_after", "pending_transition_before", "pending_transition_after", "decision", "events_emitted", "detail",
)


def guard(out: str, cfg: Config) -> None:
    """A folder that holds anything is only written to if replacing is allowed."""
    if os.path.isdir(out) and os.listdir(out) and not cfg.replace_output:
        raise FileExistsError(f"output folder {out} is not empty")


def clear(out: str) -> None:
    """Removes what a run writes, and nothing else. Called only after the input was read without error."""
    for name in KNOWN:
        path = os.path.join(out, name)
        if os.path.isdir(path):
            shutil.rmtree(path)
        elif os.path.exists(path):
            os.remove(path)


def file_metadata(name: str, cfg: Config) -> dict[str, str]:
    # The keys of the files' metadata.
    meta = {"xq:eventizer": EVENTIZER_VERSION, "xq:analysis_contract": ANALYSIS_CONTRACT, "xq:compression": cfg.parquet_compression, "xq:parquet_row_group_max_rows": str(cfg.parquet_row_group_rows), "xq:parquet_dictionary_max_bytes": str(cfg.parquet_dictionary_max_bytes), "xq:h3_resolution": str(cfg.h3_resolution), "xq:h3_library": "none", "xq:h3_library_version": "", "xq:h3_core_version": ""}
    if name in GEOMETRY_TYPES:
        meta["geo"] = json.dumps({"columns": {"geometry": {"encoding": "WKB", "geometry_types": GEOMETRY_TYPES[name]}}, "primary_column": "geometry", "version": "1.1.0"}, separators=(",", ":"))
    return meta


def stamp_file(path: str, meta: dict[str, str]) -> None:
    """Adds key-value metadata to a file, row group by row group; the new file takes the old one's place at once, so a repeated task does no harm."""
    source = pq.ParquetFile(path)
    codec = source.metadata.row_group(0).column(0).compression if source.metadata.num_row_groups else "SNAPPY"
    schema = source.schema_arrow.with_metadata({**(source.schema_arrow.metadata or {}), **{k.encode(): v.encode() for k, v in meta.items()}})
    with pq.ParquetWriter(path + ".new", schema, compression=codec if codec != "UNCOMPRESSED" else "NONE", coerce_timestamps="ms", allow_truncated_timestamps=True) as writer:
        for k in range(source.metadata.num_row_groups):
            writer.write_table(source.read_row_group(k).replace_schema_metadata(schema.metadata), row_group_size=max(1, source.metadata.row_group(k).num_rows))
    source.close()
    os.replace(path + ".new", path)
    checksum = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")
    if os.path.exists(checksum):
        os.remove(checksum)


def stamp(spark: SparkSession, folder: str, meta: dict[str, str]) -> None:
    """Adds key-value metadata to every file of a layer, which Spark's writer cannot: a task for each file, over the folder that all share."""
    paths = [os.path.join(os.path.abspath(folder), n) for n in sorted(os.listdir(folder)) if n.endswith(".parquet")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                stamp_file(path, meta)
            yield batch

    if paths:
        spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths)).mapInArrow(run, "path string").count()


def write_layer(df: DataFrame, out: str, name: str, cfg: Config) -> str:
    """One layer, sorted within files by entity and time so that row groups can be skipped."""
    path = os.path.join(out, "analysis", f"{name}.parquet")
    ordered = df.repartitionByRange(*[F.col(c) for c in SORT[name]]).sortWithinPartitions(*SORT[name])
    writer = ordered.write.mode("overwrite").option("compression", {"none": "uncompressed"}.get(cfg.parquet_compression, cfg.parquet_compression))
    writer.option("parquet.block.row.count.limit", cfg.parquet_row_group_rows).option("parquet.dictionary.page.size", max(1, cfg.parquet_dictionary_max_bytes)).parquet(path)
    stamp(df.sparkSession, path, file_metadata(name, cfg))
    return path


def write_events_jsonl(lines: DataFrame, out: str) -> str:
    """The event stream as JSON lines, in order of entity and sequence, in one folder of part files that follow each other."""
    path = os.path.join(out, "canonical", "events.jsonl")
    lines.repartitionByRange("entity_id", "seq").sortWithinPartitions("entity_id", "seq").select("value").write.mode("overwrite").text(path)
    return path


def write_rejects(rejects: DataFrame, out: str) -> str:
    path = os.path.join(out, "rejects.csv")
    rejects.repartitionByRange("source_row").sortWithinPartitions("source_row").write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return path


def trace_file_name(entity_id: str) -> str:
    """A name that any file system takes, and eight hexadecimal digits that tell entities apart."""
    safe = ""
    for c in entity_id:
        safe += c if c.isalpha() or c.isdecimal() or c in "-_." else "_"
        if len(safe.encode()) >= 64:
            break
    return f"{safe.strip('._-') or 'entity'}-{hashlib.sha256(entity_id.encode()).hexdigest()[:8]}.csv"


def traces(rows: DataFrame) -> DataFrame:
    """Decision traces, one row for each observation, from assigned rows with closed_kind, the type of the interval that ends with a row."""
    w = Window.partitionBy("entity_id").orderBy("idx")
    first = F.col("idx") == 1
    was = lambda c, empty: F.when(first, F.lit(empty)).otherwise(F.lag(c).over(w))
    phase_name = lambda c: F.when(c == "present", "present").otherwise("seeking")
    named = F.when(F.col("is_gap") & F.col("is_discontinuity"), "continuity_break_gap_discontinuity").when(F.col("is_discontinuity"), "continuity_break_discontinuity").when(F.col("is_gap"), "continuity_break_gap").otherwise(F.col("decision"))
    last = F.col("next_gap").isNull()
    at = {"ENTER": F.col("opens_no").isNotNull() & F.col("from_no").isNotNull(), "STAY_DWELL": F.col("end_reason") == "confirmed_movement"}
    emitted = F.concat_ws(
        ";", F.when(first, "START"), F.when(F.lag("end_reason").over(w).isin("gap", "discontinuity"), F.lag("closed_kind").over(w)), F.when(F.col("is_gap"), "GAP"), F.when(F.col("is_discontinuity"), "DISCONTINUITY"),
        F.when(at["ENTER"], "ENTER"), F.when(at["STAY_DWELL"], F.concat(F.col("closed_kind"), F.lit(";LEAVE"))), F.when(F.col("end_reason") == "dataset_end", F.col("closed_kind")), F.when(last, "END"))
    fixed = lambda c, n: F.format_string(f"%.{n}f", F.col(c))
    rows = rows.withColumn("_spelled", F.split(X.spelled(F.col("lat"), F.col("lon"), F.col("ha")), "\0"))
    spelled = lambda k: F.get("_spelled", F.lit(k))
    return rows.select(
        "entity_id", F.col("idx").alias("observation_index"), "source_row", F.col("ts_text").alias("ts"), spelled(0).alias("lat"), spelled(1).alias("lon"), F.when(F.col("ha").isNotNull(), spelled(2)).otherwise("").alias("ha_m"), "ha_state", "step_accuracy_state", "sample_count",
        "segment_id", "presence_interval_id", fixed("step_dt_s", 3).alias("step_dt_s"), fixed("step_distance_m", 3).alias("step_distance_m"), fixed("effective_distance_m", 3).alias("effective_distance_m"), fixed("implied_speed_mps", 6).alias("implied_speed_mps"), "is_gap", "is_discontinuity",
        F.when(first, "none").otherwise(phase_name(F.lag("phase_after").over(w))).alias("phase_before"), phase_name(F.col("phase_after")).alias("phase_after"), was("candidates_after", 0).alias("move_candidates_before"), F.col("candidates_after").alias("move_candidates_after"),
        was("pending_after", False).alias("pending_transition_before"), F.col("pending_after").alias("pending_transition_after"), F.when(last, F.concat(named, F.lit(";dataset_end"))).otherwise(named).alias("decision"), emitted.alias("events_emitted"),
        F.when(first, "initialized presence search").when(F.col("decision") == "presence_candidate_reanchored", "new anchor outside previous presence search radius").otherwise("").alias("detail"),
    )


def write_traces(traced: DataFrame, out: str, entity_ids: tuple[str, ...]) -> list[str]:
    """A CSV file for each chosen entity; rows are fetched entity by entity."""
    folder = os.path.join(out, "diagnostics", "traces")
    os.makedirs(folder, exist_ok=True)
    written = []
    for entity in dict.fromkeys(entity_ids):
        rows = traced.where(F.col("entity_id") == entity).orderBy("observation_index").toLocalIterator()
        first = next(rows, None)
        if first is None:
            continue
        name = trace_file_name(entity)
        with open(os.path.join(folder, name), "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f, lineterminator="\n")
            w.writerow(TRACE_COLUMNS)
            for r in (first, *rows):
                w.writerow([str(v).lower() if isinstance(v, bool) else "" if v is None else v for v in (r[c] for c in TRACE_COLUMNS)])
        written.append(f"diagnostics/traces/{name}")
    return written


def storage(out: str, input_bytes: int, observations: int) -> dict[str, Any]:
    """Bytes by file, largest first, and how they compare with the input."""
    files = []
    for folder, _, names in os.walk(out):
        files += [{"path": os.path.relpath(os.path.join(folder, n), out).replace(os.sep, "/"), "bytes": os.path.getsize(os.path.join(folder, n))} for n in names if not n.startswith((".", "_")) and n != "manifest.json"]
    files.sort(key=lambda x: (-x["bytes"], x["path"]))
    part = lambda head: sum(f["bytes"] for f in files if f["path"].startswith(head))
    total, analysis, canonical = sum(f["bytes"] for f in files), part("analysis/"), part("canonical/")
    ratio = lambda n: n / input_bytes if input_bytes else 0.0
    return {"input_bytes": input_bytes, "total_bytes": total, "analysis_bytes": analysis, "canonical_bytes": canonical, "total_expansion_ratio": ratio(total), "analysis_expansion_ratio": ratio(analysis), "canonical_expansion_ratio": ratio(canonical), "analysis_bytes_per_observation": analysis / observations if observations else 0.0, "files": files}


def parquet_stats(folder: str) -> dict[str, int]:
    found = [pq.ParquetFile(os.path.join(folder, n)).metadata for n in sorted(os.listdir(folder)) if n.endswith(".parquet")]
    return {"rows": sum(m.num_rows for m in found), "row_groups": sum(m.num_row_groups for m in found), "files": len(found)}


