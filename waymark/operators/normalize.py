"""From observations to a normalized trajectory: one row per entity and instant, step metrics, continuity breaks, segments.

Input columns: entity_id, ts_s, ts_ns, source_row, lat, lon, ha (null if unknown), lat_places, lon_places. Everything is
window functions over one partitioning by entity, so the rows are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.config import Config
from waymark.functions import expressions as X


#: Columns of `label` and of `identify`, which follow from the other columns of their row.
LABELS = ("has_step", "step_accuracy_state", "ha_state", "movement_state", "speed_class")
IDENTIFIERS = ("track_id", "subject", "ts_text", "geohash", "segment_id")


def collapse(observations: DataFrame) -> DataFrame:
    """The best row of each entity and instant: known radius first, then the least, then by latitude, longitude and source row.

    sample_count counts the rows of the instant; same_ts_scatter_m is the farthest of them from the one that stays.
    """
    instant = Window.partitionBy("entity_id", "ts_s", "ts_ns").orderBy(F.col("ha").asc_nulls_last(), "lat", "lon", "source_row")
    whole = instant.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Rows of an entity are in one partition from here on, which serves this window by instant and the next by entity.
    ranked = observations.repartition(F.col("entity_id")).withColumns({
        "rank": F.row_number().over(instant),
        "sample_count": F.count("*").over(whole),
        "best_lat": F.first("lat").over(whole),
        "best_lon": F.first("lon").over(whole),
    })
    away = F.when(F.col("sample_count") > 1, X.distance_m(F.col("best_lat"), F.col("best_lon"), F.col("lat"), F.col("lon"))).otherwise(F.lit(0.0))
    scattered = ranked.withColumn("away", away).withColumn("same_ts_scatter_m", F.max("away").over(whole))
    return scattered.where("rank = 1").drop("rank", "best_lat", "best_lon", "away")


def step_metrics(collapsed: DataFrame, cfg: Config) -> DataFrame:
    """Time, distance, effective distance and speed from the row before; gap and discontinuity flags; classes; segment and run numbers.

    idx counts the rows of an entity from 1. run counts the stretches between continuity breaks (gap or discontinuity) from 0,
    segment_index those between discontinuities from 1. The last row of a run knows the break that follows it.
    """
    w = Window.partitionBy("entity_id").orderBy("ts_s", "ts_ns")
    before = {f"prev_{c}": F.lag(c).over(w) for c in ("ts_s", "ts_ns", "lat", "lon", "ha", "source_row", "lat_places", "lon_places")}
    rows = collapsed.withColumns({"idx": F.row_number().over(w), **before})
    first = F.col("idx") == 1
    rows = rows.withColumns({
        "step_dt_s": F.when(first, F.lit(0.0)).otherwise(X.seconds_between(F.col("prev_ts_s"), F.col("prev_ts_ns"), F.col("ts_s"), F.col("ts_ns"))),
        "step_distance_m": F.when(first, F.lit(0.0)).otherwise(X.distance_m(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon"))),
    })
    rows = rows.withColumn("effective_distance_m", F.when(first, F.lit(0.0)).otherwise(X.effective_distance_m(F.col("step_distance_m"), F.col("prev_ha"), F.col("ha"))))
    rows = rows.withColumn("implied_speed_mps", F.when(F.col("step_dt_s") > 0, F.col("effective_distance_m") / F.col("step_dt_s")).otherwise(F.lit(0.0)))
    rows = rows.withColumns({
        "is_gap": ~first & (F.col("step_dt_s") > cfg.gap_threshold_s),
        "is_discontinuity": ~first & ((F.col("effective_distance_m") > cfg.max_jump_m) | ((F.col("step_dt_s") > 0) & (F.col("implied_speed_mps") > cfg.max_speed_mps))),
    })
    is_break = F.col("is_gap") | F.col("is_discontinuity")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({
        "run": F.sum(is_break.cast("int")).over(so_far),
        "segment_index": F.sum(F.col("is_discontinuity").cast("int")).over(so_far) + 1,
        "next_gap": F.lead("is_gap").over(w),
        "next_discontinuity": F.lead("is_discontinuity").over(w),
        # Sums over the whole entity; differences give paths and counts between two rows of one run.
        "cum_path_m": F.sum(F.when(is_break, F.lit(0.0)).otherwise(F.col("step_distance_m"))).over(so_far),
        "cum_known": F.sum(F.col("ha").isNotNull().cast("int")).over(so_far),
    })
    return label(rows.withColumn("run_ends", F.coalesce(F.col("next_gap") | F.col("next_discontinuity"), F.lit(True))), cfg)


def label(rows: DataFrame, cfg: Config) -> DataFrame:
    """Classes of the step and of the radius."""
    first = F.col("idx") == 1
    return rows.withColumns({
        "has_step": ~first,
        "step_accuracy_state": F.when(first, "initial").otherwise(X.edge_state(F.col("prev_ha"), F.col("ha"))),
        "ha_state": X.ha_state(F.col("ha")),
        "movement_state": F.when(first, "initial").when(F.col("is_gap") | F.col("is_discontinuity"), "continuity_break").when(F.col("effective_distance_m") <= cfg.move_radius_m, "within_deadband").otherwise("movement"),
        "speed_class": F.when(first | F.col("is_gap") | (F.col("step_dt_s") <= 0), "unknown").when((F.col("effective_distance_m") <= cfg.walk_max_jump_m) & (F.col("implied_speed_mps") <= cfg.walk_max_speed_mps), "walk-compatible").otherwise("non-walk-compatible"),
    })


def identify_entity(rows: DataFrame, cfg: Config) -> DataFrame:
    """Track, segment and subject identifiers."""
    named = rows.withColumns({"track_id": X.stable_id("trk", F.lit(cfg.source), F.col("entity_id")), "subject": F.concat(F.lit(cfg.subject_prefix), F.col("entity_id"))})
    return named.withColumn("segment_id", X.stable_id("seg", F.col("track_id"), F.col("segment_index").cast("string")))


def identify(rows: DataFrame, cfg: Config) -> DataFrame:
    """Track, segment and subject identifiers, the time as text and the geohash cell."""
    return identify_entity(rows, cfg).withColumns({"ts_text": X.rfc3339(F.col("ts_s"), F.col("ts_ns")), "geohash": X.geohash(F.col("lat"), F.col("lon"), cfg.geohash_precision)})


def normalize(observations: DataFrame, cfg: Config) -> DataFrame:
    return step_metrics(collapse(observations), cfg)
