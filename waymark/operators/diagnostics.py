"""Distributions and cross-tabulations of steps, and closure checks of the counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.config import Config
from waymark.functions import expressions as X

#: Exact quantiles where a streaming sketch would only approximate.
QUANTILES = (0.5, 0.9, 0.99)
#: The sketch that brackets them errs by a share of 1/ACCURACY of the rows at most; about 3 * 6/ACCURACY of the values are put in order.
ACCURACY = 50_000


def steps(normalized: DataFrame, cfg: Config) -> DataFrame:
    """Rows with a step, its bands and, at discontinuities, its reason."""
    reason = X.discontinuity_reason(F.col("effective_distance_m"), F.col("step_dt_s"), F.col("implied_speed_mps"), cfg.max_jump_m, cfg.max_speed_mps)
    return normalized.where("has_step").withColumns({"dt_band": X.dt_band(F.col("step_dt_s")), "distance_band": X.distance_band(F.col("effective_distance_m")), "reason": F.when(F.col("is_discontinuity"), reason)})


def distributions(steps: DataFrame) -> DataFrame:
    """Count, least, greatest and quantiles of distances, speeds and times by accuracy state; speeds and times only of steps that took time."""
    timed = F.col("step_dt_s") > 0
    values = {"raw_distance_m": F.col("step_distance_m"), "effective_distance_m": F.col("effective_distance_m"), "implied_speed_mps": F.when(timed, F.col("implied_speed_mps")), "step_dt_s": F.when(timed, F.col("step_dt_s"))}
    listed = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in values.items()]))
    long = steps.select(F.col("step_accuracy_state").alias("state"), listed.alias("m")).where("m.value is not null").select("state", "m.metric", "m.value")
    return exact_quantiles(long, "metric", "state")


def exact_quantiles(values: DataFrame, *by: str) -> DataFrame:
    """Count, least, greatest and exact quantiles (interpolated between neighbouring ranks) of column `value` by group; groups must be few.

    No group is held in memory. A sketch gives a bracket around each quantile; values inside a bracket are counted one by one, those
    between brackets together, with their least and greatest, and the counts in order give the ranks. A quantile whose rank all these
    missed would be null, not wrong.
    """
    beside = 2 / ACCURACY
    edges = [min(1.0, max(0.0, q + d)) for q in QUANTILES for d in (-beside, beside)]
    brackets = values.groupBy(*by).agg(F.percentile_approx("value", edges, ACCURACY).alias("edges"))
    value, edge = F.col("value"), [F.get("edges", F.lit(i)) for i in range(len(edges))]
    inside, passed = F.lit(False), F.lit(0)
    for low, high in zip(edge[::2], edge[1::2], strict=True):
        inside = inside | value.between(low, high)
        passed = passed + (value > low).cast("int") + (value > high).cast("int")
    placed = values.join(F.broadcast(brackets), list(by)).withColumns({"alone": F.when(inside, value), "passed": F.when(~inside, passed)})
    counted = placed.groupBy(*by, "alone", "passed").agg(F.count("*").alias("c"), F.min("value").alias("low"), F.max("value").alias("high"))
    so_far = Window.partitionBy(*by).orderBy("low").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumns({"upto": F.sum("c").over(so_far), "n": F.sum("c").over(Window.partitionBy(*by))})

    def at(rank: Column) -> Column:
        first, last = F.col("upto") - F.col("c"), F.col("upto") - 1
        return F.max(F.when(rank == first, F.col("low")).when(rank == last, F.col("high")).when(rank.between(first, last), F.col("alone")))

    out = [F.max("n").alias("n"), F.min("low").alias("least"), F.max("high").alias("greatest")]
    for q in QUANTILES:
        place = F.lit(q) * (F.col("n") - 1)
        share = F.max(place - F.floor(place))
        lower, upper = at(F.floor(place)), at(F.ceil(place))
        out.append((lower + (upper - lower) * share).alias(f"p{round(q * 100)}"))
    return ranked.groupBy(*by).agg(*out)


def edge_bands(steps: DataFrame) -> DataFrame:
    return steps.groupBy("step_accuracy_state", "dt_band").agg(F.count("*").alias("n"))


def discontinuity_cube(steps: DataFrame) -> DataFrame:
    """Discontinuities by reason, state and band, with all subtotals; a null stands for all values."""
    return steps.where("is_discontinuity").cube("reason", "step_accuracy_state", "dt_band").agg(F.count("*").alias("n"))


def speed_only_matrix(steps: DataFrame) -> DataFrame:
    """Discontinuities by speed alone: state, time band and distance band, and whether they are mere jitter."""
    micro = (F.col("dt_band") == "lt_1s") & (F.col("distance_band") == "lt_5m")
    rows = steps.where("reason = 'speed_only'").withColumn("candidate_class", F.when(micro, "micro_displacement").otherwise("other_speed_only"))
    return rows.groupBy("step_accuracy_state", "dt_band", "distance_band", "candidate_class").agg(F.count("*").alias("n"))


def speed_only_distances(steps: DataFrame) -> DataFrame:
    """The effective distances of discontinuities by speed alone, by accuracy state, as `exact_quantiles`."""
    return exact_quantiles(steps.where("reason = 'speed_only'").select(F.col("step_accuracy_state").alias("state"), F.col("effective_distance_m").alias("value")), "state")


def is_target() -> Column:
    """Short steps between fixes without a known radius that are too fast though not far."""
    return (F.col("step_accuracy_state") == "both_missing") & (F.coalesce("reason", F.lit("")) == "speed_only") & (F.col("step_dt_s") > 0) & (F.col("step_dt_s") < 5) & (F.col("effective_distance_m") >= 50) & (F.col("effective_distance_m") < 500)


def target_population(steps: DataFrame) -> DataFrame:
    """Each such step with its direction, rounded distance, displacement and the precision of the coordinates as written."""
    bearing = X.bearing_deg(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon"))
    before, now = X.precision_key(F.col("prev_lat_places"), F.col("prev_lon_places")), X.precision_key(F.col("lat_places"), F.col("lon_places"))
    turned = F.col("lon") - F.col("prev_lon")
    short = F.when(turned > 180, turned - 360).when(turned < -180, turned + 360).otherwise(turned)
    return steps.where(is_target()).select(
        "entity_id", "idx", "step_distance_m", "effective_distance_m", "step_dt_s", F.abs(F.col("lat") - F.col("prev_lat")).alias("abs_delta_lat_deg"), F.abs(short).alias("abs_delta_lon_deg"),
        X.sector(bearing, X.SECTORS_16).alias("bearing_16"), F.round("effective_distance_m").cast("long").alias("distance_1m"), X.vector_10m(F.col("step_distance_m"), bearing).alias("vector_10m"),
        before.alias("previous_precision"), now.alias("precision"), F.concat(before, F.lit("->"), now).alias("precision_transition"),
    )


def target_distributions(population: DataFrame) -> DataFrame:
    """`exact_quantiles` of the distances, times and displacements of `target_population`, by metric."""
    metrics = {"raw_distance_m": "step_distance_m", "effective_distance_m": "effective_distance_m", "step_dt_s": "step_dt_s", "abs_delta_lat_deg": "abs_delta_lat_deg", "abs_delta_lon_deg": "abs_delta_lon_deg"}
    listed = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(c).alias("value")) for k, c in metrics.items()]))
    return exact_quantiles(population.select(listed.alias("m")).select("m.metric", "m.value"), "metric")


def target_cross_tabs(population: DataFrame) -> DataFrame:
    """Steps of `target_population` by change of precision and, each in turn, direction, rounded distance and displacement."""
    kinds = ("bearing_16", "distance_1m", "vector_10m")
    listed = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("key")) for c in kinds]))
    return population.select("precision_transition", listed.alias("m")).groupBy("precision_transition", "m.kind", "m.key").agg(F.count("*").alias("n"))


def _consecutive_targets(steps: DataFrame) -> DataFrame:
    """Target steps B -> D right after a target step A -> B, which gives the columns that begin with a_."""
    w = Window.partitionBy("entity_id").orderBy("idx")
    names = ("prev_lat", "prev_lon", "prev_lat_places", "prev_lon_places", "effective_distance_m")
    return steps.withColumn("target", is_target()).withColumns({"was_target": F.lag("target").over(w), **{f"a_{c}": F.lag(c).over(w) for c in names}}).where("target and was_target")


def _three_precisions() -> tuple[Column, Column, Column]:
    return X.precision_key(F.col("a_prev_lat_places"), F.col("a_prev_lon_places")), X.precision_key(F.col("prev_lat_places"), F.col("prev_lon_places")), X.precision_key(F.col("lat_places"), F.col("lon_places"))


def precision_triplets(steps: DataFrame) -> DataFrame:
    """Pairs of consecutive target steps by the precisions of their three positions."""
    return _consecutive_targets(steps).groupBy(F.concat_ws("->", *_three_precisions()).alias("precision_triplet")).agg(F.count("*").alias("n"))


def reversals(steps: DataFrame) -> DataFrame:
    """Counts over pairs of consecutive target steps A -> B -> D: returns to A, opposite bearings, like distances, precisions."""
    rows = _consecutive_targets(steps)
    back = X.distance_m(F.col("a_prev_lat"), F.col("a_prev_lon"), F.col("lat"), F.col("lon"))
    b1, b2 = X.bearing_deg(F.col("a_prev_lat"), F.col("a_prev_lon"), F.col("prev_lat"), F.col("prev_lon")), X.bearing_deg(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon"))
    turn = F.abs(b1 - b2)
    turn = F.when(turn > 180, 360 - turn).otherwise(turn)
    opposite, near, like = F.abs(turn - 180) <= 22.5, back < 5, F.abs(F.col("a_effective_distance_m") - F.col("effective_distance_m")) <= 5
    pa, pb, pd = _three_precisions()
    return rows.agg(
        F.count("*").alias("consecutive_target_edge_pairs"), F.count_if((F.col("a_prev_lat") == F.col("lat")) & (F.col("a_prev_lon") == F.col("lon"))).alias("exact_aba_returns"), F.count_if(near).alias("return_within_5m"),
        F.count_if(opposite).alias("near_opposite_bearing"), F.count_if(like).alias("near_symmetric_distance_5m"), F.count_if(near & opposite & like).alias("aba_like_pairs"), F.count_if((pa == pd) & (pa != pb)).alias("precision_aba_returns"),
    )


def edge_totals(steps: DataFrame, *by: str) -> DataFrame:
    gap, disc = F.col("is_gap"), F.col("is_discontinuity")
    return steps.groupBy(*by).agg(F.count("*").alias("edges"), F.count_if(~gap & ~disc).alias("continuous_edges"), F.count_if(gap).alias("gap_edges"), F.count_if(disc).alias("discontinuity_edges"), F.count_if(gap & disc).alias("gap_and_discontinuity_edges"))


def closure(steps: DataFrame, decided: DataFrame, rows: int, entities: int) -> dict[str, int]:
    """What must be zero: edges less their kinds, reasons less discontinuities, candidates and departures less their outcomes."""
    e, d = edge_totals(steps).first().asDict(), decided.first().asDict()
    reasons = steps.where("is_discontinuity").count()
    return {
        "edges": rows - entities - (e["continuous_edges"] + e["gap_edges"] + e["discontinuity_edges"] - e["gap_and_discontinuity_edges"]),
        "reasons": e["discontinuity_edges"] - reasons,
        "departure_candidates": d["departure_candidate_unaccounted"],
        "pending_transitions": d["pending_transition_unaccounted"],
        "presence": d["presence_confirmations"] - sum(d[f"presence_end_{k}"] for k in ("dataset_end", "gap", "discontinuity", "confirmed_movement")),
    }
