"""Registered queries for what the mapped observations do not show: parsing, rejects, written precision, conformance, fast short steps.

Their inputs are made from every row of the driver's `events` table in both engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import expressions as X
from waymark.functions import timestamps as T
from waymark.operators import conformance as C
from waymark.operators import diagnostics as D
from waymark.operators import events as E
from waymark.operators import normalize as N
from waymark.plans import oracle as O
from waymark.plans.queries import CFG, ORACLE, QUERIES, exact, layers, r
from waymark.sources.csv_input import judge


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # the table's times carry no zone
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def _pick(by: Column, *choices: Column) -> Column:
    out = F.when(by == 0, choices[0])
    for k, c in enumerate(choices[1:], 1):
        out = out.when(by == k, c)
    return out


def timestamp_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's time written in one of eight ways, read back."""
    e = _events(spark, sf_dir)
    s, n = F.floor(F.col("us") / 1000000).cast("long"), (F.pmod("us", F.lit(1000000)) * 1000).cast("int")
    z = X.rfc3339(s, n)
    shifted = F.concat(F.regexp_replace(X.rfc3339(s + 19800, n), "Z$", ""), F.lit("+05:30"))
    micros = F.lpad(F.pmod("us", F.lit(1000000)).cast("string"), 6, "0")
    written = _pick(F.col("event_id") % 8, z, shifted, s.cast("string"), F.floor(F.col("us") / 1000).cast("string"), F.col("us").cast("string"), F.concat(F.col("us").cast("string"), F.lit("000")), F.concat(s.cast("string"), F.lit("."), micros), F.concat(F.lit("2024-01-01 "), s.cast("string")))
    parsed = e.select("event_id", T.parse(written).alias("t"))
    return parsed.select("event_id", F.coalesce(F.col("t.s") * 1000000 + F.floor(F.col("t.ns") / 1000).cast("long"), F.lit(-1)).alias("t_us"))


ORACLE["timestamp_parse"] = "SELECT event_id, CASE event_id % 8 WHEN 2 THEN us // 1000000 * 1000000 WHEN 3 THEN us // 1000 * 1000 WHEN 7 THEN -1 ELSE us END AS t_us FROM (SELECT event_id, epoch_us(ts) AS us FROM events)"


def reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records made from all events, thirteen kinds of them, one sound: counts by reason."""
    e = _events(spark, sf_dir)
    k, text = F.col("event_id") % 13, F.lit
    bad = lambda column, good: F.coalesce(_pick(k, *column), good)
    null = F.lit(None).cast("string")
    fields = e.select(
        F.col("event_id").alias("source_row"), (k != 0).alias("parse_ok"),
        bad([null, text("  ")], F.col("user_id").cast("string")).alias("id"), bad([null, null, text("yesterday")], F.col("us").cast("string")).alias("ts"),
        bad([null, null, null, text("95")], text("51.5")).alias("lat"), bad([null, null, null, null, text("5d")], text(" -0.1 ")).alias("lon"),
        bad([null, null, null, null, null, text(""), text("wide"), text("NaN"), text("-1"), text("1e999"), text("0"), text("+Inf")], text("12.5")).alias("ha"),
    )
    return judge(fields, CFG).groupBy(F.coalesce("reject_code", F.lit("accepted")).alias("reject_code")).agg(F.count("*").alias("n"), F.count("ha_value").alias("with_ha"))


ORACLE["reject_counts"] = """SELECT code AS reject_code, count(*) AS n, count(ha) AS with_ha FROM (SELECT CASE event_id % 13 WHEN 0 THEN 'csv_parse_error' WHEN 1 THEN 'empty_id' WHEN 2 THEN 'invalid_ts' WHEN 3 THEN 'invalid_lat' WHEN 4 THEN 'invalid_lon' WHEN 6 THEN 'non_numeric_ha' WHEN 7 THEN 'non_finite_ha' WHEN 8 THEN 'negative_ha'
  WHEN 9 THEN 'non_numeric_ha' WHEN 11 THEN 'non_finite_ha' ELSE 'accepted' END AS code, CASE WHEN event_id % 13 NOT IN (5, 6) THEN 1 END AS ha FROM events) GROUP BY code"""


def coordinate_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("whole", F.floor("value").cast("long").cast("string"))
    lat = _pick(F.col("event_id") % 4, F.col("whole"), F.concat("whole", F.lit(".50")), F.concat("whole", F.lit("e-1")), F.concat("whole", F.lit(".123456")))
    lon = _pick(F.col("user_id") % 3, F.lit("-0.1"), F.lit("7"), F.lit("1E1"))
    return e.groupBy(X.precision_key(X.decimal_places(lat), X.decimal_places(lon)).alias("precision")).agg(F.count("*").alias("n"))


ORACLE["coordinate_precision"] = "SELECT 'lat_' || ['0', '2', 'scientific', '6'][1 + event_id % 4] || '_lon_' || ['1', '0', 'scientific'][1 + user_id % 3] AS precision, count(*) AS n FROM events GROUP BY ALL"


def validate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical stream with its units turned from seconds to metres: counts of broken rules."""
    L = layers(spark, sf_dir)
    lines = E.canonical(E.stream(L.rows, L.folded, L.presence, CFG), CFG)
    spoilt = lines.withColumn("value", F.regexp_replace("value", '"unit":"s"', '"unit":"m"'))
    return C.errors(C.parse(spoilt)).groupBy("error").agg(F.count("*").alias("n"))


ORACLE["validate_events"] = O.events("SELECT CASE event_type WHEN 'GAP' THEN 'GAP requires magnitude in seconds' ELSE 'STAY/DWELL require magnitude seconds and end_time' END AS error, count(*) AS n FROM ev WHERE event_type IN ('GAP', 'STAY', 'DWELL') GROUP BY ALL")


def fast_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events two seconds apart, to and fro over a few hundred metres, radii unknown."""
    e = _events(spark, sf_dir).withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    odd = F.col("rn") % 2
    return e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("entity_id"), (F.lit(1704067200) + F.col("rn") * 2).cast("long").alias("ts_s"), F.lit(0).alias("ts_ns"), F.col("event_id").alias("source_row"),
        (F.lit(50).cast("decimal(10,4)") + odd.cast("decimal(10,0)") * F.lit("0.002").cast("decimal(10,4)") + (k % 3).cast("decimal(10,0)") * F.lit("0.0007").cast("decimal(10,4)")).cast("double").alias("lat"), F.lit(0.25).alias("lon"), F.lit(None).cast("double").alias("ha"),
        F.when(odd == 1, 4).otherwise(3).alias("lat_places"), F.lit(5).alias("lon_places"),
    )


_FAST = f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events),
b AS (SELECT 'u' || user_id AS id, rn AS idx, CAST(50.0 + (rn % 2) * 0.002 + (k % 3) * 0.0007 AS DOUBLE) AS lat, 0.25::DOUBLE AS lon, CASE WHEN rn % 2 = 1 THEN 'lat_4_lon_5' ELSE 'lat_3_lon_5' END AS prec FROM e),
c AS (SELECT *, lag(lat) OVER o AS p_lat, lag(lon) OVER o AS p_lon, lag(prec) OVER o AS p_prec, lag(lat, 2) OVER o AS a_lat, lag(lon, 2) OVER o AS a_lon, lag(prec, 2) OVER o AS a_prec FROM b WINDOW o AS (PARTITION BY id ORDER BY idx)),
d AS (SELECT *, CASE WHEN idx > 1 THEN {O.dist('p_lat', 'p_lon', 'lat', 'lon')} END AS raw FROM c),
t AS (SELECT *, coalesce(raw / 2 > 50 AND raw >= 50 AND raw < 500, false) AS target FROM d),
u AS (SELECT *, lag(target) OVER (PARTITION BY id ORDER BY idx) AS was, lag(raw) OVER (PARTITION BY id ORDER BY idx) AS a_raw FROM t)
"""


def _fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.steps(N.normalize(fast_steps(spark, sf_dir), CFG), CFG)


def target_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.target_population(_fast(spark, sf_dir))
    return rows.groupBy("bearing_16", "distance_1m", "vector_10m", "precision_transition").agg(F.count("*").alias("n"), F.sum("abs_delta_lat_deg").alias("sum_abs_delta_lat_deg"))


ORACLE["target_population"] = _FAST + f"""SELECT CASE WHEN lat > p_lat THEN 'N' ELSE 'S' END AS bearing_16, CAST(round(raw) AS BIGINT) AS distance_1m, 'east_+0m_north_' || CASE WHEN lat > p_lat THEN '+' ELSE '-' END || CAST(round(raw / 10) AS BIGINT) * 10 || 'm' AS vector_10m, p_prec || '->' || prec AS precision_transition, count(*) AS n, {r('sum(abs(lat - p_lat))', 'sum_abs_delta_lat_deg')} FROM u WHERE target GROUP BY ALL"""


def reversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.reversals(_fast(spark, sf_dir))


ORACLE["reversals"] = _FAST + f"""SELECT count(*) AS consecutive_target_edge_pairs, count_if(a_lat = lat AND a_lon = lon) AS exact_aba_returns, count_if({O.dist('a_lat', 'a_lon', 'lat', 'lon')} < 5) AS return_within_5m, count_if((lat > p_lat) <> (p_lat > a_lat)) AS near_opposite_bearing, count_if(abs(a_raw - raw) <= 5) AS near_symmetric_distance_5m,
  count_if({O.dist('a_lat', 'a_lon', 'lat', 'lon')} < 5 AND (lat > p_lat) <> (p_lat > a_lat) AND abs(a_raw - raw) <= 5) AS aba_like_pairs, count_if(a_prec = prec AND a_prec <> p_prec) AS precision_aba_returns FROM u WHERE target AND was"""


_METRICS = {"raw_distance_m": "raw", "effective_distance_m": "raw", "step_dt_s": "2.0", "abs_delta_lat_deg": "abs(lat - p_lat)", "abs_delta_lon_deg": "abs(lon - p_lon)"}
_LISTED = " UNION ALL ".join(f"SELECT '{name}' AS metric, CAST({v} AS DOUBLE) AS v FROM u WHERE target" for name, v in _METRICS.items())


def target_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.target_distributions(D.target_population(_fast(spark, sf_dir)))


ORACLE["target_distributions"] = _FAST + f"SELECT metric, count(*) AS n, {r('min(v)', 'least')}, {r('max(v)', 'greatest')}, {r('quantile_cont(v, 0.5)', 'p50')}, {r('quantile_cont(v, 0.9)', 'p90')}, {r('quantile_cont(v, 0.99)', 'p99')} FROM ({_LISTED}) GROUP BY metric"


def target_cross_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.target_cross_tabs(D.target_population(_fast(spark, sf_dir)))


_KEYS = {"bearing_16": "CASE WHEN lat > p_lat THEN 'N' ELSE 'S' END", "distance_1m": "CAST(CAST(round(raw) AS BIGINT) AS VARCHAR)", "vector_10m": "'east_+0m_north_' || CASE WHEN lat > p_lat THEN '+' ELSE '-' END || CAST(round(raw / 10) AS BIGINT) * 10 || 'm'"}
ORACLE["target_cross_tabs"] = _FAST + " UNION ALL ".join(f"SELECT p_prec || '->' || prec AS precision_transition, '{kind}' AS kind, {key} AS key, count(*) AS n FROM u WHERE target GROUP BY ALL" for kind, key in _KEYS.items())


def precision_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.precision_triplets(_fast(spark, sf_dir))


ORACLE["precision_triplets"] = _FAST + "SELECT a_prec || '->' || p_prec || '->' || prec AS precision_triplet, count(*) AS n FROM u WHERE target AND was GROUP BY ALL"


def wkb_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometry of all segments as hexadecimal WKB."""
    from waymark.operators.layers import segments

    return segments(layers(spark, sf_dir).normalized, geometry=True).select("segment_id", F.hex("geometry").alias("wkb"))


def canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as JSON lines."""
    L = layers(spark, sf_dir)
    return E.canonical(E.stream(L.rows, L.folded, L.presence, CFG), CFG)


for _name, _query in (("timestamp_parse", timestamp_parse), ("reject_counts", reject_counts), ("coordinate_precision", coordinate_precision), ("validate_events", validate_events), ("target_population", target_population), ("reversals", reversals), ("target_distributions", target_distributions), ("target_cross_tabs", target_cross_tabs), ("precision_triplets", precision_triplets), ("wkb_geometry", wkb_geometry), ("canonical_events", canonical_events)):
    QUERIES[_name] = lambda spark, sf_dir, f=_query: exact(f(spark, sf_dir))
