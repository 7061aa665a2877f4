"""Location observations made from the driver's `events` table, which has no coordinates.

Each event becomes a fix of its user: users stand in a grid, move every five events, and jump where an error event has a
large value. Time runs 25 times faster. Every fiftieth row is repeated at the same instant with another position and radius.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Start of 2024 in microseconds.
EPOCH_US = 1704067200000000

#: The same mapping as DuckDB SQL: common table expressions that end in m(id, t_us, source_row, lat, lon, ha).
MAPPED_SQL = """
e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
b AS (SELECT concat('u', CAST(user_id AS VARCHAR)) AS id, 1704067200000000 + CAST(floor((us - 1704067200000000) / 25.0) AS BIGINT) AS t_us, event_id + 2 AS source_row,
        CAST(50.0 + (user_id % 10) * 0.5 + (CAST(floor(rn / 5.0) AS INT) % 4) * 0.004 + (k % 7) * 0.0001 + CASE WHEN event_type = 'error' AND value > 90 THEN 2.0 ELSE 0.0 END AS DOUBLE) AS lat,
        CAST(-0.1 - (user_id % 7) * 0.25 + (k % 5) * 0.0001 AS DOUBLE) AS lon,
        CASE WHEN k % 5 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(k % 30 AS DOUBLE) END AS ha FROM e),
m AS (SELECT id, t_us, source_row, lat, lon, ha FROM b
      UNION ALL SELECT id, t_us, source_row + 10000000, lat + 0.0003, lon, CASE WHEN ha IS NULL THEN CAST(12 AS DOUBLE) ELSE ha + 7 END FROM b WHERE source_row % 50 = 0)"""


def mapped_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, ts_s, ts_ns, source_row, lat, lon, ha, lat_places, lon_places); places are those of the number as Spark writes it."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # the table's times carry no zone
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    numbered = events.select(
        "event_id", "user_id", "event_type", "value",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
        F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("rn"),
    )
    # Coordinates are whole numbers of ten-thousandths, so that one division gives the double nearest to the decimal.
    far = F.when((F.col("event_type") == "error") & (F.col("value") > 90), F.lit(20000)).otherwise(F.lit(0))
    lat = F.lit(500000) + F.col("user_id") % 10 * 5000 + F.floor(F.col("rn") / F.lit(5.0)).cast("int") % 4 * 40 + F.col("k") % 7 + far
    lon = F.lit(-1000) - F.col("user_id") % 7 * 2500 + F.col("k") % 5
    base = numbered.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("entity_id"),
        (F.lit(EPOCH_US) + F.floor((F.col("us") - EPOCH_US) / F.lit(25.0)).cast("long")).alias("t_us"),
        (F.col("event_id") + 2).alias("source_row"),
        (lat.cast("double") / 10000.0).alias("lat"), (lon.cast("double") / 10000.0).alias("lon"),
        F.when(F.col("k") % 5 != 0, (F.col("k") % 30).cast("double")).alias("ha"),
    )
    # One scan: a row that is repeated is exploded into two.
    copies = F.explode(F.when(F.col("source_row") % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    both = base.select("*", copies)
    second = F.col("copy") == 1
    return both.select(
        "entity_id",
        F.floor(F.col("t_us") / 1000000).cast("long").alias("ts_s"),
        (F.pmod(F.col("t_us"), F.lit(1000000)) * 1000).cast("int").alias("ts_ns"),
        F.when(second, F.col("source_row") + 10000000).otherwise(F.col("source_row")).alias("source_row"),
        F.when(second, F.col("lat") + 0.0003).otherwise(F.col("lat")).alias("lat"),
        "lon",
        F.when(second, F.coalesce(F.col("ha") + 7, F.lit(12.0))).otherwise(F.col("ha")).alias("ha"),
        F.lit(0).alias("lat_places"), F.lit(0).alias("lon_places"),
    )
