"""Column builders: distances, bearings, cells, identifiers, classes and bands. All run inside Spark's own engine."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

EARTH_RADIUS_M = 6371008.8
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
# Compass sectors.
SECTORS_8 = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")
SECTORS_16 = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance on the mean earth radius."""
    a, b = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1 - h)))


def effective_distance_m(raw: Column, ha1: Column, ha2: Column) -> Column:
    """Distance less the known radii of uncertainty, not below zero."""
    return F.greatest(F.lit(0.0), raw - F.coalesce(ha1, F.lit(0.0)) - F.coalesce(ha2, F.lit(0.0)))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in [0, 360)."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    deg = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.when(deg < 0, deg + 360).otherwise(deg)


def sector(bearing: Column, names: tuple[str, ...] = SECTORS_8) -> Column:
    width = 360 / len(names)
    return F.element_at(F.array(*[F.lit(n) for n in names]), (F.floor((bearing + width / 2) / width) % len(names) + 1).cast("int"))


def ecef(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    a, b = F.radians(lat), F.radians(lon)
    return F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)


def centroid(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a mean of unit vectors."""
    return F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), F.degrees(F.atan2(y, x))


def _cell_index(value: Column, low: float, width: float, bits: int) -> Column:
    """Number of the cell that holds a value when the range is halved `bits` times; a border belongs to the cell above it.

    The first estimate may be a cell off by rounding. Borders are exact in doubles, so one comparison on each side settles it.
    """
    size, last = width / (1 << bits), (1 << bits) - 1
    guess = F.floor((value - low) / size).cast("long")
    border = guess * size + low
    exact = F.when(value < border, guess - 1).when(value >= border + size, guess + 1).otherwise(guess)
    return F.least(F.greatest(exact, F.lit(0)), F.lit(last)).cast("long")


def geohash(lat: Column, lon: Column, precision: int) -> Column:
    """Geohash: the bits of longitude and latitude in turn, five to a character."""
    total = 5 * precision
    across, up = (total + 1) // 2, total // 2
    x, y = _cell_index(lon, -180.0, 360.0, across), _cell_index(lat, -90.0, 180.0, up)
    letters = F.lit(GEOHASH_ALPHABET)

    def letter(k: int) -> Column:
        value = F.lit(0).cast("long")
        for j in range(5 * k, 5 * k + 5):
            bit = F.shiftright(x, across - 1 - j // 2) if j % 2 == 0 else F.shiftright(y, up - 1 - j // 2)
            value = value * 2 + bit.bitwiseAND(F.lit(1).cast("long"))
        return F.substr(letters, (value + 1).cast("int"), F.lit(1))

    return F.concat(*[letter(k) for k in range(precision)])


@F.arrow_udf(StringType())
def spelled(lat: pa.Array, lon: pa.Array, ha: pa.Array) -> pa.Array:
    """Coordinates and radius as identifiers spell them, a zero byte between: nine, nine and three places, `missing` without a radius."""
    return pa.array([f"{a:.9f}\0{b:.9f}\0{'missing' if c is None else f'{c:.3f}'}" for a, b, c in zip(lat.to_pylist(), lon.to_pylist(), ha.to_pylist())], pa.string())


def fix_id(prev: str = "") -> Column:
    """Identifier of the position of a row, or of the row before it (`prev_`)."""
    at = lambda c: F.col(prev + c)
    return stable_id("fix", F.col("entity_id"), rfc3339(at("ts_s"), at("ts_ns")), spelled(at("lat"), at("lon"), at("ha")))


def observation_id() -> Column:
    return stable_id("obs", F.col("track_id"), F.col("ts_text"), spelled(F.col("lat"), F.col("lon"), F.col("ha")))


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix:first 24 hexadecimal digits of SHA-256 over the parts, a zero byte before each."""
    zero = F.lit("\0")
    return F.concat(F.lit(f"{prefix}:"), F.substr(F.sha2(F.concat(*[x for p in parts for x in (zero, p)]), 256), F.lit(1), F.lit(24)))


def rfc3339(seconds: Column, nanos: Column) -> Column:
    """UTC time from epoch seconds and nanoseconds; trailing zeros of the fraction are left out."""
    whole = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.when(nanos == 0, F.lit("")).otherwise(F.regexp_replace(F.concat(F.lit("."), F.lpad(nanos.cast("string"), 9, "0")), "0+$", ""))
    return F.concat(whole, fraction, F.lit("Z"))


def seconds_between(s1: Column, n1: Column, s2: Column, n2: Column) -> Column:
    """Seconds from (s1, n1) to (s2, n2) as a double: whole seconds plus the rest in nanoseconds."""
    total_s, total_n = s2 - s1, (n2 - n1).cast("long")
    borrow = F.when(total_n < 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
    return (total_s - borrow).cast("double") + (total_n + borrow * 1000000000).cast("double") / 1e9


def millis(seconds: Column, nanos: Column) -> Column:
    """Timestamp cut down to the millisecond."""
    return F.timestamp_millis(seconds * 1000 + F.floor(nanos / 1000000))


def edge_state(previous_ha: Column, ha: Column) -> Column:
    return F.when(previous_ha.isNotNull() & ha.isNotNull(), "both_known").when(ha.isNotNull(), "previous_missing").when(previous_ha.isNotNull(), "current_missing").otherwise("both_missing")


def ha_state(ha: Column) -> Column:
    return F.when(ha.isNotNull(), "known").otherwise("missing")


def support_class(known: Column, missing: Column) -> Column:
    return F.when((known > 0) & (missing > 0), "mixed").when(known > 0, "all_known").when(missing > 0, "all_missing").otherwise("none")


def coverage_pct(known: Column, total: Column) -> Column:
    return F.when(total > 0, F.lit(100.0) * known / total).otherwise(F.lit(0.0))


def discontinuity_reason(effective: Column, dt: Column, speed: Column, max_jump_m: float, max_speed_mps: float) -> Column:
    jump, fast = effective > max_jump_m, (dt > 0) & (speed > max_speed_mps)
    return F.when(jump & fast, "jump_and_speed").when(jump, "jump_only").when(fast, "speed_only").otherwise("unknown")


# The bands of the diagnostics, each with its upper limit (not included).
DT_BANDS = ((1, "lt_1s"), (5, "1_5s"), (30, "5_30s"), (60, "30_60s"), (300, "1_5m"), (1800, "5_30m"), (7200, "30m_2h"), (None, "ge_2h"))
DISTANCE_BANDS = ((5, "lt_5m"), (50, "5_50m"), (500, "50_500m"), (5000, "500m_5km"), (None, "ge_5km"))


def _band(value: Column, bands: tuple, first: Column) -> Column:
    for limit, name in bands:
        first = first.otherwise(name) if limit is None else first.when(value < limit, name)
    return first


def dt_band(dt: Column) -> Column:
    """Band of a time step in seconds."""
    return _band(dt, DT_BANDS, F.when(dt <= 0, "non_positive"))


def distance_band(effective: Column) -> Column:
    """Band of an effective distance in metres."""
    return _band(effective, DISTANCE_BANDS[1:], F.when(effective < DISTANCE_BANDS[0][0], DISTANCE_BANDS[0][1]))


def decimal_places(text: Column) -> Column:
    """Digits after the point of a number as written; -1 in scientific notation."""
    return F.when(text.rlike("[eE]"), -1).when(F.instr(text, ".") > 0, F.length(text) - F.instr(text, ".")).otherwise(0)


def precision_key(lat_places: Column, lon_places: Column) -> Column:
    spell = lambda n: F.when(n < 0, "scientific").otherwise(n.cast("string"))
    return F.concat(F.lit("lat_"), spell(lat_places), F.lit("_lon_"), spell(lon_places))


def vector_10m(distance: Column, bearing: Column) -> Column:
    """A displacement rounded to 10 m east and north."""
    signed = lambda v: F.format_string("%+d", F.round(v / 10).cast("long") * 10)
    return F.concat(F.lit("east_"), signed(distance * F.sin(F.radians(bearing))), F.lit("m_north_"), signed(distance * F.cos(F.radians(bearing))), F.lit("m"))
