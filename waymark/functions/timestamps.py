"""Instants from text: RFC 3339 with a zone, or Unix epochs whose unit follows from their size.

Below 1e11 a number is seconds, below 1e14 milliseconds, below 1e17 microseconds, else nanoseconds. Whole numbers and RFC 3339
stay in Spark's engine; fractions and exponents go through exact rational arithmetic, ties away from zero.
"""

from __future__ import annotations

import re
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from waymark.functions.expressions import let

#: Years 0 to 9999.
LEAST_S, MOST_S = -62167219200, 253402300799
_RFC = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2})([.,][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"
_WHOLE = r"^[+-]?[0-9]{1,19}$"
_DECIMAL = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
_DECIMAL_RE = re.compile(_DECIMAL)
MOST_CHARACTERS, MOST_EXPONENT = 128, 400


def exact_nanos(text: str | None) -> tuple[int, int] | None:
    """(seconds, nanoseconds) of a decimal epoch, or None if it is not one or out of range."""
    if text is None or len(text) > MOST_CHARACTERS or not _DECIMAL_RE.match(text):
        return None
    exponent = re.search(r"[eE]([+-]?[0-9]+)$", text)
    if exponent and abs(int(exponent[1])) > MOST_EXPONENT:
        return None
    value = Fraction(text)
    if not -(1 << 63) <= value <= (1 << 63) - 1:
        return None
    size = abs(value)
    nanos = size * (1 if size >= 10**17 else 1000 if size >= 10**14 else 10**6 if size >= 10**11 else 10**9)
    whole = (2 * nanos.numerator + nanos.denominator) // (2 * nanos.denominator)
    whole = -whole if value < 0 else whole
    seconds, rest = divmod(whole, 10**9)
    return (seconds, rest) if LEAST_S <= seconds <= MOST_S else None


@F.arrow_udf(LongType())
def _decimal_seconds(column: pa.Array) -> pa.Array:
    return pa.array([None if (x := exact_nanos(t)) is None else x[0] for t in column.to_pylist()], pa.int64())


@F.arrow_udf(LongType())
def _decimal_nanos(column: pa.Array) -> pa.Array:
    return pa.array([None if (x := exact_nanos(t)) is None else x[1] for t in column.to_pylist()], pa.int64())


def _from_rfc(g: Column) -> Column:
    """struct(s, ns) from the parts of an RFC 3339 time, null if they are out of range."""
    part = lambda k: F.get(g, F.lit(k))
    number = lambda k: F.nullif(part(k), F.lit("")).try_cast("int")
    zone = part(7)
    zone_s = F.coalesce(F.nullif(F.substr(zone, F.lit(2), F.lit(2)), F.lit("")).try_cast("int") * 3600 + F.nullif(F.substr(zone, F.lit(5), F.lit(2)), F.lit("")).try_cast("int") * 60, F.lit(0))
    day = F.try_to_date(F.concat_ws("-", part(0), part(1), part(2)), "yyyy-MM-dd")
    fits = (number(3) <= 23) & (number(4) <= 59) & (number(5) <= 59) & (zone_s <= 86400)
    seconds = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86400 + number(3) * 3600 + number(4) * 60 + number(5) - F.when(zone.startswith("-"), -zone_s).otherwise(zone_s)
    nanos = F.coalesce(F.rpad(F.substr(part(6), F.lit(2), F.lit(9)), F.lit(9), "0").try_cast("int"), F.lit(0))
    return F.struct(F.when(fits, seconds).alias("s"), nanos.alias("ns"))


def _from_whole(v: Column) -> Column:
    size = F.abs(v.cast("decimal(20,0)"))
    unit = F.when(size >= 10**17, F.lit(10**9)).when(size >= 10**14, F.lit(10**6)).when(size >= 10**11, F.lit(10**3)).otherwise(F.lit(1)).cast("long")
    return let(unit, lambda u: F.struct(F.floor(v.cast("decimal(20,0)") / u).cast("long").alias("s"), (F.pmod(v, u) * (F.lit(10**9).cast("long") / u).cast("long")).cast("int").alias("ns")))


def parse(text: Column, decimals: bool = True) -> Column:
    """struct(s, ns): epoch seconds and nanoseconds of trimmed text; s is null if it is no instant. Without `decimals`, fractions of epochs are not read and no Python runs."""
    # Seven parts stand at fixed places; the zone is the last character or the last six.
    zone = F.when(text.endswith("Z"), F.lit("Z")).otherwise(F.substr(text, F.lit(-6), F.lit(6)))
    fraction = F.substr(text, F.lit(20), F.length(text) - 19 - F.length(zone))
    groups = F.array(*[F.substr(text, F.lit(at), F.lit(n)) for at, n in ((1, 4), (6, 2), (9, 2), (12, 2), (15, 2), (18, 2))], fraction, zone)
    whole = F.when(text.rlike(_WHOLE), text.try_cast("long"))
    is_rfc = text.rlike(_RFC)
    native = F.when(is_rfc, let(groups, _from_rfc)).when(whole.isNotNull(), let(whole, _from_whole))
    if decimals:
        rest = F.when(whole.isNull() & ~is_rfc & text.rlike(_DECIMAL), text)
        native = F.coalesce(native, F.struct(_decimal_seconds(rest).alias("s"), _decimal_nanos(rest).cast("int").alias("ns")))
    return let(native, lambda t: F.when(t["s"].between(LEAST_S, MOST_S), t))
