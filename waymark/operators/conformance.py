"""Rules that every event of the stream keeps, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.config import MODALITY, PROFILE_ID, WIRE_VERSION
from waymark.functions import timestamps as T
from waymark.functions.expressions import seconds_between
from waymark.operators.events import KINDS

PARAMETERS = ("geohash_precision", "move_radius_m", "dwell_threshold_s", "gap_threshold_s", "max_speed_mps", "max_jump_m", "confirm_moves", "confirm_window_s", "walk_max_speed_mps", "walk_max_jump_m")
SCHEMA = "xq_version string, id string, event_time string, end_time string, source string, modality string, class string, profile string, subject string, feature string, action string, state string, polarity long, magnitude double, unit string, provenance struct<producer string, producer_version string, parameters map<string, string>>, context struct<source_event string>"


def parse(lines: DataFrame) -> DataFrame:
    """Column e from JSON lines in column value; null where the line is no JSON object."""
    return lines.withColumn("e", F.from_json("value", SCHEMA + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))


def checks() -> list[tuple[str, Column]]:
    """(message, whether column e breaks the rule)."""
    e = lambda name: F.col(f"e.{name}")
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    ts_s, ts_n, end_s, end_n = (F.col(c) for c in ("at.s", "at.ns", "until.s", "until.ns"))
    timed = F.coalesce(e("event_time"), F.lit("")).rlike("T") & ts_s.isNotNull()
    ended = ~empty(e("end_time"))
    no_provenance = e("provenance").isNull()
    kind = F.coalesce(e("context.source_event"), F.lit(""))
    known = kind.isin(*KINDS)
    lasting, span = kind.isin("STAY", "DWELL"), seconds_between(ts_s, ts_n, end_s, end_n)
    complete = e("magnitude").isNotNull() & (F.coalesce(e("unit"), F.lit("")) == "s") & ended
    threshold = F.coalesce(F.element_at(e("provenance.parameters"), "dwell_threshold_s").try_cast("double"), F.lit(0.0))
    expected = None
    for name, (feature, action, state, polarity) in KINDS.items():
        fits = (e("feature") == feature) & (e("action") == action) & (e("state") == state) & (F.coalesce(e("polarity"), F.lit(0)) == polarity)
        expected = F.when(kind == name, fits) if expected is None else expected.when(kind == name, fits)
    go_on = ~no_provenance
    unit_is = lambda u: F.coalesce(e("unit"), F.lit("")) == u
    # The messages, word for word.
    return [
        ("xq_version must be 0.1", F.coalesce(e("xq_version"), F.lit("")) != WIRE_VERSION),
        ("missing required Core field", empty(e("id")) | empty(e("source")) | empty(e("event_time")) | empty(e("modality")) | empty(e("class")) | empty(e("feature")) | empty(e("action"))),
        ("modality must be xq:mobility", F.coalesce(e("modality"), F.lit("")) != MODALITY),
        ("profile must be xq.mob:profile-0.1", F.coalesce(e("profile"), F.lit("")) != PROFILE_ID),
        ("reference eventizer events must use class=transition", F.coalesce(e("class"), F.lit("")) != "transition"),
        ("event_time is not RFC3339", ~timed),
        ("invalid end_time", ended & (end_s.isNull() | (timed & F.coalesce(span < 0, F.lit(False))))),
        ("missing provenance", no_provenance),
        ("missing provenance producer/version", go_on & (empty(e("provenance.producer")) | empty(e("provenance.producer_version")))),
        *[(f"missing provenance parameter {p}", go_on & F.coalesce(F.element_at(e("provenance.parameters"), p).isNull(), F.lit(True))) for p in PARAMETERS],
        ("missing or unknown context.source_event", go_on & ~known),
        ("profile mapping feature/action/state/polarity mismatch", go_on & known & ~F.coalesce(expected, F.lit(False))),
        ("STAY/DWELL require magnitude seconds and end_time", go_on & lasting & ~complete),
        ("interval magnitude does not equal end_time-event_time", go_on & lasting & complete & F.coalesce(F.abs(span - e("magnitude")) > 1e-6, F.lit(False))),
        ("STAY duration is not strictly below dwell threshold", go_on & (kind == "STAY") & complete & (e("magnitude") >= threshold)),
        ("DWELL duration is below dwell threshold", go_on & (kind == "DWELL") & complete & (e("magnitude") < threshold)),
        ("GAP requires magnitude in seconds", go_on & (kind == "GAP") & (e("magnitude").isNull() | ~unit_is("s"))),
        ("DISCONTINUITY requires magnitude in metres", go_on & (kind == "DISCONTINUITY") & (e("magnitude").isNull() | ~unit_is("m"))),
    ]


def errors(parsed: DataFrame) -> DataFrame:
    """A row for each broken rule: all columns of `parsed`, event_id and error."""
    parsed = parsed.withColumns({"at": T.parse(F.coalesce("e.event_time", F.lit("")), decimals=False), "until": T.parse(F.coalesce("e.end_time", F.lit("")), decimals=False)})
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(message)) for message, bad in checks()]))
    found = F.when(F.col("e").isNull() | F.col("e._bad").isNotNull(), F.array(F.lit("invalid JSON"))).otherwise(broken)
    return parsed.withColumn("event_id", F.coalesce("e.id", F.lit(""))).withColumn("error", F.explode(found))


def validate_file(spark: SparkSession, path: str, limit: int = 1000) -> tuple[int, list[str]]:
    """Number of events in a JSONL file, and messages for the first `limit` broken rules with their lines; empty lines are skipped."""
    from waymark.sources.csv_input import _numbered

    parsed = parse(_numbered(spark, path)).persist()
    events = parsed.where("e is not null and e._bad is null").count()
    found = errors(parsed).orderBy("source_row").limit(limit).select("source_row", "event_id", "error").collect()
    parsed.unpersist()
    return events, [f"line {r['source_row']}: invalid JSON" if r["error"] == "invalid JSON" else f"line {r['source_row']} ({r['event_id']}): {r['error']}" for r in found]
