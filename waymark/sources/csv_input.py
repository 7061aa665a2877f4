"""CSV observations: id, ts, lat, lon, ha, with rejects.

Lines are read as text and split by one pattern, so that quoting is judged as strictly as the format asks: a bare quote, or
text after a closing one, is a parse error; ragged rows are not; empty lines do not count. A quoted field may hold line breaks;
a file that ends inside one has a last record that is a parse error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.config import Config
from waymark.functions import expressions as X
from waymark.functions import timestamps as T

REQUIRED = ("id", "ts", "lat", "lon", "ha")
# Reasons of rejection, in the order in which they are looked for.
REASONS = {
    "csv_parse_error": "malformed CSV record", "empty_id": "empty id", "invalid_ts": "invalid ts", "invalid_lat": "invalid lat", "invalid_lon": "invalid lon",
    "missing_ha": "missing ha", "non_numeric_ha": "non-numeric ha", "non_finite_ha": "non-finite ha", "negative_ha": "negative ha", "ha_exceeds_max": "ha exceeds max-ha-m",
}
# Possessive, so that Java's patterns neither try again nor recurse over long fields.
_BODY = r'[^"]*+(?:""[^"]*+)*+'
_FIELD = rf'(?:"{_BODY}"|[^",]*+)'
_RECORD = rf'^{_FIELD}(?:,{_FIELD})*+\z'
_SPLIT = rf',({_FIELD})'
#: A line that opens a quoted field and does not close it; one that begins inside a quoted field and ends inside one.
_OPENS = rf'^(?:{_FIELD},)*+"{_BODY}\z'
_STAYS = rf'^{_BODY}(?:"(?:,{_FIELD})*?,"{_BODY})?\z'
#: Blocks of files whose table is broadcast; more are joined by a shuffle.
BROADCAST_BLOCKS = 100_000
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_SPECIAL = r"(?i)^[+-]?(inf|infinity)$|^nan$"


@dataclass
class Ingested:
    """`rows` has every record with its reject_code (null if accepted)."""

    rows: DataFrame

    @property
    def accepted(self) -> DataFrame:
        return self.rows.where("reject_code is null").select(F.col("id").alias("entity_id"), "ts_s", "ts_ns", "source_row", F.col("lat_value").alias("lat"), F.col("lon_value").alias("lon"), F.col("ha_value").alias("ha"), "lat_places", "lon_places")

    @property
    def rejects(self) -> DataFrame:
        reason = F.element_at(F.create_map(*[x for k, v in REASONS.items() for x in (F.lit(k), F.lit(v))]), F.col("reject_code"))
        blank = F.col("reject_code") == "csv_parse_error"
        fields = [F.when(blank, "").otherwise(F.col(c)).alias(c) for c in REQUIRED]
        return self.rows.where("reject_code is not null").select("source_row", F.col("reject_code").alias("reason_code"), reason.alias("reason"), *fields)


def number(text: Column) -> Column:
    """A double as written in decimal notation or as inf or nan; null for anything else, such as 5d."""
    return F.when(text.rlike(_NUMBER), text.try_cast("double")).when(text.rlike(_SPECIAL), F.when(F.lower(text).contains("nan"), F.lit(float("nan"))).when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))


def overflows(text: Column, value: Column) -> Column:
    """Digits that stand for a number beyond a double's range."""
    return text.rlike(_NUMBER) & value.isin(float("inf"), float("-inf"))


def judge(fields: DataFrame, cfg: Config) -> DataFrame:
    """Records (source_row, parse_ok, id, ts, lat, lon, ha as text) with their values and the code of the first check that fails."""
    trimmed = fields.withColumns({c: F.btrim(F.coalesce(F.col(c), F.lit("")), F.lit(" \t\r\n\x0b\x0c\u0085 ")) for c in REQUIRED})
    timed = trimmed.withColumn("t", T.parse(F.col("ts")))
    values = timed.withColumns({"ts_s": F.col("t.s"), "ts_ns": F.col("t.ns"), "lat_value": number(F.col("lat")), "lon_value": number(F.col("lon")), "ha_value": number(F.col("ha"))})
    lat, lon, ha, blank = F.col("lat_value"), F.col("lon_value"), F.col("ha_value"), F.col("ha") == ""
    bad = lambda v, most: v.isNull() | F.isnan(v) | ~v.between(-most, most)
    most = F.lit(cfg.max_ha_m if cfg.max_ha_m > 0 else float("inf"))
    code = (
        F.when(~F.col("parse_ok"), "csv_parse_error").when(F.col("id") == "", "empty_id").when(F.col("ts_s").isNull(), "invalid_ts").when(bad(lat, 90.0), "invalid_lat").when(bad(lon, 180.0), "invalid_lon")
        .when(blank & F.lit(cfg.ha_policy == "require"), "missing_ha").when(blank, F.lit(None))
        .when(ha.isNull() | overflows(F.col("ha"), ha), "non_numeric_ha").when(F.isnan(ha) | ha.isin(float("inf"), float("-inf")), "non_finite_ha").when(ha < 0, "negative_ha").when(ha > most, "ha_exceeds_max")
    )
    return values.withColumns({"reject_code": code, "lat_places": X.decimal_places(F.col("lat")), "lon_places": X.decimal_places(F.col("lon"))})


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _starts(blocks: DataFrame) -> DataFrame:
    """Blocks (file, block, n) with `start`, the sum of n over all blocks before. Sums by file come first, so that files are summed up apart."""
    before = (Window.unboundedPreceding, -1)
    files = blocks.groupBy("file").agg(F.sum("n").alias("n")).select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(*before)), F.lit(0)).alias("of_file"))
    in_file = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(*before)), F.lit(0))
    return blocks.withColumn("in_file", in_file).join(files, "file").withColumn("start", F.col("of_file") + F.col("in_file")).drop("of_file", "in_file", "n")


def _sized(blocks: DataFrame, n: int) -> DataFrame:
    return F.broadcast(blocks) if n <= BROADCAST_BLOCKS else blocks


def _numbered(spark: SparkSession, path: str, quoted: bool = False) -> DataFrame:
    """Lines with their ordinal from 1, empty lines left out; if `quoted`, records of CSV, whose quoted fields may hold line breaks.

    Lines are counted per block of the file and numbered from the blocks' sums: a table with a row for each block, not each line.
    Files in which no line leaves a quote open, the common case, have a record in each line.
    """
    lines = _lines(spark, path).where("value <> ''").withColumn("mid", F.monotonically_increasing_id())
    open_ = F.count_if((F.instr("value", '"') > 0) & F.col("value").rlike(_OPENS)) if quoted else F.lit(0).cast("long")
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("mid").alias("first"), open_.alias("open")).persist()
    many, opened = blocks.agg(F.count("*"), F.sum("open")).first()
    if opened:
        return _spanning(_lines(spark, path).withColumn("mid", F.monotonically_increasing_id()), many)
    starts = _starts(blocks.drop("open"))
    return lines.join(_sized(starts, many), ["file", "block"]).select((F.col("start") + F.col("mid") - F.col("first") + 1).alias("source_row"), "value")


def _spanning(lines: DataFrame, many: int) -> DataFrame:
    """Records that may span lines, of lines (value, file, block, mid).

    A line either ends inside a quoted field, or outside, or keeps or swaps the state that it began in. So the state after it is
    that after the last line which sets it, swapped as often as lines since do; blocks are chained in the same way.
    """
    quote = F.instr("value", '"') > 0
    lines = lines.withColumns({"from_out": quote & F.col("value").rlike(_OPENS), "from_in": ~quote | F.col("value").rlike(_STAYS)})

    def chain(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
        """`set`, the state that the rows so far set (null: none), and `odd`, whether they swap it an odd number of times since."""
        w = Window.partitionBy(*keys).orderBy(order)
        fixed, swap = F.col("from_out") == F.col("from_in"), F.col("from_out") & ~F.col("from_in")
        rows = rows.withColumns({"set": F.last(F.when(fixed, F.col("from_out")), True).over(w), "part": F.sum(fixed.cast("int")).over(w), "swap": swap.cast("int")})
        return rows.withColumn("odd", F.sum("swap").over(Window.partitionBy(*keys, "part").orderBy(order)) % 2 == 1).drop("part", "swap")

    def after(start: Column) -> Column:
        return F.coalesce("set", start) != F.col("odd")

    chained = chain(lines, ["file", "block"], "mid")
    ends = chained.groupBy("file", "block").agg(F.max_by(F.struct("set", "odd"), "mid").alias("e")).select("file", "block", F.coalesce("e.set", F.lit(False)).alias("a"), F.coalesce("e.set", F.lit(True)).alias("b"), F.col("e.odd").alias("o"))
    in_file = Window.partitionBy("file").orderBy("block")
    blocks = chain(ends.select("file", "block", (F.col("a") != F.col("o")).alias("from_out"), (F.col("b") != F.col("o")).alias("from_in")), ["file"], "block")
    blocks = blocks.withColumn("ends_in", after(F.lit(False))).select("file", "block", F.coalesce(F.lag("ends_in").over(in_file), F.lit(False)).alias("began_in"), F.last("ends_in").over(in_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("unclosed"))
    w = Window.partitionBy("file", "block").orderBy("mid")
    rows = chained.join(_sized(blocks, many), ["file", "block"]).withColumn("out_in", after(F.col("began_in")))
    rows = rows.withColumn("in_in", F.coalesce(F.lag("out_in").over(w), F.col("began_in"))).withColumn("begins", ~F.col("in_in") & (F.col("value") != ""))
    rows = rows.where("begins or in_in").withColumn("nth", F.sum(F.col("begins").cast("long")).over(w))
    starts = _starts(rows.groupBy("file", "block").agg(F.count_if("begins").alias("n")))
    rows = rows.join(_sized(starts, many), ["file", "block"]).withColumn("source_row", F.col("start") + F.col("nth"))
    whole = rows.where("not in_in and not out_in").select("source_row", "value")
    # What follows a quote that the file never closes is not gathered: the opening line alone is a parse error.
    last = F.max(F.when(F.col("unclosed") & F.col("out_in") & ~F.col("in_in"), F.col("source_row"))).over(Window.partitionBy("file"))
    pieces = rows.where("in_in or out_in").withColumn("last", last).where("not (in_in and coalesce(source_row = last, false))")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "mid", "value"))), lambda x: x["value"]), "\n")
    return whole.unionByName(pieces.groupBy("source_row").agg(text.alias("value")))


def unquote(field: Column) -> Column:
    return F.when(field.startswith('"'), F.replace(F.substr(field, F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))).otherwise(field)


def header_columns(header: str) -> dict[str, int]:
    """Position of each required column: names trimmed and in lower case, the last of equal ones, any order. ValueError if one is missing."""
    import csv

    names = next(csv.reader([header]), [])
    at = {n.strip().lower(): i for i, n in enumerate(names)}
    for name in REQUIRED:
        if name not in at:
            raise ValueError(f"missing required CSV header {name!r}")
    return {n: at[n] for n in REQUIRED}


def read_observations(spark: SparkSession, path: str, cfg: Config) -> Ingested:
    """All records of a CSV file. The header is record 1. With cfg.strict the first invalid record raises ValueError."""
    lines = _numbered(spark, path, quoted=True)
    header = lines.where("source_row = 1").head()
    if header is None:
        raise ValueError("read CSV header: the file is empty")
    at = header_columns(header["value"])
    fields = F.transform(F.regexp_extract_all(F.concat(F.lit(","), F.col("value")), F.lit(_SPLIT), F.lit(1)), unquote)
    # A record without quotes, the common case, is split without a pattern.
    parts = F.when(F.instr("value", '"') > 0, fields).otherwise(F.split("value", ",", -1))
    records = lines.where("source_row > 1").select("source_row", ((F.instr("value", '"') == 0) | F.col("value").rlike(_RECORD)).alias("parse_ok"), parts.alias("f"))
    named = records.select("source_row", "parse_ok", *[F.coalesce(F.get("f", F.lit(i)), F.lit("")).alias(n) for n, i in at.items()])
    out = Ingested(judge(named, cfg))
    if cfg.strict:
        first = out.rows.where("reject_code is not null").orderBy("source_row").select("source_row", "reject_code").head()
        if first is not None:
            raise ValueError(f"CSV row {first['source_row']}: {REASONS[first['reject_code']]}")
    return out
