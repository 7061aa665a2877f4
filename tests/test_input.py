import pytest
from pyspark.sql import functions as F

from waymark.config import Config
from waymark.functions import timestamps as T
from waymark.functions.jsontext import number, text
from waymark.functions.wkb import path_bytes, point_bytes
from waymark.sources.csv_input import header_columns, read_observations
from waymark.sources.sinks import trace_file_name

GOOD = {
    "2026-09-01T10:00:00Z": (1788256800, 0), "2026-09-01T10:00:00.123456789Z": (1788256800, 123456789), "2026-09-01T11:00:00+01:00": (1788256800, 0), "1788256800": (1788256800, 0), "1788256800123": (1788256800, 123000000),
    "1788256800123456": (1788256800, 123456000), "1788256800123456789": (1788256800, 123456789), "1788256800.5": (1788256800, 500000000), "1.7882568e9": (1788256800, 0), "-1": (-1, 0), "-1.5": (-2, 500000000), "0": (0, 0), "1788256800123.5": (1788256800, 123500000), ".5": (0, 500000000), "1969-12-31T23:59:59.5Z": (-1, 500000000),
}
BAD = ["", "yesterday", "2026-09-01", "2026-09-01 10:00:00Z", "2026-09-01T10:00:00", "2026-13-01T10:00:00Z", "2026-02-30T10:00:00Z", "NaN", "1e999", "0x10", "1,5", "9" * 130, "1e-500"]


def test_timestamps(spark):
    rows = spark.createDataFrame([(t,) for t in [*GOOD, *BAD]], "t string").select("t", T.parse(F.col("t")).alias("p")).collect()
    found = {r["t"]: (r["p"]["s"], r["p"]["ns"]) if r["p"] is not None else None for r in rows}
    assert {t: found[t] for t in GOOD} == GOOD
    assert [t for t in BAD if found[t] is not None] == []


def write(tmp_path, body):
    path = tmp_path / "in.csv"
    path.write_text(body)
    return str(path)


def test_rejects(spark, tmp_path):
    path = write(tmp_path, "LAT, lon ,ID,ha,ts,more\n51.5,-0.1,a,5,1788256800,x\n51.5,-0.1,,5,1788256800\n51.5,-0.1,a,5,never\n95,-0.1,a,5,1788256800\n51.5,200,a,5,1788256800\n\n51.5,-0.1,a,wide,1788256800\n51.5,-0.1,a,-1,1788256800\n51.5,-0.1,a,NaN,1788256800\n\"51.5\"x,-0.1,a,5,1788256800\n51.5,-0.1,\"a, \"\"b\"\"\",,1788256800\n")
    found = read_observations(spark, path, Config(source="t"))
    assert [(r["source_row"], r["reason_code"]) for r in found.rejects.orderBy("source_row").collect()] == [(3, "empty_id"), (4, "invalid_ts"), (5, "invalid_lat"), (6, "invalid_lon"), (7, "non_numeric_ha"), (8, "negative_ha"), (9, "non_finite_ha"), (10, "csv_parse_error")]
    assert [(r["entity_id"], r["source_row"], r["ha"]) for r in found.accepted.orderBy("source_row").collect()] == [("a", 2, 5.0), ('a, "b"', 11, None)]
    assert read_observations(spark, path, Config(source="t", ha_policy="require")).rejects.where("reason_code = 'missing_ha'").count() == 1
    assert read_observations(spark, path, Config(source="t", max_ha_m=4.0)).rejects.where("reason_code = 'ha_exceeds_max'").count() == 1
    with pytest.raises(ValueError, match="CSV row 3"):
        read_observations(spark, path, Config(source="t", strict=True))


def test_rows_are_numbered_over_many_blocks(spark, tmp_path):
    path = write(tmp_path, "id,ts,lat,lon,ha\n" + "".join(f"e{i},{1788256800 + i},1.5,2.5,3\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = read_observations(spark, path, Config(source="t")).accepted.select("entity_id", "source_row").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["entity_id"]: r["source_row"] for r in rows} == {f"e{i}": i + 2 for i in range(5000)}


@pytest.mark.parametrize("block", ["1000000", "64"])
def test_quoted_line_breaks(spark, tmp_path, block):
    """A field over three lines with an empty one, a quote that closes badly, a line that closes one field and opens another, an empty first field beside quotes."""
    body = 'id,ts,lat,lon,ha,note\n' + "a,1788256800,1,2,3,x\n" * 5 + 'b,1788256801,1,2,3,"one\n\n, ""two""\n"\n'
    body += 'c,1788256802,1,2,"3"x,"y"\n"d\nd"x,1788256803,1,2,3\n"e\ne",1788256804,1,2,3,"p\nq"\n\n,"1788256805",1,2,3\n' + "f,1788256806,1,2,,x\n" * 5
    path = write(tmp_path, body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = read_observations(spark, path, Config(source="t"))
        accepted = [(r["source_row"], r["entity_id"], r["ts_s"] - 1788256800) for r in found.accepted.orderBy("source_row").collect()]
        rejects = [(r["source_row"], r["reason_code"]) for r in found.rejects.orderBy("source_row").collect()]
        unclosed = read_observations(spark, write(tmp_path, body + 'g,1788256807,1,2,3,"z\n' + "h,1788256808,1,2,3,w\n" * 5), Config(source="t")).rows.orderBy("source_row").select("source_row", "reject_code").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert accepted == [*[(i, "a", 0) for i in range(2, 7)], (7, "b", 1), (10, "e\ne", 4), *[(i, "f", 6) for i in range(12, 17)]]
    assert rejects == [(8, "csv_parse_error"), (9, "csv_parse_error"), (11, "empty_id")]
    assert [tuple(r) for r in unclosed[-1:]] == [(17, "csv_parse_error")] and len(unclosed) == 16


def test_header():
    assert header_columns(" Ha,LON,lat,ts,id,id") == {"id": 5, "ts": 3, "lat": 2, "lon": 1, "ha": 0}
    with pytest.raises(ValueError, match="ha"):
        header_columns("id,ts,lat,lon")


def test_config():
    assert Config(source="s").validate().parameters()["move_radius_m"] == 100
    for bad in ({"source": " "}, {"geohash_precision": 13}, {"h3_resolution": 16}, {"partitions": 0}, {"ha_policy": "x"}, {"move_radius_m": -1.0}, {"move_radius_m": float("nan")}, {"output_profile": "x"}, {"parquet_compression": "lz4"}):
        with pytest.raises(ValueError):
            Config(**{"source": "s", **bad}).validate()


def test_json_numbers():
    assert [number(x) for x in (100.0, 1e7, 1.5e-5, 1e21, 1e-7, 0.1, -0.0)] == ["100", "10000000", "0.000015", "1e+21", "1e-07", "0.1", "-0"]
    assert text({"b": "<&>", "a": [1, True, None]}) == '{"a":[1,true,null],"b":"\\u003c\\u0026\\u003e"}'


def test_geometry():
    assert point_bytes(1.0, 2.0).hex() == "0101000000000000000000f03f0000000000000040"
    assert path_bytes([[(1.0, 2.0)]]) == point_bytes(1.0, 2.0)
    many = path_bytes([[(1.0, 2.0)], [(3.0, 4.0), (5.0, 6.0)]])
    assert many[:9].hex() == "010500000002000000" and many[9:18].hex() == "010200000002000000"


def test_trace_names():
    assert trace_file_name("a") == "a-ca978112.csv" and trace_file_name("../x").startswith("x-") and trace_file_name("///").startswith("entity-")
