import datetime as dt

from waymark.config import Config
from waymark.streaming.presence_stream import presence_decisions, windowed_counts

SCHEMA = "entity_id string, ts timestamp, lat double, lon double, ha double"
AT = dt.datetime(2026, 9, 1, 10)


def at(minutes):
    return AT + dt.timedelta(minutes=minutes)


def stream(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(folder / f"in/{i:03d}"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in/*"))


def finish(df, name, folder, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)


def test_decisions_with_late_rows(spark, tmp_path):
    move = [("a", at(m), lat, -0.1, 5.0) for m, lat in ((0, 51.5), (5, 51.5), (10, 51.505), (12, 51.506), (14, 51.506))]
    batches = [[move[0], move[2]], [move[1], move[3]], [move[4]], [("z", at(600), 0.0, 0.0, None)], [("z", at(601), 0.0, 0.0, None)]]
    finish(presence_decisions(stream(spark, tmp_path, batches), Config(source="s")), "decided", tmp_path)
    found = [(r["decision"], r["kind"]) for r in spark.sql("select * from decided where entity_id = 'a' order by ts").collect()]
    assert found == [("dataset_start", "START"), ("presence_confirmed_dataset_start", ""), ("departure_candidate_started", ""), ("departure_confirmed", "LEAVE"), ("presence_confirmed_arrival_transition", "ENTER")]


def test_windowed_counts(spark, tmp_path):
    batches = [[("a", at(0), 51.5, -0.1, 5.0), ("b", at(1), 51.5, -0.1, 5.0)], [("z", at(600), 0.0, 0.0, None)], [("z", at(601), 0.0, 0.0, None)]]
    finish(windowed_counts(stream(spark, tmp_path, batches), Config(source="s")), "counted", tmp_path)
    first = spark.sql("select * from counted order by window_start").first()
    assert (first["observation_count"], first["entity_count"]) == (2, 2)
