import io
import json
import os

import pyarrow.parquet as pq
import pytest

from waymark import cli
from waymark.config import Config
from waymark.operators.conformance import validate_file
from waymark.plans.analyst import Dataset, decode_cursor, encode_cursor, limit_of
from waymark.plans.eventize import eventize
from waymark.server import answer, serve

CSV = """id,ts,lat,lon,ha
a,2026-09-01T10:00:00Z,51.5000,-0.1000,10
a,2026-09-01T10:05:00Z,51.5000,-0.1000,10
a,2026-09-01T10:10:00Z,51.5050,-0.1000,10
a,2026-09-01T10:12:00Z,51.5060,-0.1000,10
a,2026-09-01T10:14:00Z,51.5060,-0.1000,10
a,2026-09-01T10:30:00Z,51.5060,-0.1000,10
b,2026-09-01T09:00:00Z,52.0000,-1.0000,8
b,2026-09-01T09:20:00Z,52.0000,-1.0000,8
b,2026-09-01T12:00:00Z,52.0000,-1.0000,8
b,2026-09-01T12:00:10Z,53.0000,-1.0000,
c,never,0,0,1
"""


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    (folder / "in.csv").write_text(CSV)
    manifest = eventize(spark, str(folder / "in.csv"), str(folder / "out"), Config(source="test", trace_ids=("a",), output_profile="full", parquet_row_group_rows=4))
    return folder, manifest


def test_manifest_and_files(written):
    folder, m = written
    s = m["stats"]
    assert (s["input_rows"], s["rejected_rows"], s["normalized_rows"], s["entity_count"], s["presence_count"], s["transition_count"], s["gap_count"], s["discontinuity_count"]) == (11, 1, 10, 2, 3, 1, 1, 1)
    assert set(s["diagnostics"]["closure"].values()) == {0}
    assert s["reject_reasons"] == {"invalid_ts": 1} and m["storage"]["total_bytes"] > 0
    layer = folder / "out" / "analysis" / "observations.parquet"
    file = next(p for p in sorted(layer.iterdir()) if p.name.endswith(".parquet") and pq.ParquetFile(p).metadata.num_rows)
    meta = pq.ParquetFile(file).schema_arrow.metadata
    assert json.loads(meta[b"geo"])["primary_column"] == "geometry" and b"xq:eventizer" in meta
    assert s["parquet"]["observations"]["row_groups"] >= 3
    trace = (folder / "out" / m["traces"][0]).read_text().splitlines()
    assert len(trace) == 7 and sum("departure_confirmed" in line for line in trace) == 1


def test_output_is_guarded(spark, written):
    folder, _ = written
    with pytest.raises(FileExistsError):
        eventize(spark, str(folder / "in.csv"), str(folder / "out"), Config(source="test"))
    before = sorted(os.listdir(folder / "out"))
    with pytest.raises(ValueError):
        eventize(spark, str(folder / "in.csv"), str(folder / "out"), Config(source="test", replace_output=True, strict=True))
    assert sorted(os.listdir(folder / "out")) == before


def test_events_conform(spark, written):
    folder, m = written
    events, errors = validate_file(spark, str(folder / "out" / "canonical" / "events.jsonl"))
    assert (events, errors) == (m["stats"]["event_count"], [])
    bad = folder / "bad.jsonl"
    bad.write_text('{"id": "x"}\n\nnot json\n')
    events, errors = validate_file(spark, str(bad))
    assert events == 1 and any("missing provenance" in e for e in errors) and any("line 2: invalid JSON" in e for e in errors)


def test_questions(spark, written):
    folder, _ = written
    d = Dataset.open(spark, str(folder / "out" / "manifest.json"))
    assert d.summary()["entities"] == 2 and d.summary()["h3_resolution"] == -1
    first = d.page(d.timeline("a"), 4)
    assert first.has_more and len(first.rows) == 4
    rest = d.page(d.timeline("a"), 100, first.next_cursor)
    assert not rest.has_more and len(first.rows) + len(rest.rows) == 9
    disc = d.rows(d.events(event_type="DISCONTINUITY"))[0]
    why = d.explain_discontinuity(disc["event_id"])
    assert why["reason"] == "jump_and_speed" and why["edge_accuracy_state"] == "current_missing" and why["previous_observation"]["lat"] == 52.0
    assert len(d.explain_event(disc["event_id"])["nearby_observations"]) == 4
    assert [r["entity_id"] for r in d.rows(d.search_entities(min_transitions=1))] == ["a"]
    assert d.page(d.presence(start="2026-09-01T10:12:00Z", end="2026-09-01T10:12:00Z")).rows[0]["classification"] == "dwell"
    for wrong in (lambda: d.presence(start="2026-09-02T00:00:00Z", end="2026-09-01T00:00:00Z"), lambda: d.observations(), lambda: d.search_entities(sort_by="x"), lambda: d.presence(h3_cell="8928308280fffff"), lambda: d.presence(start="today"), lambda: d.timeline("")):
        with pytest.raises(ValueError):
            wrong()


def test_paging():
    assert decode_cursor(encode_cursor(250)) == 250 and decode_cursor("") == 0
    assert [limit_of(n) for n in (None, 0, 7, 5000)] == [100, 100, 7, 1000]
    with pytest.raises(ValueError):
        decode_cursor("###")


def test_server(spark, written):
    folder, _ = written
    d = Dataset.open(spark, str(folder / "out"))
    ask = lambda method, **params: answer(d, {"jsonrpc": "2.0", "id": 1, "method": method, "params": params})
    assert ask("initialize")["result"]["serverInfo"]["name"] == "waymark"
    names = {t["name"] for t in ask("tools/list")["result"]["tools"]}
    assert len(names) == 11 and "describe_h3_cell" not in names
    page = ask("tools/call", name="get_entity_timeline", arguments={"entity_id": "a", "from": "2026-09-01T10:12:00Z", "limit": 2})["result"]["structuredContent"]
    assert len(page["rows"]) == 2 and page["has_more"]
    assert ask("tools/call", name="get_entity", arguments={"entity_id": "zz"})["result"]["isError"]
    assert "error" in ask("tools/call", name="get_entity", arguments={"sql": "x"}) and "error" in ask("nothing")
    assert len(ask("resources/list")["result"]["resources"]) == 6
    assert "evidence" in ask("resources/read", uri="waymark://guidance")["result"]["contents"][0]["text"]
    out = io.StringIO()
    serve(d, io.StringIO('{"jsonrpc":"2.0","method":"notifications/initialized"}\n{"jsonrpc":"2.0","id":7,"method":"ping"}\nnot json\n'), out)
    assert [json.loads(line).get("id") for line in out.getvalue().splitlines()] == [7, None]


def test_command_line(spark, written, capsys):
    folder, _ = written
    assert cli.main(["version"]) == 0
    assert cli.main(["inspect", str(folder / "out"), "--diagnostics"]) == 0
    assert "entities 2" in capsys.readouterr().out
    assert cli.main(["inspect", str(folder / "out"), "--entity", "a", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["transition_count"] == 1
    assert cli.main(["inspect", str(folder / "none")]) == 1
    args = cli.parser().parse_args(["eventize", "x.csv", "--out", "y", "--source", "s", "--no-confirm-moves", "--trace-id", "a"])
    assert cli.config_of(args) == Config(source="s", confirm_moves=False, trace_ids=("a",))
