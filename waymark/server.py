"""The analyst's tools over JSON-RPC on standard input and output, one message a line."""

from __future__ import annotations

import json
import sys
from dataclasses import asdict
from typing import IO, Any

from waymark.config import ANALYSIS_CONTRACT, EVENTIZER_VERSION, TOOLS_CONTRACT, VERSION
from waymark.plans.analyst import SORT_FIELDS, Dataset, Page

PROTOCOL = "2025-03-26"
GUIDANCE = """# How to read this dataset
Observations are evidence. Events, presence intervals, segments and transitions are derived from them by fixed rules.
A GAP is missing evidence, not travel. A DISCONTINUITY violates the continuity model; it does not prove travel.
A missing radius of uncertainty is unknown, not zero. Counts of known and missing radii stand beside each derived object.
Results come in pages: ask again with next_cursor while has_more is true."""
CONTRACTS = {
    "eventizer": f"# {EVENTIZER_VERSION}\nPresence needs two rows within the move radius of a fixed anchor. A departure needs two rows outside within the confirmation window. ENTER needs a confirmed departure before it. Gaps and discontinuities reset the search.",
    "analysis": f"# {ANALYSIS_CONTRACT}\nLayers: observations, events, presence_intervals, transitions, segments, entities, and tracks in the full profile. Times are in milliseconds, UTC. H3 columns may be null.",
    "tools": f"# {TOOLS_CONTRACT}\nTools take fixed inputs and run no free SQL. At most 1000 rows a call; cursors are opaque.",
}

_TEXT, _COUNT, _NUMBER, _FLAG = {"type": "string"}, {"type": "integer"}, {"type": "number"}, {"type": "boolean"}
_PAGE = {"limit": _COUNT, "cursor": _TEXT}
_TIMES = {"entity_id": _TEXT, "from": _TEXT, "to": _TEXT}


def _page(plan: str) -> Any:
    def call(d: Dataset, a: dict[str, Any]) -> Page:
        a = {{"from": "start", "to": "end"}.get(k, k): v for k, v in a.items()}
        limit, cursor = a.pop("limit", None), a.pop("cursor", "")
        return d.page(getattr(d, plan)(**a), limit, cursor)

    return call


TOOLS: dict[str, tuple[str, dict[str, Any], Any]] = {
    "dataset_summary": ("Totals and settings of the dataset", {}, lambda d, a: d.summary()),
    "search_entities": ("Entities by activity, support and dwell", {"min_observations": _COUNT, "min_presence_intervals": _COUNT, "min_transitions": _COUNT, "min_discontinuities": _COUNT, "min_dwell_seconds": _NUMBER, "ha_class": _TEXT, "min_ha_coverage_pct": _NUMBER, "sort_by": {"type": "string", "enum": list(SORT_FIELDS)}, "ascending": _FLAG, **_PAGE}, _page("search_entities")),
    "get_entity": ("One entity's summary", {"entity_id": _TEXT}, lambda d, a: d.get_entity(a.get("entity_id", ""))),
    "get_entity_timeline": ("Events, presence and transitions of an entity in order", {**_TIMES, **_PAGE}, _page("timeline")),
    "get_presence": ("Presence intervals", {**_TIMES, "h3_cell": _TEXT, "classification": _TEXT, **_PAGE}, _page("presence")),
    "get_transitions": ("Confirmed transitions", {**_TIMES, "origin_h3_cell": _TEXT, "destination_h3_cell": _TEXT, "accuracy_support": _TEXT, **_PAGE}, _page("transitions")),
    "get_segments": ("Trajectory segments", {**_TIMES, **_PAGE}, _page("segments")),
    "get_events": ("Semantic events", {**_TIMES, "event_type": _TEXT, "h3_cell": _TEXT, **_PAGE}, _page("events")),
    "get_observations": ("Observations of an entity or a cell", {**_TIMES, "h3_cell": _TEXT, **_PAGE}, _page("observations")),
    "describe_h3_cell": ("What happens in an H3 cell", {"h3_cell": _TEXT, "flow_limit": _COUNT}, lambda d, a: d.describe_h3_cell(a.get("h3_cell", ""), a.get("flow_limit", 0))),
    "explain_event": ("An event with the evidence around it", {"event_id": _TEXT}, lambda d, a: d.explain_event(a.get("event_id", ""))),
    "explain_discontinuity": ("Why a step is a discontinuity", {"event_id": _TEXT}, lambda d, a: d.explain_discontinuity(a.get("event_id", ""))),
}


def tools(dataset: Dataset) -> dict[str, tuple[str, dict[str, Any], Any]]:
    """The tools that the dataset supports: cells are described only where there are any."""
    return {k: v for k, v in TOOLS.items() if dataset.has_h3 or k != "describe_h3_cell"}


def resources(dataset: Dataset) -> dict[str, tuple[str, str]]:
    named = {"waymark://manifest": ("application/json", json.dumps(dataset.manifest, default=str)), "waymark://capabilities": ("application/json", json.dumps({"tools": sorted(tools(dataset)), "h3_available": dataset.has_h3, "max_rows": 1000})), "waymark://guidance": ("text/markdown", GUIDANCE)}
    return named | {f"waymark://contract/{k}": ("text/markdown", v) for k, v in CONTRACTS.items()}


def _content(result: Any) -> dict[str, Any]:
    plain = json.dumps(asdict(result) if isinstance(result, Page) else result, default=lambda o: asdict(o) if isinstance(o, Page) else str(o))
    return {"content": [{"type": "text", "text": plain}], "structuredContent": json.loads(plain), "isError": False}


def answer(dataset: Dataset, message: dict[str, Any]) -> dict[str, Any] | None:
    """The reply to one request; none to a notification."""
    method, params, ident = message.get("method"), message.get("params") or {}, message.get("id")
    if ident is None:
        return None
    reply = {"jsonrpc": "2.0", "id": ident}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}, "resources": {}}, "serverInfo": {"name": "waymark", "version": VERSION}, "instructions": GUIDANCE}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": [{"name": k, "description": d, "inputSchema": {"type": "object", "properties": p, "additionalProperties": False}} for k, (d, p, _) in tools(dataset).items()]}}
    if method == "resources/list":
        return reply | {"result": {"resources": [{"uri": k, "name": k.split("://")[1], "mimeType": kind} for k, (kind, _) in resources(dataset).items()]}}
    if method == "resources/read":
        found = resources(dataset).get(params.get("uri"))
        return reply | ({"result": {"contents": [{"uri": params["uri"], "mimeType": found[0], "text": found[1]}]}} if found else {"error": {"code": -32002, "message": "no such resource"}})
    if method == "tools/call":
        tool, given = tools(dataset).get(params.get("name")), params.get("arguments") or {}
        if tool is None or set(given) - set(tool[1]):
            return reply | {"error": {"code": -32602, "message": "no such tool" if tool is None else f"unknown arguments: {sorted(set(given) - set(tool[1]))}"}}
        try:
            return reply | {"result": _content(tool[2](dataset, dict(given)))}
        except (ValueError, LookupError, TypeError) as e:
            return reply | {"result": {"content": [{"type": "text", "text": str(e)}], "isError": True}}
    return reply | {"error": {"code": -32601, "message": f"unknown method {method!r}"}}


def serve(dataset: Dataset, source: IO[str] = sys.stdin, sink: IO[str] = sys.stdout) -> None:
    """Answers until the input ends. Standard output carries messages only."""
    for line in source:
        if not line.strip():
            continue
        try:
            reply = answer(dataset, json.loads(line))
        except json.JSONDecodeError as e:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        if reply is not None:
            sink.write(json.dumps(reply) + "\n")
            sink.flush()
