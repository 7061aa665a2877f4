"""Commands: eventize, validate, inspect, serve, version."""

from __future__ import annotations

import argparse
import json
import sys
from typing import Any

from waymark.config import EVENTIZER_VERSION, VERSION, Config


def session(name: str = "waymark") -> Any:
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="waymark")
    commands = top.add_subparsers(dest="command", required=True)
    run = commands.add_parser("eventize", help="make a dataset from a CSV file of observations")
    run.add_argument("input")
    run.add_argument("--out", required=True)
    default = Config()
    for name, kind in (("source", str), ("subject_prefix", str), ("geohash_precision", int), ("h3_resolution", int), ("move_radius_m", float), ("dwell_threshold_s", float), ("gap_threshold_s", float), ("max_speed_mps", float), ("max_jump_m", float), ("confirm_window_s", float), ("walk_max_speed_mps", float), ("walk_max_jump_m", float), ("accuracy_policy", str), ("ha_policy", str), ("max_ha_m", float), ("partitions", int), ("output_profile", str), ("parquet_compression", str), ("parquet_row_group_rows", int), ("parquet_dictionary_max_bytes", int)):
        run.add_argument("--" + name.replace("_", "-"), type=kind, default=getattr(default, name))
    run.add_argument("--confirm-moves", action=argparse.BooleanOptionalAction, default=True)
    run.add_argument("--allow-missing-ha", action="store_true", help="the same as --ha-policy preserve")
    run.add_argument("--strict", action="store_true")
    run.add_argument("--replace-output", action="store_true")
    run.add_argument("--trace-id", action="append", default=[])
    check = commands.add_parser("validate", help="check a file of events")
    check.add_argument("events")
    look = commands.add_parser("inspect", help="show a dataset or one of its entities")
    look.add_argument("dataset")
    look.add_argument("--entity")
    look.add_argument("--diagnostics", action="store_true")
    look.add_argument("--json", action="store_true")
    serve = commands.add_parser("serve", help="answer the analyst's tools on standard input and output")
    serve.add_argument("dataset")
    commands.add_parser("version")
    return top


def config_of(args: argparse.Namespace) -> Config:
    names = set(Config.__dataclass_fields__) & set(vars(args))
    given = {n: getattr(args, n) for n in names} | {"trace_ids": tuple(args.trace_id)}
    if args.allow_missing_ha:
        given["ha_policy"] = "preserve"
    return Config(**given)


def top_bins(table: list[dict[str, Any]], n: int = 10) -> list[str]:
    """The fullest bins of a diagnostic table, most first, then by name."""
    key = lambda r: "/".join("*" if v is None else str(v) for k, v in r.items() if k != "n")
    return [f"  {key(r)}: {r['n']}" for r in sorted(table, key=lambda r: (-r["n"], key(r)))[:n]]


def human_bytes(n: float) -> str:
    for unit in ("B", "KiB", "MiB", "GiB", "TiB"):
        if n < 1024 or unit == "TiB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return ""


def summary_lines(manifest: dict[str, Any], diagnostics: bool = False) -> list[str]:
    s, storage = manifest["stats"], manifest["storage"]
    lines = [
        f"dataset {manifest['source']} by {manifest['tool']} {manifest['tool_version']}, {manifest['eventizer']}",
        f"rows {s['input_rows']}, valid {s['valid_rows']}, rejected {s['rejected_rows']}, normalized {s['normalized_rows']}, entities {s['entity_count']}",
        f"events {s['event_count']}, presence {s['presence_count']}, transitions {s['transition_count']}, segments {s['segment_count']}, gaps {s['gap_count']}, discontinuities {s['discontinuity_count']}",
        f"HA coverage {s['normalized_ha_coverage_pct']:.2f} %, analysis {human_bytes(storage['analysis_bytes'])}, events {human_bytes(storage['canonical_bytes'])}",
    ]
    lines += [f"  rejected {k}: {v}" for k, v in sorted(s["reject_reasons"].items())]
    if diagnostics:
        d = s["diagnostics"]
        lines += ["counters"] + [f"  {k}: {v}" for k, v in d["counters"].items()] + ["steps by state and time"] + top_bins(d["edge_dt_bands"]) + ["discontinuities"] + top_bins(d["discontinuity_cube"]) + ["closure"] + [f"  {k}: {v}" for k, v in d["closure"].items()]
    return lines


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(f"waymark {VERSION} ({EVENTIZER_VERSION})")
        return 0
    try:
        if args.command == "inspect" and not args.entity:
            from waymark.sources.dataset import read_manifest

            manifest, _ = read_manifest(args.dataset)
            print(json.dumps(manifest, indent=2) if args.json else "\n".join(summary_lines(manifest, args.diagnostics)))
            return 0
        if args.command == "eventize":
            from waymark.plans.eventize import eventize

            print("\n".join(summary_lines(eventize(session(), args.input, args.out, config_of(args).validate()))))
            return 0
        if args.command == "validate":
            from waymark.operators.conformance import validate_file

            events, messages = validate_file(session(), args.events)
            print(f"{events} events, {len(messages)} errors")
            for m in messages:
                print(m, file=sys.stderr)
            return 1 if messages else 0
        from waymark.plans.analyst import Dataset

        dataset = Dataset.open(session(), args.dataset)
        if args.command == "inspect":
            entity = dataset.get_entity(args.entity)
            print(json.dumps(entity, indent=2, default=str) if args.json else "\n".join(f"{k}: {v}" for k, v in entity.items()))
            return 0
        from waymark.server import serve

        serve(dataset)
        return 0
    except (ValueError, LookupError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
