"""Reading a written dataset: its manifest and its layers."""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from waymark.plans.analyst import LAYERS

MANIFEST = "manifest.json"


def dataset_root(path: str) -> str:
    """The folder of a dataset given by its folder or its manifest."""
    return os.path.dirname(path) or "." if os.path.basename(path) == MANIFEST else path


def read_manifest(path: str) -> tuple[dict[str, Any], str]:
    root = dataset_root(path)
    with open(os.path.join(root, MANIFEST), encoding="utf-8") as f:
        return json.load(f), root


def read_layers(spark: SparkSession, root: str, register: bool = False) -> dict[str, DataFrame]:
    """The layers under root/analysis, also as temporary views if asked for. Tracks are optional; any other missing layer is a ValueError."""
    found = {}
    for name in (*LAYERS, "tracks"):
        path = os.path.join(root, "analysis", f"{name}.parquet")
        if not os.path.exists(path):
            if name == "tracks":
                continue
            raise ValueError(f"missing layer {name}")
        found[name] = spark.read.parquet(path)
        if register:
            found[name].createOrReplaceTempView(name)
    return found
