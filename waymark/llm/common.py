"""Shared pieces: checkpoints in the cluster's shared folder, Arrow columns as bytes, connected components."""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Where that is unset, a folder of its own in local mode; on a cluster, whose machines would not share it, RuntimeError."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="waymark-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared checkpoint folder, so that later jobs neither recompute them nor depend on one executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of files that are no longer read, by Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are over: it does so when the driver collects garbage, which loops of small jobs hardly cause."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_cut(df: DataFrame) -> None:
    """Deletes the files of a `cut` that nothing reads any more."""
    plan = df._jdf.queryExecution().logical()
    file = plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None
    if file is not None and file.isDefined():
        remove_folder(df.sparkSession, file.get())


#: Rows and bytes of one Arrow batch of documents between the JVM and Python.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def document_batches(spark: SparkSession) -> None:
    """Lowers the session's limits of Arrow batches to BATCH_ROWS and BATCH_BYTES: whole documents are large rows, and both sides hold a batch at a time."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key)
        size = int(now[:-1] if now.endswith("b") else now) if now.rstrip("b").lstrip("-").isdigit() else 0
        if not 0 < size <= most:
            spark.conf.set(key, str(most))


def column_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column's values in UTF-8."""
    return column.cast(pa.large_binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], weight: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches into slices with about `most` bytes in column `weight`, one row at least."""
    for batch in batches:
        n, start, size = batch.num_rows, 0, 0
        if batch.nbytes <= most:
            if n:
                yield batch
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(weight)).cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)
        for i, length in enumerate(lengths):
            if size and size + length > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += int(length)
        if n > start:
            yield batch.slice(start)


#: Edges in one part of a round's written edges.
EDGES_A_PART = 250_000


def _edge_state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return int(row["n"]), int(row["h"] or 0)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of undirected edges (u, v); root is the smallest node reachable.

    Alternating large-star and small-star rounds. Each round is a minimum by key (combined before the shuffle) and an
    equi-join back, which AQE can split when a node has many neighbours. The loop ends when the edges no longer change.
    Rows with a null end and self-loops are dropped. Raises RuntimeError if max_rounds do not suffice.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _edge_state(edges)
    if not state[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # Repeated edges stay until the end of the round: one shuffle less.
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        made = small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        last, edges = edges, cut(made.coalesce(1 + state[0] // EDGES_A_PART))
        drop_cut(last)
        del last, both, least, large, down, joined, small, made
        free_shuffles(edges.sparkSession)
        now = _edge_state(edges)
        if now == state:
            stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
        state = now
    raise RuntimeError(f"no fixed point in {max_rounds} rounds")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
