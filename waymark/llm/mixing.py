"""Mixing sources to target weights.

Words per source are aggregated, repetition rates follow from the targets, and each document is emitted floor(rate) times
plus one more time with the probability of the fraction, decided by a seeded hash of its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
#: A table of sources up to this many rows is broadcast; a larger one is joined by shuffle, where AQE splits a hot source.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space, tab, LF, VT, FF and CR; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_plan(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target, rate) from rows (source, size).

    Sources in code point order, null last, get the weights in turn. Targets share `share` times all words by weight, none
    above `cap` times its source's words; what a capped source leaves goes to the others by weight until none is above.
    The fixed point is found without iteration: sources are capped in order of words per weight, so one running sum over the
    sorted sources gives the level at which the rest is shared. A source without words has target 0 and rate 0.
    The result has one row per source; the window runs over these rows only.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    weighed = per_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int")))
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    capped_before = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(float(cap))
    level = (budget - capped_before) / F.sum("weight").over(rest)
    levels = weighed.withColumn("level", level).withColumn("is_capped", F.col("level") * F.col("weight") >= F.col("source_size") * F.lit(float(cap)))
    # The first source that is not capped fixes the level for itself and all after it.
    fixed = F.min(F.when(~F.col("is_capped"), F.struct((F.col("source_size") / F.col("weight")).alias("a"), F.col("source").isNull().alias("b"), F.col("source").alias("c"), "level"))).over(everything)
    chosen = levels.withColumn("fixed", fixed["level"])
    top = F.col("source_size") * F.lit(float(cap))
    full = F.col("fixed").isNull() | (F.col("fixed") * F.col("weight") >= top)
    target = F.when(full, top).otherwise(F.col("fixed") * F.col("weight"))
    return chosen.select(
        "source",
        "source_size",
        F.coalesce(target, F.lit(0.0)).alias("target"),
        F.when(F.col("source_size") > 0, F.when(full, F.lit(float(cap))).otherwise(target / F.col("source_size"))).otherwise(F.lit(0.0)).alias("rate"),
    )


def draw(id_column: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 32 bits of md5(seed:id)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """Every document with `__mix_size`, `__mix_source_size`, `__mix_target` and `__mix_copies`, the number of times the mix takes it.

    Null text has size 0; a null source is a source of its own, ordered last. Documents with equal ids draw alike. An empty
    table gives an empty result. Other columns pass through; names that begin with `__mix_` are reserved. Only the table of
    sources is joined; it is broadcast after its rows were counted, and joined by shuffle beyond BROADCAST_SOURCES.
    """
    sized = docs.withColumn("__mix_size", word_count(F.col(text_col)))
    plan = source_plan(sized.select(F.col(source_col).alias("source"), F.col("__mix_size").alias("size")), weights, share, cap)
    plan = cut(plan.select(F.col("source").alias("__mix_source"), F.col("source_size").alias("__mix_source_size"), F.col("target").alias("__mix_target"), F.col("rate").alias("__mix_rate")))
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    joined = sized.join(plan, sized[source_col].eqNullSafe(F.col("__mix_source")), "left")
    whole = F.floor(F.col("__mix_rate"))
    extra = (draw(F.col(id_col), seed) < F.col("__mix_rate") - whole).cast("long")
    return joined.withColumn("__mix_copies", whole + extra).drop("__mix_source", "__mix_rate")


def emit(docs: DataFrame, **kwargs) -> DataFrame:
    """The mix itself: each document as many times as `mix` takes it, with the columns of `docs`."""
    mixed = mix(docs, **kwargs).where("__mix_copies > 0")
    return mixed.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])
