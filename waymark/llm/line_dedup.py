"""Line deduplication by winnowing over line hashes, in DataFrame functions only.

A document is its lines that have words, each a hash and a number of words. For each line there is a gram: the shortest run of
lines from it on with `noise_words` words; and a window: the shortest run from it on with `min_words` words. Each window selects
the gram in it with the least hash, so two copies of a run of min_words words or more select the same grams inside it: these
are the guaranteed fingerprints. Only fingerprints that occur twice go on. Around each, matches are extended both ways to the
windows that hold it, forwards (shortest from a line on) and backwards (shortest up to a line). A window whose content stands
earlier in the corpus is deleted. Every line of a repeated run of min_words words or more lies in such a window, so:

A line with words is deleted if and only if it belongs to a run of consecutive lines (lines without words left out) that has min_words words
or more and also occurs earlier, in the order of id (null last), text hash and line. Occurrences may overlap.
Lines without words go where the next lines with words on both sides are deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS, NOISE_WORDS = 40, 20


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once: inside, it is a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _reach(words: Column, start: Column, need: int, back: bool = False) -> Column:
    """The line (from 0) where the shortest run from `start` on, or back from it, has `need` words; -1 if there is none. Each line has a word at least, so `need` lines suffice."""
    if back:
        first = F.greatest(F.lit(0), start - need + 1)
        ahead = F.reverse(F.slice(words, first + 1, start - first + 1))
    else:
        ahead = F.slice(words, start + 1, F.lit(need))
    step = lambda s, w: F.when(s["sum"] >= need, s).otherwise(F.struct((s["sum"] + w).alias("sum"), (s["n"] + 1).alias("n")))
    end = F.aggregate(ahead, F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n")), step)
    return _let(end, lambda s: F.when(s["sum"] >= need, start - s["n"] + 1 if back else start + s["n"] - 1).otherwise(F.lit(-1)))


def signatures(docs: DataFrame, id_col: str, text_col: str, min_words: int, noise_words: int) -> DataFrame:
    """One row for each document with a window: id, th (text hash), p (line numbers), h (line hashes), fwd and bwd (ends and starts of windows), grams (j, e, hash) selected."""
    line = F.transform(F.split(F.col(text_col), "\n", -1), lambda l, i: F.struct(i.alias("p"), F.xxhash64(F.btrim(l, F.lit(" \t\r"))).alias("h"), F.regexp_count(l, F.lit(WORD)).cast("long").alias("w")))
    parsed = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.filter(line, lambda x: x["w"] > 0).alias("l"))
    # Rows with equal id and text are one document. Later steps read the arrays by position, so they are written once.
    parsed = cut(parsed.where(F.aggregate("l", F.lit(0).cast("long"), lambda s, x: s + x["w"]) >= min_words).select("id", "th", F.col("l.p").alias("p"), F.col("l.h").alias("h"), F.col("l.w").alias("w")).dropDuplicates(["id", "th"]))
    places = F.sequence(F.lit(0), F.size("w") - 1)
    gram = lambda i: _let(_reach(F.col("w"), i, noise_words), lambda e: F.struct(i.alias("j"), e.alias("e"), F.when(e >= 0, F.xxhash64(F.slice("h", i + 1, e - i + 1))).alias("hash")))
    shape = parsed.select(
        "id", "th", "p", "h",
        F.struct(
            F.transform(places, lambda i: _reach(F.col("w"), i, min_words)).alias("fwd"),
            F.transform(places, lambda i: _reach(F.col("w"), i, min_words, back=True)).alias("bwd"),
            F.transform(places, gram).alias("grams"),
        ).alias("s"),
    )

    def select(s: Column) -> Column:
        def least(end: Column, i: Column) -> Column:
            inside = F.filter(F.slice(s["grams"], i + 1, end - i + 1), lambda g: (g["e"] >= 0) & (g["e"] <= end))
            return F.array_min(F.transform(inside, lambda g: F.struct(g["hash"].alias("hash"), g["j"].alias("j"), g["e"].alias("e"))))

        return F.array_distinct(F.filter(F.transform(s["fwd"], lambda end, i: F.when(end >= 0, least(end, i))), lambda g: g.isNotNull()))

    return shape.select("id", "th", "p", "h", "s.fwd", "s.bwd", _let(F.col("s"), select).alias("grams"))


def _order(*columns: str) -> list[Column]:
    return [F.col("id").isNull().alias("no_id"), *[F.col(c) for c in columns]]


def _later(rows: DataFrame, key: str, place: list[str]) -> DataFrame:
    """Rows whose key stands earlier too. First places are combined before the shuffle; a key that many rows share is split by AQE in the join."""
    firsts = cut(rows.groupBy(key).agg(F.count("*").alias("n"), F.min(F.struct(*_order(*place))).alias("earliest")).where("n > 1"))
    return rows.join(firsts, key).where(F.struct(*_order(*place)) != F.col("earliest"))


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, noise_words: int = NOISE_WORDS) -> DataFrame:
    """(id, th, spans): for each document that loses lines, disjoint spans (first, last) of line numbers from 0."""
    if not 0 < noise_words <= min_words:
        raise ValueError("0 < noise_words <= min_words is needed")
    marks = cut(signatures(docs, id_col, text_col, min_words, noise_words))
    grams = marks.select("id", "th", F.explode("grams").alias("g")).select("id", "th", "g.hash", "g.j", "g.e")
    known = cut(grams.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"))
    matched = grams.join(known, "hash").groupBy("id", "th").agg(F.collect_list(F.struct("j", "e")).alias("matched"))
    around = marks.drop("grams").join(matched.withColumnsRenamed({"id": "m_id", "th": "m_th"}), F.col("id").eqNullSafe(F.col("m_id")) & (F.col("th") == F.col("m_th"))).drop("m_id", "m_th")

    def windows(g: Column) -> Column:
        first = F.greatest(F.lit(0), g["e"] - min_words + 1)
        last = F.least(F.size("p") - 1, g["j"] + min_words - 1)
        ahead = F.transform(F.sequence(F.least(first, g["j"]), g["j"]), lambda x: F.struct(x.alias("s"), F.get("fwd", x).alias("t")))
        back = F.transform(F.sequence(g["e"], F.greatest(last, g["e"])), lambda y: F.struct(F.get("bwd", y).alias("s"), y.alias("t")))
        return F.filter(F.concat(ahead, back), lambda r: (r["s"] >= 0) & (r["s"] <= g["j"]) & (r["t"] >= g["e"]))

    runs = around.select("id", "th", "p", "h", F.explode(F.array_distinct(F.flatten(F.transform("matched", windows)))).alias("r"))
    runs = runs.select("id", "th", F.col("r.s").alias("s"), F.col("r.t").alias("t"), F.get("p", F.col("r.s")).alias("first"), F.get("p", F.col("r.t")).alias("last"), F.xxhash64(F.slice("h", F.col("r.s") + 1, F.col("r.t") - F.col("r.s") + 1)).alias("key"))
    later = _later(cut(runs), "key", ["id", "th", "s"])
    spans = later.groupBy("id", "th", "s").agg(F.max("t").alias("t"), F.min("first").alias("first"), F.max("last").alias("last"))
    by_line = Window.partitionBy("id", "th").orderBy("s")
    before = F.max("t").over(by_line.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.when(before.isNull() | (F.col("s") > before + 1), 1).otherwise(0))
    islands = islands.withColumn("island", F.sum("new").over(by_line)).groupBy("id", "th", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return islands.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, noise_words: int = NOISE_WORDS) -> DataFrame:
    """`docs` with the repeated lines taken out of text_col, and `__line_spans`, the line numbers taken (null where none).

    Null texts stay null, texts without repeated lines stay as they are, a text of which all lines go becomes empty. Rows with
    equal id and text lose the same lines. Names that begin with `__line_` are reserved.
    """
    spans = repeated_lines(docs, id_col=id_col, text_col=text_col, min_words=min_words, noise_words=noise_words)
    spans = cut(spans.select(F.col("id").alias("__line_id"), F.col("th").alias("__line_th"), F.col("spans").alias("__line_spans")))
    # Spans are few beside the texts: they are the side that is hashed, so texts are not sorted.
    joined = docs.withColumn("__line_hash", F.xxhash64(text_col)).join(spans.hint("shuffle_hash"), docs[id_col].eqNullSafe(F.col("__line_id")) & (F.col("__line_hash") == F.col("__line_th")), "left")
    kept = F.filter(F.split(F.col(text_col), "\n", -1), lambda l, i: ~F.exists(F.col("__line_spans"), lambda s: (s["first"] <= i) & (i <= s["last"])))
    return joined.withColumn(text_col, F.when(F.col("__line_spans").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))).drop("__line_id", "__line_th", "__line_hash")
