"""Quality classifier: a factorisation machine on hashed words, structure statistics and metadata.

score = b + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2): all pairwise interactions in time linear in
the features. Trained by AdaGrad on a bounded sample of labelled rows (`sample_rows` expected rows).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import column_bytes, document_batches, slices

WORD_BUCKETS, RANK = 1 << 15, 8
#: Expected labelled rows that the weights are fitted on.
SAMPLE_ROWS = 6000
CACHE_WORDS = 300_000
STATISTICS = ("no_words", "log_words", "word_length", "upper", "digit", "symbol", "sentence_marks", "non_ascii", "log_lines", "repeated_lines", "distinct_words", "shouted_words", "marked_words", "bars", "metadata_known", "log_n_chars")
DIMS = WORD_BUCKETS + len(STATISTICS)

_KINDS = np.zeros(256, np.uint8)
_KINDS[65:91] = 1  # upper case
_KINDS[48:58] = 2  # digits
_KINDS[[ord(c) for c in "#$%&*+<=>@\\^_`{}~[]/|\"'()-:;"]] = 3  # symbols
_KINDS[[ord(c) for c in ".,!?"]] = 4  # sentence marks
_KINDS[128:] = 5
_KINDS[[9, 10, 11, 12, 13, 32]] = 6
_BLOCK = 1 << 22


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        bucket = zlib.crc32(word) % WORD_BUCKETS
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = bucket
        return bucket


_BUCKETS = _Buckets()


def features(text: bytes | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features of a whole text: hashed lower-case words (log counts, unit length), then STATISTICS, each between 0 and about 1."""
    text = text or b""
    words = text.split()
    n = len(words)
    kinds = np.zeros(256, np.int64)
    for at in range(0, len(text), _BLOCK):
        kinds += np.bincount(_KINDS[np.frombuffer(text, np.uint8, min(_BLOCK, len(text) - at), at)], minlength=256)
    size = max(1, len(text) - int(kinds[6]))
    lines = text.split(b"\n") if text else []
    buckets = np.fromiter(map(_BUCKETS.__getitem__, text.lower().split()), np.int64, n)
    found, counts = np.unique(buckets, return_counts=True)
    values = 1 + np.log(counts)
    values = values / max(1e-12, np.sqrt(values @ values)) if n else values
    shouted = sum(map(bytes.isupper, words))
    marked = sum([w[-1] in b"*#$%&!|" for w in words])
    statistics = np.array([
        float(n == 0),
        np.log1p(n) / 10,
        min(1.0, size / max(1, n) / 20),
        kinds[1] / size,
        kinds[2] / size,
        kinds[3] / size,
        kinds[4] / size,
        kinds[5] / size,
        np.log1p(len(lines)) / 8,
        1 - len(set(lines)) / max(1, len(lines)),
        len(found) / max(1, n),
        shouted / max(1, n),
        marked / max(1, n),
        words.count(b"|") / max(1, n),
        float(n_chars is not None),
        np.log1p(max(0, n_chars or 0)) / 12,
    ])
    there = np.flatnonzero(statistics)
    return np.r_[found, WORD_BUCKETS + there].astype(np.int32), np.r_[values, statistics[there]]


@dataclass
class Model:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, index: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[index] * x[:, None]
        s = vx.sum(0)
        return float(self.bias + self.w[index] @ x + 0.5 * (s @ s - (vx * vx).sum()))

    def score(self, text: bytes | None, n_chars: int | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(*features(text, n_chars)), -40, 40))))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 4, rate: float = 0.08, l2: float = 1e-4, seed: int = 1) -> Model:
    """AdaGrad on the logistic loss, rows in the order given. Without rows the model scores 0.5."""
    model = Model(0.0, np.zeros(DIMS), np.random.default_rng(seed).normal(0, 0.03, (DIMS, RANK)))
    if not rows:
        model.v[:] = 0
        return model
    gw, gv, gb = np.full(DIMS, 1e-6), np.full((DIMS, RANK), 1e-6), 1e-6
    for _ in range(epochs):
        for index, x, y in rows:
            v = model.v[index]
            s = (v * x[:, None]).sum(0)
            margin = model.bias + model.w[index] @ x + 0.5 * (s @ s - ((v * x[:, None]) ** 2).sum())
            error = 1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y
            dw = error * x + l2 * model.w[index]
            dv = error * (x[:, None] * s - v * (x * x)[:, None]) + l2 * v
            gw[index] += dw * dw
            gv[index] += dv * dv
            gb += error * error
            model.w[index] -= rate * dw / np.sqrt(gw[index])
            model.v[index] -= rate * dv / np.sqrt(gv[index])
            model.bias -= rate * error / np.sqrt(gb)
    return model


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from the rows of `labels` (id_col, label_col 0 or 1) and their documents; null and other labels are left out.

    A label row enters the sample if the hash of its id falls below a rate that gives each class half of sample_rows; only the
    sample, whose bound does not grow with the corpus, is broadcast and joined to the texts.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("__fm_id"), F.col(label_col).cast("int").alias("y")).where("__fm_id is not null").distinct()
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(counts) < 2:
        model = train([])
        model.bias = {(0,): -4.0, (1,): 4.0}.get(tuple(counts), 0.0)
        return model
    draw = F.pmod(F.xxhash64(F.lit("quality"), F.col("__fm_id").cast("string")), F.lit(1 << 30))
    rate = F.when(F.col("y") == 1, F.lit(sample_rows / 2 / counts[1])).otherwise(F.lit(sample_rows / 2 / counts[0]))
    sample = F.broadcast(known.withColumn("draw", draw).where(F.col("draw") < rate * F.lit(float(1 << 30))))
    chars = F.col(chars_col).cast("long") if chars_col and chars_col in docs.columns else F.lit(None).cast("long")
    rows = docs.select(F.col(id_col).alias("__fm_id"), F.col(text_col).cast("string").alias("t"), chars.alias("n")).join(sample, "__fm_id")
    # One text for each label row, whatever number of documents bear its id.
    rows = rows.groupBy("__fm_id", "y", "draw").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t", "n")).alias("d")).select("d.t", "d.n", "y", "draw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            found = [features(t, n) for t, n in zip(column_bytes(batch.column("t")), batch.column("n").to_pylist())]
            yield pa.record_batch([batch.column("y"), batch.column("draw"), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float64()))], names=["y", "draw", "i", "x"])

    got = rows.mapInArrow(run, "y int, draw long, i array<int>, x array<double>").orderBy("draw", "y", "i").toArrow()
    return train([(i.values.to_numpy(), x.values.to_numpy(), y) for i, x, y in zip(got["i"], got["x"], got["y"].to_pylist())])


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", chars_col: str | None = "n_chars", score_name: str = "score") -> DataFrame:
    """All columns of `docs` but the text, and the probability of label 1. Null texts count as empty; a null n_chars as unknown metadata; an own column score_name is replaced."""
    document_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in (text_col, score_name)]
    known = chars_col if chars_col in kept else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, text_col):
            chars = batch.column(known).to_pylist() if known else [None] * batch.num_rows
            scores = [own.score(t, n) for t, n in zip(column_bytes(batch.column(text_col)), chars)]
            yield pa.record_batch([batch.column(c) for c in kept] + [pa.array(scores, pa.float64())], names=[*kept, score_name])

    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept)
    return docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(run, f"{typed}, `{score_name}` double".removeprefix(", "))
