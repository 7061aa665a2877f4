"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained by follow-the-regularised-leader with elastic-net penalties, then calibrated by one temperature. Document frequencies
come from all training documents; the weights from a bounded sample of them (`per_language` expected rows a language).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import cut, document_batches, slices

BITS, ORDERS = 15, (1, 2, 3)
BUCKETS = 1 << BITS
#: Expected sample rows a language, and of all languages together: with more than 200 of them each has fewer.
PER_LANGUAGE, SAMPLE_ROWS = 1000, 200_000
UNDETERMINED = "und"
#: Characters counted at a time; grams that span two blocks are kept.
BLOCK = 1 << 20

_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the n-grams of a whole text: lower case, each run of other characters than letters one space. Empty without letters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.int32), np.empty(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    kept = np.where(letter, points, 32)[keep].astype(np.uint32)
    kept = np.r_[np.uint32(32), kept] if kept[0] != 32 else kept
    total = np.zeros(BUCKETS, np.int64) if len(kept) > BLOCK else None
    for at in range(0, len(kept), BLOCK):
        block = kept[at : at + BLOCK + max(ORDERS) - 1]
        grams = []
        for order in ORDERS:
            n = min(BLOCK, len(block) - order + 1)
            if n <= 0:
                continue
            h = np.full(n, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for k in range(order):
                h = (h ^ block[k : k + n]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
            grams.append(h * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS))
        flat = np.concatenate(grams)
        if total is None:
            counts = np.bincount(flat, minlength=BUCKETS) if len(flat) > 4000 else None
            if counts is None:
                found, n = np.unique(flat, return_counts=True)
                return found.astype(np.int32), n
            found = np.flatnonzero(counts)
            return found.astype(np.int32), counts[found]
        total += np.bincount(flat, minlength=BUCKETS)
    found = np.flatnonzero(total)
    return found.astype(np.int32), total[found]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def vector(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[buckets]
        return x / max(np.sqrt(x @ x), 1e-12)

    def score(self, text: str | None) -> tuple[str, float]:
        buckets, counts = gram_counts(text)
        if not len(buckets) or not self.languages:
            return UNDETERMINED, 0.0
        p = softmax((self.vector(buckets, counts) @ self.weights[buckets] + self.weights[BUCKETS]) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(min(1.0, max(0.0, p[best])))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, dims: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01, epochs: int = 3) -> np.ndarray:
    """Weights (dims + 1, classes) of a softmax over sparse rows (indices, values, class); the last row is the bias, free of l1."""
    z, n = np.zeros((dims + 1, classes)), np.zeros((dims + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        penalty = np.where(at == dims, 0.0, l1)[:, None]
        return np.where(np.abs(zs) <= penalty, 0.0, -(zs - np.sign(zs) * penalty) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for indices, values, target in rows:
            at, x = np.append(indices, dims), np.append(values, 1.0)
            w = weights(at)
            error = softmax(x @ w)
            error[target] -= 1
            g = x[:, None] * error
            before = n[at]
            after = before + g * g
            z[at] += g - (np.sqrt(after) - np.sqrt(before)) / alpha * w
            n[at] = after
    return np.concatenate([weights(np.arange(i, min(i + 4096, dims + 1))) for i in range(0, dims + 1, 4096)])


def fit_temperature(logits: np.ndarray, targets: np.ndarray) -> float:
    """The temperature with the least cross-entropy, by golden section over its logarithm.

    The right class counts (n + 1) / (n + 2) and the others share the rest, so that a sample without errors does not make every
    score 1.
    """
    n, k = logits.shape if logits.ndim == 2 else (0, 0)
    if n == 0 or k < 2:
        return 1.0
    wanted = np.full((n, k), 1 / ((n + 2) * (k - 1)))
    wanted[np.arange(n), targets] = (n + 1) / (n + 2)
    loss = lambda t: -(wanted * np.log(np.maximum(softmax(logits / np.exp(t)), 1e-300))).sum(1).mean()
    a, b, g = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model from all rows of `docs` with a language. Texts without letters teach nothing.

    Document frequencies count every such row. The sample takes a row if the hash of its id and text falls below per_language over
    the language's rows, so its size follows the number of languages, not of rows, and stays about SAMPLE_ROWS. Every language is
    learned, however rare. One in five sample rows calibrates.
    """
    document_batches(docs.sparkSession)
    labelled = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("t"))
    rates = labelled.groupBy("lang").count().collect()  # one row a language
    languages = sorted(r["lang"] for r in rates)
    per_language = min(per_language, max(1, SAMPLE_ROWS // max(1, len(languages))))
    rate = {r["lang"]: min(1.0, per_language / r["count"]) for r in rates}
    code = {lang: k for k, lang in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency, n = np.zeros(BUCKETS, np.int64), 0
        schema = pa.schema([("lang", pa.int32()), ("draw", pa.int64()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
        for batch in batches:
            for part in slices(iter([batch]), "t"):
                out = []
                for text, lang, draw, chosen in zip(*(part.column(c).to_pylist() for c in ("t", "lang", "draw", "chosen"))):
                    buckets, counts = gram_counts(text)
                    frequency[buckets] += 1
                    n += len(buckets) > 0
                    if chosen and len(buckets):
                        out.append((code[lang], draw, buckets, counts))
                if out:
                    yield pa.record_batch([pa.array(c) for c in zip(*out)], schema=schema)
        found = np.flatnonzero(frequency)
        yield pa.record_batch([pa.array([-1], pa.int32()), pa.array([n]), pa.array([found.astype(np.int32)]), pa.array([frequency[found]])], schema=schema)

    if not languages:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS + 1, 0)), 1.0)
    draw = F.pmod(F.xxhash64(F.lit("langid"), F.coalesce("i", F.lit("")), F.coalesce("t", F.lit(""))), F.lit(1 << 30))
    chance = F.coalesce(F.element_at(F.create_map(*[x for lang, r in rate.items() for x in (F.lit(lang), F.lit(r))]), F.col("lang")), F.lit(0.0))
    marked = labelled.select("t", "lang", draw.alias("draw")).withColumn("chosen", F.col("draw") < chance * F.lit(float(1 << 30)))
    parts = cut(marked.mapInArrow(run, "lang int, draw long, buckets array<int>, counts array<long>"))
    frequency, total = np.zeros(BUCKETS), 0
    per_task = parts.where("lang = -1")
    total = per_task.agg(F.sum("draw")).first()[0] or 0
    for row in per_task.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy("x.buckets").agg(F.sum("x.counts").alias("n")).collect():
        frequency[row[0]] = row[1]
    idf = np.log((1 + total) / (1 + frequency)) + 1
    # Copies of a row draw alike and count once, so one id cannot fill the sample. Sorted by hash: the order of training does not depend on the tasks.
    sample = parts.where("lang >= 0").dropDuplicates(["lang", "draw"]).orderBy("draw", "lang").toArrow()
    model = Model(languages, idf, np.zeros((BUCKETS + 1, len(languages))), 1.0)
    rows = []
    for lang, buckets, counts in zip(sample["lang"].to_pylist(), sample["buckets"], sample["counts"]):
        b = buckets.values.to_numpy()
        rows.append((b, model.vector(b, counts.values.to_numpy()), lang))
    held = [r for k, r in enumerate(rows) if k % 5 == 4]
    model.weights = ftrl([r for k, r in enumerate(rows) if k % 5 != 4], len(languages), BUCKETS)
    if held:
        model.temperature = fit_temperature(np.array([v @ model.weights[b] + model.weights[BUCKETS] for b, v, _ in held]), np.array([k for _, _, k in held]))
    return model


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score", keep_text: bool = False) -> DataFrame:
    """All columns of `docs` (but the text, unless keep_text), and the language and its calibrated probability.

    Null, empty and letterless texts have language `und` and score 0, and so has every text if the model knows no language. Own
    columns with the names of the two results are replaced.
    """
    document_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if (keep_text or c != text_col) and c not in (lang_name, score_name)]
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, text_col):
            scored = [own.score(t) for t in batch.column(text_col).to_pylist()]
            yield pa.record_batch([batch.column(c) for c in kept] + [pa.array([s[0] for s in scored], pa.string()), pa.array([s[1] for s in scored], pa.float64())], names=[*kept, lang_name, score_name])

    return docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(run, f"{typed}, `{lang_name}` string, `{score_name}` double".removeprefix(", "))


def id_remainder(id_col: Column, divisor: int) -> Column:
    """crc32 of the id in decimal digits, modulo divisor; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(divisor))
