"""A training-corpus pipeline: each stage works on all rows that the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import langid, line_dedup, mixing, sentencepiece_bpe, simhash
from waymark.llm.common import ensure_checkpoint_dir, remove_folder

#: Where the best language's probability must lie at least between 1/k, the least that it can be among k languages, and 1.
LEAST_OVER_GUESS = 1 / 3
#: Documents are linked if their fingerprints differ in so many of 64 bits at most, or their shingle sets have this Jaccard similarity.
RADIUS, SIMILARITY = 4, 0.8


def least_score(languages: int) -> float:
    """The least probability with which a document stays: 0.5 among four languages. One language alone always has 1, which judges nothing."""
    guess = 1 / max(1, languages)
    return guess + (1 - guess) * LEAST_OVER_GUESS


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model is sure of; it learns from the documents' own labels. Those without letters go."""
    model = langid.fit(docs)
    found = langid.predict(docs, model, lang_name="__lang_pred", score_name="__lang_score", keep_text=True)
    return found.where((F.col("__lang_pred") != langid.UNDETERMINED) & (F.col("__lang_score") >= least_score(len(model.languages)))).select(*docs.columns)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that stand earlier in the corpus; those left without words go. n_chars follows the text."""
    found = line_dedup.dedup_lines(docs)
    changed = F.col("__line_spans").isNotNull()
    left = found.where(~changed | F.col("text").rlike(line_dedup.WORD))
    return left.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by five-word shingles: their fingerprints, and the similarity of their sets."""
    return simhash.keep_one(docs, shingle=5, radius=RADIUS, similarity=SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources weigh 3, 1, 2 in turn, share 150 % of all words, none above twice its own."""
    return mixing.emit(docs, weights=(3, 1, 2), share=1.5, cap=2.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of each document that the mix took, repeats included."""
    import public_tokenizers

    tokens = sentencepiece_bpe.tokenize(docs, public_tokenizers.path("piece_bpe_32k.model"), with_text=False)
    return tokens.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", identify_language),
    ("lines", remove_repeated_lines),
    ("near_duplicates", remove_near_duplicates),
    ("mixing", mix_sources),
    ("tokens", encode),
]

#: Fingerprints, language scores and token ids are beyond SQL; the tests run a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents.

    What a stage keeps is written to the shared checkpoint folder and read again; it goes when the next stage has been written.
    The folder of the last one stays, as the result reads it when it is asked for.
    """
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        here = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(here)
        if last:
            remove_folder(spark, last)
        docs, last = spark.read.parquet(here), here
    return STAGES[-1][1](spark, docs, sf_dir)
