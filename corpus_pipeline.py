"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing, SentencePiece.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage
before it kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeframe.llm import line_spread, near_copies, sentence_pieces, source_mix, toxicity
from probeframe.llm._shared import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5.

    Null and empty texts score as the model's bias does and stay; repeated rows
    fare alike; other columns, a ``score`` of the table's own too, are kept.
    """
    model = toxicity.fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = "_toxicity"
    while name in docs.columns:
        name += "_"
    return toxicity.score(docs, model, name).filter(F.col(name) < 0.5).drop(name)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that spread over many sources, but for each line's first occurrence.

    Null texts stay null, repeated rows are treated alike, other columns are kept.
    """
    return line_spread.remove_spread_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: candidates by simhash fingerprints and by bands of minhashes, confirmed by a similarity of five-word shingles of 0.8 at least.

    Of equal candidates that with the smallest id, then hash of the text, stays;
    null and empty texts are one group; other columns are kept.
    """
    return near_copies.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: a row for each epoch that takes one, whole or in part.

    A null source is a source of its own; documents without words are never
    taken; repeated rows are taken each for themselves; other columns are kept.
    """
    return source_mix.mixed_texts(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with the text that they give back and whether both libraries agree; a null text is empty, every row stays."""
    return sentence_pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", near_dedup),
    ("source_mix", mix_sources),
    ("sentence_pieces", encode_pieces),
]

#: No SQL: the scores of a trained model, the fingerprints and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
