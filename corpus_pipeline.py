"""A corpus made ready for training: five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the
columns of ``documents``.  Nulls, empty texts, repeated rows, further columns and empty tables
are handled as the operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foliant.llm import exact_dedup, packing, simhash, suffix_dedup, toxicity
from foliant.llm.common import table
from foliant.storage import drop_since, mark, stored

#: Bytes of a repeated passage in the pipeline: longer than stock phrases, shorter than most stretches of
#: over 50 words (19 in 20 have 297 bytes or more where documents share them; very short words fall below).
PASSAGE, GRAM = 250, 80


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the document of smallest id stays."""
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity 0.8), the document of smallest id stays."""
    return simhash.drop_near_copies(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur more than once are cut out of the texts."""
    return suffix_dedup.cut_repeats(docs, window=PASSAGE, gram=GRAM)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens: a row for each piece."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("exact_dedup", exact),
    ("simhash_dedup", near),
    ("suffix_dedup", passages),
    ("packing", packed),
]

#: No SQL: language models, fingerprints and tokenizers are beyond it; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each stored and read again; what a stage stored on
    its way, and what it read, is removed once its result is stored."""
    docs, point = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        drop_since(spark, point, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
