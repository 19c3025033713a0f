"""The corpus pipeline: stages applied one after the other to the documents, each to all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again. All but the
last return the columns of `documents`; the last returns the packed pieces of what is left.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from nitscope.llm import decontaminate, minhash, packing, pii, quality, simhash
from nitscope.runtime import materialize, table


def quality_rules(spark, docs, sf_dir):
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies stays: SimHash fingerprints over five-word shingles and, beyond their
    distance, MinHash bands propose pairs; a similarity of 0.8 or more of the whole sets links them."""
    return simhash.keep_one(docs, minhash.near_copies)


def decontamination(spark, docs, sf_dir):
    """Documents that hold a passage of a benchmark item go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark, docs, sf_dir):
    """Personal data in texts is replaced by its kind in brackets; n_chars is that of the new text."""
    masked = pii.mask(docs, pii.learn_patterns(docs))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else masked


def best_fit_packing(spark, docs, sf_dir):
    """Pieces of the documents' tokens with their places in sequences of at most 2048."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenization, fingerprints over connected components and packing are beyond SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over `documents`; what lies between two stages is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
