"""The corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, encoding.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  Rows keep all
their columns up to the last stage, which returns the encoded texts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from mapsieve.llm import bitmap_join, ordinal_quality, sentencepiece_sa, suffix_dedup, template_decontam
from mapsieve.llm.common import stored


def quality(spark, docs, sf_dir):
    """Documents whose top grade is more likely than not stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return ordinal_quality.select(docs, ordinal_quality.fit(*ordinal_quality.sampled(docs, labels)))


def near_duplicates(spark, docs, sf_dir):
    """One document of each group stays: that with the smallest doc_id."""
    return bitmap_join.one_of_each(docs)


def repeated_passages(spark, docs, sf_dir):
    """Bytes covered by 200-byte strings that occur elsewhere go; so do documents that lose all their text."""
    out = suffix_dedup.cut(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def benchmark_leaks(spark, docs, sf_dir):
    """Documents that hold an item of the benchmark go."""
    return template_decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark, docs, sf_dir):
    """doc_id, n_pieces, ids_crc32, round_trip and the piece ids of every document."""
    return sentencepiece_sa.encode(docs, with_pieces=True)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("SentencePiece encoding", encode),
]
#: No stage can be put in SQL; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
