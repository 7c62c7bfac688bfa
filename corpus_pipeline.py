"""From documents to training batches: five stages, each on all that the stage before it kept."""

from __future__ import annotations

from waxworks.llm.jaccard_join import keep_one
from waxworks.llm.language_id import keep_known
from waxworks.llm.packing import pack
from waxworks.llm.quality_rules import keep_good
from waxworks.llm.suffix_dedup import cut_repeats
from waxworks.session import stable


def quality(spark, docs, sf_dir):
    """Documents that the base rules and the limits of repetition keep."""
    return keep_good(docs)


def language(spark, docs, sf_dir):
    """Documents in a language that is known, by a model fitted on those at hand."""
    return keep_known(docs)


def near_copies(spark, docs, sf_dir):
    """Of each group of near copies the document with the least id."""
    return keep_one(docs)


def repeats(spark, docs, sf_dir):
    """Documents without the strings of 200 bytes and more that stand anywhere else too."""
    return cut_repeats(docs)


def packing(spark, docs, sf_dir):
    """Sequences of the texts' bytes in buckets and batches."""
    return pack(docs)


STAGES = [
    ("quality rules", quality),
    ("language id", language),
    ("near copies", near_copies),
    ("repeated strings", repeats),
    ("packing", packing),
]

#: Most stages can't be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows. What each other stage keeps is written once, to the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
