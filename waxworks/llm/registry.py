"""Queries of this subpackage, each with its SQL where SQL can express it."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
MODULES = (
    "quality_rules", "sharding", "exact_topk", "byte_bpe", "language_id", "toxicity", "chat_format", "suffix_dedup", "jaccard_join", "packing",
    "chat_repair", "hard_negatives", "minhash_dedup",
)


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under a name."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def load():
    for name in MODULES:
        import_module(f"waxworks.llm.{name}")
    return dict(QUERIES), dict(ORACLE)
