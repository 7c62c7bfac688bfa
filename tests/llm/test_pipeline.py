"""Each stage of the pipeline against a plain version of its decision on the stage's own input."""

from test_jaccard_join import brute as jaccard
from test_quality_rules import brute as quality
from test_suffix_dedup import brute as suffix

import corpus_pipeline


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = [docs.cache()]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], folder).cache())
        if name != "packing":
            assert seen[-1].columns == columns
    rows = [[r.asDict() for r in x.collect()] for x in seen]
    assert {r["doc_id"] for r in rows[1]} == {r["doc_id"] for r in rows[0] if quality(r["text"])[-1]}
    assert len(rows[2]) >= 0.98 * len(rows[1]) and {r["doc_id"] for r in rows[2]} <= {r["doc_id"] for r in rows[1]}
    assert {r["doc_id"] for r in rows[3]} == {c for _, _, c in jaccard([(r["doc_id"], r["text"]) for r in rows[2]])}
    want = suffix([r["text"] for r in rows[3]])
    after = {r["doc_id"]: r for r in rows[4]}
    for r, (size, removed, spans, _) in zip(rows[3], want):
        left = after[r["doc_id"]]
        assert size - removed <= len(left["text"].encode()) <= size - removed + 6 * spans and left["n_chars"] == len(left["text"])
    lengths = {}
    for r in rows[5]:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    assert lengths == {r["doc_id"]: len(r["text"].encode()) for r in rows[4]}
    for x in seen:
        x.unpersist()
