"""The pipeline's stages, one after the other, each against what it must keep."""

from __future__ import annotations

import corpus_pipeline as P
from eventflow.llm import minhash, toxicity
from eventflow.llm.common import stored

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    kept = {}
    for name, stage in P.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF_DIR), name)
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    assert all(labels.get(i) != 0 or i in kept["toxicity"] for i in texts)
    assert set(kept["line_dedup"]) == set(kept["toxicity"])
    sets = {i: minhash.shingles(t) for i, t in kept["line_dedup"].items()}
    gone = set(kept["line_dedup"]) - set(kept["near_dedup"])
    linked = lambda a, b: bool(sets[a] and sets[b]) and minhash.similar(sets[a], sets[b], 80)
    assert all(any(linked(i, j) for j in sets if j != i) for i in gone)
    assert not any(linked(i, j) for i in kept["near_dedup"] for j in kept["near_dedup"] if i < j)
    assert all(kept["decontamination"][i] == t for i, t in kept["near_dedup"].items() if i in kept["decontamination"])
    packed = P.STAGES[-1][1](spark, docs, SF_DIR).collect()
    assert {r.doc_id for r in packed} == set(kept["decontamination"])
    assert sorted(map(tuple, P.run(spark, SF_DIR).drop("sequence_id").collect())) == sorted(tuple(r)[:5] + (r.offset,) for r in packed)


def test_toxic_stage_drops_what_the_query_predicts(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    bad = {r.doc_id for r in toxicity.toxicity(docs, labels).collect() if r.predicted}
    left = {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()}
    assert not bad & left and len(bad) + len(left) == docs.count()
