"""The pipeline stage by stage, against what each stage must do to its own input."""

from __future__ import annotations

import corpus_pipeline
from salescope.llm.common import table, word_list, written
from salescope.llm.decontaminate import contamination
from salescope.llm.order_minhash import near_duplicates

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    by_stage = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), "stage")
        assert docs.columns == table(spark, SF, "documents").columns
        by_stage[name] = {r["doc_id"]: r for r in docs.collect()}
    lines, near, clean = (by_stage[n] for n in ("line dedup", "near dedup", "decontamination"))
    assert lines.keys() == by_stage["toxicity"].keys()
    classes = near_duplicates(spark.createDataFrame(list(lines.values()))).collect()
    assert sorted(near) == sorted({r["class_id"] for r in classes})
    assert not contamination(docs, table(spark, SF, "benchmark")).filter("contaminated").collect()
    hits = contamination(spark.createDataFrame(list(near.values())), table(spark, SF, "benchmark")).collect()
    for r in hits:
        if not r["contaminated"]:
            assert clean[r["doc_id"]] == near[r["doc_id"]]
    assert all(r["n_chars"] == len(r["text"]) for r in clean.values())
    pieces = corpus_pipeline.packing(spark, docs, SF).collect()
    assert {r["doc_id"] for r in pieces} == set(clean)
    assert all(r["start"] + r["length"] <= r["doc_tokens"] for r in pieces)
    assert any(word_list(r["text"]) for r in clean.values())
