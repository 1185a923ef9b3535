"""The pipeline against plain Python over the same rows, stage by stage."""

import re

import corpus_pipeline
from ticklake.llm.common import keep
from ticklake.llm.decontaminate import normal
from ticklake.llm.quality import quality_scores

from . import edge
from .test_dedup import brute

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("labels", "benchmark"))
    stages = dict(corpus_pipeline.STAGES)
    assert [*stages] == ["quality_classifier", "exact_dedup", "near_dedup", "decontamination", "packing"]
    rows = {r.doc_id: r.text for r in docs.collect()}
    now = keep(stages["quality_classifier"](spark, docs, SMALL))
    score = {r.doc_id: r.score for r in quality_scores(docs, labels).collect()}
    rows = {i: t for i, t in rows.items() if score[i] >= corpus_pipeline.QUALITY}
    assert sorted(r.doc_id for r in now.collect()) == sorted(rows)
    # what labels call good stays
    assert {r.doc_id for r in labels.where("quality = 1").collect()} <= set(rows)

    now = keep(stages["exact_dedup"](spark, now, SMALL))
    first = {}
    for i in sorted(rows):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", rows[i]), i)
    rows = {i: rows[i] for i in first.values()}
    assert sorted(r.doc_id for r in now.collect()) == sorted(rows)

    now = keep(stages["near_dedup"](spark, now, SMALL))
    root = brute(sorted(rows.items()), 5, 80)
    rows = {i: t for i, t in rows.items() if root[i] == i}
    assert sorted(r.doc_id for r in now.collect()) == sorted(rows)

    now = keep(stages["decontamination"](spark, now, SMALL))
    assert now.columns == docs.columns
    items = [normal(r.text) for r in bench.collect()]
    rows = {i: t for i, t in rows.items() if not any(x in normal(t) for x in items)}  # planted passages are verbatim here
    assert sorted(r.doc_id for r in now.collect()) == sorted(rows)

    last = stages["packing"](spark, now, SMALL)
    assert {r.doc_id for r in last.collect()} == set(rows)
    assert corpus_pipeline.run(spark, SMALL).count() == last.count()


def test_stages_take_edge_rows(spark, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    for docs in (edge.docs(spark, extra=False), edge.empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            docs = keep(stage(spark, docs, str(tmp_path)))
        assert docs.count() >= 0
