"""Every stage against a plain statement of it, on the input that it got."""

import numpy as np
from brute import decontamination, line_dedup, near_duplicates, sha

import corpus_pipeline as p
from tripmesh.llm import op05_toxicity, op10_pack
from tripmesh.llm.common import read_table


def test_stages_and_run(spark, small, tmp_path):
    docs = read_table(spark, small, "documents")
    columns, pairs, stages = docs.columns, {}, {}
    for name, stage in p.STAGES:
        pairs[name] = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        stages[name] = docs
        assert name == p.STAGES[-1][0] or docs.columns == columns
    ids = {name: sorted(r.doc_id for r in s.select("doc_id").distinct().collect()) for name, s in stages.items()}

    toxic = {r.doc_id: r.toxic for r in read_table(spark, small, "labels").collect()}
    gone = {i for i, _ in pairs["toxicity"]} - set(ids["toxicity"])
    assert gone and np.mean([toxic.get(i, 1) for i in gone]) > 0.8
    model = op05_toxicity.fit(read_table(spark, small, "documents"), op05_toxicity.training_labels(spark, small))
    assert len(op05_toxicity.keep_clean(read_table(spark, small, "documents"), model).collect()) == len(ids["toxicity"])

    want = {i: h for i, _, _, _, h in line_dedup(pairs["line dedup"])}
    assert {r.doc_id: sha(r.text or "") for r in stages["line dedup"].collect()} == want

    want = sorted(i for i, _, _, kept in near_duplicates(pairs["near dedup"], size=5) if kept)
    assert ids["near dedup"] == want and len(want) < len(pairs["near dedup"])

    items = [(r.item_id, r.text) for r in read_table(spark, small, "benchmark").collect()]
    want = sorted(x[0] for x in decontamination(pairs["benchmark decontamination"], items) if not x[5])
    assert ids["benchmark decontamination"] == want and len(want) < len(pairs["benchmark decontamination"])

    placed = stages["best-fit packing"]
    assert ids["best-fit packing"] == want
    words = op10_pack.WordIds(op10_pack.default_tokenizer())
    total = sum(len(words.encode([t or ""])[0]) // 4 + 1 for _, t in pairs["best-fit packing"])
    rows = placed.collect()
    assert sum(r.length for r in rows) == total
    assert len({r.sequence_id for r in rows}) <= -(-total // op10_pack.LENGTH) * 1.02 + 1

    whole = sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in p.run(spark, small).collect())
    assert whole == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows)
