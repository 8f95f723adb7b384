"""The pipeline's stages, each judged on its own input against plain versions."""

import zlib
from collections import Counter

import numpy as np

import corpus_pipeline as P
from strikelake.llm import queries as Q
from strikelake.session import cut_lineage

from .test_operators import plain_classes, plain_contamination, plain_fingerprint, plain_ids

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before, rows = docs.columns, docs, {}
    for name, stage in P.STAGES:
        after = cut_lineage(stage(spark, before, SF))
        rows[name] = (before.collect(), after.collect())
        if name != P.STAGES[-1][0]:
            assert after.columns == columns
        before = after

    came, kept = rows["toxicity"]
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    gone = {r.doc_id for r in came} - {r.doc_id for r in kept}
    labelled = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(gone & labelled - toxic) <= 3

    came, kept = rows["near_dedup"]
    groups = plain_classes([plain_fingerprint(r.text) for r in came], 2)
    least = {}
    for r, g in zip(came, groups):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in kept) == sorted(least.values())

    came, kept = rows["decontamination"]
    items = [(r.item_id, r.text) for r in Q.table(spark, SF, "benchmark").collect()]
    found = plain_contamination([(r.doc_id, r.text) for r in came], items)
    assert sorted(r.doc_id for r in kept) == sorted(k[0] for k in found if not k[-1])

    came, kept = rows["mixing"]
    texts = {r.doc_id: r.text for r in came}
    assert all(texts[r.doc_id] == r.text for r in kept)
    assert max(Counter(r.doc_id for r in kept).values()) <= 3

    came, coded = rows["token_codes"]
    want = Counter((r.doc_id, len(plain_ids(r.text)) + 1) for r in came)
    assert Counter((r.doc_id, r.n_tokens) for r in coded) == want
    crcs = {r.doc_id: zlib.crc32(np.array(plain_ids(r.text) + [0], "<u4").tobytes()) for r in came}
    assert all(crcs[r.doc_id] == r.ids_crc32 for r in coded)
    ordered = sorted(coded, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted(r.doc_id for r in came)


def test_run_gives_the_stages_rows(spark):
    once = P.run(spark, SF).collect()
    assert Counter(tuple(r) for r in once) == Counter(tuple(r) for r in P.run(spark, SF).collect())
    assert once
