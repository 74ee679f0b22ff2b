"""Each stage of the pipeline against brute force on its own input, and the whole of it."""

import collections
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as pipeline
from tallyglass.llm import mixing
from tallyglass.llm.common import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The input of each stage, then the result of the last."""
    docs = pipeline.documents(spark, SF)
    odd = [(100_000, "12 34 !!", "en", "src0", 8), (100_001, None, None, None, None), (100_002, "Только другая письменность здесь", "en", "src1", 32)]
    copy = docs.limit(5).withColumn("doc_id", F.col("doc_id") + 200_000)
    docs = materialize(docs.unionByName(copy).unionByName(spark.createDataFrame(odd, docs.schema)), "input")
    found = [docs]
    for name, stage in pipeline.STAGES:
        found.append(materialize(stage(spark, found[-1], SF), name))
    return found


def test_shapes(stages):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]
    assert all(df.dtypes == stages[0].dtypes for df in stages[1:-1])


def test_language_keeps_clean_documents(stages):
    gone = {r.doc_id for r in stages[0].exceptAll(stages[1]).collect()}
    assert {100_000, 100_001} <= gone <= {100_000, 100_001, 100_002}


def test_exact_copies_go(stages):
    groups = collections.defaultdict(list)
    for r in stages[1].collect():
        groups["".join(r.text.split(" ")).translate({c: None for c in range(9, 14)})].append(r)
    want = sorted(max(g, key=lambda r: (len(r.text), -r.doc_id)).doc_id for g in groups.values())
    assert sorted(r.doc_id for r in stages[2].collect()) == want


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_copies_go_and_others_stay(stages):
    rows = sorted(stages[2].collect(), key=lambda r: r.doc_id)
    kept = {r.doc_id for r in stages[3].collect()}
    sets = [shingles(r.text) for r in rows]
    near = np.array([[len(a & b) / max(1, len(a | b)) for b in sets] for a in sets])
    for i, r in enumerate(rows):
        others = np.delete(near[i], i)
        if others.max(initial=0) < 0.5:
            assert r.doc_id in kept  # alone
        for j in range(i):
            assert near[i, j] < 0.8 or not {r.doc_id, rows[j].doc_id} <= kept


def test_near_copies_are_those_of_the_stated_similarity(stages):
    rows = sorted(stages[2].collect(), key=lambda r: r.doc_id)
    sets = [shingles(r.text) for r in rows]
    near = np.array([[5 * len(a & b) >= 4 * len(a | b) for b in sets] for a in sets])
    label = np.arange(len(rows))
    while (lower := np.where(near, label[None, :], len(rows)).min(axis=1)).tolist() != label.tolist():
        label = lower
    assert {r.doc_id for r in stages[3].collect()} == {rows[i].doc_id for i in set(label.tolist())}


def test_mix_is_the_operators(stages):
    want = collections.Counter(r.doc_id for r in mixing.mix_sources(stages[3], pipeline.MIX).collect())
    assert collections.Counter(r.doc_id for r in stages[4].collect()) == want


def test_packing_holds_every_document_as_often(stages):
    want = collections.Counter(r.doc_id for r in stages[4].collect())
    rows = stages[5].collect()
    assert collections.Counter(r.doc_id for r in rows if r.piece == 0) == want
    for placed in collections.defaultdict(list, {k: [r for r in rows if r.sequence_id == k] for k in {r.sequence_id for r in rows}}).values():
        at = 0
        for r in sorted(placed, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096


def test_run_equals_its_stages(spark):
    docs = pipeline.documents(spark, SF)
    for _, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "again")
    key = lambda df: collections.Counter((r.doc_id, r.piece, r.ids_crc32) for r in df.collect())
    assert key(pipeline.run(spark, SF)) == key(docs)
