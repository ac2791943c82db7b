import numpy as np
import pytest
from llm_data import documents, fold, sentence

from riskframe.llm import toxicity

BAD = "vile rotten foul wretch".split()


def labelled(spark, n=400):
    docs, labels = [], []
    for i in range(n):
        words = sentence(i, 30 + i % 50).split()
        toxic = i % 4 == 0
        if toxic:
            for k in range(2):
                words.insert((i * 5 + k * 11) % len(words), BAD[(i // 4 + k) % len(BAD)])
        docs.append((i, " ".join(words), "en" if i % 3 else "fr", "s", 1, 0.5, "x", "y", 1, 2, 3, 4, 5, 6, "z"))
        labels.append((i, 1, int(toxic), "extra"))
    return documents(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, score string")


def test_held_out_accuracy_and_filter(spark):
    docs, labels = labelled(spark)
    rows = toxicity.score_toxicity(docs, labels).collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(400) if fold(i, 0)}
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in held]) >= 0.95
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if not r["predicted"]}


def test_scores_use_neither_held_out_labels_nor_columns(spark):
    docs, labels = labelled(spark)
    other = labels.selectExpr("doc_id", "if(pmod(crc32(cast(doc_id as string)), 5) = 0, 1 - toxic, toxic) as toxic")
    a = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, other).collect()}
    assert a == b


def test_pooling_over_blocks_equals_whole(monkeypatch):
    rows = np.random.default_rng(0).normal(size=(100, toxicity._PARTS + 2)).astype(np.float32)
    whole = toxicity.pooled_text(lambda a, b: rows[a:b], len(rows))
    monkeypatch.setattr(toxicity, "BLOCK_WORDS", 7)
    parts = toxicity.pooled_text(lambda a, b: rows[a:b], len(rows))
    assert (parts[0] == whole[0]).all()
    assert parts[1] == pytest.approx(whole[1], rel=1e-5)


def test_threshold_by_hand():
    logits = np.array([3.0, 2.0, 1.0, 0.0, -1.0])
    assert toxicity.best_threshold(logits, np.array([1, 1, 0, 0, 0])) == 1.5
    assert toxicity.best_threshold(np.array([1.0, 1.0, 0.0]), np.array([1, 1, 0])) == 0.5


def test_awkward_rows(spark):
    docs, labels = labelled(spark, 60)
    odd = documents(spark)
    both = docs.unionByName(odd)
    labels = labels.unionByName(
        spark.createDataFrame([(0, 1, 1, "a"), (1, 1, None, "a"), (None, 1, 1, "a"), (5, 1, 0, "a")], labels.schema)
    )
    rows = toxicity.score_toxicity(both, labels).collect()
    assert len(rows) == both.count() and all(0 <= r["score"] <= 1 for r in rows)
    blank = {r["score"] for r in toxicity.score_toxicity(odd, labels).where("doc_id in (5, 6, 7)").collect()}
    assert len(blank) == 1
    none = labels.limit(0)
    assert {(r["score"], r["predicted"]) for r in toxicity.score_toxicity(odd, none).collect()} == {(0.0, 0)}
    assert toxicity.score_toxicity(odd.limit(0), labels).count() == 0
