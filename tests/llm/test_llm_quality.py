import numpy as np
from llm_data import documents, fold, sentence

from riskframe.llm import quality


def labelled(spark, n=400):
    docs, labels = [], []
    for i in range(n):
        words = sentence(i, 30 + i % 50).split()
        low = i % 5 == 2
        if low:
            words = [w + "$$$" if k % 2 else w for k, w in enumerate(words)] if i % 2 else words[:3] * 20
        source = "junk" if low and i % 3 else f"s{i % 4}"
        docs.append((i, " ".join(words), "en", source, len(words), 0.5, "x", "y", 1, 2, 3, 4, 5, 6, "z"))
        if i % 2 == 0 or i % 7 == 0:
            labels.append((i, int(not low), 0, "extra"))
    return documents(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, score string")


def test_held_out_accuracy_and_filter(spark):
    docs, labels = labelled(spark)
    rows = quality.score_quality(docs, labels).collect()
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if fold(r["doc_id"], 0)]
    assert all(r["held_out"] for r in held)
    assert np.mean([r["predicted"] == (r["doc_id"] % 5 != 2) for r in held]) >= 0.95
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if r["predicted"]}


def test_views_teach_each_other():
    """Each view knows a half of the cases for sure; handed labels carry that to the other."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 4000)
    text = np.column_stack([y + rng.normal(0, 0.3, 4000), rng.normal(size=4000)])
    facts = np.column_stack([y + rng.normal(0, 0.4, 4000), rng.normal(size=(4000, 20)).T[0]])
    alone = quality.co_train(text[:40], facts[:40], y[:40], text[:0], facts[:0])
    both = quality.co_train(text[:40], facts[:40], y[:40], text[40:2000], facts[40:2000])
    right = [((m.logits(text[2000:], facts[2000:])[2] > 0) == y[2000:]).mean() for m in (alone, both)]
    assert right[1] >= right[0] - 0.01 and right[1] > 0.95


def test_word_forms():
    assert quality.word_form("abc")[1:] == (3, 0, 0, 0)
    assert quality.word_form("aBc12!!")[1:] == (3, 1, 2, 2)
    assert quality.word_form("foo$$$")[0] == quality.word_form("barbaz$")[0] != quality.word_form("foo")[0]
    assert quality.word_form("LOUD!")[0] == quality.word_form("NOISE!")[0] != quality.word_form("Loud!")[0]


def test_awkward_rows(spark):
    docs, labels = labelled(spark, 80)
    odd = documents(spark)
    rows = quality.score_quality(docs.unionByName(odd), labels).collect()
    assert len(rows) == 80 + odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in quality.score_quality(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(odd.limit(0), labels).count() == 0
    bare = docs.select("doc_id", "text")  # without metadata columns
    assert quality.score_quality(bare, labels).count() == 80
