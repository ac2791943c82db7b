import hashlib
import re

import pytest
from llm_data import documents, plain, sentence

from riskframe.llm.decontaminate import occurrence_report, without_benchmark


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, item_text in items:
            b = words(item_text)
            m = min(window, len(b))
            patterns = {tuple(b[i : i + m]) for i in range(len(b) - m + 1)} if b else set()
            for i in range(len(w) - m + 1 if m else 0):
                if tuple(w[i : i + m]) in patterns:
                    hit.update(range(i, i + m))
                    found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    return out


ITEMS = [
    (1, sentence(2, 60)),
    (2, sentence(2, 60)),  # the same windows under another id
    (10, sentence(50, 30)),
    (11, "Two, WORDS!"),
    (12, "one"),
    (13, ""),
    (14, None),
    (15, "straße élève"),
    (1, sentence(2, 60)),  # a repeated row
]


@pytest.mark.parametrize("shard_windows", [400_000, 7])
def test_equals_brute_force(spark, shard_windows):
    docs = documents(spark)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = occurrence_report(docs, bench, shard_windows=shard_windows).collect()
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], ITEMS)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_overlapping_and_adjacent_hits(spark):
    item = sentence(60, 14)
    texts = [item, f"x {item} {item} y", " ".join(item.split()[:9]), " ".join(item.split()[3:13])]
    items = [(1, item)]
    got = occurrence_report(plain(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute(list(enumerate(texts)), items))


def test_empty_tables_and_filter(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = documents(spark)
    assert occurrence_report(docs, none).where("contaminated").count() == 0
    assert occurrence_report(docs.limit(0), none).count() == 0
    bench = spark.createDataFrame(ITEMS[:2], "item_id long, text string")
    kept = without_benchmark(docs, bench)
    assert kept.schema.names == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - {2, 3}


def test_item_without_id_marks_but_names_nothing(spark):
    bench = spark.createDataFrame([(None, "gamma ray")], "item_id long, text string")
    row = occurrence_report(plain(spark, ["a gamma ray b"]), bench).first()
    assert (row["n_hit"], row["n_items"], row["contaminated"]) == (2, 0, True)
