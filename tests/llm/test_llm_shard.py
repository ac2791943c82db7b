import zlib
from collections import Counter, defaultdict

from llm_data import documents, plain, sentence

from riskframe.llm.shard import longest_first, shard_by_size, shard_report


def test_longest_first_by_hand():
    sizes = [(7, "a"), (5, "b"), (4, "c"), (4, "d"), (3, "e")]
    assert longest_first(sizes, 2) == [0, 1, 1, 0, 1]
    assert longest_first([], 2) == []


def test_rows_sizes_and_slots(spark):
    docs = documents(spark)
    rows = shard_report(docs, 4).collect()
    want = Counter()
    for r in docs.collect():
        data = (r["text"] or "").encode()
        want[r["doc_id"], len(data) + 1, zlib.crc32(data)] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots, shards = defaultdict(list), defaultdict(set)
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
        shards[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shards.values())  # equal texts stay together


def test_balance_with_bundles_and_a_large_group(spark):
    texts = [sentence(i, 5 + i % 40) for i in range(800)] + ["copied text " * 20] * 30
    for grain in (40_000, 50):
        loads = Counter()
        for r in shard_by_size(plain(spark, texts), 8, grain=grain, bundles=256).collect():
            loads[r["shard"]] += r["size"]
        assert len(loads) == 8
        assert max(loads.values()) - min(loads.values()) < 0.03 * sum(loads.values()) / 8


def test_empty_table(spark):
    assert shard_report(documents(spark).limit(0)).count() == 0
