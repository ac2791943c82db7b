import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from llm_data import documents, sentence

from riskframe.llm.simhash import components, near_duplicates, near_links, one_of_each


def fingerprint(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, run = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [run] if run else []
            run = ""
        else:
            run += c
    if not words:
        return 0
    shingles = [words] if len(words) < k else [words[i : i + k] for i in range(len(words) - k + 1)]
    hashes = [xxhash.xxh64(" ".join(s).encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(codes, radius):
    """Smallest member reachable, by all pairs."""
    codes = np.array(sorted(codes), dtype=np.uint64)
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= radius
    label = np.arange(len(codes))
    while True:
        lower = np.where(near, label[None, :], len(codes)).min(axis=1)
        if (lower == label).all():
            return {int(c): int(codes[k]) for c, k in zip(codes, label)}
        label = lower


def test_equals_brute_force(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], fingerprint(r["text"])) for r in docs.collect()]
    label = classes({c for _, c in rows}, 2)
    first = {}
    for i, c in rows:
        if i is not None:
            first[label[c]] = min(i, first.get(label[c], i))
    want = Counter((i, f"{c:016x}", first.get(label[c])) for i, c in rows)
    assert Counter(map(tuple, near_duplicates(docs).collect())) == want
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(first.values())
    assert ids.count(None) == len({label[c] for _, c in rows} - set(first))


@pytest.mark.parametrize("radius,shard_size", [(2, 2048), (2, 12), (3, 16)])
def test_links_of_dense_codes(spark, radius, shard_size):
    """Clusters of codes a few bits apart, in shards that must be dealt again and again."""
    rng = random.Random(radius)
    codes = set()
    for _ in range(6):
        code = rng.getrandbits(64)
        for _ in range(20):
            codes.add(code)
            code ^= 1 << rng.randrange(64)
            code ^= 1 << rng.randrange(64)
    codes |= {rng.getrandbits(5) for _ in range(20)} | {0, (1 << 64) - 1}
    signed = {c - (1 << 64) if c >> 63 else c: c for c in codes}
    links = near_links(spark.createDataFrame([(c,) for c in signed], "code long"), radius, shard_size)
    assert all((signed[r["a"]] ^ signed[r["b"]]) >= 0 for r in links.collect())
    label = {r["code"]: r["label"] for r in components(links).collect()}
    found = {signed[c]: label.get(c, c) for c in signed}
    want = classes(list(codes), radius)
    groups = lambda m: sorted(sorted(c for c in codes if m[c] == v) for v in set(m.values()))
    assert groups(found) == groups(want)


def test_chain_becomes_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    label = {r["code"]: r["label"] for r in components(links).collect()}
    assert all(label[i] == 0 for i in range(61)) and label[101] == 100


def test_empty_table_and_copies(spark):
    assert near_duplicates(documents(spark).limit(0)).count() == 0
    rows = [(i, sentence(7, 50), *[None] * 13) for i in range(40)]
    assert [r["doc_id"] for r in one_of_each(documents(spark, rows)).collect()] == [0]
    same = [(4, sentence(7, 50), *[None] * 13)] * 3
    assert one_of_each(documents(spark, same)).count() == 1
