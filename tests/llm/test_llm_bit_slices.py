import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_data import documents, plain, sentence

from riskframe.llm import bit_slices
from riskframe.llm.decontaminate import search_words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [re.sub("[A-Z]+", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, best):
    """(item, rank, id, score) with every document scored."""
    rows = [(i, Counter(terms_of(t)), len(terms_of(t))) for i, t in docs]
    n_docs, tokens = sum(n > 0 for *_, n in rows), sum(n for *_, n in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i].update(terms_of(t))
    out = []
    for item, terms in asked.items():
        found = []
        for i, counts, n in rows:
            score = 0
            for t in terms & set(counts):
                m = 100 - 50 + 50 * n * n_docs // tokens
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += weight * (1_000_000_000 * counts[t] // (1000 * counts[t] + 20 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(found)[:best], 1):
            out.append((item, rank, i, -score))
    return sorted(out, key=str)


def report(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def item_table(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, score double")


@pytest.mark.parametrize("best, block_terms", [(5, 200_000), (3, 4)])
def test_equals_brute_force(spark, best, block_terms):
    texts = [sentence(i, 5 + i * 7 % 90) + (" rare" * (i % 9) if i % 4 == 0 else "") for i in range(150)]
    items = [(0, sentence(3, 6)), (1, "RARE alpha"), (2, "rare"), (3, "unknown words"), (4, ""), (5, None), (None, "beta rare")]
    items += [(6, "gamma"), (6, "delta gamma")]
    out = bit_slices.search(plain(spark, texts), item_table(spark, [(*i, 0.5) for i in items]), best, block_terms=block_terms)
    assert report(out) == brute(list(enumerate(texts)), items, best)


def test_awkward_rows(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(1, "two words one"), (2, sentence(1, 40)), (3, "straße 123 it's 日本語テキスト")]
    table = item_table(spark, [(*i, 1.0) for i in items])
    assert report(bit_slices.search(docs, table, 4)) == brute(rows, items, 4)
    empty = bit_slices.search(docs.limit(0), table)
    assert empty.columns == ["item_id", "rank", "doc_id", "score"] and empty.count() == 0
    assert bit_slices.search(docs, table.limit(0)).count() == 0


def test_bounds_are_never_too_low_and_exclude_most():
    texts = [sentence(i, 20 + i * 13 % 200).encode() + b" often" * (i % 40) for i in range(200)]
    items = bit_slices.Items([sorted(set(search_words(sentence(i, 8).encode()))) for i in range(20)] + [[b"often"]])
    words = [search_words(t) for t in texts]
    df = Counter(items.vocabulary[w] for own in words for w in set(own) if w in items.vocabulary)
    items.weigh(len(words), sum(map(len, words)), df)
    known: dict[bytes, int] = {}
    own, counts = [], []
    for w in words:
        found = Counter(w)
        own.append(np.array([known.setdefault(t, len(known)) for t in found]))
        counts.append(np.array(list(found.values())))
    hashes = np.array([bit_slices.xxh64_intdigest(t) for t in known], dtype=np.uint64)
    asked = np.array([bit_slices.xxh64_intdigest(t) for t in items.vocabulary], dtype=np.uint64)
    width = 8192
    row = {"positions": width, "lengths": [len(w) for w in words], "slices": bit_slices._sliced(hashes, counts, own, width)}
    bounds = np.concatenate([b for _, b in bit_slices._bounds(items, asked, row)], axis=1)
    exact = np.zeros_like(bounds)
    for d, w in enumerate(words):
        shares = np.zeros(len(items.vocabulary), dtype=np.int64)
        m = int(items.lengths(np.array([len(w)]))[0])
        for t, tf in Counter(w).items():
            if t in items.vocabulary:
                shares[items.vocabulary[t]] = items.weights[items.vocabulary[t]] * bit_slices._share(tf, m)
        exact[:, d] = items.sums(shares)
    assert (bounds >= exact).all() and bounds.sum() < 1.3 * exact.sum()
