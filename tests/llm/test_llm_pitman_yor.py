import math
from collections import Counter

import numpy as np
import pytest
from llm_data import documents, fold

from riskframe.llm import pitman_yor as py


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, run = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [run] if run else []
            run = ""
        else:
            run += c
    return [*words, None]


def test_counts_and_base_score(spark):
    docs = documents(spark)
    rows = docs.collect()
    counts = Counter(w for r in rows if not fold(r["doc_id"], 1) for w in tokens(r["text"]))
    n, v = sum(counts.values()), len(counts)
    want = []
    for r in rows:
        t = tokens(r["text"])
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        want.append((str(r["doc_id"]), fold(r["doc_id"], 1), len(t), sum(counts[w] > 0 for w in t), n, round(base, 6)))
    got = py.score_documents(docs).collect()
    names = ("held_out", "n_tokens", "n_known", "train_tokens")
    assert sorted((str(r["doc_id"]), *[r[c] for c in names], round(r["base_score"], 6)) for r in got) == sorted(want)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    for r in got:
        assert r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"]))


def test_empty_tables(spark):
    docs = documents(spark)
    assert py.score_documents(docs.limit(0)).count() == 0
    only_held = docs.where("doc_id is not null and pmod(crc32(cast(doc_id as string)), 5) = 1")
    rows = py.score_documents(only_held).collect()
    assert rows and all(r["score"] == 0 and r["train_tokens"] == 0 for r in rows)


def test_probabilities_of_a_context_sum_to_one(spark):
    """Over all training words and one unknown word, in every context and after every sweep."""
    rng = np.random.default_rng(3)
    pairs = {w: {u: int(rng.integers(0, 6)) for u in range(4)} for w in range(1, 9)} | {9: dict.fromkeys(range(4), 0)}
    pairs[1][2] = 700  # more customers than the exact table holds
    counts = spark.createDataFrame([(w, sum(c.values())) for w, c in pairs.items()], "w long, n long")
    own = [(w, [(u, c[u]) for u in range(1, 4)]) for w, c in pairs.items()]
    listed = spark.createDataFrame(own, "w long, pairs array<struct<u:int,c:bigint>>")
    state = py.materialize(py.first_state(counts, listed), "state")
    words = sum(1 for c in pairs.values() if sum(c.values()))
    for number in range(3):
        totals = py.Totals(state, 2)
        assert totals.customers[:4].tolist() == [sum(c[u] for c in pairs.values()) for u in range(4)]
        chances = np.zeros(4)
        for r in py.sweep(state, totals, 1 / (words + 1), totals.discount(), number, True, True).collect():
            chances += np.frombuffer(r["sums"], "<f8")
        assert chances == pytest.approx(np.ones(4))
        state = py.materialize(py.sweep(state, totals, 1 / (words + 1), totals.discount(), number, False, False), "state")
        for r in state.collect():
            c, t = np.frombuffer(r["cs"], "<i8"), np.frombuffer(r["ts"], "<i8")
            assert ((t <= c) & ((t > 0) == (c > 0))).all()
            assert (0 < r["top"] <= t.sum()) or (r["top"] == t.sum() == 0)


def test_count_beyond_sixteen_bits(spark):
    docs = spark.createDataFrame([(0, "a " * 70_000), (1, "a b")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in py.score_documents(docs).collect()}
    assert rows[0]["n_tokens"] == rows[0]["n_known"] == 70_001


def test_tables_follow_their_exact_distribution():
    """Small restaurants by enumeration of all seatings, one customer after another."""
    d, strength, others, chance, n = 0.6, 1.0, 3, 0.2, 5
    weights = Counter()

    def seat(sizes, left, weight):
        if not left:
            weights[len(sizes)] += weight
            return
        for k, size in enumerate(sizes):
            seat([*sizes[:k], size + 1, *sizes[k + 1 :]], left - 1, weight * (size - d))
        opened = (strength + d * (others + len(sizes))) * chance
        seat([*sizes, 1], left - 1, weight * opened)

    seat([], n, 1.0)
    want = np.array([weights[t] for t in range(1, n + 1)]) / sum(weights.values())
    for exact in (True, False):
        seating = py.Seating(d, strength, np.random.default_rng(0))
        many = 40_000
        args = np.full(many, others), np.full(many, chance)
        got = seating._exact(n, *args) if exact else seating._strides(np.full(many, n), *args)
        found = np.bincount(got, minlength=n + 1)[1:] / many
        assert found == pytest.approx(want, abs=0.01 if exact else 0.06)


@pytest.mark.parametrize("d, others, chance", [(0.7, 200, 1e-3), (0.5, 50, 1e-2), (0.7, 50, 0.3), (0.8, 0, 0.9)])
def test_tables_of_many_customers_follow_the_exact_distribution(d, others, chance):
    logs = py.stirling_logs(d, 1500)
    for n in (200, 600, 1500):
        t = np.arange(1, n + 1)
        weights = logs[n, 1 : n + 1] + np.cumsum(np.log(1.0 + d * (others + t - 1)) + math.log(chance))
        want = np.exp(weights - weights.max())
        want /= want.sum()
        many, mean = 20_000, (want * t).sum()
        deviation = math.sqrt((want * (t - mean) ** 2).sum())
        seating = py.Seating(d, 1.0, np.random.default_rng(n))
        got = seating.tables(np.full(many, n), np.full(many, others), np.full(many, chance))
        assert got.mean() == pytest.approx(mean, rel=0.02, abs=4 * deviation / math.sqrt(many))
        assert got.std() == pytest.approx(deviation, rel=0.05, abs=0.02)


@pytest.mark.parametrize("d", [0.1, 0.3, 0.5, 0.7, 0.8])
def test_sibuya_sums_equal_the_stirling_numbers(d):
    n, t = 700, np.arange(1, 701)
    factorials = np.array([math.lgamma(n + 1) - math.lgamma(k + 1) for k in t])
    want = py.stirling_logs(d, n)[n, 1:] - factorials + t * math.log(d)
    got = py.sibuya_logs(d, np.array([[float(n)]]), t[None, :].astype(float))[0]
    assert got == pytest.approx(want, abs=0.01)


def test_tables_of_a_billion_customers():
    seating = py.Seating(0.6, 1.0, np.random.default_rng(0))
    customers = np.array([10**9, 10**9, 10**9, 193])
    got = seating.tables(customers, np.array([0, 10**8, 10**8, 5]), np.array([1e-9, 1e-8, 0.5, 1.0]))
    assert ((got >= 1) & (got <= customers)).all() and got[0] == 1 and got[2] > 10**6


def test_stirling_numbers():
    # With discount 0 they are the unsigned Stirling numbers of the first kind.
    logs = py.stirling_logs(0.0, 5)
    assert np.exp(logs[5, 1:]) == pytest.approx([24, 50, 35, 10, 1])


def test_model_beats_the_base_on_held_out_text(spark):
    sf = "/root/testdata/sf0.001"
    rows = py.score_documents(spark.read.parquet(f"{sf}/documents.parquet")).where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def ids_of(held, many):
    return [k for k in range(10_000) if fold(k, 1) == held][:many]


def test_rare_words_have_contexts_of_their_own(spark):
    """Words below 1/4,096 of the tokens, each followed by a word of its own."""
    train, held = ids_of(False, 9), ids_of(True, 4)
    rows = [(train[0], "f " * 40_000)]
    rows += [(k, f"{u} {x}") for k, (u, x) in zip(train[1:], [("ua", "xa"), ("ub", "xb")] * 4)]
    asked = ["ua xa", "ua xb", "ub xa", "ub xb"]
    docs = spark.createDataFrame(rows + list(zip(held, asked)), "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in py.score_documents(docs).collect()}
    same, other, crossed, own = (score[k] for k in held)
    assert same > other + 0.5 and own > crossed + 0.5


def test_pairs_seen_once_are_scored_exactly(spark, monkeypatch):
    """Without a repeated word nothing is drawn, whatever the parts and blocks."""
    monkeypatch.setattr(py, "PART_TOKENS", 5)
    (train,), held = ids_of(False, 1), ids_of(True, 4)
    texts = {train: "a b c d e f g h", held[0]: "a b c", held[1]: "b d new a a", held[2]: None, held[3]: "h new b c"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    known = tokens(texts[train])
    n, d = len(known), 0.95
    pairs = set(zip([None, *known], known))
    base = 1 / (n + 1)

    def chance(u, w):
        rest = (1 + d * n) / (1 + n)
        parent = (1 - d if w in known else 0) / (1 + n) + rest * base
        own, open_ = (((u, w) in pairs) * (1 - d) / 2, (1 + d) / 2) if u in known else (0, 1)
        return own + open_ * parent

    got = {r["doc_id"]: r for r in py.score_documents(docs).collect()}
    assert len(got) == len(texts)
    for k, text in texts.items():
        words = tokens(text)
        assert got[k]["score"] == pytest.approx(sum(math.log10(chance(u, w)) for u, w in zip([None, *words], words)))
        assert got[k]["n_known"] == sum(w in known for w in words) and got[k]["train_tokens"] == n


def test_packed_arrays_come_back():
    arrays = [np.array([3, -1, 2**60]), np.zeros(0, "<u4"), np.array([0.5, -2.0]), np.arange(5, dtype="<u4")]
    for a, b in zip(arrays, py.unpack(py.pack(*arrays)), strict=True):
        assert a.dtype == b.dtype and a.tolist() == b.tolist()
