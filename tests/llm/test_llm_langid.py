import itertools
import math

import numpy as np
import pytest
from llm_data import documents, fold

from riskframe.llm import langid

LETTERS = {"en": "the and with from that this", "xx": "zqo qzz oqz zzo qoq ozq", "yy": "éàü üéà àéü éüé ààü üüé"}


def taught(spark, n=120):
    rows = []
    for i in range(n):
        lang = sorted(LETTERS)[i % 3]
        words = LETTERS[lang].split()
        text = " ".join(words[(i * 7 + k * (1 + i % 4)) % len(words)] for k in range(12))
        rows.append((i, text, lang, "src", 1, 0.5, "x", "y", 1, 2, 3, 4, 5, 6, "z"))
    return documents(spark, rows)


class Tiny(langid.Pieces):
    def __init__(self, pieces):
        self.number = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces))


def all_segmentations(word):
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, run = [], word[0]
        for cut, c in zip(cuts, word[1:]):
            if cut:
                parts.append(run)
                run = ""
            run += c
        yield [*parts, run]


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "▁a", "ab", "▁ab", "ba", "bab"]
    vocabulary = Tiny(pieces)
    rng = np.random.default_rng(0)
    table = langid._with_unknown(rng.random((len(pieces), 2)))
    for word in ("a", "ab", "abab", "babbab", "axb", "aaaaaaaa"):
        want = np.zeros(2)
        for parts in all_segmentations("▁" + word):
            chance = np.ones(2)
            for p in parts:
                known = vocabulary.number.get(p)
                if known is None:
                    chance *= langid.UNKNOWN if len(p) == 1 else 0.0
                else:
                    chance *= table[known]
            want += chance
        got = langid.forward(vocabulary.lattice([word, word]), table)
        assert got[1] == pytest.approx(np.log(want), rel=1e-9)


def test_expected_counts_by_all_segmentations():
    pieces = ["▁", "a", "b", "▁a", "ab", "▁ab", "bab"]
    vocabulary = Tiny(pieces)
    chances = langid._with_unknown(np.random.default_rng(1).random((len(pieces), 1)))[:, 0]
    want, total = np.zeros(len(pieces)), 0.0
    for parts in all_segmentations("▁babab"):
        if all(p in vocabulary.number for p in parts):
            chance = math.prod(chances[vocabulary.number[p]] for p in parts)
            total += chance
            for p in parts:
                want[vocabulary.number[p]] += chance
    got = langid.expected_pieces(vocabulary.lattice(["babab"]), chances, np.array([3.0]), len(pieces))
    assert got[: len(pieces)] == pytest.approx(3 * want / total)


def test_long_words_keep_their_precision():
    vocabulary = Tiny(["▁", "a", "b", "ab"])
    table = langid._with_unknown(np.full((4, 2), [1e-3, 1e-4]))
    logs = langid.forward(vocabulary.lattice(["ab" * 5000]), table)[0]
    assert np.isfinite(logs).all() and logs[0] > logs[1]


def test_learned_languages(spark):
    docs = taught(spark)
    rows = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    for r in docs.collect():
        got = rows[r["doc_id"]]
        assert got["held_out"] == fold(r["doc_id"], 0)
        assert got["lang_pred"] == r["lang"] and 0.5 < got["score"] <= 1


def test_awkward_rows(spark):
    docs = documents(spark)
    rows = langid.identify(docs).collect()
    assert len(rows) == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        if r["doc_id"] is not None:
            none = not any(c.isalpha() for c in texts[r["doc_id"]] or "")
            assert (r["lang_pred"] == "und") == none, r
            assert 0 <= r["score"] <= 1 and (not none or r["score"] == 0)
    assert langid.identify(docs.limit(0)).count() == 0
    unknown = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in langid.identify(unknown).collect()} == {"und"}


def test_prediction_ignores_own_labels(spark):
    docs = taught(spark)
    held = docs.selectExpr("doc_id", "text", "if(pmod(crc32(cast(doc_id as string)), 5) = 0, 'zz', lang) as lang")
    a, b = (sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(d).collect()) for d in (docs, held))
    assert a == b
