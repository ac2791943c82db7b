import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from llm_data import documents, plain, sentence

from riskframe.llm import suffix_levels


def brute(rows, length):
    """(id, bytes, removed bytes, runs, digest of what stays) by looking at every string."""
    data = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    out = []
    for i, b in data:
        covered = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if counts[b[k : k + length]] > 1:
                covered[k : k + length] = b"\1" * length
        runs = sum(c and not p for c, p in zip(covered, b"\0" + bytes(covered)))
        kept = bytes(x for x, c in zip(b, covered) if not c)
        out.append((i, len(b), sum(covered), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def report(df):
    assert df.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def planted(seed):
    """Texts with shared passages of many lengths, edits inside copies, and repeats in one text."""
    draw = random.Random(seed)
    fresh = lambda n: "".join(draw.choice("abcdefgh é\n") for _ in range(n))
    passages = [fresh(n) for n in (60, 99, 100, 101, 130, 260, 700)]
    texts = []
    for i in range(60):
        parts = [fresh(draw.randrange(0, 300))]
        for _ in range(draw.randrange(0, 4)):
            p = draw.choice(passages)
            if draw.random() < 0.4:
                at = draw.randrange(len(p))
                p = p[:at] + "#" + p[at + 1 :]
            parts += [p[draw.randrange(3) :], fresh(draw.randrange(0, 80))]
        texts.append("".join(parts))
    return [*texts, texts[3], texts[3], "a" * 450, "ab" * 300, passages[-1] * 2, ""]


@pytest.mark.parametrize("batches", [3])
def test_equals_brute_force(spark, batches):
    rows = list(enumerate(planted(batches)))
    out = suffix_levels.remove_repeats(plain(spark, [t for _, t in rows]), length=100, window=64, batches=batches)
    assert report(out) == brute(rows, 100)


def test_awkward_rows(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = suffix_levels.remove_repeats(docs, batches=2)
    assert report(out) == brute(rows, 400)
    assert suffix_levels.remove_repeats(docs.limit(0), batches=1).count() == 0


def test_every_string_has_one_anchor_and_copies_the_same():
    length, window = 100, 64
    text = (sentence(1, 120) + "z" * 300).encode()
    texts = [text, b"another head " * 9 + text, sentence(2, 90).encode()]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    doc, anchor, first, last = suffix_levels.anchors(data, offsets, length, window)
    owner = {}
    for d, a, s, e in zip(doc.tolist(), anchor.tolist(), first.tolist(), last.tolist()):
        assert offsets[d] <= s <= e <= offsets[d + 1] - length and s <= a + window and e <= a
        for k in range(s, e + 1):
            assert k not in owner
            owner[k] = a - k
    assert len(owner) == sum(len(t) - length + 1 for t in texts)
    shift = offsets[1] + 13 * 9
    assert all(owner[k] == owner[k + shift] for k in range(len(text) - length + 1))


def test_places_dealt_in_parts(monkeypatch):
    data = np.frombuffer(sentence(7, 2_000).encode(), dtype=np.uint8)
    offsets = np.array([0, 700, len(data)])
    whole = suffix_levels.anchors(data, offsets, 100, 64)
    monkeypatch.setattr(suffix_levels, "PLACES", 257)
    parts = suffix_levels.anchors(data, offsets, 100, 64)
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_family_merges_equal_sizes(spark):
    family = suffix_levels.Family()
    for i in range(7):
        rows = [(0, i, 5, 3, 9, 1, 2), (0, i, 50, 30, 90, 10 + i, i)]
        family.add(spark.createDataFrame(rows, "part int, number long, " + suffix_levels.ENTRY))
        sizes = [2**k for k, level in enumerate(family.levels) if level is not None]
        assert sum(sizes) == i + 1
    assert sum(a.count() for a in family.arrays()) == 3 + 7
    assert [tuple(r) for r in family.contexts().collect()] == [(1, 7)]
    family.drop()


def test_scans_and_merges_move_no_rows(spark):
    tables = [suffix_levels.Bucketed(spark.range(50).selectExpr("id * 3 AS context", "id AS n"), "array", "context") for _ in "ab"]
    a, b = (t.rows for t in tables)
    for df in (suffix_levels.merged([a, b]), suffix_levels.long_matches(a, [b])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan
    for t in tables:
        t.drop()
