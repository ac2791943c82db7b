import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from llm_data import documents, plain
from tokenizers import Tokenizer

from riskframe.llm.pack import configurations, pack, plan
from riskframe.llm.tokens import WordTokens, vocabulary_path


def tokenizer():
    return Tokenizer.from_file(vocabulary_path())


def test_ids_are_the_librarys(spark):
    own, library = WordTokens(vocabulary_path()), tokenizer()
    texts = [r["text"] or "" for r in documents(spark).collect()]
    texts += ["don't  can't 'S it's'll a'b", "É È́ é İstanbul ΣΑΣ ﬁ µ ª", "a b\x1cc\x85d", "<|startoftext|>x <|x|> 12.5%"]
    for text in texts:
        want = np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert own.encode(text) == want, text[:80]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcXYZéÈßñ'.,!#<|>́ \n\t09日 -")), max_size=40))
def test_ids_of_any_mixture(text):
    library = tokenizer_once()
    want = np.array(library[0].encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert library[1].encode(text) == want


_ONCE = []


def tokenizer_once():
    if not _ONCE:
        _ONCE.extend([tokenizer(), WordTokens(vocabulary_path())])
    return _ONCE


def laid_out(lengths, capacity):
    runs, sequences = plan(dict(Counter(lengths)), capacity)
    filled, packed = defaultdict(list), Counter()
    for r in runs:
        for i in range(r.count):
            filled[r.sequence + i // r.each].append((r.offset + i % r.each * r.length, r.length))
            packed[r.length, r.first + i] += 1
    assert all(n == 1 for n in packed.values())
    assert Counter(n for n, _ in packed) == Counter(lengths)
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    assert sorted(filled) == list(range(sequences))
    return sequences


@pytest.mark.parametrize("low,high,n", [(1, 4096, 4000), (1300, 2100, 3000), (1, 300, 5000), (4096, 4096, 7), (1, 1, 9000)])
def test_plan_is_sound_and_tight(low, high, n):
    rng = random.Random(low + high)
    lengths = [rng.randint(low, high) for _ in range(n)]
    rooms = []
    for length in sorted(lengths, reverse=True):  # first-fit decreasing, by hand
        for i, room in enumerate(rooms):
            if room >= length:
                rooms[i] -= length
                break
        else:
            rooms.append(4096 - length)
    assert laid_out(lengths, 4096) <= 1.01 * len(rooms)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_plan_of_any_lengths(lengths):
    assert laid_out(lengths, 64) >= -(-sum(lengths) // 64)


def test_configurations_reach_the_known_optimum():
    # Two of 5 and one of 6 fill 16; 10 and 5 of them need 5 sequences.
    used = configurations([6, 5], [5, 10], 16)
    assert sum(times for _, times in used) == pytest.approx(5.0)


def test_pieces_of_documents(spark):
    docs = documents(spark)
    rows = pack(docs).collect()
    library = tokenizer()
    want = Counter()
    for r in docs.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            own = np.array(ids[at : at + 4096], dtype="<u4")
            want[r["doc_id"], k, at, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    filled = defaultdict(list)
    for r in rows:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    assert pack(docs.limit(0)).count() == 0
    assert pack(plain(spark, [None])).first()["length"] == 1
