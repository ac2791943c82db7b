"""Best-fit packing of tokenized documents by linear grouping.

Only the counts of piece lengths (one number per possible length) reach the
driver, so planning costs the same at any size of the table:

1. Large lengths are sorted and cut into groups of equal cardinality; each is
   rounded up to its group's largest.
2. A linear program over the few sizes left, solved by column generation,
   says how often to use which configuration of sizes.
3. Actual documents take the places of the rounded sizes, longest first.
4. What is left, large ones over from whole configurations first, then the small
   ones, goes best-fit into the room that sequences have.

The plan is a list of runs: so many pieces of one length go into consecutive
sequences at one offset. Each piece then finds its run by its length and its
number among the pieces of that length.

Defined cases: a missing or empty text is its end token alone; repeated rows are
packed each; missing ids stay missing; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskframe.llm.common import map_batches, quoted, slots, with_number
from riskframe.llm.tokens import WordTokens, vocabulary_path
from riskframe.session import materialize

CAPACITY = 4096
END_ID = 1
#: Ways to group, of which the one with the fewest sequences is taken: lengths
#: above this share of the capacity count as large, so many groups, and sizes of
#: the linear program in multiples of this many tokens.
GROUPINGS = ((1 / 3, 48, 8), (1 / 4, 48, 8), (1 / 2, 48, 8), (1 / 4, 96, 4))
#: A plan this close to the bound (all tokens over the capacity) needs no rival.
CLOSE = 1.0005
PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"


@dataclass
class Run:
    """``count`` pieces of one length, from number ``first`` on, ``each`` to a sequence."""

    length: int
    first: int
    count: int
    sequence: int
    each: int
    offset: int


def token_pieces(docs: DataFrame, keep: Sequence[str], text: str, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of at most ``capacity`` tokens, the end token included."""
    end = END_ID.to_bytes(4, "little")

    def make():
        tokens = WordTokens(path)

        def step(texts):
            index, number, start, length, crc = [], [], [], [], []
            for i, value in enumerate(texts.to_pylist()):
                ids = tokens.encode(value) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    index.append(i)
                    number.append(k)
                    start.append(at // 4)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip((number, start, length, crc), kinds)]
            return pa.array(index, pa.int64()), columns

        return step

    return map_batches(docs, keep, [F.coalesce(quoted(text), F.lit(""))], PIECES, make)


def _best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits: an unbounded knapsack."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    for room in range(int(sizes.min()), capacity + 1):
        fits = np.flatnonzero(sizes <= room)
        gain = best[room - sizes[fits]] + values[fits]
        top = int(gain.argmax())
        if gain[top] > best[room - 1] + 1e-12:
            best[room], last[room] = gain[top], fits[top]
        else:
            best[room], last[room] = best[room - 1], -1
    counts, room = np.zeros(len(sizes), dtype=np.int64), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            counts[last[room]] += 1
            room -= int(sizes[last[room]])
    return float(best[capacity]), counts


def configurations(sizes: Sequence[int], demands: Sequence[int], capacity: int) -> list[tuple[np.ndarray, float]]:
    """(counts per size, times used) of the linear program's optimum, by column generation."""
    sizes, need = np.asarray(sizes), np.asarray(demands, dtype=float)
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)  # one column per configuration
    used = need / basis.diagonal()
    for _ in range(40 * k):
        prices = np.linalg.solve(basis.T, np.ones(k))
        value, counts = _best_pattern(sizes, np.maximum(prices, 0), capacity)
        if value <= 1 + 1e-7:
            break
        change = np.linalg.solve(basis, counts.astype(float))
        ratios = np.full(k, np.inf)
        np.divide(used, change, out=ratios, where=change > 1e-9)
        out = int(ratios.argmin())
        step = ratios[out]
        if not np.isfinite(step):
            break
        used = np.maximum(used - step * change, 0)
        used[out] = step
        basis[:, out] = counts
    return [(basis[:, j].astype(np.int64), float(used[j])) for j in range(k)]


class _Room:
    """Stretches of consecutive sequences by the room they have left."""

    def __init__(self) -> None:
        self.at: dict[int, list[tuple[int, int]]] = {}
        self.rooms: list[int] = []

    def add(self, room: int, first: int, count: int) -> None:
        if room <= 0 or count <= 0:
            return
        if room not in self.at:
            self.at[room] = []
            bisect.insort(self.rooms, room)
        self.at[room].append((first, count))

    def least(self, length: int) -> tuple[int, int, int] | None:
        """Take a stretch of the least room that is enough."""
        i = bisect.bisect_left(self.rooms, length)
        if i == len(self.rooms):
            return None
        room = self.rooms[i]
        first, count = self.at[room].pop()
        if not self.at[room]:
            del self.at[room]
            self.rooms.pop(i)
        return room, first, count


def plan(counts: dict[int, int], capacity: int = CAPACITY, groupings=GROUPINGS) -> tuple[list[Run], int]:
    """Runs for all pieces, given the number of pieces of each length; number of sequences."""
    bound = -(-sum(n * c for n, c in counts.items()) // capacity)
    best = None
    for grouping in groupings:
        found = _grouped_plan(counts, capacity, *grouping)
        if best is None or found[1] < best[1]:
            best = found
        if best[1] <= bound * CLOSE:
            break
    return best


def _grouped_plan(
    counts: dict[int, int], capacity: int, large_share: float, groups: int, grain: int
) -> tuple[list[Run], int]:
    runs: list[Run] = []
    room = _Room()
    sequences = 0
    # Lengths from the longest, each with the place of its first piece in that order.
    large = [n for n in sorted(counts, reverse=True) if n > capacity * large_share]
    starts, total = [], 0
    for n in large:
        starts.append(total)
        total += counts[n]
    per_group = max(1, math.ceil(total / groups))
    bounds = [(a, min(a + per_group, total)) for a in range(0, total, per_group)]

    def pieces(a: int, b: int) -> list[tuple[int, int, int]]:
        """(length, first number, count) of the pieces at places a to b."""
        out, i = [], bisect.bisect_right(starts, a) - 1
        while a < b:
            stop = min(b, starts[i] + counts[large[i]])
            out.append((large[i], a - starts[i], stop - a))
            a, i = stop, i + 1
        return out

    # Equal rounded sizes are one size.
    sized: dict[int, list[int]] = {}
    for a, b in bounds:
        top = large[bisect.bisect_right(starts, a) - 1]
        span = sized.setdefault(min(capacity, -(-top // grain) * grain), [a, b])
        span[1] = b
    sizes = list(sized)
    spans = list(sized.values())
    taken = [a for a, _ in spans]
    if sizes:
        for use, times in configurations([s // grain for s in sizes], [b - a for a, b in spans], capacity // grain):
            times = min([int(times + 1e-6), *((spans[g][1] - taken[g]) // c for g, c in enumerate(use) if c)])
            if times <= 0:
                continue
            blocks = []
            for g in np.flatnonzero(use):
                for _ in range(use[g]):
                    blocks.append(pieces(taken[g], taken[g] + times))
                    taken[g] += times
            # Sequences of the same actual lengths are one stretch.
            edges = {0, times}
            for block in blocks:
                place = 0
                for _, _, count in block:
                    place += count
                    edges.add(place)
            edges = sorted(edges)
            cursors = [[0, 0] for _ in blocks]  # part of the block, pieces of it already placed
            for a, b in zip(edges, edges[1:]):
                offset = 0
                for block, cursor in zip(blocks, cursors):
                    length, first, count = block[cursor[0]]
                    runs.append(Run(length, first + cursor[1], b - a, sequences + a, 1, offset))
                    offset += length
                    cursor[1] += b - a
                    if cursor[1] == count:
                        cursor[:] = [cursor[0] + 1, 0]
                room.add(capacity - offset, sequences + a, b - a)
            sequences += times
    rest = [piece for g, (_, b) in enumerate(spans) for piece in pieces(taken[g], b)]
    rest += [(n, 0, counts[n]) for n in sorted(counts, reverse=True) if n <= capacity * large_share]
    for length, first, count in sorted(rest, key=lambda r: -r[0]):
        while count:
            stretch = room.least(length)
            if stretch is None:
                new = -(-count // (capacity // length))
                stretch = (capacity, sequences, new)
                sequences += new
            free, start, wide = stretch
            each = free // length
            full = min(wide, count // each)
            if full:
                runs.append(Run(length, first, full * each, start, each, capacity - free))
                room.add(free - each * length, start, full)
                first, count = first + full * each, count - full * each
            elif count:  # the last pieces go into one sequence
                runs.append(Run(length, first, count, start, count, capacity - free))
                room.add(free - count * length, start, 1)
                first, count, full = first + count, 0, 1
            room.add(free, start + full, wide - full)
    return runs, sequences


def _placed(rows: DataFrame, keep: Sequence[str], runs: Sequence[Run]) -> DataFrame:
    """Sequence and offset of each piece, from its length and number."""
    runs = sorted(runs, key=lambda r: (r.length, r.first))
    # Lengths are below 2 ** 20, numbers below 2 ** 43.
    starts = np.array([(r.length << 43) + r.first for r in runs], dtype=np.int64)
    table = np.array([(r.first, r.sequence, r.each, r.offset) for r in runs], dtype=np.int64).reshape(-1, 4)

    def make():
        def step(length, number):
            length, number = (c.to_numpy(zero_copy_only=False) for c in (length, number))
            own = table[np.searchsorted(starts, (length << 43) + number, side="right") - 1]
            nth = number - own[:, 0]
            sequence = own[:, 1] + nth // own[:, 2]
            return None, [pa.array(sequence), pa.array(own[:, 3] + nth % own[:, 2] * length)]

        return step

    return map_batches(rows, keep, [F.col("length"), F.col("_nth")], "sequence_id bigint, offset bigint", make)


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    capacity: int = CAPACITY,
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    named = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    pieces = token_pieces(named, ["doc_id"], "text", path or vocabulary_path(), capacity)
    pieces = materialize(with_number(pieces, "_number"), "pieces")
    # One row per length that occurs, at most ``capacity``.
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = plan(counts, capacity)
    parts = max(16, math.ceil(max(counts.values(), default=0) / 20_000))
    numbered = slots(pieces, "length", "_number", "_nth", parts=parts)
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return _placed(numbered, keep, runs)
