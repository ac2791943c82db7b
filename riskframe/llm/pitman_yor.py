"""Language-model scores by a hierarchical Pitman-Yor model of word pairs.

A context restaurant belongs to every preceding word and one to the start of a
text; all share one parent, the restaurant of single words, whose dishes come
from a uniform base. Customers are word occurrences; the tables of a context
restaurant are the parent's customers.

Seating enters the probabilities only by the number of tables of a dish, so each
Gibbs step draws that number given all other tables: its weight is the
generalised Stirling number of the dish's customers and tables, times the chance
of opening that many tables of the dish. After the first sweeps, the predictive
probabilities of every sweep are added up; their mean scores the texts.

Words and pairs are dealt to parts by hash; the number of parts grows with the
tokens. A pair seen once has one table in every sweep, so a pair part holds and
draws only those seen more often; a word part holds its words' counts and draws
their tables in the parent. In a sweep the pair parts send the word parts their
tables' sums and get back the totals of their words; only the parent's totals
go to the driver. Tables of others that change in the same sweep are seen with
the next one's totals. At the end each block of documents gets what its words
and pairs need and adds up its documents' logs.

Defined cases: a missing or empty text is its end token; repeated rows are
scored each and teach each; rows without id teach; without any training row
every token has the base probability one; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from riskframe.llm.common import ascii_words, in_fold, map_batches, quoted, remove, whole_bytes
from riskframe.session import materialize, write_shared

HELD_OUT = 1
#: Contexts of ``first_state`` that belong to no word.
OTHER, FIRST_WORD = 0, 2
#: Bytes of an Arrow batch, as a task's process holds a batch besides a block or part.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"
BURN_IN, SAMPLES = 2, 3
STRENGTH = 1.0
#: Dishes of up to so many customers use the table of Stirling numbers.
EXACT = 192
#: For larger ones the weights of so many numbers of tables are found; those between count as the nearest.
KNOTS = 64
#: Logs of weights further below the largest one are left out of the draw.
NEGLIGIBLE = 30.0
#: Terms of the series for few tables, and the least part of its terms that a sum may be.
TERMS, LEAST_SUM = 64, 1e-10
KEPT_WORDS = 100_000
#: Bytes of text in one block.
BLOCK_BYTES = 4 << 20
SEED = 42


class WordIds:
    """64-bit hashes of words; the end token is the empty word's."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.end = self._hash(b"")

    @staticmethod
    def _hash(word: bytes) -> int:
        value = xxh64_intdigest(word)
        return value - (1 << 64) if value >> 63 else value

    def of(self, data: bytes) -> np.ndarray:
        ids = self.ids
        if len(ids) > KEPT_WORDS:
            ids.clear()
        words = ascii_words(data)
        get, put = ids.get, ids.setdefault
        out = [get(word) or put(word, self._hash(word)) for word in words]
        out.append(self.end)
        return np.array(out, dtype=np.int64)


def _binary(values: np.ndarray, ends: np.ndarray, kind) -> pa.Array:
    """Rows of little-endian numbers, row i ending at ``ends[i]``."""
    data = np.ascontiguousarray(np.asarray(values).astype(kind, copy=False))
    offsets = np.concatenate([[0], ends]).astype(np.int64) * data.itemsize
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data.view(np.uint8))]
    return pa.Array.from_buffers(pa.large_binary(), len(ends), buffers).cast(pa.binary())


def _flat(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all rows, numbers per row) of a binary column without missing rows."""
    size = np.dtype(kind).itemsize
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    total = int(offsets[-1] - offsets[0]) // size
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=kind, count=total, offset=int(offsets[0])).copy() if total else np.zeros(0, kind)
    return flat, np.diff(offsets).astype(np.int64) // size


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes; the bytes of like weight stand together, so that they compress."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
        out += [a.dtype.str[1:].encode(), len(a).to_bytes(4, "little"), planes]
    return b"".join(out)


def unpack(data: bytes | pa.Buffer) -> list[np.ndarray]:
    data, out, at = memoryview(data), [], 0
    while at < len(data):
        kind, size = np.dtype("<" + str(data[at : at + 2], "ascii")), int.from_bytes(data[at + 2 : at + 6], "little")
        end = at + 6 + size * kind.itemsize
        planes = np.frombuffer(data, np.uint8, end - at - 6, at + 6).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(size))
        at = end
    return out


TOKENS = "block bigint, words binary, data binary, doc int, n_tokens bigint"


def token_blocks(docs: DataFrame) -> DataFrame:
    """A row per block of documents (a slice of an Arrow batch) and a row per document.

    A block's words are the distinct ones with their training counts; its data are
    the documents' tokens as places among them, their sizes and whether they train.
    """

    def make():
        ids, count = WordIds(), [0]

        def step(texts, held_out):
            texts, train = texts.to_pylist(), ~held_out.to_numpy(zero_copy_only=False).astype(bool)
            block = (TaskContext.get().partitionId() << 24) + count[0]
            count[0] += 1
            found = [ids.of(t) for t in texts]
            sizes = np.array([len(f) for f in found], dtype=np.int64)
            words, tokens = np.unique(np.concatenate(found).view(np.uint64), return_inverse=True)
            counts = np.bincount(tokens[np.repeat(train, sizes)], minlength=len(words))
            data = pack(tokens.astype("<u4"), sizes, train.astype("<u1"))
            return pa.array([0, *range(len(texts))], pa.int64()), [
                pa.array(np.full(1 + len(found), block)),
                pa.array([pack(words, counts), *[None] * len(found)], pa.binary()),
                pa.array([data, *[None] * len(found)], pa.binary()),
                pa.array([None, *range(len(found))], pa.int32()),
                pa.array([None, *sizes.tolist()], pa.int64()),
            ]

        return step

    inputs = [F.col("data"), F.col("held_out")]
    return map_batches(docs, ["doc_id", "held_out"], inputs, TOKENS, make, BLOCK_BYTES)


def stirling_logs(discount: float, most: int) -> np.ndarray:
    """Logs of the generalised Stirling numbers: [customers, tables], -inf where there are none."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    tables = np.arange(most + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for n in range(most):
            stay = out[n] + np.log(np.maximum(n - discount * tables, 0))
            out[n + 1] = np.logaddexp(np.concatenate([[-np.inf], out[n, :-1]]), stay)
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Log of the gamma function of positive numbers."""
    low = x < 8
    z = np.where(low, x + 8, x)
    out = (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    if low.any():
        out[low] -= np.log(np.prod(x[low][:, None] + np.arange(8), axis=1))
    return out


def _sibuya_series(discount: float, n: np.ndarray, t: np.ndarray) -> np.ndarray:
    """``sibuya_logs`` by the expansion of a power of one minus a power; nan where its terms cancel."""
    term = np.broadcast_to(1 / n, t.shape).copy()
    total, size = np.zeros(t.shape), np.zeros(t.shape)
    with np.errstate(all="ignore"):
        for j in range(1, TERMS + 1):
            b = j * discount
            z, x = n - b, n - b + discount
            # The quotient of the gamma functions of both, without the difference of their large logs.
            step = (z - 0.5) * np.log1p(discount / z) + discount * (np.log(x) - 1)
            step += (1 / x - 1 / z) / 12 - (x**-3 - z**-3) / 360
            term *= (j - 1 - t) / j * np.exp(-step)  # zero from t + 1 on
            part = term * (0.0 if b == round(b) else 1 / math.gamma(-b))
            total += part
            size += np.abs(part)
        good = (total > LEAST_SUM * size) & (np.abs(term) * math.gamma(1 + b) < LEAST_SUM * total)
        return np.where(good, np.log(total), np.nan)


def _sibuya_saddle(discount: float, n: np.ndarray, t: np.ndarray) -> np.ndarray:
    """``sibuya_logs`` by the saddle point with its first correction; for many tables."""
    d, out = discount, t * np.log(discount)  # all draws are one
    more = np.flatnonzero(t < n)
    n, t = n[more], t[more]
    mean = np.log(n / t)
    u = -mean / (1 - d)
    with np.errstate(all="ignore"):
        for last in (False,) * 8 + (True,):
            x, y, f = -np.expm1(u), np.exp(u), -np.expm1(d * u)
            g, r = d * x * y ** (d - 1) / f, x / y
            a = (1 - d) * r
            slope = 1 + a - g
            if not last:
                u = np.minimum(u + (np.log(g) - mean) * r / slope, -1e-9)
        second = g * slope
        bend = a * (1 + r) - second
        third = second * slope + g * bend
        fourth = third * slope + 2 * second * bend + g * (a * (1 + r) * (1 + 2 * r) - third)
        k2, k3, k4 = t * second, t * third, t * fourth
        right = 1 + k4 / (8 * k2**2) - 5 * k3**2 / (24 * k2**3)
        out[more] = t * np.log(f) - n * np.log(x) - 0.5 * np.log(2 * np.pi * k2) + np.log(np.maximum(right, 1e-3))
    return out


def sibuya_logs(discount: float, n: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Logs of the chance that ``t`` Sibuya numbers add up to ``n``.

    It is the generalised Stirling number of n customers and t tables, times
    t! discount**t / n!. ``n`` is a column, ``t`` has a row for each of its rows.
    """
    out = _sibuya_series(discount, n, t)
    rest = np.isnan(out)
    out[rest] = _sibuya_saddle(discount, np.broadcast_to(n, t.shape)[rest], t[rest])
    return out


class Seating:
    """Draws numbers of tables of dishes in restaurants of one level."""

    def __init__(self, discount: float, strength: float, draw: np.random.Generator):
        self.discount, self.strength, self.draw = discount, strength, draw
        self.logs = stirling_logs(discount, EXACT)

    def tables(self, customers: np.ndarray, others: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """Tables of each dish, given the restaurant's other tables and the dish's chance in the parent."""
        out = np.minimum(customers, 1)
        for n in np.unique(customers[(customers > 1) & (customers <= EXACT)]):
            own = np.flatnonzero(customers == n)
            step = max(1, 500_000 // int(n))
            for at in range(0, len(own), step):
                part = own[at : at + step]
                out[part] = self._exact(int(n), others[part], chance[part])
        many = np.flatnonzero(customers > EXACT)
        if len(many):
            out[many] = self._strides(customers[many], others[many], chance[many])
        return out

    def _exact(self, n: int, others: np.ndarray, chance: np.ndarray) -> np.ndarray:
        opened = np.log(self.strength + self.discount * (others[:, None] + np.arange(n))) + np.log(chance)[:, None]
        weights = self.logs[n, 1 : n + 1] + np.cumsum(opened, axis=1)
        weights = np.exp(weights - weights.max(axis=1, keepdims=True)).cumsum(axis=1)
        points = self.draw.random(len(others)) * weights[:, -1]
        return 1 + np.minimum((weights < points[:, None]).sum(axis=1), n - 1)

    def _strides(self, customers: np.ndarray, others: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """Draws from weights at ``KNOTS`` numbers of tables around the likely ones."""
        step = 4096
        parts = [slice(at, at + step) for at in range(0, len(customers), step)]
        return np.concatenate([self._by_knots(customers[p], others[p], chance[p]) for p in parts])

    def _log_weights(self, n: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Logs of Stirling numbers times discount**t, up to a factor of each row."""
        out = np.empty(t.shape)
        small = n[:, 0] <= EXACT
        if small.any():
            tables = t[small].astype(np.int64)
            out[small] = self.logs[n[small].astype(np.int64), tables] + tables * np.log(self.discount)
        large = ~small
        if large.any():
            out[large] = sibuya_logs(self.discount, n[large], t[large]) - log_gamma(t[large] + 1)
        return out

    def _by_knots(self, customers: np.ndarray, others: np.ndarray, chance: np.ndarray) -> np.ndarray:
        n = customers[:, None].astype(np.float64)
        opened = (self.strength / self.discount + others)[:, None]
        low, high = np.ones_like(n), n.copy()
        rows = np.arange(len(n))
        while True:
            t = np.rint(low * (high / low) ** np.linspace(0, 1, KNOTS))
            weights = self._log_weights(n, t) + log_gamma(opened + t) - log_gamma(opened) + t * np.log(chance)[:, None]
            weights -= weights.max(axis=1, keepdims=True)
            kept = weights > -NEGLIGIBLE
            # The places before the first and behind the last that counts.
            first = np.maximum(kept.argmax(axis=1) - 1, 0)
            last = np.minimum(KNOTS - kept[:, ::-1].argmax(axis=1), KNOTS - 1)
            wide = (high[:, 0] - low[:, 0] >= KNOTS) & (last - first < KNOTS // 2)
            if not wide.any():
                break
            low[wide, 0], high[wide, 0] = t[rows, first][wide], t[rows, last][wide]
        # Every number of tables belongs to the nearest knot.
        ends = np.concatenate([np.floor((t[:, :-1] + t[:, 1:]) / 2), high], axis=1)
        starts = np.concatenate([low - 1, ends[:, :-1]], axis=1)
        mass = (np.exp(weights) * (ends - starts)).cumsum(axis=1)
        points = self.draw.random(len(n)) * mass[:, -1]
        pick = np.minimum((mass <= points[:, None]).sum(axis=1), KNOTS - 1)
        width = (ends - starts)[rows, pick]
        place = np.minimum(np.floor(self.draw.random(len(n)) * width), width - 1)
        return (starts[rows, pick] + 1 + place).astype(np.int64)


# --- the model with few contexts, whose totals fit on the driver: for tests only ---

STATE = "c_word bigint, us binary, cs binary, ts binary, top bigint, sums binary"


def first_state(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """One table per seen pair, one parent table per seen word.

    Every word also has the pair with OTHER, with what its other pairs leave of its count.
    """

    def make():
        def step(seen, pairs):
            seen = seen.to_numpy()
            per_row = np.diff(pairs.offsets.to_numpy())
            flat = pairs.flatten()
            u, c = (flat.field(i).to_numpy() for i in range(2))
            starts = np.cumsum(per_row) - per_row
            rows = np.repeat(np.arange(len(seen)), per_row)
            named = np.bincount(rows, weights=c, minlength=len(seen)).astype(np.int64)
            # OTHER is the smallest context, so it goes in front.
            u, c = np.insert(u, starts, OTHER), np.insert(c, starts, seen - named)
            ends = np.cumsum(per_row + 1)
            return None, [
                pa.array(seen), _binary(u, ends, "<u2"), _binary(c, ends, "<i8"), _binary(np.minimum(c, 1), ends, "<i8"),
                pa.array(np.minimum(seen, 1)), _binary(np.zeros(len(c)), ends, "<f8"),
            ]

        return step

    none = F.array().cast("array<struct<u:int,c:bigint>>")
    whole = counts.join(pairs, "w", "left").select("w", "n", F.coalesce("pairs", none).alias("pairs"))
    return map_batches(whole, ["w"], [F.col("n"), F.col("pairs")], STATE, make)


class Totals:
    """Customers and tables of every restaurant; the parent's dishes and discounts."""

    def __init__(self, state: DataFrame, contexts: int):
        size = contexts + FIRST_WORD

        def make():
            def step(us, cs, ts, top):
                u, _ = _flat(us, "<u2")
                c, t = _flat(cs, "<i8")[0], _flat(ts, "<i8")[0]
                rows = [np.zeros(size + 1, dtype=np.int64) for _ in range(4)]
                for out, values in zip(rows, (c, t, (c == 1), (c == 2))):
                    np.add.at(out, u, values.astype(np.int64))
                rows[1][size] = top.to_numpy().sum()
                return pa.array(np.zeros(size + 1, dtype=np.int64)), [
                    pa.array(np.arange(size + 1), pa.int32()), *map(pa.array, rows)
                ]

            return step

        inputs = [F.col(c) for c in ("us", "cs", "ts", "top")]
        each = map_batches(state, [], inputs, "u int, c bigint, t bigint, ones bigint, twos bigint", make)
        sums = each.groupBy("u").agg(*[F.sum(c).alias(c) for c in ("c", "t", "ones", "twos")]).collect()  # per context
        self.customers, self.tables = np.zeros(size), np.zeros(size)
        self.top_tables, self.ones, self.twos = 0, 0, 0
        for r in sums:
            if r["u"] == size:
                self.top_tables = r["t"]
            else:
                self.customers[r["u"]], self.tables[r["u"]] = r["c"], r["t"]
                self.ones += r["ones"]
                self.twos += r["twos"]
        self.top_customers = float(self.tables.sum())

    def plus(self, other: Totals) -> Totals:
        """The totals of both."""
        for name, value in vars(other).items():
            setattr(self, name, getattr(self, name) + value)
        return self

    def discount(self) -> float:
        return float(np.clip(self.ones / max(1, self.ones + 2 * self.twos), 0.1, 0.95))


def parent_chances(totals: Totals, base: float, discount: float, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Chances of words in the parent restaurant."""
    rest = (STRENGTH + discount * totals.top_tables) / (STRENGTH + totals.top_customers)
    return (customers - discount * tables) / (STRENGTH + totals.top_customers) + rest * base


def pair_chances(totals: Totals, discount: float, u, c, t, parent) -> np.ndarray:
    """Predictive chances of pairs, given their words' chances in the parent."""
    rest = (STRENGTH + discount * totals.tables) / (STRENGTH + totals.customers)
    return (c - discount * t) / (STRENGTH + totals.customers[u]) + rest[u] * parent


def sweep(state: DataFrame, totals: Totals, base: float, discount: float, number: int, keep: bool, last: bool) -> DataFrame:
    """Add the state's predictive chances to the sums if ``keep``; draw the next state unless ``last``."""

    def make():
        def step(words, c_word, us, cs, ts, top, sums):
            u, per_row = _flat(us, "<u2")
            c, t, total = _flat(cs, "<i8")[0], _flat(ts, "<i8")[0], _flat(sums, "<f8")[0]
            top = top.to_numpy()
            ends = np.cumsum(per_row)
            rows = np.repeat(np.arange(len(per_row)), per_row)
            parent = parent_chances(totals, base, discount, np.add.reduceat(t, ends - per_row), top)[rows]
            if keep:
                total += pair_chances(totals, discount, u, c, t, parent)
            if not last:
                # The same draws whenever the task runs again.
                draw = np.random.default_rng([SEED, number, int(words[0].as_py()) & 0xFFFFFFFF])
                seating = Seating(discount, STRENGTH, draw)
                t = seating.tables(c, np.maximum(totals.tables[u] - t, 0), parent)
                customers = np.add.reduceat(t, ends - per_row)
                top = seating.tables(customers, np.maximum(totals.top_tables - top, 0), np.full(len(top), base))
            return None, [
                c_word, us, cs, _binary(t, ends, "<i8"), pa.array(top, pa.int64()), _binary(total, ends, "<f8")
            ]

        return step

    inputs = [F.col(c) for c in ("w", "c_word", "us", "cs", "ts", "top", "sums")]
    return map_batches(state, ["w"], inputs, STATE, make)


# --- the model in parts -------------------------------------------------------

#: Tokens of a part. Words are dealt to parts by their hash, pairs by the hash of both words.
PART_TOKENS = 1_000_000
#: Kinds of rows: a block and its pairs, a word part's state, a pair part's state and what goes between them.
BLOCK, WORDS, PAIRS, PLACES, CODES, VALUES, CHANCES, ASKED, TABLES = range(9)
MESSAGE = "kind int, key bigint, sender bigint, data binary, sums array<double>"


def joined(messages: list[bytes], kinds: str) -> list[np.ndarray]:
    """Each of the messages' arrays, one message after the other; ``kinds`` if there are none."""
    if not messages:
        return [np.zeros(0, kind) for kind in kinds.split()]
    return [np.concatenate(a) for a in zip(*map(unpack, messages))]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["kind", "key", "sender", "data", "sums"])


def step_of_parts(rows: DataFrame, make: Callable[[], Callable], result=MESSAGE, batch: Callable = _batch) -> DataFrame:
    """Rows to the part or block that is their key, and the rows that it sends.

    ``make`` builds, once per task, the function that gets a key and its rows as
    {kind: ([sender], [data])}, by sender, and returns rows. Memory holds one
    key's rows: about ``PART_TOKENS`` tokens' share, or a block.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        handle, current, inbox = None, None, {}

        def out():
            sent = handle(current, inbox)
            if sent:
                yield batch(sent)

        for part in batches:
            handle = handle or make()
            heads = zip(*(c.to_pylist() for c in part.columns[:3]))
            for (kind, key, sender), data in zip(heads, part.column(3)):
                if key != current:
                    if current is not None:
                        yield from out()
                    current, inbox = key, {}
                senders, held = inbox.setdefault(kind, ([], []))
                senders.append(sender)
                held.append(data.as_buffer())
        if current is not None:
            yield from out()

    rows = rows.select("kind", "key", "sender", "data")
    return rows.repartition("key").sortWithinPartitions("key", "kind", "sender").mapInArrow(run, result)


def _ranges(groups: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(group, its places) of sorted groups."""
    starts = np.flatnonzero(np.diff(groups, prepend=-1))
    for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(groups)]):
        yield int(groups[at]), slice(at, end)


def ask_words(tokens: DataFrame, parts: int) -> DataFrame:
    """Each block's words with their training counts, to the words' parts.

    Parts are ranges of hashes, so a block's words are in order of their parts.
    """

    def run(batches):
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                words, counts = unpack(data.as_buffer())
                part = (((words >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
                yield _batch([(ASKED, q, block, pack(words[s], counts[s]), None) for q, s in _ranges(part)])

    return tokens.where("doc is null").select("block", "words").mapInArrow(run, MESSAGE)


def number_words(asked: DataFrame) -> DataFrame:
    """The words' parts count their words; blocks get their words' places in the part and counts.

    A part's sums: its words, their training tokens, and how many words those are of.
    """

    def handle(part, inbox):
        blocks, data = inbox[ASKED]
        sizes = [len(unpack(d)[0]) for d in data]
        ids, counts = joined(data, "u8 i8")
        words, place = np.unique(ids, return_inverse=True)
        n = np.bincount(place, weights=counts, minlength=len(words)).astype(np.int64)
        ends = np.cumsum(sizes)
        out = [(PLACES, b, part, pack(place[e - s : e].astype("<u4"), n[place[e - s : e]]), None) for b, s, e in zip(blocks, sizes, ends)]
        sums = [float(len(words)), float(n.sum()), float((n > 0).sum())]
        return [*out, (WORDS, part, -1, pack(n, np.zeros(len(n), "<i8")), sums)]

    return step_of_parts(asked, lambda: handle)


class Numbers:
    """Words numbered by part; parts of pairs."""

    def __init__(self, starts: np.ndarray, parts: int):
        self.starts, self.parts = starts, parts

    def split(self, numbers: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray]]:
        """(word part, places among the sorted numbers, places in the part)."""
        part = np.searchsorted(self.starts, numbers, side="right") - 1
        for q, s in _ranges(part):
            yield q, s, (numbers[s] - self.starts[q]).astype("<u4")

    def of_block(self, senders: list[int], found: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and training counts of a block's words."""
        return np.concatenate([f[0] + self.starts[q] for q, f in zip(senders, found)]), np.concatenate([f[1] for f in found])

    def pairs(self, tokens: np.ndarray, number: np.ndarray, n: np.ndarray):
        """A block's distinct pairs in order of their parts: the place of each token's pair,
        the pairs' words, and the places and parts of those whose words both were seen.

        The end of a text is what the next text's first word follows, so the start
        of a text needs no context of its own: the end token has as many customers.
        """
        key, pair = np.unique((np.roll(tokens, 1).astype(np.int64) << 32) | tokens, return_inverse=True)
        u, w = key >> 32, key & 0xFFFFFFFF
        mixed = (number[u].astype(np.uint64) << np.uint64(32) | number[w].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        part = ((mixed >> np.uint64(32)) % np.uint64(self.parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        place = np.empty(len(key), np.int64)
        place[order] = np.arange(len(key))
        u, w, part = u[order], w[order], part[order]
        asked = np.flatnonzero((n[u] > 0) & (n[w] > 0))
        return place[pair], u, w, asked, part[asked]


def ask_pairs(rows: DataFrame, numbers: Numbers) -> DataFrame:
    """Each block's distinct pairs with their training counts, to the pairs' parts."""

    def handle(block, inbox):
        senders, data = inbox[PLACES]
        number, n = numbers.of_block(senders, [unpack(d) for d in data])
        tokens, sizes, train = unpack(inbox[BLOCK][1][0])
        pair, u, w, asked, part = numbers.pairs(tokens, number, n)
        c = np.bincount(pair, weights=np.repeat(train, sizes), minlength=len(u))[asked].astype("<u4")
        u, w = number[u[asked]].astype("<u4"), number[w[asked]].astype("<u4")
        return [(ASKED, p, block, pack(u[s], w[s], c[s]), None) for p, s in _ranges(part)]

    return step_of_parts(rows, lambda: handle)


def _to_words(part: int, numbers: Numbers, us, ws, ui, wi, left) -> list[tuple]:
    """Customers less tables of the pairs, summed by context and by word, to the words' parts."""
    out: dict[int, list] = {}
    for k, (known, place) in enumerate(((us, ui), (ws, wi))):
        sums = np.bincount(place, weights=left, minlength=len(known)).astype(np.int64)
        for q, s, at in numbers.split(known):
            out.setdefault(q, [np.zeros(0, "<u4"), np.zeros(0, "<i8")] * 2)[2 * k : 2 * k + 2] = at, sums[s]
    return [(TABLES, q, part, pack(*arrays), None) for q, arrays in out.items()]


def count_pairs(asked: DataFrame, numbers: Numbers) -> DataFrame:
    """The pairs' parts add up the counts. A pair seen once always has one table, so only
    those seen more often are drawn; what a word has besides them are its single pairs.

    A part's sums: the drawn pairs' customers and how many pairs have two. Its rows
    CODES hold for a block's pairs 0, 1 (seen once) or 2 and the place among the drawn.
    """

    def handle(part, inbox):
        blocks, data = inbox[ASKED]
        sizes = [len(unpack(d)[0]) for d in data]
        u, w, c = joined(data, "u4 u4 u4")
        key, place = np.unique(u.astype(np.uint64) << np.uint64(32) | w, return_inverse=True)
        c = np.bincount(place, weights=c, minlength=len(key)).astype(np.int64)
        drawn = c > 1
        codes = np.minimum(c, 1)
        codes[drawn] = 2 + np.arange(drawn.sum())
        codes, ends = codes.astype("<u4")[place], np.cumsum(sizes)
        out = [(CODES, part, b, pack(codes[e - s : e]), None) for b, s, e in zip(blocks, sizes, ends)]
        key, c = key[drawn], c[drawn]
        us, ui = np.unique((key >> np.uint64(32)).astype(np.int64), return_inverse=True)
        ws, wi = np.unique((key & np.uint64(0xFFFFFFFF)).astype(np.int64), return_inverse=True)
        t = np.ones(len(c), np.int64)
        state = pack(us, ws, ui.astype("<u4"), wi.astype("<u4"), c, t, np.zeros(len(c), np.int64))
        sums = [float(c.sum()), float((c == 2).sum())]
        return [*out, (PAIRS, part, -1, state, sums), *_to_words(part, numbers, us, ws, ui, wi, c - t)]

    return step_of_parts(asked, lambda: handle)


class Whole:
    """Customers and tables of the parent restaurant."""

    def __init__(self, customers: float, tables: float):
        self.top_customers, self.top_tables = customers, tables


def seat_words(rows: DataFrame, before: Whole | None, base: float, discount: float, number: int) -> DataFrame:
    """The words' parts take over the tables of their pairs and draw the parent's, one each at first.

    Of the last sweeps they keep each word's tables as a context, its customers and
    its tables in the parent. The pairs' parts get these three of their words, but
    for the last sweep. A part's sums: the last two.
    """
    keep, last = number >= BURN_IN, number == BURN_IN + SAMPLES - 1

    def make():
        seating = Seating(discount, STRENGTH, np.random.default_rng(0))

        def handle(part, inbox):
            n, top, *kept = unpack(inbox[WORDS][1][0])
            parts, data = inbox.get(TABLES, ([], []))
            asked = [unpack(d) for d in data]
            tables, customers = n.copy(), n.copy()
            for at_u, left_u, at_w, left_w in asked:
                tables[at_u] -= left_u
                customers[at_w] -= left_w
            if before is None:
                top = np.minimum(customers, 1)
            else:
                # The same draws whenever the task runs again.
                seating.draw = np.random.default_rng([SEED, number, 0, part])
                top = seating.tables(customers, np.maximum(before.top_tables - top, 0), np.full(len(n), base))
            kept += [tables, customers, top] if keep else []
            sums = [float(customers.sum()), float(top.sum())]
            out = [(WORDS, part, -1, pack(n, top, *kept), sums)]
            if not last:
                sent = (pack(tables[a[0]], customers[a[2]], top[a[2]]) for a in asked)
                out += [(VALUES, p, part, data, None) for p, data in zip(parts, sent)]
            return out

        return handle

    return step_of_parts(rows, make)


def _small(change: np.ndarray) -> np.ndarray:
    """Small numbers of either sign as small ones without sign."""
    return (change << 1) ^ (change >> 63)


def word_chances(rows: DataFrame) -> DataFrame:
    """To the blocks, of their words: places, counts and what was kept, as changes from sweep to sweep.

    Words seen once have one table of each, unseen ones none: these are not sent.
    """

    def handle(part, inbox):
        n, _, *kept = unpack(inbox[WORDS][1][0])
        kept = [k if i < 3 else _small(k - kept[i - 3]) for i, k in enumerate(kept)]
        out = []
        for block, data in zip(*inbox[PLACES]):
            place, count = unpack(data)
            drawn = place[count > 1]
            out.append((CHANCES, block, part, pack(place, count, *(k[drawn] for k in kept)), None))
        return out

    return step_of_parts(rows, lambda: handle)


def seat_pairs(rows: DataFrame, numbers: Numbers, whole: Whole, base: float, discount: float, number: int) -> DataFrame:
    """The pairs' parts draw the tables of their pairs, given those of all others before."""
    keep = number + 1 >= BURN_IN

    def make():
        seating = Seating(discount, STRENGTH, np.random.default_rng(0))

        def handle(part, inbox):
            us, ws, ui, wi, c, t, total = unpack(inbox[PAIRS][1][0])
            tables, customers, top = joined(inbox.get(VALUES, ([], []))[1], "i8 i8 i8")
            parent = parent_chances(whole, base, discount, customers, top)[wi]
            seating.draw = np.random.default_rng([SEED, number, 1, part])
            t = seating.tables(c, np.maximum(tables[ui] - t, 0), parent)
            state = pack(us, ws, ui, wi, c, t, total + t if keep else total)
            return [(PAIRS, part, -1, state, None), *_to_words(part, numbers, us, ws, ui, wi, c - t)]

        return handle

    return step_of_parts(rows, make)


def pair_values(rows: DataFrame) -> DataFrame:
    """To the blocks, of their pairs: the customers, and the kept sweeps' tables added up."""

    def handle(part, inbox):
        _, _, _, _, c, _, total = unpack(inbox[PAIRS][1][0])
        c, total = np.concatenate([[0, 1], c]), np.concatenate([[0, SAMPLES], total])
        codes = (unpack(d)[0] for d in inbox[CODES][1])
        return [(VALUES, b, part, pack(c[k], total[k]), None) for b, k in zip(inbox[CODES][0], codes)]

    return step_of_parts(rows, lambda: handle)


SUMS = "block bigint, doc int, score double, base_score double, n_known bigint"


def block_sums(rows: DataFrame, numbers: Numbers, kept: list[Whole], base: float, discount: float, n: int, v: int) -> DataFrame:
    """(block, doc, score, base_score, n_known): sums over each document's tokens."""

    def handle(block, inbox):
        senders, data = inbox.pop(CHANCES)
        found = [unpack(d) for d in data]
        number, count = numbers.of_block(senders, found)
        drawn = np.flatnonzero(count > 1)
        tokens, sizes, _ = unpack(inbox[BLOCK][1][0])
        pair, u, w, asked, _ = numbers.pairs(tokens, number, count)
        c, total = joined(inbox.pop(VALUES, ([], []))[1], "i8 i8")
        chances = np.zeros(len(u))
        chances[asked] = (c - discount * total / SAMPLES) / (STRENGTH + count[u[asked]])
        each = [np.minimum(count, 1) for _ in range(3)]  # tables, customers, tables in the parent
        for k, whole in enumerate(kept):
            for j, values in enumerate(each):
                sent = np.concatenate([f[2 + 3 * k + j] for f in found])
                values[drawn] = sent if k == 0 else values[drawn] + ((sent >> 1) ^ -(sent & 1))
            tables, customers, top = each
            opened = (STRENGTH + discount * tables) / (STRENGTH + count)
            chances += opened[u] * parent_chances(whole, base, discount, customers, top)[w] / SAMPLES
        logs = np.log10(chances)[pair]
        first = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        sums = [np.bincount(doc, weights=x, minlength=len(sizes)) for x in (logs, first[tokens], count[tokens] > 0)]
        return [(block, *sums)]

    def batch(rows):
        (block, score, first, known), = rows
        columns = [np.full(len(score), block), np.arange(len(score), dtype=np.int32), score, first, known.astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "doc", "score", "base_score", "n_known"])

    return step_of_parts(rows, lambda: handle, SUMS, batch)


def _only(rows: DataFrame, *kinds: int) -> DataFrame:
    return rows.where(F.col("kind").isin(*kinds))


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    spark = docs.sparkSession
    named = docs.select(
        quoted(doc_id).alias("doc_id"), in_fold(doc_id, HELD_OUT).alias("held_out"), whole_bytes(text).alias("data")
    )

    def stored(rows: DataFrame, name: str) -> tuple[DataFrame, str]:
        """The written rows, and where they are."""
        spark._jvm.System.gc()  # the shuffles of earlier steps go with their plans
        before = spark.conf.get(BATCH_BYTES[0])
        spark.conf.set(*BATCH_BYTES)
        try:
            path = write_shared(rows, name)
        finally:
            spark.conf.set(BATCH_BYTES[0], before)
        return spark.read.schema(rows.schema).parquet(path), path

    def written(rows: DataFrame) -> tuple[DataFrame, str, list]:
        """The written rows, where they are, and the parts' sums."""
        rows, path = stored(rows, "parts")
        return rows, path, rows.where("sums is not null").select("key", "sums").collect()  # a row per part

    tokens, tokens_path = stored(token_blocks(named), "tokens")
    size = tokens.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    parts = 1 + size // PART_TOKENS
    words, words_path, found = written(number_words(ask_words(tokens, parts)))
    tokens, _ = stored(tokens.drop("words"), "tokens")
    remove(spark, tokens_path)
    sizes = np.zeros(parts, np.int64)
    for r in found:
        sizes[r["key"]] = r["sums"][0]
    n, v = (int(sum(r["sums"][k] for r in found)) for k in (1, 2))
    base = 1.0 / (v + 1)
    numbers = Numbers(np.cumsum(sizes) - sizes, parts)
    blocks = tokens.where("doc is null").select(
        F.lit(BLOCK).alias("kind"), F.col("block").alias("key"), F.lit(-1).cast("bigint").alias("sender"), "data",
        F.lit(None).cast("array<double>").alias("sums"),
    )
    places = _only(words, PLACES)
    pairs, pairs_path, found = written(count_pairs(ask_pairs(blocks.unionByName(places), numbers), numbers))
    drawn, twos = (sum(r["sums"][k] for r in found) for k in (0, 1))
    ones = n - drawn
    discount = float(np.clip(ones / max(1, ones + 2 * twos), 0.1, 0.95))
    codes = _only(pairs, CODES)
    # The blocks' questions, as rows of the words' parts.
    asked = places.select("kind", F.col("sender").alias("key"), F.col("key").alias("sender"), "data", "sums")
    whole, kept, old = None, [], []
    for number in range(BURN_IN + SAMPLES):
        last = number == BURN_IN + SAMPLES - 1
        rows = _only(words, WORDS).unionByName(_only(pairs, TABLES))
        words, path, found = written(seat_words(rows, whole, base, discount, number))
        whole = Whole(*(sum(r["sums"][k] for r in found) for k in (0, 1)))
        kept += [whole] if number >= BURN_IN else []
        if last:
            break
        rows = _only(pairs, PAIRS).unionByName(_only(words, VALUES))
        pairs, now, _ = written(seat_pairs(rows, numbers, whole, base, discount, number))
        for used in old:
            remove(spark, used)
        old = [path, now]
    values = pair_values(codes.unionByName(_only(pairs, PAIRS)))
    chances = word_chances(_only(words, WORDS).unionByName(asked))
    rows = blocks.unionByName(chances).unionByName(values)
    sums, _ = stored(block_sums(rows, numbers, kept, base, discount, n, v), "sums")
    for used in [words_path, pairs_path, path, *old]:
        remove(spark, used)
    rows = tokens.where("doc is not null").select("block", "doc", "doc_id", "held_out", "n_tokens")
    return rows.join(sums, ["block", "doc"]).select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
