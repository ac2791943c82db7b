"""Leaf-wise gradient boosting on histograms.

Feature slots are cut into bins from one sketch, and the rows are written once
as blocks of bin numbers. A tree grows leaf by leaf, the best gain first, up to
its number of leaves. What a split's children are worth does not depend on the
order of the splits, so one pass over the blocks sums gradients for the children
of all splits that are sure to come: a tree takes about as many jobs as it is
deep. Only the smaller child of a split is summed, its sibling is the rest.

Each pass returns one table of sums, whose size is checked before the first one.
Rows of a label whose cells are all equal share their gradients. Where a large
table holds many such rows, they become one row with a count, and a draw of rows
takes a binomial number of them, which is how many of them single draws take.
Rows never leave their tasks: they are dealt into blocks where they lie. Margins are kept beside the blocks and are
checkpointed now and then, so a lost executor costs a few trees at most.

The result is a ``GBTClassificationModel``: it scores inside the JVM and is
saved and loaded like any other stage.
"""

from __future__ import annotations

import heapq
import json
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.operators.prep import sparse_parts
from riskframe.operators.split import SEED
from riskframe.session import materialize, new_shared_path

# The published tuned parameters.
TUNED_BOOST = {
    "n_estimators": 483,
    "learning_rate": 0.010636066512540286,
    "num_leaves": 124,
    "max_depth": 11,
    "min_child_samples": 50,
    "subsample": 0.6727299868828402,
    "colsample_bytree": 0.6733618039413735,
    "reg_alpha": 0.016480446427978974,
    "reg_lambda": 0.12561043700013563,
}

#: Least sum of Hessians on either side of a split.
LEAST_HESSIAN = 1e-3
MAX_BINS = 255
BLOCK_ROWS = 1 << 16
#: Bytes of one pass's sums.
MAX_SUMS = 256 << 20
CHECKPOINT_TREES = 25


@dataclass(frozen=True)
class BoostParams:
    """The booster's nine parameters."""

    n_estimators: int = 100
    learning_rate: float = 0.1
    num_leaves: int = 31
    max_depth: int = 11
    min_child_samples: int = 50
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    reg_alpha: float = 0.0
    reg_lambda: float = 0.0


@dataclass(frozen=True)
class Bins:
    """Cut points of every slot; the cells of all slots stand one after another."""

    cuts: list[np.ndarray]  # value <= cuts[b] lies in bin b or below; the last bin is open
    starts: np.ndarray = field(init=False)  # first cell of each slot, and the number of cells
    zero: np.ndarray = field(init=False)  # cell of the value 0

    def __post_init__(self):
        sizes = [len(c) + 1 for c in self.cuts]
        object.__setattr__(self, "starts", np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
        zero = [np.searchsorted(c, 0.0, side="left") for c in self.cuts]
        object.__setattr__(self, "zero", self.starts[:-1] + np.array(zero, dtype=np.int64))

    @property
    def slot_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.cuts)), np.diff(self.starts))


def find_bins(rows: DataFrame, width: int, max_bins: int = MAX_BINS) -> Bins:
    """Cut points of the ``features`` vector's slots: midpoints of neighbouring quantiles.

    One row per slot comes back.
    """
    _, indices, values = sparse_parts()
    cells = rows.select(F.explode(F.arrays_zip(indices.alias("i"), values.alias("v"))).alias("c")).select("c.*")
    shares = [k / max_bins for k in range(max_bins + 1)]
    sketch = F.percentile_approx("v", shares, 20 * max_bins).alias("q")
    cuts = [np.empty(0)] * width
    for r in cells.where("v <> 0").groupBy("i").agg(sketch).collect():
        q = np.unique([*r["q"], 0.0])
        cuts[r["i"]] = (q[:-1] + q[1:]) / 2
    return Bins(cuts)


@dataclass(frozen=True)
class Block:
    """Rows of one block: labels, weights, and the cells whose value is not the zero bin's."""

    number: int
    label: np.ndarray
    weight: np.ndarray
    row: np.ndarray  # of each entry
    cell: np.ndarray
    times: np.ndarray | None = None  # equal rows that each row stands for; one if left out

    def drawn(self, seed: int, tree: int, share: float) -> np.ndarray:
        """How often each row is in a tree's sample: the same whenever it is drawn."""
        if share >= 1:
            return np.ones(len(self.label)) if self.times is None else self.times.astype(np.float64)
        draw = np.random.Generator(np.random.PCG64([seed, tree, self.number]))
        if self.times is None:
            return (draw.random(len(self.label)) < share).astype(np.float64)
        return draw.binomial(self.times, share).astype(np.float64)


_BLOCK = "number bigint, label binary, sizes binary, cells binary, times binary"


def _packed(number: int, labels: list, sizes: list, cells: list, times: list) -> pa.RecordBatch:
    columns = (labels, "u1"), (sizes, "<i4"), (cells, "<i4"), (times, "<i8")
    data = [np.concatenate([np.empty(0, t), *x]).astype(t).tobytes() for x, t in columns]
    return pa.RecordBatch.from_arrays(
        [pa.array([number]), *(pa.array([d], pa.binary()) for d in data)], names=["number", "label", "sizes", "cells", "times"]
    )


def binned_blocks(rows: DataFrame, bins: Bins, parts: int) -> DataFrame:
    """Rows of (features, label) as a written table of blocks."""
    _, indices, values = sparse_parts()
    starts, zero = bins.starts, bins.zero
    flat_cuts = np.concatenate([*bins.cuts, np.empty(0)])
    cut_starts = starts - np.arange(len(starts))

    def cells_of(index: np.ndarray, value: np.ndarray) -> np.ndarray:
        low, high = cut_starts[index], cut_starts[index + 1]
        while (open_ := low < high).any():  # binary search in every entry's own cuts
            middle = (low + high) // 2
            above = open_ & (flat_cuts[np.minimum(middle, len(flat_cuts) - 1)] < value)
            low, high = np.where(above, middle + 1, low), np.where(open_ & ~above, middle, high)
        return starts[index] + low - cut_starts[index]

    def run(batches):
        from pyspark import TaskContext

        labels, sizes, cells, n, made = [], [], [], 0, 0
        part = TaskContext.get().partitionId()

        for batch in batches:
            index = batch.column(1)
            lengths = np.diff(index.offsets.to_numpy())
            slot, value = index.flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            found = cells_of(slot, value) if len(slot) else np.empty(0, dtype=np.int64)
            kept = found != zero[slot]
            row = np.repeat(np.arange(len(lengths)), lengths)
            labels.append(batch.column(0).to_numpy())
            sizes.append(np.bincount(row[kept], minlength=len(lengths)))
            cells.append(found[kept])
            n += len(lengths)
            if n >= BLOCK_ROWS:
                yield _packed(part << 32 | made, labels, sizes, cells, [])
                labels, sizes, cells, n, made = [], [], [], 0, made + 1
        if n:
            yield _packed(part << 32 | made, labels, sizes, cells, [])

    plain = rows.select(F.col("label").cast("tinyint").alias("label"), indices.alias("i"), values.alias("v"))
    return materialize(plain.coalesce(parts).mapInArrow(run, _BLOCK), "blocks")


def equal_rows(blocks: DataFrame) -> DataFrame:
    """(label, cells, n): the blocks' rows, equal ones once with their number."""

    def run(batches):
        for batch in batches:
            for label, sizes, cells in zip(*(batch.column(c).to_pylist() for c in ("label", "sizes", "cells"))):
                ends = np.cumsum(np.frombuffer(sizes, dtype="<i4"), dtype=np.int64) * 4
                offsets = pa.py_buffer(np.concatenate([[0], ends]).astype("<i8").tobytes())
                rows = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, offsets, pa.py_buffer(cells)])
                own = np.frombuffer(label, dtype="i1")
                yield pa.RecordBatch.from_arrays([pa.array(own), rows.cast(pa.binary())], names=["label", "cells"])

    rows = blocks.mapInArrow(run, "label tinyint, cells binary")
    return materialize(rows.groupBy("label", "cells").agg(F.count(F.lit(1)).alias("n")), "equal")


def counted_blocks(rows: DataFrame, parts: int) -> DataFrame:
    """The rows of ``equal_rows`` as a written table of blocks, whatever order they come in."""

    def run(batches):
        from pyspark import TaskContext

        labels, sizes, cells, times, n, made = [], [], [], [], 0, 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            own = batch.column(1).to_pylist()
            labels.append(batch.column(0).to_numpy())
            sizes.append([len(c) // 4 for c in own])
            cells.append(np.frombuffer(b"".join(own), dtype="<i4"))
            times.append(batch.column(2).to_numpy())
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield _packed(part << 32 | made, labels, sizes, cells, times)
                labels, sizes, cells, times, n, made = [], [], [], [], 0, made + 1
        if n:
            yield _packed(part << 32 | made, labels, sizes, cells, times)

    dealt = rows.select("label", "cells", "n").repartition(parts, "cells").sortWithinPartitions("cells", "label")
    return materialize(dealt.mapInArrow(run, _BLOCK), "blocks")


def _unpacked(row, positive: float) -> Block:
    label = np.frombuffer(row["label"], dtype="u1").astype(np.float64)
    sizes = np.frombuffer(row["sizes"], dtype="<i4")
    weight = np.where(label == 1, positive, 1.0)
    entry = np.repeat(np.arange(len(label), dtype=np.int32), sizes)
    times = np.frombuffer(row["times"], dtype="<i8") if row["times"] else None
    return Block(row["number"], label, weight, entry, np.frombuffer(row["cells"], dtype="<i4"), times)


@dataclass
class Tree:
    """Nodes as lists: split slot and cell (-1 in leaves), children, value, rows, gain."""

    slot: list[int] = field(default_factory=lambda: [-1])
    cell: list[int] = field(default_factory=lambda: [-1])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    rows: list[int] = field(default_factory=lambda: [0])
    gain: list[float] = field(default_factory=lambda: [-1.0])

    def split(self, node: int, slot: int, cell: int, gain: float) -> tuple[int, int]:
        children = len(self.slot), len(self.slot) + 1
        self.slot[node], self.cell[node], self.gain[node] = slot, cell, gain
        self.left[node], self.right[node] = children
        for x, empty in ((self.slot, -1), (self.cell, -1), (self.left, -1), (self.right, -1), (self.value, 0.0), (self.rows, 0), (self.gain, -1.0)):
            x += [empty, empty]
        return children


def _places(tree: Tree, block: Block, bins: Bins, slot_of: np.ndarray, node: np.ndarray | None = None) -> np.ndarray:
    """The leaf of every row, sought from the root or from nodes that hold the rows."""
    node = np.zeros(len(block.label), dtype=np.int64) if node is None else node
    slot, cell = np.array(tree.slot), np.array(tree.cell)
    left, right = np.array(tree.left), np.array(tree.right)
    while True:
        inner = slot[node] >= 0
        if not inner.any():
            return node
        below = np.zeros(len(node), dtype=bool)
        below[inner] = bins.zero[slot[node[inner]]] <= cell[node[inner]]
        at = node[block.row]
        own = slot_of[block.cell] == slot[at]
        below[block.row[own]] = block.cell[own] <= cell[at[own]]
        node = np.where(inner, np.where(below, left[node], right[node]), node)


def _gradients(block: Block, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-margin))
    return block.weight * (p - block.label), block.weight * p * (1 - p)


def _sums(block: Block, margin: np.ndarray, drawn: np.ndarray, place: np.ndarray, nodes: list[int], cells: int) -> np.ndarray:
    """(node, cell or total, [g, h, rows]) of a block; the last cell is the node's total."""
    number = np.full(place.max(initial=0) + max(nodes) + 2, -1)
    number[nodes] = np.arange(len(nodes))
    own = np.where(drawn > 0, number[place], -1)
    g, h = _gradients(block, margin)
    size, row = cells + 1, block.row
    used = own[row] >= 0
    entry, rows = own[row[used]] * size + block.cell[used], np.flatnonzero(own >= 0)
    total = own[rows] * size + cells
    out = np.empty((3, len(nodes) * size))
    for i, v in enumerate((g * drawn, h * drawn, drawn)):
        out[i] = np.bincount(entry, v[row[used]], len(nodes) * size)
        out[i] += np.bincount(total, v[rows], len(nodes) * size)
    return out.reshape(3, len(nodes), size)


def _with_zero_bins(sums: np.ndarray, bins: Bins) -> np.ndarray:
    """Fill each slot's zero bin with what its other bins leave of the total."""
    sums = sums.copy()
    filled = np.add.reduceat(sums[..., :-1], bins.starts[:-1], axis=-1)
    sums[..., bins.zero] += sums[..., -1:] - filled
    return sums


def _shrunk(g, alpha: float):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def leaf_weight(g, h, params: BoostParams):
    """The value that takes most off the penalised loss."""
    return -_shrunk(g, params.reg_alpha) / (h + params.reg_lambda)


def best_split(sums: np.ndarray, bins: Bins, slots: np.ndarray, params: BoostParams) -> tuple[float, int, int] | None:
    """(gain, slot, cell) of one node's filled sums; cells up to that one go left."""

    def score(g, h):
        return _shrunk(g, params.reg_alpha) ** 2 / (h + params.reg_lambda + 1e-300)

    total = sums[:, -1]
    if total[2] < 2 * params.min_child_samples or not len(slots):
        return None
    running = np.cumsum(sums[:, :-1], axis=1)
    slot_of = bins.slot_of
    before = np.concatenate([np.zeros((3, 1)), running], axis=1)[:, bins.starts[:-1]]
    left = running - before[:, slot_of]
    right = total[:, None] - left
    ends = np.zeros(len(slot_of), dtype=bool)
    ends[bins.starts[1:] - 1] = True
    able = ~ends & np.isin(slot_of, slots)
    able &= (left[2] >= params.min_child_samples - 0.5) & (right[2] >= params.min_child_samples - 0.5)
    able &= (left[1] >= LEAST_HESSIAN) & (right[1] >= LEAST_HESSIAN)
    if not able.any():
        return None
    gain = np.where(able, score(left[0], left[1]) + score(right[0], right[1]) - score(total[0], total[1]), -np.inf)
    cell = int(np.argmax(gain))
    return (float(gain[cell]), int(slot_of[cell]), cell) if gain[cell] > 1e-12 else None


class Grower:
    """One tree, grown by passes over the blocks.

    ``sums_of`` maps nodes of the present tree to their sums over all blocks.
    """

    def __init__(self, bins: Bins, params: BoostParams, slots: np.ndarray, sums_of):
        self.bins, self.params, self.slots, self.sums_of = bins, params, slots, sums_of
        self.tree = Tree()
        self.sums: dict[int, np.ndarray] = {}
        self.split: dict[int, tuple[float, int, int] | None] = {}
        self.depth = {0: 0}

    def _learn(self, node: int, sums: np.ndarray) -> None:
        self.sums[node] = sums
        deep = self.params.max_depth > 0 and self.depth[node] >= self.params.max_depth
        self.split[node] = None if deep else best_split(sums, self.bins, self.slots, self.params)

    def _chosen(self) -> list[int]:
        """Nodes that a best-first growth splits, as far as splits are known."""
        ready, chosen = [], []

        def offer(node):
            if self.split.get(node):
                heapq.heappush(ready, (-self.split[node][0], node))

        offer(0)
        while ready and len(chosen) < self.params.num_leaves - 1:
            _, node = heapq.heappop(ready)
            chosen.append(node)
            if self.tree.left[node] >= 0:
                offer(self.tree.left[node])
                offer(self.tree.right[node])
        return chosen

    def _explored(self, nodes: list[int]) -> None:
        """Split the nodes and learn their children's sums: one pass for all."""
        smaller, larger = [], []
        for node in nodes:
            gain, slot, cell = self.split[node]
            left, right = self.tree.split(node, slot, cell, gain)
            self.depth[left] = self.depth[right] = self.depth[node] + 1
            below = self.sums[node][2, self.bins.starts[slot] : cell + 1].sum()
            small = left if 2 * below <= self.sums[node][2, -1] else right
            smaller.append(small)
            larger.append(left + right - small)
        found = _with_zero_bins(self.sums_of(self.tree, smaller), self.bins)
        for i, (node, small, large) in enumerate(zip(nodes, smaller, larger)):
            self._learn(small, found[:, i])
            self._learn(large, self.sums[node] - found[:, i])  # the sibling is the rest

    def grow(self) -> Tree:
        self._learn(0, _with_zero_bins(self.sums_of(self.tree, [0]), self.bins)[:, 0])
        # A node that is not chosen now is not chosen later: later knowledge only adds rivals.
        while new := [n for n in self._chosen() if self.tree.left[n] < 0]:
            self._explored(new)
        return self._finished(set(self._chosen()))

    def _finished(self, chosen: set[int]) -> Tree:
        """The chosen splits only, nodes numbered depth first."""
        out, stack = Tree(*([] for _ in range(7))), [(0, -1, False)]
        while stack:
            node, parent, is_right = stack.pop()
            number = len(out.slot)
            if parent >= 0:
                (out.right if is_right else out.left)[parent] = number
            g, h, n = self.sums[node][:, -1]
            inner = node in chosen
            out.slot.append(self.tree.slot[node] if inner else -1)
            out.cell.append(self.tree.cell[node] if inner else -1)
            out.gain.append(self.tree.gain[node] if inner else -1.0)
            out.left.append(-1)
            out.right.append(-1)
            out.rows.append(int(round(n)))
            out.value.append(self.params.learning_rate * float(leaf_weight(g, h + 1e-300, self.params)))
            if inner:
                stack.append((self.tree.right[node], number, True))
                stack.append((self.tree.left[node], number, False))
        return out


class InTask:
    """Sums and margins of blocks that a task holds."""

    def __init__(self, blocks: list[Block], bins: Bins, params: BoostParams, start: float, seed: int):
        self.blocks, self.bins, self.share, self.seed = blocks, bins, params.subsample, seed
        self.slot_of = bins.slot_of
        self.margins = [np.full(len(b.label), start) for b in blocks]
        self.number = 0
        self.tree, self.state = None, []

    def sums(self, tree: Tree, nodes: list[int]) -> np.ndarray:
        if tree is not self.tree:
            self.tree = tree
            self.state = [(b.drawn(self.seed, self.number, self.share), None) for b in self.blocks]
        total = 0.0
        for i, (block, margin) in enumerate(zip(self.blocks, self.margins)):
            drawn, place = self.state[i]
            place = _places(tree, block, self.bins, self.slot_of, place)  # a growing tree moves rows further down only
            self.state[i] = drawn, place
            total = total + _sums(block, margin, drawn, place, nodes, len(self.slot_of))
        return total

    def add(self, tree: Tree) -> None:
        value = np.array(tree.value)
        for block, margin in zip(self.blocks, self.margins):
            margin += value[_places(tree, block, self.bins, self.slot_of)]


class InJobs:
    """Sums and margins of blocks spread over the executors; one job a pass."""

    def __init__(self, blocks, bins: Bins, params: BoostParams, start: float, seed: int):
        self.blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
        self.bins, self.share, self.seed = bins, params.subsample, seed
        self.margins = blocks.map(lambda b: np.full(len(b.label), start))
        self.used: list = [self.blocks]
        self.number = self.added = 0

    def sums(self, tree: Tree, nodes: list[int]) -> np.ndarray:
        bins, share, seed, number = self.bins, self.share, self.seed, self.number

        def own(part):
            total, slot_of = None, bins.slot_of
            for block, margin in part:
                place = _places(tree, block, bins, slot_of)
                sums = _sums(block, margin, block.drawn(seed, number, share), place, nodes, len(slot_of))
                total = sums if total is None else total + sums
            return [] if total is None else [total]

        return self.blocks.zip(self.margins).mapPartitions(own).treeReduce(np.add)

    def add(self, tree: Tree) -> None:
        bins = self.bins

        def moved(pair):
            block, margin = pair
            return margin + np.array(tree.value)[_places(tree, block, bins, bins.slot_of)]

        self.margins = self.blocks.zip(self.margins).map(moved).persist(StorageLevel.MEMORY_AND_DISK)
        self.used.append(self.margins)
        self.added += 1
        if self.added % CHECKPOINT_TREES == 0:
            self.margins.checkpoint()
            self.margins.count()
        if len(self.used) > 3:
            self.used.pop(1).unpersist()

    def close(self) -> None:
        for rows in self.used:
            rows.unpersist()


def grow_trees(held: InTask | InJobs, bins: Bins, params: BoostParams, seed: int) -> list[Tree]:
    """All trees; one whose draw of slots allows no split is left out."""
    trees: list[Tree] = []
    draw = np.random.Generator(np.random.PCG64([seed, 1]))
    usable = np.flatnonzero(np.diff(bins.starts) > 1)
    take = max(1, int(round(len(usable) * params.colsample_bytree)))
    for number in range(params.n_estimators):
        slots = np.sort(draw.choice(usable, take, replace=False)) if take < len(usable) else usable
        held.number = number
        tree = Grower(bins, params, slots, held.sums).grow()
        if tree.slot[0] >= 0:
            trees.append(tree)
            held.add(tree)
    return trees


def train(rows: DataFrame, params: BoostParams, positive_weight: float, seed: int = SEED) -> GBTClassificationModel:
    """Fit on (features, label) rows.

    Rows that fit one block are boosted inside one task, as a job for every pass
    would cost more than the pass; the trees are the same. Of larger tables, equal
    rows are counted first, if that halves them at least.
    """
    spark = rows.sparkSession
    size = F.max(F.size(vector_to_array("features")))
    n, positives, width = rows.agg(F.count(F.lit(1)), F.sum("label"), size).first()
    if not n or not 0 < positives < n:
        raise ValueError("training rows hold one class only")
    bins = find_bins(rows, width)
    start = math.log(positive_weight * positives / (n - positives))
    if n < 2 * params.min_child_samples or bins.starts[-1] == width:
        return as_spark_model(spark, [], bins, start, width)
    if 24 * (int(bins.starts[-1]) + 1) * max(1, params.num_leaves // 2) > MAX_SUMS:
        raise ValueError("too many slots for one table of sums; fold rare levels or take fewer bins")
    parts = -(-n // BLOCK_ROWS)
    blocks = binned_blocks(rows, bins, parts)
    if parts > 1:
        equal = equal_rows(blocks)
        kinds = equal.count()
        if 2 * kinds <= n:
            parts = -(-kinds // BLOCK_ROWS)
            blocks = counted_blocks(equal, parts)
    blocks = blocks.rdd.map(lambda r: _unpacked(r, positive_weight))
    if parts == 1:

        def whole(part):
            held = [b for b in part]
            return grow_trees(InTask(held, bins, params, start, seed), bins, params, seed) if held else []

        trees = blocks.mapPartitions(whole).collect()
    else:
        sc = spark.sparkContext
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(new_shared_path(spark, "margins"))
        held = InJobs(blocks, bins, params, start, seed)
        trees = grow_trees(held, bins, params, seed)
        held.close()
    return as_spark_model(spark, trees, bins, start, width)


_FORMS: dict = {}


def _saved_form(spark: SparkSession):
    """How this version saves a booster, read off a model of one leaf: schemas and descriptions."""
    key = spark.sparkContext.applicationId
    if key not in _FORMS:
        two = spark.createDataFrame([(Vectors.dense([0.0]), 0.0), (Vectors.dense([0.0]), 1.0)], ["features", "label"])
        path = new_shared_path(spark, "booster-form")
        GBTClassifier(maxIter=1, maxDepth=1).fit(two).write().save(path)
        meta = spark.read.parquet(f"{path}/treesMetadata")
        head = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        _FORMS[key] = spark.read.parquet(f"{path}/data").schema, meta.schema, json.loads(meta.first()[1]), head
    return _FORMS[key]


def as_spark_model(spark: SparkSession, trees: list[Tree], bins: Bins, start: float, width: int) -> GBTClassificationModel:
    """The trees as a model of ``pyspark.ml``, through its saved form.

    That model's margin is half the log-odds, so values are halved; the log-odds
    all rows start from go into the first tree.
    """
    filled = new_shared_path(spark, "booster")
    data, meta, about, head = _saved_form(spark)
    trees = trees or [Tree()]
    # Values below cuts go left; an open slot's bins end at its cuts.
    flat = np.concatenate([np.append(c, np.inf) for c in bins.cuts]) if bins.cuts else np.empty(0)
    rows = []
    for number, tree in enumerate(trees):
        for i in range(len(tree.slot)):
            value = (tree.value[i] + (start if number == 0 else 0.0)) / 2
            inner = tree.slot[i] >= 0
            split = (tree.slot[i], [float(flat[tree.cell[i]])] if inner else [], -1)
            node = (i, value, 0.0, [float(tree.rows[i]), 0.0, 0.0], tree.rows[i], tree.gain[i], tree.left[i], tree.right[i], split)
            rows.append((number, node))
    spark.createDataFrame(rows, data).coalesce(1).write.parquet(f"{filled}/data")
    text = json.dumps({**about, "numFeatures": width})
    listed = pd.DataFrame({meta.names[0]: range(len(trees)), meta.names[1]: text, meta.names[2]: 1.0})
    spark.createDataFrame(listed, meta).coalesce(1).write.parquet(f"{filled}/treesMetadata")
    whole = {**head, "numFeatures": width, "numTrees": len(trees), "paramMap": {**head["paramMap"], "maxIter": len(trees)}}
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{filled}/metadata")
    return GBTClassificationModel.load(filled)
