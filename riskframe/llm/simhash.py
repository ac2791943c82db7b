"""SimHash near-duplicates: BK-trees over shards of fingerprints.

Distinct fingerprints are dealt into shards so that any two within the radius
meet: 64 bits are cut into radius + 1 blocks, and two such fingerprints agree in
at least one. Each shard is a BK-tree: children are keyed by their integer
Hamming distance to the parent, and a search follows only edges within the
radius of the query's own distance. Trees go to the queries of their own shard
by key; to broadcast all trees would send every fingerprint to every task.

A shard with too many fingerprints is dealt again by its other bits, cut into
radius + 1 blocks once more; every time fewer bits are free, so shards have a
bound whatever the data. A tree reports one link per member to the first member
it hangs together with, never all pairs.

Defined cases: a missing or empty text has the fingerprint zero; fewer words
than a shingle are one shingle; repeated rows and equal texts share a
fingerprint and so a component; rows without id get their component's id, which
is missing if no row of it has one; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from riskframe.llm.common import ascii_words, map_batches, quoted, whole_bytes, with_number
from riskframe.operators.keyed import attach_by_key
from riskframe.session import materialize

SHINGLE = 3
RADIUS = 2
BITS = 64
SHARD_FINGERPRINTS = 2_048
#: Shingles whose bits are unpacked at once.
UNPACKED = 65_536


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the shingles' hashes, repeats included."""
    words = ascii_words(data)
    if not words:
        return 0
    runs = zip(*[words[i:] for i in range(shingle)]) if len(words) >= shingle else [words]
    hashes = np.array([xxh64_intdigest(b" ".join(run), 42) for run in runs], dtype="<u8")
    votes = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), UNPACKED):
        octets = hashes[at : at + UNPACKED].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def with_fingerprints(docs: DataFrame, keep, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The kept columns and ``code``, the fingerprint as a signed 64-bit number."""

    def make():
        def step(texts):
            return None, [pa.array([fingerprint(t, shingle) for t in texts.to_pylist()], pa.int64())]

        return step

    return map_batches(docs, keep, [whole_bytes(text)], "code bigint", make)


class BKTree:
    """Distinct codes; children keyed by integer Hamming distance to the parent."""

    def __init__(self) -> None:
        self.codes: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, code: int, radius: int) -> list[int]:
        """Places of the codes within the radius."""
        found, open_ = [], [0] if self.codes else []
        codes, children = self.codes, self.children
        while open_:
            node = open_.pop()
            distance = (codes[node] ^ code).bit_count()
            if distance <= radius:
                found.append(node)
            edges = children[node]
            for edge in range(max(0, distance - radius), distance + radius + 1):
                if edge in edges:
                    open_.append(edges[edge])
        return found

    def add(self, code: int) -> None:
        node, new = 0, len(self.codes)
        self.codes.append(code)
        self.children.append({})
        while node != new:
            distance = (self.codes[node] ^ code).bit_count()
            node = self.children[node].setdefault(distance, new)


def tree_links(codes: list[int], radius: int) -> list[tuple[int, int]]:
    """(code, first code it hangs together with) of every code that has a partner."""
    whole = (1 << BITS) - 1
    tree, parent = BKTree(), list(range(len(codes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, code in enumerate(codes):
        for j in tree.near(code & whole, radius):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
        tree.add(code & whole)
    return [(code, codes[r]) for i, code in enumerate(codes) if (r := root(i)) != i]


def _cut(bits: list[int], parts: int) -> list[list[int]]:
    ends = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(ends, ends[1:])]


def _mask(bits: list[int]) -> int:
    mask = sum(1 << b for b in bits)
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def near_links(codes: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_FINGERPRINTS) -> DataFrame:
    """(a, b) links between distinct codes whose components are those of all pairs within the radius."""
    spark = codes.sparkSession

    def links():
        def step(shards):
            index, a, b = [], [], []
            for i, members in enumerate(shards.to_pylist()):
                for x, y in tree_links(members, radius):
                    index.append(i)
                    a.append(x)
                    b.append(y)
            return pa.array(index, pa.int64()), [pa.array(a, pa.int64()), pa.array(b, pa.int64())]

        return step

    found, entries = None, None
    fixed: dict[int, list[int]] = {0: []}  # bits that the shards of each way share
    while True:
        # Deal by each block of the bits that are still free.
        ways, table = {}, []
        for way, bits in fixed.items():
            free = [b for b in range(BITS) if b not in bits]
            for block in _cut(free, min(radius + 1, len(free))):
                table.append((way, len(ways), _mask(bits + block)))
                ways[len(ways)] = bits + block
        fixed = ways
        if entries is None:  # all codes go every first way
            masks = F.array(*[F.struct(F.lit(to).alias("next"), F.lit(mask).alias("mask")) for _, to, mask in table])
            dealt = codes.select("code", F.explode(masks).alias("step")).select("code", "step.*")
        else:
            steps = spark.createDataFrame(table, "way int, next int, mask bigint")
            dealt = entries.join(F.broadcast(steps), "way")  # (radius + 1) ** level rows
        part = F.col("code").bitwiseAND(F.col("mask")).alias("part")
        entries = materialize(dealt.select(F.col("next").alias("way"), part, "code"), "shards")
        counts = entries.groupBy("way", "part").agg(F.count(F.lit(1)).alias("n"))
        large = materialize(counts.where(F.col("n") > shard_size).select("way", "part"), "large-shards")
        shards = (
            entries.join(large, ["way", "part"], "left_anti")
            .groupBy("way", "part")
            .agg(F.array_sort(F.collect_list("code")).alias("codes"))  # at most shard_size
            .where(F.size("codes") > 1)
        )
        own = materialize(map_batches(shards, [], [F.col("codes")], "a bigint, b bigint", links), "links")
        found = own if found is None else found.unionByName(own)
        if large.isEmpty():
            return found.distinct()
        entries = entries.join(large, ["way", "part"], "left_semi").select("way", "code")


def components(links: DataFrame) -> DataFrame:
    """(code, label): the smallest code that links lead to, for every linked code.

    Rounds of smallest labels over links, each followed by a jump to the label's
    own label; joins and minima only, each round's table written.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.where("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("code")).agg(F.least("code", F.min("b")).alias("label")), "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("code", "b"), "b")
            .groupBy(F.col("a").alias("code"))
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "code", "left").select(
            "code", "label", F.least("label", "near").alias("lower")
        )
        jump = labels.select(F.col("code").alias("lower"), F.col("label").alias("far"))
        moved = materialize(
            lower.join(jump, "lower", "left").select("code", "label", F.least("lower", "far").alias("lower")), "labels"
        )
        changed = moved.where(F.col("lower") != F.col("label")).isEmpty()
        labels = moved.select("code", F.col("lower").alias("label"))
        if changed:
            return labels


def linked_codes(rows: DataFrame, radius: int = RADIUS, first: str = "doc_id") -> DataFrame:
    """(code, n, component_id) per distinct code of a written table; a component is named by its smallest ``first``."""
    nodes = materialize(rows.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first")), "codes")
    labels = components(near_links(nodes.select("code"), radius))
    labelled = nodes.join(labels, "code", "left").withColumn("label", F.coalesce("label", "code"))
    firsts = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    return materialize(labelled.join(firsts, "label").select("code", "n", "component_id"), "components")


def as_hex(code: Column) -> Column:
    return F.lower(F.lpad(F.hex(code), 16, "0"))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    named = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    rows = materialize(with_fingerprints(named, ["doc_id"], "text", shingle), "fingerprints")
    linked = linked_codes(rows, radius)
    return attach_by_key(rows, linked, "code").select("doc_id", as_hex(F.col("code")).alias("fingerprint"), "component_id")


def one_of_each(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """Of every component the row of the smallest id (of equal ids one row), columns unchanged.

    A row without id stays only if its component has no row with one.
    """
    columns = docs.columns
    kept = [f"c{i}" for i in range(len(columns))]
    tagged = with_number(docs.toDF(*kept), "number")
    place = columns.index(doc_id)
    tagged = with_fingerprints(tagged, [*kept, "number"], kept[columns.index(text)], shingle)
    tagged = materialize(tagged, "tagged")
    # Missing ids come last.
    key = F.struct(F.col(kept[place]).isNull().alias("none"), F.col(kept[place]).alias("id"), F.col("number"))
    first = linked_codes(tagged.select("code", key.alias("key")), radius, "key")
    stay = first.select(F.col("component_id.number").alias("number")).distinct()
    return tagged.join(stay, "number", "left_semi").select(*kept).toDF(*columns)
