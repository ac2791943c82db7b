"""Order statistics and running totals over a whole table, exactly.

A window without partition would sort the table in one task. Here the value
axis is cut into ranges first; each range is one window partition, and the
totals of the ranges before it (one row per range) are added. Approximate
quantiles choose the cut points, so ranges hold similar numbers of rows; the
cut points decide the layout only, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskframe.session import materialize

BUCKET = "_range"
INF = float("inf")


def number_or_missing(c: str) -> Column:
    """A numeric column as double; NaN counts as missing."""
    return F.nanvl(F.col(c).cast("double"), F.lit(None))


#: Rows that one range should hold.
RANGE_ROWS = 500_000


def default_ranges(df: DataFrame) -> int:
    """Ranges for the table's rows, at least one per shuffle partition."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(8, partitions, -(-df.count() // RANGE_ROWS))


def range_cuts(df: DataFrame, columns: Sequence[str], ranges: int | None = None) -> dict[str, list[float]]:
    """Cut points per numeric column: one aggregate whose result is one row."""
    ranges = ranges or default_ranges(df)
    shares = [i / ranges for i in range(1, ranges)]
    accuracy = max(10_000, 20 * ranges)
    row = df.agg(
        *[F.percentile_approx(F.col(c).cast("double"), shares, accuracy).alias(f"c{i}") for i, c in enumerate(columns)]
    ).first()
    return {c: sorted({v for v in (row[i] or []) if math.isfinite(v)}) for i, c in enumerate(columns)}


def with_ranges(df: DataFrame, cuts: Mapping[str, Sequence[float]], names: Mapping[str, str]) -> DataFrame:
    """Add the number of the range each column's value lies in."""
    columns = list(cuts)
    edges = [[-INF, *(cuts[c] or [0.0]), INF] for c in columns]
    return Bucketizer(
        inputCols=columns, outputCols=[names[c] for c in columns], splitsArray=edges, handleInvalid="keep"
    ).transform(df)


def long_values(
    df: DataFrame, columns: Sequence[str], cuts: Mapping[str, Sequence[float]], keep: Sequence[str] = ()
) -> DataFrame:
    """Non-missing values as rows: kept columns, column_name, value, range."""
    doubles = [f"_v{i}" for i in range(len(columns))]
    places = {v: f"_b{i}" for i, v in enumerate(doubles)}
    wide = df.select(*keep, *[number_or_missing(c).alias(v) for c, v in zip(columns, doubles)])
    wide = with_ranges(wide, {v: cuts[c] for c, v in zip(columns, doubles)}, places)
    cells = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(v).alias("value"),
            F.col(places[v]).cast("int").alias(BUCKET),
        )
        for c, v in zip(columns, doubles)
    ]
    return (
        wide.select(*keep, F.explode(F.array(*cells)).alias("cell"))
        .select(*keep, "cell.*")
        .where(F.col("value").isNotNull())
    )


def running_totals(
    levels: DataFrame,
    value: str,
    sums: Sequence[str],
    groups: Sequence[str] = (),
    descending: bool = False,
    next_value: str | None = None,
    stored: bool = False,
) -> DataFrame:
    """Add ``cum_<s>``: the total of ``s`` up to and including each value.

    ``levels`` holds one row per (groups, value) and its range number. With
    ``next_value`` the following value in the order is added under that name.
    The levels are read twice; Spark reuses their shuffle unless rows were
    unfolded before it, in which case ``stored`` writes them once.
    """
    if stored:
        levels = materialize(levels, "levels")
    direction = F.desc if descending else F.asc
    at = [*groups, BUCKET]
    inside = Window.partitionBy(*at).orderBy(direction(value))
    before_here = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(direction(BUCKET))
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)

    # One row per group and range.
    totals = levels.groupBy(*at).agg(
        *[F.sum(s).alias(f"_t_{s}") for s in sums],
        (F.max if descending else F.min)(value).alias("_first"),
    )
    offsets = totals.select(
        *at,
        *[F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *([F.lead("_first").over(across).alias("_next_first")] if next_value else []),
    )
    if not groups:
        offsets = F.broadcast(offsets)  # at most one row per range

    out = levels.select(
        "*",
        *[F.sum(s).over(before_here).alias(f"_c_{s}") for s in sums],
        *([F.lead(value).over(inside).alias("_next_here")] if next_value else []),
    ).join(offsets, at)
    return out.select(
        *levels.columns,
        *[(F.col(f"_c_{s}") + F.col(f"_o_{s}")).alias(f"cum_{s}") for s in sums],
        *([F.coalesce("_next_here", "_next_first").alias(next_value)] if next_value else []),
    )


def global_index(
    df: DataFrame, position: Column, order: Sequence[Column], name: str, ranges: int | None = None
) -> DataFrame:
    """0-based place of every row in a total order, without a one-task sort.

    ``position`` is a number that never decreases along ``order``; it only
    spreads the rows over ranges. ``df`` should be a materialized table.
    """
    placed = df.withColumn("_pos", position.cast("double"))
    cuts = range_cuts(placed, ["_pos"], ranges)
    placed = with_ranges(placed, cuts, {"_pos": BUCKET})
    totals = placed.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(BUCKET, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(BUCKET).orderBy(*order)
    return (
        placed.withColumn("_row", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), BUCKET)  # at most one row per range
        .select(*df.columns, (F.col("_row") + F.col("_before")).alias(name))
    )


# Quantile sketches are read at GRID points; a rank is then looked for within a
# few grid steps, and the sketch is repeated inside the bracket as long as that
# holds more rows than one task should sort.
GRID = 400
BRACKET_ROWS = 5_000_000
MARGINS = (1, 50, GRID)


@dataclass
class _Bracket:
    """Where ranks of one (set, column) are: between two values, both included."""

    set_name: str
    column: str
    ranks: list[int] | None
    low: float = -INF
    high: float = INF

    def inside(self, v: Column) -> Column:
        out = v.isNotNull()
        if self.low > -INF:
            out = out & (v >= F.lit(self.low))
        if self.high < INF:
            out = out & (v <= F.lit(self.high))
        return out

    def below(self, v: Column) -> Column:
        return v < F.lit(self.low) if self.low > -INF else F.lit(False)


def _grid(v: Column) -> Column:
    return F.percentile_approx(v, [i / GRID for i in range(1, GRID)], 10 * GRID)


def _sketch(df: DataFrame, sets: Mapping[str, Column], brackets: Sequence[_Bracket]) -> list[tuple]:
    """Per bracket: rows below, rows inside, grid of the inside; one pass, one row."""
    terms = []
    for b in brackets:
        v = F.when(sets[b.set_name], number_or_missing(b.column))
        inner = F.when(b.inside(v), v)
        terms += [F.count_if(b.below(v)), F.count(inner), _grid(inner)]
    row = df.agg(*[t.alias(f"t{i}") for i, t in enumerate(terms)]).first()
    return [(row[3 * i], row[3 * i + 1], row[3 * i + 2] or []) for i in range(len(brackets))]


def _narrowed(b: _Bracket, below: int, inside: int, grid: Sequence[float], margin: int) -> list[_Bracket]:
    """The bracket cut down around its ranks, ranks of one place together."""
    out: dict[tuple[float, float], list[int]] = {}
    for rank in sorted(set(b.ranks)):
        step = math.floor((rank - below) / inside * GRID)
        low, high = step - margin, step + 1 + margin
        at = (grid[low - 1] if low >= 1 else b.low, grid[high - 1] if high <= GRID - 1 else b.high)
        out.setdefault(at, []).append(rank)
    return [_Bracket(b.set_name, b.column, ranks, *at) for at, ranks in out.items()]


def _pick(
    df: DataFrame, sets: Mapping[str, Column], brackets: Sequence[_Bracket], grids: Mapping[str, Sequence[float]]
) -> list:
    """Values at the brackets' ranks; a rank outside its bracket gives no row.

    The brackets' ends are the cut points, and the sketch's grid where a bracket
    is wide, so that a range holds a small share of the values at any margin. Only values in a bracket keep their
    own level, all others of a range are one, so the shuffle carries little
    more than the brackets' insides.
    """
    columns = list(dict.fromkeys(b.column for b in brackets))
    flags = {s: f"_s{i}" for i, s in enumerate(sets)}
    flagged = df.select(
        *[inset.alias(flags[s]) for s, inset in sets.items()], *[F.col(c) for c in columns]
    )
    cuts, kept = {}, F.lit(False)
    for c in columns:
        spans = [(b.low, math.nextafter(b.high, INF)) for b in brackets if b.column == c]
        inner = {g for g in grids.get(c, ()) if math.isfinite(g)}
        cuts[c] = sorted({e for span in spans for e in span if math.isfinite(e)} | inner) or [0.0]
        edges = [-INF, *cuts[c], INF]
        whole = [i for i, at in enumerate(zip(edges, edges[1:])) if any(lo <= at[0] and at[1] <= hi for lo, hi in spans)]
        kept = kept | ((F.col("column_name") == c) & F.col(BUCKET).isin(whole))
    level = F.when(kept, F.col("value")).alias("level")
    levels = (
        long_values(flagged, columns, cuts, list(flags.values()))
        .groupBy("column_name", BUCKET, level)
        .agg(*[F.count_if(f).alias(f) for f in flags.values()])
    )
    totals = running_totals(levels, "level", list(flags.values()), ["column_name"], stored=True)
    per_set = [
        F.struct(F.lit(s).alias("set_name"), F.col(f).alias("n"), F.col(f"cum_{f}").alias("upto"))
        for s, f in flags.items()
    ]
    asked = df.sparkSession.createDataFrame(
        sorted({(b.set_name, b.column, rank) for b in brackets for rank in b.ranks}),
        "set_name string, column_name string, rank bigint",
    )
    hit = (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))
    return (
        totals.where(F.col("level").isNotNull())
        .select("column_name", "level", F.explode(F.array(*per_set)).alias("r"))
        .select("column_name", "level", "r.*")
        .join(F.broadcast(asked), ["set_name", "column_name"])  # one row per rank asked for
        .where(hit)
        .select("set_name", "column_name", "rank", "level")
        .collect()
    )


def values_at_ranks(
    df: DataFrame,
    columns: Sequence[str],
    ranks: Callable[[str, str, int], Sequence[int]],
    sets: Mapping[str, Column] | None = None,
    also: Sequence[Column] = (),
) -> tuple[dict[tuple[str, str], dict[int, float]], dict[tuple[str, str], int], list]:
    """Exact values at 0-based ranks, for several columns and row sets at once.

    ``ranks(set, column, n)`` names the ranks wanted among n non-missing values.
    Returns the values, the counts, and the results of the aggregates ``also``,
    which are computed in the first pass. Two passes over the table, and one
    more for every factor of several hundred beyond some billion rows.
    """
    sets = dict(sets or {"all": F.lit(True)})
    keys = [(name, c) for name in sets for c in columns]
    terms = [_grid(number_or_missing(c)) for c in columns]
    terms += [F.count_if(sets[name] & number_or_missing(c).isNotNull()) for name, c in keys]
    row = df.agg(*[t.alias(f"t{i}") for i, t in enumerate([*terms, *also])]).first()  # one row
    grids = {c: row[i] or [] for i, c in enumerate(columns)}
    counts = dict(zip(keys, row[len(columns) : len(terms)]))
    extra = list(row[len(terms) :])
    found: dict[tuple[str, str], dict[int, float]] = {key: {} for key in keys}

    # One sketch per column serves all sets: it only says where to look first.
    open_, sketches = [], []
    for (name, c), n in counts.items():
        if n:
            open_.append(_Bracket(name, c, sorted(set(ranks(name, c, n)))))
            sketches.append((0, n, grids[c]))
    for margin in MARGINS:
        # A small set strays further from the sketch of all rows; each bracket by its own count.
        widths = [min(GRID, margin + (0 if len(sets) == 1 else math.ceil(2 * GRID / math.sqrt(p[1])))) for p in sketches]
        brackets = [x for b, p, w in zip(open_, sketches, widths) for x in _narrowed(b, *p, w)]
        rows = max((p[1] * (2 * w + 1) // GRID for p, w in zip(sketches, widths)), default=0)
        brackets = _refined(df, sets, brackets, rows)
        for row in _pick(df, sets, brackets, grids) if brackets else []:
            found[row["set_name"], row["column_name"]][row["rank"]] = row["level"]
        missed = []
        for b, p in zip(open_, sketches):
            b.ranks = [r for r in b.ranks if r not in found[b.set_name, b.column]]
            if b.ranks:
                missed.append((b, p))
        if not missed:
            break
        open_, sketches = [b for b, _ in missed], [p for _, p in missed]
    return found, counts, extra


def _refined(df: DataFrame, sets: Mapping[str, Column], brackets: list[_Bracket], rows: int) -> list[_Bracket]:
    """Narrow brackets further while they may hold too many rows for one task.

    ``rows`` is the largest bracket's share of its sketch; from then on the rows
    inside each bracket are counted.
    """
    while brackets and rows > BRACKET_ROWS:
        per = _sketch(df, sets, brackets)
        inside = [all(p[0] <= r < p[0] + p[1] for r in b.ranks) for b, p in zip(brackets, per)]
        narrow = [
            x for b, p, ok in zip(brackets, per, inside) for x in (_narrowed(b, *p, MARGINS[0]) if ok else [b])
        ]
        largest = max((p[1] for p in per), default=0) * (2 * MARGINS[0] + 1) // GRID
        if not all(inside) or largest >= rows:
            return narrow
        brackets, rows = narrow, largest
    return brackets


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    shares: Sequence[float],
    sets: Mapping[str, Column] | None = None,
) -> dict[tuple[str, str], list[float | None]]:
    """Interpolated quantiles per (set, column), exact at any table size."""
    return quantiles_with(df, columns, shares, sets)[0]


def quantiles_with(
    df: DataFrame,
    columns: Sequence[str],
    shares: Sequence[float],
    sets: Mapping[str, Column] | None = None,
    also: Sequence[Column] = (),
) -> tuple[dict[tuple[str, str], list[float | None]], list]:
    """The quantiles, and the results of further aggregates of the first pass."""

    def ranks(_s: str, _c: str, n: int) -> list[int]:
        places = [q * (n - 1) for q in shares]
        return [r for p in places for r in (math.floor(p), math.ceil(p))]

    found, counts, extra = values_at_ranks(df, columns, ranks, sets, also)
    out: dict[tuple[str, str], list[float | None]] = {}
    for key, values in found.items():
        n = counts[key]
        row: list[float | None] = []
        for q in shares:
            if n == 0:
                row.append(None)
                continue
            p = q * (n - 1)
            low, high = values[math.floor(p)], values[math.ceil(p)]
            row.append(low + (high - low) * (p - math.floor(p)))
        out[key] = row
    return out, extra
