"""Global running totals, ranks and exact quantiles without a one-task sort.

A plain ``Window.orderBy`` moves every row to one task, and the built-in exact
``percentile`` keeps every distinct value in one buffer. Here the value range
is cut at approximate quantiles, so each piece holds about the same number of
rows whatever the distribution; work inside a piece is independent and only
the per-piece totals (a bounded number of rows) are cumulated globally.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorage.functions.columns import tie_order

#: Rows that are ordered as one page.
PAGE = 1_000
#: Rows that are ordered in ``MERGERS`` pages and then in one.
LARGE_PAGE = 100_000
MERGERS = 64
#: Size of the sketch that bounds the n-th score: its ranks are off by about one row in TOP_SKETCH / 4.
TOP_SKETCH = 4_096
#: The top shares at which that sketch is read, each smaller than the one before by an eighth of a power of two.
TOP_SHARES = [2 ** (-j / 8) for j in range(1, 8 * 10)]


def piece_bits(df: DataFrame) -> int:
    """log2 of the number of pieces: four per shuffle partition, 64 to 4096."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(math.ceil(math.log2(4 * partitions)), 6), 12)


def sketch(df: DataFrame, value: Column, k: int) -> DataFrame:
    """One row (n, sketch): a quantile sketch of the numbers in ``value``, merged in two levels.

    The partitions' sketches meet in ``MERGERS`` groups first, so no task merges more
    than its share of them. Missing values and NaN take no part.
    """
    group = (F.spark_partition_id() % MERGERS).alias("_group")
    parts = df.groupBy(group).agg(F.kll_sketch_agg_double(value.cast("double"), k).alias("_sketch"))
    whole = parts.agg(F.kll_merge_agg_double("_sketch", k).alias("sketch"))
    return whole.select(F.coalesce(F.kll_sketch_get_n_double("sketch"), F.lit(0)).alias("n"), "sketch")


def sketched_quantiles(found: DataFrame, shares: Sequence[float]) -> Column:
    """The approximate quantiles at literal ``shares`` from a row of ``sketch``, null where it is empty."""
    probs = F.expr(f"array({', '.join(f'{p!r}D' for p in shares)})")
    return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", probs))


def split_points(df: DataFrame, value: Column, bits: int) -> Column:
    """Approximate quantiles as a scalar subquery: a sorted array below 2**bits long.

    Put it in a column of its own before searching it; lambdas take no subquery.
    """
    pieces = 2**bits
    found = sketch(df, value, 8 * pieces)
    points = F.array_distinct(sketched_quantiles(found, [i / pieces for i in range(1, pieces)]))
    return found.select(points.alias("points")).scalar()


def count_below(points: Column, value: Column, bits: int, inclusive: bool = False) -> Column:
    """How many sorted points lie below the value, by binary search."""
    steps = F.expr(f"array({', '.join(str(2**b) for b in reversed(range(bits)))})")

    def narrow(found: Column, step: Column) -> Column:
        point = F.get(points, found + step - 1)
        passed = (point <= value) if inclusive else (point < value)
        return F.when(passed, found + step).otherwise(found)

    # Never null, so no null check on it is pushed down to the detail rows.
    return F.coalesce(F.aggregate(steps, F.lit(0), narrow), F.lit(0))


def as_columns(df: DataFrame, keep: Sequence[str], **cells: str) -> DataFrame:
    """Rename computed columns through a one-row generator.

    The optimizer then treats them as given and neither copies the search
    behind them into filters nor infers it across the join that follows.
    """
    row = F.struct(*[F.col(source).alias(name) for name, source in cells.items()])
    return df.select(*keep, F.inline(F.array(row)))


def running_before(
    counts: DataFrame,
    value: str,
    totals: Sequence[str],
    group: Sequence[str] = (),
    descending: bool = False,
    weight: Column | None = None,
    pieces: bool = False,
) -> DataFrame:
    """Add ``<total>_before`` (sum over strictly earlier values) and ``<total>_all``.

    ``counts`` has one row per (group, value), already aggregated, and no null
    group or value. ``weight`` is positive on every row (the first total unless
    given); reading it lets the split-point subquery reuse the same shuffle. With
    ``pieces`` the number of the value's piece stays as ``_piece``.
    """
    group = list(group)
    shown = ["_piece"] if pieces else []
    bits = piece_bits(counts)
    anchor = F.when((F.col(totals[0]) if weight is None else weight) > 0, F.col(value))
    cut = counts.withColumn("_points", split_points(counts, anchor, bits))
    cut = cut.withColumn("_found", count_below(F.col("_points"), F.col(value), bits)).drop("_points")
    cut = as_columns(cut, counts.columns, _piece="_found")

    def direction(c: str) -> Column:
        return F.desc(c) if descending else F.asc(c)

    sizes = cut.groupBy(*group, "_piece").agg(*[F.sum(t).alias(t) for t in totals])
    # At most 2**bits rows per group reach this window.
    earlier = Window.partitionBy(*group).orderBy(direction("_piece")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = sizes.select(
        *group,
        "_piece",
        *[F.coalesce(F.sum(t).over(earlier), F.lit(0)).alias(f"_{t}_offset") for t in totals],
        *[F.sum(t).over(whole).alias(f"{t}_all") for t in totals],
    )
    inside = (
        Window.partitionBy(*group, "_piece")
        .orderBy(direction(value))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = cut.select(
        "*", *[F.coalesce(F.sum(t).over(inside), F.lit(0)).alias(f"_{t}_local") for t in totals]
    )
    return local.join(offsets, [*group, "_piece"]).select(
        *counts.columns,
        *shown,
        *[(F.col(f"_{t}_offset") + F.col(f"_{t}_local")).alias(f"{t}_before") for t in totals],
        *[F.col(f"{t}_all") for t in totals],
    )


def ranked(df: DataFrame, score: str, key: str, rank: str = "rank") -> DataFrame:
    """Exact 1..N rank by score descending, nulls last, ties by (tie_order, key).

    A score held by many rows is itself a split point. Its rows are cut by the
    leading bits of the tie order, as finely as the score range is, instead of
    landing in one task.
    """
    bits = piece_bits(df)
    s = F.col(score)
    points = F.col("_points")
    piece = F.when(s.isNull(), -1).otherwise(count_below(points, s, bits))
    placed = df.withColumn("_points", split_points(df, s, bits)).withColumns(
        {"_found": piece, "_tie": tie_order(F.col(key))}
    )
    at_point = s.isNull() | F.coalesce(F.get(points, F.col("_found")) == s, F.lit(False))
    placed = placed.withColumn("_at", at_point).drop("_points")
    lead = F.shiftright("_tie", 32 - bits).cast("int")
    placed = placed.withColumn("_lead", F.when(F.col("_at"), lead).otherwise(-1))
    placed = as_columns(placed, [*df.columns, "_tie"], _piece="_found", _hot="_at", _slice="_lead")
    cell = ["_piece", "_hot", "_slice"]
    sizes = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    # One task cumulates the pieces, at most 1 + 2**bits; the slices of a piece are cumulated in its own.
    above = Window.orderBy(F.desc("_piece")).rowsBetween(Window.unboundedPreceding, -1)
    pieces = sizes.groupBy("_piece").agg(F.sum("_n").alias("_n"))
    pieces = pieces.select("_piece", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above"))
    order = Window.partitionBy("_piece").orderBy(F.desc("_hot"), F.asc("_slice"))
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).join(pieces, "_piece")
    offsets = offsets.select(*cell, (F.col("_above") + F.col("_before")).alias("_offset"))
    local = Window.partitionBy(*cell).orderBy(F.desc_nulls_last(score), "_tie", key)
    return (
        placed.withColumn("_local", F.row_number().over(local))
        .join(offsets, cell)
        .select(*df.columns, (F.col("_offset") + F.col("_local")).alias(rank))
    )


def at_least(df: DataFrame, n: int, score: str) -> Column:
    """A score that at least n rows reach, close to the n-th one, as a scalar subquery.

    The value comes from a sketch and counts only if an exact count confirms it;
    otherwise, as with fewer than n scored rows, it is minus infinity.
    """
    found = sketch(df, F.col(score), TOP_SKETCH)
    share = F.least(F.lit(float(n)) / F.greatest("n", F.lit(1)) + 8.0 / TOP_SKETCH, F.lit(1.0))
    place = F.floor(-8 * F.log2(share)).cast("int") - 1
    values = sketched_quantiles(found, [1 - s for s in TOP_SHARES])
    guess = found.select(F.when(place >= 0, F.get(values, place)).alias("low")).scalar()
    reached = df.select(score).where(F.col(score) >= guess).agg(F.count(F.lit(1)).alias("_reached"))
    low = F.when(F.col("_reached") >= n, guess).otherwise(F.lit(float("-inf")))
    return reached.select(F.coalesce(low, F.lit(float("-inf"))).alias("low")).scalar()


def pruned(df: DataFrame, n: int, score: str) -> DataFrame:
    """The rows that can be among the n highest scores: a filter on the scan, before anything is shuffled.

    Rows without a score stay only where the others may not make up n.
    """
    low = at_least(df, n, score)
    return df.where((F.col(score) >= low) | (F.col(score).isNull() & (low == float("-inf"))))


def top_n(df: DataFrame, n: int, score: str, key: str) -> DataFrame:
    """The n highest scores, ties by (tie_order, key); rows without a score come last.

    Up to ``PAGE`` rows are one ordered page. Beyond that, rows below a sketched bound
    of the n-th score leave first. Up to ``LARGE_PAGE`` rows are then ordered in pages of
    n rows each and these in one; for more, counts per distinct score give the exact
    n-th score, and only rows at or above it are ranked.
    """
    order = [F.desc_nulls_last(score), tie_order(F.col(key)), F.col(key)]
    if n <= PAGE:
        return df.orderBy(*order).limit(n)
    near = pruned(df, n, score)
    if n <= LARGE_PAGE:
        pages = Window.partitionBy("_page").orderBy(*order)
        paged = near.withColumn("_page", F.spark_partition_id() % MERGERS)
        kept = paged.withColumn("_place", F.row_number().over(pages)).where(F.col("_place") <= n)
        return kept.select(*df.columns).orderBy(*order).limit(n)
    counts = near.where(F.col(score).isNotNull()).groupBy(score).agg(F.count(F.lit(1)).alias("_n"))
    reached = running_before(counts, score, ["_n"], descending=True).where(F.col("_n_before") < n)
    cut = reached.agg(F.struct(F.min(score).alias("low"), F.max("_n_all").alias("all")).alias("cut")).scalar()
    enough = F.coalesce(F.col("_cut.all"), F.lit(0)) >= n
    above = near.withColumn("_cut", cut).where(F.coalesce(F.col(score) >= F.col("_cut.low"), ~enough)).drop("_cut")
    return ranked(above, score, key, "_rank").where(F.col("_rank") <= n).drop("_rank")


def at_places(run: DataFrame, before: str, wanted: DataFrame, place: str, bits: int) -> DataFrame:
    """Each row of ``wanted`` beside the row of ``run`` that covers its place, null beyond the last.

    ``run`` comes from ``running_before`` with its pieces: a row covers the places from its
    ``before`` to the next one's. A place finds its piece among the piece starts, an array of
    at most 2**bits numbers; inside a piece both tables meet in one ordered sweep, so there
    is no pairing of places with rows.
    """
    names = run.columns
    starts = run.groupBy("_piece").agg(F.min(before).alias("_start"))
    starts = starts.agg(F.sort_array(F.collect_list(F.struct("_start", "_piece"))).alias("s")).scalar()
    asked = wanted.withColumn("_starts", starts)
    found = count_below(F.col("_starts._start"), F.col(place), bits + 1, inclusive=True)
    asked = asked.withColumn("_found", F.get(F.col("_starts._piece"), found - 1)).drop("_starts")
    asked = as_columns(asked, wanted.columns, _piece="_found")
    rows = run.select("_piece", F.col(before).alias("_at"), F.lit(0).alias("_kind"), F.struct(*names).alias("_row"))
    marks = asked.select("_piece", F.col(place).alias("_at"), F.lit(1).alias("_kind"), F.struct(*wanted.columns).alias("_mark"))
    sweep = Window.partitionBy("_piece").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(marks, allowMissingColumns=True)
    met = both.withColumn("_met", F.last("_row", ignorenulls=True).over(sweep)).where("_kind = 1")
    kept = [n for n in names if n not in wanted.columns and n != "_piece"]
    return met.select("_mark.*", *[F.col(f"_met.{n}").alias(n) for n in kept])


def exact_quantiles(
    df: DataFrame, value: Column, probs: Sequence[float], group: Sequence[str] = (), name: str = "q"
) -> DataFrame:
    """One row per group with ``name``: array of linearly interpolated quantiles.

    Nulls in ``value`` are skipped and group columns must not be null.
    """
    group = list(group)
    counts = (
        df.select(*group, value.cast("double").alias("_v"))
        .where(F.col("_v").isNotNull())
        .groupBy(*group, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    run = running_before(counts, "_v", ["_n"], group)

    # The place p * (n - 1) is kept as a whole and a rest, so no float error
    # can move an edge off the value it falls on. A probability that is no short
    # ratio is taken as its decimal digits, and multiplied as a decimal.
    picks, parts = [], []
    for i, p in enumerate(probs):
        ratio = Fraction(p).limit_denominator(10_000)
        rows = "(_n_all - 1)"
        if float(ratio) != p:
            ratio, rows = Fraction(repr(float(p))), "cast(_n_all - 1 as decimal(18, 0))"
        exact = ratio.denominator > 10_000
        over, under = (f"cast({x} as decimal(19, 0))" if exact else f"{x}L" for x in (ratio.numerator, ratio.denominator))
        steps = f"{over} * {rows}"
        whole, rest = f"({steps} div {under})", f"({steps} % {under})"
        for side, place in (("lo", whole), ("hi", f"({whole} + sign({rest}))")):
            covers = f"_n_before <= {place} and {place} < _n_before + _n"
            picks.append(F.expr(f"max(case when {covers} then _v end) as _{side}{i}"))
        parts.append(f"_lo{i} + (_hi{i} - _lo{i}) * (cast({rest} as double) / {ratio.denominator}D)")
    found = run.groupBy(*group).agg(F.max("_n_all").alias("_n_all"), *picks)
    return found.select(*group, F.expr(f"array({', '.join(parts)})").alias(name))
