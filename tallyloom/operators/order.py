"""Row order as data: prefixes, ranks and running totals without one big task.

Spark rows have no position. Every operator here takes explicit order columns
that must be unique (within their group) and not null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.digests import digest_bucket, digest_share
from ..session import settle

# A group of at most this many order keys may be ranked by one task.
EXACT_ROWS = 200_000
# Order keys sampled per group and round to narrow the search for a cutoff.
SAMPLE_ROWS = 10_000
# Keys sampled over all groups together, as they go to the driver.
MOST_SAMPLED = 1_000_000
# A top-k of at most this many narrow rows is left to Spark's own merge.
SMALL_LIMIT = 1_000


def _typed(df: DataFrame, name: str, value: Any) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast(df.schema[name].dataType)


def up_to(df: DataFrame, order: Sequence[str], values: Sequence[Any]) -> Column:
    """Rows at or before the given order values; plain comparisons push down."""
    *outer, last = order
    *heads, tail = values
    kept = F.col(last) <= _typed(df, last, tail)
    for name, value in reversed(list(zip(outer, heads))):
        bound = _typed(df, name, value)
        kept = (F.col(name) < bound) | ((F.col(name) == bound) & kept)
    return kept


def _table(df: DataFrame, group: str, order: Sequence[str], bounds: Sequence[str], rows: list[tuple]) -> DataFrame:
    """A broadcast table: one row per group, order values per named bound, a number."""
    columns = [StructField(group, df.schema[group].dataType)]
    for bound in bounds:
        columns += [StructField(f"__{bound}_{name}", df.schema[name].dataType) for name in order]
    columns.append(StructField("__number", DoubleType()))
    unset = [None] * len(order)
    flat = [(g, *(v for values in found for v in (values or unset)), float(n)) for g, *found, n in rows]
    return F.broadcast(df.sparkSession.createDataFrame(flat, StructType(columns)))


def _reached(df: DataFrame, order: Sequence[str], bound: str) -> Column:
    """The row is at or before the bound of its group; null if the bound is unset."""
    return up_to(df, order, [F.col(f"__{bound}_{name}") for name in order])


def find_cutoffs(
    df: DataFrame,
    group: str,
    order: Sequence[str],
    wanted: Mapping[Any, int],
    sizes: Mapping[Any, int],
    exact_rows: int = EXACT_ROWS,
    sample_rows: int = SAMPLE_ROWS,
) -> dict[Any, tuple]:
    """Order values of row number ``wanted[g]`` (from 1) of every group ``g``.

    Nothing is sorted as a whole. A sample of order keys brackets the row
    looked for, exact counts confirm on which side of the brackets it lies,
    and the search goes on inside until a group is small enough to be ranked.
    Only order columns are read; the driver sees samples and counts. The
    groups must be few, such as the datasets of a mix.
    """
    keys = df.select(group, *order)
    # group -> lower bound (excluded), upper bound, rows at or before the lower bound, rows inside
    spans = {g: (None, None, 0, sizes[g]) for g in wanted}

    def inside(bounds: Sequence[str], rows: list[tuple]) -> DataFrame:
        near = keys.join(_table(df, group, order, ["low", "high", *bounds], rows), group)
        above = F.coalesce(~_reached(df, order, "low"), F.lit(True))
        below = F.coalesce(_reached(df, order, "high"), F.lit(True))
        return near.filter(above & below)

    while wide := [g for g, (_, _, _, rows) in spans.items() if rows > exact_rows]:
        drawn: dict[Any, list[tuple]] = {g: [] for g in wide}
        per_group = min(sample_rows, max(MOST_SAMPLED // len(wide), 100))
        rates = [(g, *spans[g][:2], min(1.0, per_group / spans[g][3])) for g in wide]
        sample = inside([], rates).filter(F.rand(7) < F.col("__number")).select(group, *order)
        for row in sample.orderBy(group, *order).collect():
            drawn[row[0]].append(tuple(row[1:]))
        brackets = {}
        for g in wide:
            share = (wanted[g] - spans[g][2]) / spans[g][3]
            spread = 3 * (len(drawn[g]) * share * (1 - share)) ** 0.5 + 2
            places = [int(share * len(drawn[g]) + shift) for shift in (-spread, spread)]
            brackets[g] = [drawn[g][at] if 0 <= at < len(drawn[g]) else None for at in places]
        checks = inside(["left", "right"], [(g, *spans[g][:2], *brackets[g], 0) for g in wide])
        counts = checks.groupBy(group).agg(
            F.count_if(_reached(df, order, "left")), F.count_if(_reached(df, order, "right"))
        )
        for g, left, right in counts.collect():
            low, high, skipped, rows = spans[g]
            edges = [(low, skipped)]
            edges += [(b, skipped + n) for b, n in zip(brackets[g], (left, right)) if b is not None]
            edges.append((high, skipped + rows))
            for (start, before), (end, until) in zip(edges, edges[1:]):
                if before < wanted[g] <= until:
                    if until - before == rows:
                        raise ValueError(f"order columns {list(order)} do not tell the rows of {g!r} apart")
                    spans[g] = (start, end, before, until - before)
                    break

    ranked = Window.partitionBy(group).orderBy(*order)
    targets = [(g, low, high, wanted[g] - skipped) for g, (low, high, skipped, _) in spans.items()]
    hits = (
        inside([], targets)
        .withColumn("__rank", F.row_number().over(ranked))
        .withColumn("__tied", F.lead(F.struct(*order)).over(ranked) == F.struct(*order))
        .filter(F.col("__rank") == F.col("__number"))
        .select(group, "__tied", *order)
    )
    found = {}
    for g, tied, *values in hits.collect():
        if tied:
            raise ValueError(f"order columns {list(order)} are not unique in {g!r}")
        found[g] = tuple(values)
    return found


def group_sizes(df: DataFrame, group: str, order: Sequence[str]) -> dict[Any, int]:
    """Rows per group; the groups must be few, such as the datasets of a mix."""
    missing = F.count_if(reduce(or_, [F.col(name).isNull() for name in order]))
    sizes = {}
    for value, rows, nulls in df.groupBy(group).agg(F.count(F.lit(1)), missing).collect():
        if nulls:
            raise ValueError(f"order columns {list(order)} hold nulls in {value!r}")
        sizes[value] = rows
    return sizes


def prefix_cutoffs(
    df: DataFrame,
    group: str,
    order: Sequence[str],
    fractions: Mapping[Any, float],
    exact_rows: int = EXACT_ROWS,
    sample_rows: int = SAMPLE_ROWS,
    sizes: Mapping[Any, int] | None = None,
) -> dict[Any, tuple | None]:
    """Where the first ``int(fraction * rows)`` rows of every group end.

    None stands for all rows. Groups that keep no row are left out. ``sizes``
    may hold the rows per group if they are known; keys are then known to be there.
    """
    sizes = group_sizes(df, group, order) if sizes is None else sizes
    wanted = {g: int(fractions[g] * rows) for g, rows in sizes.items() if g in fractions}
    part = {g: k for g, k in wanted.items() if 0 < k < sizes[g]}
    cutoffs = find_cutoffs(df, group, order, part, sizes, exact_rows, sample_rows) if part else {}
    return {g: cutoffs.get(g) for g, k in wanted.items() if k}


def keep_prefixes(
    df: DataFrame,
    group: str,
    order: Sequence[str],
    fractions: Mapping[Any, float],
    exact_rows: int = EXACT_ROWS,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """First ``int(fraction * rows)`` rows of every group, in order.

    The cutoffs, one row per group named in ``fractions``, are broadcast; wide
    rows are neither sorted nor shuffled. Groups without a fraction are left out.
    """
    cutoffs = prefix_cutoffs(df, group, order, fractions, exact_rows, sample_rows)
    ends = _table(df, group, order, ["end"], [(g, end, end is None) for g, end in cutoffs.items()])
    kept = (F.col("__number") == 1) | _reached(df, order, "end")
    return df.join(ends, group).filter(kept).drop("__number", *[f"__end_{name}" for name in order])


def _checked_size(df: DataFrame, order: Sequence[str]) -> int:
    """Number of rows; a null in an order column raises."""
    return group_sizes(df.withColumn("__all", F.lit(0)), "__all", order).get(0, 0)


def _first(df: DataFrame, order: Sequence[str], k: int, rows: int) -> DataFrame:
    if rows <= k:
        return df
    if k <= 0:
        return df.filter(F.lit(False))
    if k <= SMALL_LIMIT:
        top = df.select(*order).orderBy(*order).limit(k + 1).collect()
        if top[k - 1] == top[k]:
            raise ValueError(f"order columns {list(order)} do not tell rows {k} and {k + 1} apart")
        cutoff = tuple(top[k - 1])
    else:
        marked = df.withColumn("__all", F.lit(0))
        cutoff = find_cutoffs(marked, "__all", order, {0: k}, {0: rows})[0]
    return df.filter(up_to(df, order, cutoff))


def first_rows(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """The first ``min(k, rows)`` rows, for any ``k``.

    Only order columns take part in the search. A null in one of them raises,
    and so does a tie between the last row kept and the first one left out.
    """
    return _first(df, order, k, _checked_size(df, order))


def first_by_digest(df: DataFrame, digest: Column, keys: Sequence[str], k: int) -> DataFrame:
    """``k`` rows drawn without replacement: the first ones in digest order.

    Digests are uniform, so all but a few more than ``k`` rows are ruled out
    by their leading digits before anything is merged. Should that leave too
    few rows, the search runs over all of them. Nulls and ties in the keys
    raise as in ``first_rows``. Adds the column ``digest``.
    """
    marked = df.withColumn("digest", digest)
    order = ["digest", *keys]
    total = _checked_size(df, keys)
    enough = k + 10 * k**0.5 + 100
    if 0 < k <= SMALL_LIMIT and total > EXACT_ROWS > enough:
        near = marked.filter(digest_share("digest") <= enough / total)
        found = near.count()
        if found > k:
            return _first(near, order, k, found)
    return _first(marked, order, k, total)


def with_digest_rank(df: DataFrame, digest: str, keys: Sequence[str], target: str) -> DataFrame:
    """Add the place of every row, from 1, in digest order.

    The leading hex digits cut the order into at most 65,536 equal ranges.
    Each is ranked by itself and moved up by the rows in the ranges before.
    Keys have to tell rows apart: a null in one raises, and so do two rows
    alike in digest and keys, whose places would differ between runs.
    """
    absent = reduce(or_, [F.col(name).isNull() for name in keys])
    empty = F.concat(F.lit("order columns hold nulls: "), F.concat_ws("/", *[F.col(name).cast("string") for name in keys]))
    checked = F.when(absent, F.raise_error(empty).cast("string")).otherwise(F.col(digest))
    rows = df.withColumn("__bucket", digest_bucket(checked))
    # At most one row per bucket: the window and the broadcast below stay that small.
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("__bucket")
        .agg(F.count(F.lit(1)).alias("__rows"))
        .select("__bucket", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    )
    inside = Window.partitionBy("__bucket").orderBy(digest, *keys)
    own = F.struct(digest, *keys)
    alike = F.concat(F.lit("order columns do not tell rows apart: "), F.concat_ws("/", *[F.col(name).cast("string") for name in keys]))
    tied = F.lag(own).over(inside) == own
    return (
        rows.withColumn("__rank", F.when(tied, F.raise_error(alike).cast("int")).otherwise(F.row_number().over(inside)))
        .join(F.broadcast(offsets), "__bucket")
        .withColumn(target, F.col("__rank") + F.col("__before"))
        .drop("__bucket", "__rank", "__before")
    )


def _sorted_parts(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Globally sorted rows, stored, with their partition and place in it.

    Range borders come from a sample, so the sorted rows are written once; the
    row numbers of a second run could differ. Sampling reads ``df`` a second
    time: settle it first if its rows are costly to make.
    """
    placed = settle(df.orderBy(*order).withColumn("__place", F.monotonically_increasing_id()))
    return placed.withColumn("__part", F.shiftright("__place", 33))


def with_running_total(df: DataFrame, order: Sequence[str], weight: str, target: str) -> DataFrame:
    """Add the sum of ``weight`` over all rows before this one, in order.

    Keep ``df`` narrow (order columns and weight): its rows are sorted and
    stored. Each sorted partition is summed by itself and moved up by the
    totals of the partitions before it. Adds ``<target>_all``, the total.
    """
    rows = _sorted_parts(df, order)
    # One row per partition: small enough for one window and a broadcast.
    parts = Window.orderBy("__part")
    offsets = (
        rows.groupBy("__part")
        .agg(F.sum(weight).alias("__sum"))
        .select(
            "__part",
            F.coalesce(
                F.sum("__sum").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("__before"),
            F.sum("__sum")
            .over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            .alias(f"{target}_all"),
        )
    )
    inside = Window.partitionBy("__part").orderBy("__place")
    running = F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        rows.withColumn("__running", running)
        .join(F.broadcast(offsets), "__part")
        .withColumn(target, F.col("__before") + F.col("__running") - F.col(weight))
        .drop("__part", "__place", "__running", "__before")
    )


def with_group_place(df: DataFrame, group: Sequence[str], order: Sequence[str], target: str) -> DataFrame:
    """Add the place of every row inside its group, from 0, in order.

    A group of any size is spread over sorted partitions. Its rows are counted
    once per partition, and only those counts are added up per group.
    """
    rows = _sorted_parts(df, [*group, *order])
    runs = rows.groupBy(*group, "__part").agg(
        F.min("__place").alias("__start"), F.count(F.lit(1)).alias("__rows")
    )
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        *[F.col(name).alias(f"__of_{name}") for name in group],
        F.col("__part").alias("__of_part"),
        "__start",
        F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"),
    )
    # Null-safe, so that rows without a group keep their places as well.
    same = reduce(and_, [F.col(name).eqNullSafe(F.col(f"__of_{name}")) for name in group])
    return rows.join(runs, same & (F.col("__part") == F.col("__of_part"))).select(
        *df.columns, (F.col("__place") - F.col("__start") + F.col("__before")).alias(target)
    )
