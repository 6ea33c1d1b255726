"""Weighted mixing of named datasets."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digests import seeded_digest
from ..functions.templates import Template, chat_text
from ..operators.order import prefix_cutoffs, up_to
from ..sources.datasets import split_kind, training_columns
from ..sources.reader_order import file_rows, reader_prefix, with_reader_place

# Fixed value: the seed of the shuffle after mixing.
MIX_SEED = 42

Spec = Mapping[str, float | Mapping[str, Any]]


def read_spec(spec: Spec) -> list[tuple[str, float, str]]:
    """Name, fraction and revision of every dataset, checked before any read."""
    entries = []
    for name, value in spec.items():
        if isinstance(value, Mapping):
            entry = (name, value.get("fraction", 1.0), value.get("revision", "main"))
        else:
            entry = (name, value, "main")
        if entry[1] < 0:
            raise ValueError(f"the fraction of {name} is below zero: {entry[1]}")
        if entry[1] > 1:
            raise ValueError(f"Dataset fraction {entry[1]} of {name} is above 1.")
        entries.append(entry)
    if not entries:
        raise ValueError("The mix names no dataset.")
    return entries


def _finish(rows: DataFrame, shuffle: bool, seed: int) -> DataFrame:
    if not shuffle:
        return rows
    return rows.withColumn("digest", seeded_digest(seed, "mix_pos", "row_key"))


def mix(
    spec: Spec,
    read: Callable[[str, str, str], DataFrame],
    order_key: str | None = None,
    splits: Sequence[str] = ("train", "test"),
    shuffle: bool = True,
    seed: int = MIX_SEED,
) -> dict[str, DataFrame]:
    """Mix datasets read by ``read(name, split, revision)``.

    Training sets give the first part of their rows in ``order_key`` order, test
    sets all of them. Without ``order_key`` that is reader order, which any table
    read straight from files has: then ``row_key`` is the place in it. Besides the training columns every row has ``mix_pos``
    (place of its dataset split in the mix) and ``row_key`` (the order key),
    and with ``shuffle`` the ``digest`` that orders the permutation.
    """
    entries = read_spec(spec)
    kinds = {split: split_kind(split) for split in splits}
    parts: dict[str, list[DataFrame]] = {}
    fractions: dict[int, float] = {}
    for name, fraction, revision in entries:
        for split, kind in kinds.items():
            rows = read(name, split, revision)
            found = parts.setdefault(kind, [])
            if order_key is None:
                found.append(_in_reader_order(rows, len(found), fraction if kind == "train" else 1.0))
                continue
            if kind == "train":
                fractions[len(found)] = fraction
            found.append(
                rows.select(
                    F.lit(len(found)).alias("mix_pos"),
                    F.col(order_key).alias("row_key"),
                    *training_columns(rows),
                )
            )
    mixed = {}
    for kind, frames in parts.items():
        if kind == "train" and order_key is not None:
            keys = reduce(DataFrame.unionByName, [rows.select("mix_pos", "row_key") for rows in frames])
            frames = _cut(frames, prefix_cutoffs(keys, "mix_pos", ["row_key"], fractions))
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
        mixed[kind] = _finish(rows, shuffle, seed)
    return mixed


def _in_reader_order(rows: DataFrame, place: int, fraction: float) -> DataFrame:
    """The first part of a table by files and places in them."""
    files = file_rows(rows)
    kept = reader_prefix(rows, int(fraction * sum(n for _, n in files)), files)
    placed = with_reader_place(kept, "__place", files)
    return placed.select(F.lit(place).alias("mix_pos"), F.col("__place").alias("row_key"), *training_columns(rows))


def _cut(frames: list[DataFrame], ends: Mapping[int, tuple | None]) -> list[DataFrame]:
    """End every dataset at its cutoff; the comparison reaches its own scan."""
    cut = []
    for at, rows in enumerate(frames):
        if at not in ends:
            rows = rows.filter(F.lit(False))
        elif ends[at] is not None:
            rows = rows.filter(up_to(rows, ["row_key"], ends[at]))
        cut.append(rows)
    return cut


def mix_tagged_rows(
    df: DataFrame,
    spec: Spec,
    dataset: str,
    split: str,
    order_key: str,
    splits: Sequence[str] = ("train", "test"),
) -> DataFrame:
    """All splits of ``mix_tagged`` in one scan: ``kind``, ``mix_pos``, ``row_key`` and the training columns.

    The cutoffs become comparisons on the table's own columns, so that rows
    outside the mix are left out where the table is read.
    """
    fractions = {name: fraction for name, fraction, _ in read_spec(spec)}
    tag, label, key = F.col(dataset), F.col(split), F.col(order_key)
    named = tag.isin(list(fractions))
    # One count per dataset and split tells what is there, how large it is and whether keys are missing.
    counted = df.filter(named).groupBy(dataset, split).agg(F.count(F.lit(1)), F.count_if(key.isNull())).collect()
    if absent := [name for name in fractions if name not in {row[0] for row in counted}]:
        raise ValueError(f"the table holds no rows of {', '.join(absent)}")
    places: list[tuple[str, str, str, int]] = []
    for kind in dict.fromkeys(split_kind(name) for name in splits):
        pairs = [(name, one) for name in fractions for one in splits if split_kind(one) == kind]
        places += [(name, one, kind, at) for at, (name, one) in enumerate(pairs)]
    # One row per dataset split of the mix, so small enough to broadcast.
    table = F.broadcast(
        df.sparkSession.createDataFrame(places, f"`{dataset}` string, `{split}` string, kind string, mix_pos int")
    )
    shares = {at: fractions[name] for name, _, kind, at in places if kind == "train"}
    found = {(name, one): (rows, lost) for name, one, rows, lost in counted}
    sizes: dict[int, int] = {}
    for name, one, kind, at in places:
        rows, lost = found.get((name, one), (0, 0))
        if kind == "train" and rows:
            if lost:
                raise ValueError(f"order columns ['row_key'] hold nulls in {name!r}")
            sizes[at] = rows
    keys = df.filter(named).select(dataset, split, key.alias("row_key")).join(table, [dataset, split])
    ends = prefix_cutoffs(keys.filter("kind = 'train'"), "mix_pos", ["row_key"], shares, sizes=sizes) if shares else {}

    def before_end(end: tuple | None) -> Column:
        return F.lit(True) if end is None else key <= F.lit(end[0]).cast(df.schema[order_key].dataType)

    kept, loose = [F.lit(False)], [F.lit(False)]
    for name, one, kind, at in places:
        if kind == "train" and at not in ends:
            continue
        end = ends[at] if kind == "train" else None
        kept.append((tag == name) & (label == one) & before_end(end))
        # The same without the split, which a table may have to compute first.
        loose.append((tag == name) & before_end(end))
    rows = df.filter(named & reduce(or_, loose) & reduce(or_, kept)).join(table, [dataset, split])
    return rows.select("kind", "mix_pos", key.alias("row_key"), *training_columns(df))


def mix_tagged(
    df: DataFrame,
    spec: Spec,
    dataset: str,
    split: str,
    order_key: str,
    splits: Sequence[str] = ("train", "test"),
    shuffle: bool = True,
    seed: int = MIX_SEED,
) -> dict[str, DataFrame]:
    """Like ``mix`` for one table that holds all datasets and splits.

    A dataset without any row in the table raises. ``mix_tagged_rows`` gives
    all splits at once, in one scan.
    """
    rows = mix_tagged_rows(df, spec, dataset, split, order_key, splits)
    kinds = dict.fromkeys(split_kind(name) for name in splits)
    return {kind: _finish(rows.filter(F.col("kind") == kind).drop("kind"), shuffle, seed) for kind in kinds}


def arrange(mixed: DataFrame) -> DataFrame:
    """Sort for writing: shuffled if the mix was, else in mix order."""
    order = ["mix_pos", "row_key"]
    return mixed.orderBy(*(["digest", *order] if "digest" in mixed.columns else order))


def as_one(mixed: Mapping[str, DataFrame]) -> DataFrame:
    """All splits in one table with a ``split`` column."""
    tagged = [rows.withColumn("split", F.lit(kind)) for kind, rows in mixed.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def render_mix(mixed: Mapping[str, DataFrame], template: Template, task: str = "sft") -> dict[str, DataFrame]:
    """Add ``text`` to every split, rendered from ``messages``."""
    return {
        kind: rows.withColumn("text", chat_text("messages", template, task)) for kind, rows in mixed.items()
    }
