"""Interpolated modified Kneser-Ney n-gram model, counted in Spark, read by memory mapping.

Counting: every task counts its n-grams, deals the sorted counts out to shards
and sends one compressed block per shard; a shard adds up its blocks. From the
top order down, a shard passes on the continuation counts of the next lower
order and the statistics of its contexts. So what is shuffled are partial
counts, never texts, and a very frequent word is one entry per task.

Storage: per order and shard one file of sorted 64-bit n-gram hashes with their
counts, and one of sorted context hashes with total and the numbers of n-grams
of count one, two and more. Workers map these files and search them with the
sorted, distinct keys of many texts at once; they never load a model.

An n-gram's shard follows from its context, unless all words of the context are
frequent ones: then from the whole n-gram, which splits hot contexts. The list
of frequent words is bounded by 12 per shard.
"""

from __future__ import annotations

import itertools
import mmap
import os
import tempfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.store import MOST_TASKS, local_path, read_bytes, slices, task_count, text_bytes, write_bytes
from tallyloom.llm.words import chain, hash_words, mix
from tallyloom.session import settle, work_folder

ORDER = 2
#: N-grams that a task holds before it sends their counts on.
HELD_GRAMS = 2_000_000
SHARD_BYTES = 16 * 1024 * 1024
#: Shards beyond the number of tasks are added up one after the other by a task, so memory is that of one shard.
MOST_SHARDS = 200_000
#: Bytes of text scored at once: more of them share the distinct keys.
SCORE_BYTES = 3_000_000
#: A stored count of four bytes with this value stands for one in the list of large counts behind.
LARGE = 2**32 - 1

# Markers that no text can hold: hashes outside any word's bytes.
START = np.uint64(0x0123456789ABCDEF)
END = np.uint64(0xFEDCBA9876543210)


@dataclass
class Model:
    """Where the files are, and the few numbers that are not in them."""

    folder: str
    order: int
    shards: int
    hot: list[int]
    train_tokens: int
    types: int
    #: per order: discounts for counts one, two and more
    discounts: dict[int, tuple[float, float, float]] = field(default_factory=dict)
    #: of order one: total, and the weight that its discounts set free
    base_total: int = 0
    base_free: float = 0.0
    present: dict[str, list[int]] = field(default_factory=dict)

    def present_in(self, name: str) -> frozenset[int]:
        """The shards that hold a file of this kind."""
        kept = self.__dict__.setdefault("_sets", {})
        if name not in kept:
            kept[name] = frozenset(self.present.get(name, []))
        return kept[name]


def _pack(columns: Sequence[np.ndarray]) -> bytes:
    """Columns of one length; the first is stored as differences, as it is sorted."""
    first = columns[0].copy()
    first[1:] -= columns[0][:-1]
    body = b"".join([first.tobytes(), *[column.tobytes() for column in columns[1:]]])
    return len(first).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(body)


def _unpack(block: bytes, kinds: Sequence[str]) -> list[np.ndarray]:
    n = int.from_bytes(block[:8], "little")
    body = zstandard.ZstdDecompressor().decompress(block[8:], max_output_size=sum(np.dtype(k).itemsize for k in kinds) * n + 1)
    out, at = [], 0
    for kind in kinds:
        out.append(np.frombuffer(body, dtype=kind, count=n, offset=at))
        at += n * np.dtype(kind).itemsize
    out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out


def _kinds(k: int) -> list[str]:
    return ["<u8"] * k + ["<u4"]


def _key(words: Sequence[np.ndarray]) -> np.ndarray:
    """The hash of a sequence of words; of none, zero."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    key = words[0]
    for word in words[1:]:
        key = chain(key, word)
    return key


def _range(keys: np.ndarray, shards: int) -> np.ndarray:
    """Cut the range of scrambled keys into equal parts."""
    return ((mix(keys) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def _shard(words: Sequence[np.ndarray], key: np.ndarray, shards: int, hot: np.ndarray) -> np.ndarray:
    if len(words) == 1:
        return _range(key, shards)
    frequent = np.logical_and.reduce([np.isin(word, hot) for word in words[:-1]])
    return _range(np.where(frequent, key, _key(words[:-1])), shards)


def _total(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sorted keys, one place of each, and its summed counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sums = np.add.reduceat(counts[order].astype(np.int64), first) if len(keys) else np.zeros(0, np.int64)
    return keys[first], order[first], sums


def _deal(words: Sequence[np.ndarray], counts: np.ndarray, shard: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """One block per shard, sorted by first word, which packs well."""
    order = np.argsort(words[0], kind="stable")
    order = order[np.argsort(shard[order], kind="stable")]
    words, counts, shard = [word[order] for word in words], counts[order].astype("<u4"), shard[order]
    borders = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
        yield int(shard[a]), _pack([*[word[a:b] for word in words], counts[a:b]])


def _sequence(texts: Sequence[bytes | None], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts behind one another, each with ``order - 1`` start marks and one end.

    Returns the marks and words, where the predicted ones are, and how many each text has.
    """
    hashes, counts = hash_words(texts)
    pads = order - 1
    sizes = counts + pads + 1
    ends = np.cumsum(sizes)
    line = np.full(int(ends[-1]) if len(ends) else 0, START, dtype=np.uint64)
    line[ends - 1] = END
    inside = np.ones(len(line), dtype=bool)
    for pad in range(pads):
        inside[ends - sizes + pad] = False
    predicted = inside.copy()
    inside[ends - 1] = False
    line[inside] = hashes
    return line, np.flatnonzero(predicted), counts + 1


def _grams(line: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """The words of the k-gram that ends at each place."""
    return [line[at - (k - 1 - j)] for j in range(k)]


def _count(docs: DataFrame, k: int, shards: int, hot: np.ndarray) -> DataFrame:
    """Partial counts of the k-grams of ``docs`` (text): shard, block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def send() -> pa.RecordBatch:
            words = [np.concatenate([part[j] for part in held]) for j in range(k)]
            key = _key(words)
            key, place, counts = _total(key, np.ones(len(key), dtype=np.int64))
            words = [word[place] for word in words]
            dealt = list(_deal(words, counts, _shard(words, key, shards, hot)))
            return _blocks(dealt)

        for batch in batches:
            for part in slices(batch, "text", SCORE_BYTES):
                line, at, _ = _sequence(part.column("text").cast(pa.binary()).to_pylist(), k)
                held.append(_grams(line, at, k))
                size += len(at)
                if size >= HELD_GRAMS:
                    yield send()
                    held, size = [], 0
        if held:
            yield send()

    return docs.select("text").mapInArrow(run, "shard int, block binary")


def _blocks(dealt: list[tuple[int, bytes]]) -> pa.RecordBatch:
    shard, block = zip(*dealt) if dealt else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(block, pa.binary())], names=["shard", "block"])


def _by_shard(blocks: DataFrame, shards: int) -> DataFrame:
    return blocks.select("shard", "block").repartition(min(shards, MOST_TASKS), "shard").sortWithinPartitions("shard")


def _each_shard(batches: Iterator[pa.RecordBatch], kinds: Sequence[str]) -> Iterator[tuple[int, list[np.ndarray]]]:
    rows = ((s, b) for batch in batches for s, b in zip(batch.column("shard").to_pylist(), batch.column("block").to_pylist()))
    for shard, group in itertools.groupby(rows, key=lambda row: row[0]):
        parts = [_unpack(block, kinds) for _, block in group]
        yield shard, [np.concatenate(columns) for columns in zip(*parts)]


def _file(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    return b"".join([len(keys).to_bytes(8, "little"), keys.astype("<u8").tobytes(), *[c.tobytes() for c in columns]])


def _count_file(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Keys, counts of four bytes, and the places and eight bytes of those that need more."""
    large = np.flatnonzero(counts >= LARGE)
    body = [large.astype("<i8").tobytes(), counts[large].astype("<i8").tobytes()]
    return b"".join([_file(keys, np.minimum(counts, LARGE).astype("<u4")), *body])


MERGED = "kind string, shard int, block binary, stats array<long>, words array<long>, counts array<long>"


def _merge(blocks: DataFrame, folder: str, k: int, shards: int, hot: np.ndarray, name: str, least_hot: int = 0) -> DataFrame:
    """Add up the blocks of every shard, store its n-grams and pass on what lower orders need.

    Rows of kind ``stat`` hold one shard's distinct n-grams, sum, and numbers of
    n-grams of count 1 to 4; of kind ``low`` continuation counts; of kind
    ``context`` the statistics of contexts. ``least_hot`` asks for the words of
    at least that count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, (*words, counts) in _each_shard(batches, _kinds(k)):
            key, place, total = _total(_key(words), counts)
            words = [word[place] for word in words]
            write_bytes(f"{folder}/{name}-{shard}", _count_file(key, total))
            stats = [len(key), int(total.sum()), *[int((total == c).sum()) for c in (1, 2, 3, 4)]]
            top = total >= least_hot if least_hot else np.zeros(len(key), dtype=bool)
            rows = [("stat", shard, None, stats, words[0][top].view(np.int64).tolist(), total[top].tolist())]
            if k > 1:
                low_key, low_place, low = _total(_key(words[1:]), np.ones(len(key), dtype=np.int64))
                low_words = [word[low_place] for word in words[1:]]
                rows += [("low", s, b, None, None, None) for s, b in _deal(low_words, low, _shard(low_words, low_key, shards, hot))]
                context = _key(words[:-1])
                order = np.argsort(context, kind="stable")
                sorted_context, sorted_total = context[order], total[order]
                first = np.flatnonzero(np.concatenate([[True], sorted_context[1:] != sorted_context[:-1]]))
                found = [np.add.reduceat(x.astype(np.int64), first) for x in (sorted_total, sorted_total == 1, sorted_total == 2, sorted_total > 2)]
                unique = sorted_context[first]
                dealt = _range(unique, shards)
                for s, part in _runs(dealt, np.argsort(dealt, kind="stable")):
                    rows.append(("context", s, _pack([unique[part], *[x[part] for x in found]]), None, None, None))
            columns = zip(*rows)
            types = [pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            names = ["kind", "shard", "block", "stats", "words", "counts"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return settle(_by_shard(blocks, shards).mapInArrow(run, MERGED))


def _merge_contexts(blocks: DataFrame, folder: str, shards: int, name: str) -> list[int]:
    """Add up the statistics of contexts and store them; returns the shards that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, (context, *numbers) in _each_shard(batches, ["<u8"] + ["<i8"] * 4):
            order = np.argsort(context, kind="stable")
            context = context[order]
            first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
            sums = [np.add.reduceat(x[order], first) for x in numbers]
            write_bytes(f"{folder}/{name}-{shard}", _file(context[first], *[x.astype("<i8") for x in sums]))
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32())})

    return [row[0] for row in _by_shard(blocks, shards).mapInArrow(run, "shard int").collect()]


def discounts(ones: int, twos: int, threes: int, fours: int) -> tuple[float, float, float]:
    """Discounts of modified Kneser-Ney from the numbers of n-grams of count 1 to 4.

    Where a small table leaves a number at zero, the discount falls back to 0.5
    a count; each stays between zero and its count.
    """
    if not ones or not twos:
        return 0.5, 0.75, 1.0
    y = ones / (ones + 2 * twos)
    found = [1 - 2 * y * twos / ones, 2 - 3 * y * threes / twos, 3 - 4 * y * fours / threes if threes else 1.5]
    return tuple(min(max(d, 0.05), c) for d, c in zip(found, (1, 2, 3)))  # type: ignore[return-value]


def train(docs: DataFrame, folder: str, order: int = ORDER, shard_bytes: int = SHARD_BYTES) -> Model:
    """Count the texts of ``docs`` (text) and store a model of ``order`` words in ``folder``."""
    docs = docs.select("text")
    size = text_bytes(docs)
    shards = task_count(size, shard_bytes, MOST_SHARDS)
    least_hot = max(1000, size // (24 * shards))
    nothing = np.zeros(0, dtype=np.uint64)
    model = Model(folder, order, shards, [], 0, 0)

    def stats_of(merged: DataFrame, name: str) -> np.ndarray:
        rows = merged.filter("kind = 'stat'").select("shard", "stats").collect()
        model.present[name] = sorted(row[0] for row in rows)
        return np.sum([row[1] for row in rows], axis=0) if rows else np.zeros(6, dtype=np.int64)

    words = _merge(_count(docs, 1, shards, nothing), folder, 1, shards, nothing, "words", least_hot)
    model.types, model.train_tokens = map(int, stats_of(words, "words")[:2])
    frequent = words.filter("kind = 'stat'").select("words").collect()
    hot = np.sort(np.array([w for row in frequent for w in row[0]], dtype=np.int64).view(np.uint64))
    if order > 1:
        hot = np.sort(np.append(hot, START))
    model.hot = hot.tolist()
    blocks = _count(docs, order, shards, hot)
    for k in range(order, 0, -1):
        merged = _merge(blocks, folder, k, shards, hot, f"grams{k}")
        stats = stats_of(merged, f"grams{k}")
        model.discounts[k] = discounts(*map(int, stats[2:]))
        if k > 1:
            name = f"contexts{k}"
            model.present[name] = sorted(_merge_contexts(merged.filter("kind = 'context'"), folder, shards, name))
            blocks = merged.filter("kind = 'low'")
        else:
            types, total, ones, twos = map(int, stats[:4])
            one, two, more = model.discounts[1]
            model.base_total = total
            model.base_free = one * ones + two * twos + more * (types - ones - twos)
    return model


@lru_cache(maxsize=512)
def _mapped(path: str, wide: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """Keys and columns of a stored file, mapped. A remote file is copied first and its copy unlinked at once.

    The columns are four numbers of contexts, or counts of n-grams with the
    places and values of large ones.
    """
    place = local_path(path)
    if place is None:
        handle, place = tempfile.mkstemp()
        with os.fdopen(handle, "wb") as out:
            out.write(read_bytes(path))
        source = open(place, "rb")
        os.unlink(place)
    else:
        source = open(place, "rb")
    with source:
        view = mmap.mmap(source.fileno(), 0, access=mmap.ACCESS_READ)
    n = int.from_bytes(view[:8], "little")
    keys = np.frombuffer(view, dtype="<u8", count=n, offset=8)
    if wide:
        return keys, [np.frombuffer(view, dtype="<i8", count=n, offset=8 + 8 * n * (j + 1)) for j in range(4)]
    counts, large = np.frombuffer(view, dtype="<u4", count=n, offset=8 + 8 * n), 8 + 12 * n
    more = (len(view) - large) // 16
    return keys, [counts, *[np.frombuffer(view, dtype="<i8", count=more, offset=large + j * 8 * more) for j in range(2)]]


def _find(model: Model, name: str, keys: np.ndarray, shard: np.ndarray, wide: bool = False) -> list[np.ndarray]:
    """The stored columns for every key, zero where it is unknown."""
    out = [np.zeros(len(keys), dtype=np.int64) for _ in range(4 if wide else 1)]
    present = model.present_in(name)
    order = np.lexsort((keys, shard))
    for s, part in _runs(shard, order):
        if s not in present:
            continue
        stored, columns = _mapped(f"{model.folder}/{name}-{s}", wide)
        place = np.minimum(np.searchsorted(stored, keys[part]), len(stored) - 1)
        hit = stored[place] == keys[part]
        part, place = part[hit], place[hit]
        for target, column in zip(out, columns):
            target[part] = column[place]
        if not wide:
            large = np.flatnonzero(out[0][part] == LARGE)
            out[0][part[large]] = columns[2][np.searchsorted(columns[1], place[large])]
    return out


def _runs(shard: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The shards that occur, each with its places in ``order``, which sorts them by shard."""
    dealt = shard[order]
    borders = np.flatnonzero(np.concatenate([[True], dealt[1:] != dealt[:-1], [True]])) if len(dealt) else [0]
    for a, b in zip(borders[:-1], borders[1:]):
        yield int(dealt[a]), order[a:b]


def _discounted(counts: np.ndarray, cut: tuple[float, float, float]) -> np.ndarray:
    steps = np.array([0.0, *cut])
    return np.maximum(counts - steps[np.minimum(counts, 3)], 0.0)


def probabilities(model: Model, line: np.ndarray, at: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The model's probability of the word at each place, given the words before it."""
    p = None
    for k in range(1, model.order + 1):
        words = _grams(line, at, k)
        key, place, back = np.unique(_key(words), return_index=True, return_inverse=True)
        distinct = [word[place] for word in words]
        counts = _find(model, f"grams{k}", key, _shard(distinct, key, model.shards, hot))[0]
        kept = _discounted(counts, model.discounts[k])[back]
        if k == 1:
            uniform = 1.0 / (model.types + 1)
            p = (kept + model.base_free * uniform) / model.base_total if model.base_total else np.full(len(at), uniform)
            continue
        context, back = np.unique(_key(words[:-1]), return_inverse=True)
        total, ones, twos, more = _find(model, f"contexts{k}", context, _range(context, model.shards), wide=True)
        d1, d2, d3 = model.discounts[k]
        free = (d1 * ones + d2 * twos + d3 * more)[back]
        total = total[back]
        p = np.where(total > 0, (kept + free * p) / np.maximum(total, 1), p)
    return p


SCORES = "n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Score every text of ``docs`` (doc_id, held_out, text); a null text is empty and holds its end alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.array(model.hot, dtype=np.uint64)
        least = np.log10(0.5) - np.log10(model.train_tokens + 0.5 * (model.types + 1))
        for batch in batches:
            for part in slices(batch, "text", SCORE_BYTES):
                line, at, sizes = _sequence(part.column("text").cast(pa.binary()).to_pylist(), model.order)
                starts = np.cumsum(sizes) - sizes
                key, back = np.unique(line[at], return_inverse=True)
                counts = _find(model, "words", key, _range(key, model.shards))[0][back]
                base = np.where(counts > 0, np.log10((counts + 0.5) / (model.train_tokens + 0.5 * (model.types + 1))), least)
                logs = np.log10(probabilities(model, line, at, hot))
                columns = [
                    part.column("doc_id"),
                    part.column("held_out"),
                    pa.array(sizes),
                    pa.array(np.add.reduceat((counts > 0).astype(np.int64), starts)),
                    pa.array(np.add.reduceat(base, starts)),
                    pa.array(np.add.reduceat(logs, starts)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id long, held_out boolean, {SCORES}")


def remainder(divisor: int) -> Column:
    """crc32 of the decimal doc_id modulo ``divisor``; of a null id, zero."""
    return F.pmod(F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)), F.lit(divisor))


def train_and_score(docs: DataFrame, order: int = ORDER, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Learn from the documents outside the held-out fold and score all of them.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (the
    smoothed unigram baseline), score (log10 probability) and perplexity. A null
    or empty text is its end alone. Repeated rows count and are scored each; a
    null doc_id is not held out. With nothing to learn from every word has the
    same chance; an empty table gives no rows, other columns are left out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(5) == 1).alias("held_out"), F.col("text").cast("string").alias("text"))
    model = train(rows.filter(~F.col("held_out")), work_folder(docs.sparkSession, "kneser"), order, shard_bytes)
    return score(rows, model).select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
