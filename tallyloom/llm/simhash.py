"""SimHash near-duplicates: fingerprints linked by a generalised pigeonhole search.

The 64 bits are grouped into parts, correlated bits together. If two
fingerprints differ in at most T bits and the thresholds t_i of the m parts add
up to T - m + 1, then some part differs in at most t_i bits (a part with t_i = -1
is not looked at). Every fingerprint is listed in each part under its own value;
as a query it chooses, by dynamic programming over estimated candidate counts,
the cheapest thresholds and asks for all values within them. Lists and questions
meet by (part, value); candidates are verified on all 64 bits, and a task passes
on only links to the smallest member of what it has joined, so a large group of
near copies gives no rows for its pairs.

A value that very many fingerprints share in a part (texts of one template) is
one hot bucket. Its lists and questions are dealt once more by the other bits: of
T + 1 groups of these, at least one agrees in two fingerprints that differ in at
most T bits, so each row goes to one smaller bucket per group and no link is lost.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.graphs import components, local_roots
from tallyloom.llm.store import MOST_TASKS, slices, task_count
from tallyloom.llm.words import mix
from tallyloom.operators.lookup import lookup
from tallyloom.session import settle

BITS = 64
SHINGLE_WORDS = 4
SEED = 42
MOST_BITS = 4
#: Cost of one question against one comparison of candidates.
PROBE_COST, CANDIDATE_COST = 1.0, 0.02
#: No part is asked for values with more differing bits than this, unless there is one part only.
MOST_FLIPS = 2
#: A bucket with more comparisons than this is searched by widening circles.
LARGE_BUCKET = 1_000_000
SHARD_ROWS = 500_000
#: Shards beyond the number of tasks follow one another in a task, which holds one at a time.
MOST_SHARDS = 200_000
#: A value of a part is hot if more fingerprints than this have it, and more than one in ``MOST_HOT`` of all.
HOT_ROWS = 100_000
#: No part has more hot values than this.
MOST_HOT = 20_000
#: Hot buckets are dealt again only by groups of at least so many bits.
LEAST_GROUP_BITS = 4
#: Counters of a histogram of the values of a part, as a power of two.
HISTOGRAM_BITS = 16


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The fingerprint of one text as an unsigned integer."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    span = min(shingle, len(words))
    pairs = zip(starts[: len(words) - span + 1].tolist(), ends[span - 1 :].tolist())
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(line[a:b], seed) for a, b in pairs]), dtype=np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every text of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                found = np.array([fingerprint(t, shingle, seed) for t in part.column("text").to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _summed(rows: DataFrame, counts, size: int) -> np.ndarray:
    """Add up an array of ``size`` counters over all fingerprints; ``counts`` makes it from an array of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += counts(batch.column("fp").to_numpy().view(np.uint64))
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total[place])], names=["place", "n"])

    out = np.zeros(size, dtype=np.int64)
    for place, n in rows.select("fp").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n")).collect():
        out[place] = n
    return out


def bits_of(fps: np.ndarray) -> np.ndarray:
    """Rows of 64 zeros and ones; column b is bit b."""
    return np.unpackbits(np.ascontiguousarray(fps.astype("<u8")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Deal the bits into parts of almost equal size, correlated bits together.

    ``both`` counts for each pair of bits the fingerprints with both set.
    """
    mean = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    tie = np.abs(both / max(n, 1) - np.outer(mean, mean)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0)
    left, found = set(range(BITS)), []
    for p in range(parts):
        size = (BITS - sum(map(len, found))) // (parts - p)
        at = max(left, key=lambda b: (tie[b, sorted(left)].max(), -b))
        part = [at]
        left.remove(at)
        while len(part) < size:
            at = max(left, key=lambda b: (tie[b, part].sum(), -b))
            part.append(at)
            left.remove(at)
        found.append(sorted(part))
    return found


def part_value(fps: np.ndarray, part: Sequence[int]) -> np.ndarray:
    """The bits of one part side by side."""
    value = np.zeros(len(fps), dtype=np.uint64)
    for j, b in enumerate(part):
        value |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(j)
    return value


def _pieces(part: Sequence[int]) -> list[list[int]]:
    """A part, or its halves and so on, narrow enough for a histogram of values."""
    if len(part) <= HISTOGRAM_BITS:
        return [list(part)]
    half = len(part) // 2
    return _pieces(part[:half]) + _pieces(part[half:])


def shells(histogram: np.ndarray, width: int, most: int) -> np.ndarray:
    """For every value the share of fingerprints with a value exactly 0, 1, ... ``most`` bits away."""
    found = np.zeros((most + 1, 1 << width))
    found[0] = histogram / max(histogram.sum(), 1)
    values = np.arange(1 << width)
    for b in range(width):
        flipped = found[:, values ^ (1 << b)]
        found[1:] += flipped[:-1]
    return found


def masks(width: int, flips: int) -> np.ndarray:
    """All ways to flip up to ``flips`` of ``width`` bits."""
    out = [sum(1 << b for b in chosen) for r in range(flips + 1) for chosen in itertools.combinations(range(width), r)]
    return np.array(out, dtype=np.uint64)


def choose_parts(n: int, most_bits: int) -> int:
    """The number of parts with the least expected cost a query, were the bits even."""

    def cost(m: int) -> float:
        width, left = BITS / m, most_bits - m + 1
        flips = [left // m + (i < left % m) for i in range(m)] if left >= 0 else [0] * (most_bits + 1) + [-1] * (m - most_bits - 1)
        asked = sum(sum(comb(round(width), r) for r in range(t + 1)) for t in flips if t >= 0)
        return asked * (PROBE_COST + CANDIDATE_COST * n / 2**width)

    # Thresholds of MOST_FLIPS everywhere must reach what the pigeonhole asks for.
    wide = [m for m in range(2, most_bits + 2) if most_bits - m + 1 <= MOST_FLIPS * m]
    return min(wide, key=cost) if most_bits else 1


class Plan:
    """Parts, histograms and the choice of thresholds; small enough to travel with every task."""

    def __init__(self, parts: list[list[int]], histograms: list[list[np.ndarray]], n: int, most_bits: int):
        self.parts, self.n, self.most_bits = parts, n, most_bits
        self.flips = most_bits if len(parts) == 1 else min(MOST_FLIPS, most_bits)
        self.histograms = histograms
        self.hot = np.zeros(0, dtype=np.uint64)
        self.groups = [second_groups(part, most_bits) for part in parts]
        self._shells: list | None = None

    def candidates(self, fps: np.ndarray, p: int) -> np.ndarray:
        """Estimated candidates of every fingerprint in part ``p`` for thresholds 0, 1, ..."""
        if self._shells is None:
            self._shells = [
                [shells(h, len(piece), self.flips) for h, piece in zip(hs, _pieces(part))]
                for hs, part in zip(self.histograms, self.parts)
            ]
        near = np.zeros((len(fps), self.flips + 1))
        near[:, 0] = 1
        for shell, piece in zip(self._shells[p], _pieces(self.parts[p])):
            own = shell[:, part_value(fps, piece).astype(np.int64)].T
            both = np.zeros_like(near)
            for a in range(self.flips + 1):
                both[:, a:] += near[:, : self.flips + 1 - a] * own[:, a : a + 1]
            near = both
        return self.n * np.cumsum(near, axis=1)

    def thresholds(self, fps: np.ndarray) -> np.ndarray:
        """The cheapest thresholds of every fingerprint, one column per part; -1 leaves a part out."""
        m, goal = len(self.parts), self.most_bits - len(self.parts) + 1
        costs = []
        for p, part in enumerate(self.parts):
            asked = np.cumsum([comb(len(part), r) for r in range(self.flips + 1)])
            costs.append(np.column_stack([np.zeros(len(fps)), PROBE_COST * asked + CANDIDATE_COST * self.candidates(fps, p)]))
        # best[s]: least cost of the parts so far with thresholds that add up to s - m
        width = m + m * self.flips + 1
        best = np.full((width, len(fps)), np.inf)
        best[m] = 0
        steps = []
        for p in range(m):
            new, step = np.full_like(best, np.inf), np.zeros(best.shape, dtype=np.int8)
            for t in range(-1, self.flips + 1):
                for s in range(width):
                    if 0 <= s - t < width:
                        price = best[s - t] + costs[p][:, t + 1]
                        better = price < new[s]
                        new[s][better], step[s][better] = price[better], t
            best = new
            steps.append(step)
        at = np.full(len(fps), goal + m)
        out = np.zeros((len(fps), m), dtype=np.int8)
        rows = np.arange(len(fps))
        for p in reversed(range(m)):
            out[:, p] = steps[p][at, rows]
            at = at - out[:, p]
        return out

    def deal(self, bucket: np.ndarray, p: int, fps: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows of buckets of part ``p``, those of hot ones once in each of their smaller buckets."""
        if not len(self.hot):
            return bucket, fps, nodes
        at = np.minimum(np.searchsorted(self.hot, bucket), len(self.hot) - 1)
        hot = self.hot[at] == bucket
        if not hot.any():
            return bucket, fps, nodes
        keys, rows = [bucket[~hot]], [np.flatnonzero(~hot)]
        for q, bits in enumerate(self.groups[p]):
            own = part_value(fps[hot], bits) | part_mark(q)
            keys.append(mix(bucket[hot] ^ mix(own)))
            rows.append(np.flatnonzero(hot))
        row = np.concatenate(rows)
        return np.concatenate(keys), fps[row], nodes[row]


def second_groups(part: Sequence[int], most_bits: int) -> list[list[int]]:
    """The bits outside a part in one group more than may differ; none if these would be too narrow to help."""
    rest = [b for b in range(BITS) if b not in set(part)]
    count = most_bits + 1
    return [rest[q::count] for q in range(count)] if len(rest) // count >= LEAST_GROUP_BITS else []


def part_mark(p: int) -> np.uint64:
    """The bits of a bucket that name its part."""
    return np.uint64(p) << np.uint64(BITS - 6)


def hot_values(rows: DataFrame, plan: Plan) -> tuple[np.ndarray, int]:
    """Sorted buckets with more fingerprints than ``HOT_ROWS`` and one in ``MOST_HOT``, and how many rows these hold.

    The histograms tell for parts of one piece. Wider parts are counted by value, but only
    where every piece of the value is that frequent.
    """
    least = max(HOT_ROWS, plan.n // MOST_HOT)
    found, held, wide = [np.zeros(0, dtype=np.uint64)], 0, []
    for p, histograms in enumerate(plan.histograms):
        if not plan.groups[p] or any(h.max(initial=0) <= least for h in histograms):
            continue
        if len(histograms) > 1:
            wide.append(p)
            continue
        hot = np.flatnonzero(histograms[0] > least)
        found.append(hot.astype(np.uint64) | part_mark(p))
        held += int(histograms[0][hot].sum())
    if not wide:
        return np.sort(np.concatenate(found)), held

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for p in wide:
                own = fps
                for piece, histogram in zip(_pieces(plan.parts[p]), plan.histograms[p]):
                    own = own[histogram[part_value(own, piece).astype(np.int64)] > least]
                value, n = np.unique(part_value(own, plan.parts[p]) | part_mark(p), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], names=["bucket", "n"])

    counted = rows.select("fp").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    hot = counted.filter(F.col("n") > least).collect()
    found.append(np.array([row.bucket for row in hot], dtype=np.int64).view(np.uint64))
    return np.sort(np.concatenate(found)), held + sum(row.n for row in hot)


def plan_search(rows: DataFrame, n: int, most_bits: int = MOST_BITS) -> Plan:
    """Group the bits and count the values of the parts over all fingerprints of ``rows`` (fp)."""

    def pairs(fps: np.ndarray) -> np.ndarray:
        total = np.zeros(BITS * BITS, dtype=np.int64)
        for at in range(0, len(fps), 1 << 16):
            bits = bits_of(fps[at : at + (1 << 16)]).astype(np.float32)
            total += (bits.T @ bits).round().astype(np.int64).reshape(-1)
        return total

    parts = group_bits(_summed(rows, pairs, BITS * BITS).reshape(BITS, BITS), n, choose_parts(n, most_bits))
    pieces = [piece for part in parts for piece in _pieces(part)]
    starts = np.cumsum([0, *[1 << len(piece) for piece in pieces]]).tolist()

    def values(fps: np.ndarray) -> np.ndarray:
        found = [np.bincount(part_value(fps, piece).astype(np.int64), minlength=1 << len(piece)) for piece in pieces]
        return np.concatenate(found)

    counted = _summed(rows, values, starts[-1])
    histograms, at = [], 0
    for part in parts:
        own = len(_pieces(part))
        histograms.append([counted[starts[at + j] : starts[at + j + 1]] for j in range(own)])
        at += own
    return Plan(parts, histograms, n, most_bits)


def _near(fps: np.ndarray, one: np.uint64, most_bits: int) -> np.ndarray:
    return np.bitwise_count(fps ^ one) <= most_bits


def _widen(asking: np.ndarray, listed: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what a large bucket's comparisons join, without making all of its pairs.

    From a member outwards: each one reached is compared with what has not been
    reached yet on the other side. Returns places in ``asking`` and ``listed``.
    """
    rest = [np.arange(len(asking)), np.arange(len(listed))]
    sides = [asking, listed]
    links: list[tuple[int, int]] = []
    while len(rest[0]):
        queue = [(0, int(rest[0][0]))]
        rest[0] = rest[0][1:]
        while queue:
            side, at = queue.pop()
            other = rest[1 - side]
            hit = _near(sides[1 - side][other], sides[side][at], most_bits)
            if hit.any():
                found = other[hit].tolist()
                rest[1 - side] = other[~hit]
                queue += [(1 - side, x) for x in found]
                links += [(at, x) if side == 0 else (x, at) for x in found]
    a, b = zip(*links) if links else ((), ())
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def bucket_links(
    asked: tuple[np.ndarray, np.ndarray, np.ndarray], listed: tuple[np.ndarray, np.ndarray, np.ndarray], most_bits: int
) -> tuple[np.ndarray, np.ndarray]:
    """Verified links between questions and lists, both (bucket, fingerprint, node), as pairs of nodes."""
    order = np.argsort(listed[0], kind="stable")
    bucket, fps, nodes = (column[order] for column in listed)
    order = np.argsort(asked[0], kind="stable")
    ask_bucket, ask_fps, ask_nodes = (column[order] for column in asked)
    first = np.searchsorted(bucket, ask_bucket, side="left")
    size = np.searchsorted(bucket, ask_bucket, side="right") - first
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    useful = np.flatnonzero(size)
    starts = np.flatnonzero(np.concatenate([[True], ask_bucket[useful][1:] != ask_bucket[useful][:-1]])) if len(useful) else []
    ends = np.append(starts[1:], len(useful)) if len(useful) else []
    small = np.ones(len(useful), dtype=bool)
    for a, b in zip(starts, ends):
        rows = useful[a:b]
        if len(rows) * int(size[rows[0]]) > LARGE_BUCKET:
            small[a:b] = False
            at = first[rows[0]]
            inside = slice(at, at + size[rows[0]])
            i, j = _widen(ask_fps[rows], fps[inside], most_bits)
            left.append(ask_nodes[rows][i])
            right.append(nodes[inside][j])
    rows = useful[small]
    ends = np.cumsum(size[rows])
    at = 0
    while at < len(rows):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + 4_000_000, side="right")))
        part = rows[at:stop]
        query = np.repeat(part, size[part])
        offset = np.arange(len(query)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
        found = first[query] + offset
        hit = np.bitwise_count(ask_fps[query] ^ fps[found]) <= most_bits
        hit &= ask_nodes[query] != nodes[found]
        left.append(ask_nodes[query[hit]])
        right.append(nodes[found[hit]])
        at = stop
    return np.concatenate(left), np.concatenate(right)


def links(rows: DataFrame, n: int, most_bits: int = MOST_BITS) -> DataFrame:
    """Links that connect all of ``rows`` (node, fp; distinct fingerprints) at most ``most_bits`` apart."""
    plan = plan_search(rows, n, most_bits)
    m = len(plan.parts)
    plan.hot, held = hot_values(rows, plan)
    shards = task_count(n * (m + 25) + 2 * held * most_bits, SHARD_ROWS, MOST_SHARDS)

    def block(bucket: np.ndarray, fps: np.ndarray, nodes: np.ndarray, asks: int) -> Iterator[tuple[int, bytes]]:
        shard = ((mix(bucket) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((bucket, shard))
        bucket, fps, nodes, shard = bucket[order], fps[order], nodes[order], shard[order]
        borders = np.searchsorted(shard, np.arange(shards + 1)).tolist()
        for s, (a, b) in enumerate(zip(borders, borders[1:])):
            if b > a:
                body = b"".join([bucket[a:b].tobytes(), fps[a:b].tobytes(), nodes[a:b].tobytes()])
                yield s, bytes([asks]) + zstandard.ZstdCompressor(level=1).compress(body)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                fps = part.column("fp").to_numpy().view(np.uint64)
                nodes = part.column("node").to_numpy()
                chosen = plan.thresholds(fps)
                out: list[tuple[int, bytes]] = []
                for p, bits in enumerate(plan.parts):
                    value = part_value(fps, bits)
                    mark = part_mark(p)
                    out += block(*plan.deal(value | mark, p, fps, nodes), 0)
                    for t in range(plan.flips + 1):
                        own = np.flatnonzero(chosen[:, p] == t)
                        if len(own):
                            ways = masks(len(bits), t)
                            asked = (value[own][:, None] ^ ways[None, :]).reshape(-1) | mark
                            asking = np.repeat(own, len(ways))
                            out += block(*plan.deal(asked, p, fps[asking], nodes[asking]), 1)
                shard, body = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(body, pa.binary())], names=["shard", "block"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((s, b) for batch in batches for s, b in zip(batch.column("shard").to_pylist(), batch.column("block").to_pylist()))
        for _, group in itertools.groupby(pairs, key=lambda pair: pair[0]):
            sides: tuple[list, list] = ([], [])
            for _, data in group:
                body = zstandard.ZstdDecompressor().decompress(data[1:])
                k = len(body) // 24
                columns = [np.frombuffer(body, "<u8", k), np.frombuffer(body, "<u8", k, 8 * k), np.frombuffer(body, "<i8", k, 16 * k)]
                sides[data[0]].append(columns)
            if sides[0] and sides[1]:
                listed, asked = (tuple(np.concatenate(c) for c in zip(*side)) for side in sides)
                node, root = local_roots(*bucket_links(asked, listed, most_bits))
                hung = node != root
                yield pa.RecordBatch.from_arrays([pa.array(node[hung]), pa.array(root[hung])], names=["u", "v"])

    dealt = rows.select("node", "fp").mapInArrow(ask, "shard int, block binary")
    return dealt.repartition(min(shards, MOST_TASKS), "shard").sortWithinPartitions("shard").mapInArrow(meet, "u long, v long")


def near_duplicates(docs: DataFrame, most_bits: int = MOST_BITS, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint and component_id of every document of ``docs`` (doc_id, text).

    A component holds the documents that chains of links of at most
    ``most_bits`` differing bits join; its id is its smallest doc_id. A null or
    blank text has fingerprint zero and is linked like any other. Rows with one
    fingerprint, repeated rows included, are one node of the search.
    """
    marked = settle(fingerprints(docs, shingle, seed))
    nodes = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("node")).filter("node is not null"))
    n = nodes.count()
    parts = task_count(n, 200_000)
    joined = components(links(nodes.repartition(parts, "fp"), n, most_bits)) if n > 1 else None
    named = nodes.withColumn("component", F.col("node"))
    if joined is not None:
        named = nodes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    found = lookup(marked, named.select("fp", "component"), ["fp"], ["doc_id"], "left")
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def keep_one(docs: DataFrame, most_bits: int = MOST_BITS, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """One row of ``docs`` (doc_id, text and any others) per component: that of the smallest doc_id.

    Rows are told apart by a number of their own, not by doc_id, so unlike texts
    with one id, or without any, are judged each. Of several rows with the
    smallest id the one with the smallest digest of its text stays, of rows
    alike in both any one. Rows without a doc_id come behind all others. A null
    or blank text has fingerprint zero, so one such row stays. Columns of any
    name are kept as they are; an empty table stays empty.
    """
    numbered = settle(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("number")))
    groups = settle(near_duplicates(numbered.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text")), most_bits, shingle, seed))
    own = F.col("row.doc_id")
    place = F.struct(own.isNull().alias("lost"), own.alias("id"), F.md5("row.text").alias("digest"), "number")
    ranked = numbered.select("number", place.alias("place")).join(groups.select(F.col("doc_id").alias("number"), "component_id"), "number")
    kept = ranked.groupBy("component_id").agg(F.min("place").alias("place")).select(F.col("place.number").alias("number"))
    return numbered.join(kept, "number", "left_semi").select("row.*")
