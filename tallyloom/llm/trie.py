"""A trie of conversations: which ones begin alike, and what every shared beginning saves.

Turns become narrow rows (hash, length) where they are read, so texts never move.
A node is named by the chained hash of the turns on its path. Nodes come from one
aggregate over all beginnings of all conversations.

Totals of subtrees are found by time-forward processing: nodes are sorted by
reverse level order, so that every child comes before its parent, and a child
sends its totals to its parent through a priority queue that is ordered as the
nodes are and spills sorted runs to disk. Nodes with many members, at most
``MOST_HEAVY`` of them by their definition, are the upper part of the trie. Cut
off below it, the trie falls into shards: every subtree whose root has few
members while its parent has many. Shards are processed side by side; the totals
of their roots are added up per parent, and the upper part is processed last.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator
from functools import partial
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import settle

#: Nodes of the upper part at most. A node belongs to it if its members are more
#: than this share of all beginnings, so there cannot be more.
MOST_HEAVY = 200_000
#: No node with so few members belongs to the upper part.
LEAST_HEAVY = 64
#: Messages that a queue keeps in memory.
QUEUE_ITEMS = 200_000
#: Rows of a shard that one task should process, and rows returned together.
TASK_NODES, BATCH_ROWS = 500_000, 10_000
#: Characters of ids that are hashed together.
ID_CHARS = 1 << 20

#: The name of the root.
ROOT = bytes(16)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


class SpillingQueue:
    """A priority queue of tuples; more than ``limit`` of them go to disk as sorted runs.

    Runs are read back a chunk at a time. Files have no name and are gone when
    the queue is closed, or with the process.
    """

    CHUNK = 1000

    def __init__(self, limit: int = QUEUE_ITEMS):
        self.limit = limit
        self.heap: list[tuple] = []
        self.heads: list[tuple[tuple, int]] = []
        self.runs: list[Iterator[tuple]] = []
        self.files: list[BinaryIO] = []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            self._spill()

    def _spill(self) -> None:
        self.heap.sort()
        file = tempfile.TemporaryFile()
        for start in range(0, len(self.heap), self.CHUNK):
            pickle.dump(self.heap[start : start + self.CHUNK], file)
        file.seek(0)
        self.heap = []
        self.files.append(file)
        self.runs.append(self._read(file))
        self._advance(len(self.runs) - 1)

    @staticmethod
    def _read(file: BinaryIO) -> Iterator[tuple]:
        while True:
            try:
                chunk = pickle.load(file)
            except EOFError:
                file.close()
                return
            yield from chunk

    def _advance(self, run: int) -> None:
        item = next(self.runs[run], None)
        if item is not None:
            heapq.heappush(self.heads, (item, run))

    def peek(self) -> tuple | None:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            return self.heads[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            item, run = heapq.heappop(self.heads)
            self._advance(run)
            return item
        return heapq.heappop(self.heap)

    def close(self) -> None:
        for file in self.files:
            file.close()


NODE = "key binary, parent binary, depth long, chars long, n_convs long, conv_id long"
TOTALS = "n_children long, n_leaves long, saved_tokens long"


NAMES = ["key", "parent", "depth", "chars", "n_convs", "conv_id", "n_children", "n_leaves", "saved_tokens"]


def forward(rows: Iterator[tuple], limit: int = QUEUE_ITEMS) -> Iterator[tuple]:
    """Every node with its children, leaves and saved characters, its subtree counted.

    ``rows`` have the columns of ``NAMES``, by falling depth and rising key; the
    last three hold what arrived from other shards. A message to a parent that
    does not come, as it belongs to another shard, is passed over.
    """
    queue = SpillingQueue(limit)
    for key, parent, depth, chars, n_convs, conv_id, children, leaves, saved in rows:
        at = (-depth, key)
        while (first := queue.peek()) is not None and first[:2] <= at:
            message = queue.pop()
            if message[:2] == at:
                children += 1
                leaves += message[2]
                saved += message[3]
        leaves = leaves if children else 1
        if depth:
            saved += (n_convs - 1) * chars
            queue.push((1 - depth, parent, leaves, saved))
        yield key, parent, depth, chars, n_convs, conv_id, children, leaves, saved
    queue.close()


def _process(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``forward`` over the sorted rows of a partition."""
    kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 7]
    rows = (row for batch in batches for row in zip(*(batch.column(name).to_pylist() for name in NAMES)))
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*held), kinds)], names=NAMES)
        held.clear()
        return out

    for row in forward(rows):
        held.append(row)
        if len(held) >= BATCH_ROWS:
            yield flush()
    if held:
        yield flush()


def shared_turns(conversation: Column) -> Column:
    """How many first turns a conversation takes from the first one of its hundred."""
    return F.crc32(conversation.cast("string").cast("binary")) % 6


def turn_rows(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """Narrow rows: ``conv``, ``place`` from 1, ``mark`` (hash of role and text), ``chars``."""
    said, who = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    mark = F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said), 256)
    rows = turns.select(
        F.col(conversation).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        who.alias("role"),
        F.unhex(F.left(mark, F.lit(32))).alias("mark"),
        F.length(said).cast("long").alias("chars"),
    ).filter(F.col("conv").isNotNull())
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "mark")
    return rows.select("conv", F.row_number().over(order).cast("long").alias("place"), "mark", "chars")


def rebuild(rows: DataFrame) -> DataFrame:
    """Turns of the rebuilt conversations: ``conv``, ``part``, ``place``, ``mark``, ``chars``.

    Sorted by part and place they follow each other; part 0 is one row without
    a mark per conversation, so that one without turns is there as well.
    """
    convs = rows.filter("place = 1").select("conv")
    own = rows.filter(F.col("place") > shared_turns(F.col("conv"))).select("conv", F.lit(2).alias("part"), "place", "mark", "chars")
    # At most five turns of a first conversation meet at most a hundred others.
    wanted = convs.select("conv", (F.col("conv") - F.col("conv") % 100).alias("first"), shared_turns(F.col("conv")).alias("h"))
    firsts = rows.filter((F.col("place") <= 5) & (F.col("conv") % 100 == 0)).withColumnRenamed("conv", "first")
    taken = wanted.join(firsts, "first").filter(F.col("place") <= F.col("h"))
    taken = taken.select("conv", F.lit(1).alias("part"), "place", "mark", "chars")
    empty = F.lit(None)
    tops = convs.select("conv", F.lit(0).alias("part"), F.lit(0).cast("long").alias("place"), empty.cast("binary").alias("mark"), F.lit(0).cast("long").alias("chars"))
    return tops.unionByName(taken).unionByName(own)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of all beginnings of the conversations of a partition, sorted by conversation and place."""
    held: list[list[Any]] = [[] for _ in range(6)]
    last: tuple | None = None
    for batch in batches:
        convs, marks, chars = (batch.column(name).to_pylist() for name in ("conv", "mark", "chars"))
        for conv, mark, size in zip(convs, marks, chars):
            if last is not None:
                for values, value in zip(held, (*last, mark is None)):
                    values.append(value)
            if mark is None:
                last = (conv, 0, ROOT, None, 0)
            else:
                _, depth, key, _, _ = last
                last = (conv, depth + 1, hashlib.sha256(key + mark).digest()[:16], key, size)
        if len(held[0]) >= BATCH_ROWS:
            yield _beginnings(held)
    if last is not None:
        for values, value in zip(held, (*last, True)):
            values.append(value)
    if held[0]:
        yield _beginnings(held)


BEGINNING = "conv long, depth long, key binary, parent binary, chars long, ends boolean"


def _beginnings(held: list[list[Any]]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
    names = ["conv", "depth", "key", "parent", "chars", "ends"]
    out = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(held, kinds)], names=names)
    for values in held:
        values.clear()
    return out


def beginnings(rebuilt: DataFrame) -> DataFrame:
    """One row per conversation and depth: name of the node, of its parent, length of the last turn, whether it ends there."""
    ordered = rebuilt.repartition("conv").sortWithinPartitions("conv", "part", "place")
    return ordered.select("conv", "mark", "chars").mapInArrow(_chain, BEGINNING)


def _join_ids(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one key, sorted, as texts of about ``chars`` characters."""
    key, first, ids, held = None, 0, [], 0
    out: list[tuple] = []
    for batch in batches:
        for found, conv in zip(batch.column("key").to_pylist(), batch.column("conv").to_pylist()):
            text = str(conv)
            if found != key or held > chars:
                if ids:
                    out.append((key, first, ",".join(ids)))
                key, first, ids, held = found, conv, [], 0
            ids.append(text)
            held += len(text) + 1
            if len(out) >= BATCH_ROWS or out and held > chars:
                yield _texts(out)
    if ids:
        out.append((key, first, ",".join(ids)))
    if out:
        yield _texts(out)


def _texts(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out))
    out.clear()
    kinds = [pa.binary(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], names=["key", "first", "ids"])


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per key over its texts, which come sorted by key and first id."""
    key, digest = None, hashlib.sha256()
    keys: list[bytes] = []
    digests: list[str] = []
    for batch in batches:
        for found, text in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if found == key:
                digest.update(b",")
            else:
                if key is not None:
                    keys.append(key)
                    digests.append(digest.hexdigest())
                key, digest = found, hashlib.sha256()
            digest.update(text.encode())
        if len(keys) >= BATCH_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests)], names=["key", "ends_sha256"])
            keys, digests = [], []
    if key is not None:
        keys.append(key)
        digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests)], names=["key", "ends_sha256"])


def end_digests(members: DataFrame, chars: int = ID_CHARS) -> DataFrame:
    """``key, ends_sha256`` for every node that conversations end at.

    Ids are joined to long texts where a sort by node and id leaves them, so a
    node with most of the conversations is spread over tasks; what one task has
    to hash in a row are few long texts, never held together.
    """
    ended = members.filter("ends").select("key", "conv")
    texts = ended.orderBy("key", "conv").mapInArrow(partial(_join_ids, chars=chars), "key binary, first long, ids string")
    return texts.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hash_ids, "key binary, ends_sha256 string")


def conversation_trie(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    most_heavy: int = MOST_HEAVY,
    least_heavy: int = LEAST_HEAVY,
) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations.

    Turns are ordered by ``turn`` (null first), ties by role and hash of the
    text; repeated rows are turns of their own. A null role or text is empty.
    Rows without a conversation belong to none and are left out; ids are
    compared and printed as whole numbers. Without any conversation there is no
    node, not even the root. Other columns are left out.

    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.
    """
    # Hashed once: names decide where rows go, and a text is read only here.
    narrow = settle(turn_rows(turns, conversation, turn, role, text))
    members = settle(beginnings(rebuild(narrow)))
    nodes = settle(
        members.groupBy("key").agg(
            F.any_value("parent").alias("parent"),
            F.any_value("depth").alias("depth"),
            F.any_value("chars").alias("chars"),
            F.count(F.lit(1)).alias("n_convs"),
            F.min("conv").alias("conv_id"),
        )
    )
    total, count = nodes.agg(F.coalesce(F.sum("n_convs"), F.lit(0)), F.count(F.lit(1))).first()
    few = max(least_heavy, total // most_heavy)
    # Fewer than most_heavy keys: each stands for more than total / most_heavy beginnings.
    heavy = F.broadcast(nodes.filter(F.col("n_convs") > few).select("key", F.lit(True).alias("heavy")))
    light = members.join(heavy, "key", "left_anti")
    shards = light.groupBy("conv").agg(F.min_by("key", "depth").alias("shard")).withColumnRenamed("conv", "conv_id")
    nothing = [F.lit(0).cast("long").alias(name) for name in ("n_children", "n_leaves", "saved_tokens")]
    below = nodes.filter(F.col("n_convs") <= few).join(shards, "conv_id").select("*", *nothing)
    tasks = max(1, -(-count // TASK_NODES), min(count // 1000, turns.sparkSession.sparkContext.defaultParallelism))
    done = settle(
        below.repartition(tasks, "shard")
        .sortWithinPartitions(F.desc("depth"), "key")
        .drop("shard")
        .mapInArrow(_process, f"{NODE}, {TOTALS}")
    )
    sent = done.join(heavy.withColumnRenamed("key", "parent"), "parent").groupBy("parent").agg(
        F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")
    )
    received = [F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in ("n_children", "n_leaves", "saved_tokens")]
    own = ["key", "parent", "depth", "chars", "n_convs", "conv_id"]
    above = nodes.filter(F.col("n_convs") > few).join(sent.withColumnRenamed("parent", "key"), "key", "left").select(*own, *received)
    # One task for at most most_heavy narrow rows.
    upper = above.repartition(1).sortWithinPartitions(F.desc("depth"), "key").mapInArrow(_process, f"{NODE}, {TOTALS}")
    whole = settle(done.unionByName(upper))
    return _described(whole, members, few)


def _described(whole: DataFrame, members: DataFrame, few: int) -> DataFrame:
    """Add the parent's conversation and the digest of the members that end at a node.

    Parents with many children have many members, so they are few and looked
    up by a broadcast; the others have few children each.
    """
    names = whole.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_convs")
    large = F.broadcast(names.filter(F.col("n_convs") > few).select("parent", F.col("parent_conv_id").alias("large_id")))
    small = names.filter(F.col("n_convs") <= few).select("parent", F.col("parent_conv_id").alias("small_id"))
    found = whole.join(large, "parent", "left")
    # Children of large parents and the root have no partner among the small; a key of their own spreads them.
    loose = F.col("large_id").isNotNull() | F.col("parent").isNull()
    found = found.withColumn("asked", F.when(loose, F.col("key")).otherwise(F.col("parent")))
    found = found.join(small.withColumnRenamed("parent", "asked"), "asked", "left")
    found = found.withColumn("parent_conv_id", F.coalesce("large_id", F.when(~loose, F.col("small_id"))))
    return found.join(end_digests(members), "key", "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )


#: The rows of the query in DuckDB. crc32 is not among its functions and is worked out bit by bit.
ORACLE = """
with convs as (select distinct conv_id as c from conversations where conv_id is not null),
shares as (
  select c, xor(list_reduce(
      list_transform(regexp_extract_all(c::varchar, '.'), lambda digit: ord(digit)::bigint),
      lambda crc, byte: list_reduce(
        range(8), lambda x, bit: xor(x >> 1, (x & 1) * 3988292384::bigint), xor(crc, byte)),
      4294967295::bigint), 4294967295::bigint) % 6 as h
  from convs
),
turns as (
  select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''),
      left(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32)) as place
  from conversations where conv_id is not null
),
rebuilt as (
  select s.c, 1 as part, t.place, t.role, t.text from shares s join turns t on t.c = s.c - s.c % 100 and t.place <= s.h
  union all
  select s.c, 2, t.place, t.role, t.text from shares s join turns t on t.c = s.c and t.place > s.h
),
placed as (
  select c, row_number() over (partition by c order by part, place) as depth,
    sha256(strlen(role) || ':' || role || text) as mark, length(text) as chars
  from rebuilt
),
listed as (
  select s.c, coalesce(list(p.mark order by p.depth) filter (p.mark is not null), []) as marks,
    coalesce(list(p.chars order by p.depth) filter (p.mark is not null), []) as sizes
  from shares s left join placed p on p.c = s.c group by s.c
),
members as (
  select c, unnest(range(len(marks) + 1)) as depth, marks, sizes from listed
),
beginnings as (
  select c, depth, sha256(array_to_string(marks[1:depth], ',')) as key,
    case when depth > 0 then sha256(array_to_string(marks[1:depth - 1], ',')) end as parent,
    case when depth > 0 then sizes[depth] else 0 end as chars, depth = len(marks) as ends
  from members
),
nodes as (
  select key, depth, any_value(parent) as parent, any_value(chars) as chars, count(*) as n_convs, min(c) as conv_id,
    sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (ends), '')) as ends_sha256
  from beginnings group by key, depth
),
children as (select parent as key, depth - 1 as depth, count(*) as n_children from nodes where depth > 0 group by 1, 2),
above as (
  select n.key as low, n.depth as low_depth, b.key, b.depth, n.n_convs, n.chars
  from nodes n join beginnings b on b.c = n.conv_id and b.depth <= n.depth
),
totals as (
  select a.key, a.depth, count(*) filter (k.key is null) as n_leaves,
    sum(case when a.low_depth > 0 then (a.n_convs - 1) * a.chars else 0 end) as saved_tokens
  from above a left join children k on k.key = a.low and k.depth = a.low_depth
  group by a.key, a.depth
)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs,
  coalesce(k.n_children, 0) as n_children, t.n_leaves, t.saved_tokens::bigint as saved_tokens, n.ends_sha256
from nodes n
join totals t on t.key = n.key and t.depth = n.depth
left join children k on k.key = n.key and k.depth = n.depth
left join nodes p on p.key = n.parent and p.depth = n.depth - 1
"""
