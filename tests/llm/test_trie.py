import hashlib
import random
import zlib

import pytest

from tallyloom.llm import trie

TABLE = "conv_id long, turn long, role string, text string, key string, depth int, n_convs string"


def table(spark, rows):
    return spark.createDataFrame([(*row, "x", 1, "y") for row in rows], TABLE).repartition(4)


def mark(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def plain(rows):
    """The trie by dictionaries of whole beginnings."""
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns.setdefault(conv, []).append(((turn is not None, turn or 0, role, mark(role, text)), (role, text)))
    turns = {conv: [t for _, t in sorted(found)] for conv, found in turns.items()}
    whole = {}
    for conv, own in turns.items():
        h = zlib.crc32(str(conv).encode()) % 6
        first = conv - (conv % 100 if conv >= 0 else -(-conv % 100))
        whole[conv] = turns.get(first, [])[:h] + own[h:]
    members = {}
    for conv, path in whole.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(conv)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    totals = {}
    for path in sorted(members, key=len, reverse=True):
        below = [totals[c] for c in children.get(path, [])]
        saved = (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        totals[path] = (sum(b[0] for b in below) or 1, saved + sum(b[1] for b in below))
    out = set()
    for path, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(whole[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.add(
            (min(convs), len(path), parent, len(convs), len(children.get(path, [])), *totals[path], hashlib.sha256(ends.encode()).hexdigest())
        )
    return out


def drawn(seed, convs=250, words=3):
    draw = random.Random(seed)
    rows = []
    for _ in range(convs):
        conv = draw.choice([draw.randrange(400), draw.randrange(10**9), -draw.randrange(300)])
        for turn in range(draw.randrange(1, 9)):
            rows.append((conv, draw.choice([turn, turn, None]), draw.choice(["user", "assistant", None]), draw.choice(["a", "bb", None, "é"][:words])))
    return rows


@pytest.mark.parametrize("limits", [(200_000, 64), (200_000, 1), (5, 1), (200_000, 10**6)])
def test_against_dictionaries(spark, limits):
    rows = drawn(1) + [(1234500, t, "user", "hot") for t in range(120)]
    rows += [(conv, 0, "user", "same") for conv in range(2000, 2300)]
    found = trie.conversation_trie(table(spark, rows), most_heavy=limits[0], least_heavy=limits[1])
    got = [tuple(row) for row in found.collect()]
    assert set(got) == plain(rows) and len(got) == len(set(got))


def test_one_conversation_and_none(spark):
    rows = [(3, 0, "user", "x")]
    assert {tuple(row) for row in trie.conversation_trie(table(spark, rows)).collect()} == plain(rows)
    assert trie.conversation_trie(table(spark, rows).filter("false")).collect() == []


def test_rows_without_a_conversation_and_repeated_rows(spark):
    rows = [(100, 0, "user", "x"), (100, 0, "user", "x"), (100, 1, None, None), (101, None, "user", "x" * 300_000)]
    lost = [(None, 0, "user", "y")] * 3
    got = {tuple(row) for row in trie.conversation_trie(table(spark, rows + lost)).collect()}
    assert got == plain(rows) == plain(rows + lost)


def test_rebuilt_conversation_without_turns(spark):
    conv = next(c for c in range(101, 1000) if c % 100 and zlib.crc32(str(c).encode()) % 6 == 5)
    rows = [(conv, 0, "user", "gone")]
    ends = hashlib.sha256(str(conv).encode()).hexdigest()
    assert [tuple(row) for row in trie.conversation_trie(table(spark, rows)).collect()] == [(conv, 0, None, 1, 0, 1, 0, ends)]


@pytest.mark.parametrize("limit", [1, 7, 1000])
def test_queue_spills_and_sorts(limit):
    draw = random.Random(limit)
    queue, kept, popped = trie.SpillingQueue(limit), [], []
    queue.CHUNK = 3
    for _ in range(2000):
        if draw.random() < 0.6 or not kept:
            item = (draw.randrange(50), draw.randrange(5))
            queue.push(item)
            kept.append(item)
        else:
            assert queue.peek() == min(kept)
            popped.append(queue.pop())
            kept.remove(popped[-1])
    while queue.peek() is not None:
        popped.append(queue.pop())
        kept.remove(popped[-1])
    assert not kept and (len(queue.files) > 0) == (limit < 1000)
    queue.close()


def test_forward_with_a_tiny_queue():
    """A wide and a deep tree: a queue of three messages gives the totals that a large one gives."""
    nodes = [(trie.ROOT, None, 0, 0, 10, 0)]
    nodes += [(bytes([1, i]), trie.ROOT, 1, 2, 3, i) for i in range(100)]
    nodes += [(bytes([2, i]), bytes([1, i // 2]), 2, 5, 2, i) for i in range(200)]
    rows = sorted(nodes, key=lambda n: (-n[2], n[0]))
    small = list(trie.forward(((*row, 0, 0, 0) for row in rows), limit=3))
    assert small == list(trie.forward((*row, 0, 0, 0) for row in rows))
    assert small[-1][-3:] == (100, 200, 100 * 2 * 2 + 200 * 5)


def test_long_lists_of_ids_are_hashed_in_pieces(spark):
    rows = [(conv, "k", True) for conv in range(0, 3000, 7)]
    members = spark.createDataFrame(rows, "conv long, k string, ends boolean").selectExpr("conv", "cast(k as binary) as key", "ends")
    got = trie.end_digests(members, chars=10).collect()
    want = hashlib.sha256(",".join(str(c) for c, _, _ in rows).encode()).hexdigest()
    assert [row.ends_sha256 for row in got] == [want]
