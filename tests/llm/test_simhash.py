"""Near-duplicate groups against all pairs."""

import re

import numpy as np
import pytest
import xxhash

from tallyloom.llm import graphs, simhash

from .conftest import documents


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    parts = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(part, 42) for part in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps, ids, most=4):
    above = {i: i for i in ids}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    values = np.array(fps, dtype=np.uint64)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= most) + i + 1:
            a, b = top(ids[i]), top(ids[j])
            above[max(a, b)] = min(a, b)
    return [top(i) for i in ids]


@pytest.mark.parametrize("large", [simhash.LARGE_BUCKET, 1])
def test_groups_equal_those_of_all_pairs(spark, messy, corpus, large, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE_BUCKET", large)
    docs = corpus.select("doc_id", "text").unionByName(messy.filter("doc_id is null or doc_id > 3").selectExpr("doc_id + 5000 as doc_id", "text"))
    found = simhash.near_duplicates(docs).collect()
    rows = [(row.doc_id, plain_fingerprint(row.text)) for row in docs.collect()]
    known = sorted({(doc, fp) for doc, fp in rows if doc is not None})
    groups = dict(zip([doc for doc, _ in known], plain_groups([fp for _, fp in known], [doc for doc, _ in known])))
    assert len(found) == len(rows)
    for row in found:
        if row.doc_id is not None:
            assert row.component_id == groups[row.doc_id]
            assert (row.doc_id, int(row.fingerprint, 16)) in known and len(row.fingerprint) == 16


def close_fingerprints(n, seed):
    """Clusters, chains and single fingerprints."""
    dice = np.random.default_rng(seed)
    centres = dice.integers(0, 2**63, 20, dtype=np.uint64)
    out = []
    for i in range(n):
        fp = centres[dice.integers(0, 20)] if i % 3 else dice.integers(0, 2**63, dtype=np.uint64)
        for b in dice.integers(0, 64, dice.integers(0, 7)):
            fp ^= np.uint64(1) << np.uint64(b)
        out.append(fp)
    return np.unique(np.array(out, dtype=np.uint64))


@pytest.mark.parametrize("parts", [1, 2, 3, 4, 5])
@pytest.mark.parametrize("most", [0, 2, 4])
def test_search_misses_no_link_whatever_the_parts(parts, most):
    if parts == 1 and most > 2:
        pytest.skip("asks for too many values")
    fps = close_fingerprints(600, most)
    bits = simhash.bits_of(fps).astype(float)
    groups = simhash.group_bits((bits.T @ bits), len(fps), parts)
    assert sorted(b for part in groups for b in part) == list(range(64))
    histograms = [
        [np.bincount(simhash.part_value(fps, piece).astype(np.int64), minlength=1 << len(piece)) for piece in simhash._pieces(part)]
        for part in groups
    ]
    plan = simhash.Plan(groups, histograms, len(fps), most)
    chosen = plan.thresholds(fps)
    assert (chosen.sum(axis=1) == most - parts + 1).all()
    nodes = np.arange(len(fps))
    asked, listed = [], []
    for p, part in enumerate(groups):
        value = simhash.part_value(fps, part)
        mark = np.uint64(p) << np.uint64(58)
        listed.append((value | mark, fps, nodes))
        for t in range(plan.flips + 1):
            own = np.flatnonzero(chosen[:, p] == t)
            ways = simhash.masks(len(part), t)
            keys = (value[own][:, None] ^ ways[None, :]).reshape(-1) | mark
            asked.append((keys, np.repeat(fps[own], len(ways)), np.repeat(nodes[own], len(ways))))
    sides = [tuple(np.concatenate(c) for c in zip(*side)) for side in (asked, listed)]
    a, b = simhash.bucket_links(*sides, most)
    found = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist()) if x != y}
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :])
    expected = {(i, j) for i, j in zip(*np.nonzero(apart <= most)) if i < j}
    assert found == expected


def test_a_large_bucket_is_joined_without_its_pairs():
    fps = close_fingerprints(900, 3)
    a, b = simhash._widen(fps, fps, 4)
    assert len(a) <= 2 * len(fps)
    node, root = graphs.local_roots(a, b)
    joined = dict(zip(node.tolist(), root.tolist()))
    assert [joined.get(i, i) for i in range(len(fps))] == plain_groups(fps, list(range(len(fps))))


def test_components_of_chains_stars_and_cycles(spark):
    dice = np.random.default_rng(0)
    pairs = [(i, i + 1) for i in range(0, 200)] + [(1000, i) for i in range(1001, 1300)] + [(5, 5)]
    pairs += [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)] + [tuple(dice.integers(3000, 3100, 2)) for _ in range(60)]
    dice.shuffle(pairs)
    found = graphs.components(spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "a long, b long")).collect()
    nodes = sorted({int(x) for pair in pairs for x in pair})
    above = {x: x for x in nodes}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in pairs:
        a, b = top(int(a)), top(int(b))
        above[max(a, b)] = min(a, b)
    joined = {row.node: row.component for row in found}
    assert {x: joined.get(x, x) for x in nodes} == {x: top(x) for x in nodes}
    assert graphs.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_of_each_group_stays_with_all_columns(spark, messy, nothing):
    kept = simhash.keep_one(messy)
    assert kept.columns == messy.columns
    rows = kept.collect()
    # Null, empty and blank texts are one group; so are the repeated texts, and "one" with and without an id.
    assert sorted(row.doc_id for row in rows) == [0, 3, 4, 6, 7]
    assert simhash.keep_one(nothing).collect() == []
    lost = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (None, "q r s t u v")], "doc_id long, text string")
    assert sorted(row.text for row in simhash.keep_one(lost).collect()) == ["a b c d e", "q r s t u v"]
    assert simhash.near_duplicates(documents(spark, ["alone"])).collect()[0].component_id == 0


def test_rows_with_one_id_are_judged_each(spark):
    schema = "doc_id long, text string, `__own` string, number int, `row` string, place string"
    texts = [(5, "alpha beta gamma delta epsilon zeta"), (5, "one two three four five six seven"), (6, "alpha beta gamma delta epsilon zeta"), (5, None), (7, "")]
    rows = spark.createDataFrame([(i, t, f"own{k}", k, "r", "p") for k, (i, t) in enumerate(texts)], schema)
    kept = simhash.keep_one(rows)
    assert kept.columns == rows.columns
    assert sorted((row.doc_id, row["__own"]) for row in kept.collect()) == [(5, "own0"), (5, "own1"), (5, "own3")]


@pytest.mark.parametrize("most", [1, 4, 8, 12, 16, 20])
@pytest.mark.parametrize("n", [10, 10**6, 10**9, 10**12])
def test_chosen_parts_reach_the_distance(most, n):
    parts = simhash.choose_parts(n, most)
    assert 0 <= most - parts + 1 <= simhash.MOST_FLIPS * parts


def test_wide_distances(spark):
    fps = close_fingerprints(120, 12)
    nodes = spark.createDataFrame([(i, int(fp.astype(np.int64))) for i, fp in enumerate(fps)], "node long, fp long")
    found = graphs.components(simhash.links(nodes, 10**6, 10)).collect()
    joined = {row.node: row.component for row in found}
    assert [joined.get(i, i) for i in range(len(fps))] == plain_groups(fps, list(range(len(fps))), 10)


def template_fingerprints(n, seed):
    """Fingerprints of which a third agree in half of their bits, many of them a few bits apart."""
    dice = np.random.default_rng(seed)
    low = np.uint64(2**32 - 1)
    same = dice.integers(0, 2**63, dtype=np.uint64) & low
    centres = (dice.integers(0, 2**63, n // 6, dtype=np.uint64) & ~low) | same
    out = [*centres, *dice.integers(0, 2**63, n - 2 * len(centres), dtype=np.uint64)]
    for fp in centres:
        for b in dice.choice(64, dice.integers(1, 7), replace=False):
            fp ^= np.uint64(1) << np.uint64(b)
        out.append(fp)
    return np.unique(np.array(out, dtype=np.uint64))


@pytest.mark.parametrize("most, parts", [(1, 2), (4, 4), (4, 3), (4, 2), (6, 5)])
def test_hot_buckets_are_dealt_again_without_loss(spark, monkeypatch, most, parts):
    fps = template_fingerprints(1500, most)
    nodes = spark.createDataFrame([(i, int(fp.astype(np.int64))) for i, fp in enumerate(fps)], "node long, fp long")
    monkeypatch.setattr(simhash, "choose_parts", lambda n, most_bits: parts)
    monkeypatch.setattr(simhash, "HOT_ROWS", 20)
    monkeypatch.setattr(simhash, "MOST_HOT", 10**12)
    seen, plain = [], simhash.hot_values

    def spy(rows, plan):
        found = plain(rows, plan)
        for p, bits in enumerate(plan.parts):
            value, size = np.unique(simhash.part_value(fps, bits), return_counts=True)
            marks = found[0] >> np.uint64(58) == p
            assert np.array_equal(found[0][marks] & np.uint64(2**58 - 1), value[size > 20])
        seen.append(found)
        return found

    monkeypatch.setattr(simhash, "hot_values", spy)
    found = graphs.components(simhash.links(nodes, len(fps), most)).collect()
    joined = {row.node: row.component for row in found}
    assert [joined.get(i, i) for i in range(len(fps))] == plain_groups(fps, list(range(len(fps))), most)
    assert len(seen[0][0]) and seen[0][1] > len(fps) // 8


def test_a_hot_bucket_becomes_many_small_ones():
    fps = template_fingerprints(6000, 5)
    plan = simhash.Plan([list(range(16)), list(range(16, 32)), list(range(32, 48)), list(range(48, 64))], [[], [], [], []], len(fps), 4)
    value, size = np.unique(simhash.part_value(fps, plan.parts[0]), return_counts=True)
    plan.hot = value[size > 100]
    bucket, dealt, nodes = plan.deal(simhash.part_value(fps, plan.parts[0]), 0, fps, np.arange(len(fps)))
    hot = int(size[size > 100].sum())
    assert len(bucket) == len(fps) + 4 * hot and np.array_equal(fps[nodes], dealt)
    assert np.unique(bucket, return_counts=True)[1].max() < size.max() / 20
