"""Leaks and nearest neighbours against plain search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import leaks, neighbours


def plain_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_common_subsequences():
    dice = random.Random(0)
    for _ in range(300):
        a, b = ([dice.randrange(5) for _ in range(dice.randrange(30))] for _ in range(2))
        assert leaks.common_subsequence(a, b) == plain_subsequence(a, b)


def test_windows_cover_all_words():
    sizes = np.array([0, 1, 16, 17, 32, 33, 48, 49, 500])
    owner, first, end = leaks.windows(sizes)
    base = np.cumsum(sizes) - sizes
    for i, n in enumerate(sizes):
        own = np.flatnonzero(owner == i)
        seen = {w for k in own for w in range(first[k] - base[i], end[k] - base[i])}
        assert seen == set(range(n)) and all(end[own] - first[own] <= leaks.WINDOW)


def test_basis_spans_the_rows_of_small_and_the_best_of_large_matrices():
    dice = np.random.default_rng(0)
    small = dice.normal(size=(6, 40))
    basis = leaks.randomised_basis(small, rank=10)
    assert np.allclose(small @ basis @ basis.T, small)
    left, right = np.linalg.qr(dice.normal(size=(200, 30)))[0], np.linalg.qr(dice.normal(size=(300, 30)))[0]
    large = left @ np.diag(2.0 ** -np.arange(30)) @ right.T
    basis = leaks.randomised_basis(large, rank=8)
    assert basis.shape == (300, 8)
    assert np.linalg.norm(large - large @ basis @ basis.T, 2) < 1.05 * 2.0**-8


def test_whole_and_paraphrased_passages_are_found(spark, corpus, folder):
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    items = [(row.item_id, row.text) for row in benchmark.collect()]
    docs = [(row.doc_id, row.text) for row in corpus.collect()]
    dice = random.Random(4)
    hidden, planted = [], set()
    for k in range(60):
        item, text = dice.choice(items)
        swapped = [word if dice.random() > (0, 0.1, 0.2)[k % 3] else f"zq{dice.randrange(999)}" for word in text.split()]
        host = dice.choice(docs)[1].split()[:400]
        at = dice.randrange(len(host) + 1)
        hidden.append((10**6 + k, " ".join(host[:at] + swapped + host[at:])))
        planted.add((10**6 + k, item))
    rows = spark.createDataFrame(docs + hidden + [(None, items[0][1]), (7 * 10**6, None), (7 * 10**6 + 1, "")], "doc_id long, text string")
    found = {(row.doc_id, row.item_id) for row in leaks.find_leaks(rows, benchmark, block_items=8).collect()}
    plain = lambda text: " ".join(text.lower().split())
    whole = {(doc, item) for doc, text in docs for item, passage in items if plain(passage) in plain(text)}
    assert whole <= found and planted <= found and (None, items[0][0]) in found
    # Nothing else but documents whose host held a passage already.
    hosts = {plain(text): doc for doc, text in docs}
    others = {pair for pair in found - whole - planted if pair[0] is not None and pair[0] < 10**6}
    assert not others and hosts
    clean = leaks.without_leaks(rows, benchmark)
    assert clean.columns == rows.columns
    leaky = {doc for doc, _ in found}
    assert {row.doc_id for row in clean.collect()} == {doc for doc, _ in docs + hidden} - leaky | {7 * 10**6, 7 * 10**6 + 1}


@pytest.mark.parametrize("block_items", [100, leaks.BLOCK_ITEMS])
def test_long_passages_are_found_whole_and_reworded(spark, block_items):
    dice = np.random.default_rng(5)
    share = 1 / (np.arange(5000) + 10)

    def text(n):
        return [f"w{k}" for k in dice.choice(5000, n, p=share / share.sum())]

    items, docs, planted = [], [], set()
    for k in range(36):
        passage = text((100, 300, 1000)[k % 3])
        items.append((k, " ".join(passage)))
        for doc, replaced in ((100 + k, 0.0), (200 + k, 0.3)):
            swapped = [f"q{dice.integers(20_000)}" if dice.random() < replaced else word for word in passage]
            docs.append((doc, " ".join(text(int(dice.integers(200))) + swapped + text(200))))
            planted.add((doc, k))
    docs += [(1000 + k, " ".join(text(600))) for k in range(40)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = [(row.doc_id, row.item_id) for row in leaks.find_leaks(rows, benchmark, block_items=block_items).collect()]
    assert len(found) == len(set(found)) and planted == {pair for pair in found if pair[0] // 100 < 10 and pair[1] == pair[0] % 100}
    assert sorted(row.doc_id for row in leaks.without_leaks(rows, benchmark, block_items).filter("doc_id < 1000").collect()) == []


def test_word_frequencies_in_one_and_in_two_steps(corpus, monkeypatch):
    from tallyloom.llm.words import hash_words

    texts = [row.text.encode() for row in corpus.collect()]
    expected = np.bincount((hash_words(texts)[0] >> np.uint64(64 - leaks.BUCKET_BITS)).astype(int), minlength=1 << leaks.BUCKET_BITS)
    assert np.array_equal(leaks.word_frequencies(corpus), expected)
    monkeypatch.setattr(leaks, "MERGED_TASKS", 2)
    assert np.array_equal(leaks.word_frequencies(corpus.repartition(7)), expected)


def test_leak_edges(spark, messy, nothing):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "the same words twice"), (3, "the same words twice")], "item_id long, text string")
    found = sorted((row.doc_id, row.item_id) for row in leaks.find_leaks(messy, items).collect())
    assert set(found) == {(4, 3), (5, 3)}
    assert leaks.find_leaks(nothing, items).collect() == []
    assert leaks.find_leaks(messy, items.filter("false")).collect() == []
    assert leaks.without_leaks(messy, items.filter("false")).count() == messy.count()
    assert leaks.without_leaks(messy, items).columns == messy.columns


def plain_nearest(ids, vectors, k=5):
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        score = units @ units[i]
        score[ids == ids[i]] = -9
        out[int(ids[i])] = [(int(ids[j]), score[j]) for j in np.lexsort((ids, -score.round(13)))[:k] if score[j] > -9]
    return out


def search(vectors):
    return neighbours.nearest(vectors, F.pmod("vec_id", F.lit(50)) == 0)


def test_neighbours_of_tasks_that_hold_few_rows(spark, folder, monkeypatch):
    """A task searches its rows part by part: as good as all at once."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    whole = {(row.query_id, row["rank"]): row.score for row in search(vectors).collect()}
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    monkeypatch.setattr(neighbours, "HELD_ROWS", 100)
    try:
        spark.conf.set(setting, "64")
        parts = {(row.query_id, row["rank"]): row.score for row in search(vectors).collect()}
    finally:
        spark.conf.set(setting, before)
    assert parts.keys() == whole.keys()
    assert sum(parts[key] >= whole[key] - 1e-12 for key in whole) >= 0.95 * len(whole)


@pytest.mark.parametrize("rows_indexed", [128, 8192])
def test_recall_and_scores(spark, folder, rows_indexed, monkeypatch):
    monkeypatch.setattr(neighbours, "INDEX_ROWS", rows_indexed)
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = vectors.collect()
    expected = plain_nearest(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float))
    found = {}
    for row in search(vectors).orderBy("query_id", "rank").collect():
        found.setdefault(row.query_id, []).append((row.vec_id, row.score))
        assert row.rank == len(found[row.query_id])
    hits = total = 0
    for query, near in expected.items():
        total += len(near)
        hits += len({v for v, _ in near} & {v for v, _ in found[query]})
        assert [s for _, s in found[query]] == sorted((s for _, s in found[query]), reverse=True)
    assert set(found) == set(expected) and hits / total >= 0.9


def test_probing_finds_every_code_within_the_radius():
    dice = np.random.default_rng(0)
    codes = dice.integers(0, 256, (500, 32), dtype=np.uint8)
    codes[:50] = codes[0] ^ np.packbits(dice.random((50, 256)) < 0.03, axis=1)
    index = neighbours.MultiIndex(codes)
    for query in (codes[0], codes[200], dice.integers(0, 256, 32, dtype=np.uint8)):
        apart = np.bitwise_count(codes ^ query).sum(axis=1)
        for radius in (0, 5, 20, 100, 120, 256):
            assert index.probe(query, radius).tolist() == np.flatnonzero(apart <= radius).tolist()


def test_ties_bad_vectors_and_few_rows(spark):
    schema = "vec_id long, embedding array<float>, score double, rank int"
    nan = float("nan")
    rows = [(i, [1.0, 2.0, 3.0], None, 1) for i in (0, 3, 4, 9, 7, 8, 12)]
    bad = [(50, None), (100, [0.0, 0.0, 0.0]), (150, [nan, 1.0, 1.0]), (200, [None, 1.0, 1.0]), (250, [1.0]), (None, [1.0, 1.0, 1.0]), (300, [float("inf"), 1.0, 0.0])]
    table = spark.createDataFrame(rows + [(*b, 0.0, 0) for b in bad], schema)
    found = sorted((row.query_id, row.rank, row.vec_id) for row in search(table).collect())
    assert found == [(0, i + 1, v) for i, v in enumerate([3, 4, 7, 8, 9])]
    few = spark.createDataFrame([(0, [1.0, 0.0], None, 0), (1, [0.0, 1.0], None, 0)], schema)
    assert [(r.query_id, r.vec_id, r.score) for r in search(few).collect()] == [(0, 1, 0.0)]
    assert search(few.filter("vec_id = 0")).collect() == []
    assert search(few.filter("false")).collect() == []
    assert search(few.filter("vec_id = 1")).collect() == []


def test_repeated_queries_and_candidates(spark):
    """Every query row has its own five neighbours, among them other rows of its id."""
    dice = np.random.default_rng(11)
    vectors = dice.normal(size=(120, 6)).astype(np.float32).tolist()
    rows = [(i, v, None, 1) for i, v in enumerate(vectors)]
    rows += [(50, vectors[7], None, 1), (100, vectors[100], None, 1), (9, vectors[9], None, 1), (9, vectors[9], None, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, query long, row int").repartition(5)
    found = {}
    for row in search(table).collect():
        found.setdefault(row.query_id, []).append((row.rank, row.vec_id, row.score))
    ids, floats = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    units = floats / np.linalg.norm(floats, axis=1, keepdims=True)
    expected = {}
    for i in np.flatnonzero(ids % 50 == 0):
        score = units @ units[i]
        near = [j for j in np.lexsort((ids, -score.round(12))) if j != i][:5]
        expected.setdefault(int(ids[i]), []).extend((rank + 1, int(ids[j]), round(score[j], 9)) for rank, j in enumerate(near))
    rounded = {query: sorted((rank, v, round(score, 9)) for rank, v, score in near) for query, near in found.items()}
    assert rounded == {query: sorted(near) for query, near in expected.items()}
    assert len(found[50]) == len(found[100]) == 10 and (1, 100, 1.0) in rounded[100]


def test_equal_vectors_tie_wherever_they_are(spark):
    dice = np.random.default_rng(12)
    one = dice.normal(size=64).tolist()
    rows = [(i, one, None, 1) for i in range(1, 900)] + [(1000, dice.normal(size=64).tolist(), None, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double, rank int").repartition(7)
    found = [(row.rank, row.vec_id) for row in search(table).filter("query_id = 1000").collect()]
    assert sorted(found) == [(i, i) for i in range(1, 6)]


def test_latent_space_in_parts_is_that_of_the_whole():
    """Rows dealt into parts give the singular directions that the whole matrix has."""
    dice = np.random.default_rng(1)
    left, right = np.linalg.qr(dice.normal(size=(120, 40)))[0], np.linalg.qr(dice.normal(size=(300, 40)))[0]
    matrix = left @ np.diag(1.5 ** -np.arange(40)) @ right.T
    for parts in (1, 4, 7):
        basis = leaks.randomised_basis(matrix, 10, parts=parts)
        assert np.allclose(basis.T @ basis, np.eye(10), atol=1e-9)
        assert np.allclose(basis @ basis.T, right[:, :10] @ right[:, :10].T, atol=1e-3)


def reworded(items, texts, replaced, seed=7):
    dice = random.Random(seed)
    words = sorted({word for text in texts for word in text.split()})
    planted = []
    for k, (_, text) in enumerate(items):
        swapped = [word if dice.random() >= replaced else dice.choice(words) for word in text.split()]
        host = texts[k * 7 % len(texts)].split()[:300]
        at = dice.randrange(len(host) + 1)
        planted.append(" ".join(host[:at] + swapped + host[at:]))
    return planted


def test_retrieval_in_a_reduced_space_against_all_windows(spark):
    """Rank a quarter of the rows, below the number of passages; all windows and passages are the truth."""
    from tallyloom.llm.words import hash_words

    big = "/root/testdata/sf0.1"
    items = [(row.item_id, row.text) for row in spark.read.parquet(f"{big}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{big}/documents.parquet").limit(1500)
    texts = [row.text for row in docs.collect()]
    idf = leaks.inverse_frequencies(leaks.word_frequencies(docs))
    from tallyloom.session import work_folder

    paths = leaks.build_blocks(spark.createDataFrame(items, "item_id long, text string"), work_folder(spark, "leaks"), idf)
    blocks = [leaks.Block(path) for path in paths]
    assert sum(block.basis.shape[1] for block in blocks) < 0.7 * len(items) < sum(len(block.latent) for block in blocks)
    words = [hash_words([text.encode()])[0].tolist() for _, text in items]
    answers = [set(leaks._answer(text, np.array(own, dtype=np.uint64), idf).tolist()) for (_, text), own in zip(items, words)]
    shares = {}
    for replaced in (0.0, 0.15, 0.3, 0.45):
        planted = reworded(items, texts, replaced)
        found = {(doc, item) for doc, _, item in leaks.leaks_in([text.encode() for text in planted], paths, idf)}
        expected = set()
        for doc, text in enumerate(planted):
            own = hash_words([text.encode()])[0].tolist()
            for (item, _), passage, answer in zip(items, words, answers):
                # Windows too far from a passage share too few words with it to follow.
                if 3 * len(set(passage) & set(own)) < len(set(passage)):
                    continue
                for at in range(0, max(len(own) - leaks.WINDOW, 0) + leaks.STEP, leaks.STEP):
                    region = own[max(0, at - len(passage)) : min(at + leaks.WINDOW, len(own)) + len(passage)]
                    share = leaks.common_subsequence(passage, region) / len(passage)
                    if share >= leaks.SURE_SHARE or share >= leaks.DOUBTFUL_SHARE and len(answer & set(region)) >= leaks.ANSWER_SHARE * len(answer):
                        expected.add((doc, item))
                        break
        assert found <= expected
        shares[replaced] = len(found) / len(expected)
    assert min(shares[0.0], shares[0.15], shares[0.3]) >= 0.97 and shares[0.45] >= 0.9


def test_too_few_words_rule_a_pair_out_only_if_they_are(spark, folder):
    """The bound on the common subsequence is never below it."""
    dice = np.random.default_rng(3)
    items = spark.createDataFrame([(i, " ".join(f"w{k}" for k in dice.integers(0, 60, dice.integers(1, 90)))) for i in range(40)], "item_id long, text string")
    from tallyloom.llm.words import hash_words
    from tallyloom.session import work_folder

    idf = leaks.inverse_frequencies(np.ones(1 << leaks.BUCKET_BITS, dtype=np.int64))
    [path] = leaks.build_blocks(items, work_folder(spark, "leaks"), idf)
    block = leaks.Block(path)
    hashes, _ = hash_words([" ".join(f"w{k}" for k in dice.integers(0, 90, 4000)).encode()])
    place = block.places(hashes)
    window = np.repeat(np.arange(60), len(block.sizes))
    passage = np.tile(np.arange(len(block.sizes)), 60)
    low, high = window * 50, window * 50 + 30 + block.sizes[passage]
    enough = leaks._enough_words(block, place, window, passage, low, high)
    for w, item, a, b, kept in zip(window, passage, low, high, enough):
        share = plain_subsequence(block.words[item], hashes[a:b].tolist()) / len(block.words[item])
        assert kept or share < leaks.DOUBTFUL_SHARE
    assert not enough.all()
