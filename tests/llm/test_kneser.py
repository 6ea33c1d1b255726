"""The language model against a dictionary version of it."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import kneser


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def plain_scores(rows, order):
    train = [words_of(text) for doc, text in rows if not held_out(doc)]
    single = Counter(word for words in train for word in [*words, "</s>"])
    total, types = sum(single.values()), len(single)
    counts = {order: Counter()}
    for words in train:
        line = ["<s>"] * (order - 1) + words + ["</s>"]
        counts[order].update(tuple(line[i - order + 1 : i + 1]) for i in range(order - 1, len(line)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(gram[1:] for gram in counts[k + 1])
    cuts, contexts = {}, {}
    for k, table in counts.items():
        of = Counter(table.values())
        cuts[k] = kneser.discounts(of[1], of[2], of[3], of[4])
        contexts[k] = defaultdict(lambda: [0, 0, 0, 0])
        for gram, n in table.items():
            row = contexts[k][gram[:-1]]
            row[0] += n
            row[min(n, 3)] += 1

    def chance(gram):
        k = len(gram)
        if k == 0:
            return 1 / (types + 1)
        lower = chance(gram[1:])
        row = contexts[k].get(gram[:-1])
        if not row:
            return lower
        n = counts[k].get(gram, 0)
        free = sum(d * m for d, m in zip(cuts[k], row[1:]))
        return (max(n - (0, *cuts[k])[min(n, 3)], 0) + free * lower) / row[0]

    out = []
    for doc, text in rows:
        words = [*words_of(text), "</s>"]
        line = ["<s>"] * (order - 1) + words
        score = sum(math.log10(chance(tuple(line[i - order + 1 : i + 1]))) for i in range(order - 1, len(line)))
        base = sum(math.log10((single[w] + 0.5) / (total + 0.5 * (types + 1))) for w in words)
        out.append((doc, held_out(doc), len(words), sum(w in single for w in words), total, base, score))
    return out, chance, single


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_the_dictionary_version(spark, messy, corpus, order, monkeypatch):
    monkeypatch.setattr(kneser, "HELD_GRAMS", 20_000)
    monkeypatch.setattr(kneser, "SCORE_BYTES", 50_000)
    docs = corpus.select("doc_id", "text").unionByName(messy.select("doc_id", "text"))
    found = kneser.train_and_score(docs, order, shard_bytes=100_000).collect()
    expected, _, _ = plain_scores([(row.doc_id, row.text) for row in docs.collect()], order)
    key = lambda row: (row[0] is None, row[0] or 0, row[2], round(row[6], 3))
    for row, other in zip(sorted(map(tuple, found), key=key), sorted(expected, key=key), strict=True):
        assert row[:5] == other[:5]
        assert row[5:7] == pytest.approx(other[5:7], rel=1e-9)
        assert row[7] == pytest.approx(10 ** (-other[6] / other[2]), rel=1e-6)
    outside = [row for row in found if row.held_out]
    assert sum(row.score for row in outside) > sum(row.base_score for row in outside)


def test_probabilities_add_up_to_one(spark):
    texts = ["a b a b c", "a b d", "c c a", "b a", "d d d d e"] * 2
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    from tallyloom.session import work_folder

    model = kneser.train(rows, work_folder(spark, "test"), 2)
    vocabulary = ["a", "b", "c", "d", "e", "unseen"]
    hot = np.array(model.hot, dtype=np.uint64)
    for before in ("a", "d", "zzz"):
        total = 0.0
        for word in vocabulary:
            line, at, _ = kneser._sequence([f"{before} {word}".encode()], 2)
            total += kneser.probabilities(model, line, at, hot)[1]
        line, at, _ = kneser._sequence([before.encode()], 2)
        total += kneser.probabilities(model, line, at, hot)[1]
        assert total == pytest.approx(1)


def test_nothing_to_learn_and_nothing_to_score(spark, nothing, messy):
    assert kneser.train_and_score(nothing).collect() == []
    outside = messy.filter((kneser.remainder(5) == 1) & F.col("doc_id").isNotNull())
    for row in kneser.train_and_score(outside).collect():
        assert (row.n_known, row.train_tokens) == (0, 0) and math.isfinite(row.score)


def test_counts_of_more_than_four_bytes(tmp_path):
    keys = np.arange(10, 60, 10, dtype=np.uint64)
    counts = np.array([1, 2**32 - 2, 2**32 - 1, 2**32, 5 * 10**12])
    path = tmp_path / "words-0"
    path.write_bytes(kneser._count_file(keys, counts))
    model = kneser.Model(str(tmp_path), 1, 1, [], 0, 0, present={"words": [0]})
    asked = np.array([50, 10, 15, 40, 30, 20, 99], dtype=np.uint64)
    found = kneser._find(model, "words", asked, np.zeros(len(asked), dtype=np.int32))[0]
    assert found.tolist() == [5 * 10**12, 1, 0, 2**32, 2**32 - 1, 2**32 - 2, 0]
