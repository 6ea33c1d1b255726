"""Language identification: features, training and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import language
from tallyloom.llm.kneser import remainder


def test_counts_of_a_long_text_in_blocks(monkeypatch):
    text = "Straße ñandú " * 120_000
    whole = np.zeros((1 << language.FEATURE_BITS) + 1, dtype=np.int64)
    for found in language.ngrams(text):
        whole += np.bincount(found, minlength=len(whole))
    assert np.array_equal(language.text_counts(text), whole[:-1])


def test_scores_of_joined_texts_equal_those_of_counts():
    dice = np.random.default_rng(1)
    size = 1 << language.FEATURE_BITS
    weights = np.vstack([dice.normal(size=(size, 3)), np.zeros((1, 3))]).astype(np.float32)
    model = language.Classifier(["a", "b", "c"], weights, np.array([0.1, 0, -0.1]), 1.0)
    texts = ["ab cé", "x", "", "q w", "漢字 und", "Abc" * 500]
    logits = model.logits(texts)
    for row, text in zip(logits, texts):
        counts = language.text_counts(text)
        assert row == pytest.approx(counts @ weights[:-1] / max(counts.sum(), 1) + model.bias, abs=1e-4)


def test_held_out_texts_get_their_language(corpus, messy):
    found = {row.doc_id: row for row in language.identify(corpus).collect()}
    rows = [row for row in corpus.collect() if row.lang and len(row.text) > 40]
    right = [found[row.doc_id].lang_pred == row.lang for row in rows if found[row.doc_id].held_out]
    assert len(right) > 20 and np.mean(right) > 0.93
    assert all(0 <= row.score <= 1 for row in found.values())


def test_the_text_alone_decides(spark, corpus):
    own = corpus.select("doc_id", "text", "lang")
    held = F.coalesce(remainder(4) == 2, F.lit(False))
    other = own.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang")))
    first = {row.doc_id: (row.lang_pred, row.score) for row in language.identify(own).collect()}
    second = {row.doc_id: (row.lang_pred, row.score) for row in language.identify(other).collect()}
    assert first == second


def test_edges(spark, messy, nothing):
    found = language.identify(messy).collect()
    assert len(found) == messy.count()
    for row in found:
        if row.doc_id in (0, 1, 2):
            assert (row.lang_pred, row.score) == ("und", 0.0)
        else:
            assert row.lang_pred in ("en", "und")
    assert language.identify(nothing).collect() == []
    unlabelled = messy.withColumn("lang", F.lit(None).cast("string"))
    assert {row.lang_pred for row in language.identify(unlabelled).collect()} == {"und"}
    digits = spark.createDataFrame([(1, "12 34!", "en"), (3, "word", "en")], "doc_id long, text string, lang string")
    assert {row.doc_id: row.lang_pred for row in language.identify(digits).collect()}[1] == "und"


def test_temperature_and_weights():
    dice = np.random.default_rng(2)
    logits = dice.normal(size=(4000, 3))
    chance = language.softmax(logits)
    target = np.array([dice.choice(3, p=p) for p in chance])
    assert language.fit_temperature(logits * 4, target) == pytest.approx(4, rel=0.15)
    examples = [(np.array([i % 2, 5]), np.array([1.0, 1.0]), i % 2) for i in range(200)]
    weights, bias = language.ftrl(examples, 2)
    assert weights[0, 0] > weights[0, 1] and weights[1, 1] > weights[1, 0]
    assert np.count_nonzero(weights) <= 6
