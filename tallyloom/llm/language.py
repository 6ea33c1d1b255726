"""Language of texts: sparse multinomial logistic regression on TF-IDF of character n-grams.

Features are hashed n-grams of one to three code points of the lower-cased
text. Document frequencies come from all training texts. The weights are
trained on a bounded sample by follow-the-regularised-leader with elastic-net
penalties; a temperature fitted on a part of the sample that the weights have
not seen calibrates the probabilities. As term frequencies are shares of a
text's n-grams, the score of a class is a mean over positions: a text of any
length is scored in blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.kneser import remainder
from tallyloom.llm.store import slices
from tallyloom.operators.lookup import lookup

FEATURE_BITS = 16
ORDERS = (1, 2, 3)
#: Labelled texts per language that train the weights, about; chosen by a hash of doc_id.
SAMPLE_TEXTS = 600
#: The share of the sample that is kept for the temperature.
CALIBRATION = 0.2
UNKNOWN = "und"
SCALE = 10.0

_LETTER = re.compile(r"[^\W\d_]")
_FACTORS = np.array([2654435761, 2246822519, 3266489917], dtype=np.uint32)
_GAP = "\x00"


def ngrams(text: str) -> list[np.ndarray]:
    """Feature of the n-gram that starts at each position, for every order.

    Texts are joined with zero characters: n-grams that hold one get the
    feature 2**FEATURE_BITS, which has no weight.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    found = []
    mixed = np.zeros(len(points), dtype=np.uint32)
    gap = np.zeros(len(points), dtype=bool)
    for order in range(1, max(ORDERS) + 1):
        if len(points) < order:
            break
        last = points[order - 1 :]
        mixed = (mixed[: len(last)] ^ last) * _FACTORS[order - 1]
        mixed ^= mixed >> np.uint32(15)
        gap = gap[: len(last)] | (last == 0)
        if order in ORDERS:
            feature = (mixed * np.uint32(668265263)) >> np.uint32(32 - FEATURE_BITS)
            found.append(np.where(gap, np.uint32(1 << FEATURE_BITS), feature))
    return found


def text_counts(text: str) -> np.ndarray:
    """How often a text has each feature."""
    total = np.zeros((1 << FEATURE_BITS) + 1, dtype=np.int64)
    for at in range(0, max(len(text), 1), 1_000_000):
        # The next block begins with the n-grams that reach over the border.
        block = text[at : at + 1_000_000 + max(ORDERS) - 1]
        for order, found in zip(ORDERS, ngrams(block)):
            total += np.bincount(found[:1_000_000], minlength=len(total))
    return total[:-1]


@dataclass
class Classifier:
    languages: list[str]
    weights: np.ndarray  # feature by class, with the inverse document frequencies worked in
    bias: np.ndarray
    temperature: float

    def logits(self, texts: Sequence[str]) -> np.ndarray:
        """Scores of all classes for many texts."""
        out = np.zeros((len(texts), len(self.languages)))
        sizes = np.zeros(len(texts))
        start = 0
        while start < len(texts):
            stop, held = start, 0
            while stop < len(texts) and (stop == start or held + len(texts[stop]) < 500_000):
                held += len(texts[stop]) + 1
                stop += 1
            if stop == start + 1 and held > 1_000_000:
                counts = text_counts(texts[start])
                out[start], sizes[start] = counts @ self.weights[:-1], counts.sum()
            else:
                lowered = [text.lower() for text in texts[start:stop]]
                firsts = np.cumsum([0, *[len(text) + 1 for text in lowered[:-1]]])
                for found in ngrams(_GAP.join([*lowered, _GAP * max(ORDERS)])):
                    out[start:stop] += np.add.reduceat(self.weights[found], firsts, axis=0)
                    sizes[start:stop] += np.add.reduceat((found < 1 << FEATURE_BITS).astype(np.int64), firsts)
            start = stop
        return out / np.maximum(sizes, 1)[:, None] + self.bias

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and probability of every text; without a letter: und, 0."""
        spoken = [i for i, text in enumerate(texts) if text and _LETTER.search(text)]
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if spoken and self.languages:
            chance = softmax(self.logits([texts[i] for i in spoken]) / self.temperature)
            best = chance.argmax(axis=1)
            for i, k, p in zip(spoken, best.tolist(), chance.max(axis=1).tolist()):
                names[i], scores[i] = self.languages[k], min(p, 1.0)
        return names, scores


def softmax(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts, and in how many each feature occurs, over all rows of ``texts`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << FEATURE_BITS) + 1, dtype=np.int64)
        rows = 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen = np.zeros(len(total), dtype=bool)
                for at in range(0, max(len(text or ""), 1), 1_000_000):
                    for found in ngrams((text or "")[at : at + 1_000_000 + max(ORDERS) - 1]):
                        seen[found] = True
                total += seen
                rows += 1
        total[-1] = rows
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total[place])], names=["place", "n"])

    summed = texts.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    total = np.zeros((1 << FEATURE_BITS) + 1, dtype=np.int64)
    for row in summed.toLocalIterator():
        total[row[0]] = row[1]
    return int(total[-1]), total[:-1]


def sample(rows: DataFrame, texts: int = SAMPLE_TEXTS) -> DataFrame:
    """About ``texts`` rows of every language of ``rows`` (doc_id, lang, text), by a hash of doc_id and text.

    A null or repeated doc_id draws its rows one by one, like any other.
    """
    counted = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("__n"))
    share = F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1_000_000)) / 1_000_000
    return lookup(rows, counted, ["lang"], ["doc_id", "text"]).filter(share < texts / F.col("__n")).drop("__n")


def ftrl(
    examples: list[tuple[np.ndarray, np.ndarray, int]],
    classes: int,
    epochs: int = 5,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 1e-2,
    l2: float = 1e-3,
) -> tuple[np.ndarray, np.ndarray]:
    """Follow the regularised leader, proximal, with elastic-net penalties: weights and bias."""
    size = 1 << FEATURE_BITS
    z, n = np.zeros((size, classes)), np.zeros((size, classes))
    bias, bias_n = np.zeros(classes), np.zeros(classes)

    def leader(at: np.ndarray | slice) -> np.ndarray:
        pull = z[at]
        return -np.sign(pull) * np.maximum(np.abs(pull) - l1, 0) / ((beta + np.sqrt(n[at])) / alpha + l2)

    for _ in range(epochs):
        for at, value, target in examples:
            weights = leader(at)
            logits = value @ weights + bias
            chance = np.exp(logits - logits.max())
            chance /= chance.sum()
            chance[target] -= 1
            slope = value[:, None] * chance[None, :]
            grown = n[at] + slope**2
            z[at] += slope - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * weights
            n[at] = grown
            bias_n += chance**2
            bias -= alpha * chance / (beta + np.sqrt(bias_n))
    return leader(slice(None)), bias


def fit_temperature(logits: np.ndarray, target: np.ndarray) -> float:
    """The temperature with the least log loss; 1 without rows."""
    if not len(target):
        return 1.0

    def loss(t: float) -> float:
        return -np.log(softmax(logits / t)[np.arange(len(target)), target] + 1e-12).mean()

    steps = np.exp(np.linspace(np.log(0.05), np.log(20), 60))
    best = min(steps, key=loss)
    return float(min(best * np.exp(np.linspace(-0.1, 0.1, 21)), key=loss))


def train(rows: DataFrame, texts: int = SAMPLE_TEXTS) -> Classifier:
    """Learn from ``rows`` (doc_id, lang, text), all of them with a language."""
    rows = rows.filter("lang is not null")
    total, seen = document_frequencies(rows)
    idf = np.log((1 + total) / (1 + seen)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                at, share = [], []
                for text in part.column("text").to_pylist():
                    counts = text_counts(text or "")
                    place = np.flatnonzero(counts)
                    at.append(place.astype("<u4").tobytes())
                    share.append((counts[place] / max(counts.sum(), 1)).astype("<f4").tobytes())
                arrays = [part.column("doc_id"), part.column("lang"), pa.array(at, pa.binary()), pa.array(share, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "lang", "at", "share"])

    chosen = sample(rows, texts).select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    found = chosen.mapInArrow(run, "doc_id long, lang string, at binary, share binary").collect()
    languages = sorted({row["lang"] for row in found})
    place = {name: k for k, name in enumerate(languages)}
    examples = []
    for row in sorted(found, key=lambda row: (hash_order(row["doc_id"]), row["lang"], row["at"])):
        at = np.frombuffer(row["at"], "<u4").astype(np.int64)
        examples.append((at, np.frombuffer(row["share"], "<f4") * idf[at] * SCALE, place[row["lang"]]))
    kept = int(len(examples) * CALIBRATION)
    weights, bias = ftrl(examples[kept:], len(languages))
    held = examples[:kept]
    logits = np.array([value @ weights[at] + bias for at, value, _ in held]).reshape(len(held), len(languages))
    temperature = fit_temperature(logits, np.array([target for _, _, target in held], dtype=np.int64))
    worked = np.vstack([weights * idf[:, None] * SCALE, np.zeros((1, len(languages)))])
    return Classifier(languages, worked.astype(np.float32), bias, temperature)


def hash_order(key: int | None) -> int:
    """A fixed order that has nothing to do with the key's size."""
    return ((key or 0) * 0x9E3779B97F4A7C15 ^ 0x5851F42D4C957F2D) % (1 << 61)


def identify(docs: DataFrame, held_out: Column | None = None, texts: int = SAMPLE_TEXTS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (doc_id, text, lang).

    Learns from the rows outside ``held_out`` that have a language. A text that
    is null or has no letter is ``und`` with score 0, as is every text if there
    is nothing to learn from; ties go to the first language by name. Repeated rows
    and null ids get a row each; an empty table gives none; other columns are left out.
    """
    fold = remainder(4) == 2 if held_out is None else held_out
    names = {"text": F.col("text").cast("string"), "lang": F.col("lang").cast("string")}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold.alias("held_out"), *[c.alias(n) for n, c in names.items()])
    model = train(rows.filter(~F.col("held_out")), texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                found, score = model.predict(part.column("text").to_pylist())
                arrays = [part.column("doc_id"), part.column("held_out"), pa.array(found, pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "lang_pred", "score"])

    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    return rows.select("doc_id", "held_out", "text").mapInArrow(run, schema)
