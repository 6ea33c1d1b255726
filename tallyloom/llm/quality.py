"""Quality of texts without labels: voting heuristics, their reliabilities, and a hashed linear scorer.

Heuristic labellers look at whole texts and vote good, bad or nothing.
Expectation-maximisation over the counts of vote combinations of all texts
estimates how accurate each is; the posterior labels of a bounded sample train
a linear scorer on hashed features, whose score decides for every text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.store import slices
from tallyloom.llm.weak import Reliability, estimate, sigmoid, train_linear
from tallyloom.llm.words import BLOCK_BYTES, chain, hash_word, hash_words, mix, word_spans

FEATURE_BITS = 16
#: Texts that train the scorer, about; chosen by a hash of doc_id.
TRAIN_TEXTS = 4000
LABELLERS = ["symbols", "capitals", "doubled words", "repeated runs", "separators", "word length", "function words", "variety"]
#: Added to the number of words of a text when features are averaged, so that a few words decide little.
PRIOR_WORDS = 8

# Frequent function words of the languages at hand.
FUNCTION_WORDS = (
    "the of and to in is that it was for on are as with be at by this a an from "
    "le la les de des et en un une que qui dans est pour sur pas au du avec "
    "der die das und ist nicht mit ein eine zu den von im auf für dem sich "
    "el los las y que del una por con para es se no al lo su"
).split()

# Classes of bytes: 0 space, 1 letter, 2 capital, 3 digit, 4 usual punctuation, 5 other symbol.
_CLASS = np.full(256, 5, dtype=np.uint8)
_CLASS[128:] = 1
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[ord(c) for c in ".,;:'\"!?()-/"]] = 4
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_USUAL = np.sort(np.array([hash_word(word) for word in FUNCTION_WORDS], dtype=np.uint64))
_SHAPES = 1 << 12


@dataclass
class Analysis:
    """What many texts look like: per text numbers, per word features."""

    words: np.ndarray  # words of each text
    shares: dict[str, np.ndarray]
    features: list[np.ndarray]  # families; one hashed feature per word of all texts


def _shapes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A code for the look of every word, and the bytes of each class in every word."""
    starts, ends = word_spans(data)
    kinds = _CLASS[data]
    counts = np.zeros((6, len(starts)), dtype=np.int64)
    for kind in (1, 2, 3, 4, 5):
        running = np.concatenate([[0], np.cumsum(kinds == kind)])
        counts[kind] = running[ends] - running[starts]
    code = kinds[starts].astype(np.int64)
    code = code * 6 + kinds[ends - 1] if len(starts) else code
    code = code * 8 + np.minimum((ends - starts) // 3, 7)
    code = code * 2 + (counts[5] > 0)
    code = code * 2 + (counts[2] > 1)
    return code % _SHAPES, counts


def _share(hits: np.ndarray, owner: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.bincount(owner, weights=hits, minlength=len(size)) / np.maximum(size, 1)


def _hashed(codes: np.ndarray, family: int) -> np.ndarray:
    return (mix(codes.astype(np.uint64) * np.uint64(8) + np.uint64(family)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def analyse(texts: Sequence[bytes | None]) -> Analysis:
    """Look at whole texts; a long one passes through in blocks of bytes."""
    texts = [text or b"" for text in texts]
    hashes, words = hash_words(texts)
    shapes, counts = [], []
    group: list[bytes] = []
    held = 0
    for text in [*texts, None]:
        if text is None or held > BLOCK_BYTES:
            found = _shapes(np.frombuffer(b" ".join(group), dtype=np.uint8))
            shapes.append(found[0])
            counts.append(found[1])
            group, held = [], 0
        if text is not None:
            group.append(text)
            held += len(text) + 1
    shape, bytes_of = np.concatenate(shapes), np.concatenate(counts, axis=1)
    owner = np.repeat(np.arange(len(texts)), words)
    same = np.concatenate([[False], owner[1:] == owner[:-1]]) if len(owner) else np.zeros(0, bool)
    doubled = np.zeros(len(hashes), dtype=bool)
    doubled[1:] = same[1:] & (hashes[1:] == hashes[:-1])
    runs = np.zeros(len(hashes), dtype=bool)
    if len(hashes) > 3:
        whole = owner[3:] == owner[:-3]
        key = chain(chain(chain(chain(mix(owner[3:].astype(np.uint64)), hashes[:-3]), hashes[1:-2]), hashes[2:-1]), hashes[3:])
        at = np.flatnonzero(whole)
        order = np.argsort(key[at], kind="stable")
        ranked = key[at][order]
        again = np.concatenate([[False], ranked[1:] == ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
        runs[3 + at[order[again]]] = True
    letters = np.bincount(owner, weights=bytes_of[1] + bytes_of[2], minlength=len(texts))
    marks = np.bincount(owner, weights=bytes_of.sum(axis=0), minlength=len(texts))
    usual = np.isin(hashes, _USUAL)
    bare = (bytes_of[1] + bytes_of[2] + bytes_of[3]) == 0
    shares = {
        "symbols": np.bincount(owner, weights=bytes_of[5], minlength=len(texts)) / np.maximum(marks, 1),
        "capitals": np.bincount(owner, weights=bytes_of[2], minlength=len(texts)) / np.maximum(letters, 1),
        "doubled words": _share(doubled, owner, words),
        "repeated runs": _share(runs, owner, words),
        "separators": _share(bare, owner, words),
        "function words": _share(usual, owner, words),
        "word length": letters / np.maximum(words, 1),
    }
    before = np.concatenate([[0], shape[:-1]]) if len(shape) else shape
    features = [
        _hashed(shape, 1),
        _hashed(np.where(same, before + 1, 0) * _SHAPES + shape, 2),
        _hashed(hashes >> np.uint64(3), 3),
        _hashed(doubled.astype(np.int64) * 2 + runs, 4),
    ]
    return Analysis(words, shares, features)


# Per labeller that only objects: the least words it looks at, and where "bad" begins.
_OBJECTIONS = {
    "symbols": (3, 0.06),
    "capitals": (5, 0.5),
    "doubled words": (8, 0.15),
    "repeated runs": (12, 0.3),
    "separators": (5, 0.1),
    "word length": (8, 12.0),
}


def votes(found: Analysis) -> np.ndarray:
    """One row per text, one column per labeller: 1 good, -1 bad, 0 nothing to say."""
    shares, words = found.shares, found.words
    columns = [-((words >= least) & (shares[name] >= bad)).astype(np.int64) for name, (least, bad) in _OBJECTIONS.items()]
    usual = shares["function words"]
    columns.append(np.where(words < 12, 0, np.where(usual >= 0.08, 1, np.where(usual <= 0.02, -1, 0))))
    varied = (shares["doubled words"] <= 0.03) & (shares["repeated runs"] <= 0.1) & (shares["separators"] <= 0.01)
    columns.append(((words >= 12) & varied).astype(np.int64))
    return np.column_stack(columns).astype(np.int64)


def _code(found: np.ndarray) -> np.ndarray:
    """A combination of votes as one number."""
    return (found + 1) @ (3 ** np.arange(found.shape[1]))


def _combination(code: np.ndarray) -> np.ndarray:
    return (code[:, None] // 3 ** np.arange(len(LABELLERS))[None, :]) % 3 - 1


def scores(found: Analysis, weights: np.ndarray) -> np.ndarray:
    """The scorer's probability of "good"; a text without words has 0."""
    owner = np.repeat(np.arange(len(found.words)), found.words)
    total = np.zeros(len(found.words))
    for family in found.features:
        total += np.bincount(owner, weights=weights[family], minlength=len(total))
    total = total / (found.words + PRIOR_WORDS) + weights[-1]
    return np.where(found.words > 0, sigmoid(total), 0.0)


def learn(docs: DataFrame, texts: int = TRAIN_TEXTS) -> tuple[Reliability, np.ndarray]:
    """Reliabilities from all rows of ``docs`` (doc_id, text), and a scorer from about ``texts`` of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 ** len(LABELLERS), dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                found = analyse(part.column("text").cast(pa.binary()).to_pylist())
                total += np.bincount(_code(votes(found)), minlength=len(total))
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total[place])], names=["code", "n"])

    counted = docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()
    code = np.array([row["code"] for row in counted], dtype=np.int64)
    rows = np.array([row["n"] for row in counted], dtype=float)
    combination = _combination(code)
    model = estimate(np.zeros(len(code), dtype=np.int64), combination, rows, 1, prior=0.8)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                found = analyse(part.column("text").cast(pa.binary()).to_pylist())
                ends = np.cumsum(found.words)
                at, share = [], []
                for a, b in zip((ends - found.words).tolist(), ends.tolist()):
                    place, n = np.unique(np.concatenate([family[a:b] for family in found.features]), return_counts=True)
                    at.append(place.astype("<u4").tobytes())
                    share.append((n / (b - a + PRIOR_WORDS)).astype("<f4").tobytes())
                arrays = [part.column("doc_id"), pa.array(_code(votes(found))), pa.array(at, pa.binary()), pa.array(share, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "code", "at", "share"])

    total = rows.sum() if len(rows) else 0
    share = F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(1_000_000)) / 1_000_000
    chosen = docs.filter(share < texts / max(total, 1)).mapInArrow(features, "doc_id long, code long, at binary, share binary")
    sample = sorted(chosen.collect(), key=lambda row: (row["doc_id"] is None, row["doc_id"], row["at"]))
    own = _combination(np.array([row["code"] for row in sample], dtype=np.int64))
    target = model.posterior(np.zeros(len(sample), dtype=np.int64), own) if sample else np.zeros(0)
    indices = [np.frombuffer(row["at"], "<u4").astype(np.int64) for row in sample]
    values = [np.frombuffer(row["share"], "<f4").astype(float) for row in sample]
    prior = np.clip(target.mean(), 0.05, 0.95) if sample else 0.8
    return model, train_linear(indices, values, target, 1 << FEATURE_BITS, rounds=60, bias=float(np.log(prior / (1 - prior))))


def judge(docs: DataFrame, texts: int = TRAIN_TEXTS, least: float = 0.5) -> DataFrame:
    """doc_id, quality (0 to 1) and keep for every row of ``docs`` (doc_id, text).

    A null text or one without words has quality 0 and is not kept. With no
    rows to learn from, texts with words are kept.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    _, weights = learn(rows, texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                found = scores(analyse(part.column("text").cast(pa.binary()).to_pylist()), weights)
                arrays = [part.column("doc_id"), pa.array(found), pa.array(found >= least)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "quality", "keep"])

    return rows.mapInArrow(run, "doc_id long, quality double, keep boolean")


def keep_good(docs: DataFrame, texts: int = TRAIN_TEXTS, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) that ``judge`` keeps, with all their columns.

    Null texts and those without words go. Rows are judged one by one, so repeated
    ones stay or go together; an empty table stays empty, columns keep their names.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    _, weights = learn(rows, texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                found = scores(analyse(part.column("text").cast(pa.binary()).to_pylist()), weights)
                yield part.filter(pa.array(found >= least))

    return docs.mapInArrow(run, docs.schema)
