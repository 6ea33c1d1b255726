"""Benchmark passages in documents, paraphrased ones too: latent semantic retrieval, then exact checks.

Word frequencies over all documents give the inverse frequencies of TF-IDF. A
passage longer than a window is cut into windows as documents are, so that a
copy of it is about as near to one of its windows as that of a short passage;
these and the whole passage are the rows of a matrix. Rows are dealt into blocks
of bounded size and these into parts. A block's latent space comes from a
randomised SVD whose every pass is an aggregate over its parts: a part multiplies
its rows with the vectors of their words and back, sums per word are added up per
block and made orthonormal, a few times; sums of products of the projected rows
give the singular directions. Its rank is a quarter of the block's rows.

Every document is cut into overlapping windows of words, each is projected and
compared with all rows of a block. Windows whose projection is too short to
reach any row are passed over; the length is a bound, so none is lost by that.
Candidates are verified by the longest common subsequence of words and, where
that leaves room for doubt, by whether the passage's answer is there.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.store import read_bytes, slices, task_count, write_bytes
from tallyloom.llm.words import hash_words, mix
from tallyloom.session import settle, work_folder

#: Buckets of word frequencies, as a power of two.
BUCKET_BITS = 18
#: Rows of the benchmark's passages that share one latent space, about, and those that one task works on.
BLOCK_ITEMS, PART_ROWS = 1024, 256
#: Tasks whose word counts one task adds up.
MERGED_TASKS = 4000
#: Dimensions of a latent space by its rows, least dimensions, and extra random ones to find them.
RANK_SHARE, LEAST_RANK, EXTRA = 4, 64, 16
#: Passes over the rows that sharpen the space.
ROUNDS = 3
WINDOW, STEP = 32, 16
#: Windows compared together, words of stretches looked up together, and pairs checked together.
NEAR_WINDOWS, REACH_WORDS, PAIRS = 2048, 1_000_000, 10_000
#: The least cosine, of what the latent space holds of a row.
LEAST_COSINE = 0.4
#: Share of a passage's words that must follow in order: certain, or certain if its answer is there too.
SURE_SHARE, DOUBTFUL_SHARE = 0.6, 0.45
ANSWER_WORDS, ANSWER_SHARE = 5, 0.6


def word_frequencies(docs: DataFrame) -> np.ndarray:
    """Occurrences of the words of every bucket over all texts of ``docs`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                hashes, _ = hash_words(part.column("text").cast(pa.binary()).to_pylist())
                total += np.bincount((hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(total))
        # One row per 1,024 buckets: few rows to add up, whatever the number of tasks.
        rows = total.reshape(-1, 1024)
        kept = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(list(rows[kept]), pa.list_(pa.int64()))], names=["row", "counts"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": [frame["row"].iloc[0]], "counts": [np.sum(np.stack(frame["counts"].to_list()), axis=0)]})

    counted = docs.select("text").mapInArrow(run, "row long, counts array<long>")
    # What very many tasks counted is added up in two steps, so that no group holds more than some thousand arrays.
    salts = task_count(docs.rdd.getNumPartitions(), MERGED_TASKS)
    if salts > 1:
        salted = counted.withColumn("salt", F.spark_partition_id() % salts)
        counted = salted.groupBy("row", "salt").applyInPandas(add, "row long, counts array<long>")
    total = np.zeros((1 << BUCKET_BITS >> 10, 1024), dtype=np.int64)
    for row in counted.groupBy("row").applyInPandas(add, "row long, counts array<long>").collect():
        total[row["row"]] = row["counts"]
    return total.reshape(-1)


def inverse_frequencies(total: np.ndarray) -> np.ndarray:
    return (np.log((1 + total.sum()) / (1 + total)) + 0.1).astype(np.float32)


def start_vectors(words: np.ndarray, width: int) -> np.ndarray:
    """Random signs per word, the same wherever the word occurs."""
    lanes = np.arange(-(-width // 64), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bits = mix((words[:, None] ^ np.uint64(0x5851F42D4C957F2D)) + lanes[None, :])
    signs = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8).reshape(len(words), -1), axis=1)[:, :width]
    return signs.astype(np.float64) * 2 - 1


def there_and_back(matrix: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """What a part of the rows adds to the next vectors: times its rows, and times their transpose."""
    return matrix.T @ (matrix @ vectors)


def orthonormal(vectors: np.ndarray) -> np.ndarray:
    return np.linalg.qr(vectors)[0]


def directions(base: np.ndarray, gram: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors of the largest singular values, from a basis and the products of the rows projected on it."""
    values, inner = np.linalg.eigh(gram)
    kept = np.argsort(-values, kind="stable")[:rank]
    return base @ inner[:, kept[values[kept] > values.max(initial=0.0) * 1e-9]]


def randomised_basis(matrix: np.ndarray, rank: int, extra: int = EXTRA, rounds: int = ROUNDS, parts: int = 1) -> np.ndarray:
    """The same for a matrix that is at hand, its rows in ``parts``: one right singular vector per column."""
    width = min(rank + extra, *matrix.shape)
    pieces = np.array_split(matrix, parts)
    base = start_vectors(mix(np.arange(matrix.shape[1], dtype=np.uint64)), width)
    for _ in range(rounds):
        base = orthonormal(sum(there_and_back(piece, base) for piece in pieces))
    return directions(base, sum((piece @ base).T @ (piece @ base) for piece in pieces), min(rank, *matrix.shape))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _answer(text: str, hashes: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Words that stand for a passage's answer: the rarest of its last sentence."""
    last = [part for part in text.replace("\n", " ").split(". ") if part.strip()]
    size = len(last[-1].split()) if last else 0
    tail = hashes[len(hashes) - size :]
    order = np.lexsort((np.arange(len(tail)), -idf[_bucket(tail)]))
    return tail[order[:ANSWER_WORDS]]


def passage_rows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passage, first and end word of the rows of passages with so many words: their windows and, if longer, the whole."""
    owner, first, end = windows(sizes)
    long, ends = np.flatnonzero(sizes > WINDOW), np.cumsum(sizes)
    owner = np.concatenate([owner, long])
    order = np.argsort(owner, kind="stable")
    return owner[order], np.concatenate([first, (ends - sizes)[long]])[order], np.concatenate([end, ends[long]])[order]


def _stretches(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All places from each first to before its end, one stretch after the other."""
    sizes = end - first
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _units(items: DataFrame, block_items: int) -> DataFrame:
    """Passages as rows of ``block, part, chunk, item_id, text``; a very long one in chunks of ``PART_ROWS`` rows.

    Passages without words are left out, repeated ones count once.
    """
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.filter(r"text rlike '[^\\x20\\x09-\\x0d]'").dropDuplicates(["item_id", "text"])
    most = F.greatest(F.lit(0), F.size(F.split("text", "[ \t-\r]+")) - WINDOW)
    rows = rows.withColumn("rows", F.when(most > 0, F.ceil(most / STEP) + 2).otherwise(1).cast("long"))
    blocks = task_count(rows.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0], block_items)
    chunks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("rows") / PART_ROWS) - 1).cast("int"))
    parts = max(1, -(-min(block_items, BLOCK_ITEMS) // PART_ROWS))
    units = rows.withColumn("chunk", F.explode(chunks))
    return units.select(
        F.pmod(F.xxhash64("item_id", "text", "chunk"), F.lit(blocks)).alias("block"),
        F.pmod(F.xxhash64("item_id", "text", "chunk", F.lit(1)), F.lit(parts)).alias("part"),
        "chunk",
        "item_id",
        "text",
    )


@dataclass
class _Part:
    """The matrix of a part: TF-IDF rows over its own vocabulary, and the passages they belong to."""

    vocabulary: np.ndarray
    matrix: np.ndarray
    sizes: np.ndarray
    passage: np.ndarray
    hashes: np.ndarray
    ends: np.ndarray
    counts: np.ndarray
    frame: pd.DataFrame

    @classmethod
    def of(cls, frame: pd.DataFrame, idf: np.ndarray) -> _Part:
        frame = frame.sort_values(["item_id", "text", "chunk"], kind="stable")
        hashes, counts = hash_words([text.encode() for text in frame["text"]])
        owner, first, end = passage_rows(counts)
        place = np.arange(len(owner)) - np.searchsorted(owner, owner, side="left")
        kept = np.flatnonzero(place // PART_ROWS == frame["chunk"].to_numpy()[owner])
        owner, first, end = owner[kept], first[kept], end[kept]
        words, sizes = hashes[_stretches(first, end)], end - first
        vocabulary, at = np.unique(words, return_inverse=True)
        matrix = np.zeros((len(owner), len(vocabulary)))
        np.add.at(matrix, (np.repeat(np.arange(len(owner)), sizes), at), idf[_bucket(words)])
        return cls(vocabulary, matrix, sizes, owner, hashes, np.cumsum(counts), counts, frame)


def _saved(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _loaded(data: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(data)))


def _own_rows(part: _Part, data: dict[str, np.ndarray]) -> np.ndarray:
    """The block's vectors of a part's words."""
    return data["vectors"][np.searchsorted(data["vocabulary"], part.vocabulary)]


_SAVED = "block long, data binary"


def build_blocks(items: DataFrame, folder: str, idf: np.ndarray, block_items: int = BLOCK_ITEMS) -> list[str]:
    """Store the latent spaces of ``items`` (item_id, text), each of about ``block_items`` rows of passages."""
    units = settle(_units(items, block_items))

    def passes(name: str, by_part: Callable[[_Part, int], dict], by_block: Callable[[list[dict], int], dict]) -> dict[int, str]:
        """One pass: ``by_part`` on every part, ``by_block`` on what the parts of a block give; stores one file per block."""

        def work(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"block": [key[0]], "data": [_saved(**by_part(_Part.of(frame, idf), key[0]))]})

        def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            found = by_block([_loaded(data) for data in frame["data"]], key[0])
            path = f"{folder}/{name}-{key[0]}.npz"
            write_bytes(path, _saved(**found))
            return pd.DataFrame({"block": [key[0]], "path": [path]})

        done = units.groupBy("block", "part").applyInPandas(work, _SAVED)
        return {row[0]: row[1] for row in done.groupBy("block").applyInPandas(add, "block long, path string").collect()}

    def summed(parts: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """The words of all parts and their summed vectors."""
        vocabulary = np.unique(np.concatenate([part["vocabulary"] for part in parts]))
        total = np.zeros((len(vocabulary), parts[0]["vectors"].shape[1]))
        for part in parts:
            total[np.searchsorted(vocabulary, part["vocabulary"])] += part["vectors"]
        return vocabulary, total

    counted = units.groupBy("block", "part").applyInPandas(
        lambda key, frame: pd.DataFrame({"block": [key[0]], "rows": [len(_Part.of(frame, idf).sizes)]}), "block long, rows long"
    )
    ranks = {block: max(LEAST_RANK, rows // RANK_SHARE) for block, rows in counted.groupBy("block").agg(F.sum("rows")).collect()}
    base: dict[int, str] = {}
    for number in range(ROUNDS):
        before = dict(base)

        def by_part(part: _Part, block: int) -> dict:
            vectors = _own_rows(part, _loaded(read_bytes(before[block]))) if before else start_vectors(part.vocabulary, ranks[block] + EXTRA)
            return {"vocabulary": part.vocabulary, "vectors": there_and_back(part.matrix, vectors)}

        def by_block(parts: list[dict], block: int) -> dict:
            vocabulary, total = summed(parts)
            return {"vocabulary": vocabulary, "vectors": orthonormal(total)}

        base = passes(f"round{number}", by_part, by_block)

    def gram(part: _Part, block: int) -> dict:
        projected = part.matrix @ _own_rows(part, _loaded(read_bytes(base[block])))
        return {"gram": projected.T @ projected}

    def space(parts: list[dict], block: int) -> dict:
        data = _loaded(read_bytes(base[block]))
        return {"vocabulary": data["vocabulary"], "vectors": directions(data["vectors"], sum(part["gram"] for part in parts), ranks[block])}

    spaces = passes("space", gram, space)

    def latent(part: _Part, block: int) -> dict:
        kept, passage = np.unique(part.passage, return_inverse=True)
        texts, items_ = part.frame["text"].to_numpy(), part.frame["item_id"].to_numpy()
        own = [part.hashes[part.ends[i] - part.counts[i] : part.ends[i]] for i in kept]
        answers = [_answer(texts[i], words, idf) for i, words in zip(kept, own)]
        numbers = [xxhash.xxh64_intdigest(f"{items_[i]}:{texts[i]}") >> 1 for i in kept]
        return {
            "latent": part.matrix @ _own_rows(part, _loaded(read_bytes(spaces[block]))),
            "norm": np.linalg.norm(part.matrix, axis=1),
            "row_sizes": part.sizes,
            "passage": passage,
            "items": items_[kept].astype(np.int64),
            # One number per passage over all blocks; its rows may lie in several.
            "numbers": np.array(numbers, dtype=np.int64),
            "words": np.concatenate([*own, np.zeros(0, np.uint64)]),
            "sizes": part.counts[kept],
            "answers": np.concatenate([*answers, np.zeros(0, np.uint64)]),
            "answer_sizes": np.array([len(a) for a in answers], dtype=np.int64),
        }

    def whole(parts: list[dict], block: int) -> dict:
        found = {name: np.concatenate([part[name] for part in parts]) for name in parts[0]}
        before = np.cumsum([0, *[len(part["items"]) for part in parts]])
        found["passage"] = np.concatenate([part["passage"] + at for part, at in zip(parts, before)])
        data = _loaded(read_bytes(spaces[block]))
        weights = idf[_bucket(data["vocabulary"])]
        return found | {"vocabulary": data["vocabulary"], "basis": data["vectors"].astype(np.float32), "weights": weights}

    return sorted(passes("block", latent, whole).values())


class Block:
    """A stored block, as a task uses it."""

    def __init__(self, path: str):
        data = _loaded(read_bytes(path))
        self.items, self.numbers, self.vocabulary = data["items"], data["numbers"], data["vocabulary"]
        self.basis, self.passage = data["basis"], data["passage"]
        length = np.linalg.norm(data["latent"], axis=1)
        self.latent = (data["latent"] / np.maximum(length, 1e-12)[:, None]).astype(np.float32)
        ends = np.cumsum(data["sizes"])
        self.words = [data["words"][b - n : b].tolist() for b, n in zip(ends, data["sizes"])]
        ends = np.cumsum(data["answer_sizes"])
        self.answers = [set(data["answers"][b - n : b].tolist()) for b, n in zip(ends, data["answer_sizes"])]
        # A copy of a row is as near to it as the space holds of the row; less is asked of what it holds little of.
        held = length / np.maximum(data["norm"], 1e-12)
        least = np.minimum(LEAST_COSINE, 0.8 * np.sqrt(data["row_sizes"] / WINDOW))
        self.least = (least * held).astype(np.float32)
        #: Directions of the words, times their weights.
        self.weighted = self.basis * data["weights"][:, None].astype(np.float32)
        self.seen = np.zeros(1 << BUCKET_BITS, dtype=bool)
        self.seen[_bucket(self.vocabulary)] = True
        self.sizes = data["sizes"]
        # How often every word is in every passage.
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.counts = np.zeros((len(self.sizes), len(self.vocabulary)), dtype=np.int64)
        at = self.places(data["words"])
        np.add.at(self.counts, (owner[at >= 0], at[at >= 0]), 1)
        # Words that only other chunks of a long passage hold.
        self.outside = np.bincount(owner[at < 0], minlength=len(self.sizes))
        self.counts = np.minimum(self.counts, 65_535).astype(np.uint16)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Place of every word in the vocabulary, -1 if it is not there."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        maybe = np.flatnonzero(self.seen[_bucket(hashes)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == hashes[maybe]
        out[maybe[hit]] = at[hit]
        return out


@lru_cache(maxsize=4)
def _block(path: str) -> Block:
    return Block(path)


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first and end word of the windows of texts with so many words; the words of all texts are numbered through."""
    counts = np.where(sizes == 0, 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // STEP)))
    owner = np.repeat(np.arange(len(sizes)), counts)
    first = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * STEP
    base = (np.cumsum(sizes) - sizes)[owner]
    return owner, base + first, base + np.minimum(first + WINDOW, sizes[owner])


def common_subsequence(passage: Sequence[int], text: Sequence[int]) -> int:
    """Length of the longest common subsequence, a machine word of places at a time."""
    places: dict[int, int] = {}
    for i, word in enumerate(passage):
        places[word] = places.get(word, 0) | 1 << i
    full = (1 << len(passage)) - 1
    row = full
    for word in text:
        match = places.get(word, 0)
        if match:
            hit = row & match
            row = ((row + hit) | (row - hit)) & full
    return len(passage) - row.bit_count()


def _near(block: Block, weight: np.ndarray, place: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows and passages that reach the least cosine of a row of the passage in the latent space, as pairs.

    ``first`` rises, and a window begins where the last one did plus a step, or
    in another text. The length of a window is taken at its least, so that a
    cosine here is too large rather than too small.
    """
    running = np.concatenate([[0], np.cumsum(weight.astype(np.float64) ** 2)])
    # No window is shorter than this: a repeated word counts at least once for every time.
    length = np.sqrt(np.maximum(running[end] - running[first], 1e-12)).astype(np.float32)
    pairs = [np.zeros(0, dtype=np.int64)]
    for at in range(0, len(first), NEAR_WINDOWS):
        part = np.arange(at, min(at + NEAR_WINDOWS, len(first)))
        # A window is two steps; each step is projected once, for both windows it lies in.
        middle = np.minimum(first[part] + STEP, end[part])
        starts = np.unique(np.concatenate([first[part], middle[middle < end[part]]]))
        stops = np.minimum(starts + STEP, end[part].max())
        own = np.zeros((len(starts) + 1, block.basis.shape[1]), dtype=np.float32)
        sizes = stops - starts
        # The last step of a text may be shorter: it ends where its window ends.
        last = np.searchsorted(starts, np.where(middle < end[part], middle, first[part]))
        sizes[last] = np.minimum(sizes[last], end[part] - starts[last])
        row = np.repeat(np.arange(len(starts)), sizes)
        spot = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[row]
        known = place[spot] >= 0
        row, word = row[known], place[spot[known]]
        # First words of all steps, then second ones, and so on.
        many = np.bincount(row, minlength=len(starts))
        begin = np.cumsum(many) - many
        for j in range(int(many.max(initial=0))):
            more = np.flatnonzero(many > j)
            own[more] += block.weighted[word[begin[more] + j]]
        left = np.searchsorted(starts, first[part])
        right = np.where(middle < end[part], np.searchsorted(starts, middle), len(starts))
        projected = own[left] + own[right]
        # No cosine is larger than the share of the window that the space holds.
        open_ = np.flatnonzero(np.sqrt((projected**2).sum(axis=1)) * 1.0001 >= block.least.min() * length[part])
        cosine = (projected[open_] @ block.latent.T) / length[part[open_], None]
        # The rows of a passage stand side by side.
        window, hit = np.nonzero(cosine >= block.least[None, :])
        key = part[open_[window]] * len(block.sizes) + block.passage[hit]
        pairs.append(key[np.concatenate([key[:1] == key[:1], key[1:] != key[:-1]])])
    found = np.concatenate(pairs)
    return found // len(block.sizes), found % len(block.sizes)


def _enough_words(block: Block, place: np.ndarray, window: np.ndarray, passage: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether enough words of a passage are between two places of the texts for it to follow there in order.

    Counts each distinct word of the stretch as often as the passage has it,
    which is no less than what the longest common subsequence can have of it.
    """
    enough = np.zeros(len(window), dtype=bool)
    least = np.ceil(DOUBTFUL_SHARE * block.sizes - 1e-9) - block.outside
    at = 0
    flat, width = block.counts.reshape(-1), len(block.vocabulary)
    reach = np.cumsum(high - low)
    while at < len(window):
        stop = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + REACH_WORDS, side="right")))
        part = slice(at, stop)
        # Pairs come window by window; the words of a window's stretches are looked up once.
        start = np.flatnonzero(np.concatenate([[True], window[part][1:] != window[part][:-1]]))
        group = np.cumsum(np.concatenate([[True], window[part][1:] != window[part][:-1]])) - 1
        first, last = np.minimum.reduceat(low[part], start), np.maximum.reduceat(high[part], start)
        sizes = last - first
        owner = np.repeat(np.arange(len(start)), sizes)
        words = place[np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
        known = np.sort((owner * width + words)[words >= 0])
        known = known[np.concatenate([known[:1] == known[:1], known[1:] != known[:-1]])]
        borders = np.searchsorted(known, np.arange(len(start) + 1) * width)
        words = known % width
        many = (borders[1:] - borders[:-1])[group]
        for a in range(0, len(group), PAIRS):
            own, n, item = group[a : a + PAIRS], many[a : a + PAIRS], passage[part][a : a + PAIRS]
            spot = np.repeat(borders[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            total = np.bincount(np.repeat(np.arange(len(n)), n), weights=flat[np.repeat(item * width, n) + words[spot]], minlength=len(n))
            enough[at + a : at + a + len(n)] = total >= least[item]
        at = stop
    return enough


def _similarity(block: Block, hashes: np.ndarray, idf: np.ndarray, first: int, end: int, item: int) -> float:
    """The exact cosine of a window with the nearest row of a passage, in the latent space."""
    words, counts = np.unique(hashes[first:end], return_counts=True)
    weights = idf[_bucket(words)] * counts
    place = block.places(words)
    projected = (block.basis[place[place >= 0]] * weights[place >= 0, None]).sum(axis=0)
    return float((block.latent[block.passage == item] @ projected).max() / np.sqrt((weights.astype(np.float64) ** 2).sum()))


def leaks_in(texts: Sequence[bytes | None], paths: Sequence[str], idf: np.ndarray) -> dict[tuple[int, int, int], tuple[float, float, float]]:
    """Leaks of many texts: (text, number of the passage, its item) and share in order, answer share, cosine of the best window."""
    hashes, sizes = hash_words(texts)
    owner, first, end = windows(sizes)
    ends = np.cumsum(sizes)
    weight = idf[_bucket(hashes)].astype(np.float32)
    found: dict[tuple[int, int, int], tuple[float, float, float]] = {}
    for path in paths:
        block = _block(path)
        place = block.places(hashes)
        window, passage = _near(block, weight, place, first, end)
        text = owner[window]
        low = np.maximum((ends - sizes)[text], first[window] - block.sizes[passage])
        high = np.minimum(ends[text], end[window] + block.sizes[passage])
        for at in np.flatnonzero(_enough_words(block, place, window, passage, low, high)).tolist():
            item, doc = int(passage[at]), int(text[at])
            region = hashes[low[at] : high[at]].tolist()
            words, answer = block.words[item], block.answers[item]
            share = common_subsequence(words, region) / len(words)
            there = len(answer.intersection(region)) / len(answer) if answer else 0.0
            if share >= SURE_SHARE or (share >= DOUBTFUL_SHARE and there >= ANSWER_SHARE):
                key = (doc, int(block.numbers[item]), int(block.items[item]))
                near = _similarity(block, hashes, idf, int(first[window[at]]), int(end[window[at]]), item)
                found[key] = max(found.get(key, (0.0, 0.0, 0.0)), (share, there, near))
    return found


def _prepare(docs: DataFrame, benchmark: DataFrame, block_items: int) -> tuple[np.ndarray, list[str]]:
    idf = inverse_frequencies(word_frequencies(docs.select(F.col("text").cast("string").alias("text"))))
    return idf, build_blocks(benchmark, work_folder(docs.sparkSession, "leaks"), idf, block_items)


_FOUND = "doc_id long, item_id long, similarity double, lcs_share double, answer_share double"


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text) and passage of ``benchmark`` (item_id, text) found in it.

    Columns: doc_id, item_id, similarity (cosine of the best window with the
    passage, or with the nearest window of a longer one),
    lcs_share (share of the passage's words that follow in order near that
    window) and answer_share. Documents without a leak have no row; null and
    empty texts on either side match nothing; a repeated row is found again.
    """
    idf, paths = _prepare(docs, benchmark, block_items)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                found = leaks_in(part.column("text").cast(pa.binary()).to_pylist(), paths, idf)
                keys = part.column("doc_id").to_pylist()
                rows = [(keys[doc], item, c, s, a) for (doc, _, item), (s, a, c) in sorted(found.items())]
                columns = zip(*rows) if rows else [[]] * 5
                types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                names = ["doc_id", "item_id", "similarity", "lcs_share", "answer_share"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return docs.mapInArrow(run, _FOUND)


def without_leaks(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of ``docs`` (text and any others) in which ``find_leaks`` finds nothing, with all their columns.

    Null and empty texts stay, as does every row if the benchmark has no words.
    Rows are judged one by one, repeated ones alike; an empty table stays empty.
    """
    idf, paths = _prepare(docs, benchmark, block_items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                found = leaks_in(part.column("text").cast(pa.binary()).to_pylist(), paths, idf)
                clean = np.ones(part.num_rows, dtype=bool)
                clean[[doc for doc, _, _ in found]] = False
                yield part.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
