"""Encoding of whole texts with a public byte-level BPE tokenizer.

The tokenizer cuts a text in front of every single space between two visible
characters, so the ids of a text are those of its space-led words one after the
other. Words are encoded by the library once and then found again by a hash, for
a block of texts at once. What is found is compared byte by byte, so a word gets
the ids of an equal one or goes to the library itself; so do words of more than
``CACHE_BYTES`` bytes.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

from tallyloom.llm.words import LANE, hash_spans, lane, padded

VOCABULARY = "byte_bpe_50k.json"

#: Words that a Python worker remembers, about 40 bytes each with their ids.
CACHE_WORDS = 1_500_000
#: Longer words are encoded again each time.
CACHE_IDS, CACHE_BYTES = 32, 64
#: Characters that the library encodes as one text.
LIBRARY_CHARS = 50_000
#: Bytes of texts looked up together; a longer text is cut between words.
BLOCK_BYTES = 2_000_000

_BETWEEN = re.compile(rb"(?<=[!-~]) (?=[!-~])")
_SPACE_LETTER = "Ġ"


def _cuts(data: np.ndarray) -> np.ndarray:
    """Places of single spaces between visible characters.

    Sure cases only: a space beside any other white space, control character or
    a character that might be one of Unicode's white spaces is not taken.
    """
    at = np.flatnonzero(data[1:-1] == 0x20) + 1
    before, after = data[at - 1], data[at + 1]
    sure = (before > 0x20) & (after > 0x20)
    high = np.flatnonzero(sure & ((before > 0x7E) | (after > 0x7E)))
    if len(high):
        places, last = at[high], len(data) - 1
        odd = (data[places - 1] == 0x7F) | (data[places + 1] == 0x7F)
        back1, back2 = data[np.maximum(places - 2, 0)], data[np.maximum(places - 3, 0)]
        tail = data[places - 1]
        odd |= (tail > 0x7F) & (back1 == 0xC2) & ((tail == 0x85) | (tail == 0xA0))
        odd |= (tail > 0x7F) & (back2 >= 0xE1) & (back2 <= 0xE3)
        lead, next1 = data[places + 1], data[np.minimum(places + 2, last)]
        odd |= (lead == 0xC2) & ((next1 == 0x85) | (next1 == 0xA0))
        odd |= (lead >= 0xE1) & (lead <= 0xE3)
        sure[high[odd]] = False
    return at[sure]


def _same(one: np.ndarray, first: np.ndarray, other: np.ndarray, second: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether stretches of one hash and of ``sizes`` bytes each are equal, in two padded arrays, pair by pair.

    Up to eight bytes go into their hash one to one, so only longer stretches are compared.
    """
    same = np.ones(len(sizes), dtype=bool)
    live, at = np.flatnonzero(sizes > LANE), 0
    while len(live):
        rest = sizes[live] - at
        equal = lane(one, first[live] + at, rest) == lane(other, second[live] + at, rest)
        same[live[~equal]] = False
        at += LANE
        live = live[equal & (rest > LANE)]
    return same


class Encoder:
    """Encodes many texts; remembers the ids of words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith(_SPACE_LETTER)]] = True
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.starts, self.sizes = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.uint8)
        self.ids = np.zeros(0, dtype="<u4")
        # The words themselves, each in as many bytes as it has.
        self.places, self.lengths = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.uint8)
        self.bytes = np.zeros(LANE, dtype=np.uint8)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(one.ids, dtype="<u4") for one in found]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers for words without spaces, each led by one: joined, the library is called a few times only."""
        blocks, block, held = [], [], 0
        for word in words:
            block.append(word)
            held += len(word) + 1
            if held > LIBRARY_CHARS:
                blocks.append(block)
                block, held = [], 0
        if block:
            blocks.append(block)
        ids, sizes = [np.zeros(0, dtype="<u4")], [np.zeros(0, dtype=np.int64)]
        for block, found in zip(blocks, self._library([" " + " ".join(block) for block in blocks])):
            starts = np.flatnonzero(self.opens[found])
            if len(starts) != len(block):
                raise AssertionError("the tokenizer does not cut at single spaces")
            ids.append(found)
            sizes.append(np.diff(np.append(starts, len(found))))
        return np.concatenate(ids), np.concatenate(sizes)

    def _block(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block, and the number of ids of each text."""
        joined = b"\n".join([*texts, b""])
        data = np.frombuffer(joined, dtype=np.uint8)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        ends = np.cumsum(lengths + 1) - 1
        heads = ends - lengths
        cuts = _cuts(data) if len(data) > 2 else np.zeros(0, dtype=np.int64)
        begin = np.sort(np.concatenate([heads, cuts]), kind="stable")
        head = np.searchsorted(begin, heads)
        is_head = np.zeros(len(begin), dtype=bool)
        is_head[head] = True
        stop = np.empty_like(begin)
        stop[:-1] = begin[1:] - is_head[1:]
        stop[-1] = ends[-1]
        words = np.flatnonzero(~is_head)
        wide, first, sizes_of = padded(data), begin[words] + 1, stop[words] - begin[words] - 1
        keys, place, back = np.unique(
            hash_spans(data, first, stop[words], exact=True), return_index=True, return_inverse=True
        )
        # A word that only shares the hash of the first one is a word of its own.
        model = place[back]
        apart = sizes_of != sizes_of[model]
        long = np.flatnonzero(~apart & (sizes_of > LANE))
        apart[long] = ~_same(wide, first[long], wide, first[model[long]], sizes_of[long])
        other = np.flatnonzero(apart)
        back[other] = len(keys) + np.arange(len(other))
        place = np.concatenate([place, other])
        at = np.searchsorted(self.hashes, keys)
        near = np.minimum(at, max(len(self.hashes) - 1, 0))
        known = np.zeros(len(place), dtype=bool)
        if len(self.hashes):
            alike = np.flatnonzero((self.hashes[near] == keys) & (self.lengths[near] == sizes_of[place[: len(keys)]]))
            hit = near[alike]
            places, lengths_ = self.places[hit].astype(np.int64), self.lengths[hit].astype(np.int64)
            known[alike] = _same(wide, first[place[alike]], self.bytes, places, lengths_)
        starts, sizes = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.int64)
        found = np.flatnonzero(known)
        starts[found], sizes[found] = self.starts[near[found]], self.sizes[near[found]]
        new = np.flatnonzero(~known)
        pieces = [joined[a:b].decode() for a, b in zip(first[place[new]].tolist(), stop[words[place[new]]].tolist())]
        alone = np.fromiter((" " in piece for piece in pieces), dtype=bool, count=len(pieces))
        alone |= sizes_of[place[new]] > CACHE_BYTES
        plain, odd = new[~alone], new[alone]
        plain_ids, plain_sizes = self._words([piece for piece, x in zip(pieces, alone) if not x])
        odd_ids = self._library([" " + piece for piece, x in zip(pieces, alone) if x])
        head_ids = self._library([joined[a:b].decode() for a, b in zip(begin[head].tolist(), stop[head].tolist())])
        base = len(self.ids)
        starts[plain], sizes[plain] = base + np.cumsum(plain_sizes) - plain_sizes, plain_sizes
        base += len(plain_ids)
        sizes[odd] = np.fromiter(map(len, odd_ids), dtype=np.int64, count=len(odd_ids))
        starts[odd] = base + np.cumsum(sizes[odd]) - sizes[odd]
        base += int(sizes[odd].sum())
        head_sizes = np.fromiter(map(len, head_ids), dtype=np.int64, count=len(head_ids))
        all_starts, all_sizes = np.empty(len(begin), dtype=np.int64), np.empty(len(begin), dtype=np.int64)
        all_starts[words], all_sizes[words] = starts[back], sizes[back]
        all_starts[head], all_sizes[head] = base + np.cumsum(head_sizes) - head_sizes, head_sizes
        buffer = np.concatenate([self.ids, plain_ids, *odd_ids, *head_ids])
        total = int(all_sizes.sum())
        shift = all_starts - (np.cumsum(all_sizes) - all_sizes)
        ids = buffer[np.repeat(shift, all_sizes) + np.arange(total)]
        whole = plain < len(keys)
        self._remember(keys, plain, plain_ids, plain_sizes, wide, first[place[plain]], sizes_of[place[plain]], whole)
        return ids, np.add.reduceat(all_sizes, head)

    def _remember(
        self,
        keys: np.ndarray,
        plain: np.ndarray,
        ids: np.ndarray,
        sizes: np.ndarray,
        data: np.ndarray,
        first: np.ndarray,
        lengths: np.ndarray,
        whole: np.ndarray,
    ) -> None:
        """Keep the ids of the words ``plain``; of words that share a hash the one that was there first stays."""
        if len(self.hashes) + len(plain) > CACHE_WORDS or len(self.ids) > CACHE_IDS * CACHE_WORDS:
            self._forget()
        starts = len(self.ids) + np.cumsum(sizes) - sizes
        self.ids = np.concatenate([self.ids, ids])
        kept = np.flatnonzero(whole & (sizes <= CACHE_IDS))
        hashes = keys[plain[kept]]
        at = np.searchsorted(self.hashes, hashes)
        if len(self.hashes):
            free = self.hashes[np.minimum(at, len(self.hashes) - 1)] != hashes
            kept, hashes, at = kept[free], hashes[free], at[free]
        lengths, first = lengths[kept], first[kept]
        ends = np.cumsum(lengths)
        bytes_ = data[np.repeat(first - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        places = len(self.bytes) - LANE + ends - lengths
        self.bytes = np.concatenate([self.bytes[:-LANE], bytes_, np.zeros(LANE, dtype=np.uint8)])
        self.hashes = np.insert(self.hashes, at, hashes)
        self.starts = np.insert(self.starts, at, starts[kept].astype(np.uint32))
        self.sizes = np.insert(self.sizes, at, sizes[kept].astype(np.uint8))
        self.places = np.insert(self.places, at, places.astype(np.uint32))
        self.lengths = np.insert(self.lengths, at, lengths.astype(np.uint8))

    def encode(self, texts: Sequence[bytes | None]) -> list[np.ndarray]:
        """The ids of every text, without special tokens; of a null text, none."""
        pieces, owner = [], []
        for index, text in enumerate(texts):
            text, at = text or b"", 0
            while len(text) - at > BLOCK_BYTES and (cut := _BETWEEN.search(text, at + BLOCK_BYTES)):
                pieces.append(text[at : cut.start()])
                owner.append(index)
                at = cut.start()
            pieces.append(text[at:])
            owner.append(index)
        out: list[list[np.ndarray]] = [[] for _ in texts]
        start, held = 0, 0
        for stop in range(1, len(pieces) + 1):
            held += len(pieces[stop - 1]) + 1
            if held >= BLOCK_BYTES or stop == len(pieces):
                ids, sizes = self._block(pieces[start:stop])
                ends = np.cumsum(sizes)
                for index, a, b in zip(owner[start:stop], (ends - sizes).tolist(), ends.tolist()):
                    out[index].append(ids[a:b])
                start, held = stop, 0
        return [parts[0] if len(parts) == 1 else np.concatenate(parts) for parts in out]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker; its memory of words lives as long as the worker."""
    return Encoder(path)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)
