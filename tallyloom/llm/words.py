"""Words of whole texts as 64-bit hashes, for many texts at once.

A word is a run of bytes other than space and 0x09 to 0x0D; A-Z are lower-cased.
All work is on arrays of the UTF-8 bytes, so a text of any length passes through
in blocks. Of n different words any two share a hash with a chance of about
n * n / 2**65.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash

BLOCK_BYTES = 2_000_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes that one step of the hash takes in, and words beyond which a library hashes a word by itself.
LANE, LONG = 8, 256
_STEP = np.uint64(0xD6E8FEB86659FD93)
_LENGTH = np.uint64(0x9E3779B97F4A7C15)
#: The low bytes of a lane that belong to a word, by their number.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(LANE + 1)], dtype=np.uint64)


def mix(keys: np.ndarray) -> np.ndarray:
    """Scramble 64-bit keys one to one, so that their leading bits can deal them out."""
    keys = keys.astype(np.uint64, copy=True)
    keys ^= keys >> np.uint64(30)
    keys *= np.uint64(0xBF58476D1CE4E5B9)
    keys ^= keys >> np.uint64(27)
    keys *= np.uint64(0x94D049BB133111EB)
    keys ^= keys >> np.uint64(31)
    return keys


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a sequence from the hash of its front and that of its last word."""
    return mix(left * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x632BE59BD9B4E019) ^ right)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[data]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def padded(data: np.ndarray) -> np.ndarray:
    """The bytes with a lane of zeros behind them, so that a lane can begin anywhere."""
    return np.concatenate([data, np.zeros(LANE, dtype=np.uint8)])


def lane(data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each place of ``padded`` bytes as one number; ``sizes`` bytes of them count."""
    windows = np.ndarray((len(data) - LANE + 1,), dtype="<u8", buffer=data, strides=(1,))
    return windows[at].astype(np.uint64) & _KEEP[np.minimum(sizes, LANE)]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, exact: bool = False) -> np.ndarray:
    """Hashes of stretches of bytes; unless ``exact``, A-Z count as a-z.

    Every eight bytes are taken into a state that is scrambled in between, so a
    hash is no sum over places and words made of a few letters do not meet.
    """
    data = padded(data if exact else _LOWER[data])
    sizes = ends - starts
    out = mix(sizes.astype(np.uint64) * _LENGTH + _STEP)
    live = np.flatnonzero((sizes > 0) & (sizes <= LONG))
    at = 0
    while len(live):
        found = lane(data, starts[live] + at, sizes[live] - at)
        out[live] = mix((out[live] ^ found) * _STEP + _LENGTH)
        at += LANE
        live = live[sizes[live] > at]
    for i in np.flatnonzero(sizes > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def _blocks(text: bytes) -> list[bytes]:
    """A long text in blocks that end between words; a single huge word stays whole."""
    found, at = [], 0
    while len(text) - at > BLOCK_BYTES:
        window = np.frombuffer(text, dtype=np.uint8, offset=at)
        spaces = np.flatnonzero(_SPACE[window[BLOCK_BYTES // 2 : BLOCK_BYTES]])
        if len(spaces):
            stop = at + BLOCK_BYTES // 2 + int(spaces[-1])
        else:
            later = np.flatnonzero(_SPACE[window[BLOCK_BYTES:]])
            stop = at + BLOCK_BYTES + int(later[0]) if len(later) else len(text)
        found.append(text[at:stop])
        at = stop
    found.append(text[at:])
    return found


def hash_words(texts: Sequence[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the number of words of each text."""
    texts = [text or b"" for text in texts]
    counts = np.zeros(len(texts), dtype=np.int64)
    out: list[np.ndarray] = []
    group: list[bytes] = []
    first = held = 0

    def flush() -> None:
        nonlocal first, group, held
        if group:
            data = np.frombuffer(b" ".join(group), dtype=np.uint8)
            starts, ends = word_spans(data)
            out.append(hash_spans(data, starts, ends))
            borders = np.cumsum([len(text) + 1 for text in group])
            counts[first : first + len(group)] += np.diff(np.searchsorted(starts, np.concatenate([[0], borders])))
        first, group, held = first + len(group), [], 0

    for index, text in enumerate(texts):
        if len(text) > BLOCK_BYTES:
            flush()
            for block in _blocks(text):
                data = np.frombuffer(block, dtype=np.uint8)
                starts, ends = word_spans(data)
                out.append(hash_spans(data, starts, ends))
                counts[index] += len(starts)
            first = index + 1
            continue
        group.append(text)
        held += len(text) + 1
        if held > BLOCK_BYTES:
            flush()
    flush()
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), counts


def hash_word(word: str) -> int:
    """The hash of one word, for markers and tests."""
    return int(hash_words([word.encode()])[0][0])
