"""Word hashes of many texts at once, as flat numpy arrays.

Texts are joined to one byte array; words are runs of bytes of a class; a word's
hash is a polynomial of keyed byte values modulo 2**64, finished by a mixer.
Nothing loops over words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed in one step; a longer text is one step of its own.
STEP_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = np.uint64(0xD6E8FEB86659FD93)
POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(4095, BASE)]).astype(np.uint64))

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: Words between ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[*range(9, 14), 32]] = False
#: Words of ASCII letters, digits and all that is not ASCII.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def powers(n: int) -> np.ndarray:
    global POWERS
    while len(POWERS) < n:
        POWERS = np.concatenate([POWERS, POWERS * POWERS[-1] * BASE])
    return POWERS


def hash_words(texts: list[bytes], is_word: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, ASCII lower-cased; offsets: the words of text k are offsets[k]:offsets[k + 1])."""
    raw = ASCII_LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    inside = is_word[raw]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    offsets = np.searchsorted(starts, cuts)
    if not len(starts):
        return np.zeros(0, np.uint64), offsets
    at = np.flatnonzero(inside)
    lengths = ends - starts
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    within = np.arange(len(at)) - np.repeat(first, lengths)
    values = BYTE_VALUE[raw[at]] * powers(int(lengths.max()))[within]
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64)), offsets


#: Which bytes of a 64-bit number belong to a run that has so many bytes left.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Rounds of 64 bits in which runs are hashed; what is longer is added as a polynomial.
ROUNDS = 4
LETTER_VALUE = mix(np.arange(1, 65537, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def run_hashes(letters: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each run of letters (unsigned, of 8 or 16 bits), 64 bits of them at a time."""
    each = 8 // letters.itemsize
    # The 64 bits from each letter on.
    at = np.ndarray(len(letters), np.uint64, np.concatenate([letters, np.zeros(each, letters.dtype)]), 0, letters.strides).copy()
    out = mix(size.astype(np.uint64) + np.uint64(1))
    for k in range(0, ROUNDS * each, each):
        if k == 0:
            out = mix(out ^ (at.take(first) & FIRST_BYTES[np.minimum(size, each) * letters.itemsize]))
        elif (more := np.flatnonzero(size > k)).size:
            out[more] = mix(out[more] ^ (at.take(first[more] + k) & FIRST_BYTES[np.minimum(size[more] - k, each) * letters.itemsize]))
    if (long := np.flatnonzero(size > ROUNDS * each)).size:
        left = size[long] - ROUNDS * each
        begin = np.cumsum(left) - left
        within = np.arange(left.sum()) - np.repeat(begin, left)
        values = LETTER_VALUE[letters[np.repeat(first[long] + ROUNDS * each, left) + within]] * powers(int(left.max()))[within]
        out[long] = mix(out[long] ^ np.add.reduceat(values, begin))
    return out


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of n words; a text of fewer words, but not none, is one run. Same layout as hash_words."""
    counts = np.diff(offsets)
    sizes = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    out_offsets = np.concatenate([[0], np.cumsum(sizes)])
    start = np.repeat(offsets[:-1] - out_offsets[:-1], sizes) + np.arange(out_offsets[-1])
    left = np.repeat(offsets[1:], sizes) - start
    total = np.zeros(len(start), np.uint64)
    for k in range(n):
        some = k < left if len(start) and left.min() < n else slice(None)
        value = words[start[some] + k] * POWERS[k + 1]
        total[some] += value
    return mix(total + np.minimum(left, n).astype(np.uint64)), out_offsets


def steps(batch: pa.RecordBatch, column: int = 1, most: int = STEP_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as UTF-8) of consecutive parts of a batch, of about `most` bytes each."""
    texts = batch.column(column).cast(pa.binary()).to_pylist()
    at = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > most:
            yield at, texts[at:k]
            at, size = k, 0
        size += len(text)
    if texts:
        yield at, texts[at:]
