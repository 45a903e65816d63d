"""Words of UTF-8 bytes as numpy arrays: where they stand and a 64-bit hash of each.

The hash is multilinear (every byte times its own random odd number, summed modulo 2**64) and then mixed. Two given words
share it with a chance below 2**-56, so tables of some million words hold no false match for practical purposes; operators
that must be exact compare bytes afterwards or say that they rely on the hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of a word that the multilinear hash covers; longer words are hashed by blake2.
LONG_WORD = 1 << 15
_RANDOM = np.random.Generator(np.random.PCG64(20240501)).integers(1, 1 << 63, LONG_WORD, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SPACE = bytes(range(9, 14)) + b" "
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


def table_of(separators: bytes) -> np.ndarray:
    """True for bytes that belong to words."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: Everything but white space.
NON_SPACE = table_of(SPACE)
#: Lower-case ASCII letters, digits and everything beyond ASCII.
ALNUM = table_of(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def spans(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = table[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each word ``data[start:end]``; words must not be empty."""
    sizes = ends - starts
    if not len(sizes):
        return np.zeros(0, np.uint64)
    short = np.minimum(sizes, LONG_WORD)
    first = np.cumsum(short) - short
    place = np.arange(int(short.sum()), dtype=np.int64) - np.repeat(first, short)
    values = (data[place + np.repeat(starts, short)].astype(np.uint64) + np.uint64(1)) * _RANDOM[place]
    h = mix(np.add.reduceat(values, first) + sizes.astype(np.uint64) * _MIX[0])
    for i in np.flatnonzero(sizes > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def factorize(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(codes, distinct values)`` in the order of first appearance."""
    coded = pa.array(values).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_numpy()


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the sequences of ``width`` words that start at each place."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(width), np.uint64)
    for j in range(width):
        h = (h ^ words[j:j + n]) * _MIX[1]
        h ^= h >> np.uint64(29)
    return mix(h)


def segments(data: np.ndarray, table: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of about ``size`` bytes that no word straddles, so that the temporary arrays of a long text stay small."""
    at = 0
    while len(data) - at > size:
        end, step = at + size, 4096
        while end < len(data):
            gap = np.flatnonzero(~table[data[end:end + step]])
            if len(gap):
                end += int(gap[0])
                break
            end, step = end + step, step * 2
        if end >= len(data):
            break
        yield at, end
        at = end
    yield at, len(data)


def text_words(text: bytes, table: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(bytes, starts, ends, hashes)`` of one text with the letters A-Z lowered."""
    data = np.frombuffer(text, np.uint8)
    if lower:
        data = LOWER[data]
    found = []
    for a, b in segments(data, table):
        s, e = spans(data[a:b], table)
        found.append((s + a, e + a, hashes(data[a:b], s, e)))
    s, e, h = (np.concatenate(x) for x in zip(*found)) if len(found) > 1 else found[0]
    return data, s, e, h


def batch_words(texts: list[bytes], table: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Words of many texts: ``(first text, bytes, starts, ends, hashes, place of each text's first word and the end)``.

    Texts are joined by a space into blocks of about ``limit`` bytes, as numpy calls on short texts cost more than the texts.
    A text beyond that is a block of its own.
    """
    i = 0
    while i < len(texts):
        j, held = i, 0
        while j < len(texts) and (j == i or held + len(texts[j]) <= limit):
            held += len(texts[j]) + 1
            j += 1
        data, s, e, h = text_words(b" ".join(texts[i:j]), table)
        sizes = np.fromiter((len(t) + 1 for t in texts[i:j]), np.int64, j - i)
        yield i, data, s, e, h, np.append(np.searchsorted(s, np.cumsum(sizes) - sizes), len(s))
        i = j
