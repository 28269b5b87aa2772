"""Vectorised word spans and word hashes over UTF-8 bytes.

A word is a longest run of bytes outside 0x20 and 0x09-0x0D.  The hash of a
span is a chain over its 8-byte lanes: each step takes in one lane and mixes all
64 bits by a bijection, so different spans of up to 8 bytes and one length never
agree and any other two do with a chance of 2**-64.  Spans over ``LONG`` bytes
are hashed by xxh3.  A second seed gives an independent hash where 64 bits
aren't enough.
"""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: spans of more bytes are hashed one by one
LONG = 64
SEED, SECOND = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_STEP = U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on all of them."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of bytes."""
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    inside = np.empty(len(data) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(SPACE[data], out=inside[1:-1].view(bool))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Hash of each span of bytes."""
    starts, size = np.asarray(starts, dtype=np.int64), np.asarray(ends, dtype=np.int64) - starts
    out = mix(size.astype(U) + U(seed))
    if not len(out):
        return out
    padded = np.empty(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    padded[len(data) :] = 0
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the 8 bytes from every place on
    live, k = np.flatnonzero(size <= LONG), 0
    while live.size:
        left = np.minimum(size[live] - k, 8)
        lane = lanes[starts[live] + k] & (U(0xFFFFFFFFFFFFFFFF) >> (64 - 8 * np.maximum(left, 1)).astype(U))
        lane[left <= 0] = 0
        out[live] = mix((out[live] ^ lane) * _STEP)
        k += 8
        live = live[size[live] > k]
    view = memoryview(padded)
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(view[starts[i] : starts[i] + size[i]], seed)
    return out


def split_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, word starts, word ends, and the first word's number per text (one more at the end)."""
    data = np.frombuffer(b"\n".join(t or b"" for t in texts), dtype=np.uint8)
    starts, ends = word_spans(data)
    sizes = np.fromiter((len(t) + 1 if t else 1 for t in texts), dtype=np.int64, count=len(texts))
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(sizes, out=bounds[1:])
    return data, starts, ends, np.searchsorted(starts, bounds)


def hash_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, one after another, and the first word's number per text (one more at the end)."""
    data, starts, ends, first = split_words(texts)
    return span_hashes(data, starts, ends), first


_LANES = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0x27D4EB2F165667C5)]


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive values (len(words) - n + 1 of them)."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=U)
    out = np.zeros(count, dtype=U)
    factor = 1
    for i in range(n):
        factor = factor * int(_LANES[i % 4]) % (1 << 64) | 1
        out += words[i : i + count] * U(factor)
    return mix(out)


def fold(values: np.ndarray, seed: int = 0) -> int:
    """One 64-bit hash of an array of hashes, in order."""
    return xxhash.xxh3_64_intdigest(np.ascontiguousarray(values).view(np.uint8), seed) if len(values) else 0


def run_hashes(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``fold`` of each run of an array of hashes."""
    view = memoryview(np.ascontiguousarray(values).view(np.uint8)) if len(values) else b""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(view[a:b]) for a, b in zip((8 * begins).tolist(), (8 * ends).tolist(), strict=True)), dtype=U, count=len(begins))


def radix_split(keys: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings keys of one group together, and each group's first place (one more at the end)."""
    group = (keys >> U(17)) % U(groups)
    order = np.argsort(group, kind="stable")
    return order, np.searchsorted(group[order], np.arange(groups + 1, dtype=U))


class HashIndex:
    """Open-addressing index from pairs of 64-bit hashes to the numbers 0, 1, ... in order of arrival.

    The first hash finds the place; a second, independent one must agree too.
    """

    def __init__(self, most: int):
        size = 1 << (2 * most - 1).bit_length()
        self.mask = U(size - 1)
        self.keys = np.zeros(size, dtype=U)
        self.checks = np.zeros(size, dtype=U)
        self.numbers = np.full(size, -1, dtype=np.int64)
        self.known = 0

    def get(self, hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Numbers of the hashes, -1 for unknown ones."""
        hashes = np.maximum(hashes, U(1))
        slots = (hashes & self.mask).astype(np.int64)
        found = self.keys[slots]
        same = (found == hashes) & (self.checks[slots] == checks)
        out = np.where(same, self.numbers[slots], -1)
        left = np.flatnonzero(~same & (found != 0))
        while left.size:
            slots[left] = (slots[left] + 1) & int(self.mask)
            found = self.keys[slots[left]]
            same = (found == hashes[left]) & (self.checks[slots[left]] == checks[left])
            out[left[same]] = self.numbers[slots[left[same]]]
            left = left[~same & (found != 0)]
        return out

    def add(self, hashes: np.ndarray, checks: np.ndarray) -> None:
        """Number distinct unknown pairs on."""
        hashes = np.maximum(hashes, U(1))
        slots = (hashes & self.mask).astype(np.int64)
        numbers = np.arange(self.known, self.known + len(hashes))
        left = np.arange(len(hashes))
        while left.size:
            free = self.keys[slots[left]] == 0
            # of several pairs at one free place the last one written holds it
            self.numbers[slots[left[free]]] = numbers[left[free]]
            done = free & (self.numbers[slots[left]] == numbers[left])
            self.keys[slots[left[done]]] = hashes[left[done]]
            self.checks[slots[left[done]]] = checks[left[done]]
            left = left[~done]
            slots[left] = (slots[left] + 1) & int(self.mask)
        self.known += len(hashes)


def distinct_pairs(hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Place of the first of each distinct pair."""
    order = np.lexsort((checks, hashes))
    h, c = hashes[order], checks[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    return order[new]
