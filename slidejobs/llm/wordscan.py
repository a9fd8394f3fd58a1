"""Words of many texts at once, from the bytes of an Arrow buffer."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: masks[n] keeps the first n bytes of eight.
MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], np.uint64)
SMALL = 1 << 21  # bytes of text to look at in one go


def byte_class(characters: bytes, bit: int) -> np.ndarray:
    """A table of 256 with `bit` set for these bytes."""
    out = np.zeros(256, np.uint8)
    out[list(characters)] = bit
    return out


class Bytes(NamedTuple):
    """data: the texts' bytes one after the other; at: where each begins, one more than texts."""

    data: np.ndarray
    at: np.ndarray


def raw_bytes(texts: pa.Array) -> Bytes:
    """The bytes of a string array without nulls; nothing is copied."""
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts):
        return Bytes(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None:
        return Bytes(np.zeros(0, np.uint8), at - at[0])
    return Bytes(np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0])


def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags are set in each text, by prefix sums."""
    return np.diff(np.r_[0, np.cumsum(flags, dtype=np.int32)][at])


def words(is_word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text of every run of word bytes; runs end with their text."""
    n = len(is_word)
    inner = at[1:-1][at[1:-1] < n]  # where a text begins
    first, last = is_word.copy(), is_word.copy()
    first[1:] &= ~is_word[:-1]
    last[:-1] &= ~is_word[1:]
    first[inner] = is_word[inner]
    last[inner[inner > 0] - 1] = is_word[inner[inner > 0] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends - starts, np.repeat(np.arange(len(at) - 1), per_text(first, at))


class Blocks:
    """Eight bytes from any place, as one number."""

    def __init__(self, data: np.ndarray):
        self.view = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))

    def at(self, places: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The bytes there, those after the first `left` as zeros."""
        return self.view[places] & MASKS[np.minimum(left, 8)]


def hashes(blocks: Blocks, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte strings, eight bytes at a time."""
    h = sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    open_, k = np.arange(len(starts)), 0
    while len(open_):
        x = (h[open_] ^ blocks.at(starts[open_] + k, sizes[open_] - k)) * np.uint64(0xBF58476D1CE4E5B9)
        h[open_] = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        k += 8
        open_ = open_[sizes[open_] > k]
    return h ^ (h >> np.uint64(32))


def same_bytes(blocks: Blocks, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Are the strings of these sizes at a and at b equal?"""
    out = np.ones(len(a), bool)
    open_, k = np.arange(len(a)), 0
    while len(open_):
        left = sizes[open_] - k
        same = blocks.at(a[open_] + k, left) == blocks.at(b[open_] + k, left)
        out[open_] = same
        k += 8
        open_ = open_[same & (left > 8)]
    return out
