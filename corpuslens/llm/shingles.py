"""Vectorised words, word shingles and parity-sketch keys of whole Arrow slices."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from corpuslens.llm.sampling import STEP, mix

U = np.uint64
WIDTH = 3
SHINGLE_FACTORS = (U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB))
INVERSE = U(pow(int(STEP), -1, 1 << 64))
SKETCH_WORDS = 16

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * STEP)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, STEP), np.full(size, INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(texts: list[bytes], between: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lower-cased) in order, and the text each belongs to.

    `between` marks the bytes that are part of no word; the line feed must be one.
    """
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", dtype=np.uint8)
    size = 1 << max(16, int(len(data)).bit_length())
    up, down = _powers(size)
    blank = between[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    start, end = edges[0::2], edges[1::2]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * up[: len(data)], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    stops = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.searchsorted(stops, start, side="left")


@lru_cache(maxsize=4)
def _factors(width: int) -> np.ndarray:
    """An odd factor for each place in a shingle."""
    more = mix(np.arange(1, width + 1, dtype=np.uint64) * STEP) | U(1)
    return np.concatenate([np.array(SHINGLE_FACTORS, dtype=np.uint64), more])[:width]


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of `width` words; a text of fewer words has one shingle."""
    words, owner = word_hashes(texts)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    factors = _factors(width)
    n = max(0, len(words) - width + 1)
    total = np.zeros(n, dtype=np.uint64)
    for i, factor in enumerate(factors):
        total += words[i : n + i] * factor
    rolled = mix(total)
    sets = []
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if high - low >= width:
            sets.append(np.unique(rolled[low : high - width + 1]))
        elif high > low:
            whole = (words[low:high] * factors[: high - low]).sum(dtype=np.uint64, keepdims=True)
            sets.append(mix(whole + U(high - low)))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return sets


def signature(hashes: np.ndarray) -> tuple[int, int]:
    """Two order-free 64-bit hashes of a whole set."""
    first = int(np.bitwise_xor.reduce(mix(hashes + U(1)), initial=U(0)))
    second = int(mix(hashes ^ SHINGLE_FACTORS[1]).sum(dtype=np.uint64))
    return first, second


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity of the elements on each of 64 * SKETCH_WORDS bits: an element in one of two sets flips one bit."""
    slot = mix(hashes ^ SHINGLE_FACTORS[2])
    bits = np.bincount((slot >> U(54)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def block_keys(hashes: np.ndarray, band: int, differing: int, blocks: int) -> np.ndarray:
    """Keys of the blocks of a wide parity sketch, for sets that differ in at most `differing` (< `blocks`) elements.

    An element of only one set flips one bit of one block, so at most `differing` blocks
    differ. With more non-empty blocks than that, one non-empty block is equal; a set
    with fewer also gives the keys of its empty blocks. (If either of two sets has
    enough non-empty blocks, one of those is equal in both.)
    """
    block = (((hashes >> U(32)) * U(blocks)) >> U(32)).astype(np.int64)  # rises with the hash
    first = np.flatnonzero(np.diff(block, prepend=-1))
    # the key stands for the block's odd bits: each bit number enters by XOR, twice is not at all
    value = np.bitwise_xor.reduceat(mix((hashes & U(0xFFFFFFFF)) + U(1)), first)
    index = block[first]
    if len(index) <= differing:
        empty = np.setdiff1d(np.arange(blocks), index)
        index = np.concatenate([index, empty])
        value = np.concatenate([value, np.zeros(len(empty), dtype=np.uint64)])
    return mix(value ^ mix(index.astype(np.uint64) + (U(band + 1) << U(40))))
