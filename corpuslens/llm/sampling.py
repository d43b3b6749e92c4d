"""SentencePiece sampling: forward filtering, backward sampling over the piece lattice.

Text is cut at blanks (no piece has a blank after another character, so the lattice
falls apart there). All different chunks of an Arrow slice share one vectorised
forward pass; each occurrence then draws its pieces from the end backwards, with
random numbers that are a hash of (seed, row key, chunk number, step). The same row
gives the same pieces in any partitioning and after any retry.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpuslens.llm.common import free_name, text_slices

CHUNK = re.compile(r" *[^ ]+| +")
STEP = np.uint64(0x9E3779B97F4A7C15)
GATE_BITS = 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: nearby integers give unrelated ones."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Pieces:
    """Piece hashes in order with id and weight, byte pieces, and each piece's bytes."""

    hashes: np.ndarray
    ids: np.ndarray
    weight: np.ndarray
    gate: np.ndarray
    longest: int
    byte_ids: np.ndarray
    byte_weight: float
    raw: list[bytes]


@lru_cache(maxsize=4)
def load_pieces(model_file: str, alpha: float) -> Pieces:
    """Weight of a piece: (2 + rank) ** -alpha, the rank from the model's score order.

    A BPE model's scores are merge ranks, not probabilities, so they are read as ranks.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = model.get_piece_size()
    special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
    byte = [model.is_byte(i) for i in range(n)]
    byte_ids = np.full(256, -1, dtype=np.int64)
    raw, text_of = [b""] * n, {}
    for i in range(n):
        name = model.id_to_piece(i)
        if byte[i]:
            byte_ids[int(name[3:5], 16)] = i
            raw[i] = bytes([int(name[3:5], 16)])
        elif not special[i]:
            text_of[i] = name.replace("▁", " ")
            raw[i] = text_of[i].encode()
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte fallback, so decoding would lose characters")
    ids = np.array(sorted(text_of, key=lambda i: (-model.get_score(i), i)), dtype=np.int64)
    weight = (2.0 + np.arange(len(ids))) ** -alpha
    hashes = np.zeros(len(ids), dtype=np.uint64)
    for k, i in enumerate(ids):
        h = 0
        for c in text_of[int(i)]:
            h = (h * int(STEP) + ord(c) + 1) % (1 << 64)
        hashes[k] = h
    order = np.argsort(hashes)
    gate = np.zeros(1 << GATE_BITS, dtype=bool)
    gate[(mix(hashes) >> np.uint64(64 - GATE_BITS)).astype(np.int64)] = True
    longest = max(len(t) for t in text_of.values())
    return Pieces(
        hashes[order], ids[order], weight[order], gate, longest, byte_ids, float((2.0 + n) ** -alpha), raw
    )


def _lattice(codes: np.ndarray, ends: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """ids[e, l] and weights[e, l] of the piece of l + 1 characters that ends at place e (weight 0: none).

    `ends[i]` is the end (exclusive) of the chunk that place i belongs to.
    """
    n = len(codes)
    ids = np.full((n, pieces.longest), -1, dtype=np.int32)
    weight = np.zeros((n, pieces.longest))
    at = np.arange(n)
    h, used = np.zeros(n, dtype=np.uint64), 1
    for size in range(pieces.longest):
        alive = at + size < ends[at]
        at, h = at[alive], h[alive]
        if not len(at):
            break
        h = h * STEP + (codes[at + size] + np.uint64(1))
        maybe = np.flatnonzero(pieces.gate[(mix(h) >> np.uint64(64 - GATE_BITS)).astype(np.int64)])
        found = np.searchsorted(pieces.hashes, h[maybe])
        found[found == len(pieces.hashes)] = 0
        hit = pieces.hashes[found] == h[maybe]
        where = at[maybe[hit]] + size
        ids[where, size] = pieces.ids[found[hit]]
        weight[where, size] = pieces.weight[found[hit]]
        if len(where):
            used = size + 1
    # characters without a piece of their own: their UTF-8 bytes, marked by a negative id
    bare = np.flatnonzero(ids[:, 0] < 0)
    code = codes[bare].astype(np.int64)
    ids[bare, 0] = -2 - code
    width = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    weight[bare, 0] = pieces.byte_weight**width
    return ids[:, :used], weight[:, :used]


def encode_slice(texts: list[str], keys: list[int], seed: int, pieces: Pieces) -> list[np.ndarray]:
    """Sampled ids of each text; an empty text has none."""
    index: dict[str, int] = {}
    chunk, per_text = [], []
    for text in texts:
        found = CHUNK.findall(" " + text) if text else []
        per_text.append(len(found))
        chunk += [index.setdefault(c, len(index)) for c in found]
    if not chunk:
        return [np.zeros(0, dtype=np.int32) for _ in texts]
    words = list(index)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.cumsum(lengths) - lengths
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    ids, weight = _lattice(codes, np.repeat(starts + lengths, lengths), pieces)
    cdf = _forward(weight, starts, lengths)
    chunk_of, text_of = np.array(chunk), np.repeat(np.arange(len(texts)), per_text)
    begins = np.cumsum(per_text) - per_text
    number = (np.arange(len(chunk_of)) - begins[text_of]).astype(np.uint64)
    key = mix(np.array(keys, dtype=np.int64).astype(np.uint64) * STEP + np.uint64(seed))
    base = mix(key[text_of] ^ (number * np.uint64(0xD6E8FEB86659FD93)))
    low, place = starts[chunk_of], starts[chunk_of] + lengths[chunk_of] - 1
    active = np.arange(len(chunk_of))
    drawn, owner, steps = [], [], []
    count = np.zeros(len(chunk_of), dtype=np.int64)
    shifts = mix(np.arange(64, dtype=np.uint64) * STEP)
    step = 0
    while len(active):
        u = (mix(base[active] + shifts[step % 64]) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
        at = place[active]
        back = (cdf[at] <= u[:, None]).sum(axis=1)
        drawn.append(ids[at, back])
        owner.append(active)
        steps.append(np.full(len(active), step))
        count[active] += 1
        place[active] = at - back - 1
        active = active[place[active] >= low[active]]
        step += 1
        if step % 64 == 0:
            base[active] = mix(base[active] ^ STEP)
    after = np.cumsum(count)
    out = np.empty(after[-1], dtype=np.int64)
    who = np.concatenate(owner)
    out[after[who] - 1 - np.concatenate(steps)] = np.concatenate(drawn)
    per = np.bincount(np.repeat(text_of, count), minlength=len(texts))
    return _bytes_expanded(out, per, pieces)


def _forward(weight: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Forward filtering: cdf[e, l] over the length (less one) of the piece that ends at place e.

    Chunks advance together, one place a step. `reach` holds the total weight of all
    segmentations up to each of the last places, relative to the newest one, so that it
    neither under- nor overflows in a long chunk and does not depend on other chunks.
    """
    longest = weight.shape[1]
    order = np.argsort(-lengths, kind="stable")
    first, size = starts[order], lengths[order]
    cdf = np.empty(weight.shape, dtype=np.float32)
    reach = np.zeros((len(first), longest))
    reach[:, 0] = 1.0
    for step in range(int(size[0])):
        live = int(np.searchsorted(-size, -step, side="left"))
        e = first[:live] + step
        joint = np.cumsum(weight[e] * reach[:live], axis=1)
        total = joint[:, -1:].copy()
        joint /= total
        cdf[e] = joint
        reach = reach[:live]
        reach[:, 1:] = reach[:, :-1] / total
        reach[:, 0] = 1.0
    return cdf


def _bytes_expanded(ids: np.ndarray, per_text: np.ndarray, pieces: Pieces) -> list[np.ndarray]:
    """Marked characters become their byte pieces; the rest stays."""
    code = np.where(ids < 0, -2 - ids, 0)
    width = np.where(ids < 0, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), 1)
    after = np.cumsum(width)
    out = np.empty(int(after[-1]), dtype=np.int32)
    out[after - width] = ids
    lead = {1: 0x00, 2: 0xC0, 3: 0xE0, 4: 0xF0}
    for w in range(1, 5):
        marked = np.flatnonzero((ids < 0) & (width == w))
        for k in range(w):
            bits = code[marked] >> (6 * (w - 1 - k))
            value = (bits | lead[w]) if k == 0 else (bits & 0x3F) | 0x80
            out[after[marked] - w + k] = pieces.byte_ids[value]
    stops = np.cumsum(np.bincount(np.repeat(np.arange(len(per_text)), per_text), weights=width, minlength=len(per_text)))
    return np.split(out, stops[:-1].astype(np.int64))


def decode(ids: np.ndarray, pieces: Pieces) -> str:
    """The exact text: bytes of all pieces in order, without the blank put before the text."""
    return b"".join([pieces.raw[i] for i in ids.tolist()]).decode()[1:]


def sample_pieces(docs: DataFrame, model_file: str, seed: int = 7, alpha: float = 0.5, key: str = "doc_id") -> DataFrame:
    """key, ids array<int>, n_pieces and `lossless` (decoding gives the text again).

    A null text gives null ids, 0 pieces and lossless true; an empty one an empty
    list. A null key counts as 0. Rows with equal key and text get equal pieces. A key
    column that is called like a new one keeps its name; the new one gets underscores before it.
    """
    added = [free_name([key], n) for n in ("ids", "n_pieces", "lossless")]
    read = free_name([key], "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load_pieces(model_file, alpha)
        for batch in text_slices(batches, read, 2 << 20):
            raw = batch.column(1).to_pylist()
            keys = [k or 0 for k in batch.column(0).to_pylist()]
            found = encode_slice([t or "" for t in raw], keys, seed, pieces)
            same = [decode(f, pieces) == (t or "") for f, t in zip(found, raw)]
            sizes = np.array([len(f) for f in found])
            values = pa.array(np.concatenate(found))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32(), mask=np.array([t is None for t in raw] + [False]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(offsets, values), pa.array(sizes, pa.int64()), pa.array(same)],
                names=[key, *added],
            )

    kinds = ("bigint", "array<int>", "bigint", "boolean")
    return docs.select(F.col(f"`{key}`").cast("bigint").alias(key), F.col("text").alias(read)).mapInArrow(
        run, ", ".join(f"`{n}` {kind}" for n, kind in zip([key, *added], kinds))
    )
