"""Peaks of one task's arrays: they must leave room beside an executor's heap."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from corpuslens.llm import repeats, search, shingles


def peak_mb(function):
    repeats._powers.cache_clear()
    shingles._powers.cache_clear()
    tracemalloc.start()
    try:
        function()
        return tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def test_windows_of_a_chunk(spark):
    """288 MB before, as a whole chunk was hashed at once."""
    data = np.random.default_rng(1).integers(97, 123, repeats.CHUNK_BYTES).astype(np.uint8)
    assert peak_mb(lambda: repeats.window_groups(data, np.array([len(data)]))) < 150


def test_windows_do_not_depend_on_pieces(monkeypatch):
    data = np.random.default_rng(2).integers(97, 100, 5_000).astype(np.uint8)
    ends = np.array([700, 720, 3_000, 5_000])

    def windows():
        return {(w, at, h) for a, b, at, h in zip(*repeats.window_groups(data, ends)) for w in range(a, b + 1)}

    whole = windows()
    monkeypatch.setattr(repeats, "PIECE", 333)
    assert windows() == whole


def test_postings_of_a_batch():
    """268 MB before, with slices of 4 MB."""
    words = " ".join(f"w{i % 5000}" for i in range(400))
    batch = pa.record_batch({"doc_id": list(range(3000)), "text": [words] * 3000})
    run = search._postings(SimpleNamespace(value=np.zeros(0, dtype=np.uint64)))
    assert peak_mb(lambda: list(run([batch]))) < 150
    assert [b.column("n").to_pylist() for b in run([batch])][0][0] == 400
