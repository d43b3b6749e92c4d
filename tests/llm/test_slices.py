"""Arrays of a task in the first two stages of the pipeline stay small, whatever a batch holds."""

import random
import tracemalloc

import pyarrow as pa

from corpuslens.llm import jaccard, langid


def _peak(run, batch) -> float:
    tracemalloc.start()
    try:
        for _ in run(iter([batch])):
            pass
        return tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def _texts(n: int) -> list[str]:
    rng = random.Random(3)
    return [" ".join(f"w{rng.randrange(5000):04d}" for _ in range(340)) for _ in range(n)]


def test_counting_of_ngrams_holds_little():
    texts = _texts(2000)
    batch = pa.RecordBatch.from_pydict({"text": texts, "lang": ["en"] * len(texts)})
    assert _peak(langid._counts(("en",)), batch) < 50


def test_signing_of_sets_holds_little():
    texts = _texts(1000)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    assert _peak(jaccard._signed(80, 5), batch) < 20
