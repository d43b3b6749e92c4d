"""Packing: windows of tokens filled by lexical retrieval.

1. Every document is tokenised once. Its whole windows stand alone; what is left over
   (less than one window) goes on with its ids.
2. The rests are range-partitioned by (MinHash of their token pairs, id), so that similar
   ones lie side by side and a crowd of equal ones is spread over many tasks.
3. In each partition, runs of `SHARD` rests get a BM25 inverted index. The next unused
   rest is the seed of a window; its unused neighbours fill the window in score order;
   where none of the best fits, the best one is cut and its remainder leads the next window.

A window that is open at the end of a shard goes on in the next one, so only the last
window of a partition is padded.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from corpuslens.llm.common import text_slices
from corpuslens.llm.sampling import mix
from corpuslens.session import stage

WINDOW = 1024
END = 0
SHARD = 1024
LOOK = 32
K1, B = 1.2, 0.75
#: Fixed value: how byte-level BPE of this family cuts text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

LONG_BLANK = 50_000
LONG_RUN = re.compile(r"\s{%d}" % LONG_BLANK)


@lru_cache(maxsize=2)
def _encoder(path: str):
    """The tokenizer file's own vocabulary, as ranks for the faster merge loop."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {
        bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special
    }
    return tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


@lru_cache(maxsize=2)
def _added_tokens(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    for token in tokens:
        if token.get("lstrip") or token.get("rstrip") or token.get("single_word"):
            raise ValueError(f"added token with lstrip, rstrip or single_word: {token['content']!r}")
    return {token["content"]: token["id"] for token in tokens}


class Tokeniser:
    """Ids of whole texts, as an array of the smallest fitting kind.

    With `added`, the file's added tokens get their ids in running text, as in the
    tokenizers library left at its defaults; else they are ordinary text. Texts with
    very long runs of blanks, at which the faster loop's pattern fails, go through that library.
    """

    def __init__(self, path: str, added: bool = False):
        self.path = path
        self.encoding = _encoder(path)
        tokens = _added_tokens(path)
        most = max([self.encoding.n_vocab, *(i + 1 for i in tokens.values())])
        self.dtype = np.dtype("<u2" if most <= 1 << 16 else "<u4")
        self.added = tokens if added else {}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None

    def _ordinary(self, text: str) -> list[int]:
        if len(text) > LONG_BLANK and LONG_RUN.search(text):
            return _library(self.path).encode(text, add_special_tokens=False).ids
        return self.encoding.encode_ordinary(text)

    def __call__(self, text: str) -> np.ndarray:
        if not any(token in text for token in self.added):
            return np.array(self._ordinary(text), dtype=self.dtype)
        ids: list[int] = []
        for part in self.cut.split(text):
            ids += [self.added[part]] if part in self.added else self._ordinary(part)
        return np.array(ids, dtype=self.dtype)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
CUT = PIECE + ", near bigint, ids binary"


def _near(ids: np.ndarray) -> int:
    """MinHash of the neighbouring token pairs."""
    if len(ids) < 2:
        return int(ids[0]) if len(ids) else 0
    wide = ids.astype(np.uint64)
    return int(mix((wide[:-1] << np.uint64(32)) | wide[1:]).min() >> np.uint64(1))


def cut_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """Whole windows with their sequence id, and rests (null sequence id) with ids and MinHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenise = Tokeniser(tokenizer, added=True)
        sequence = TaskContext.get().partitionId() << 32
        for batch in text_slices(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(tokenise(text or ""), np.array([END], dtype=tokenise.dtype))
                n = len(ids)
                for start in range(0, n - n % window, window):
                    rows.append((doc_id, start, window, crc(ids[start : start + window]), n, sequence, 0, None, None))
                    sequence += 1
                rest = ids[n - n % window :]
                if len(rest):
                    rows.append((doc_id, n - len(rest), len(rest), None, n, None, None, _near(rest), rest.tobytes()))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns[:8]] + [pa.array(columns[8], pa.binary())], names=CUT_NAMES
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, CUT)


CUT_NAMES = [part.split()[0] for part in CUT.split(", ")]
PIECE_NAMES = [part.split()[0] for part in PIECE.split(", ")]


class Bm25:
    """Inverted index over a shard's token lists; terms in half of them or more weigh nothing."""

    def __init__(self, lists: list[np.ndarray]):
        self.n = len(lists)
        length = np.array([len(x) for x in lists], dtype=float)
        flat = np.concatenate(lists).astype(np.int64)
        doc = np.repeat(np.arange(self.n, dtype=np.int64), length.astype(np.int64))
        pair, tf = np.unique(flat * self.n + doc, return_counts=True)
        term, self.doc = pair // self.n, pair % self.n
        first = np.flatnonzero(np.diff(term, prepend=-1))
        df = np.diff(np.append(first, len(term)))
        idf = np.maximum(np.log((self.n - df + 0.5) / (df + 0.5)), 0.0)
        norm = K1 * (1 - B + B * length / length.mean())
        self.weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[self.doc])
        group = np.repeat(np.arange(len(first)), df)
        useful = idf[group] > 0
        by_doc = np.argsort(self.doc[useful], kind="stable")
        self.first, self.df = first, df
        self.terms = group[useful][by_doc]
        self.bounds = np.searchsorted(self.doc[useful][by_doc], np.arange(self.n + 1))

    def scores(self, query: int) -> np.ndarray:
        terms = self.terms[self.bounds[query] : self.bounds[query + 1]]
        size = self.df[terms]
        if not len(size):
            return np.zeros(self.n)
        skip = np.repeat(self.first[terms] - (np.cumsum(size) - size), size)
        postings = skip + np.arange(len(skip))
        return np.bincount(self.doc[postings], weights=self.weight[postings], minlength=self.n)


class Packer:
    """Fills windows one after the other; `open` is the window that still has room."""

    def __init__(self, sequence: int, window: int):
        self.sequence, self.window, self.used = sequence, window, 0

    def place(self, rest: list, room: int) -> tuple:
        """Up to `room` tokens of rest = [doc_id, start, doc_tokens, ids] go into the open window."""
        doc_id, start, total, ids = rest
        piece = ids[:room]
        rest[1], rest[3] = start + len(piece), ids[room:]
        row = (doc_id, start, len(piece), crc(piece), total, self.sequence, self.used)
        self.used += len(piece)
        if self.used == self.window:
            self.sequence, self.used = self.sequence + 1, 0
        return row

    def pack(self, rests: list[list]) -> list[tuple]:
        index = Bm25([r[3] for r in rests])
        left = np.array([len(r[3]) for r in rests])
        rows: list[tuple] = []
        seed = 0
        carried = -1
        while True:
            if carried < 0:
                while seed < len(rests) and not left[seed]:
                    seed += 1
                if seed == len(rests):
                    return rows
            start = carried if carried >= 0 else seed
            carried = -1
            before = self.sequence
            rows.append(self.place(rests[start], self.window - self.used))
            left[start] = len(rests[start][3])
            if self.sequence != before:
                carried = start if left[start] else -1
                continue
            score = index.scores(start)
            score[left == 0] = -1.0
            ranked = np.argsort(-score, kind="stable")
            ranked = ranked[: int((left > 0).sum())]
            while self.sequence == before and len(ranked):
                room = self.window - self.used
                fits = np.flatnonzero(left[ranked[:LOOK]] <= room)
                at = int(fits[0]) if len(fits) else 0
                chosen = int(ranked[at])
                rows.append(self.place(rests[chosen], room))
                left[chosen] = len(rests[chosen][3])
                ranked = np.delete(ranked, at)
                if left[chosen]:
                    carried = chosen


def _pack(tokenizer: str, window: int, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = Tokeniser(tokenizer).dtype
        packer = Packer((1 << 62) | (TaskContext.get().partitionId() << 32), window)
        held: list[list] = []

        def emit(rests: list[list]) -> pa.RecordBatch:
            columns = list(zip(*packer.pack(rests)))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=PIECE_NAMES)

        for batch in batches:
            for doc_id, start, total, raw in zip(*[c.to_pylist() for c in batch.columns]):
                held.append([doc_id, start, total, np.frombuffer(raw, dtype=kind)])
                if len(held) == shard:
                    yield emit(held)
                    held = []
        if held:
            yield emit(held)

    return run


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every token of every row, with id 0 after the text, lies in exactly one piece. A
    null text is empty: one piece with id 0 alone. Rows with equal or null ids are
    packed as documents of their own. A table without rows gives none.
    """
    cut = stage(cut_documents(docs, tokenizer, window), "packing-cut")
    whole = cut.where(F.col("sequence_id").isNotNull()).select(*PIECE_NAMES)
    rests = cut.where(F.col("sequence_id").isNull()).select("near", "doc_id", "start", "doc_tokens", "ids")
    near = rests.repartitionByRange("near", "doc_id").sortWithinPartitions("near", "doc_id", "start", "ids")
    packed = near.select("doc_id", "start", "doc_tokens", "ids").mapInArrow(_pack(tokenizer, window, shard), PIECE)
    return whole.unionByName(packed)
