"""Removal of long byte strings that also start in a document with a smaller id.

1. Every window of `SPAN` bytes names its smallest k-byte string (its anchor), by content
   alone: equal windows have equal anchors at equal places. Chunks of documents send the
   32-bit anchor codes to code ranges, and get back those that several documents have.
2. Around shared anchors, the bytes of all windows of one anchor (a context, at most
   `SPAN + SPAN - K` bytes) go to the anchor's range, equal contexts of a chunk once.
3. A range builds a run-length Burrows-Wheeler index of the contexts of all anchors with
   more than one, streams them through it, and so finds for each window the smallest
   document id that has it. (The windows of an anchor with one context are its owner's.)
4. Chunks mark the windows that a smaller document has, and cut their bytes.

All groups are bounded: a chunk holds about `CHUNK_BYTES` of text, a range the anchors of
about `RANGE_BYTES` of text, and a passage that all documents share enters it once a chunk.
Whole copies of a text are settled first by their digest and take no part in 1 to 4.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from corpuslens.llm.runindex import RunLengthIndex
from corpuslens.llm.sampling import STEP, mix
from corpuslens.session import stage

SPAN = 50
K = 24
CHUNK_BYTES = 4 << 20
RANGE_BYTES = 1 << 20
#: Bytes hashed at once: with the overlap below 2 ** 20, so that the powers and all arrays of a piece are small.
PIECE = 1_000_000
U = np.uint64
INVERSE = U(pow(int(STEP), -1, 1 << 64))
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * STEP)
COPY, SHARED, RESULT = 0, 1, 2
NOTES = "chunk bigint, kind int, bucket bigint, doc_id bigint, blob binary"
HIT = np.dtype([("context", "<u4"), ("low", "u1"), ("high", "u1"), ("doc", "<i8")])


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, STEP), np.full(size, INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbouring values."""
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _piece_anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every window start: place and hash of the window's smallest k-byte string (the first of equal ones)."""
    up, down = _powers(1 << max(16, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    n = len(data) - K + 1
    hashes = mix((sums[K:] - sums[:n]) * down[:n])
    low = U((1 << 24) - 1)
    packed = (hashes & ~low) | np.arange(n, dtype=np.uint64)
    place = (_sliding_min(packed, SPAN - K + 1) & low).astype(np.int64)
    return place, hashes


def window_groups(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts with one anchor: (first, last, anchor place, anchor hash).

    `data` holds the documents one after the other, `ends` their ends; windows stay
    inside a document. Pieces overlap, so that every window is seen once.
    """
    parts = []
    for begin in range(0, max(0, len(data) - SPAN + 1), PIECE):
        piece = data[begin : begin + PIECE + SPAN - 1]
        place, hashes = _piece_anchors(piece)
        valid = np.ones(len(place), dtype=bool)  # the window ends inside its document
        near = np.searchsorted(ends, [begin, begin + len(piece)], side="left")
        for end in (ends[near[0] : near[1] + 1] - begin).tolist():
            valid[max(0, end - SPAN + 1) : max(0, end)] = False
        change = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (valid != np.concatenate([[False], valid[:-1]])))
        first = change[valid[change]]
        following = np.append(change[1:], len(place))[valid[change]]
        at = place[first]
        parts.append((begin + first, begin + following - 1, begin + at, hashes[at]))
    if not parts:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))


class Chunk:
    """The documents of a chunk in id order, without those that are whole copies, and their anchors.

    Everything is a function of the chunk's rows, so each step can build it again.
    """

    def __init__(self, rows: pd.DataFrame, notes: pd.DataFrame, range_bits: int):
        raw = [t.encode() for t in rows["text"]]
        ids = rows["doc_id"].to_numpy(dtype=np.int64)
        copies: dict[int, set[bytes]] = {}
        for doc, digest in notes.loc[notes["kind"] == COPY, ["doc_id", "blob"]].itertuples(index=False):
            copies.setdefault(int(doc), set()).add(bytes(digest))
        copy = [i in copies and hashlib.sha256(t).digest() in copies[i] for i, t in zip(ids.tolist(), raw)]
        self.copies = [(int(i), t) for i, t, c in zip(ids, raw, copy) if c]
        kept = sorted((int(i), t) for i, t, c in zip(ids, raw, copy) if not c)
        self.ids = np.array([i for i, _ in kept], dtype=np.int64)
        self.raw = [t for _, t in kept]
        self.bytes = b"".join(self.raw)
        self.data = np.frombuffer(self.bytes, dtype=np.uint8)
        self.ends = np.cumsum([len(t) for t in self.raw], dtype=np.int64)
        self.first, self.last, self.place, hashes = window_groups(self.data, self.ends)
        self.code = (hashes >> U(32 - range_bits)).astype(np.int64)  # range number, then 32 bits
        self.doc = self.ids[np.searchsorted(self.ends, self.first, side="right")] if len(self.first) else self.first

    def shared(self, notes: pd.DataFrame) -> None:
        """Keep only the groups whose anchor several documents have."""
        mine = notes[notes["kind"] == SHARED]
        codes = [
            (np.int64(b) << np.int64(32)) | np.frombuffer(x, dtype="<u4").astype(np.int64)
            for b, x in zip(mine["bucket"], mine["blob"])
        ]
        keep = np.zeros(len(self.code), dtype=bool)
        if codes:
            known = np.sort(np.concatenate(codes))
            at = np.searchsorted(known, self.code)
            keep = known[np.minimum(at, len(known) - 1)] == self.code
        for name in ("first", "last", "place", "code", "doc"):
            setattr(self, name, getattr(self, name)[keep])

    def contexts(self) -> list[tuple[int, int, bytes, int]]:
        """Different (code, bytes before the anchor, bytes) with the smallest document; sets `self.context`."""
        index: dict[tuple[int, int, bytes], int] = {}
        found = []
        self.context = np.empty(len(self.first), dtype=np.int64)
        rows = zip(self.code.tolist(), self.first.tolist(), self.last.tolist(), self.place.tolist(), self.doc.tolist())
        for i, (code, first, last, place, doc) in enumerate(rows):
            key = (code, place - first, self.bytes[first : last + SPAN])
            at = index.setdefault(key, len(found))
            if at == len(found):
                found.append((*key, doc))
            self.context[i] = at
        return found


def _by_range(codes: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(range, places of its codes) for each range that occurs."""
    order = np.argsort(codes >> 32, kind="stable")
    ranges = codes[order] >> 32
    cuts = np.flatnonzero(np.diff(ranges)) + 1
    return [(int(codes[part[0]] >> 32), part) for part in np.split(order, cuts) if len(part)]


def _send_anchors(range_bits: int):
    def run(rows: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows):
            chunk = Chunk(rows, notes, range_bits)
            number = int(rows["chunk"].iloc[0])
            order = np.argsort(chunk.code)
            codes, docs = chunk.code[order], chunk.doc[order]
            first = np.flatnonzero(np.diff(codes, prepend=-1))
            # an anchor of two documents of this chunk is sent twice
            other = np.concatenate([[False], (codes[1:] == codes[:-1]) & (docs[1:] != docs[:-1])])
            several = np.add.reduceat(other, first) > 0 if len(first) else first
            codes = np.repeat(codes[first], 1 + several)
            cuts = np.flatnonzero(np.diff(codes >> 32)) + 1
            out = [
                (int(part[0] >> 32), number, (part & 0xFFFFFFFF).astype("<u4").tobytes())
                for part in np.split(codes, cuts)
                if len(part)
            ]
        return pd.DataFrame(out, columns=["bucket", "chunk", "blob"])

    return run


def _find_shared(rows: pd.DataFrame) -> pd.DataFrame:
    blobs = [np.frombuffer(b, dtype="<u4") for b in rows["blob"]]
    values = np.concatenate(blobs)
    order = np.argsort(values)
    same = np.diff(values[order]) == 0
    shared = np.empty(len(values), dtype=bool)
    shared[order] = np.append(same, False) | np.append(False, same)
    out, low = [], 0
    for chunk, bucket, blob in zip(rows["chunk"], rows["bucket"], blobs):
        mine = blob[shared[low : low + len(blob)]]
        low += len(blob)
        if len(mine):
            mine = mine[np.append(True, mine[1:] != mine[:-1])]
            out.append((chunk, SHARED, bucket, None, mine.tobytes()))
    return pd.DataFrame(out, columns=["chunk", "kind", "bucket", "doc_id", "blob"]).astype({"doc_id": "Int64"})


def _send_contexts(range_bits: int):
    def run(rows: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows):
            chunk = Chunk(rows, notes, range_bits)
            chunk.shared(notes)
            found = chunk.contexts()
            codes = np.array([c[0] for c in found], dtype=np.int64)
            for bucket, at in _by_range(codes) if len(codes) else []:
                mine = [found[i] for i in at]
                out.append(
                    (
                        bucket,
                        int(rows["chunk"].iloc[0]),
                        at.astype("<u4").tobytes(),
                        np.array([(c[0] & 0xFFFFFFFF) for c in mine], dtype="<u4").tobytes(),
                        bytes(c[1] for c in mine),
                        bytes(len(c[2]) for c in mine),
                        np.array([c[3] for c in mine], dtype="<i8").tobytes(),
                        b"".join(c[2] for c in mine),
                    )
                )
        return pd.DataFrame(out, columns=["bucket", "chunk", "context", "code", "before", "size", "doc", "text"])

    return run


CONTEXTS = "bucket bigint, chunk bigint, context binary, code binary, before binary, size binary, doc binary, text binary"


def _smallest_documents(strings: list[bytes], codes: np.ndarray, owners: np.ndarray):
    """Runs of windows with one smallest document: (string, first window, last window, document), by string.

    An anchor with a single context needs no search: all its windows are the owner's.
    The contexts of the others are indexed and streamed.
    """
    windows = np.array([len(s) for s in strings], dtype=np.int64) - SPAN + 1
    _, code, uses = np.unique(codes, return_inverse=True, return_counts=True)
    alone = np.flatnonzero(uses[code] == 1)
    parts = [(alone, np.zeros(len(alone), dtype=np.int64), windows[alone] - 1, owners[alone])]
    among = np.flatnonzero(uses[code] > 1)
    if len(among):
        several = [strings[i] for i in among]
        _, best = RunLengthIndex(several, owners[among], SPAN).stream(several)
        size = windows[among]
        best = best[:, : int(size.max())]
        inside = np.arange(best.shape[1])[None] < size[:, None]
        turn = inside & np.concatenate([np.ones((len(best), 1), dtype=bool), best[:, 1:] != best[:, :-1]], axis=1)
        string, low = np.nonzero(turn)
        last = np.append(string[1:] != string[:-1], True)
        high = np.where(last, size[string] - 1, np.append(low[1:], 0) - 1)
        parts.append((among[string], low, high, best[string, low]))
    string, low, high, doc = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(string, kind="stable")
    return string[order], low[order], high[order], doc[order]


def _match_contexts(rows: pd.DataFrame) -> pd.DataFrame:
    """Find the smallest document of every window of a range's contexts, and tell the chunks that have larger ones."""
    index: dict[bytes, int] = {}
    smallest: list[int] = []
    codes: list[int] = []
    held = []
    for row in rows.itertuples(index=False):
        cuts = np.cumsum(np.frombuffer(row.size, dtype=np.uint8).astype(np.int64)).tolist()
        docs = np.frombuffer(row.doc, dtype="<i8")
        which = np.empty(len(docs), dtype=np.int64)
        low = 0
        for i, (high, doc, code) in enumerate(zip(cuts, docs.tolist(), np.frombuffer(row.code, dtype="<u4").tolist())):
            at = index.setdefault(row.text[low:high], len(smallest))
            if at == len(smallest):
                smallest.append(doc)
                codes.append(code)
            elif doc < smallest[at]:
                smallest[at] = doc
            which[i] = at
            low = high
        held.append((int(row.chunk), int(row.bucket), np.frombuffer(row.context, dtype="<u4"), docs, which))
    string, low, high, value = _smallest_documents(list(index), np.array(codes), np.array(smallest, dtype=np.int64))
    begin = np.searchsorted(string, np.arange(len(smallest) + 1))
    out = []
    for chunk, bucket, context, docs, which in held:
        size = begin[which + 1] - begin[which]
        who = np.repeat(np.arange(len(which)), size)
        run = np.repeat(begin[which] - (np.cumsum(size) - size), size) + np.arange(len(who))
        hit = value[run] < docs[who]
        who, run = who[hit], run[hit]
        if len(who):
            hits = np.empty(len(who), dtype=HIT)
            hits["context"], hits["low"], hits["high"], hits["doc"] = context[who], low[run], high[run], value[run]
            out.append((chunk, RESULT, bucket, None, hits.tobytes()))
    return pd.DataFrame(out, columns=["chunk", "kind", "bucket", "doc_id", "blob"]).astype({"doc_id": "Int64"})


def _removed(chunk: Chunk, notes: pd.DataFrame) -> np.ndarray:
    """True for every byte of the chunk inside a window that a smaller document has."""
    chunk.shared(notes)
    found = chunk.contexts()
    cover = np.zeros(len(chunk.data) + 1, dtype=np.int64)
    if found:
        least = np.array([c[3] for c in found], dtype=np.int64)
        again = chunk.doc > least[chunk.context]  # the whole context stands in a smaller document of this chunk
        np.add.at(cover, chunk.first[again], 1)
        np.add.at(cover, chunk.last[again] + SPAN, -1)
        blobs = notes.loc[notes["kind"] == RESULT, "blob"]
        hits = np.concatenate([np.frombuffer(b, dtype=HIT) for b in blobs]) if len(blobs) else np.zeros(0, dtype=HIT)
        order = np.argsort(chunk.context, kind="stable")
        begin = np.searchsorted(chunk.context[order], np.arange(len(found) + 1))
        context = hits["context"].astype(np.int64)
        size = begin[context + 1] - begin[context]
        hit = np.repeat(np.arange(len(hits)), size)
        place = order[np.repeat(begin[context] - (np.cumsum(size) - size), size) + np.arange(len(hit))]
        smaller = hits["doc"][hit] < chunk.doc[place]
        hit, place = hit[smaller], place[smaller]
        np.add.at(cover, chunk.first[place] + hits["low"][hit], 1)
        np.add.at(cover, chunk.first[place] + hits["high"][hit] + SPAN, -1)
    return np.cumsum(cover[:-1]) > 0


RESULT_SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, source_sha256 string, kept string"


def _cut(range_bits: int, with_text: bool):
    empty = (None, None)

    def sha(data: bytes) -> str:
        return hashlib.sha256(data).hexdigest()

    def run(rows: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows):
            chunk = Chunk(rows, notes, range_bits)
            gone = _removed(chunk, notes)
            low = 0
            for doc, raw, high in zip(chunk.ids.tolist(), chunk.raw, chunk.ends.tolist()):
                mask = gone[low:high]
                n = int(mask.sum())
                kept = chunk.data[low:high][~mask].tobytes() if n else raw
                spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if n else 0
                out.append((doc, len(raw), n, spans, sha(kept), *((sha(raw), kept.decode(errors="ignore")) if with_text else empty)))
                low = high
            out += [(d, len(t), len(t), 1, sha(b""), *((sha(t), "") if with_text else empty)) for d, t in chunk.copies]
        return pd.DataFrame(out, columns=[part.split()[0] for part in RESULT_SCHEMA.split(", ")])

    return run


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; on request source_sha256 and the kept text.

    The last two are null otherwise. A cut inside a character leaves the whole character
    out of the kept text (the digest is of the bytes).

    Texts are UTF-8 bytes; a byte goes if a `SPAN`-byte string that covers it also
    starts in a row with a smaller doc_id, judged on the input. Null texts are empty.
    Rows with equal ids never remove each other; a row with a null id loses nothing and
    removes nothing. Texts shorter than `SPAN` stay. No rows give no rows. Other columns
    are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = rows.select(
        "doc_id",
        F.xxhash64("doc_id", "text").alias("spot"),
        F.sha2("text", 256).alias("digest"),
        F.octet_length("text").cast("bigint").alias("size"),
    )
    base = stage(base.where("doc_id IS NOT NULL"), "repeats-base")
    total = base.agg(F.sum("size")).first()[0] or 0
    n_chunks = max(1, -(-total // CHUNK_BYTES))
    range_bits = min(31, max(0, (total // RANGE_BYTES).bit_length()))

    chunk = F.pmod(F.col("spot"), F.lit(n_chunks)).cast("bigint").alias("chunk")
    groups = base.where(F.col("size") >= SPAN).groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    copies = base.join(groups.where("n > 1"), "digest").where("doc_id > least")
    copy_notes = stage(
        copies.select(
            chunk,
            F.lit(COPY).alias("kind"),
            F.lit(0).cast("bigint").alias("bucket"),
            "doc_id",
            F.unhex("digest").alias("blob"),
        ),
        "repeats-copies",
    )
    texts = rows.where("doc_id IS NOT NULL").select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)).cast("bigint").alias("chunk"), "doc_id", "text"
    )

    def with_notes(notes: DataFrame, function, schema: str) -> DataFrame:
        left, right = texts.toDF(*texts.columns), notes.toDF(*notes.columns)
        return left.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInPandas(function, schema)

    anchors = with_notes(copy_notes, _send_anchors(range_bits), "bucket bigint, chunk bigint, blob binary")
    shared = stage(anchors.groupBy("bucket").applyInPandas(_find_shared, NOTES), "repeats-shared")
    known = copy_notes.unionByName(shared)
    contexts = with_notes(known, _send_contexts(range_bits), CONTEXTS)
    results = stage(contexts.groupBy("bucket").applyInPandas(_match_contexts, NOTES), "repeats-results")
    cut = with_notes(known.unionByName(results), _cut(range_bits, with_text), RESULT_SCHEMA)
    loose = rows.where("doc_id IS NULL").select(
        "doc_id",
        F.octet_length("text").cast("bigint").alias("n_bytes"),
        F.lit(0).cast("bigint").alias("n_removed"),
        F.lit(0).cast("bigint").alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"),
        (F.sha2("text", 256) if with_text else F.lit(None).cast("string")).alias("source_sha256"),
        (F.col("text") if with_text else F.lit(None).cast("string")).alias("kept"),
    )
    return cut.unionByName(loose)
