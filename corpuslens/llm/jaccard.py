"""N-gram Jaccard join by parity sketches.

Sets with Jaccard similarity t or more differ in at most (1 - t)/(1 + t) of the sum of
their sizes. XOR-ing every shingle into one bit of a sketch, the Hamming distance of two
sketches is at most that difference; so, with more blocks than it, one block must be
equal. Documents meet where a block of their size band is equal, and the sets decide.

Equal sets are one node from the start, and of groups with the same members one is kept. The
smallest member of a group is compared with all. Members that are then still in another component
are tested with all members by size, distance from the smallest member (triangle inequality) and
short sketch, in blocks of bounded size inside a task. Of the pairs that these leave open, the first
16, in later rounds 256, 4,096 ... of a member are compared, until no member has more. So a crowd of near
copies costs a few comparisons each, and no pair that could join two components is left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.llm import shingles as S
from corpuslens.llm.common import text_slices
from corpuslens.llm.components import components
from corpuslens.session import stage, staged_alone

BAND = 1.5
U = np.uint64
#: Keys of a range (they grow with the root of all keys beyond it), of a flush, members of a group in one part.
RANGE_KEYS, FLUSH_KEYS, SHARE_ROWS = 1 << 20, 1 << 18, 1000
SLICE_BYTES = 1 << 18
#: Pairs tested at once, pairs of a member that the first round compares, and how that number grows by the round.
TEST_PAIRS, FIRST_PAIRS, MORE_PAIRS = 1 << 16, 16, 16
#: Bits (4 MB) that keep texts of ids without a partner from being shuffled; rows that a task remembers against repeats.
MARK_BITS, MARK_ROWS = 1 << 25, 1 << 16
#: Partners that meet a text in one task, which gets the text once for them; pairs up to which their list is broadcast.
TEXT_PAIRS, SENT_PAIRS = 128, 1 << 19


class SizeBands:
    """Bands of set sizes for linking at `percent` or more (100 * intersection >= percent * union).

    A pair meets in the band of its smaller set. A set also joins each band below in which
    a partner that is smaller, but large enough to link, can lie.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.least = -(-percent // (100 - percent)) if percent < 100 else 1 << 62
        self._blocks: dict[int, int] = {}

    def low(self, band: int) -> int:
        return int(np.ceil(self.least * BAND**band))

    def differing(self, band: int) -> int:
        high = self.low(band + 1) - 1
        return ((100 - self.percent) * (high + high * 100 // self.percent)) // (100 + self.percent)

    def blocks(self, band: int) -> int:
        """So many that the band's smallest sets, too, seldom fill as few as `differing` of them.

        A set that does gives the keys of its empty blocks, which all such sets share.
        """
        if band not in self._blocks:
            least, low = self.differing(band), self.low(band)
            n = least + 1 + least // 50 + (least >= 10)
            while n < low:
                empty = math.exp(-low / n)
                if n * (1 - empty) - 2 * math.sqrt(n * empty * (1 - empty)) > least:
                    break
                n += 1 + n // 64
            self._blocks[band] = n
        return self._blocks[band]

    def band(self, size: int) -> int:
        band = 0
        while self.low(band + 1) <= size:
            band += 1
        return band

    def of(self, size: int) -> list[int]:
        """The own band, and each lower one in which a smaller partner can lie."""
        if size < self.least:
            return []
        smallest = max(self.least, -(-size * self.percent // 100))
        return list(range(self.band(size), self.band(smallest) - 1, -1))


def _as_long(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _hashed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], np.ndarray]]:
    """Slices of rows with the shingle sets of their texts and the sets' two hashes."""
    for batch in text_slices(batches, limit=SLICE_BYTES):
        sets = S.shingle_sets([(t or "").encode() for t in batch.column("text").to_pylist()], width)
        yield batch, sets, np.array([S.signature(h) for h in sets], dtype=np.uint64).reshape(-1, 2)


def _signed(percent: int, width: int):
    bands = SizeBands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets, signs in _hashed(batches, width):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(h) for h in sets], pa.int64()),
                    pa.array(_as_long(np.ascontiguousarray(signs[:, 0]))),
                    pa.array(_as_long(np.ascontiguousarray(signs[:, 1]))),
                    pa.array([sum(bands.blocks(b) for b in bands.of(len(h))) for h in sets], pa.int64()),
                ],
                names=["doc_id", "n", "s1", "s2", "n_keys"],
            )

    return run


def _keys_of(hashes: np.ndarray, bands: SizeBands) -> np.ndarray:
    own = bands.of(len(hashes))
    if not own:
        return np.zeros(0, dtype=np.uint64)
    return np.unique(np.concatenate([S.block_keys(hashes, b, bands.differing(b), bands.blocks(b)) for b in own]))


def _sent(percent: int, width: int, ranges: int):
    """Block keys on their way to the task of their range, packed: 32 bits of the key, and the set's hash.

    A set is sent once from a flush, whatever its copies. Of a key that several sets of one
    flush have, the range is sent the first two; the others are known to share it, and go to
    parts of their own. So a range gets at most two entries of a key from a flush.
    """
    bands = SizeBands(percent)

    def packed(part: np.ndarray, code: np.ndarray, sign: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        ends = np.append(cuts[1:], len(part))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(names[part[cuts]]),
                pa.array([code[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
                pa.array([sign[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
            ],
            names=["part", "codes", "signs"],
        )

    def flush(keys: list[np.ndarray], signs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, sign = np.concatenate(keys), np.concatenate(signs)
        order = np.lexsort((sign, key))
        key, sign = key[order], sign[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (sign[1:] != sign[:-1])
        key, sign = key[new], sign[new]
        first = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        place = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        part = (key % U(ranges)).astype(np.int64)
        code = (key // U(ranges)).astype(np.uint32)
        asked = np.flatnonzero(place < 2)
        asked = asked[np.argsort(part[asked], kind="stable")]
        yield packed(part[asked], code[asked], sign[asked], np.arange(ranges, dtype=np.int64))
        known = np.flatnonzero(place >= 2)
        if len(known):
            # their whole keys, in a part that only this flush uses
            whole = (part[known].astype(np.uint64) << U(32)) | code[known].astype(np.uint64)
            number = -1 - int(np.bitwise_xor.reduce(key) >> U(2))
            yield packed(np.zeros(len(known), dtype=np.int64), whole, sign[known], np.array([number]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        signs: list[np.ndarray] = []
        held, seen = 0, set()
        for _, sets, sign in _hashed(batches, width):
            for hashes, s in zip(sets, sign[:, 0]):
                if int(s) in seen or not len(own := _keys_of(hashes, bands)):
                    continue
                seen.add(int(s))
                keys.append(own)
                signs.append(np.full(len(own), s))
                held += len(own)
            if held >= FLUSH_KEYS:
                yield from flush(keys, signs)
                keys, signs, held, seen = [], [], 0, set()
        if held:
            yield from flush(keys, signs)

    return run


def _met(rows: pd.DataFrame) -> pd.DataFrame:
    """(key, s1) of the keys that two different sets have, from the packed entries of one part."""
    part = int(rows["part"].iloc[0])
    sign = np.frombuffer(b"".join(rows["signs"]), dtype=np.int64)
    if part < 0:
        return pd.DataFrame({"key": np.frombuffer(b"".join(rows["codes"]), dtype=np.int64), "s1": sign})
    code = np.frombuffer(b"".join(rows["codes"]), dtype=np.uint32)
    order = np.lexsort((sign, code))
    code, sign = code[order], sign[order]
    new = np.ones(len(code), dtype=bool)
    new[1:] = (code[1:] != code[:-1]) | (sign[1:] != sign[:-1])
    code, sign = code[new], sign[new]
    alike = code[1:] == code[:-1]
    several = np.append(alike, False) | np.insert(alike, 0, False)
    return pd.DataFrame({"key": (part << 32) | code[several].astype(np.int64), "s1": sign[several]})


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).astype(np.int64)))


def _marked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of all rows whose id is in `ids`, and of a few others, without a shuffle of the texts.

    The ids' hashes fill a bitmap of `MARK_BITS`; an exact join has to follow. Of the rows of a task
    that repeat an id and its text, most are left out.
    """
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(MARK_BITS)).cast("bigint")
    parts = ids.select(F.shiftright(spot, 15).alias("part"), (spot % F.lit(1 << 15)).alias("bit")).groupBy("part")
    marks = np.zeros((MARK_BITS >> 15, 4096), dtype=np.uint8)
    for part, bits in parts.agg(F.bitmap_construct_agg("bit")).collect():
        marks[part] = np.frombuffer(bits, dtype=np.uint8)
    packed = marks.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(packed, dtype=np.uint8)
        seen: set[tuple[int, str | None]] = set()
        for batch in batches:
            at = batch.column("spot").to_numpy()
            part = batch.select(["doc_id", "text"]).filter(pa.array(((marks[at >> 3] >> (at & 7)) & 1).astype(bool)))
            new = []
            for row in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                name = (row[0], row[1] and hashlib.md5(row[1].encode()).digest())
                new.append(name not in seen)
                seen.add(name)
            yield part.filter(pa.array(new, pa.bool_()))
            if len(seen) > MARK_ROWS:
                seen = set()

    return docs.select("doc_id", "text", spot.alias("spot")).mapInArrow(run, "doc_id bigint, text string")


def _sketched(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets, _ in _hashed(batches, width):
            sketches = _lists([S.parity_sketch(h) for h in sets])
            sizes = pa.array([len(h) for h in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, sketches], names=["doc_id", "n", "sketch"])

    return run


def _distance(a: str, b: str) -> Column:
    """Hamming distance of two short sketches."""
    flips = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(flips, F.lit(0), lambda s, x: s + x)


COMPARED = "a bigint, b bigint, differ bigint, linked boolean"


def _judged(percent: int, width: int):
    """`COMPARED` of the text of one id (`left`) and the texts of its partners."""

    def run(rows: pa.Table) -> pa.Table:
        left = rows.column("left")
        own = {sign.tobytes(): h for _, sets, signs in _hashed(rows.filter(left).to_batches(), width) for h, sign in zip(sets, signs) if len(h)}
        found: list[tuple[int, int, bool]] = []
        for batch, sets, _ in _hashed(rows.filter(pc.invert(left)).to_batches(), width):
            for doc, theirs in zip(batch.column("doc_id").to_pylist(), sets):
                for mine in own.values() if len(theirs) else ():
                    total = len(mine) + len(theirs)
                    differ = total - 2 * len(np.intersect1d(mine, theirs, assume_unique=True))
                    found.append((doc, differ, (100 + percent) * differ <= (100 - percent) * total))
        doc, differ, linked = zip(*found) if found else ((), (), ())
        head = [rows.column("a")[0].as_py()] * len(found)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.table([pa.array(c, t) for c, t in zip((head, doc, differ, linked), kinds)], names=["a", "b", "differ", "linked"])

    return run


def _compared(pairs: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """(a, b, differ, linked) of different stored pairs: the size of the symmetric difference and whether the sets link.

    Only texts of ids of some pair travel: that of `b` once a pair, that of `a` once for `TEXT_PAIRS` of its pairs.
    The sets are made of them where they meet, so no table holds sets.
    """
    uses = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(TEXT_PAIRS)).alias("spots"))
    dealt = pairs.join(uses, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("spots")).alias("spot"))
    left = dealt.select(F.col("a").alias("doc_id"), "a", "spot", F.lit(True).alias("left")).distinct()
    wanted = left.unionByName(dealt.select(F.col("b").alias("doc_id"), "a", "spot", F.lit(False).alias("left")))
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    wanted = F.broadcast(wanted) if pairs.count() <= SENT_PAIRS else wanted
    met = _marked(docs, ids).join(wanted, "doc_id").select("a", "spot", "left", "doc_id", "text")
    return met.groupBy("a", "spot").applyInArrow(_judged(percent, width), COMPARED)


def _blocks(live: DataFrame) -> DataFrame:
    """`live` by blocks (key, i, j): rows of part i outside the head's component (left) meet those of part j (right).

    Needs other (outside the head's component), n_other and size of the group. A row is in
    one left part of all blocks of its group's row i and in one right part of all of column j.
    """

    def parts(n: str) -> Column:
        return F.ceil(F.col(n) / F.lit(SHARE_ROWS)).cast("bigint")

    def spot(n: str) -> Column:
        return F.pmod(F.xxhash64("doc_id", "n"), parts(n))

    def every(n: str) -> Column:
        return F.sequence(F.lit(0).cast("bigint"), parts(n) - 1)

    def cell(i: Column, j: Column, left: bool, right: bool) -> Column:
        return F.struct(i.alias("i"), j.alias("j"), F.lit(left).alias("left"), F.lit(right).alias("right"))

    zero = F.lit(0).cast("bigint")
    right = F.transform(every("n_other"), lambda i: cell(i, spot("size"), False, True))
    left = F.transform(every("size"), lambda j: cell(spot("n_other"), j, True, False))
    cells = (
        F.when((F.col("size") <= SHARE_ROWS) & F.col("other"), F.array(cell(zero, zero, True, True)))
        .when(F.col("size") <= SHARE_ROWS, F.array(cell(zero, zero, False, True)))
        .when(F.col("other"), F.concat(left, right))
        .otherwise(right)
    )
    names = ["doc_id", "n", "away", "part", "other", "sketch"]
    return live.withColumn("cell", F.explode(cells)).select("key", "cell.*", *names)


def _possible(percent: int, limit: int):
    """Pairs (a, b) of different components that sizes, distances and sketches leave open, from rows sorted by block.

    At most `limit` for each left row of a block; a key with more is named in a row of its own.
    """

    def pairs_of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, i, j, doc, n, away, part = (
            rows.column(c).to_numpy() for c in ("key", "i", "j", "doc_id", "n", "away", "part")
        )
        left, right, other = (rows.column(c).to_numpy() for c in ("left", "right", "other"))
        sketch = rows.column("sketch").combine_chunks().flatten().to_numpy().reshape(len(key), -1).view(np.uint64)
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(key)))
        begin, count = np.repeat(first, size), np.repeat(size, size)
        mine = np.flatnonzero(left)
        number = np.cumsum(count[mine]) // TEST_PAIRS
        for who in np.split(mine, np.flatnonzero(np.diff(number)) + 1):
            if not len(who):
                continue
            x = np.repeat(who, count[who])
            y = np.repeat(begin[who] - (np.cumsum(count[who]) - count[who]), count[who]) + np.arange(len(x))
            # two rows outside the head's component meet in both orders; one is enough
            keep = right[y] & (part[x] != part[y]) & (~other[y] | (doc[x] < doc[y]))
            keep &= 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
            most = (100 - percent) * (n[x] + n[y])
            keep &= ~((away[x] >= 0) & (away[y] >= 0) & ((100 + percent) * np.abs(away[x] - away[y]) > most))
            x, y, most = x[keep], y[keep], most[keep]
            keep = (100 + percent) * np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1, dtype=np.int64) <= most
            x, y = x[keep], y[keep]
            place = np.arange(len(x)) - np.searchsorted(x, x)
            over = np.unique(key[x[place >= limit]])
            x, y = x[place < limit], y[place < limit]
            none = pa.nulls(len(over), pa.int64())
            for columns in (
                [np.minimum(doc[x], doc[y]), np.maximum(doc[x], doc[y]), pa.nulls(len(x), pa.int64())],
                [none, none, over],
            ):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key, i, j = (batch.column(c).to_numpy() for c in ("key", "i", "j"))
            if not len(key):
                continue
            # the last block may go on in the next batch
            cut = len(key) - int(((key == key[-1]) & (i == i[-1]) & (j == j[-1])).sum())
            if not cut and held and all(held[-1].column(c)[-1] == batch.column(c)[0] for c in ("key", "i", "j")):
                held.append(batch)
                continue
            done = pa.Table.from_batches([*held, batch.slice(0, cut)])
            if done.num_rows:
                yield from pairs_of(done)
            held = [batch.slice(cut)]
        if held:
            yield from pairs_of(pa.Table.from_batches(held))

    return run


def jaccard_components(docs: DataFrame, percent: int = 90, width: int = S.WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id of each row.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, shingles `width` words (all words of
    a shorter text). Null and empty texts have no shingles and link with nothing. Rows
    with equal ids and texts get equal results; ids that stand for different texts are
    compared by either text. A null id links with nothing and gets a null component. Keys travel
    packed, once, to the task of their range; rows are made only of keys that two sets have.
    Other columns are not read. No rows give no rows. Tables on the way to the result are deleted.
    """
    return staged_alone(docs.sparkSession, lambda: _components_of(docs, percent, width), "jaccard-components")


def _components_of(docs: DataFrame, percent: int, width: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    base = stage(
        rows.mapInArrow(_signed(percent, width), "doc_id bigint, n bigint, s1 bigint, s2 bigint, n_keys bigint"), "jaccard-base"
    )
    sign = ["n", "s1", "s2"]
    known = base.where("n > 0 AND doc_id IS NOT NULL")
    nodes = stage(known.groupBy(*sign).agg(F.min("doc_id").alias("node"), F.max("n_keys").alias("n_keys")), "jaccard-nodes")
    total = nodes.agg(F.sum("n_keys")).first()[0] or 0
    ranges = max(1, math.ceil(total / max(RANGE_KEYS, 20 * math.sqrt(total))))
    sent = rows.where("doc_id IS NOT NULL").mapInArrow(
        _sent(percent, width, ranges), "part bigint, codes binary, signs binary"
    )
    met = sent.groupBy("part").applyInPandas(_met, "key bigint, s1 bigint").dropDuplicates(["key", "s1"])
    own = nodes.select(F.col("node").alias("doc_id"), "n", "s1")
    members = stage(met.join(own, "s1").select("key", "doc_id", "n", "s1"), "jaccard-met")
    # sizes of the smallest id's sets: the smallest and, by the same order, the largest
    shared = members.groupBy("key").agg(
        F.count("*").alias("size"),
        F.min("doc_id").alias("head"),
        F.min(F.struct("doc_id", "n"))["n"].alias("head_low"),
        (-F.min(F.struct("doc_id", (-F.col("n")).alias("n")))["n"]).alias("head_high"),
        F.bit_xor(F.xxhash64("s1")).alias("same1"),
        F.bit_xor(F.xxhash64("s1", F.lit(1))).alias("same2"),
    )
    shared = shared.where("size > 1")
    # keys with the same sets make the same pairs: one of them is enough
    once = shared.groupBy("size", "head", "head_low", "head_high", "same1", "same2").agg(F.min("key").alias("key"))
    members = stage(members.drop("s1").join(once.drop("same1", "same2"), "key"), "jaccard-members")
    ids = members.select("doc_id").distinct()
    sketched = _marked(rows, ids).mapInArrow(_sketched(width), "doc_id bigint, n bigint, sketch array<bigint>")
    sketches = stage(sketched.where("n > 0").distinct(), "jaccard-sketches")

    def near(n: str, m: str, x: str, y: str) -> Column:
        """Whether sizes and short sketches leave a link open."""
        most = (100 - percent) * (F.col(n) + F.col(m))
        return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * _distance(x, y) <= most)

    first = (
        members.where(F.col("doc_id") != F.col("head"))
        .where((100 * F.col("n") >= percent * F.col("head_low")) & (100 * F.col("head_high") >= percent * F.col("n")))
        .select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
        .distinct()
    )
    heads = sketches.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    others = sketches.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
    first = first.join(heads, "a").join(others, "b").where(near("n_a", "n_b", "sketch_a", "sketch_b"))
    first = stage(first.select("a", "b").distinct(), "jaccard-first")
    first = stage(_compared(first, rows, percent, width), "jaccard-pairs")
    tried = first.select("a", "b")
    links = first.where("linked").select("a", "b").distinct()
    parts = components(links)
    away = first.groupBy(F.col("a").alias("head"), F.col("b").alias("doc_id")).agg(F.min("differ").alias("away"))
    # `away`: how many shingles differ between the member and the first of its group; null where sizes or
    # sketches already kept the two apart. Symmetric differences obey the triangle inequality, so two
    # members whose `away` lie too far apart cannot link.
    members = stage(
        members.where("size > 2").join(away, ["head", "doc_id"], "left")
        .withColumn("away", F.when(F.col("doc_id") == F.col("head"), F.lit(0)).otherwise(F.coalesce("away", F.lit(-1))))
        .select("key", "doc_id", "n", "head", "size", F.col("away").cast("bigint").alias("away")),
        "jaccard-members",
    )
    limit = FIRST_PAIRS
    while True:
        of_head = parts.select(F.col("node").alias("head"), F.col("component").alias("head_part"))
        placed = members.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").join(of_head, "head", "left")
        placed = placed.withColumn("part", F.coalesce("component", "doc_id"))
        placed = placed.withColumn("other", F.col("part") != F.coalesce("head_part", "head"))
        placed = placed.select("key", "doc_id", "n", "head", "size", "away", "part", "other")
        opened = placed.where("other").groupBy("key").agg(F.count("*").alias("n_other"))
        # heads were compared with all members of their groups
        live = placed.where("doc_id <> head").join(opened, "key").join(sketches, ["doc_id", "n"])
        blocks = _blocks(live).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "doc_id")
        found = stage(blocks.mapInArrow(_possible(percent, limit), "a bigint, b bigint, key bigint"), "jaccard-possible")
        if found.isEmpty():
            break
        pairs = found.where("a IS NOT NULL").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
        pairs = stage(pairs, "jaccard-pairs")
        if not pairs.isEmpty():
            tried = tried.unionByName(pairs)
            new = stage(_compared(pairs, rows, percent, width).where("linked"), "jaccard-links")
            if not new.isEmpty():
                links = links.unionByName(new.select("a", "b"))
                parts = components(links)
        more = found.where("key IS NOT NULL").select("key").distinct()
        if more.isEmpty():
            break
        members = stage(members.join(more, "key", "left_semi"), "jaccard-members")
        limit *= MORE_PAIRS

    found = nodes.join(parts, "node", "left").select(*sign, F.coalesce("component", "node").alias("component"))
    out = base.select("doc_id", *sign).join(found, sign, "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )
