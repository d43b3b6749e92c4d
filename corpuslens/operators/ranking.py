"""Positions of rows without a single-task sort.

A plain `row_number() over (partition by class)` puts a whole class - perhaps a
third of all rows - into one task, and without a partition it puts everything
there. Here the order key is cut into buckets, rows are numbered inside each
(class, bucket), and the row counts of the buckets before it are added. The
bucket table is bounded by `buckets x classes`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.functions.hashing import hash_key
from corpuslens.schema import ID

SPLITS = 255
BUCKET_ROWS = 20_000


def hash_rank(
    df: DataFrame,
    by: list[str] | None = None,
    id_col: str = ID,
    seed: int | str = 42,
    out: str = "rn",
    rows: int = 0,
) -> DataFrame:
    """0-based position of each row in seeded hash order, within `by`.

    Buckets are the first hex digits of the hash, of equal expected size whatever the
    ids look like: three digits, and more where `rows`, the number of rows, asks for it.
    """
    return _number(_hash_keyed(df, id_col, seed, rows), list(by or []), [F.col("_key"), F.col(id_col)], out).drop("_key")


def _hash_keyed(df: DataFrame, id_col: str, seed: int | str, rows: int) -> DataFrame:
    digits = 3
    while rows > BUCKET_ROWS * 16**digits:
        digits += 1
    return df.withColumn("_key", hash_key(id_col, seed)).withColumn("_bucket", F.substring("_key", 1, digits))


def ordered_rank(
    df: DataFrame, order_col: str, by: list[str] | None = None, out: str = "rn"
) -> DataFrame:
    """0-based position of each row by a unique `order_col`, within `by`.

    Buckets are ranges between split points taken from a hash sample of the
    order column (at most 255 values come to the driver).
    """
    return _number(_range_keyed(df, order_col), list(by or []), [F.col(order_col)], out)


def _range_keyed(df: DataFrame, order_col: str) -> DataFrame:
    sample = (
        df.select(F.col(order_col).alias("v"))
        .orderBy(hash_key("v", "splits"), "v")
        .limit(SPLITS)
    )
    points = sorted(row.v for row in sample.collect() if row.v is not None)
    kind = df.schema[order_col].dataType

    def below(low: int, high: int) -> Column:
        """How many of the points, known to be `low` to `high`, are not above the value; halved at each step."""
        if low == high:
            return F.lit(low)
        at = (low + high) // 2
        return F.when(F.lit(points[at]).cast(kind) <= F.col(order_col), below(at + 1, high)).otherwise(below(low, at))

    return df.withColumn("_bucket", below(0, len(points)))


def _number(keyed: DataFrame, by: list[str], order: list[Column], out: str) -> DataFrame:
    group = [*by, "_bucket"]
    starts = _starts(keyed, by).drop("_n")
    within = Window.partitionBy(*group).orderBy(*order)
    numbered = keyed.withColumn("_in", F.row_number().over(within))
    # `numbered` is already placed and sorted by (class, bucket), so only the small
    # table of starts moves for this join.
    return (
        numbered.join(starts, group)
        .withColumn(out, (F.col("_start") + F.col("_in") - 1).cast("bigint"))
        .drop("_bucket", "_start", "_in")
    )


def _starts(keyed: DataFrame, by: list[str]) -> DataFrame:
    """Rows of each (class, bucket), and of the buckets of its class before it."""
    counts = keyed.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*by, "_bucket", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))


def hash_bounds(
    df: DataFrame, places: dict, label: str | None, id_col: str = ID, seed: int | str = 42
) -> dict[tuple, tuple]:
    """(class, place) -> (hash, id) of the row at that 0-based place of its class in hash order.

    Only the id and the label are ranked; the few rows asked for come to the driver, and a
    wide table is then cut by comparing each row's own hash with them. `places` has a list
    of places for each class (of the one class None, without a label).
    """
    narrow = df.select(*([label] if label else []), id_col)
    keyed = _hash_keyed(narrow, id_col, seed, sum(max(p, default=0) for p in places.values()))
    return _rows_at(keyed, places, label, ("_key", id_col))


def ordered_bounds(df: DataFrame, order_col: str, places: dict, label: str) -> dict[tuple, tuple]:
    """(class, place) -> (value,) of the row at that 0-based place of its class in the order of `order_col`."""
    return _rows_at(_range_keyed(df.select(label, order_col), order_col), places, label, (order_col,))


def _rows_at(keyed: DataFrame, places: dict, label: str | None, names: tuple[str, ...]) -> dict[tuple, tuple]:
    """Rows at `places` in the order of `names`. Only the buckets that one of them lies in are sorted."""
    lists = {c: F.array(*[F.lit(p).cast("bigint") for p in ps]) for c, ps in places.items() if ps}
    if not lists:
        return {}
    wanted = by_class(label, lists) if label else lists[None]
    by = [label] if label else []
    first, n = F.col("_start"), F.col("_n")
    hit = _starts(keyed, by).where(F.exists(wanted, lambda p: (p >= first) & (p < first + n))).drop("_n")
    within = Window.partitionBy(*by, "_bucket").orderBy(*names)
    ranked = keyed.join(F.broadcast(hit), [*by, "_bucket"]).withColumn("_rn", F.col("_start") + F.row_number().over(within) - 1)
    rows = ranked.where(F.array_contains(wanted, F.col("_rn"))).collect()
    return {(r[label] if label else None, r._rn): tuple(r[n] for n in names) for r in rows}


def hash_below(bound: tuple, id_col: str = ID, seed: int | str = 42) -> Column:
    """Whether a row stands at or before the row `bound` of `hash_bounds`."""
    key = hash_key(id_col, seed)
    return (key < F.lit(bound[0])) | ((key == F.lit(bound[0])) & (F.col(id_col) <= F.lit(bound[1])))


def class_counts(df: DataFrame, label: str = "label", limit: int = 10_000) -> dict:
    """Rows per label, on the driver; refuses a column that is not a class label."""
    rows = df.groupBy(label).agg(F.count("*").alias("n")).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{label} has more than {limit} values: not a class label")
    if any(row[label] is None for row in rows):
        raise ValueError(f"{label} has NULL values")
    return {row[label]: row.n for row in sorted(rows, key=lambda r: r[label])}


def by_class(label: str, values: dict, otherwise=None) -> Column:
    """CASE over a small dictionary class -> value."""
    rule = None
    for key, value in values.items():
        test = F.col(label) == F.lit(key)
        value = value if isinstance(value, Column) else F.lit(value)
        rule = F.when(test, value) if rule is None else rule.when(test, value)
    if rule is None:
        return F.lit(otherwise)
    return rule if otherwise is None else rule.otherwise(F.lit(otherwise))
