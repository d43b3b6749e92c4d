"""Fixed-length token ids for sequence models, with a vocabulary learned from the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from corpuslens.operators.features import with_tokens
from corpuslens.operators.lookup import list_sizes, look_up, send_table
from corpuslens.schema import ID
from corpuslens.session import stage

# Reserved ids.
PAD, UNKNOWN, START, END = 0, 1, 2, 3
FIRST_WORD = 4
MAX_VOCABULARY = 1_000_000


def token_vocabulary(df: DataFrame, text: str = "text", size: int = 30_522) -> DataFrame:
    """`(token, n, token_id)`: the `size` most frequent tokens of the whole corpus.

    The size of a tokenizer vocabulary is fixed by design. The count of the last
    token that fits comes from the table of distinct counts, which is small (their
    sum is at most the number of tokens); only tokens from there up are sorted.
    """
    counts = (
        with_tokens(df, text)
        .select(F.explode_outer("tokens").alias("token"))
        .where(F.col("token").isNotNull())
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )
    counts = stage(counts, "token-counts")
    above = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    least = (
        counts.groupBy("n")
        .agg(F.count("*").alias("tokens"))
        .withColumn("_above", F.coalesce(F.sum("tokens").over(above), F.lit(0)))
        .where(F.col("_above") < size)
        .agg(F.min("n"))
        .first()[0]
    )
    top = counts.where(F.col("n") >= F.lit(least)).orderBy(F.desc("n"), "token").limit(size)
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "token"))
    return top.withColumn("token_id", (rank + (FIRST_WORD - 1)).cast("int"))


def encode_fixed(
    df: DataFrame,
    vocabulary: DataFrame,
    text: str = "text",
    labels: list[str] | None = None,
    max_len: int = 512,
    id_col: str = ID,
) -> DataFrame:
    """`input_ids` and `attention_mask` of exactly `max_len`, and a double label array.

    Tokens are looked up inside their row, in a vocabulary that every task holds (`MAX_VOCABULARY`
    tokens at most): no token becomes a row, nothing is shuffled. An unknown token is `UNKNOWN`.
    """
    labels = labels or []
    sent = send_table(vocabulary, "token", "token_id", MAX_VOCABULARY)
    if sent is None:
        raise ValueError(f"more than {MAX_VOCABULARY} tokens in the vocabulary")
    body = F.slice("tokens", 1, max_len - 2)
    flags = F.array(*[F.col(c).cast("double") for c in labels]).cast("array<double>").alias("labels")
    tokenised = with_tokens(df, text).select(id_col, body.alias("tokens"), flags)
    ids = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            n = batch.num_rows
            sizes = list_sizes(batch.column("tokens"))
            found = look_up(batch.column("tokens").flatten(), table, UNKNOWN)
            row = np.repeat(np.arange(n), sizes)
            column = np.arange(len(found)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            out = np.full((n, max_len), PAD, dtype=np.int32)
            out[:, 0] = START
            out[row, column + 1] = found
            out[np.arange(n), sizes + 1] = END
            mask = (np.arange(max_len)[None] < sizes[:, None] + 2).astype(np.int32)
            cuts = pa.array(np.arange(n + 1, dtype=np.int32) * max_len)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.ListArray.from_arrays(cuts, pa.array(out.ravel())),
                    pa.ListArray.from_arrays(cuts, pa.array(mask.ravel())),
                    batch.column("labels"),
                ],
                names=[id_col, "input_ids", "attention_mask", "labels"],
            )

    return tokenised.mapInArrow(run, f"{ids}, input_ids array<int>, attention_mask array<int>, labels array<double>")
