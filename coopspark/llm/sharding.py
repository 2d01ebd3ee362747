"""Reproducible global shuffle into shards by a Feistel permutation of row numbers.

Rows are numbered 0..n-1 in the order of (doc_id, text checksum, size). A
balanced Feistel network permutes the smallest domain 4**w that holds n; a value
that lands at n or beyond is permuted again (cycle walking) until it lies below
n, which keeps the whole a permutation of 0..n-1. Shard and slot are its
remainder and quotient by the number of shards: counts differ by one at most,
slots have no gaps, and both follow from the row number alone. ``row_of`` goes
the other way, so a reader can compute which row any slot holds.

Only (doc_id, size, checksum) are shuffled, once, for the numbering; texts
aren't. No task holds more than a range of ids, and rows that tie are split.

The law is ``rows``. Equal texts are not kept together: counts at most one apart
forbid it for large groups. Defined cases: a null text has no bytes (size 8,
checksum 0); null doc_ids are numbered first; repeated rows get slots of their
own; an empty table gives an empty table; extra columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coopspark.llm.common import columns_of
from coopspark.operators.running import running_sum

ROUNDS = 6
_MASK = (1 << 64) - 1


def _keys(seed: int) -> list[np.uint64]:
    """Round keys: successive outputs of a 64-bit mixer started at the seed."""
    out, state = [], seed & _MASK
    for _ in range(ROUNDS):
        state = (state + 0x9E3779B97F4A7C15) & _MASK
        z = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        out.append(np.uint64((z ^ (z >> 27)) & _MASK))
    return out


def _width(n: int) -> int:
    """Bits of a half, so that 4**width >= n."""
    return max(1, ((max(n, 1) - 1).bit_length() + 1) // 2)


def _round(half: np.ndarray, key: np.uint64, mask: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (half ^ key) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(29))) & mask


def _feistel(values: np.ndarray, width: int, keys: list[np.uint64]) -> np.ndarray:
    bits, mask = np.uint64(width), np.uint64((1 << width) - 1)
    left, right = values >> bits, values & mask
    for key in keys:
        left, right = right, left ^ _round(right, key, mask)
    return (left << bits) | right


def _inverse(values: np.ndarray, width: int, keys: list[np.uint64]) -> np.ndarray:
    bits, mask = np.uint64(width), np.uint64((1 << width) - 1)
    left, right = values >> bits, values & mask
    for key in reversed(keys):
        left, right = right ^ _round(left, key, mask), left
    return (left << bits) | right


def _walk(step, values: np.ndarray, n: int) -> np.ndarray:
    out = step(np.asarray(values, np.uint64))
    while (beyond := out >= np.uint64(n)).any():
        out[beyond] = step(out[beyond])
    return out.astype(np.int64)


def permute(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Places of row numbers (0 <= row < n) in the shuffled order."""
    return _walk(lambda v: _feistel(v, _width(n), _keys(seed)), rows, n)


def row_of(places: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The row numbers at places of the shuffled order."""
    return _walk(lambda v: _inverse(v, _width(n), _keys(seed)), places, n)


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The row number that a shard's slot holds."""
    return int(row_of(np.array([slot * shards + shard]), n, seed)[0])


def number_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, row): sizes, checksums and global row numbers from 0."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    slim = columns_of(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    # Ties are rows alike in all three columns, hence interchangeable; the last key only splits them over partitions.
    slim = slim.withColumn("one", F.lit(1).cast("bigint")).withColumn("tie", F.monotonically_increasing_id())
    return running_sum(slim, "one", ["doc_id", "text_crc32", "size", "tie"], name="row", rows=True).select("doc_id", "size", "text_crc32", (F.col("row") - 1).alias("row"))


def assign(docs: DataFrame, shards: int = 24, seed: int = 20_240_607, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, row, shard, slot) for every document."""
    if shards < 1:
        raise ValueError("shards must be positive")
    numbered = number_rows(docs, id_col, text_col)
    n = docs.count()

    @F.pandas_udf("bigint")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), n, seed))

    placed = numbered.withColumn("place", place("row"))
    return placed.select("doc_id", "size", "text_crc32", "row", (F.col("place") % shards).cast("int").alias("shard"), F.expr(f"place div {int(shards)}").alias("slot"))
