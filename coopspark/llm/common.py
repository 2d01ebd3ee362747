"""Helpers shared by the corpus operators.

Words everywhere are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; for
UTF-8 text that equals ``bytes.split()`` with no argument, and ``bytes.lower()``
lower-cases exactly A-Z.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coopspark.plans.stage import split_count

WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns. Extra columns, whatever they are called, never reach an operator's internals."""
    return df.select(*[df[n] for n in names])


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of the id as text is divisible by ``folds`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Re-slice Arrow batches (zero copy), so that Python objects exist for few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def slices_of_texts(batches: Iterator[pa.RecordBatch], column: int, rows: int, most: int = 1 << 28) -> Iterator[pa.RecordBatch]:
    """As ``slices``, and with ``most`` bytes in a text column at most (a longer text is a slice of its own)."""
    for batch in slices(batches, rows):
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for k, size in enumerate(sizes):
            if k > start and held + size > most:
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += size
        if batch.num_rows:
            yield batch.slice(start)


def one_text(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each value of ``keys``, the first of which spreads the work, with its least text: repeated ids don't exceed a sample's bound."""
    return rows.repartition(split_count(rows), keys[0]).groupBy(*keys).agg(F.min("text").alias("text"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, limit: int, id_col: str = "doc_id", text_col: str = "text", where: Column | None = None) -> DataFrame:
    """(doc_id, text, label) of at most ``limit`` labelled documents of the training folds, for fitting.

    The choice is by a hash of the id, so it is the same at any partitioning.
    Only ids meet in the sort; the chosen ones (``limit`` of them at most, so a
    bounded broadcast) then pick their texts in one scan of ``docs``; of an id's
    several texts the least one counts.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    if where is not None:
        known = known.where(where)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    found = columns_of(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    return one_text(found, "doc_id", "label")
