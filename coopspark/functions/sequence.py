"""Column expressions on nucleotide sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType


_COMPLEMENT = str.maketrans("ACGT", "TGCA")


def letter_codes(texts: pa.Array, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins (and the last ends); ``wide``: code points in place of bytes."""
    if wide:
        known = [s or "" for s in texts.to_pylist()]
        return np.frombuffer("".join(known).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum([0, *map(len, known)])
    texts = texts.cast(pa.large_string())
    _, ends, data = texts.buffers()
    at = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


@F.arrow_udf(ArrayType(ArrayType(FloatType())))
def _one_hot(texts: pa.Array) -> pa.Array:
    codes, at = letter_codes(texts)
    if (codes > 127).any():
        codes, at = letter_codes(texts, wide=True)
    n = np.diff(at)
    flat, width = np.zeros(4 * len(codes), np.float32), np.repeat(n, n)
    place = np.arange(len(codes)) + 3 * np.repeat(at[:-1], n)  # a text's four rows lie side by side
    for base in b"ACGT":
        flat[place] = codes == base
        place += width
    rows = np.concatenate([[0], np.cumsum(np.repeat(n, 4))]).astype(np.int32)
    rows = pa.ListArray.from_arrays(pa.array(rows), pa.array(flat))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) + 1, 4, dtype=np.int32)), rows, mask=texts.is_null())


def one_hot(seq: Column) -> Column:
    """Four rows (A, C, G, T) of 0/1; any other letter is 0 in all of them. By Arrow batches: lambdas over letters are interpreted."""
    return _one_hot(seq)


@F.arrow_udf(StringType())
def _reverse_complement(texts: pa.Array) -> pa.Array:
    return pa.array([None if s is None else s[::-1].translate(_COMPLEMENT) for s in texts.to_pylist()], pa.string())


def reverse_complement(seq: Column) -> Column:
    return _reverse_complement(seq)


@F.arrow_udf(ArrayType(StringType()))
def both_strands(texts: pa.Array) -> pa.Array:
    """An array of each text and its reverse complement, nulls where it is null."""
    out = [x for s in texts.to_pylist() for x in ((s, s[::-1].translate(_COMPLEMENT)) if s is not None else (None, None))]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(out) + 1, 2, dtype=np.int32)), pa.array(out, pa.string()))


def _texts(codes: np.ndarray, at: np.ndarray, like: pa.Array) -> pa.Array:
    """Bytes and where each text begins as an array of texts, null where ``like`` is."""
    known = like.is_valid().to_numpy(zero_copy_only=False)
    nulls = pa.py_buffer(np.packbits(known, bitorder="little")) if not known.all() else None
    return pa.LargeStringArray.from_buffers(len(like), pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(np.ascontiguousarray(codes)), nulls).cast(pa.string())


def translated(seq: Column, letters: str, others: str) -> Column:
    """``seq`` with each of ``letters`` (ASCII) replaced by the one of ``others`` at its place; a table look-up a batch, where Spark's translate makes a string a letter."""
    table, names = np.arange(256, dtype=np.uint8), str.maketrans(letters, others)
    table[list(letters.encode("ascii"))] = list(others.encode("ascii"))

    @F.arrow_udf(StringType())
    def mapped(texts: pa.Array) -> pa.Array:
        codes, at = letter_codes(texts)
        if (codes > 127).any():
            return pa.array([None if s is None else s.translate(names) for s in texts.to_pylist()], pa.string())
        return _texts(table[codes], at, texts)

    return mapped(seq)


def _substring(s: str, place: int, length: int) -> str:
    """As SQL's substring: places count from 1, from the end if negative."""
    low = place - 1 if place > 0 else len(s) + place if place < 0 else 0
    return s[max(low, 0) : max(low + length, 0)]


def _masked_text(s: str, start: int, end: int) -> str:
    n = max(min(end + 1, len(s)) - start, 0)
    return _substring(s, 1, start) + "N" * n + _substring(s, start + n + 1, len(s))


def masked_texts(texts: pa.Array, *ends: pa.Array) -> pa.Array:
    """``masked`` of a batch with one span (start, end) after the other; a null start gives null."""
    keep = texts.is_valid().to_numpy(zero_copy_only=False)
    for start in ends[::2]:
        keep &= start.is_valid().to_numpy(zero_copy_only=False)
    codes, at = letter_codes(texts)
    starts = [x.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False) for x in ends[::2]]
    stops = [x.cast(pa.int64()).fill_null(2**62).to_numpy(zero_copy_only=False) for x in ends[1::2]]  # no end: up to the text's
    if (codes > 127).any() or any((a < 0).any() for a in starts):
        rows = [s if k else None for s, k in zip(texts.to_pylist(), keep, strict=True)]
        for a, b in zip(starts, stops, strict=True):
            rows = [None if s is None else _masked_text(s, int(i), int(j)) for s, i, j in zip(rows, a, b, strict=True)]
        return pa.array(rows, pa.string())
    codes, n = codes.copy(), np.diff(at)
    for a, b in zip(starts, stops, strict=True):
        size = np.maximum(np.minimum(b, n - 1) + 1 - a, 0)
        size[~keep] = 0
        first = np.cumsum(size) - size
        codes[np.arange(size.sum()) + np.repeat(at[:-1] + a - first, size)] = ord("N")
    return _texts(codes, at, pa.array(keep, mask=~keep))


_masked_by_batch = F.arrow_udf(masked_texts, StringType())


def masked_by_batch(seq: Column, *spans: tuple[Column, Column]) -> Column:
    """``masked`` with one span after the other, by Arrow batches: a model in Python gets the masked text in the pass that makes it."""
    return _masked_by_batch(seq, *[c for span in spans for c in span])


def masked(seq: Column, start: Column, end: Column) -> Column:
    """``seq`` with N from ``start`` to ``end`` (0-based, the end included, clipped at the sequence's end)."""
    n = F.greatest(F.least(end + 1, F.length(seq)) - start, F.lit(0)).cast("int")
    return F.concat(F.substring(seq, F.lit(1), start.cast("int")), F.repeat(F.lit("N"), n), F.substring(seq, (start + n + 1).cast("int"), F.length(seq)))


def masked_spans(seq: Column, spans: Column, errors: str = "raise") -> Column:
    """``seq`` with every span (struct of start and end, the end included) masked.

    Spans may come in any order. Two that share a position raise, or give null
    with ``errors="null"``; touching is sharing, as an end is included.
    """
    ordered = F.array_sort(spans)
    clash = F.exists(F.sequence(F.lit(1), F.greatest(F.size(ordered) - 1, F.lit(1))), lambda k: (F.size(ordered) > k) & (F.get(ordered, k)["start"] < F.get(ordered, k - 1)["end"] + 1))
    out = F.aggregate(ordered, seq, lambda s, span: masked(s, span["start"], span["end"]))
    return F.when(~clash, out).otherwise(F.raise_error(F.lit("overlapping spans")).cast("string") if errors == "raise" else F.lit(None).cast("string"))
