"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Pre-tokens repeat: a corpus has far fewer distinct ones than occurrences. The
merges, the costly part, therefore run once for each distinct pre-token of the
whole corpus:

1. Documents are cut into pre-tokens; each block of documents keeps its
   distinct pre-tokens once, and the occurrences as positions into them.
2. The distinct pre-tokens are exploded into word buckets (a hash of the word)
   and shuffled by bucket. A bucket's task meets every block's share of its
   words and encodes each distinct word once.
3. The ids go back to their blocks (grouped by block, with the positions, which
   took the same way) and are put in the order of the positions.

Texts are cut once; a block's name is its task's number and its own within it.

A shuffled row holds one block's words of one bucket, compressed. A very
frequent word is one entry a block, so no bucket is hot, and a bucket's task
keeps only its distinct words. Blocks are bounded by ``block_chars``. The table
of token bytes, whose size is the vocabulary's, is joined inside the tasks.

Defined cases: a null or empty text has no ids and decodes to no bytes;
repeated rows give repeated results; an empty table gives an empty table;
extra columns are not looked at. A null ``doc_id`` is carried along.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coopspark.llm.common import columns_of, slices
from coopspark.plans.stage import split_count

BLOCK_CHARS = 16_000_000
BUCKETS_PER_PARTITION = 4
_ROWS = "bucket int, block bigint, data binary, doc_ids array<bigint>, counts array<int>, seq binary"
_loaded: dict[tuple[str, str], object] = {}


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: a line has a token in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def vocabulary_key(ranks: dict[bytes, int]) -> str:
    """A digest of all tokens and ranks: workers serve several vocabularies in one session."""
    digest = xxhash.xxh3_128()
    for token, rank in sorted(ranks.items()):
        digest.update(struct.pack("<qI", rank, len(token)) + token)
    return digest.hexdigest()


def token_table(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """(id int, bytes binary): one row for each token of the vocabulary."""
    return spark.createDataFrame([(i, bytearray(b)) for b, i in ranks.items()], "id int, bytes binary")


def _tiktoken(ranks: dict[bytes, int], pattern: str, key: str):
    """The task's encoder; Python workers are reused, so it is built once in each."""
    if (key, pattern) not in _loaded:
        import tiktoken

        _loaded[key, pattern] = tiktoken.Encoding(key, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[key, pattern]


def _ragged(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """data[starts[i]:starts[i]+lengths[i]] for all i, end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return data[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


def _packed(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as byte planes, zstd: upper planes of small numbers nearly vanish."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _packed_words(words: list[bytes]) -> bytes:
    """Lengths as numbers, then all bytes, zstd."""
    import zstandard

    head = _packed(np.fromiter(map(len, words), "<u4", len(words)))
    return struct.pack("<I", len(head)) + head + zstandard.ZstdCompressor(level=3).compress(b"".join(words))


def _unpacked_words(data: bytes) -> list[bytes]:
    import zstandard

    (n,) = struct.unpack_from("<I", data)
    ends = np.cumsum(_unpacked(data[4 : 4 + n]).astype(np.int64)).tolist()
    text = zstandard.ZstdDecompressor().decompress(data[4 + n :])
    return [text[i:j] for i, j in zip([0, *ends], ends, strict=False)]


def _cut(batches: Iterator[pa.RecordBatch], pattern: str, block_chars: int) -> Iterator[tuple[int, list[bytes], list, list[int], np.ndarray]]:
    """Blocks: number, distinct words with the most frequent ones first, document ids, words in each document, positions."""
    import regex

    find, made = regex.compile(pattern).findall, TaskContext.get().partitionId() << 32
    index: dict[str, int] = {}
    ids: list[int | None] = []
    counts: list[int] = []
    seq: list[np.ndarray] = []
    chars = 0

    def block() -> tuple[int, list[bytes], list, list[int], np.ndarray]:
        used = np.concatenate([np.zeros(0, np.int64), *seq])
        order = np.argsort(-np.bincount(used, minlength=len(index)), kind="stable")  # small numbers for frequent words
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        words = list(index)
        return made, [words[i].encode() for i in order.tolist()], ids, counts, rank[used]

    for batch in slices(batches, 64):
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for at in range(len(texts)):
            words = find(texts[at])
            ids.append(batch.column(0)[at].as_py())
            counts.append(len(words))
            # A text's words are numbered in one pass; only its distinct ones are looked up.
            coded = pa.array(words, pa.string()).dictionary_encode()
            place = [index.setdefault(w, len(index)) for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
            seq.append(np.array(place, np.int64)[coded.indices.to_numpy()])
            chars += len(texts[at])
            if chars >= block_chars:
                yield block()
                made, chars = made + 1, 0
                index, ids, counts, seq = {}, [], [], []
    if ids:
        yield block()


def _buckets(words: list[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(n)


def _rows(bucket: list, block: list, data: list, doc_ids: list, counts: list, seq: list) -> pa.RecordBatch:
    columns = [pa.array(bucket, pa.int32()), pa.array(block, pa.int64()), pa.array(data, pa.binary()), pa.array(doc_ids, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32())), pa.array(seq, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "block", "data", "doc_ids", "counts", "seq"])


def _exploded(pattern: str, block_chars: int, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each block: a row with its positions (bucket n or above), and one for each bucket with the distinct words that belong there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, words, ids, counts, seq in _cut(batches, pattern, block_chars):
            bucket = _buckets(words, n)
            order = np.argsort(bucket, kind="stable")
            found, starts = np.unique(bucket[order], return_index=True)
            spans = np.split(order, starts[1:]) if len(found) else []
            packs = [_packed_words([words[i] for i in span.tolist()]) for span in spans]
            none = [None] * len(packs)
            yield _rows([n + hash(name) % n, *found.tolist()], [name] * (len(packs) + 1), [_packed(bucket), *packs], [ids, *none], [counts, *none], [_packed(seq), *none])

    return run


def _encode_words(encoder: Callable[[], Callable[[bytes], list[int]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by bucket; a bucket's distinct words are encoded once and kept until the next one. Rows of positions pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        at, known = None, {}
        for batch in slices(batches, 64):
            out = []
            for bucket, pack, body in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(5), strict=True):
                if body.is_valid:
                    out.append(pack.as_py())
                    continue
                if bucket != at:
                    at, known = bucket, {}
                parts = []
                for w in _unpacked_words(pack.as_py()):
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = np.array(encode(w), "<u4").tobytes()
                    parts.append(ids)
                out.append(_packed(np.concatenate([np.array([len(parts)], "<u4"), np.fromiter(map(len, parts), "<u4", len(parts)) // 4, np.frombuffer(b"".join(parts), "<u4")])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary()), *batch.columns[3:]], names=batch.schema.names)

    return run


def _assemble(token_bytes: Callable[[], list[bytes]]) -> Callable[[pa.Table], pa.Table]:
    """Word ids of one block back in the order of its documents, and the bytes that they stand for."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("bucket")
        body = rows.slice(rows.num_rows - 1)
        docs, counts = body.column("doc_ids")[0].as_py(), np.array(body.column("counts")[0].as_py(), np.int64)
        seq, buckets = _unpacked(body.column("seq")[0].as_py()), _unpacked(body.column("data")[0].as_py())
        packs = [_unpacked(p.as_py()) for p in rows.slice(0, rows.num_rows - 1).column("data")]
        lengths = np.concatenate([np.zeros(0, np.int64), *[p[1 : 1 + p[0]] for p in packs]]).astype(np.int64)
        flat = np.concatenate([np.zeros(0, "<u4"), *[p[1 + p[0] :] for p in packs]]).astype(np.int32)
        if len(lengths) != len(buckets):
            raise RuntimeError("a block's words are missing")
        # Packs follow each other by bucket, and in the block's order of words within one.
        order = np.argsort(buckets, kind="stable")
        starts, sizes = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        starts[order], sizes[order] = np.cumsum(lengths) - lengths, lengths
        names = token_bytes()
        spelled = list(map(names.__getitem__, flat.tolist()))
        word_bytes = [b"".join(spelled[i : i + n]) for i, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
        ids, decoded, at = [], [], 0
        for n in counts.tolist():
            used = seq[at : at + n]
            ids.append(_ragged(flat, starts[used], sizes[used]))
            decoded.append(b"".join(map(word_bytes.__getitem__, used.tolist())))
            at += n
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        return pa.table({"doc_id": pa.array(docs, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), "decoded": pa.array(decoded, pa.binary())})

    return run


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Every whole text's token ids, and the bytes that these decode to: (doc_id bigint, ids array<int>, decoded binary)."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # as large as the vocabulary, whatever the corpus
    key = vocabulary_key(ranks)

    def encoder() -> Callable[[bytes], list[int]]:
        return _tiktoken(shared.value, pattern, key)._encode_single_piece

    def token_bytes() -> list[bytes]:
        if (key, "bytes") not in _loaded:
            table = [b""] * (max(shared.value.values(), default=-1) + 1)
            for token, i in shared.value.items():
                table[i] = token
            _loaded[key, "bytes"] = table
        return _loaded[key, "bytes"]  # type: ignore[return-value]

    source = columns_of(docs, id_col, text_col).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    parts = split_count(docs)
    n = BUCKETS_PER_PARTITION * parts
    cut = source.mapInArrow(_exploded(pattern, block_chars, n), _ROWS)
    encoded = cut.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_encode_words(encoder), _ROWS)
    return encoded.groupBy("block").applyInArrow(_assemble(token_bytes), "doc_id bigint, ids array<int>, decoded binary")


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded`` (binary): the ids looked up in the token-byte table.

    The table is broadcast, being bounded by the vocabulary, and the join runs
    inside the map task, so the documents aren't shuffled. An id outside the
    vocabulary raises; null ids give null.
    """
    spark = encoded.sparkSession
    table = spark.sparkContext.broadcast({i: b for b, i in ranks.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = table.value
        for batch in slices(batches, 512):
            at = batch.schema.get_field_index(ids_col)
            out = [None if not x.is_valid else b"".join(map(names.__getitem__, x.values.to_numpy(zero_copy_only=False).tolist())) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    from pyspark.sql.types import BinaryType, StructField, StructType

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", BinaryType())]))


def decode_by_join(encoded: DataFrame, tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded): the same as a relational plan, for ids whose vocabulary is itself a large table.

    Ids are exploded with positions, joined with ``tokens`` (id, bytes) and put
    together by position. ``id_col`` must be unique.
    """
    exploded = encoded.select(id_col, F.posexplode(ids_col).alias("pos", "id"))
    joined = exploded.join(tokens, "id").groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("pos", F.hex("bytes").alias("hex")))).alias("parts"))
    bytes_of = F.unhex(F.array_join(F.transform("parts", lambda p: p["hex"]), ""))
    return encoded.select(id_col).join(joined, id_col, "left").select(id_col, F.coalesce(bytes_of, F.lit(b"")).alias("decoded"))


def digests(encoded: DataFrame) -> DataFrame:
    """Counts and SHA-256 digests of ids and decoded bytes."""
    text = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(text.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
