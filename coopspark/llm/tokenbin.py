"""Token ids in a binary format of bit-plane-shuffled, zstandard-compressed blocks.

A *frame* holds whole documents. Its ids are cut into blocks of ``block_ids``;
each block is transposed into planes (a plane has byte k, or bit k, of all ids
of the block) and each plane is compressed on its own. Small ids leave the
upper planes constant, which then cost a few bytes. The layout, all integers
little-endian unsigned 32 bit::

    "BPS1" | kind (8 byte planes x 4, or 1 for bit planes) | block_ids | n_ids | n_blocks
    for each block: the compressed length of each plane
    the compressed planes

Frames are the rows of a Parquet dataset written by Spark's own committer (a
lost executor leaves no half file, and any store that Spark writes to will do);
the columns beside the frame are the chunk index: part, chunk, first id in the
part, number of ids, and the documents with their lengths. A reader can skip to
any chunk and decodes each frame by itself.

Parts are even ranges of (doc_id, hash of the text), of which only the ids and
hashes are sorted; texts are tokenized straight into their parts, and one
shuffle sorts the ids. One doc_id with very many texts, or very many null ids,
are thereby split; only rows alike in both stay together. Global offsets need
one total for each part.

Defined cases: a null text is an empty one; a document without ids still has
its end id; null doc_ids come last; repeated rows are written repeatedly, in
order of their ids; an empty table writes no frame and reads back empty.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coopspark.llm.common import columns_of, slices, slices_of_texts
from coopspark.plans.stage import split_count, written

MAGIC = b"BPS1"
BLOCK_IDS = 65_536
CHUNK_IDS = 1_048_576
CACHE_WORDS, CACHE_PIECES = 1_000_000, 1_000_000
_loaded: dict[tuple[str, str], "_Words"] = {}


def _stand_ins() -> dict[int, str]:
    """Byte-level alphabets spell a byte by its Latin-1 character if that is printable, else by the next character from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or (b >= 161 and b != 173)]
    others = [b for b in range(256) if b not in printable]
    of = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
    return {c: "".join(of[b] for b in chr(c).encode()) for c in range(256)}


_STAND_INS = _stand_ins()
FRAME = "part int, chunk int, first_id bigint, n_ids bigint, doc_ids array<bigint>, lengths array<int>, frame binary"


# ---- the codec -------------------------------------------------------------


def _planes(block: np.ndarray, kind: int) -> np.ndarray:
    data = np.ascontiguousarray(block, "<u4")
    if kind == 8:
        return np.ascontiguousarray(data.view(np.uint8).reshape(-1, 4).T)
    bits = np.unpackbits(data.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")


def _from_planes(planes: list[bytes], n: int, kind: int) -> np.ndarray:
    if kind == 8:
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes]).T).view("<u4").ravel()
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes])
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u4").ravel()


def pack(ids: np.ndarray, block_ids: int = BLOCK_IDS, kind: int = 8, level: int = 3) -> bytes:
    """One frame. ``kind``: 8 transposes into byte planes, 1 into bit planes."""
    import zstandard

    if kind not in (1, 8):
        raise ValueError("kind must be 1 (bit planes) or 8 (byte planes)")
    squeeze = zstandard.ZstdCompressor(level=level).compress
    n_blocks = -(-len(ids) // block_ids)
    parts = [squeeze(p.tobytes()) for k in range(n_blocks) for p in _planes(ids[k * block_ids : (k + 1) * block_ids], kind)]
    return MAGIC + struct.pack("<4I", kind, block_ids, len(ids), n_blocks) + np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts)


def unpack(frame: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids ``first`` up to ``last`` of a frame; only the blocks that hold them are decompressed."""
    import zstandard

    if frame[:4] != MAGIC:
        raise ValueError("not a frame")
    kind, block_ids, n, n_blocks = struct.unpack_from("<4I", frame, 4)
    last = n if last is None else min(last, n)
    per = 4 if kind == 8 else 32
    sizes = np.frombuffer(frame, "<u4", n_blocks * per, 20).astype(np.int64)
    ends = 20 + 4 * n_blocks * per + np.concatenate([[0], np.cumsum(sizes)])
    expand, out = zstandard.ZstdDecompressor().decompress, [np.zeros(0, "<u4")]
    low = first // block_ids
    for k in range(low, min(n_blocks, -(-last // block_ids))):
        planes = [expand(frame[ends[k * per + j] : ends[k * per + j + 1]]) for j in range(per)]
        out.append(_from_planes(planes, min(block_ids, n - k * block_ids), kind))
    return np.concatenate(out)[first - low * block_ids : max(first, last) - low * block_ids]


# ---- tokens ----------------------------------------------------------------


class _Cache:
    """Values of many keys at once, two generations of them: the older is dropped when the younger is full, so what is frequent stays."""

    def __init__(self, most: int, make: Callable[[list[str]], list[bytes]]):
        self.half, self.make = most // 2, make
        self.young: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def of(self, keys: list[str]) -> list[bytes]:
        """The values of different keys; those of keys that aren't known are made in one call."""
        if len(self.young) > self.half:
            self.young, self.older = {}, self.young
        young, older = self.young, self.older
        out = list(map(young.get, keys))
        new = []
        for k, value in enumerate(out):
            if value is None:
                value = older.get(keys[k])
                if value is None:
                    new.append(k)
                else:
                    out[k] = young[keys[k]] = value
        for k, value in zip(new, self.make([keys[k] for k in new]) if new else [], strict=True):
            out[k] = value
            if len(keys[k]) <= 64:
                young[keys[k]] = value
        return out


class _Words:
    """Ids of texts whose words are encoded once each while they stay in a cache.

    Sound where ``separable`` says so: no token then reaches across a white
    space, and a text's ids are its words' ids end to end. Words that aren't
    cached are split by the tokenizer's own pattern, all in one pass, if they
    are Latin-1: there NFC changes nothing and lower-casing goes character by
    character. Their pieces need the merges only, again in one call. Other words
    are encoded whole. Without a pattern whole texts are.
    """

    def __init__(self, path: str, pieces: str | None = None, fold: bool = False):
        import regex
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.split = regex.compile(f"{pieces}|\n").findall if pieces else None
        self.fold, self.added = fold, [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merges = Tokenizer.from_file(path)
        self.merges.normalizer, self.merges.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        suffix, known = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        self.ends = np.zeros(1 + max(known.values(), default=0), bool)
        if suffix:
            self.ends[[i for token, i in known.items() if token.endswith(suffix)]] = True
        self.suffix = bool(suffix)
        self.pieces, self.words = _Cache(CACHE_PIECES, self._merged), _Cache(CACHE_WORDS, self._encoded)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _merged(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that are already split and lower-cased: the merges alone, on their bytes' stand-ins."""
        if not self.suffix:
            return [np.array([t.id for t in self.tokenizer.model.tokenize(p.translate(_STAND_INS))], "<u4").tobytes() for p in pieces]
        ids = np.array(self.merges.encode_batch_fast([" ".join(p.translate(_STAND_INS) for p in pieces)], add_special_tokens=False)[0].ids, "<u4")
        # A piece's last token, and no other, ends a word.
        ends, data = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist(), ids.tobytes()
        if len(ends) != len(pieces):
            raise RuntimeError("the tokenizer's merges don't end each piece with an end-of-word token")
        return [data[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def _encoded(self, words: list[str]) -> list[bytes]:
        plain = [w.isascii() or w.encode("latin-1", "replace").decode("latin-1") == w for w in words]
        for k, w in enumerate(words):  # added tokens are found before any split
            if "<" in w and any(t in w for t in self.added):
                plain[k] = False
        joined = "\n".join(w for w, ok in zip(words, plain, strict=True) if ok)
        found = self.split(joined.lower() if self.fold else joined)
        different = [p for p in dict.fromkeys(found) if p != "\n"]
        ids = dict(zip(different, self.pieces.of(different), strict=True))
        each: list[bytes] = []
        held: list[bytes] = []
        for p in found:
            if p == "\n":
                each.append(b"".join(held))
                held = []
            else:
                held.append(ids[p])
        each.append(b"".join(held))
        made = iter(each)
        return [next(made) if ok else self._whole(w) for w, ok in zip(words, plain, strict=True)]

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has."""
        column = pc.fill_null(column, "")
        if self.split is None:
            made = [e.ids for e in self.tokenizer.encode_batch(column.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, "<u4"), *[np.array(i, "<u4") for i in made]]), np.array([len(i) for i in made], np.int64)
        split = pc.ascii_split_whitespace(column)
        bounds = split.offsets.to_numpy().astype(np.int64)
        words = split.flatten().dictionary_encode()
        codes = words.indices.to_numpy().astype(np.int64)
        made = self.words.of(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        data = np.frombuffer(b"".join(made), "<u4")
        lengths = np.fromiter(map(len, made), np.int64, len(made)) // 4
        starts, sizes = (np.cumsum(lengths) - lengths)[codes], lengths[codes]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = data[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], sizes)]
        return ids, np.diff(ends[bounds - bounds[0]])


#: Split alternatives that can match no white space.
_SOLID = {r"[\p{L}]+", r"\p{L}+", r"[\p{N}]", r"[\p{N}]+", r"\p{N}", r"\p{N}+", r"[^\s\p{L}\p{N}]+"}


def separable(path: str) -> tuple[str | None, bool]:
    """The pattern whose matches a tokenizer keeps as separate pieces before byte-level merges, and whether it lower-cases first.

    Decided from what the tokenizer's file declares; None where that doesn't
    make a text's ids its words' ids end to end, and whole texts are encoded.
    """
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    norms = (said.get("normalizer") or {}).get("normalizers") or []
    steps = (said.get("pre_tokenizer") or {}).get("pretokenizers") or []
    known = all(n["type"] in ("NFC", "Lowercase") or (n["type"] == "Replace" and n.get("pattern") == {"Regex": r"\s+"} and n.get("content") == " ") for n in norms)
    plain = all(not t.get("normalized") and not t.get("lstrip") and not t.get("rstrip") and not t.get("single_word") and "<" in t["content"] and not any(c.isspace() for c in t["content"]) for t in said.get("added_tokens") or [])
    model = said["model"]
    if len(steps) != 2 or not known or not plain or model.get("type") != "BPE" or model.get("dropout") or said.get("post_processor"):
        return None, False
    split, level = steps
    kept = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and split["pattern"].get("Regex")
    bytes_only = level.get("type") == "ByteLevel" and not level.get("add_prefix_space") and not level.get("use_regex")
    if not kept or not bytes_only or not all(part in _SOLID or re.fullmatch(r"['a-zA-Z]+", part) for part in kept.split("|")):
        return None, False
    return kept, any(n["type"] == "Lowercase" for n in norms)


def _loaded_words(path: str, digest: str, split: tuple[str | None, bool]) -> _Words:
    """The worker's encoder for a file of that content; Python workers are reused, so it is built once in each."""
    if (path, digest) not in _loaded:
        _loaded[path, digest] = _Words(path, *split)
    return _loaded[path, digest]


def _place(bounds: list[tuple], doc: int | None, tie: int) -> int:
    return bisect_left(bounds, (doc is None, doc or 0, tie))


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", bounds: list[tuple] | None = None) -> DataFrame:
    """(part, doc_id, tie, n_ids, ids binary): whole texts as little-endian unsigned 32-bit ids, 16-bit if all ids of the tokenizer fit.

    ``bounds``: the last (doc_id is null, doc_id or 0, tie) of each part but the
    last one; ``tie`` is a hash of the text.
    """
    from tokenizers import Tokenizer

    split, narrow = separable(tokenizer_path), max(Tokenizer.from_file(tokenizer_path).get_vocab().values(), default=0) < 65536 and (end_id or 0) < 65536
    with open(tokenizer_path, "rb") as f:
        digest = xxhash.xxh3_128_hexdigest(f.read())
    kind, cuts = ("<u2" if narrow else "<u4"), bounds or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _loaded_words(tokenizer_path, digest, split)
        # An id takes four bytes and stands for one at least: offsets of 2**28 bytes of text fit in 32 bits.
        for batch in slices_of_texts(batches, 1, 1024):
            ids, counts = words.texts(batch.column(1))
            if end_id is not None:
                ids = np.insert(ids, np.cumsum(counts), end_id)
                counts = counts + 1
            data = ids.astype(kind)
            ends = np.concatenate([[0], np.cumsum(counts)]) * data.itemsize
            packed = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
            part = [_place(cuts, *key) for key in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), batch.column(0), batch.column(2), pa.array(counts.astype(np.int32)), packed], names=["part", "doc_id", "tie", "n_ids", "ids"])

    return _keyed(docs, id_col, text_col).mapInArrow(run, "part int, doc_id bigint, tie bigint, n_ids int, ids binary")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return columns_of(docs, id_col, text_col).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tie"))


def part_bounds(docs: DataFrame, parts: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple]:
    """The last (doc_id is null, doc_id or 0, tie) of each of ``parts`` even ranges but the last: one row for each part."""
    slim = _keyed(docs, id_col, text_col).select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "tie")
    ranged = slim.repartitionByRange(parts, "none", "id", "tie").groupBy(F.spark_partition_id().alias("p")).agg(F.max(F.struct("none", "id", "tie")).alias("last"))
    return sorted({tuple(r.last) for r in ranged.collect()})[:-1]


# ---- files -----------------------------------------------------------------


def frames(tokens: DataFrame, parts: int, chunk_ids: int = CHUNK_IDS, block_ids: int = BLOCK_IDS, kind: int = 8) -> DataFrame:
    """Frames of whole documents in ascending doc_id order within each part; part p is the task p's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, first = None, 0, 0
        docs: list[int | None] = []
        lengths: list[int] = []
        held: list[np.ndarray] = []
        n = 0

        def out() -> pa.RecordBatch:
            columns = [pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([first], pa.int64()), pa.array([n], pa.int64()), pa.array([docs], pa.list_(pa.int64()))]
            columns += [pa.array([lengths], pa.list_(pa.int32())), pa.array([pack(np.concatenate(held), block_ids, kind)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "chunk", "first_id", "n_ids", "doc_ids", "lengths", "frame"])

        for batch in slices(batches, 256):
            for p, doc, size, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if docs and (p != part or n >= chunk_ids):
                    yield out()
                    chunk, first, n, docs, lengths, held = chunk + 1, first + n, 0, [], [], []
                if p != part:
                    part, chunk, first = p, 0, 0
                docs.append(doc)
                lengths.append(size)
                held.append(np.frombuffer(data, "<u2" if len(data) == 2 * size else "<u4").astype("<u4"))
                n += size
        if docs:
            yield out()

    placed = tokens.repartitionById(parts, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_last(), "tie", "ids")
    return placed.select("part", "doc_id", "n_ids", "ids").mapInArrow(run, FRAME)


def write_ids(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", kind: int = 8) -> DataFrame:
    """Tokenize, write the frames (to ``path``, else to the session's shared folder) and return them as read back."""
    parts = split_count(docs)
    bounds = part_bounds(docs, parts, id_col, text_col)
    made = frames(tokenize(docs, tokenizer_path, end_id, id_col, text_col, bounds), parts, kind=kind)
    if path is None:
        return written(made)
    made.write.parquet(path)
    return open_ids(docs.sparkSession, path)


def open_ids(spark: SparkSession, path: str) -> DataFrame:
    """Written frames."""
    return spark.read.schema(FRAME).parquet(path)


def part_offsets(files: DataFrame) -> DataFrame:
    """(part, offset): ids in all parts before it. One row for each part, so one window over them is small."""
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    return totals.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("offset"))


def read_ids(files: DataFrame) -> DataFrame:
    """(doc_id, start, ids array<int>) from frames: whole documents, each with the number of ids before it."""
    return _per_document(files, lambda ids: ids.astype(np.int32), pa.list_(pa.int32()), "ids", "array<int>")


def ids_crc32(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from frames; the ids stay inside the tasks."""
    return _per_document(files, lambda ids: zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()), pa.int64(), "ids_crc32", "bigint")


def _per_document(files: DataFrame, value, kind: pa.DataType, name: str, sql: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            offset, docs, lengths, frame = (batch.column(k)[0].as_py() for k in range(4))
            ends = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))])
            ids = unpack(frame)
            for at in range(0, len(docs), 1000):
                to = min(at + 1000, len(docs))
                values = [value(ids[ends[i] : ends[i + 1]]) for i in range(at, to)]
                yield pa.RecordBatch.from_arrays([pa.array(docs[at:to], pa.int64()), pa.array(offset + ends[at:to], pa.int64()), pa.array(np.diff(ends[at : to + 1]), pa.int64()), pa.array(values, kind)], names=["doc_id", "start", "n_tokens", name])

    rows = files.join(F.broadcast(part_offsets(files)), "part").select((F.col("offset") + F.col("first_id")).alias("offset"), "doc_ids", "lengths", "frame")
    return rows.mapInArrow(run, f"doc_id bigint, start bigint, n_tokens bigint, {name} {sql}")
