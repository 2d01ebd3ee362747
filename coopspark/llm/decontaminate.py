"""Benchmark passages in documents by Wu-Manber multi-pattern search.

Texts are searched in a plain form: words, lower-cased, between single spaces.
The patterns are the windows of ``width`` consecutive words of each item (one
window for an item of fewer words), with a space at both ends, so that a match
is a match of whole words.

Patterns of similar length form a class with tables of its own. With ``m`` the
shortest length of a class, only the first m bytes of its patterns count for

* the shift table: for each hash of ``b`` bytes, how far the nearest place at
  which such a block stands in a pattern lies from the pattern's m-th byte (a
  block that no pattern has: ``m - b + 1``, the largest shift);
* the buckets: the patterns whose last block (bytes m-b to m) has that hash.

The search looks at a block, skips as far as its shift says, and where that is 0
tests the patterns of the block's bucket, by their first bytes and then by direct
comparison of all bytes. Numpy moves many such searches at once, each over its
own stretch of the text: a shift depends on nothing but the block in front.

Documents are scanned where they are read and not shuffled. The benchmark is cut
into overlapping pieces (no window is lost), and pieces into groups of at most
``group_bytes``; one group's pieces and tables are held at a time, by the driver
and by a broadcast, and each group is one scan of the documents, so a benchmark
of any size has bounded memory.

Defined cases: null, empty and wordless texts have no words, hit nothing and are
hit by nothing; an item's id may be null (it is then listed as the empty text)
and may repeat (its texts are one item); documents are rows, repeated ones too;
empty documents give an empty table and an empty benchmark hits nothing; extra
columns are not looked at. A text is held whole by its task, with some ten times
its bytes, however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coopspark.llm.common import columns_of, slices_of_texts
from coopspark.plans.stage import written

WIDTH = 10
GROUP_BYTES = 16 << 20
PIECE_WORDS = 4096
BATCH_BYTES = 4 << 20
BLOCK, LANES = 8, 8192
CLASSES = (1, 6, 12, 24)  # a class costs as much as its shortest pattern: long ones stay together
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_ITEMS = "item string, piece binary"
_FOUND = "row bigint, doc_id {kind}, n_words bigint, spans array<struct<first:bigint,words:bigint>>, items array<string>"

_plain = np.zeros(256, np.uint8)  # a byte of a word in lower case; 0 for all others
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _plain[_b] = _b
for _b in range(0x41, 0x5B):
    _plain[_b] = _b + 32


def plain(data: np.ndarray) -> np.ndarray:
    """Bytes with words in lower case between single spaces, and one space at either end."""
    own = np.concatenate([np.zeros(1, np.uint8), _plain[data], np.zeros(1, np.uint8)])
    gap = own == 0
    keep = ~gap
    keep[0] = True
    keep[1:] |= gap[1:] & ~gap[:-1]
    out = own[keep]
    out[out == 0] = 32
    return out


def pieces(text: str | None, width: int, words: int = PIECE_WORDS) -> list[bytes]:
    """A text's plain form, cut so that pieces share ``width - 1`` words."""
    all_ = plain(np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)).tobytes().split()
    if not all_:
        return []
    starts = range(0, max(1, len(all_) - width + 1), words)
    return [b" " + b" ".join(all_[a : a + words + width - 1]) + b" " for a in starts]


def _items(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, piece = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for p in pieces(text, width):
                    item.append(name)
                    piece.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(piece, pa.binary())], names=["item", "piece"])

    return run


class Blocks:
    """The b bytes (8 at most) that begin at each place of a text, as numbers; beyond its end they are 0."""

    def __init__(self, text: np.ndarray, b: int):
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        self.view = np.ndarray(len(text) + 1, "<u8", padded, 0, (1,))  # overlapping words
        self.mask = np.uint64(2 ** (8 * b) - 1)

    def at(self, places: np.ndarray) -> np.ndarray:
        return self.view[places] & self.mask


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of the next."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - counts - starts, counts)


class LengthClass:
    """Shift table and buckets of patterns of similar length (places ``start`` in ``text``, lengths ``size``)."""

    def __init__(self, text: np.ndarray, number: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.m = m = int(size.min())
        self.b = b = min(BLOCK, m)
        self.bits = int(min(22, max(12, np.ceil(np.log2(len(start) * (m - b + 1) + 1)) + 3)))
        self.shift = np.full(1 << self.bits, m - b + 1, np.int32)
        blocks = Blocks(text, b)
        for q in range(m - b + 1):
            np.minimum.at(self.shift, self.hash(blocks.at(start + q)), m - b - q)
        last = self.hash(blocks.at(start + m - b))
        order = np.argsort(last, kind="stable")
        self.number, self.start, self.size = number[order], start[order], size[order]
        self.head = blocks.at(self.start)
        self.first = np.searchsorted(last[order], np.arange((1 << self.bits) + 1)).astype(np.int32)

    def hash(self, blocks: np.ndarray) -> np.ndarray:
        return ((blocks * _FACTOR) >> np.uint64(64 - self.bits)).astype(np.int64)

    def candidates(self, text: np.ndarray, blocks: Blocks) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(starts, hashes) of places whose m-th byte ends a block of some pattern's bucket."""
        m, b = self.m, self.b
        n = len(text) - m + 1  # places at which a pattern's first m bytes can begin
        if n <= 0:
            return
        lanes = int(min(LANES, -(-n // 1024)))
        edges = np.linspace(0, n, lanes + 1).astype(np.int64)
        at, end = edges[:-1].copy(), edges[1:].copy()
        while len(at):
            h = self.hash(blocks.at(at + m - b))
            skip = self.shift[h]
            if (hit := skip == 0).any():
                yield at[hit], h[hit]
            at += np.maximum(skip, 1)
            if not (inside := at < end).all():
                at, end = at[inside], end[inside]

    def search(self, text: np.ndarray, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, number) of all occurrences."""
        places, found = [], []
        blocks = Blocks(text, self.b)
        for start, h in self.candidates(text, blocks):
            head = blocks.at(start)
            counts = self.first[h + 1] - self.first[h]
            for a in _bounded(counts):
                member = _ranges(self.first[h[a]].astype(np.int64), counts[a])
                place = np.repeat(start[a], counts[a])
                same = (self.head[member] == np.repeat(head[a], counts[a])) & (place + self.size[member] <= len(text))
                for p, k in zip(place[same].tolist(), member[same].tolist(), strict=True):
                    s, n = self.start[k], self.size[k]
                    if np.array_equal(text[p : p + n], patterns[s : s + n]):
                        places.append(p)
                        found.append(self.number[k])
        return np.array(places, np.int64), np.array(found, np.int64)


def _bounded(counts: np.ndarray, most: int = 1_000_000) -> Iterator[slice]:
    """Slices whose counts add up to about ``most`` at most."""
    ends = np.cumsum(counts)
    a = 0
    while a < len(counts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield slice(a, b)
        a = b


@dataclass
class Patterns:
    """The distinct windows of a group of pieces, their tables, and the items that have them."""

    text: np.ndarray
    words: np.ndarray  # of each pattern
    items: list[str]  # sorted as strings
    owner_first: np.ndarray
    owner: np.ndarray
    classes: list[LengthClass]


def compile_patterns(rows: list[tuple[str, bytes]], width: int) -> Patterns:
    """Windows of all pieces. Equal windows are one pattern, told apart by 128-bit hashes."""
    items = sorted({item for item, _ in rows}, key=lambda s: s.encode("utf-8", "surrogatepass"))
    code = {item: k for k, item in enumerate(items)}
    text = np.frombuffer(b"".join(piece for _, piece in rows), np.uint8)
    start, size, words, owner, digest = [], [], [], [], []
    base = 0
    for item, piece in rows:
        spaces = np.flatnonzero(np.frombuffer(piece, np.uint8) == 32)
        k = min(width, len(spaces) - 1)
        a, b = spaces[: len(spaces) - k], spaces[k:] + 1
        start.append(a + base)
        size.append(b - a)
        words.append(np.full(len(a), k))
        owner.append(np.full(len(a), code[item]))
        digest += [xxhash.xxh3_128_digest(piece[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        base += len(piece)
    if not rows:
        none = np.zeros(0, np.int64)
        return Patterns(text, none, items, np.zeros(1, np.int64), none, [])
    start, size, words, owner = (np.concatenate(x).astype(np.int64) for x in (start, size, words, owner))
    _, first, number = np.unique(np.array(digest, "S16").view("V16"), return_index=True, return_inverse=True)
    pairs = np.unique(np.stack([number.ravel(), owner]), axis=1)
    owner_first = np.searchsorted(pairs[0], np.arange(len(first) + 1))
    start, size, words = start[first], size[first], words[first]
    edges = np.searchsorted(CLASSES, size, "right")
    classes = [LengthClass(text, at := np.flatnonzero(edges == e), start[at], size[at]) for e in np.unique(edges)]
    return Patterns(text, words, items, owner_first, pairs[1], classes)


def search_texts(data: np.ndarray, offsets: np.ndarray, patterns: Patterns) -> tuple[np.ndarray, list, list]:
    """Of texts that lie end to end in ``data``: words, hit spans (first word, words) and items of each."""
    n = len(offsets) - 1
    # A byte that is no word's between texts becomes part of the plain form's space; a second one, unlike
    # all plain bytes, keeps matches from crossing.
    parts, docs = [], np.zeros(n + 1, np.int64)
    for k in range(n):
        own = plain(data[offsets[k] : offsets[k + 1]])
        parts += [own, np.zeros(1, np.uint8)]
        docs[k + 1] = docs[k] + len(own) + 1
    text = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    begins = np.zeros(len(text) + 1, np.int64)
    begins[2:] = np.cumsum((text[:-1] == 32) & (text[1:] != 32) & (text[1:] != 0))  # words that begin before a place
    words = begins[docs[1:]] - begins[docs[:-1]]
    places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for c in patterns.classes:
        p, f = c.search(text, patterns.text)
        places.append(p)
        found.append(f)
    place, number = np.concatenate(places), np.concatenate(found)
    spans, items = [[] for _ in range(n)], [[] for _ in range(n)]
    if not len(place):
        return words, spans, items
    doc = np.searchsorted(docs, place, "right") - 1
    first = begins[place + 1]
    hit = np.zeros(int(begins[-1]) + 1, np.int64)
    np.add.at(hit, first, 1)
    np.add.at(hit, first + patterns.words[number], -1)
    covered = np.concatenate([[False], np.cumsum(hit)[:-1] > 0, [False]])
    # Documents' words follow each other: a span ends at its document's end too.
    limits = begins[docs]
    edge = covered[1:] != covered[:-1]
    edge[limits] |= covered[1:][limits] & covered[:-1][limits]
    cuts = np.flatnonzero(edge)
    for a, b in zip(cuts, [*cuts[1:], len(covered) - 1], strict=True):
        if covered[a + 1]:
            k = int(np.searchsorted(limits, a, "right")) - 1
            spans[k].append({"first": int(a - limits[k]), "words": int(b - a)})
    once = np.unique(np.stack([doc, number]), axis=1)
    counts = patterns.owner_first[once[1] + 1] - patterns.owner_first[once[1]]
    owner = patterns.owner[_ranges(patterns.owner_first[once[1]], counts)]
    for k, i in np.unique(np.stack([np.repeat(once[0], counts), owner]), axis=1).T.tolist():
        items[k].append(patterns.items[i])
    return words, spans, items


def _scan(tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = tables.value
        for own in slices_of_texts(batches, 2, 10_000, BATCH_BYTES):
            texts = own.column(2)
            ends = np.cumsum(np.concatenate([[0], pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy()]).astype(np.int64))
            words, spans, items = search_texts(np.frombuffer(b"".join(x for x in texts.to_pylist() if x), np.uint8), ends, patterns)
            kind = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(words, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))], names=["row", "doc_id", "n_words", "spans", "items"])

    return run


def _merged(spans):
    """Overlapping and touching spans of a sorted array made one."""
    start = F.slice(spans, 1, 0)
    last = lambda acc: F.element_at(acc, -1)

    def add(acc, s):
        end = lambda x: x["first"] + x["words"]
        joined = F.struct(last(acc)["first"].alias("first"), (F.greatest(end(last(acc)), end(s)) - last(acc)["first"]).alias("words"))
        rest = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["first"] + F.get(acc, F.size(acc) - 1)["words"] >= s["first"]), F.concat(rest, F.array(joined))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, start, add)


def find_passages(docs: DataFrame, items: DataFrame, width: int = WIDTH, group_bytes: int = GROUP_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, items) for every document.

    ``spans`` are the runs of hit words (first word from 0, number of words), in
    order and apart; ``items`` are the ids, as strings in order, of the items
    that have a window which occurs in the document.
    """
    if width < 1:
        raise ValueError("width must be positive")
    own = columns_of(items, item_col, item_text_col).select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("text"))
    # Rows alike are one; an item's pieces and equal pieces of many items are spread over the groups.
    cut = written(own.mapInArrow(_items(width), _ITEMS).distinct())
    total = cut.agg(F.sum(F.length("piece"))).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    texts = columns_of(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    schema = _FOUND.format(kind=texts.schema["doc_id"].dataType.simpleString())
    spark = docs.sparkSession

    def scan(source: DataFrame, group: int) -> DataFrame:
        # The group's pieces: about ``group_bytes`` of the benchmark.
        rows = [(r.item, bytes(r.piece)) for r in cut.where(F.pmod(F.xxhash64("item", "piece"), F.lit(groups)) == group).collect()]
        return source.mapInArrow(_scan(spark.sparkContext.broadcast(compile_patterns(rows, width))), schema)

    if groups == 1:
        return scan(texts.select(F.lit(0).cast("bigint").alias("row"), "doc_id", "text"), 0).drop("row")
    source = written(texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    parts = [written(scan(source, g).where("size(items) > 0" if g else "true")) for g in range(groups)]
    all_ = parts[0]
    for part in parts[1:]:
        all_ = all_.unionByName(part)
    gathered = all_.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return gathered.select("doc_id", "n_words", _merged(F.col("spans")).alias("spans"), "items")
