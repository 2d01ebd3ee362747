"""Near-duplicate documents: max-min hashing, banding, confirmation, components.

A document's set holds its distinct word shingles. Under each of ``permutations``
hash orders both the least and the greatest value are kept: each is a fair draw
from the set, so one evaluation gives two signature values. Bands of ``rows``
values are all minima or all maxima of different permutations. Documents that
share a band are candidates; a link needs ``100 * intersection >= percent *
union`` on the full sets.

No group is expanded into pairs:

1. Documents with equal sets are one class from the start (a hash of the set).
2. In each bucket of two or more classes a *hub*, the class with the most
   bucket companions, is compared with all others: as many pairs as members.
   Pairs are spread by (hub, salt), so a hub of very many is many tasks' work.
3. Where the members that remain (without the hub) already are one component,
   no further link can matter. Members of other buckets are compared with those
   of another component that share one of their *rarest* shingles: two linked
   sets must share one of the ``n - ceil(0.8 n) + 1`` rarest ones of each, so
   nothing is lost, and a passage that very many documents have opens no pairs.
   Shingles that the same members have are one group. Places in that order, sizes
   and shared bands exclude most pairs before any set is looked at.
4. The sets of what is left go to the groups' blocks, once for each pair of
   blocks, and are intersected there: a document's shingles are marked in the
   block's vocabulary, and the marks under all others' sets are added up. Pairs
   that links already connect are skipped, and no table of pairs is made.

Documents that are all nearly, but not quite, similar enough remain pairs to be
looked at (g * g / 2 for g of them, at about a microsecond each for texts of a
few hundred words); their sets are shipped g / BLOCK times.

Every pair of a bucket is thereby compared, excluded or already connected,
whatever the bucket's size; recall is that of the banding (a pair at similarity
0.8 is missed with probability below 1e-5 at 24 bands of 4).

Defined cases: null, empty or blank texts have empty sets (0 shingles) and are
linked with nothing; fewer words than a shingle's make one shingle; repeated
rows are one class; a component's id is its least non-null doc_id, null if there
is none; empty tables give empty results; extra columns are not looked at, and
are kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from coopspark.llm.common import columns_of, slices, utf8
from coopspark.operators.components import connected_components
from coopspark.plans.stage import small, split_count, written

PERMUTATIONS, ROWS = 48, 4
PER_SALT = 256
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
CACHE_WORDS = 200_000
REP_ROWS = 1_000_000


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, np.uint64) | np.uint64(1)


def shingles(text: str | None, width: int, known: dict[bytes, int] | None = None) -> np.ndarray:
    """The set of a text's shingles as sorted 64-bit hashes. ``known``: words' hashes, kept as long as a task runs."""
    words = utf8(text).lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = {} if known is None else known
    if len(known) > CACHE_WORDS:
        known.clear()
    codes = []
    for w in words:
        c = known.get(w)
        if c is None:
            c = known[w] = xxhash.xxh3_64_intdigest(w)
        codes.append(c)
    h = np.array(codes, np.uint64)
    k = min(width, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = (out ^ h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(s: np.ndarray, permutations: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of a set under each permutation."""
    flips, factors = _odd(permutations, 11), _odd(permutations, 12)
    low, high = np.full(permutations, 2**64 - 1, np.uint64), np.zeros(permutations, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 2048):
            v = (s[at : at + 2048, None] ^ flips) * factors
            low, high = np.minimum(low, v.min(axis=0)), np.maximum(high, v.max(axis=0))
    return low, high


def band_keys(s: np.ndarray, permutations: int = PERMUTATIONS, rows: int = ROWS) -> list[int]:
    """One 64-bit key for each band: the bands of minima, then those of maxima."""
    keys = []
    for side, values in enumerate(signature(s, permutations)):
        for band in range(permutations // rows):
            keys.append(xxhash.xxh3_64_intdigest(values[band * rows : (band + 1) * rows].tobytes(), seed=2 * band + side))
    return np.array(keys, np.uint64).view(np.int64).tolist()


def enough(both: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes a and b with ``both`` common shingles are linked."""
    return 100 * both >= percent * (a + b - both)


def _describe(width: int, permutations: int, rows: int, text_at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, known = TaskContext.get().partitionId() << 33, {}
        for batch in slices(batches):
            n, digest, keys = [], [], []
            for text in batch.column(text_at).to_pylist():
                s = shingles(text, width, known)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(band_keys(s, permutations, rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(range(row, row + batch.num_rows), pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=[*batch.schema.names, "row", "n", "digest", "keys"])
            row += batch.num_rows

    return run


def _sets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column end to end, and where each list begins and the last one ends."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _compare_with_hub(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (hub, salt, row, set) sorted by (hub, salt, row is not the hub): the hub's set comes first, its members follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.zeros(0, np.int64)
        for batch in slices(batches, 256):
            hub, row = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            values, starts = _sets_of(batch.column(3))
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            heads = np.flatnonzero(row == hub)
            for lo, hi in zip([0, *heads.tolist()], [*heads.tolist(), len(row)], strict=True):
                if lo == hi:
                    continue
                if row[lo] == hub[lo]:
                    at, own = hub[lo], np.sort(values[starts[lo] : starts[lo + 1]])
                    lo += 1
                if lo == hi:
                    continue
                if (hub[lo:hi] != at).any():
                    raise RuntimeError("a hub's set is missing")
                part = values[starts[lo] : starts[hi]]
                hit = own[np.minimum(np.searchsorted(own, part), len(own) - 1)] == part
                both = np.add.reduceat(hit.astype(np.int64), starts[lo:hi] - starts[lo])
                good = enough(both, len(own), np.diff(starts[lo : hi + 1]), percent)
                a.append(row[lo:hi][good])
                b.append(hub[lo:hi][good])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def _shingled(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (row, text) as (row, n, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in slices(batches, 128):
            sets = [shingles(text, width, known).view(np.int64) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["row", "n", "set"])

    return run


class _Group:
    """Members of a shingle's pair of blocks: columns (block, rep, component, n, place), sketches, and sets if they were shipped."""

    def __init__(self, parts: list[tuple], percent: int):
        self.percent = percent
        self.block, self.rep, component, self.n, self.place = (np.concatenate([p[k] for p in parts]) for k in range(5))
        self.component = np.unique(component, return_inverse=True)[1]
        self.sketch = np.concatenate([p[5] for p in parts])
        self.values = np.concatenate([p[6] for p in parts]) if parts[0][6] is not None else None
        self.starts = np.concatenate([[0], np.cumsum(self.n)])

    def partners(self, x: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that can be linked with x, and aren't connected yet.

        Two sets that share their ``place``-th and other rarest shingle have at
        most ``min(n - place)`` in common if it is the first that they share;
        that, their sizes and the bands must allow a link.
        """
        others = others[self.component[others] != self.component[x]]
        most = np.minimum(self.n[x] - self.place[x], (self.n - self.place)[others])
        others = others[(100 + self.percent) * most >= self.percent * (self.n[x] + self.n[others])]
        return others[(self.sketch[others] == self.sketch[x]).any(axis=1)]

    def sides(self, i: int, j: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each member of block i, with the members of block j to look at."""
        left, right = np.flatnonzero(self.block == i), np.flatnonzero(self.block == j)
        for k, x in enumerate(left.tolist()):
            yield x, (left[k + 1 :] if i == j else right)

    def candidates(self, i: int, j: int) -> np.ndarray:
        """The members that have a partner."""
        seen = np.zeros(len(self.rep), bool)
        for x, others in self.sides(i, j):
            found = self.partners(x, others)
            if len(found):
                seen[x] = True
                seen[found] = True
        return self.rep[seen]

    def links(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Links that connect all that linked pairs connect."""
        code = np.unique(self.values, return_inverse=True)[1]
        mark = np.zeros(int(code.max(initial=-1)) + 1, np.int32)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x, others in self.sides(i, j):
            found = self.partners(x, others)
            if not len(found):
                continue
            own = code[self.starts[x] : self.starts[x + 1]]
            mark[own] = 1
            sizes = self.n[found]
            ends = np.cumsum(sizes)
            under = code[np.arange(ends[-1]) - np.repeat(ends - sizes - self.starts[found], sizes)]
            both = np.add.reduceat(mark[under], ends - sizes)
            mark[own] = 0
            linked = found[enough(both, self.n[x], sizes, self.percent)]
            a.append(np.maximum(self.rep[linked], self.rep[x]))
            b.append(np.minimum(self.rep[linked], self.rep[x]))
            self.component[np.isin(self.component, self.component[linked])] = self.component[x]
        return np.concatenate(a), np.concatenate(b)


def _by_group(percent: int, with_sets: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (shingle, i, j, block, rep, component, n, place, sketch[, set]) sorted by (shingle, i, j): candidates (shingle, i, j, rep), or with sets, links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def done() -> pa.RecordBatch:
            group = _Group(held, percent)
            if with_sets:
                a, b = group.links(at[1], at[2])
                return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            reps = group.candidates(at[1], at[2])
            key = [pa.array([k] * len(reps), kind) for k, kind in zip(at, (pa.int64(), pa.int32(), pa.int32()), strict=True)]
            return pa.RecordBatch.from_arrays([*key, pa.array(reps)], names=["shingle", "i", "j", "rep"])

        for batch in slices(batches, 1024):
            key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)], axis=1)
            rest = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3, 8)]
            rest.append(np.frombuffer(b"".join(batch.column(8).to_pylist()), "<u2").reshape(batch.num_rows, -1))
            values, starts = _sets_of(batch.column(9)) if with_sets else (None, None)
            bounds = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if (now := tuple(key[lo].tolist())) != at:
                    if held:
                        yield done()
                    at, held = now, []
                held.append((*[part[lo:hi] for part in rest], values[starts[lo] : starts[hi]] if with_sets else None))
        if held:
            yield done()

    return run


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among pairs (hub, rep): spread by (hub, salt), so that a hub of very many is many tasks' work."""
    spread = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).withColumn("salts", F.ceil(F.col("n") / PER_SALT).cast("int"))
    spread = written(spread)
    salted = pairs.join(small(spread, REP_ROWS), "hub").select("hub", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int").alias("salt"), F.col("rep").alias("row"))
    copies = spread.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("hub").alias("row"))
    work = salted.unionByName(copies).join(sets, "row").select("hub", "salt", "row", "set")
    work = work.repartition(split_count(pairs), "hub", "salt").sortWithinPartitions("hub", "salt", F.col("row") != F.col("hub"))
    return written(work.mapInArrow(_compare_with_hub(percent), "a bigint, b bigint"))


def _rare_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of ``members`` (rep, component, keys) in different components that connect all that linked pairs connect.

    Two sets that are linked share one of their ``n - ceil(percent n / 100) + 1``
    first shingles under any order of all shingles; here it is the rarest first.
    Shingles of one member have no partner and only use up places. Of shingles
    that the same members have among their first ones, the rarest stands for all.
    """
    sketch = F.array_join(F.transform("keys", lambda k: F.substring(F.lpad(F.hex(k), 16, "0"), 13, 4)), "")
    own = written(members.join(sets.withColumnRenamed("row", "rep"), "rep").select("rep", "component", "n", F.unhex(sketch).alias("sketch"), "set"))
    each = own.select("rep", F.explode("set").alias("shingle"))
    common = written(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    shared = each.join(small(common, REP_ROWS), "shingle").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("shared"))
    alone = F.col("n") - F.size("shared")
    places = F.expr(f"cast(n - (n * {percent} + 99) div 100 + 1 as int)")
    firsts = F.slice("shared", F.lit(1), F.greatest(places - alone.cast("int"), F.lit(0)))
    firsts = own.drop("set").join(shared, "rep").select("rep", "component", "n", "sketch", alone.alias("alone"), firsts.alias("firsts"))
    rows = firsts.select("rep", "component", "n", "sketch", "alone", F.posexplode("firsts").alias("at", "first"))
    rows = written(rows.select(F.col("first.shingle").alias("shingle"), F.col("first.df").alias("df"), "rep", "component", "n", (F.col("alone") + F.col("at")).alias("place"), "sketch"))
    alike = [F.count(F.lit(1)).alias("size"), *[F.bit_xor(F.xxhash64(F.lit(k), "rep")).alias(f"who{k}") for k in (1, 2)]]
    groups = rows.groupBy("shingle").agg(*alike, F.min("df").alias("df"), F.sum("n").alias("weight"), F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
    groups = groups.groupBy("size", "who1", "who2").agg(F.min(F.struct("df", "shingle")).alias("first"), F.max("weight").alias("weight"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int")
    groups = written(groups.select(F.col("first.shingle").alias("shingle"), blocks.alias("blocks")))
    rows = rows.drop("df").join(small(groups, REP_ROWS), "shingle").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["shingle", "i", "j"]
    rows = written(rows.select("shingle", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "component", "n", "place", "sketch"))
    dealt = lambda df: df.repartition(split_count(rows), *key).sortWithinPartitions(*key)
    found = written(dealt(rows).mapInArrow(_by_group(percent, False), "shingle bigint, i int, j int, rep bigint"))
    left = rows.join(found, [*key, "rep"], "left_semi").join(own.select("rep", "set"), "rep").select(*rows.columns, "set")
    return written(dealt(left).mapInArrow(_by_group(percent, True), "a bigint, b bigint"))


def _links(classes: DataFrame, texts: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links between class representatives: with hubs, then inside what the hubs leave open."""
    members = classes.select("rep", F.explode("keys").alias("key"))
    shared = written(members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    members = written(members.join(small(shared, REP_ROWS), "key"))
    mass = written(members.groupBy("rep").agg(F.sum("size").alias("mass")))
    hubs = members.join(small(mass, REP_ROWS), "rep").groupBy("key").agg(F.max(F.struct("mass", "rep")).alias("hub")).select("key", F.col("hub.rep").alias("hub"))
    members = written(members.join(small(written(hubs), REP_ROWS), "key").where("rep <> hub").select("key", "rep", "hub"))
    pairs = written(members.select("hub", "rep").distinct())

    # Only documents that share a band with another are looked at again; their sets are built once.
    texts = texts.join(small(mass.select(F.col("rep").alias("row")), REP_ROWS), "row").select("row", "text")
    sets = written(texts.mapInArrow(_shingled(width), "row bigint, n bigint, set array<bigint>"))
    components = written(connected_components(_compared(pairs, sets, percent)))

    named = members.join(small(components.withColumnRenamed("node", "rep"), REP_ROWS), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = written(named.select("key", "rep", "component"))
    open_ = written(named.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("key"))
    left = named.join(small(open_, REP_ROWS), "key").select("rep", "component").distinct()
    return components, _rare_links(written(left.join(classes.select("rep", "keys"), "rep")), sets, percent)


def _described(docs: DataFrame, width: int, permutations: int, rows: int) -> DataFrame:
    schema = StructType([*docs.schema.fields, StructField("row", LongType()), StructField("n", LongType()), StructField("digest", BinaryType()), StructField("keys", ArrayType(LongType()))])
    return written(docs.mapInArrow(_describe(width, permutations, rows, docs.columns.index("text")), schema))


def _classed(described: DataFrame, width: int, percent: int) -> DataFrame:
    """(digest, rep, component, kept_row, component_id) for every distinct set."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = written(described.where("n > 0").groupBy("digest").agg(F.min(F.struct("row", "keys")).alias("first"), F.min(order).alias("best")).select("digest", F.col("first.row").alias("rep"), F.col("first.keys").alias("keys"), "best"))
    components, second = _links(classes, described.select("row", "text"), width, percent)
    final = components
    if not second.isEmpty():
        final = written(connected_components(components.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(second)))
    named = classes.drop("keys").join(final.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    best = named.groupBy("component").agg(F.min("best").alias("lead"))
    return named.join(best, "component").select("digest", "rep", "component", F.col("lead.row").alias("kept_row"), F.col("lead.doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, permutations: int = PERMUTATIONS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document."""
    own = columns_of(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    described = _described(own, width, permutations, rows)
    classed = written(_classed(described, width, percent).select("digest", "component_id"))
    out = described.select("doc_id", "n", "digest").join(classed, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80, permutations: int = PERMUTATIONS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one of least doc_id (of repeated rows, any one). Empty texts all stay."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.struct(*[docs[c] for c in docs.columns if c != text_col]).alias("others"))
    described = _described(own, width, permutations, rows)
    kept = written(_classed(described, width, percent).select(F.col("kept_row").alias("row")).distinct().unionByName(described.where("n = 0").select("row")))
    rows_ = described.select("row", "text", "others").join(small(kept, REP_ROWS), "row", "left_semi")
    return rows_.select(*[F.col("text").alias(c) if c == text_col else F.col("others")[c].alias(c) for c in docs.columns])
