"""Readers: every one a Spark job with a fixed schema."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coopspark import schemas
from coopspark.functions.scalars import hit_fields
from coopspark.functions.sequence import letter_codes
from coopspark.plans.stage import written


def read_regions(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    """Region CSV with a header; ``extra`` names further columns, as in ``target_reg double``."""
    return spark.read.schema(schemas.REGIONS + (f", {extra}" if extra else "")).csv(path, header=True)


def read_bed(spark: SparkSession, path: str, columns: int = 3) -> DataFrame:
    """BED of three or six columns, without header, tab-separated."""
    if columns not in (3, 6):
        raise ValueError("columns must be 3 or 6")
    return spark.read.schema(schemas.BED3 if columns == 3 else schemas.BED6).csv(path, sep="\t")


def read_cofactors(spark: SparkSession, path: str) -> DataFrame:
    """0/1 cofactor matrix (TSV with header); ``/`` in column names becomes ``_``."""
    table = spark.read.csv(path, sep="\t", header=True)
    return table.toDF(*[c.replace("/", "_") for c in table.columns])


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pair list (TSV with header TF1, TF2)."""
    return spark.read.csv(path, sep="\t", header=True).select("TF1", "TF2")


def read_families(spark: SparkSession, path: str, symbol: str = "symbol", family: str = "family") -> DataFrame:
    """(symbol in upper case, family) from a CSV with header."""
    return spark.read.csv(path, header=True).select(F.upper(F.col(symbol)).alias("symbol"), F.col(family).alias("family"))


def read_dispersion(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, gini) from a TSV with header."""
    return spark.read.csv(path, sep="\t", header=True).select("symbol", F.col("gini").try_cast("double").alias("gini"))


def read_matrix(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Prey by bait matrix with header, values as text."""
    return spark.read.csv(path, sep=sep, header=True)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """One name a line; comments (#) and blank lines are left out."""
    lines = spark.read.schema("name string").csv(path, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return lines.where("name is not null and name <> ''")


_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")
_NAME = re.compile(r" *>[ \t\n\x0b\f\r]*([^ \t\n\x0b\f\r]*)")
_SPACES = np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))


def _contigs(lines: pa.Array) -> list[tuple[str | None, str]]:
    """(name, letters) of consecutive FASTA lines: first what comes before a header, with no name."""
    data, at = letter_codes(lines)
    first = np.zeros(len(lines), np.uint8)
    filled = at[1:] > at[:-1]
    first[filled] = data[at[:-1][filled]]
    names = {int(i): m.group(1) for i in np.flatnonzero((first == ord(">")) | (first == ord(" "))) if (m := _NAME.match(lines[int(i)].as_py()))}
    head = np.zeros(len(lines) + 1, bool)
    head[list(names)] = True
    spaced = np.flatnonzero(_SPACES[data])
    if (data > 127).any() or not head[np.searchsorted(at, spaced, "right") - 1].all():
        texts = ["" if head[i] else _SPACE.sub("", s) for i, s in enumerate(lines.to_pylist())]
        text, at = "".join(texts), np.cumsum([0, *map(len, texts)])
        begins = {i: int(at[i]) for i in names}
    else:
        text = data.tobytes().decode("ascii")
        begins = {i: int(at[i + 1]) for i in names}
    ends = [*[int(at[i]) for i in names], int(at[-1])]
    return [(None, text[: ends[0]]), *[(names[i], text[begins[i] : end]) for i, end in zip(names, ends[1:], strict=True)]]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple[str | None, str]]]]:
    """The other columns' values and the contigs of lines that lie in one byte range; a range may come in several runs."""
    for batch in batches:
        value, *others = batch.columns
        changed = np.zeros(max(len(value) - 1, 0), bool)
        for x in others:
            changed |= np.diff(x.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)) != 0
        cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), len(value)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if high > low:
                yield tuple(x[low].as_py() for x in others), _contigs(value.slice(low, high - low))


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each byte range: its headers, the letters before the first and after the last one, and that one's name."""
    rows: dict[tuple, list] = {}
    for key, contigs in _runs(batches):
        row = rows.setdefault(key, [0, 0, 0, None])
        for name, text in contigs:
            if name is not None:
                row[0], row[2], row[3] = row[0] + 1, 0, name
            row[2 if row[0] else 1] += len(text)
    columns = list(zip(*[(*key, *row) for key, row in rows.items()], strict=True)) or [()] * 6
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["file", "block", "heads", "lead", "tail", "name"])


def _tiles(width: int, whole: bool):
    """Tiles (id, nth, chrom, tile, start, seq) of lines with their range's ``id`` and the letters ``before`` it in its first contig: those that lie in the range, or else the pieces at its borders."""
    names = ["id", "nth", "chrom", "tile", "start", "seq"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, current, nth, chrom, at, rest = [], None, 0, None, None, ""

        def put(text: str, done: bool) -> None:
            if text and (done and at % width == 0) == whole:
                rows.append((current, nth, chrom, at // width, at, text))

        def taken() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 6
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for (id_, before), contigs in _runs(batches):
            if id_ != current:
                put(rest, False)
                current, nth, chrom, at, rest = id_, 0, None, before, ""
            for name, text in contigs:
                if name is not None:
                    put(rest, True)  # a contig's end
                    nth, chrom, at, rest = nth + 1, name, 0, ""
                if at is None:  # letters before any header
                    continue
                text, low = rest + text, 0
                while (high := low + width - at % width) <= len(text):
                    put(text[low:high], True)
                    at, low = at + high - low, high
                rest = text[low:]
            if len(rows) >= 10_000:
                yield taken()
        put(rest, False)
        yield taken()

    return cut


def read_fasta(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Tiles (chrom, tile, seq) of fixed width.

    Files are read by byte ranges, as Spark splits them, so a contig may lie in
    many tasks. A first pass counts letters and headers of each range; running
    sums over these rows say where the contig that a range begins with stands.
    Tiles that lie in a range are cut there; only the pieces at its borders,
    two a range, are shuffled. A line is the smallest unit: files should be
    wrapped.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    edges = raw.mapInArrow(_edges, "file string, block bigint, heads bigint, lead bigint, tail bigint, name string")
    along = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    edges = edges.withColumn("sum", F.coalesce(F.sum("lead").over(along), F.lit(0)))
    begun = F.when(F.col("heads") > 0, F.struct(F.col("block").alias("of"), "heads", "name", (F.col("tail") - F.col("sum") - F.col("lead")).alias("less")))
    known = edges.withColumn("begun", F.last(begun, ignorenulls=True).over(along))
    known = written(known.select("file", "block", F.monotonically_increasing_id().alias("id"), "begun.of", F.col("begun.heads").alias("ofth"), "begun.name", (F.col("sum") + F.col("begun.less")).alias("before")))
    met = raw.join(F.broadcast(known.select("file", "block", "id", "before")), ["file", "block"], "left")
    lines = met.select("value", F.coalesce("id", F.raise_error(F.lit("the files were split in another way than before")).cast("bigint")).alias("id"), "before")
    schema = "id bigint, nth bigint, chrom string, tile bigint, start bigint, seq string"
    whole = lines.mapInArrow(_tiles(width, True), schema).join(F.broadcast(known.select("id", "name")), "id")
    whole = whole.select(F.when(F.col("nth") == 0, F.col("name")).otherwise(F.col("chrom")).alias("chrom"), "tile", "seq")
    parts = lines.mapInArrow(_tiles(width, False), schema).join(F.broadcast(known.drop("before")), "id")
    began = F.col("nth") == 0  # in an earlier range
    parts = parts.select("file", F.when(began, F.col("of")).otherwise(F.col("block")).alias("of"), F.when(began, F.col("ofth")).otherwise(F.col("nth")).alias("nth"), F.when(began, F.col("name")).otherwise(F.col("chrom")).alias("chrom"), "tile", F.struct("start", "seq").alias("piece"))
    met = parts.groupBy("file", "of", "nth", "chrom", "tile").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))  # a tile's width at most
    return whole.unionByName(met.select("chrom", "tile", F.array_join(F.transform("pieces", lambda p: p["seq"]), "").alias("seq")))


def read_signal(spark: SparkSession, path: str, track: str) -> DataFrame:
    """(chrom, start, end, value, track) from a bedGraph file."""
    return spark.read.schema(schemas.SIGNAL).csv(path, sep="\t").withColumn("track", F.lit(track))


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Motif hits from BED with a packed detail text: chrom, start, end, tf, score, strand. The details are separated by spaces, tabs being the file's."""
    raw = spark.read.schema(schemas.HITS).csv(path, sep="\t")
    return parsed_hits(raw.withColumn("details", F.translate("details", " ", "\t")))


def parsed_hits(hits: DataFrame) -> DataFrame:
    """The detail text of hits as typed columns."""
    tf, score, strand = hit_fields(F.col("details"))
    return hits.select("chrom", "start", "end", tf.alias("tf"), score.alias("score"), strand.alias("strand"))


def read_peaks(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, tf): the name is the detail before the first colon or underscore, upper case."""
    return named_peaks(spark.read.schema(schemas.PEAKS).csv(path, sep="\t"))


def named_peaks(peaks: DataFrame) -> DataFrame:
    return peaks.select("chrom", "start", "end", F.upper(F.split("detail", "[:_]")[0]).alias("tf"))


def read_pfms(spark: SparkSession, path: str) -> DataFrame:
    """(motif, tf, a, c, g, t): count rows of each ``>ID name`` record as arrays of numbers."""
    record = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    head = F.split(F.regexp_extract("value", r"^\s*([^\n]*)", 1), r"\s+")
    row = lambda b: F.transform(F.regexp_extract_all(F.regexp_extract("value", rf"(?m)^\s*{b}\s*\[([^\]]*)\]", 1), F.lit(r"([0-9.eE+-]+)"), 1), lambda x: x.cast("double")).alias(b.lower())
    return record.select(F.get(head, F.lit(0)).alias("motif"), F.upper(F.get(head, F.lit(1))).alias("tf"), *[row(b) for b in "ACGT"])


def gc_fraction(pfms: DataFrame) -> DataFrame:
    """(tf, gc): share of C and G in all counts of a motif."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return pfms.select("tf", F.try_divide(total("c") + total("g"), total("a") + total("c") + total("g") + total("t")).alias("gc"))
