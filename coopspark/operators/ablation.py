"""Model scoring as a DataFrame operator, and motif ablation on top of it.

A predictor maps a table with a sequence column to the same table with a column
of predictions, one number for each track. Masks are scored once: a motif's
single mask serves its own score and every pair that it is part of, so a pair
costs one prediction of its own, the doubly masked sequence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from coopspark.functions.sequence import letter_codes, masked_by_batch, masked_texts
from coopspark.plans.stage import split_count, written


SPANS = ["start1", "end1", "start2", "end2"]
ROW_MASKS = 256  # masks of a sequence that one row holds
ROW_MOTIFS = 16  # motifs of a sequence that one row holds where it is paired: a row's pairs are these or those with 16 others
MASK_BYTES = 4 << 20  # masked texts that a Python worker holds at a time
Sequences = DataFrame | Callable[[DataFrame], DataFrame]  # (region, seq), or what adds seq to a table by its region


class Predictor(Protocol):
    """A model. It may also have ``score_masks`` and ``score_pairs`` (see ``CountPredictor``), which mask and score in one pass."""

    def score(self, df: DataFrame, seq_col: str, out: str) -> DataFrame:
        """``df`` with an array of predictions, one for each track."""
        ...


class ExprPredictor:
    """Tracks given as column expressions of the sequence."""

    def __init__(self, *tracks: Callable[[Column], Column]):
        self.tracks = tracks

    def score(self, df: DataFrame, seq_col: str, out: str) -> DataFrame:
        return df.withColumn(out, F.array(*[t(F.col(seq_col)).cast("double") for t in self.tracks]))


class PandasFnPredictor:
    """A Python model: ``load()`` runs once in a task and returns a function from a list of sequences to (n, tracks)."""

    def __init__(self, load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 1024):
        self.load, self.batch = load, batch

    def score(self, df: DataFrame, seq_col: str, out: str) -> DataFrame:
        load, size = self.load, self.batch

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for pdf in frames:
                for at in range(0, len(pdf), size):
                    part = pdf.iloc[at : at + size]
                    known = part[seq_col].notna()
                    p = iter(np.asarray(model(part[seq_col][known].tolist()), np.float64).tolist() if known.any() else [])
                    yield part.assign(**{out: [next(p) if k else None for k in known]})

        return df.mapInPandas(run, StructType([*df.schema.fields, StructField(out, ArrayType(DoubleType()))]))


class MLPredictor:
    """A fitted Spark ML pipeline for each track; the prediction column of each becomes one entry."""

    def __init__(self, models: list, seq_input: str = "seq", prediction: Callable[[Column], Column] | None = None):
        self.models, self.seq_input, self.prediction = models, seq_input, prediction or (lambda c: c)

    def score(self, df: DataFrame, seq_col: str, out: str) -> DataFrame:
        names, kept = [], df.columns
        work = df.withColumn(self.seq_input, F.col(seq_col)) if seq_col != self.seq_input else df
        for k, (model, column) in enumerate(self.models):
            name = f"{out}__{k}"
            before = work.columns
            work = model.transform(work).withColumn(name, self.prediction(F.col(column)).cast("double")).select(*before, name)
            names.append(name)
        return work.withColumn(out, F.array(*names)).select(*kept, out)


def _before(data: np.ndarray, at: np.ndarray, word: bytes) -> Callable[[np.ndarray], np.ndarray]:
    """How many occurrences of ``word`` begin before each of some places. One that goes on in the next text is none. Eight bytes of hits are summed at a time."""
    hit, most = np.zeros(len(data) // 8 * 8 + 16, np.uint8), len(data) - len(word) + 1
    if most > 0:
        hit[:most] = data[:most] == word[0]
        for i in range(1, len(word)):
            hit[:most] &= data[i : i + most] == word[i]
    for i in range(1, len(word)):  # a word doesn't go on in the next text
        last = at[1:] - i
        hit[last[last >= at[:-1]]] = 0
    eight, ones = hit.view("<u8"), np.uint64(0x0101010101010101)
    upto = np.concatenate([[0], np.cumsum((eight * ones) >> np.uint64(56), dtype=np.int64)])
    below = np.array([(1 << 8 * r) - 1 for r in range(8)], np.uint64)
    return lambda places: upto[places >> 3] + (((eight[places >> 3] & below[places & 7]) * ones) >> np.uint64(56)).astype(np.int64)


class _Letters:
    """How many letters of each text of a batch lie in occurrences of each word, in the text and in its masks.

    Masked letters are N. A mask takes away the occurrences that it touches, so
    running sums of their beginnings give a mask's counts, and no masked text is
    made. Masked texts are made for words with an N, texts that aren't ASCII and
    negative starts.
    """

    def __init__(self, texts: pa.Array, words: list[bytes]):
        self.texts, self.words = texts, words
        data, self.at = letter_codes(texts)
        self.before = [_before(data, self.at, w) for w in words]
        self.whole = np.stack([len(w) * np.diff(f(self.at)) for w, f in zip(words, self.before, strict=True)], axis=1)
        self.plain = not any(b"N" in w for w in words) and not (data > 127).any()

    def masked(self, row: np.ndarray, *spans: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """A row of counts for each mask: of text ``row``, with one or two spans of (start, end), the end included; an end before the start masks nothing."""
        if not self.plain or any((start < 0).any() for start, _ in spans):
            return self._of_texts(row, spans)
        at, n, out = self.at[row], np.diff(self.at)[row], self.whole[row]
        for k, (word, before) in enumerate(zip(self.words, self.before, strict=True)):
            ends = []
            for start, end in spans:
                stop = np.minimum(end, n - 1) + 1
                low = np.minimum(np.maximum(start - len(word) + 1, 0), n)
                ends.append((low, np.where(stop > start, stop, low)))
            gone = sum(before(at + high) - before(at + low) for low, high in ends)
            if len(ends) == 2:  # what both touch was taken twice
                low = np.maximum(ends[0][0], ends[1][0])
                gone -= before(at + np.maximum(low, np.minimum(ends[0][1], ends[1][1]))) - before(at + low)
            out[:, k] -= len(word) * gone
        return out

    def _of_texts(self, row: np.ndarray, spans: tuple[tuple[np.ndarray, np.ndarray], ...]) -> np.ndarray:
        size = np.cumsum(pc.binary_length(self.texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[row])
        cuts = [0, *np.searchsorted(size, np.arange(MASK_BYTES, size[-1] if len(size) else 0, MASK_BYTES), "right").tolist(), len(row)]
        found = np.zeros((len(row), len(self.words)), np.int64)
        for low, high in zip(cuts, cuts[1:], strict=False):  # some megabytes of masked texts at a time
            own = self.texts.take(pa.array(row[low:high]))
            for start, end in spans:
                own = masked_texts(own, pa.array(start[low:high]), pa.array(end[low:high]))
            data, at = letter_codes(own)
            found[low:high] = np.stack([len(w) * np.diff(_before(data, at, w)(at)) for w in self.words], axis=1)
        return found


def letters_of_words(*words: str) -> Callable[[Column], Column]:
    """An array: how many letters of a text lie in occurrences of each word (ASCII), which must not overlap itself. One pass by Arrow batches for all words."""
    codes = [w.encode("ascii") for w in words]

    @F.arrow_udf(ArrayType(LongType()))
    def counted(texts: pa.Array) -> pa.Array:
        found = _Letters(texts, codes).whole
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(codes)), pa.array(found.ravel(), pa.int64()), mask=texts.is_null())

    return counted


def letters_of_masks(*words: str) -> Callable[..., Column]:
    """An array for each mask of a sequence: what ``letters_of_words`` gives on the masked text. Starts and ends are arrays side by side; null starts mask nothing."""
    codes = [w.encode("ascii") for w in words]

    @F.arrow_udf(ArrayType(ArrayType(LongType())))
    def counted(texts: pa.Array, *spans: pa.Array) -> pa.Array:
        many = spans[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        row, flat = np.repeat(np.arange(len(texts)), many), [x.flatten() for x in spans]
        ends = [(a.fill_null(0).to_numpy(), pc.if_else(a.is_null(), -1, b.fill_null(2**62)).to_numpy()) for a, b in zip(flat[::2], flat[1::2], strict=True)]  # no end: up to the text's
        found = _Letters(texts, codes).masked(row, *ends)
        unknown = texts.take(pa.array(row)).is_null() if texts.null_count else pa.array(np.zeros(len(row), bool))
        each = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * len(codes)), pa.array(found.ravel()), mask=unknown)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), each)

    return counted


def letters_of_pairs(max_distance: int, *words: str) -> Callable[..., Column]:
    """An array for each sequence: its pairs of motifs, as (i, j) and what ``letters_of_words`` gives: o on the text, a and b with one motif masked, c with both.

    Starts and ends are arrays side by side, in the order of ``motif_pairs``;
    with a ``cut``, one of a pair lies before that place and one from there on.
    """
    codes = [w.encode("ascii") for w in words]
    names = [f"{c}{k}" for c in "oabc" for k in range(len(codes))]

    @F.arrow_udf(ArrayType(StructType([StructField(n, IntegerType()) for n in ("i", "j", *names)])))
    def counted(texts: pa.Array, starts: pa.Array, ends: pa.Array, cut: pa.Array) -> pa.Array:
        many = starts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        start, end = (x.flatten().to_numpy(zero_copy_only=False) for x in (starts, ends))
        row, at = np.repeat(np.arange(len(texts)), many), np.cumsum(many) - many
        own, split = np.arange(len(row)), (at + cut.fill_null(-1).to_numpy(zero_copy_only=False))[row]
        cross = cut.is_valid().to_numpy(zero_copy_only=False)[row]
        first, stop = np.where(cross, split, own + 1), (at + many)[row]
        size = np.where(cross & (own >= split), 0, stop - first)
        i = np.repeat(own, size)
        j = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(len(i))
        kept = (np.maximum(start[i], start[j]) >= np.minimum(end[i], end[j])) & (start[j] - start[i] <= max_distance)
        i, j = i[kept], j[kept]
        letters, of = _Letters(texts, codes), row[i]
        one, both = letters.masked(row, (start, end)), letters.masked(of, (start[i], end[i]), (start[j], end[j]))
        unknown = texts.is_null().to_numpy(zero_copy_only=False)[of]
        counts = [pa.array(x[:, k].astype(np.int32), mask=unknown) for x in (letters.whole[of], one[i], one[j], both) for k in range(len(codes))]
        each = pa.StructArray.from_arrays([pa.array((x - at[of]).astype(np.int32)) for x in (i, j)] + counts, ["i", "j", *names])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))]).astype(np.int32)), each)

    return counted


def letters_of(word: str) -> Callable[[Column], Column]:
    """``letters_of_words`` of one word, as a number."""
    counted = letters_of_words(word)
    return lambda s: F.get(counted(s), F.lit(0))


class CountPredictor:
    """Tracks given as expressions of the counts of words in the sequence."""

    def __init__(self, words: list[str], *tracks: Callable[[dict[str, Column]], Column]):
        self.words, self.tracks = words, tracks

    def score(self, df: DataFrame, seq_col: str, out: str) -> DataFrame:
        counted = df.withColumn("counts__", letters_of_words(*self.words)(F.col(seq_col)))  # a column of its own: all tracks read it
        counts = {w: F.get("counts__", F.lit(k)).cast("double") for k, w in enumerate(self.words)}
        return counted.withColumn(out, F.array(*[t(counts).cast("double") for t in self.tracks])).drop("counts__")


    def score_masks(self, df: DataFrame, seq_col: str, masks: str) -> DataFrame:
        """A row for each of ``masks``, arrays of structs (start1, end1, start2, end2), of which the first masks nothing: ``masks`` is then the struct, ``p0`` the prediction of the sequence, ``p1`` that of its mask.

        A sequence goes to Python once for all its masks.
        """
        counted = df.withColumn("counts__", letters_of_masks(*self.words)(F.col(seq_col), *[F.col(f"{masks}.{c}") for c in SPANS]))
        kept = [c for c in df.columns if c not in (seq_col, masks)]
        each = counted.select(*kept, F.get("counts__", F.lit(0)).alias("n0__"), F.explode(F.arrays_zip(F.col(masks).alias("m"), F.col("counts__").alias("n"))).alias("of__"))

        def scored(counts: str) -> Column:
            known = {w: F.get(counts, F.lit(k)).cast("double") for k, w in enumerate(self.words)}
            return F.array(*[t(known).cast("double") for t in self.tracks])

        return each.select(*kept, F.col("of__.m").alias(masks), scored("n0__").alias("p0"), scored("of__.n").alias("p1"))


    def score_pairs(self, df: DataFrame, seq_col: str, motifs: str, cut: str, max_distance: int) -> DataFrame:
        """A row for each pair of ``motifs``, arrays of structs with start_rel and end_rel (see ``letters_of_pairs``): the structs ``first`` and ``second``, and the predictions ``p0`` of the sequence, ``p1`` and ``p2`` with one motif masked and ``p12`` with both.

        A sequence goes to Python once for all its pairs, and no mask of it is made.
        """
        counted = df.withColumn("pairs__", letters_of_pairs(max_distance, *self.words)(F.col(seq_col), F.col(f"{motifs}.start_rel"), F.col(f"{motifs}.end_rel"), F.col(cut)))
        kept = [c for c in df.columns if c not in (seq_col, motifs, cut)]
        # An outer explode: before an inner one Spark asks whether there are pairs, and runs the function once more for it.
        each = counted.select(*kept, motifs, F.explode_outer("pairs__").alias("of__")).where("of__ is not null")

        def scored(kind: str) -> Column:
            known = {w: F.col(f"of__.{kind}{k}").cast("double") for k, w in enumerate(self.words)}
            return F.array(*[t(known).cast("double") for t in self.tracks])

        one = lambda c: F.get(motifs, F.col(f"of__.{c}"))
        return each.select(*kept, one("i").alias("first"), one("j").alias("second"), scored("o").alias("p0"), scored("a").alias("p1"), scored("b").alias("p2"), scored("c").alias("p12"))


def default_predictor() -> CountPredictor:
    """Two non-additive expressions of letter and pair counts; a stand-in model that SQL can check."""
    return CountPredictor(["GC", "A", "TA", "C"], lambda n: F.ln(1 + n["GC"]) * (1 + n["A"] / F.lit(600.0)), lambda n: F.ln(1 + n["TA"]) * (1 + n["C"] / F.lit(600.0)))


def score_sequences(df: DataFrame, predictor: Predictor, seq_col: str = "seq", out: str = "p") -> DataFrame:
    return predictor.score(df, seq_col, out)


def occlusion_scan(sequences: DataFrame, predictor: Predictor, window: int = 10, step: int = 10) -> DataFrame:
    """(region, track, scores): importance of each position by masking windows that slide by ``step``.

    A position's importance is the absolute change of the prediction under the
    last window that covers it.
    """
    scored = predictor.score(sequences.where("length(seq) > 0"), "seq", "p")
    spans = scored.withColumn("at", F.explode(F.expr(f"sequence(0, length(seq) - 1, {step})")))
    cut = spans.select("region", "p", "at", F.length("seq").alias("n"), masked_by_batch(F.col("seq"), (F.col("at"), F.col("at") + (window - 1))).alias("seq"))
    changed = predictor.score(cut, "seq", "q")
    rows = changed.select("region", "n", "at", F.posexplode(F.zip_with("p", "q", lambda p, q: F.abs(p - q))).alias("track", "score"))
    curve = rows.groupBy("region", "track", "n").agg(F.sort_array(F.collect_list(F.struct("at", "score"))).alias("w"))
    # A window's score stands from its start to the next one's, or to the end.
    scores = F.flatten(F.transform("w", lambda w: F.array_repeat(w["score"], F.least(F.lit(step), F.col("n") - w["at"]))))
    return curve.select("region", "track", scores.alias("scores"))


def _sequences(sequences: DataFrame, original: DataFrame) -> DataFrame:
    """(region, seq, p0) for a join by region that doesn't broadcast them (sizes of texts are guessed low) and keeps the partitions that they have if they are by region.

    The original prediction comes before the model, as a Python model's rows have lost their partitions.
    """
    return sequences.select("region", "seq").hint("merge").join(original.hint("merge"), "region").hint("merge")


def _spread(df: DataFrame) -> DataFrame:
    """By region in as many partitions as the session has: scoring is the costly part, whatever the bytes of the shuffle before it, which is all that Spark's own choice sees."""
    return df.repartition(split_count(df), "region")


def original_scores(sequences: DataFrame, predictor: Predictor) -> DataFrame:
    """(region, p0): each distinct sequence's prediction, a written table, so that it is scored once however often it is read."""
    return written(predictor.score(_spread(sequences.select("region", "seq")).distinct(), "seq", "p0").select("region", "p0"))


def mask_scores(masks: DataFrame, sequences: Sequences, predictor: Predictor, original: DataFrame | None = None) -> DataFrame:
    """(region, start1, end1, start2, end2, isa): each distinct mask once; a mask of one span has a null second one.

    If the model masks for itself (and ``original`` isn't given), a region's
    masks meet its sequence in rows of at most ``ROW_MASKS``, and the sequence
    is scored in the same pass.
    """
    own = _spread(masks.select("region", *SPANS)).distinct()
    if original is None and hasattr(predictor, "score_masks"):
        place = F.row_number().over(Window.partitionBy("region").orderBy(*SPANS)) - 1
        span = F.struct(*[F.col(c).cast("bigint").alias(c) for c in SPANS])
        rows = own.withColumn("row__", F.floor(place / ROW_MASKS)).groupBy("region", "row__").agg(F.collect_list(span).alias("masks"))
        none = F.struct(*[F.lit(None).cast("bigint").alias(c) for c in SPANS])
        rows = rows.select("region", F.concat(F.array(none), "masks").alias("masks"))
        met = sequences(rows) if callable(sequences) else rows.join(sequences.select("region", "seq").hint("merge"), "region")
        scored = predictor.score_masks(met, "seq", "masks").where("masks.start1 is not null").select("region", "masks.*", "p0", "p1")
    else:
        if original is None:
            original = original_scores(sequences(_spread(own.select("region")).distinct()) if callable(sequences) else sequences, predictor)
        met = sequences(own.join(original, "region")) if callable(sequences) else own.join(_sequences(sequences, original), "region")
        second = F.when(F.col("start2").isNull(), 0).otherwise(F.col("start2")), F.when(F.col("start2").isNull(), -1).otherwise(F.col("end2"))  # no span masks nothing
        scored = predictor.score(met.withColumn("seq", masked_by_batch(F.col("seq"), (F.col("start1"), F.col("end1")), second)), "seq", "p1")
    return scored.select("region", *SPANS, F.zip_with("p0", "p1", lambda a, b: a - b).alias("isa"))


def _of_motifs(motifs: DataFrame) -> DataFrame:
    """The masks of single motifs."""
    none = F.lit(None).cast("bigint")
    return motifs.select("region", F.col("start_rel").cast("bigint").alias("start1"), F.col("end_rel").cast("bigint").alias("end1"), none.alias("start2"), none.alias("end2"))


def _single(scores: DataFrame) -> DataFrame:
    return scores.where("start2 is null").select("region", F.col("start1").alias("start_rel"), F.col("end1").alias("end_rel"), "isa")


def single_scores(motifs: DataFrame, sequences: Sequences, predictor: Predictor, original: DataFrame | None = None) -> DataFrame:
    """(region, start_rel, end_rel, isa): each distinct mask once, a written table."""
    return written(_single(mask_scores(_of_motifs(motifs), sequences, predictor, original)))


def _masked_rows(motifs: DataFrame, sequences: Sequences) -> DataFrame:
    """(region, seq, masks) for ``score_masks``, with the motif itself as ``own`` in each mask; at most ``ROW_MASKS`` a row."""
    none = F.lit(None).cast("bigint")
    spans = [F.col("start_rel").cast("bigint").alias("start1"), F.col("end_rel").cast("bigint").alias("end1"), none.alias("start2"), none.alias("end2")]
    known = _spread(motifs.where("start_rel is not null and end_rel is not null").select("region", F.struct(*spans, F.struct(*[c for c in motifs.columns if c != "region"]).alias("own")).alias("m")))
    rows = known.groupBy("region").agg(F.collect_list("m").alias("masks"))
    met = sequences(rows) if callable(sequences) else rows.join(sequences.select("region", "seq").hint("merge"), "region")
    met = met.withColumn("row__", F.expr(f"explode(sequence(0L, (size(masks) - 1) div {ROW_MASKS}))"))
    part = F.when(F.size("masks") <= ROW_MASKS, F.col("masks")).otherwise(F.slice("masks", (F.col("row__") * ROW_MASKS + 1).cast("int"), F.lit(ROW_MASKS)))
    return met.select("region", "seq", F.concat(F.array(F.lit(None).cast(known.schema["m"].dataType)), part).alias("masks"))


def single_ablation(motifs: DataFrame, sequences: Sequences, predictor: Predictor, tracks: list[int], single: DataFrame | None = None) -> DataFrame:
    """``motifs`` (region, start_rel, end_rel, ...) with isa_t{k}: the prediction lost by masking the motif. ``single``: what ``single_scores`` gave.

    Without it, and if the model masks for itself, the motifs go through the
    model's pass as they are: no join brings their scores.
    """
    if single is None and hasattr(predictor, "score_masks"):
        scored = predictor.score_masks(_masked_rows(motifs, sequences), "seq", "masks").where("masks.start1 is not null")
        kept = [F.col("region") if c == "region" else F.col(f"masks.own.{c}").alias(c) for c in motifs.columns]
        return scored.select(*kept, *[(F.get("p0", F.lit(k)) - F.get("p1", F.lit(k))).alias(f"isa_t{k}") for k in tracks])
    single = single_scores(motifs, sequences, predictor) if single is None else single
    out = motifs.join(single, ["region", "start_rel", "end_rel"])
    return out.select(*motifs.columns, *[F.get("isa", F.lit(k)).alias(f"isa_t{k}") for k in tracks])


def motif_pairs(motifs: DataFrame, max_distance: int, carried: list[str]) -> DataFrame:
    """Pairs of motifs of a region, the earlier one first, that don't overlap and start at most ``max_distance`` apart.

    Rows are ordered by start, end, name and the carried columns; rows alike in
    all of these are interchangeable. Carried columns become tf1_... and tf2_....
    """
    order = Window.partitionBy("region").orderBy("start_rel", "end_rel", "tf", *carried)
    rows = motifs.select("region", "tf", "start_rel", "end_rel", *carried).withColumn("place", F.row_number().over(order))
    side = lambda k: rows.select(F.col("region").alias(f"region{k}"), F.col("tf").alias(f"tf{k}"), F.col("start_rel").alias(f"start{k}"), F.col("end_rel").alias(f"end{k}"), F.col("place").alias(f"place{k}"), *[F.col(c).alias(f"tf{k}_{c}") for c in carried])
    # A pair's second start lies in the first one's distance bin or in the next: regions of very many motifs are joined by bin.
    bins = F.expr(f"start1 div {max_distance + 1}")
    first = side(1).withColumn("bin1", F.explode(F.array(bins, bins + 1)))
    second = side(2).withColumn("bin2", F.expr(f"start2 div {max_distance + 1}"))
    on = (F.col("region1") == F.col("region2")) & (F.col("bin1") == F.col("bin2")) & (F.col("place1") < F.col("place2")) & (F.greatest("start1", "start2") >= F.least("end1", "end2")) & (F.col("start2") - F.col("start1") <= max_distance)
    pairs = first.join(second, on).withColumn("distance", F.col("start2") - F.col("start1"))
    return pairs.select(F.col("region1").alias("region"), "tf1", "tf2", "start1", "end1", "start2", "end2", "distance", *[f"tf{k}_{c}" for c in carried for k in (1, 2)])


def _paired_rows(motifs: DataFrame, sequences: Sequences, max_distance: int, columns: list[str]) -> DataFrame:
    """(region, seq, motifs, cut) for ``score_pairs``: one row for a region of at most ``ROW_MOTIFS`` motifs, else one for each two blocks of them that are near enough."""
    ends = [F.col(c).cast("bigint").alias(c) for c in ("start_rel", "end_rel")]
    known = _spread(motifs.select("region", F.struct(*ends, "tf", *columns).alias("m")).where("m.start_rel is not null and m.end_rel is not null"))
    rows = known.groupBy("region").agg(F.sort_array(F.collect_list("m")).alias("motifs")).where("size(motifs) > 1")
    met = sequences(rows) if callable(sequences) else rows.join(sequences.select("region", "seq").hint("merge"), "region")
    last = f"(size(motifs) - 1) div {ROW_MOTIFS}"
    blocks = met.withColumn("a__", F.expr(f"explode(sequence(0L, {last}))")).withColumn("b__", F.expr(f"explode(sequence(a__, {last}))"))
    blocks = blocks.where(f"a__ = b__ or get(motifs, cast(b__ * {ROW_MOTIFS} as int)).start_rel - get(motifs, cast(a__ * {ROW_MOTIFS} + {ROW_MOTIFS - 1} as int)).start_rel <= {max_distance}")
    block = lambda c: F.slice("motifs", (F.col(c) * ROW_MOTIFS + 1).cast("int"), F.lit(ROW_MOTIFS))
    own = F.when(F.size("motifs") <= ROW_MOTIFS, F.col("motifs")).when(F.col("a__") == F.col("b__"), block("a__")).otherwise(F.concat(block("a__"), block("b__")))
    return blocks.select("region", "seq", own.alias("motifs"), F.when(F.col("a__") < F.col("b__"), ROW_MOTIFS).alias("cut"))


def pair_ablation(motifs: DataFrame, sequences: Sequences, predictor: Predictor, tracks: list[int], max_distance: int, carried: list[str] | None = None, original: DataFrame | None = None, single: DataFrame | None = None, came: str | None = None) -> DataFrame:
    """Pair table: isa1, isa2, isa_both and interaction = isa1 + isa2 - isa_both for each track.

    ``original`` and ``single`` are tables that were scored before, if any.
    Without them, and if the model pairs for itself, a region's motifs meet its
    sequence in its one partition and come out as scored pairs; nothing is
    written, so whoever reads the pairs more than once writes them. ``came``
    names a flag: pairs without a motif that has it are left out.
    """
    carried = carried if carried is not None else [f"pass_threshold_t{k}" for k in tracks]
    if original is None and single is None and hasattr(predictor, "score_pairs"):
        rows = _paired_rows(motifs, sequences, max_distance, carried + ([came] if came else []))
        scored = predictor.score_pairs(rows, "seq", "motifs", "cut", max_distance)
        if came:
            scored = scored.where(F.col(f"first.{came}") | F.col(f"second.{came}"))
        sides = ((1, "first"), (2, "second"))
        own = [F.col(f"{side}.tf").alias(f"tf{k}") for k, side in sides] + [F.col(f"{side}.{c}_rel").alias(f"{c}{k}") for k, side in sides for c in ("start", "end")]
        own += [(F.col("second.start_rel") - F.col("first.start_rel")).alias("distance"), *[F.col(f"{side}.{c}").alias(f"tf{k}_{c}") for c in carried for k, side in sides]]
        of = lambda p: F.struct(*[(F.get("p0", F.lit(k)) - F.get(p, F.lit(k))).alias(f"t{k}") for k in tracks])
        out = scored.select("region", *own, of("p1").alias("isa1"), of("p2").alias("isa2"), of("p12").alias("isa12"))
        return _interactions(out, {k: [F.col(f"{c}.t{k}") for c in ("isa1", "isa2", "isa12")] for k in tracks})
    motifs = _spread(motifs)  # pairs are then formed, and meet their scores, where their region's motifs are
    pairs = motif_pairs(motifs, max_distance, carried + ([came] if came else []))
    if came:
        pairs = written(pairs.where(F.col(f"tf1_{came}") | F.col(f"tf2_{came}")).drop(f"tf1_{came}", f"tf2_{came}"))
        ends = lambda k: pairs.select("region", F.col(f"start{k}").alias("start_rel"), F.col(f"end{k}").alias("end_rel"))
        motifs = ends(1).unionByName(ends(2))  # only the masks of these pairs
    if original is None:
        original = original_scores(sequences(_spread(motifs.select("region")).distinct()) if callable(sequences) else sequences, predictor)
    single = single_scores(motifs, sequences, predictor, original) if single is None else single
    return scored_pairs(pairs, sequences, predictor, tracks, original, single)


def scored_pairs(pairs: DataFrame, sequences: Sequences, predictor: Predictor, tracks: list[int], original: DataFrame, single: DataFrame) -> DataFrame:
    """``pairs`` with isa1, isa2, isa_both and interaction for each track; only the doubly masked sequences are scored here."""
    return _assembled(pairs, single, mask_scores(pairs, sequences, predictor, original), tracks)


def _assembled(pairs: DataFrame, single: DataFrame, both: DataFrame, tracks: list[int]) -> DataFrame:
    """Pairs with the scores of their masks. All sides are partitioned by region, so each row moves once, not once a join."""
    alone = _spread(single)
    one = lambda k: alone.select("region", F.col("start_rel").alias(f"start{k}"), F.col("end_rel").alias(f"end{k}"), F.col("isa").alias(f"isa{k}"))
    both = _spread(both.select("region", *SPANS, F.col("isa").alias("isa12")))
    out = _spread(pairs).join(one(1), ["region", "start1", "end1"]).join(one(2), ["region", "start2", "end2"]).join(both, ["region", *SPANS])
    return _interactions(out.select(*pairs.columns, "isa1", "isa2", "isa12"), {k: [F.get(c, F.lit(k)) for c in ("isa1", "isa2", "isa12")] for k in tracks})


def _interactions(pairs: DataFrame, tracks: dict[int, list[Column]]) -> DataFrame:
    """``pairs`` with what masking the first, the second and both motifs loses on each track in place of isa1, isa2 and isa12, and the interaction."""
    made = []
    for k, (a, b, c) in tracks.items():
        made += [a.alias(f"isa1_t{k}"), b.alias(f"isa2_t{k}"), c.alias(f"isa_both_t{k}"), (a + b - c).alias(f"interaction_t{k}")]
    return pairs.select(*[c for c in pairs.columns if c not in ("isa1", "isa2", "isa12")], *made)
