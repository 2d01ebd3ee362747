"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words: the mix's size shared by source weights,
where a target stops at ``max_copies`` times its source's size and the excess is
shared again by weight (in closed form, the level at which the sources' shares
add up to the size). All documents of a source then get the whole copies that
the target contains for certain. The remaining words are sampled with unequal
probabilities: a document is included with ``pi = min(1, e / size)``, so that
each brings the same expected number of words, at most all of its own, and a few
very long documents can't make up the sample. The level ``e`` is where these add
up to the remaining words. Documents are ranked by the odds of a uniform number
over the odds of ``pi`` (certain ones first), and the first ones whose sizes add
up to the remaining words are taken once more: a sample of fixed size in words.

A document larger than the words still missing is passed over and the ranking
goes on below it, in ``PASSES`` passes; at the end one document is added, the one
not chosen whose size comes nearest to the words still missing, if it helps.

Rows alike in doc_id and text share their number, and with it their rank. Where
a pass ends among such rows, as many of them are taken as still fit; which ones
follows from their places in a written table, by counts of its partitions.

The decisions are a few numbers for each source (levels and rank keys up to
which each pass went); documents meet them in a join with that small table and
are never shuffled themselves. The running sums in rank order are
range-partitioned, so a source with a third of all rows is spread; levels come
from the counts of sizes.

The uniform number is taken from an MD5 of seed, doc_id and text, so reruns
agree at any partitioning. Defined cases: a null text has no words; a null
source is a source, the last one; rows alike in doc_id and text are
interchangeable, and any number of them may be taken; sources without words take
nothing; an empty table gives an empty table; extra columns are kept by ``mix``
and not looked at otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coopspark.llm.common import WORD_PATTERN, columns_of
from coopspark.operators.running import running_sum
from coopspark.plans.stage import BROADCAST_ROWS, small, written

WEIGHTS = (3.0, 1.0, 2.0)
SEED = "mix-1"
PASSES = 3


def uniform(id_col: str, text_col: str, seed: str) -> Column:
    """A number in (0, 1) with 52 random bits."""
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text_col), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(key, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4503599627370496.0)


def sizes(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: str) -> DataFrame:
    """(doc_id, source, size, u)."""
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")
    return columns_of(docs, id_col, source_col, text_col).select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words.alias("size"), uniform(id_col, text_col, seed).alias("u"))


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, max_copies: int = 2) -> DataFrame:
    """(source, source_size, target): one row for each source.

    Source i gets min(max_copies * size, level * weight). Sources are full up to
    some place in the order of max_copies * size / weight; the level follows
    from what they leave.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)).cast("int") + 1)
    everything = Window.partitionBy()
    w = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(max_copies)).withColumn("total", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("left", F.lit(share) * F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    w = w.withColumn("level", F.col("left") / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    w = w.withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    w = w.withColumn("at", F.row_number().over(order))
    level = F.min(F.when(~F.col("full"), F.struct("at", "level"))).over(everything)
    return w.select("source", "source_size", F.when(F.col("full") | level.isNull(), F.col("cap").cast("double")).otherwise(level["level"] * F.col("weight")).alias("target"))


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """A left join on source in which null meets null."""
    other = right.withColumnRenamed("source", "source__")
    return left.join(other, left["source"].eqNullSafe(other["source__"]), "left").drop("source__")


def _levels(sized: DataFrame, per_source: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(source, since, level): documents of fewer than ``since`` words are certain, others have ``pi = level / size``.

    ``since`` is the least size at which the expected words reach ``rest``. A
    row of the windows stands for all of a source's documents of one size.
    """
    counts = _beside(sized.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), near(per_source)).where("fraction > 0")
    below = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("source")
    counts = counts.withColumn("words", F.coalesce(F.sum(F.col("size") * F.col("n")).over(below), F.lit(0))).withColumn("others", F.sum("n").over(every) - F.coalesce(F.sum("n").over(below), F.lit(0)))
    reached = counts.where(F.col("words") + F.col("size") * F.col("others") >= F.col("rest"))
    first = reached.groupBy("source").agg(F.min(F.struct("size", ((F.col("rest") - F.col("words")) / F.col("others")).alias("level"))).alias("first"))
    return first.select("source", F.col("first.size").alias("since"), F.col("first.level").alias("level"))


def _ranked(sized: DataFrame, per_source: DataFrame) -> DataFrame:
    """Adds q, the odds of u over the odds of the document's inclusion: -1 for certain ones, null outside the sampling."""
    odds = F.expr("u / (1D - u) * ((size - level) / level)")
    q = F.when(F.col("size") < F.col("since"), F.lit(-1.0)).when(F.col("level") > 0, odds)
    return _beside(sized, per_source).withColumn("q", F.when(F.col("size") > 0, q))


def _chosen(passes: int) -> Column:
    """Whether a pass took the document: its q lies in the pass's range and its size fitted then."""
    taken = F.lit(False)
    for k in range(passes):
        taken |= (F.col("q") > F.col(f"cut{k}")) & (F.col("q") <= F.col(f"cut{k + 1}")) & (F.col("size") <= F.col(f"missing{k}"))
    return F.coalesce(taken, F.lit(False))


NO_TIES = "array<struct<q:double,taken:bigint>>"


def plan(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, max_copies: int = 2, passes: int = PASSES) -> DataFrame:
    """The decisions, one row for each source: (source, source_size, target, whole, since, level, ties, cut0.., missing0.., q_last).

    ``ties`` says how many rows alike are taken where only some of them fit.
    """
    t = targets(sized, weights, share, max_copies)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_copies))).otherwise(0).cast("bigint")
    t = t.withColumn("whole", whole).withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    t = written(t.withColumn("fraction", F.when((F.col("source_size") > 0) & (F.col("whole") < max_copies), F.col("rest") / F.col("source_size")).otherwise(0.0)))
    # All tables of decisions have a row for each source: one count says whether they can be broadcast.
    near = F.broadcast if t.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lambda df: df
    state = _beside(t, _levels(sized, t, near)).withColumn("cut0", F.lit(-2.0)).withColumn("missing0", F.col("rest"))
    state = written(state.withColumn("ties", F.array().cast(NO_TIES)).drop("fraction", "rest"))
    own = [c for c in state.columns if c not in ("source", "ties")]
    for k in range(passes):
        ranked = _ranked(sized, near(state)).where(f"q > cut{k} and size <= missing{k}")
        # One row for each q: rows alike share one, and so do all certain documents of a source.
        ranked = ranked.groupBy("source", "q", F.col(f"missing{k}").alias("missing")).agg(F.sum("size").alias("all"), F.max("size").alias("size"))
        summed = running_sum(ranked, "all", ["q"], ["source"], name="words")
        fits = F.col("words") <= F.col("missing")
        past = F.min(F.when(~fits & (F.col("q") >= 0), F.struct("q", (F.col("words") - F.col("all")).alias("before"), "size")))
        got = summed.groupBy("source").agg(F.max(F.when(fits, F.col("q"))).alias("got"), F.max(F.when(fits, F.col("words"))).alias("held"), past.alias("past"))
        some = F.coalesce(F.floor((F.col(f"missing{k}") - F.col("past.before")) / F.col("past.size")), F.lit(0))
        ties = F.when(some > 0, F.array_append("ties", F.struct(F.col("past.q").alias("q"), some.alias("taken")))).otherwise(F.col("ties"))
        cut = F.coalesce("got", f"cut{k}").alias(f"cut{k + 1}")
        missing = F.col(f"missing{k}") - F.coalesce("held", F.lit(0)) - F.when(some > 0, some * F.col("past.size")).otherwise(0)
        state = written(_beside(state, got).select("source", *own, ties.alias("ties"), cut, missing.alias(f"missing{k + 1}")))
        own += [f"cut{k + 1}", f"missing{k + 1}"]
    missing = F.col(f"missing{passes}")
    left = _ranked(sized, near(state)).where(F.col("q").isNotNull() & ~_chosen(passes)).withColumn("off", F.abs(F.col("size") - missing)).where(F.col("off") < missing)
    left = left.groupBy("source", "q", "off").agg(F.count(F.lit(1)).alias("n"))
    last = left.groupBy("source").agg(F.min(F.struct("off", "q", "n")).alias("last"))
    alone = F.col("last.n") == 1
    ties = F.when(~alone, F.array_append("ties", F.struct(F.col("last.q").alias("q"), F.lit(1).cast("bigint").alias("taken")))).otherwise(F.col("ties"))
    return written(_beside(state, last).select("source", *own, ties.alias("ties"), F.when(alone, F.col("last.q")).alias("q_last")))


def copies(sized: DataFrame, decisions: DataFrame, passes: int = PASSES) -> DataFrame:
    """Adds each document's copies, 0 to max_copies, from its source's decisions."""
    more = _chosen(passes) | F.coalesce(F.col("q") == F.col("q_last"), F.lit(False))
    ranked = _ranked(sized, small(decisions)).withColumn("copies", F.col("whole") + more.cast("bigint"))
    if decisions.where("size(ties) > 0").isEmpty():
        return ranked
    of_q = F.filter("ties", lambda t: t["q"] == F.col("q"))
    some = F.when(F.size(of_q) > 0, F.aggregate(of_q, F.lit(0).cast("bigint"), lambda n, t: n + t["taken"]))
    ranked = ranked.withColumn("some", some)
    # Rows alike of which only some are taken are numbered in the partitions of a written table, and these by their counts.
    alike = written(ranked.where("some is not null").withColumn("id__", F.monotonically_increasing_id())).withColumn("part__", F.shiftright("id__", 33))
    counts = alike.groupBy("source", "q", "part__").agg(F.count(F.lit(1)).alias("n__"))
    before = Window.partitionBy("source", "q").orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("source").alias("source__"), F.col("q").alias("q__"), F.col("part__").alias("at__"), F.coalesce(F.sum("n__").over(before), F.lit(0)).alias("before__"))
    inside = Window.partitionBy("source", "q", "part__").orderBy("id__")
    numbered = alike.withColumn("place__", F.row_number().over(inside))
    numbered = numbered.join(counts, F.col("source").eqNullSafe(F.col("source__")) & (F.col("q") == F.col("q__")) & (F.col("part__") == F.col("at__")))
    taken = F.col("before__") + F.col("place__") <= F.col("some")
    numbered = numbered.withColumn("copies", F.col("copies") + taken.cast("bigint"))
    return ranked.where("some is null").unionByName(numbered.select(*ranked.columns)).drop("some")


def sample(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, max_copies: int = 2, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every document."""
    sized = written(sizes(docs, id_col, source_col, text_col, seed))
    chosen = copies(sized, plan(sized, weights, share, max_copies))
    return chosen.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, max_copies: int = 2, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it was taken."""
    decisions = plan(written(sizes(docs, id_col, source_col, text_col, seed)), weights, share, max_copies)
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[source_col].alias("source"), words.alias("size"), uniform(id_col, text_col, seed).alias("u"))
    chosen = copies(row, decisions).where("copies > 0")
    return chosen.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
