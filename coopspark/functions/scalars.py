"""Column expressions on coordinates, names and statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from coopspark.schemas import CATEGORIES


def resized(start: Column, end: Column, length: int) -> tuple[Column, Column]:
    """Start and end of the interval of ``length`` around the centre ``(start + end) // 2``."""
    left = F.shiftright(start + end, 1) - F.lit(length // 2)
    return left, left + F.lit(length)


def regression_target(signal: Column) -> Column:
    """log1p of the signal; no signal counts as 0."""
    return F.log1p(F.coalesce(signal, F.lit(0.0)))


def class_label(signal: Column, above: Column | float = 0.0) -> Column:
    """1.0 where the signal is strictly above a threshold, else 0.0."""
    return (F.coalesce(signal, F.lit(0.0)) > above).cast("double")


def region_id(chrom: Column, start: Column, end: Column) -> Column:
    """``chrom:start-end``."""
    return F.concat(chrom.cast("string"), F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def parse_region(region: Column) -> tuple[Column, Column, Column]:
    """Chromosome, start and end of a region id."""
    part = lambda k: F.regexp_extract(region, r"^(.*):(\d+)-(\d+)$", k)
    return part(1), part(2).cast("bigint"), part(3).cast("bigint")


def hit_fields(details: Column) -> tuple[Column, Column, Column]:
    """TF (upper case), score (0 where it is no number) and strand of a tab-packed detail text."""
    field = lambda k: F.get(F.split(details, "\t"), F.lit(k))
    return F.upper(field(3)), F.coalesce(field(1).try_cast("bigint"), F.lit(0)), field(2)


def dimer_parts(tf: Column) -> Column:
    """The components of ``A::B``, upper case."""
    return F.split(F.upper(tf), "::")


def canonical_pair(a: Column, b: Column) -> Column:
    """The two names in order, joined with a bar."""
    return F.concat(F.least(a, b), F.lit("|"), F.greatest(a, b))


def name_prefix(name: Column) -> Column:
    """Leading letters of a name; the name itself if it starts with none."""
    letters = F.regexp_extract(name, "^([a-zA-Z]+)", 1)
    return F.when(letters != "", letters).otherwise(name)


def minus_log10(p: Column) -> Column:
    """-log10 with 0 taken as 1e-300."""
    return -F.log10(F.when(p == 0, F.lit(1e-300)).otherwise(p))


def signed_cbrt(x: Column) -> Column:
    return F.signum(x) * F.pow(F.abs(x), F.lit(1.0 / 3.0))


def signed_cube(x: Column) -> Column:
    return F.pow(x, F.lit(3.0))


def category_order(category: Column) -> Column:
    """Position of a cooperativity category; null for anything else."""
    return F.when(category.isin(CATEGORIES), F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), category).cast("int") - 1)


def binding_flag(value: Column) -> Column:
    """0 where the trimmed text is exactly ``0``, else 1 (null too)."""
    return F.when(F.trim(value.cast("string")) == "0", 0).otherwise(1)


def expressed(tf: Column, names: Column) -> Column:
    """Whether all components of a (dimer) name are among ``names``."""
    return F.forall(dimer_parts(tf), lambda p: F.array_contains(names, p))
