"""Two-sided p-values of Student's t and of the signed rank statistic as Spark
expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Largest number of pairs for which the signed rank null distribution is
# counted out; beyond it the normal approximation is used.
EXACT_PAIRS = 50


def _series(first: Column, factor, terms: Column) -> Column:
    """``first * (1 + f(1) + f(1)f(2) + ...)`` with ``terms`` factors."""
    steps = F.when(terms >= 1, F.sequence(F.lit(1), F.greatest(terms, F.lit(1)))).otherwise(
        F.array().cast("array<int>")
    )
    start = F.struct(first.alias("term"), first.alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * factor(i)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    return F.aggregate(steps, start, step, lambda acc: acc["total"])


def student_t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) for integer degrees of freedom, by the finite cosine series
    of the t distribution. Null for a null or NaN ``t`` and for ``df < 1``."""
    v = df.cast("int")
    angle = F.atan(F.abs(t) / F.sqrt(v.cast("double")))
    cos, sin = F.cos(angle), F.sin(angle)
    cos2 = cos * cos
    even = sin * _series(F.lit(1.0), lambda i: cos2 * (2 * i - 1) / (2 * i), ((v - 2) / 2).cast("int"))
    odd = F.lit(2.0) / F.pi() * (angle + sin * _series(cos, lambda i: cos2 * (2 * i) / (2 * i + 1), ((v - 3) / 2).cast("int")))
    inside = F.when(v == 1, F.lit(2.0) / F.pi() * angle).when(v % 2 == 0, even).otherwise(odd)
    return F.when(t.isNotNull() & ~F.isnan(t) & (v >= 1), F.greatest(F.lit(1.0) - inside, F.lit(0.0)))


def signed_rank_exact(w: Column, n: Column) -> Column:
    """P of a signed rank sum as small as ``w`` on either side, by counting the
    subsets of ranks 1..n with each sum."""
    total = (n * (n + 1) / 2).cast("int")
    start = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), total))

    def add_rank(counts: Column, rank: Column) -> Column:
        return F.transform(
            counts,
            lambda c, j: c + F.when(j >= rank, F.get(counts, j - rank)).otherwise(F.lit(0.0)),
        )

    counts = F.aggregate(F.sequence(F.lit(1), n.cast("int")), start, add_rank)
    tail = F.aggregate(F.slice(counts, 1, w.cast("int") + 1), F.lit(0.0), lambda a, c: a + c)
    return F.least(F.lit(1.0), 2 * tail / F.pow(F.lit(2.0), n))


def signed_rank_exact_tied(w: Column, ranks: Column) -> Column:
    """The same for ranks that repeat: ``ranks`` holds each pair's rank, the mean one
    where sizes are equal. Sums are counted by doubled ranks, which are whole."""
    doubled = F.transform(ranks, lambda r: (2 * r).cast("int"))
    total = F.aggregate(doubled, F.lit(0), lambda a, r: a + r)
    start = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), total))

    def add_rank(counts: Column, rank: Column) -> Column:
        return F.transform(counts, lambda c, j: c + F.when(j >= rank, F.get(counts, j - rank)).otherwise(F.lit(0.0)))

    counts = F.aggregate(doubled, start, add_rank)
    tail = F.aggregate(F.slice(counts, 1, (2 * w).cast("int") + 1), F.lit(0.0), lambda a, c: a + c)
    return F.least(F.lit(1.0), 2 * tail / F.pow(F.lit(2.0), F.size(ranks)))


def normal_two_sided(z: Column) -> Column:
    """P(|Z| >= |z|) for a standard normal, from the complementary error
    function: a power series near zero and a continued fraction in the tail."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(80)),
        F.struct(x.alias("term"), x.alias("total")),
        lambda a, i: F.struct(
            (a["term"] * 2 * x * x / (2 * i + 1)).alias("term"),
            (a["total"] + a["term"] * 2 * x * x / (2 * i + 1)).alias("total"),
        ),
        lambda a: F.lit(1.0) - F.lit(2.0) / F.sqrt(F.pi()) * F.exp(-x * x) * a["total"],
    )
    fraction = F.aggregate(
        F.sequence(F.lit(80), F.lit(1), F.lit(-1)), x, lambda a, i: x + (i / F.lit(2.0)) / a
    )
    tail = F.exp(-x * x) / F.sqrt(F.pi()) / fraction
    return F.when(x < 2.5, series).otherwise(tail)
