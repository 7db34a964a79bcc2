"""Mixing sources to target weights by entropy balancing.

Among all document rates that give every source its target number of words, the
ones taken are closest in relative entropy (words as the base measure) to using
each document once. They are ``rate = min(max_rate, exp(multiplier of its
source))``; the multipliers solve a convex dual whose gradient per source is
``mass - target`` and whose Hessian is diagonal, the mass itself. Every Newton
step is one aggregate over the word masses by constraint cell, which are summed
from the documents once, on the map side first. Several constraint columns (say
source and language) are solved block by block in the same way.

Rates become whole copies inside blocks of about ``BLOCK`` documents, to which a
hash of the id deals the documents of a source, so a source with a third of all
rows is split like any other. In a block the largest documents are rounded first
and each takes up the error of those before it, so a block ends within about half
of its smallest document of its share.

Defined results: a null text has size 0 and is never taken, null sources are one
source that sorts last, rows that agree in id, size and source get the same
copies, an empty table gives an empty one, other columns pass through untouched.
Reruns agree: sizes are whole numbers, and order inside blocks follows size, hash
and id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolode.llm.common import packed, table, unpacked, words, written

MAX_RATE = 3
BLOCK = 1000
#: Newton ends when every mass is this close to its target; it is an error if that takes more steps.
TOLERANCE, STEPS = 1e-9, 60


def size_of(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def water_filled(sources: DataFrame, max_rate: int = MAX_RATE) -> DataFrame:
    """Adds ``target`` to rows of (source, mass, weight): shares of the whole mass by
    weight, none above ``max_rate`` times its mass. Sources are capped in the order
    of mass by weight; all further ones share what is left. One row per source."""
    order = Window.orderBy(F.col("mass") / F.col("weight"), F.col("source").asc_nulls_last())
    after = order.rowsBetween(0, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("mass").over(total) - max_rate * F.coalesce(F.sum("mass").over(before), F.lit(0))
    level = left / F.sum("weight").over(after)
    tried = sources.withColumns({"level": level, "cap": max_rate * F.col("mass")})
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level"))))
    shared = tried.withColumn("shared", first.over(total)["level"])
    share = F.col("weight") * F.col("shared")
    capped = F.col("shared").isNull() | (share > F.col("cap"))
    return shared.withColumn("target", F.when(capped, F.col("cap").cast("double")).otherwise(share)).drop(
        "level", "cap", "shared"
    )


def newton_multipliers(
    cells: DataFrame, targets: dict[str, DataFrame], max_rate: float = MAX_RATE, tolerance: float = TOLERANCE, steps: int = STEPS
) -> dict[str, DataFrame]:
    """The dual's solution: for each constraint column a table (level, multiplier).
    ``cells`` has the constraint columns and their ``mass``; ``targets`` a table
    (level, target) per column. Only the largest error comes to the driver."""
    found = {
        c: written(t.select("level", "target", F.lit(0.0).alias("multiplier")), "multipliers")[0] for c, t in targets.items()
    }
    for _ in range(steps):
        worst = 0.0
        for column in found:
            masses = tilted(cells, found, max_rate).groupBy(F.col(column).alias("at")).agg(
                F.sum(F.col("mass") * F.col("rate")).alias("got")
            )
            joined = found[column].join(masses, F.col("level").eqNullSafe(F.col("at")), "left")
            gap = F.coalesce((F.col("target") - F.col("got")) / F.nullif(F.col("got"), F.lit(0.0)), F.lit(0.0))
            step = F.when(F.col("target") <= 0, F.lit(float("-inf"))).otherwise(
                F.col("multiplier") + F.greatest(F.lit(-2.0), F.least(F.lit(2.0), gap))
            )
            error = F.when(F.col("target") > 0, F.abs(F.col("target") - F.col("got")) / F.col("target"))
            # a mass at its cap cannot grow further
            stepped = joined.select("level", "target", step.alias("multiplier"), error.alias("error"))
            after, _ = written(stepped, "multipliers")
            worst = max(worst, after.agg(F.max("error")).first()[0] or 0.0)
            found[column] = after.drop("error")
        if worst <= tolerance:
            return found
    raise RuntimeError(f"no mixture after {steps} Newton steps: a mass is {worst:.3g} of its target away from it")


def tilted(df: DataFrame, multipliers: dict[str, DataFrame], max_rate: float = MAX_RATE) -> DataFrame:
    """``df`` with the ``rate`` of each row."""
    tilt = F.lit(0.0)
    for i, (column, found) in enumerate(multipliers.items()):
        found = found.select(F.col("level").alias(f"_l{i}"), F.col("multiplier").alias(f"_m{i}"))
        df = df.join(found, F.col(column).eqNullSafe(F.col(f"_l{i}")), "left")
        tilt = tilt + F.coalesce(F.col(f"_m{i}"), F.lit(0.0))
    rate = F.least(F.lit(float(max_rate)), F.exp(tilt))
    return df.withColumn("rate", rate).drop(*[f"_{x}{i}" for i in range(len(multipliers)) for x in "lm"])


def _rounded(items: str, most: int) -> str:
    """Copies of a block's (size, key, id, n, rate), largest first: whole numbers
    next to the rate that bring words taken nearest to words wanted so far."""
    c = (
        f"CAST(least({most}, ceil(x.rate - 1e-9), greatest(floor(x.rate + 1e-9),"
        " round((a.want + x.rate * x.size * x.n - a.got) / (x.size * x.n)))) AS INT)"
    )
    return (
        f"aggregate({items}, struct(0D AS want, 0D AS got, CAST(array() AS ARRAY<INT>) AS out), (a, x) ->"
        f" transform(array({c}), c -> struct(a.want + x.rate * x.size * x.n AS want,"
        f" a.got + c * x.size * x.n AS got, concat(a.out, array(c)) AS out))[0], a -> a.out)"
    )


def copies(sized: DataFrame, rates: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """Copies of each distinct (id, size, source) with words."""
    units = sized.filter("size > 0").groupBy("source", "id", "size").agg(F.count(F.lit(1)).alias("n"))
    of_source = rates.join(sources.select(F.col("source").alias("_s"), "docs"), F.col("source").eqNullSafe(F.col("_s")))
    of_source = of_source.select(F.col("source").alias("_s"), "rate", F.ceil(F.col("docs") / block).cast("long").alias("_blocks"))
    dealt = units.join(of_source, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_key", F.xxhash64("id", "size"))
    blocks = dealt.groupBy("source", F.pmod(F.col("_key"), F.col("_blocks")).alias("_block")).agg(
        F.sort_array(F.collect_list(F.struct("size", F.col("_key").alias("key"), "id", "n", "rate")), asc=False).alias("items")
    )
    zipped = F.arrays_zip("items", F.expr(_rounded("items", MAX_RATE)).alias("copies"))
    return blocks.select("source", F.explode(zipped).alias("z")).select("source", "z.items.id", "z.items.size", "z.copies")


def _plan(sized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Copies by (id, size, source), and the sources with their masses and targets."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("mass"), F.count(F.lit(1)).alias("docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighted = sources.withColumn("weight", (rank - 1) % 3 + 1)
    sources, _ = written(water_filled(weighted), "sources")
    found = newton_multipliers(
        sources.select("source", "mass"), {"source": sources.select(F.col("source").alias("level"), "target")}
    )
    rates = tilted(sources.select("source"), found)
    return copies(sized, rates, sources), sources


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return packed(docs, id=docs[id_col], source=docs[source_col], size=size_of(docs[text_col]))


def _same(a: str, b: str, *columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out &= F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: size, source_size, target of its source, copies
    and words taken."""
    sized, _ = written(_sized(docs, id_col, text_col, source_col).drop("row"), "sizes", most=0)
    taken, sources = _plan(sized)
    out = sized.alias("d").join(sources.alias("s"), _same("d", "s", "source"), "left")
    out = out.join(taken.alias("t"), _same("d", "t", "id", "size", "source"), "left")
    number = F.coalesce(F.col("t.copies"), F.lit(0))
    return out.select(
        F.col("d.id").alias("doc_id"),
        F.col("d.size").alias("size"),
        F.col("s.mass").alias("source_size"),
        F.col("s.target").alias("target"),
        number.alias("copies"),
        (number * F.col("d.size")).cast("long").alias("taken"),
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row as often as it has copies, with all its columns."""
    sized, _ = written(_sized(docs, id_col, text_col, source_col).drop("row"), "sizes", most=0)
    taken, _ = written(_plan(sized)[0].filter("copies > 0"), "copies")
    rows = _sized(docs, id_col, text_col, source_col).alias("d").join(taken.alias("t"), _same("d", "t", "id", "size", "source"))
    return unpacked(rows.select("d.row", F.explode(F.sequence(F.lit(1), F.col("t.copies")))))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(table(spark, folder, "documents"))
