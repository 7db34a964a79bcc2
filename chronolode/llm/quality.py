"""Quality rules whose cutoffs follow the data.

Each document gets whole-number measures of its text. A quantile sketch of every
measure is kept per language and source: a histogram of values rounded to one
part in 32, so sketches merge by adding counts, in any order, to the same result.
Counts are summed on the map side, so a source with a third of all rows sends a
few hundred rows per task. Only documents that pass the base rules are sketched. A
document is rejected where a measure lies beyond the fence of its group, ``median +
spread * deviation``. The deviation is the root mean square of distances from the
median, none counted as more than the rule's ``clip``, so junk in under half of a group
moves the fence by a bounded amount, and documents that are mostly zero still have a
spread of their own; ``least`` is the smallest deviation assumed, for groups without
any. A group with too few documents uses the sketch of its language, and that of all
documents where the language has too few as well. Cutoffs are joined back by language
and source.

Defined results: a null text has no words and fails the base rules, null
languages and sources are groups of their own, a group without a document that passes
the base rules has no cutoffs and keeps none, an empty table gives an empty one, other
columns pass through untouched, repeated rows count as often as they occur. A very long
text is measured whole, its word hashes and windows in one row's arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolode.llm.common import packed, table, unpacked, words, written

#: Base rules: fewest words, largest share of repeated words in percent.
MIN_WORDS, MAX_REPEATED = 10, 20


@dataclass(frozen=True)
class Rule:
    """A measure in thousandths, the most that a document's distance from the median
    counts, and the least deviation of a group."""

    name: str
    value: str
    clip: int
    least: int


RULES = (
    Rule("symbols", "1000 * n_symbols div greatest(word_chars, 1)", 12, 1),
    Rule("duplicate_lines", "1000 * n_dup_lines div greatest(n_lines, 1)", 200, 15),
    Rule("repeated_words", "1000 * n_repeat_words div greatest(n_words, 1)", 100, 5),
    Rule("capitals", "1000 * n_capitals div greatest(word_chars, 1)", 30, 2),
    Rule("word_length", "1000 * word_chars div greatest(n_words, 1)", 800, 100),
)
#: Deviations from the median to the fence, and the documents a group needs for a cutoff of its own.
SPREAD, MIN_DOCS = 12, 100


def _repeated(n_words: str, windows: str) -> str:
    """Words covered by windows that occur twice or more. Only texts with such a
    window sort their windows; the fresh words of each are those past the one
    before."""
    ranked = f"sort_array(transform({windows}, (w, i) -> struct(w, i)))"
    twice = (
        "sort_array(transform(filter(r, (x, j) -> (j > 0 AND r[greatest(j - 1, 0)].w = x.w)"
        " OR (j < size(r) - 1 AND r[least(j + 1, size(r) - 1)].w = x.w)), x -> x.i))"
    )
    covered = (
        "aggregate(p, struct(0L AS n, -5 AS last),"
        " (a, i) -> struct(a.n + least(5, i - a.last) AS n, i AS last), a -> a.n)"
    )
    # transform over an array of one value names the value, so it is made once
    return (
        f"IF(size(array_distinct({windows})) = size({windows}), 0L,"
        f" transform(transform(array({ranked}), r -> {twice}), p -> {covered})[0])"
    )


def measured(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines (those with a word) and n_capitals; it may hold no such columns."""
    filled = F.coalesce(text, F.lit(""))
    first = df.withColumns(
        {
            "_words": words(text),
            "_lines": F.filter(F.split(filled, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "n_symbols": F.regexp_count(filled, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_capitals": (F.length(filled) - F.length(F.regexp_replace(filled, "[A-Z]+", ""))).cast("long"),
        }
    )
    second = first.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
        }
    )
    third = second.withColumn(
        "_windows",
        F.expr(
            "IF(size(_hashes) < 5, array(), transform(sequence(0, size(_hashes) - 5), i ->"
            " xxhash64(_hashes[i], _hashes[i + 1], _hashes[i + 2], _hashes[i + 3], _hashes[i + 4])))"
        ),
    )
    fourth = third.withColumn("n_repeat_words", F.expr(_repeated("n_words", "_windows")))
    return fourth.drop("_words", "_lines", "_hashes", "_windows")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def cell(value: Column) -> Column:
    """The sketch's cell of a whole number: itself below 64, else its power of two
    and the next five binary digits."""
    power = F.length(F.bin(value)) - 1
    part = F.call_function("shiftright", value, F.greatest(power - 5, F.lit(0))) - 32
    return F.when(value < 64, value).otherwise(64 + 32 * (power - 6) + part).cast("long")


def cell_value(at: Column) -> Column:
    """The smallest value of a cell."""
    power, part = F.floor((at - 64) / 32).cast("int") + 6, (at - 64) % 32
    return F.when(at < 64, at).otherwise(F.call_function("shiftleft", 32 + part, power - 5)).cast("long")


def sketch(df: DataFrame, keys: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts by ``keys``, rule and cell over documents that pass the base rules, and again
    by fewer keys: ``level`` says how many lead. Sketches of parts of the data merge by
    adding up ``n``."""
    pairs = F.array(*[F.struct(F.lit(r.name).alias("rule"), cell(F.expr(r.value)).alias("cell")) for r in rules])
    cells = df.select(*keys, F.explode(F.when(~base_failed(), pairs)).alias("p")).groupBy(*keys, "p.rule", "p.cell").agg(F.count(F.lit(1)).alias("n"))
    whole = cells.select(F.explode(F.sequence(F.lit(0), F.lit(len(keys)))).alias("level"), *cells.columns).select(
        "level",
        *[F.when(F.col("level") > i, F.col(k)).alias(k) for i, k in enumerate(keys)],
        "rule", "cell", "n",
    )
    return whole.groupBy("level", *keys, "rule", "cell").agg(F.sum("n").alias("n"))


def cutoffs(
    sketched: DataFrame, keys: tuple[str, ...], rules: tuple[Rule, ...] = RULES, spread: int = SPREAD, min_docs: int = MIN_DOCS
) -> DataFrame:
    """The cutoff of each rule for each full set of keys, from the nearest level
    with enough documents: one row per keys, a column per rule."""
    group = Window.partitionBy("level", *keys, "rule")
    up_to = group.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketched.withColumns({"upto": F.sum("n").over(up_to), "all": F.sum("n").over(group)})
    middle = F.min(F.when(F.col("upto") * 2 >= F.col("all"), F.col("cell"))).over(group)
    of_rule = {x: F.create_map(*[y for r in rules for y in (F.lit(r.name), F.lit(getattr(r, x)))])[F.col("rule")] for x in ("clip", "least")}
    away = F.least(F.abs(cell_value(F.col("cell")) - F.col("mid")), of_rule["clip"])
    apart = ranked.withColumn("mid", cell_value(middle)).withColumn("squares", F.col("n") * away * away)
    fences = apart.groupBy("level", *keys, "rule").agg(
        F.max("all").alias("docs"), F.max("mid").alias("mid"), F.sum("squares").alias("squares")
    )
    deviation = F.greatest(F.sqrt(F.col("squares") / F.col("docs")), of_rule["least"].cast("double"))
    fences = fences.select("level", *keys, "rule", "docs", (F.col("mid") + F.ceil(deviation * spread)).alias("cut"))
    wide = fences.groupBy("level", *keys).agg(
        F.max("docs").alias("docs"), *[F.max(F.when(F.col("rule") == r.name, F.col("cut"))).alias(r.name) for r in rules]
    )
    packed_cuts = wide.withColumn("cuts", F.struct(*[r.name for r in rules])).select("level", *keys, "docs", "cuts")
    out = packed_cuts.filter(F.col("level") == len(keys)).alias("full")
    choice = [(F.col("full.docs"), F.col("full.cuts"))]
    for level in range(len(keys) - 1, -1, -1):
        upper = packed_cuts.filter(F.col("level") == level).alias(f"l{level}")
        same = F.lit(True)
        for k in keys[:level]:
            same &= F.col(f"full.{k}").eqNullSafe(F.col(f"l{level}.{k}"))
        out = out.join(F.broadcast(upper) if level == 0 else upper, same, "left")
        choice.append((F.col(f"l{level}.docs"), F.col(f"l{level}.cuts")))
    cut = choice[-1][1]
    for docs, cuts in reversed(choice[:-1]):
        cut = F.when(docs >= min_docs, cuts).otherwise(cut)
    return out.select(*[F.col(f"full.{k}").alias(k) for k in keys], cut.alias("cuts"))


def judged(df: DataFrame, cuts: DataFrame, keys: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` joined with its cutoffs; adds base_failed and kept."""
    cuts = cuts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("cuts").alias("_cuts"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    within = F.lit(True)
    for r in rules:
        within &= F.expr(r.value) <= F.col("_cuts")[r.name]
    joined = df.join(cuts, same, "left").withColumn("base_failed", base_failed())
    # one condition on both sides: a part on measures alone would be pushed below
    # them as a filter, and every measure taken anew for each time it is named
    kept = F.when(F.col("base_failed"), False).otherwise(within)
    return joined.withColumn("kept", kept).drop("_cuts", *[f"_{k}" for k in keys])


def _measured_rows(docs: DataFrame, id_col: str, text_col: str, keys: tuple[str, ...]) -> DataFrame:
    named = {f"k{i}": docs[k] for i, k in enumerate(keys)}
    return measured(packed(docs, id=docs[id_col], t=docs[text_col], **named), F.col("t")).drop("t")


def quality_verdicts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, ...] = ("lang", "source")
) -> DataFrame:
    """One row per row of ``docs``: measures, base_failed and kept. Texts are read
    once; their measures are written for the sketch and the join."""
    names = tuple(f"k{i}" for i in range(len(keys)))
    rows, _ = written(_measured_rows(docs, id_col, text_col, keys).drop("row"), "measures", most=0)
    cuts, _ = written(cutoffs(sketch(rows, names), names), "cutoffs")
    out = judged(rows, cuts, names)
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    )


def quality_filter(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, ...] = ("lang", "source")
) -> DataFrame:
    """The rows that pass, with all their columns. Measures are taken twice, which
    costs less than writing or shuffling every text."""
    names = tuple(f"k{i}" for i in range(len(keys)))
    cuts, _ = written(cutoffs(sketch(_measured_rows(docs, id_col, text_col, keys).drop("row"), names), names), "cutoffs")
    return unpacked(judged(_measured_rows(docs, id_col, text_col, keys), cuts, names).filter("kept"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return quality_verdicts(table(spark, folder, "documents"))


_VALUES = {r.name: r.value.replace(" div ", " // ") for r in RULES}
SQL = f"""
with d as (
  select *, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) as l
  from documents),
n as (
  select doc_id, lang, source, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
    length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) as n_symbols,
    length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[A-Z]', '', 'g')) as n_capitals,
    len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines from d),
starts as (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d),
win as (select doc_id, i, w[i:i + 4] as g from starts),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from win) where c > 1),
rep as (select doc_id, count(distinct i + o) as n_repeat_words
        from twice, (select unnest([0, 1, 2, 3, 4]) as o) group by doc_id),
m as (select n.*, coalesce(n_repeat_words, 0) as n_repeat_words from n left join rep using (doc_id)),
v as (select lang, source, rule, value from m, lateral (values
  {', '.join(f"('{k}', {x})" for k, x in _VALUES.items())}) as t(rule, value)
  where n_words >= {MIN_WORDS} and 100 * n_repeat_words <= {MAX_REPEATED} * n_words),
c as (select *, if(value < 64, value,
    64 + 32 * (length(bin(value)) - 7) + (value >> greatest(length(bin(value)) - 6, 0)) - 32) as cell from v),
s as (select level, if(level > 0, lang, null) as lang, if(level > 1, source, null) as source, rule, cell, count(*) as n
      from c, (select unnest([0, 1, 2]) as level) group by all),
r as (select *, sum(n) over (partition by level, lang, source, rule order by cell) as upto,
        sum(n) over (partition by level, lang, source, rule) as total from s),
q as (select *, if(cell < 64, cell, (32 + (cell - 64) % 32) << ((cell - 64) // 32 + 1)) as value,
    min(cell) filter (upto * 2 >= total) over (partition by level, lang, source, rule) as half from r),
x as (select *, if(half < 64, half, (32 + (half - 64) % 32) << ((half - 64) // 32 + 1)) as mid,
    least(abs(value - mid), case rule {' '.join(f"when '{r.name}' then {r.clip}" for r in RULES)} end) as away from q),
f as (select level, lang, source, rule, max(total) as docs, max(mid) + cast(ceil({SPREAD} * greatest(
    sqrt(cast(sum(n * away * away) as double) / max(total)),
    case rule {' '.join(f"when '{r.name}' then {r.least}" for r in RULES)} end)) as bigint) as cut from x group by level, lang, source, rule),
k as (select a.lang, a.source, a.rule,
    case when a.docs >= {MIN_DOCS} then a.cut when b.docs >= {MIN_DOCS} then b.cut else z.cut end as cut
  from f a join f b on b.level = 1 and b.rule = a.rule and b.lang is not distinct from a.lang
  join f z on z.level = 0 and z.rule = a.rule where a.level = 2),
w as (select lang, source, {', '.join(f"max(cut) filter (rule = '{r.name}') as c_{r.name}" for r in RULES)} from k group by all),
o as (select m.*, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED} * n_words as base_failed,
    {' and '.join(f"{x} <= c_{k}" for k, x in _VALUES.items())} as within
  from m left join w on m.lang is not distinct from w.lang and m.source is not distinct from w.source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and within as kept
from o
"""
