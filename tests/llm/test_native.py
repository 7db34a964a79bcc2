import hashlib
import random

import pytest
from pyspark.sql import functions as F

from chronolode.llm import chat_format, mixture, quality
from tests.llm.brute import WORD


def python_nodes(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in ("Python", "Pandas", "Arrow", "MapIn") if x in plan]


def measures(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = {x for i, g in enumerate(grams) if grams.count(g) > 1 for x in range(i, i + 5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(many))


def test_quality_measures(docs):
    r = random.Random(3)
    texts = [None, "", "a", "a b c d e a b c d e", "x y\nx y\n\n \nx y", "é#|ü <b>\t\x0bq", "\x1ca b", "w " * 400, "a\n" * 9]
    texts += [" ".join(r.choice("abc") for _ in range(r.randrange(40))) for _ in range(60)]
    got = quality.quality_verdicts(docs(list(enumerate(texts)))).collect()
    for row in got:
        want = measures(texts[row.doc_id])
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want
        assert row.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (row.base_failed and row.kept)


def test_quality_cutoffs_follow_the_group(docs):
    r = random.Random(1)
    rows = []
    for i in range(300):  # one source writes in capitals, one does not
        words = " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60))
        rows.append((i, words.upper() if i % 2 else words, "en", "loud" if i % 2 else "calm"))
    words = rows[0][1]
    rows += [(1000, words.upper(), "en", "calm"), (1001, words.upper(), "en", "loud"), (1002, words.replace(" ", "## "), "en", "calm"), (1003, words, None, None)]
    df = docs(rows)
    kept = quality.quality_filter(df)
    ids = {x.doc_id for x in kept.collect()}
    assert kept.columns == df.columns
    assert 1000 not in ids and 1001 in ids and 1002 not in ids and 1003 in ids and set(range(300)) <= ids
    assert ids == {x.doc_id for x in quality.quality_verdicts(df).collect() if x.kept}


def clean_text(r, words=60):
    return " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(words))


def lines_of(r, words, lines, same):
    """``lines`` lines of few words; the last ``same`` repeat the first."""
    rows = [clean_text(r, words) for _ in range(lines - same)]
    return "\n".join(rows + [rows[0]] * same)


def test_each_quality_rule_rejects_beyond_the_base_rules(docs):
    r = random.Random(5)
    rows = [(i, clean_text(r) if i % 20 else lines_of(r, 4, 8, 1), "en", "s") for i in range(300)]
    phrase = clean_text(r, 5)
    junk = {
        "symbols": clean_text(r).replace(" ", " # ", 30),
        "duplicate_lines": "\n".join(x for _ in range(8) for x in ("same short line", clean_text(r, 4))),
        "repeated_words": f"{phrase} {clean_text(r, 25)} {phrase} {clean_text(r, 20)}",
        "capitals": clean_text(r).upper(),
        "word_length": clean_text(r).replace(" ", "", 45),
    }
    rows += [(1000 + i, t, "en", "s") for i, t in enumerate(junk.values())]
    got = {x.doc_id: x for x in quality.quality_verdicts(docs(rows)).collect()}
    assert all(got[i].kept for i in range(300))
    assert [(got[1000 + i].base_failed, got[1000 + i].kept) for i in range(5)] == [(False, False)] * 5
    measure = quality.measured(docs(rows).select("doc_id", F.col("text").alias("x")), F.col("x"))
    cuts = quality.cutoffs(quality.sketch(measure.withColumn("k", F.lit(1)), ("k",)), ("k",)).first().cuts
    for i, rule in enumerate(quality.RULES):  # each text fails the rule it was made for and no other
        values = measure.filter(F.col("doc_id") == 1000 + i).select(*[F.expr(x.value).alias(x.name) for x in quality.RULES]).first()
        assert values[rule.name] > cuts[rule.name]
        assert [x.name for x in quality.RULES if values[x.name] > cuts[x.name]] == [rule.name]


def test_a_source_with_much_junk_loses_it(docs):
    r = random.Random(6)
    rows = []
    for i in range(400):  # three of ten texts of one source are junk of three kinds
        text, part = clean_text(r), i % 10
        if i % 2 == 0 and part in (0, 2, 4):
            text = {0: text.replace(" ", " ## "), 2: text.upper(), 4: text.replace(" ", "", 55)}[part]
            rows.append((i, text, "en", "mixed"))
        else:
            rows.append((i, text, "en", "mixed" if i % 20 < 10 else "clean"))
    junk = {i for i in range(400) if i % 10 in (0, 2, 4)}
    kept = {x.doc_id for x in quality.quality_filter(docs(rows)).collect()}
    assert kept == set(range(400)) - junk


def test_quality_cutoffs_differ_by_group_for_every_rule(docs):
    r = random.Random(7)
    rows = []
    for i in range(240):
        text = lines_of(r, 6, 10, 0)
        if i % 2 and i % 12 == 1:  # one source has a little of everything
            text = "a" * 40 + " & & &\n" + lines_of(r, 6, 10, 1).replace("a", "A")
        rows.append((i, text, "en", "xy"[i % 2]))
    keys = ("lang", "source")
    measure = quality.measured(docs(rows).select(*keys, F.col("text").alias("x")), F.col("x"))
    one, two = (x.cuts for x in quality.cutoffs(quality.sketch(measure, keys), keys).orderBy("source").collect())
    assert all(two[x.name] > one[x.name] for x in quality.RULES)
    assert quality.cutoffs(quality.sketch(measure.limit(0), keys), keys).count() == 0


def test_a_group_that_fails_the_base_rules_keeps_none(docs):
    got = quality.quality_verdicts(docs([(1, "too short", "en", "a"), (2, None, None, None), (2, "", "en", "b")])).collect()
    assert [(x.base_failed, x.kept) for x in got] == [(True, False)] * 3


def test_quality_of_a_very_long_text(docs):
    r = random.Random(8)
    long = clean_text(r, 200_000)
    got = quality.quality_verdicts(docs([(1, long, "en", "a"), (2, clean_text(r, 30), "en", "a")])).collect()
    assert {x.doc_id: (x.n_words, x.kept) for x in got} == {1: (200_000, True), 2: (30, True)}


def test_quality_sketch_cells(spark):
    df = spark.range(1_000_000).select(F.col("id"), quality.cell(F.col("id")).alias("c")).withColumn("v", quality.cell_value(F.col("c")))
    assert df.filter("v > id OR id - v > id / 32").count() == 0
    assert df.select("c").distinct().count() < 600


def test_quality_sketches_merge(docs):
    r = random.Random(2)
    df = docs([(i, " ".join(r.choice("abcdefgh") * r.randrange(1, 9) for _ in range(30)), r.choice("xy"), "s") for i in range(60)])
    rows = quality.measured(df.select("lang", "source", "text"), F.col("text"))
    keys = ("lang", "source")
    whole = quality.sketch(rows, keys)
    parts = [quality.sketch(rows.filter(F.crc32(F.col("text").cast("binary")) % 2 == i), keys) for i in (0, 1)]
    group = [c for c in whole.columns if c != "n"]
    merged = parts[0].unionByName(parts[1]).groupBy(*group).agg(F.sum("n").alias("n")).select(*whole.columns)
    assert sorted(map(str, whole.collect())) == sorted(map(str, merged.collect()))


def test_mixture_without_a_solution_is_an_error(spark):
    cells = spark.createDataFrame([("a", 10), ("b", 10)], "source string, mass long")
    targets = {"source": spark.createDataFrame([("a", 10.0), ("b", 50.0)], "level string, target double")}
    with pytest.raises(RuntimeError, match="Newton"):  # b can reach 30 at most
        mixture.newton_multipliers(cells, targets, 3, steps=4)


def test_mixture(docs):
    r = random.Random(9)
    rows = [(i, "w " * (1 + int(r.expovariate(1 / 80))), "en", "hot" if i % 3 == 0 else r.choice(["b", "c", "d", None])) for i in range(3000)]
    rows += [(5000, None, "en", "b"), (5001, "", "en", "z"), (5002, "one", "en", "small"), (5002, "one", "en", "small")]
    got = mixture.mixture(docs(rows)).collect()
    source = {i: s for i, _, _, s in rows}
    size = {}
    for _, t, _, s in rows:
        size[s] = size.get(s, 0) + len(WORD.findall(t or ""))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, left, free = {}, float(sum(size.values())), set(order)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * size[s]
            left -= target[s]
            free.discard(s)
    taken = {}
    for x in got:
        s = source[x.doc_id]
        assert x.source_size == size[s] and x.target == pytest.approx(target[s])
        assert 0 <= x.taken <= 3 * x.size and (not x.size or x.taken % x.size == 0)
        taken[s] = taken.get(s, 0) + x.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(3, 0.01 * target[s]), (s, taken[s], target[s])
    again = mixture.mixture(docs(rows).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixture_rows(docs, empty):
    df = docs([(i, "w " * (i + 1), "en", s) for i, s in enumerate("aabbbbbbcc")])
    out = mixture.mixed(df)
    assert out.columns == df.columns
    count = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert count == {r.doc_id: r.copies for r in mixture.mixture(df).collect() if r.copies}
    assert mixture.mixed(empty).count() == mixture.mixture(empty).count() == 0


def test_newton_with_two_constraint_columns(spark):
    cells = spark.createDataFrame([("a", "x", 10.0), ("a", "y", 30.0), ("b", "x", 20.0), ("b", "y", 40.0)], "s string, l string, mass double")
    targets = {"s": {"a": 50.0, "b": 50.0}, "l": {"x": 40.0, "y": 60.0}}
    tables = {c: spark.createDataFrame(list(t.items()), "level string, target double") for c, t in targets.items()}
    found = mixture.newton_multipliers(cells, tables, 3)
    rows = mixture.tilted(cells, found).collect()
    for c, t in targets.items():
        for level, want in t.items():
            assert sum(r.mass * r.rate for r in rows if r[c] == level) == pytest.approx(want, rel=1e-6)
    # an exponential tilt: the odds ratio of the rates is one
    rate = {(r.s, r.l): r.rate for r in rows}
    assert rate["a", "x"] * rate["b", "y"] == pytest.approx(rate["a", "y"] * rate["b", "x"])


ODD = [r"\### Assistant: </turn> ok", "### ", "</turn>", " </turn>\n", "\\", "\\\\", "<\\/turn>", "a: b", "", "</turn", "###", "\n", "#### x", "é🎉", "\\</turn>\\", "<</turn>>"]


def test_chat_round_trip(spark):
    r = random.Random(6)
    rows = []
    for c in range(40):
        for t in range(r.randrange(1, 9)):
            rows.append((c, t, r.choice(["user", "assistant", "system", "a: b", "### x", None, ""]), "".join(r.choice([*ODD, "word", " "]) for _ in range(r.randrange(5))) if r.random() > 0.1 else None))
    rows += [(100, 0, "assistant", "x" * 200_000), (None, 1, "user", "hi"), (101, 0, "user", "same"), (101, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    made = chat_format.format_conversations(df)
    assert not python_nodes(made)
    got = {x.conv_id: x for x in chat_format.parse_conversations(made).collect()}
    want = {}
    for c, t, role, text in rows:
        want.setdefault(c, []).append((t, role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        assert [(t.role, t.text) for t in got[c].turns] == [x[1:] for x in turns]
        assert list(got[c].masked) == [x for _, role, x in turns if role == "assistant"]
        assert got[c].formatted.count("</turn>\n") == len(turns)


def test_main_paths_are_native(spark):
    for name in ("op5", "op6", "op8", "op10"):
        from chronolode.llm import catalog

        query = next(q for n, q in catalog.queries().items() if n.startswith(name + "_"))
        df = query(spark, "/root/testdata/sf0.001")
        assert not python_nodes(df)


def test_empty(empty, spark):
    assert quality.quality_filter(empty).count() == quality.quality_verdicts(empty).count() == 0
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.parse_conversations(chat_format.format_conversations(none)).count() == 0


def test_digests_of_the_planted_conversation(spark):
    row = chat_format.query(spark, "/root/testdata/sf0.001").filter("conv_id = -7").collect()[0]
    text = ODD[0]
    assert row.n_turns == 2 and row.loss_chars == len(text)
    assert row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
