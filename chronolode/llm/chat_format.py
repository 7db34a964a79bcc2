r"""Conversations as one training text each, checked by a grammar round trip.

Grammar of the rendered text::

    conversation = turn*
    turn         = "### " role ": " body " </turn>" "\n"

Neither field may hold the strings that begin and end a turn, nor a role the one
that ends it. A turn is written as it is where a deterministic parser accepts it
and gives it back unchanged; where it does not (a control string or a backslash
inside) its fields are escaped, and the parser is run again. Escaping puts a backslash before each
backslash and breaks each control string with one, so an escaped field holds no
control string and ends at the first one that follows. Any field survives the
second pass, so two passes suffice; a row that still differed would raise.

The loss mask is the list of (start, length) of assistant bodies, in code points
of the rendered text. Turn texts are escaped row by row before turns meet; one
row per conversation is the only large value made.

Defined results: null text or role is empty, turns that share a number are
ordered by role and text, a null conversation id is an id of its own, an empty
table gives an empty one, other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolode.llm.common import table

# Fixed values of the template.
HEAD, MIDDLE, TAIL = "### ", ": ", " </turn>\n"
IN_ROLE, IN_BODY = ("### ", "</turn>", ": "), ("### ", "</turn>")


def escape(text: Column, control: tuple[str, ...]) -> Column:
    r"""Backslash before each backslash, and after the first character of each
    control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in control:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _turn(role: Column, body: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit(MIDDLE), body, F.lit(TAIL))


def _turns(rendered: Column) -> Column:
    """The parser: (head, body) of each turn as written, still escaped. A turn ends
    at the first tail; its role ends at the first middle."""
    pieces = F.split(rendered, TAIL, -1)
    whole = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return F.transform(
        whole,
        lambda p: F.struct(
            F.substring_index(p.substr(F.lit(len(HEAD) + 1), F.length(p)), MIDDLE, 1).alias("role"),
            p.substr(F.locate(MIDDLE, p) + len(MIDDLE), F.length(p)).alias("body"),
        ),
    )


def _round_trip(role: Column, body: Column, want_role: Column, want_body: Column) -> Column:
    """Whether the parser accepts the rendered turn and gives back this one."""
    one = F.transform(_turns(_turn(role, body)), lambda t: F.struct(unescape(t["role"]), unescape(t["body"])))
    same = one == F.array(F.struct(want_role, want_body))
    for field, control in ((role, IN_ROLE), (body, IN_BODY)):
        for mark in control:
            same &= ~F.contains(field, F.lit(mark))
    return same


def format_conversations(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``loss_spans``."""
    rows = turns.select(
        turns[conv_col].alias("conv"),
        turns[turn_col].alias("n"),
        F.coalesce(turns[role_col], F.lit("")).alias("role"),
        F.coalesce(turns[text_col], F.lit("")).alias("text"),
    )
    plain = rows.withColumn("same", _round_trip(F.col("role"), F.col("text"), F.col("role"), F.col("text")))
    chosen = plain.select(
        "conv", "n", "role", "text",
        F.when(F.col("same"), F.col("role")).otherwise(escape(F.col("role"), IN_ROLE)).alias("out_role"),
        F.when(F.col("same"), F.col("text")).otherwise(escape(F.col("text"), IN_BODY)).alias("body"),
    )
    checked = chosen.withColumn(
        "body",
        F.when(_round_trip(F.col("out_role"), F.col("body"), F.col("role"), F.col("text")), F.col("body")).otherwise(
            F.raise_error(F.lit("a turn does not survive its round trip"))
        ),
    )
    line = checked.select(
        "conv", "n", "role", "text",
        _turn(F.col("out_role"), F.col("body")).alias("line"),
        (F.length("out_role") + len(HEAD) + len(MIDDLE)).alias("skip"),
        F.length("body").alias("chars"),
    )
    before = Window.partitionBy("conv").orderBy("n", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = line.withColumn("start", F.coalesce(F.sum(F.length("line")).over(before), F.lit(0)))
    gathered = placed.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("start", "line"))).alias("lines"),
        F.sort_array(
            F.collect_list(
                F.when(
                    F.col("role") == "assistant",
                    F.struct((F.col("start") + F.col("skip") + 1).cast("int").alias("start"), F.col("chars").alias("length")),
                )
            )
        ).alias("loss_spans"),
    )
    return gathered.select(
        F.col("conv").alias("conv_id"), F.array_join("lines.line", "").alias("formatted"), "loss_spans"
    )


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """Turns (role, text) and masked texts read back from ``formatted`` alone."""
    read = F.transform(
        _turns(F.col("formatted")),
        lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["body"]).alias("text")),
    )
    masked = F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr(s["start"], s["length"])))
    return formatted.withColumns({"turns": read, "masked": masked})


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation and one full of control strings, digests of what is read
    back from the formatted text."""
    odd = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string"
    )
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = parse_conversations(format_conversations(turns))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.withColumn("loss", F.array_join("masked", "")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked as (
  select *, role || chr(10) || text as msg,
    instr(role || text, '\') + instr(role, '### ') + instr(text, '### ') + instr(role, '</turn>')
      + instr(text, '</turn>') + instr(role, ': ') = 0 as plain from rows),
sized as (
  select *, 15 + length(role) + length(text) + if(plain, 0,
      length(replace(msg, '\', '\\')) + length(replace(msg, '### ', '###  '))
      + length(replace(msg, '</turn>', '</turn> ')) + length(replace(role, ': ', ':  '))
      - 3 * length(msg) - length(role)) as chars from marked)
select conv_id, count(*) as n_turns,
  sha256(string_agg(msg || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars
from sized group by conv_id
"""
