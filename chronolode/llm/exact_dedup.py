"""Exact duplicates: equal texts by a 128-bit content hash, bytes compared inside
groups.

A first pass aggregates ids by hash, combined on the map side, so a text that a
third of all rows hold is one row per task before the shuffle. Only the texts of
groups with more than one row are grouped by their bytes; a hash collision
splits there into groups of its own.

Defined results: a null text counts as empty, null ids are smaller than all
others, rows that agree in id and text share one verdict (``without_duplicates``
returns one of them), an empty table gives an empty one, other columns are
ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolode.llm.common import packed, table, unpacked, written


def content_hash(text: Column) -> Column:
    """128 bits of the text's bytes."""
    return F.unhex(F.md5(text))


def _keyed(docs: DataFrame, id_col: str, text_col: str, hashed: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit(""))
    return packed(docs, id=docs[id_col], t=text, h=hashed(text), sha=F.sha2(text, 256))


def _groups(keyed: DataFrame, keep: str) -> DataFrame:
    """One row for each text that several rows hold: hash, digest, size, kept id
    and the number of rows with that id."""
    best = {"largest": F.max, "smallest": F.min}[keep]
    counted = keyed.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    several, _ = written(counted.filter("n > 1").select("h"), "hash-groups")
    by_bytes = keyed.join(several, "h", "left_semi").groupBy("h", "t")
    # null ids sort below all others, so one among "smallest" is the one kept
    kept = best(F.col("id")) if keep == "largest" else F.min(F.struct("id"))["id"]
    return by_bytes.agg(F.count(F.lit(1)).alias("n"), kept.alias("keep")).select(
        "h", F.sha2("t", 256).alias("sha"), "n", "keep"
    )


def _judged(keyed: DataFrame, keep: str) -> DataFrame:
    groups = _groups(keyed, keep)
    return keyed.join(groups, ["h", "sha"], "left").select(
        "row",
        "id",
        "h",
        "sha",
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep"),
        F.coalesce("n", F.lit(1).cast("long")).alias("n"),
    )


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    hashed: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per row of ``docs``: its id, the id that stays, the number of rows
    with its text, whether it stays, and the text's sha256."""
    return _judged(_keyed(docs, id_col, text_col, hashed).drop("row").withColumn("row", F.lit(0)), keep).select(
        F.col("id").alias("doc_id"),
        F.col("keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def without_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    hashed: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """The rows that stay, one for each text, with all their columns."""
    keyed = _keyed(docs, id_col, text_col, hashed)
    stay = _judged(keyed, keep).filter(F.col("id").eqNullSafe(F.col("keep")))
    single, several = stay.filter("n = 1"), stay.filter("n > 1")
    return unpacked(single.unionByName(several.dropDuplicates(["h", "sha"])))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(table(spark, folder, "documents"), keep="largest")


SQL = """
with d as (select doc_id, coalesce(text, '') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id,
  count(*) over (partition by t) as group_size,
  doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from d
"""
