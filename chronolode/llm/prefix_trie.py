r"""The trie of conversations that begin alike, by composable fingerprints.

A conversation is rebuilt from the head of another one and its own later turns. No
rebuilt text is made: every turn is a map x -> a x + b modulo 2^61 - 1 taken from a
digest of its role and text, turns after one another are the product of their maps,
and this product is the fingerprint of a beginning. Products form a group, so with
H the product of the head, P(i) that of a conversation's first i turns and h the
turns it leaves out, its rebuilt beginnings are ``H * P(h)^-1 * P(i)``: one factor for
each conversation, combined with products of original turns.

1. Turns are sorted by ranges of (conversation, turn), so a conversation may hold
   any share of them, and multiplied along each partition; products of what reaches
   over an edge, one per partition, are carried on by the driver.
2. Beginnings of equal depth and fingerprint are a node. Equality is verified along
   stored references: all members of a node must come from one parent node and have
   one turn digest last, and rows with one digest must have equal bytes. If ever two
   differ, all digests are taken anew with another salt.
3. Sums over subtrees need no walk: each node belongs to the row of its smallest
   member at its depth, what lies below a node is then found in the later rows of
   its members, and sums backwards over a conversation's rows (in blocks of
   ``DEPTHS``) added up by node give the sum over the subtree.
4. The ids that end in a node are joined in chunks of neighbouring ids; a node of
   many chunks is digested as a stream.

Defined results: null roles and texts are empty; a null turn comes first; turns that
share a number are ordered by a digest of role and text, and repeated rows are turns
of their own; rows without a conversation id belong to no conversation and are left
out; a head whose conversation is absent is empty; an empty table gives an empty
one; very long texts are read once for their digest; other columns are ignored
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolode.llm.common import materialise, table, written

#: Conversations share the head of one in so many; heads are shorter than HEADS.
FAMILY, HEADS = 5, 9
PRIME = (1 << 61) - 1
#: Depths summed in one window, and bits of neighbouring ids joined at once.
DEPTHS, ID_BITS = 1024, 12
#: Digests with other salts before the rows are given up.
SALTS = 5

_NODE = ["depth", "fa", "fb"]

Digest = Callable[[Column, Column, int], Column]


def turn_digest(role: Column, text: Column, salt: int) -> Column:
    """16 bytes of a turn."""
    head = F.concat(F.length(role).cast("string"), F.lit(":" if salt == 0 else f":{salt}:"))
    return F.unhex(F.md5(F.concat(head, role, text)))


def head_turns(conv: Column) -> Column:
    """Turns that a conversation takes from the first of its family."""
    return (F.crc32(conv.cast("string")) % HEADS).cast("int")


def _maps(digests: pa.Array) -> list[list[int]]:
    """The map (a, b) of each digest."""
    _, places, data = digests.buffers()
    at = np.frombuffer(places, np.int32)[digests.offset]
    halves = np.frombuffer(data, ">u8", offset=int(at), count=2 * len(digests)).reshape(-1, 2)
    return [(halves[:, 0] % np.uint64(PRIME - 1) + np.uint64(1)).tolist(), (halves[:, 1] % np.uint64(PRIME)).tolist()]


def combined(f: tuple[int, int], g: tuple[int, int]) -> tuple[int, int]:
    """The fingerprint of what f stands for, then what g stands for."""
    return f[0] * g[0] % PRIME, (f[0] * g[1] + f[1]) % PRIME


def inverse(f: tuple[int, int]) -> tuple[int, int]:
    a = pow(f[0], -1, PRIME)
    return a, -f[1] * a % PRIME


def _multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Products along the conversations of a sorted partition, from the start of
    each or of the partition; last a row that says how the partition begins and ends."""
    part, first, conv, i, f, edge = TaskContext.get().partitionId(), None, None, 0, (1, 0), True
    for batch in batches:
        convs = batch.column("conv").to_pylist()
        out = []
        for c, *g in zip(convs, *_maps(batch.column("digest")), strict=True):
            if c != conv:
                if conv is None:
                    first = c
                else:
                    edge = False
                conv, i, f = c, 0, (1, 0)
            before, f, i = f, combined(f, g), i + 1
            out.append((edge, i, *before, *f))
        if out:
            edges, places, *products = zip(*out, strict=True)
            n = len(out)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * n, pa.int32()), pa.array(edges), pa.array(convs), pa.array(places, pa.int64()),
                    *(pa.array(p, pa.int64()) for p in products),
                    batch.column("bytes"), batch.column("digest"), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()),
                ],
                _SCANNED,
            )
    if conv is not None:
        values = [[part], [False], [conv], [i], [1], [0], [f[0]], [f[1]], [0], [b""], [first], [edge]]
        kinds = [pa.int32(), pa.bool_(), *[pa.int64()] * 7, pa.binary(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], _SCANNED)


_SCANNED = ["part", "edge", "conv", "i", "ba", "bb", "a", "b", "bytes", "digest", "first", "whole"]


def _carries(ends: list) -> dict[int, tuple[int, int, int]]:
    """What the first conversation of a partition already has before it: turns and
    their product. ends: the last row of each partition."""
    out, conv, n, f = {}, None, 0, (1, 0)
    for e in sorted(ends, key=lambda e: e.part):
        own = (e.a, e.b)
        if e.first == conv:
            out[e.part] = (n, *f)
            if e.whole:
                n, f = n + e.i, combined(f, own)
                continue
        conv, n, f = e.conv, e.i, own
    return out


def _carried(carries: dict[int, tuple[int, int, int]]):
    """Products from the start of the conversation for rows at a partition's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("part", "i", "ba", "bb", "a", "b")), strict=True)
            out = []
            for part, i, ba, bb, a, b in rows:
                n, *f = carries.get(part, (0, 1, 0))
                out.append((i + n, *combined(f, (ba, bb)), *combined(f, (a, b))))
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), *columns, batch.column("bytes"), batch.column("digest")],
                ["conv", "i", "ba", "bb", "a", "b", "bytes", "digest"],
            )

    return run


def _factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Head times the inverse of what is left out, for each conversation."""
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("ha", "hb", "la", "lb")), strict=True)
        out = [combined((ha, hb), inverse((la, lb))) for ha, hb, la, lb in rows]
        names = [n for n in batch.schema.names if n not in ("ha", "hb", "la", "lb")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), *(pa.array([f[j] for f in out], pa.int64()) for j in (0, 1))], [*names, "ma", "mb"]
        )


def _shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of rebuilt beginnings, and of those one turn shorter."""
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("ma", "mb", "ba", "bb", "a", "b")), strict=True)
        out = [(*combined((ma, mb), (a, b)), *combined((ma, mb), (ba, bb))) for ma, mb, ba, bb, a, b in rows]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("conv", "depth")),
                *(pa.array([f[j] for f in out], pa.int64()) for j in range(4)),
                *(batch.column(c) for c in ("bytes", "digest", "ends")),
            ],
            ["conv", "depth", "fa", "fb", "pa", "pb", "bytes", "digest", "ends"],
        )


def _turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, salt: int, digest: Digest) -> DataFrame:
    role, text = F.coalesce(df[role_col], F.lit("")), F.coalesce(df[text_col], F.lit(""))
    return df.filter(df[conv_col].isNotNull()).select(
        df[conv_col].cast("long").alias("conv"),
        df[turn_col].alias("turn"),
        digest(role, text, salt).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
        role.alias("role"),
        text.alias("text"),
    )


def _same_bytes(turns: DataFrame, stored: DataFrame) -> bool:
    """Whether rows with one digest have one role and text."""
    several, _ = written(stored.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest"), "shared-turns")
    both = [f(c).alias(f"{f.__name__}_{c}") for c in ("role", "text") for f in (F.min, F.max)]
    groups = turns.select("digest", "role", "text").join(several, "digest", "left_semi").groupBy("digest").agg(*both)
    return groups.filter("min_role <> max_role OR min_text <> max_text").isEmpty()


def _products(stored: DataFrame) -> DataFrame:
    """(conv, i, product before turn i, product up to it, bytes, digest)."""
    # equal rows are interchangeable; the last key lets them lie in several partitions
    salted = stored.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    keys = ["conv", "turn", "digest", "salt"]
    in_order = salted.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv", "digest", "bytes")
    scanned = in_order.mapInArrow(
        _multiplied,
        "part int, edge boolean, conv long, i long, ba long, bb long, a long, b long, bytes long, digest binary, first long, whole boolean",
    )
    scanned = materialise(scanned, "products")
    carries = _carries(scanned.filter("whole IS NOT NULL").collect())
    rows, columns = scanned.filter("whole IS NULL"), ["conv", "i", "ba", "bb", "a", "b", "bytes", "digest"]
    carried = rows.filter("edge").mapInArrow(
        _carried(carries), "conv long, i long, ba long, bb long, a long, b long, bytes long, digest binary"
    )
    return rows.filter("NOT edge").select(*columns).unionByName(carried)


def _rebuilt(products: DataFrame) -> DataFrame:
    """Every beginning of every rebuilt conversation, the empty one included: (conv,
    depth, fingerprint, that of its parent, last turn's bytes and digest, ends)."""
    h = head_turns(F.col("conv"))
    head = F.struct("i", "ba", "bb", "a", "b", "bytes", "digest")
    convs = products.groupBy("conv").agg(
        F.max("i").alias("n"),
        F.max(F.when(F.col("i") == h, F.struct("a", "b"))).alias("left"),
        F.sort_array(F.collect_list(F.when(F.col("i") < HEADS, head))).alias("heads"),
    )
    convs = materialise(convs, "conversations")
    first = convs.select(F.col("conv").alias("base"), F.col("heads").alias("base_heads"))
    named = convs.withColumns({"base": F.col("conv") - F.col("conv") % FAMILY, "h": h}).join(first, "base", "left")
    taken = named.withColumn("taken", F.coalesce(F.slice("base_heads", F.lit(1), F.col("h")), F.array().cast(dict(convs.dtypes)["heads"])))
    last = F.element_at("taken", -1)
    plan = taken.select(
        "conv", "h", F.size("taken").alias("from_head"),
        (F.size("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"),
        *[F.coalesce(F.when(F.size("taken") > 0, last[c]), F.lit(one)).cast("long").alias(f"h{c}") for c, one in (("a", 1), ("b", 0))],
        *[F.coalesce(F.col("left")[c], F.lit(one)).cast("long").alias(f"l{c}") for c, one in (("a", 1), ("b", 0))],
        "taken",
    )
    kinds = dict(plan.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in plan.columns if c not in ("ha", "hb", "la", "lb")) + ", ma long, mb long"
    plan = materialise(plan.mapInArrow(_factors, schema), "plans")
    root = plan.select(
        "conv", F.lit(0).cast("long").alias("depth"), F.lit(1).cast("long").alias("fa"), F.lit(0).cast("long").alias("fb"),
        F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"), F.lit(0).cast("long").alias("bytes"),
        F.lit(None).cast("binary").alias("digest"), (F.col("total") == 0).alias("ends"),
    )
    heads = plan.select("conv", "total", F.explode("taken").alias("t")).select(
        "conv", F.col("t.i").alias("depth"), F.col("t.a").alias("fa"), F.col("t.b").alias("fb"),
        F.col("t.ba").alias("pa"), F.col("t.bb").alias("pb"), "t.bytes", "t.digest", (F.col("t.i") == F.col("total")).alias("ends"),
    )
    own = products.join(plan.select("conv", "h", "from_head", "total", "ma", "mb"), "conv").filter("i > h")
    depth = F.col("i") - F.col("h") + F.col("from_head")
    own = own.select(
        "conv", depth.alias("depth"), "ma", "mb", "ba", "bb", "a", "b", "bytes", "digest", (depth == F.col("total")).alias("ends")
    ).mapInArrow(_shifted, "conv long, depth long, fa long, fb long, pa long, pb long, bytes long, digest binary, ends boolean")
    return materialise(root.unionByName(heads).unionByName(own), "beginnings")


def _nodes(rows: DataFrame) -> DataFrame:
    """One row per depth and fingerprint; ``same`` says that all members agree in
    parent and last turn."""
    parent = F.struct("pa", "pb")
    return rows.groupBy(*_NODE).agg(
        F.min("conv").alias("conv"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(F.col("ends").cast("long")).alias("n_ends"),
        F.max("bytes").alias("bytes"),
        F.min(parent).alias("parent"),
        (F.min(parent).eqNullSafe(F.max(parent)) & F.min("digest").eqNullSafe(F.max("digest"))).alias("same"),
    )


def _below(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """By node: leaves and savings in its subtree."""
    own = nodes.select(
        "conv", "depth", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saves"), (F.col("n_convs") == F.col("n_ends")).cast("long").alias("leaf")
    )
    marked = rows.select("conv", *_NODE).join(own, ["conv", "depth"], "left").fillna(0, ["saves", "leaf"])
    marked = marked.withColumn("block", F.floor(F.col("depth") / DEPTHS))
    rest = Window.partitionBy("conv", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("conv").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = marked.groupBy("conv", "block").agg(F.sum("saves").alias("s"), F.sum("leaf").alias("l"))
    blocks = blocks.select("conv", "block", F.sum("s").over(later).alias("s"), F.sum("l").over(later).alias("l")).filter("s > 0 OR l > 0")
    summed = marked.select("conv", "block", *_NODE, F.sum("saves").over(rest).alias("saves"), F.sum("leaf").over(rest).alias("leaf"))
    summed = summed.join(blocks, ["conv", "block"], "left")
    total = [F.sum(F.col(c) + F.coalesce(F.col(x), F.lit(0))).alias(c) for c, x in (("saves", "s"), ("leaf", "l"))]
    return summed.groupBy(*_NODE).agg(*total)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's chunks, which come one after the other."""
    node, state = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], [*_NODE, "ends_sha256"])

    for batch in batches:
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "ids")), strict=True):
            if key != node:
                if node is not None:
                    yield done()
                node, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if node is not None:
        yield done()


def _ends(rows: DataFrame) -> DataFrame:
    """By node: the digest of the ids that end there, where there are any."""
    near = F.call_function("shiftright", F.col("conv"), F.lit(ID_BITS)).alias("near")
    chunks = rows.filter("ends").groupBy(*_NODE, near).agg(F.array_join(F.sort_array(F.collect_list("conv")), ",").alias("ids"))
    chunks = materialise(chunks, "ends")
    counted = chunks.groupBy(*_NODE).agg(F.count(F.lit(1)).alias("n"), F.first("ids").alias("ids"))
    single = counted.filter("n = 1").select(*_NODE, F.sha2("ids", 256).alias("ends_sha256"))
    many, _ = written(counted.filter("n > 1").select(*_NODE), "long-ends")
    streams = chunks.join(many, _NODE, "left_semi").repartition(*_NODE).sortWithinPartitions(*_NODE, "near").select(*_NODE, "ids")
    return single.unionByName(streams.mapInArrow(_streamed, "depth long, fa long, fb long, ends_sha256 string"))


def prefix_trie(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    digest: Digest = turn_digest,
) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256."""
    for salt in range(SALTS):
        turns = _turns(df, conv_col, turn_col, role_col, text_col, salt, digest)
        stored = materialise(turns.drop("role", "text"), "turns")
        if not _same_bytes(turns, stored):
            continue
        rows = _rebuilt(_products(stored))
        nodes = materialise(_nodes(rows), "nodes")
        if nodes.filter("NOT same").isEmpty():
            break
    else:
        raise RuntimeError(f"turns that differ have equal digests with {SALTS} salts")
    up = [(F.col("depth") - 1).alias("depth"), F.col("parent.pa").alias("fa"), F.col("parent.pb").alias("fb")]
    children = nodes.filter("depth > 0").groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fa").alias("pa"), F.col("fb").alias("pb"), F.col("conv").alias("parent_conv_id"))
    out = nodes.join(_below(rows, nodes), _NODE).join(children, _NODE, "left").join(_ends(rows), _NODE, "left")
    out = out.withColumns({"pa": F.col("parent.pa"), "pb": F.col("parent.pb")}).join(parents, ["depth", "pa", "pb"], "left")
    return out.select(
        F.col("conv").alias("conv_id"),
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        F.col("leaf").alias("n_leaves"),
        F.col("saves").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(table(spark, folder, "conversations"))


_CRC = """xor(list_reduce(
      list_transform(string_split(cast(conv_id as varchar), ''), lambda x: cast(ascii(x) as bigint)),
      lambda crc, x: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::bigint[],
        lambda s, i: xor(s >> 1, 3988292384 * (s & 1)), xor(crc, x)), cast(4294967295 as bigint)), 4294967295)"""
SQL = f"""
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first,
      md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as i
  from conversations where conv_id is not null),
c as (
  select conv_id, list({{'r': role, 't': text}} order by i) as seq, {_CRC} % {HEADS} as h from t group by conv_id),
b as materialized (
  select c.conv_id, list_concat(coalesce(o.seq[1:c.h], []), coalesce(c.seq[c.h + 1:], [])) as seq
  from c left join c as o on o.conv_id = c.conv_id - c.conv_id % {FAMILY}),
m as (select conv_id, seq, unnest(range(0, len(seq) + 1)) as d from b),
n as materialized (
  select d, seq[1:d] as k, min(conv_id) as conv_id, count(*) as n_convs, count(*) filter (len(seq) = d) as n_ends,
    coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (len(seq) = d), '') as ends
  from m group by d, k),
s as (
  select a.d, a.k, count(*) filter (x.n_convs = x.n_ends) as n_leaves, count(*) filter (x.d = a.d + 1) as n_children,
    sum(if(x.d = 0, 0, (x.n_convs - 1) * strlen(x.k[x.d].t))) as saved_tokens
  from n as a join n as x on x.d >= a.d and x.k[1:a.d] = a.k group by a.d, a.k)
select n.conv_id, n.d as depth, p.conv_id as parent_conv_id, n.n_convs, s.n_children, s.n_leaves,
  cast(s.saved_tokens as bigint) as saved_tokens, sha256(n.ends) as ends_sha256
from n join s on s.d = n.d and s.k = n.k left join n as p on p.d = n.d - 1 and p.k = n.k[1:n.d - 1]
"""
