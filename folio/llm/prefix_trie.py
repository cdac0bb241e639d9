"""Prefix trie of conversations: which openings are shared, and what sharing them saves.

Method: Spark SQL ROLLUP over positional turn-id columns.  A conversation is a row with the ids of its first ``WIDTH`` turns
in columns of their own; one ROLLUP over these aggregates all its prefixes together, and grouping_id tells how deep a
group is.  Conversations that go on continue in further blocks of columns, keyed by the node that the block before ended in.  A
second ROLLUP over the nodes, from the last block to the first, adds up what lies below each.

Only conversations that share a node with others go on to a further block.  Below a node whose members are all one sequence
(a single conversation, or copies) there is one path, whose nodes follow from the positions of its turns, so neither a long
conversation nor a group of long copies adds rounds; what does is the depth down to which different conversations agree.

Turns are known by 128 bits of a digest of role and text; texts are read once and never moved.  A conversation may hold any
share of the rows: turns are numbered by a range sort over all conversations, not in one group.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import ORACLES, register, released, table, tasks
from folio.operators.ordering import with_running
from folio.session import materialise

WIDTH = 4
SHARED = 5  # most turns taken over from another conversation
FAMILY = 100
LIST_IDS = 1024


def turn_id(role: str = "role", text: str = "text") -> Column:
    """16 bytes that stand for a turn; null role and text count as empty."""
    r, t = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    whole = F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t)
    return F.substring(F.unhex(F.sha2(F.encode(whole, "UTF-8"), 256)), 1, 16)


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, tid, points, part, at) for each turn and (conv_id, part, first, before, length) for each stretch it lies in.

    ``turns`` has conv_id, turn, role, text.  Turns are ordered by ``turn``, null first, those of one ``turn`` by their digest.
    ``at`` rises along ``part``, one stretch of the sort, from ``first`` on; ``before`` turns of the conversation lie in earlier
    stretches, so a turn's place is at - first + before + 1.
    """
    n = tasks(turns.sparkSession)
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), turn_id().alias("tid"),
        F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("points"), F.monotonically_increasing_id().alias("row"))
    keys = ["conv_id", F.col("turn").asc_nulls_first(), "tid", "row"]  # the row's number only parts repeated rows
    dealt = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    placed = materialise(dealt.select("conv_id", "tid", "points", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    pieces = placed.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    by_conv = Window.partitionBy("conv_id")  # a row for each stretch that has the conversation
    pieces = materialise(pieces.select(
        "conv_id", "part", "first", F.coalesce(F.sum("n").over(by_conv.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(by_conv).alias("length")))
    return placed, pieces


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that open with turns of the first of their hundred: (conv_id, pos, tid, points) and (conv_id, length).

    Conversation ``c`` takes the first ``h`` turns of ``c - c % 100``, all if it has fewer, none if it is absent, and goes on with
    its own turns after its first ``h``; ``h`` is crc32 of the decimal ``c``, modulo 6.  Every conversation has a length, even zero.
    """
    placed, pieces = numbered(turns)
    own = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED + 1)
    convs = pieces.groupBy("conv_id").agg(F.max("length").alias("length")).withColumns({"h": own, "base": F.col("conv_id") - F.col("conv_id") % FAMILY})
    heads = convs.where(F.col("conv_id") == F.col("base")).select("base", F.col("length").alias("had"))
    convs = convs.join(heads, "base", "left").withColumn("taken", F.least("h", F.coalesce("had", F.lit(0))))
    convs = materialise(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("length")))
    pieces = pieces.drop("length").join(convs.select("conv_id", "h", "taken"), "conv_id")
    at = placed.join(pieces, ["conv_id", "part"]).withColumn("pos", F.col("at") - F.col("first") + F.col("before") + 1)
    kept = at.where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "tid", "points")
    opening = at.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") <= SHARED)).select(F.col("conv_id").alias("base"), "pos", "tid", "points")
    given = opening.join(convs.select("conv_id", "base", "taken"), "base").where("pos <= taken").select("conv_id", "pos", "tid", "points")
    return materialise(kept.unionByName(given)), convs.select("conv_id", "length")


def blocks_of(rows: DataFrame, width: int) -> DataFrame:
    """(conv_id, block, t1 .., p1 .., d1, d2): ``width`` turns a row, ids and code points, and a digest of the row's place and ids."""
    at = F.pmod(F.col("pos") - 1, F.lit(width))
    pick = lambda i, c: F.max(F.when(at == i, F.col(c)))
    wide = rows.groupBy("conv_id", F.floor((F.col("pos") - 1) / width).alias("block")).agg(
        *[pick(i, "tid").alias(f"t{i + 1}") for i in range(width)], *[pick(i, "points").alias(f"p{i + 1}") for i in range(width)])
    seen = F.sha2(F.concat(F.encode(F.concat(F.col("block").cast("string"), F.lit(":")), "UTF-8"), *[F.coalesce(f"t{i + 1}", F.lit(b"")) for i in range(width)]), 256)
    half = lambda i: F.conv(F.substring(seen, 16 * i + 1, 16), 16, -10).cast("bigint")
    return wide.withColumns({"d1": half(0), "d2": half(1)})


def list_hashes(members: DataFrame) -> DataFrame:
    """(ender, length, ends_sha256): the digest of the comma-joined ids of each group, ascending; ``members`` has also conv_id.

    A group may be of any size: its ids are sorted over all tasks, each task joins its stretch to pieces of ``LIST_IDS`` ids, and
    only these pieces, a thousandth of the rows, meet in one task, which streams them through the digest.
    """
    n = tasks(members.sparkSession)
    keys = ["length", "ender", "conv_id"]
    schema = pa.schema([("ender", pa.int64()), ("length", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])

    def joined(batches):
        key, ids = None, []
        piece = lambda: (*key, ids[0], ",".join(map(str, ids)))
        for b in batches:
            out = []
            for e, d, c in zip(*(b.column(x).to_pylist() for x in ("ender", "length", "conv_id")), strict=True):
                if ids and (key != (e, d) or len(ids) >= LIST_IDS):
                    out.append(piece())
                    ids = []
                key = (e, d)
                ids.append(c)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(piece(), schema, strict=True)], schema=schema)

    def hashed(batches):
        key, digest = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([digest.hexdigest()])], names=["ender", "length", "ends_sha256"])
        for b in batches:
            for e, d, ids in zip(*(b.column(x).to_pylist() for x in ("ender", "length", "ids")), strict=True):
                if key == (e, d):
                    digest.update(b"," + ids.encode())
                    continue
                if key is not None:
                    yield row()
                key, digest = (e, d), hashlib.sha256(ids.encode())
        if key is not None:
            yield row()

    pieces = members.select(keys).repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(lambda b: released(joined(b)), "ender bigint, length bigint, first bigint, ids string")
    dealt = pieces.repartition(n, "length", "ender").sortWithinPartitions("length", "ender", "first")
    return dealt.mapInArrow(lambda b: released(hashed(b)), "ender bigint, length bigint, ends_sha256 string")


def _rolled(rows: DataFrame, width: int, aggregates: list[str]) -> DataFrame:
    """ROLLUP over t1 .. of each ``node``: ``level`` (0 to ``width``), ``path`` (the ids down to it, end to end) and the aggregates.

    Groups that only repeat a shorter one, because their last id is null, are left out.
    """
    ids = [f"t{i + 1}" for i in range(width)]
    columns = ", ".join(ids)
    got = rows.sparkSession.sql(
        f"SELECT node, {columns}, {width} - bit_count(grouping_id()) AS level, {', '.join(aggregates)} FROM {{rows}} GROUP BY node, ROLLUP({columns})", rows=rows)
    last = F.coalesce(*[F.when(F.col("level") == i + 1, F.col(ids[i]).isNotNull()) for i in range(width)], F.lit(True))
    path = F.concat(*[F.coalesce(c, F.lit(b"")) for c in ids])
    return got.where(last).withColumn("path", path).drop(*ids)


def _at_level(name: str, width: int, first: int = 0) -> Column:
    """Of columns ``name``0 .. ``name``<width> the one of the row's level (shifted by ``first``), zero beyond."""
    return F.coalesce(*[F.when(F.col("level") + first == i, F.col(f"{name}{i}")) for i in range(width + 1)], F.lit(0))


def trie(rows: DataFrame, convs: DataFrame, *, width: int = WIDTH) -> DataFrame:
    """The nodes of the trie of ``rows`` (conv_id, pos, tid, points) over conversations ``convs`` (conv_id, length).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.  The root has depth
    0 and no parent.  No conversations give no rows, not even the root.
    """
    spark = rows.sparkSession
    wide = materialise(blocks_of(rows, width))
    sums = wide.groupBy("conv_id").agg(F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2"))
    zero = F.lit(0).cast("bigint")
    known = materialise(convs.join(sums, "conv_id", "left").select("conv_id", "length", F.coalesce("d1", zero).alias("d1"), F.coalesce("d2", zero).alias("d2")))
    columns = [*[f"t{i + 1}" for i in range(width)], *[f"p{i + 1}" for i in range(width)]]
    block = lambda k: wide.where(F.col("block") == k).select("conv_id", *columns)

    # equal sequences: who is first among them, and the ids of groups of two or more
    same = known.groupBy("length", "d1", "d2").agg(F.min("conv_id").alias("ender"), F.count(F.lit(1)).alias("n")).where("n > 1")
    hashes = list_hashes(known.join(same, ["length", "d1", "d2"]).select("ender", "length", "conv_id"))

    def forward(members: DataFrame, k: int) -> DataFrame:
        """Nodes of block ``k``: level 0 is the node the block hangs on."""
        ends_at = lambda i: f"length = {k * width + i}"
        got = _rolled(members, width, [
            "min(conv_id) AS conv_id", "count(*) AS n_convs", "max(length) AS longest", "min(d1) = max(d1) AND min(d2) = max(d2) AS one",
            *[f"count_if({ends_at(i)}) AS e{i}" for i in range(width + 1)], *[f"min(conv_id) FILTER (WHERE {ends_at(i)}) AS f{i}" for i in range(width + 1)],
            *[f"max(p{i + 1}) AS p{i + 1}" for i in range(width)]])
        points = F.coalesce(*[F.when(F.col("level") == i + 1, F.col(f"p{i + 1}")) for i in range(width)], zero)
        ender = F.coalesce(*[F.when(F.col("level") == i, F.col(f"f{i}")) for i in range(width + 1)])
        return got.select("node", "level", "path", "conv_id", "n_convs", "longest", "one", points.alias("points"), _at_level("e", width).alias("n_ends"), ender.alias("ender"))

    members = known.join(block(0), "conv_id", "left").withColumn("node", zero)
    levels, k = [], 0
    while True:
        nodes = materialise(forward(members, k))
        levels.append(nodes)
        deep = nodes.where((F.col("level") == width) & (F.col("longest") > (k + 1) * width) & ~F.col("one")).select("node", "path", F.col("conv_id").alias("next"))
        if deep.isEmpty():
            break
        path = F.concat(*[F.coalesce(f"t{i + 1}", F.lit(b"")) for i in range(width)])
        on = members.withColumn("path", path).join(deep, ["node", "path"]).select("conv_id", "length", "d1", "d2", F.col("next").alias("node"))
        on = on.where(F.col("length") > (k + 1) * width)
        k += 1
        members = materialise(on.join(block(k), "conv_id"))

    # paths below nodes of one sequence: a row for each further turn of their first conversation
    tails = [n.where((F.col("level") == width) & F.col("one") & (F.col("longest") > (i + 1) * width)).select("conv_id", "n_convs", F.col("longest").alias("length"), F.lit((i + 1) * width).cast("bigint").alias("from")) for i, n in enumerate(levels)]
    tails = materialise(_union(tails))
    turns = rows.select("conv_id", "pos", "points").join(tails, "conv_id").where(F.col("pos") > F.col("from"))
    single = turns.where("n_convs = 1").withColumn("rest", zero)
    copies = with_running(turns.where("n_convs > 1"), "conv_id", "pos", F.col("points"), "sum", "after", following=True, inclusive=True)
    copies = materialise(copies.withColumn("rest", F.col("after")).drop("after"))
    below_tail = copies.groupBy("conv_id").agg(F.max(F.col("rest") * (F.col("n_convs") - 1)).alias("tail_saved"))
    told = single.unionByName(copies).select(
        "conv_id", F.col("pos").alias("depth"), F.col("conv_id").alias("parent_conv_id"), "n_convs",
        (F.col("pos") < F.col("length")).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("rest")).alias("saved_tokens"),
        F.when(F.col("pos") == F.col("length"), F.col("conv_id")).alias("ender"), F.when(F.col("pos") == F.col("length"), F.col("n_convs")).otherwise(0).alias("n_ends"))

    # from the last block up: what lies below each node
    done, below = [], None
    for k in range(len(levels) - 1, -1, -1):
        nodes = levels[k]
        if below is None:
            none = F.lit(None).cast("bigint")
            hang = nodes.select("*", none.alias("b_children"), none.alias("b_leaves"), none.alias("b_saved"))
        else:
            hung = below.select(F.col("node").alias("conv_id"), F.lit(width).alias("level"), "b_children", "b_leaves", "b_saved")
            hang = nodes.join(hung, ["conv_id", "level"], "left")
        tail = tails.where(F.col("from") == (k + 1) * width).join(below_tail, "conv_id", "left").select(
            "conv_id", F.lit(width).alias("level"), F.lit(1).cast("bigint").alias("tail"), F.coalesce("tail_saved", zero).alias("tail_saved"))
        hang = hang.join(tail, ["conv_id", "level"], "left")
        hang = materialise(hang.select(
            "node", "level", "path", "conv_id", "n_convs", "points", "n_ends", "ender",
            F.coalesce("b_children", "tail", zero).alias("b_children"), F.coalesce("b_leaves", "tail", zero).alias("b_leaves"), F.coalesce("b_saved", "tail_saved", zero).alias("b_saved")))
        # every node with its path in columns: an inner node's children are the rows one level down in its group
        inner = hang if k == 0 else hang.where("level > 0")
        cut = [F.when(F.col("level") > i, F.substring("path", 16 * i + 1, 16)).alias(f"t{i + 1}") for i in range(width)]
        counted = inner.select("node", F.col("level").alias("at"), *cut, "b_children", "b_leaves", "b_saved", ((F.col("n_convs") - 1) * F.col("points")).alias("own"))
        totals = _rolled(counted, width, [*[f"count_if(at = {i}) AS c{i}" for i in range(width + 1)], "sum(b_leaves) AS leaves", "sum(b_saved + own) AS saved"])
        totals = totals.select("node", "level", "path", _at_level("c", width, 1).alias("direct"), "leaves", "saved")
        raised = materialise(hang.join(totals, ["node", "level", "path"]).withColumn("n_children", F.col("direct") + F.col("b_children")))
        # a node without children is a leaf; leaves are counted once more, now that children are known
        leaf = raised.where("n_children = 0 and level > 0" if k else "n_children = 0").select("node", *cut)
        leaves = _rolled(leaf, width, ["count(*) AS own_leaves"])
        whole = materialise(raised.join(leaves, ["node", "level", "path"], "left").select(
            "node", "level", "path", "conv_id", "n_convs", "n_ends", "ender", "n_children", (F.col("leaves") + F.coalesce("own_leaves", zero)).alias("n_leaves"), F.col("saved").alias("saved_tokens")))
        below = whole.where("level = 0").select("node", F.col("n_children").alias("b_children"), F.col("n_leaves").alias("b_leaves"), F.col("saved_tokens").alias("b_saved"))
        named = whole if k == 0 else whole.where("level > 0")
        up = named.where("n_children > 0 and level > 0").select("node", (F.col("level") + 1).alias("level"), F.col("path").alias("above"), F.col("conv_id").alias("parent"))
        above = F.when(F.col("level") > 1, F.substring("path", F.lit(1), 16 * (F.col("level") - 1)))
        linked = named.withColumn("above", above).join(up, ["node", "level", "above"], "left")
        top = F.when(F.col("level") == 1, F.col("node")) if k else F.when(F.col("level") == 1, F.lit(-1).cast("bigint"))
        done.append(linked.select(
            "conv_id", (F.col("level") + k * width).cast("bigint").alias("depth"), F.coalesce("parent", top).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ender", "n_ends"))
    root = done.pop()
    smallest = known.agg(F.min("conv_id").alias("smallest")).first()["smallest"]
    root = root.withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(smallest).cast("bigint")).otherwise(F.col("parent_conv_id")))
    nodes = _union([*done, root, told])
    got = nodes.join(hashes.select("ender", F.col("length").alias("depth"), F.col("ends_sha256").alias("many")), ["ender", "depth"], "left")
    one = F.when(F.col("n_ends") == 1, F.sha2(F.col("ender").cast("string").cast("binary"), 256))
    return got.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("many", one, F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def conversation_trie(turns: DataFrame, *, width: int = WIDTH) -> DataFrame:
    """The trie (see :func:`trie`) of the conversations of ``turns`` (conv_id, turn, role, text), rebuilt as :func:`rebuilt` says.

    A null ``turn`` comes first; turns of one ``turn``, repeated rows among them, are ordered by the digest of role and text.  A null
    role or text is empty.  Rows without ``conv_id`` belong to no conversation and play no part, nor do other columns.  A text may be
    of any length.  An empty table gives no rows.
    """
    return trie(*rebuilt(turns), width=width)


@register
def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    """The trie of all conversations."""
    return conversation_trie(table(spark, sf, "conversations"))


ORACLES["op12_prefix_trie"] = """
WITH ids AS MATERIALIZED (
  SELECT conv_id AS c, conv_id - conv_id % 100 AS base,
         xor(4294967295, list_reduce(list_concat([4294967295], flatten([[ord(x), -1, -1, -1, -1, -1, -1, -1, -1] for x in string_split(CAST(conv_id AS VARCHAR), '')])),
           lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
),
turns AS MATERIALIZED (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, tid) AS pos, tid, points
  FROM (SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS tid, length(coalesce(text, '')) AS points
        FROM conversations WHERE conv_id IS NOT NULL)
),
seq AS MATERIALIZED (
  SELECT i.c, row_number() OVER (PARTITION BY i.c ORDER BY t.c <> i.base OR t.pos > i.h, t.pos) AS pos, t.tid, t.points
  FROM ids i JOIN turns t ON (t.c = i.base AND t.pos <= i.h) OR (t.c = i.c AND t.pos > i.h)
),
paths AS MATERIALIZED (
  SELECT c, 0 AS depth, '' AS path, '' AS above, 0 AS points FROM ids
  UNION ALL
  SELECT c, pos, string_agg(tid, '') OVER w, coalesce(string_agg(tid, '') OVER (PARTITION BY c ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), points
  FROM seq WINDOW w AS (PARTITION BY c ORDER BY pos)
),
len AS (SELECT c, max(depth) AS length FROM paths GROUP BY c),
nodes AS MATERIALIZED (
  SELECT path, any_value(above) AS above, p.depth, min(p.c) AS conv_id, count(*) AS n_convs, max(points) AS points,
         sha256(coalesce(string_agg(CASE WHEN p.depth = length THEN CAST(p.c AS VARCHAR) END, ',' ORDER BY p.c), '')) AS ends_sha256
  FROM paths p JOIN len USING (c) GROUP BY path, p.depth
),
kids AS (SELECT above AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY above),
full_nodes AS MATERIALIZED (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (path)),
sums AS (
  SELECT a.path, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.points) AS saved_tokens
  FROM full_nodes a JOIN full_nodes b ON b.depth >= a.depth AND a.path = b.path[1:64 * a.depth] GROUP BY a.path
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s USING (path) LEFT JOIN full_nodes p ON n.depth > 0 AND p.path = n.above
"""
