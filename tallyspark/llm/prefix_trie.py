"""Conversation prefix trie, rolled up by pointer jumping.

A node is a distinct sequence of first turns, keyed by a digest of the sequence; edges lead to the digest of the sequence without its last
turn. Leaf counts and savings are summed over subtrees by doubling: after round k each node holds the sums over its descendants at a
distance below 2^k and a pointer to its ancestor at distance 2^k, so a depth of 1,000 turns takes ten rounds. Each round is a grouped
sum by pointer and two joins, and a written table.

No conversation, node or subtree lands in one task: turns are numbered within ranges of the sorted table and within blocks of BLOCK
turns, with the counts and digests of the ranges before added to them; nodes are sums that are combined before the shuffle.

Defined results: a null role or text is empty; a row with a null conv_id names no conversation and is left out; null turns come first,
and rows that share a turn are ordered by role, then by the text's SHA-256; repeated rows are turns of their own; an empty table gives an
empty result. Other columns are ignored. ends_sha256 is by definition one SHA-256 over all ids that end at a node: their
digits, joined in blocks of ids before, meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, shuffle_partitions, table, written

#: Turns of a block; ids of a block, by their value.
BLOCK, IDS = 4096, 1024
#: A rebuilt conversation begins like the one whose id is the next lower multiple of STRIDE, for crc32(id) % HEAD turns.
STRIDE, HEAD = 100, 6
NODE = ["depth", "x1", "x2"]


def numbered(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, at (place from 0), digest (of role and text), points (code points of the text).
    The rows are sorted into ranges, and each is numbered within its range, from the count of the ranges before."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.sha2(text, 256).alias("sha"), F.length(text).cast("long").alias("points"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("sha")]
    dealt = written(rows.repartitionByRange(shuffle_partitions(turns.sparkSession), "conv_id", *order).withColumn("range", F.spark_partition_id()), "turns")
    own = Window.partitionBy("conv_id", "range").orderBy(*order)
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = (dealt.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
             .select("conv_id", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    # the length keeps role and text apart
    digest = F.sha2(F.concat_ws(":", F.length("role"), "role", "sha"), 256)
    return written(dealt.withColumn("place", F.row_number().over(own) - 1).join(bases, ["conv_id", "range"])
                   .select("conv_id", (F.col("base") + F.col("place")).alias("at"), digest.alias("digest"), "points"), "numbered")


def rebuilt(turns: DataFrame, stride: int = STRIDE, head: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv_id; their turns: conv_id, at, digest, points), each begun like the one at its multiple of stride."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % head
    base = F.col("conv_id") - F.col("conv_id") % stride
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("conv_id", h.alias("h"), base.alias("base"))
    starts = turns.where((F.col("conv_id") % stride == 0) & (F.col("at") < head - 1)).withColumnRenamed("conv_id", "base")
    first = convs.join(starts, "base").where("at < h").select("conv_id", "at", "digest", "points")
    sizes = starts.groupBy("base").agg(F.count(F.lit(1)).alias("have"))
    ids = turns.where(F.col("at") >= h).withColumns({"h": h, "base": base})
    rest = (ids.join(sizes, "base", "left")
            .select("conv_id", (F.col("at") - F.col("h") + F.least(F.col("h"), F.coalesce("have", F.lit(0)))).alias("at"), "digest", "points"))
    return convs.select("conv_id"), written(first.unionByName(rest), "rebuilt")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, x1, x2 (the prefix's digest), y1, y2 (the digest of the prefix without its last turn), points. A prefix is the xor of its
    turns' digests, each taken with its place: within a block first, then with the blocks before."""
    each = turns.withColumns({"block": F.floor(F.col("at") / BLOCK), "d1": F.xxhash64("digest", "at"), "d2": F.xxhash64("at", F.lit("2"), "digest")})
    so_far = Window.partitionBy("conv_id", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = each.groupBy("conv_id", "block").agg(F.bit_xor("d1").alias("b1"), F.bit_xor("d2").alias("b2"))
    bases = blocks.select("conv_id", "block", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(c) for c in ("b1", "b2")])
    xor = lambda a, b: F.col(a).bitwiseXOR(F.col(b))
    return (each.withColumns({"x1": F.bit_xor("d1").over(so_far), "x2": F.bit_xor("d2").over(so_far)}).join(bases, ["conv_id", "block"])
            .select("conv_id", (F.col("at") + 1).alias("depth"), xor("x1", "b1").alias("x1"), xor("x2", "b2").alias("x2"), "d1", "d2", "points")
            .withColumns({"y1": xor("x1", "d1"), "y2": xor("x2", "d2")}).drop("d1", "d2"))


def joined_ids(ends: DataFrame, by: list[str]) -> DataFrame:
    """ends(*by, conv_id) -> ids: the decimal ids of each key in numerical order, comma-joined; blocks of ids first."""
    digits = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    blocks = ends.groupBy(*by, F.floor(F.col("conv_id") / IDS).alias("block")).agg(digits.alias("digits"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("block", "digits"))), lambda x: x["digits"])
    return blocks.groupBy(*by).agg(F.array_join(listed, ",").alias("ids"))


def jumped(nodes: DataFrame, deepest: int, values: list[str]) -> DataFrame:
    """nodes(conv_id, depth, up: the parent's conv_id, null at the root; values) -> conv_id, depth and each value's sum over the subtree."""
    now = written(nodes.select("conv_id", "depth", "up", *values), "jump")
    step = 1
    while step <= deepest:
        above = F.col("depth") - step
        gained = (now.where("up is not null").groupBy(F.col("up").alias("conv_id"), above.alias("depth"))
                  .agg(*[F.sum(v).alias(f"more_{v}") for v in values]))
        # what points to the same ancestor is summed above; here each node only looks up where its ancestor points to
        pointers = now.where("up is not null").select(F.col("conv_id").alias("up"), (F.col("depth") + step).alias("depth"), F.col("up").alias("next"))
        old = now
        now = written(now.join(gained, ["conv_id", "depth"], "left").join(pointers, ["up", "depth"], "left")
                      .select("conv_id", "depth", F.col("next").alias("up"),
                              *[(F.col(v) + F.coalesce(F.col(f"more_{v}"), F.lit(0))).alias(v) for v in values]), "jump")
        discard(old)
        step *= 2
    return now


def prefix_trie(conversations: DataFrame, rebuild: bool = True) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> a row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    turns = numbered(conversations)
    convs, whole = rebuilt(turns) if rebuild else (turns.select("conv_id").distinct(), turns)
    convs = written(convs, "convs")
    paths = written(prefixes(whole), "prefixes")
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", *[zero.alias(c) for c in NODE], *[F.lit(None).cast("long").alias(c) for c in ("y1", "y2")], zero.alias("points"))
    every = paths.select(*root.columns).unionByName(root)
    members = written(every.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("y1").alias("y1"),
                                               F.min("y2").alias("y2"), F.min("points").alias("points")), "members")
    parents = members.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("y1"), F.col("x2").alias("y2"), F.col("conv_id").alias("up"))
    linked = written(members.join(parents, ["depth", "y1", "y2"], "left").drop("y1", "y2"), "linked")
    children = (linked.where("up is not null").groupBy(F.col("up").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
                .agg(F.count(F.lit(1)).alias("n_children")))
    nodes = written(linked.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", zero)), "nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    values = {"n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("points")}
    sums = jumped(nodes.withColumns(values), deepest, list(values))
    # a conversation ends at its deepest prefix
    lengths = every.groupBy("conv_id").agg(F.max_by(F.struct(*NODE), "depth").alias("last"))
    ends = joined_ids(lengths.select("conv_id", "last.*"), NODE)
    out = (nodes.join(sums.drop("up"), ["conv_id", "depth"]).join(ends, NODE, "left")
           .select("conv_id", "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                   F.sha2(F.coalesce("ids", F.lit("")), 256).alias("ends_sha256")))
    result = written(out, "trie")
    discard(turns, whole, convs, paths, members, linked, nodes, sums)
    return result


def op13_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: crc32 by the bits: eight shifts a byte.
CRC32 = """(4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, _: xor(x >> 1, 3988292384::BIGINT * (x & 1)))))"""
OP13_SQL = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, COALESCE(role, ''), sha256(COALESCE(text, ''))) - 1 AS pos,
                  COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {CRC32.format('conv_id')} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
have AS (SELECT conv_id AS base, COUNT(*) AS n FROM t GROUP BY 1),
r AS (SELECT c.conv_id, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base WHERE t.pos < c.h
      UNION ALL SELECT c.conv_id, t.pos - c.h + LEAST(c.h, COALESCE(have.n, 0)), t.role, t.text
      FROM c JOIN t USING (conv_id) LEFT JOIN have USING (base) WHERE t.pos >= c.h),
p AS (SELECT conv_id, pos + 1 AS depth, length(text) AS points,
             sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, ';') OVER (PARTITION BY conv_id ORDER BY pos)) AS node FROM r
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
q AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, max(depth) OVER (PARTITION BY conv_id) AS deepest FROM p),
n AS (SELECT node, depth, MIN(parent) AS parent, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs, MIN(points) AS points,
             COALESCE(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = deepest), '') AS ids FROM q GROUP BY node, depth),
k AS (SELECT parent AS node, COUNT(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, COALESCE(n_children, 0) AS n_children FROM n LEFT JOIN k USING (node)),
s AS (SELECT q.node, SUM(CASE WHEN m.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, SUM((m.n_convs - 1) * m.points) AS saved_tokens
      FROM m JOIN q ON q.conv_id = m.conv_id AND q.depth <= m.depth GROUP BY 1)
SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(m.ids) AS ends_sha256
FROM m JOIN s USING (node) LEFT JOIN n AS up ON up.node = m.parent"""
