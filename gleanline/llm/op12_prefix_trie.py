"""A trie of conversation prefixes with sums over subtrees, by heavy paths.

A node is a distinct sequence of first d turns. Its key follows from a running sum along the
conversation: each (depth, role, text) becomes 128 bits of an MD5, whose four words are summed, so
that a long conversation's keys are made in blocks on many tasks. Two prefixes meet by chance with
a probability of some n**2 / 2**129 for n nodes.

The child with the most members continues its parent's path (of equals the one with the smallest
member), so a light child has at most half of its parent's members and no node lies under more than
log2(members) light edges. A path ends in a leaf, and all of it lies in the leaf's first member: the
path is what that conversation has from its last light edge on. Subtrees are summed in rounds, from
the paths under the most light edges up: suffix sums along the path's positions give each node's
totals, and the top's total is added to the node that the path hangs on, before its round. Each
node takes part in one round, each round's table is written, and there are at most log2(members) + 1.

Edge cases: a null role or text is empty; null turns come first, equal turns go by the MD5 of role
and text; rows that repeat a turn are turns of their own; rows with a null conv_id belong to no
conversation and are left out; a conversation without turns after rebuilding counts at the root
alone; conversations of any length are dealt by blocks of positions; an empty table gives no rows
(not even a root, which has no member); further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanline.llm.common import cut, scratch
from gleanline.llm.conversations import conversations, ordered, placed, running

#: Conversations share their first turns with the first of so many; the first `crc32 % HEADS` of them.
FAMILY, HEADS = 5, 9
ROOT = "root"
#: Conversation ids that may lie in one string while they are joined.
IDS = 1024
WORDS = ["h0", "h1", "h2", "h3"]


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, d, bytes): each turn's hash of role and text, and the text's size."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    d = F.md5(F.concat_ws(":", F.octet_length(role).cast("string"), role, text).cast("binary"))
    return rows.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", d.alias("d"), F.octet_length(text).cast("long").alias("bytes"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n_turns) and (conv_id, depth, n_turns, d, bytes) of the rebuilt conversations. turns: conv_id, k, d, bytes."""
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("conv_id", "n", heads.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    lengths = own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = cut(own.join(lengths, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")))
    first = turns.filter(F.col("k") < HEADS - 1).select(F.col("conv_id").alias("base"), "k", "d", "bytes")
    head = convs.join(first, "base").filter("k < h").select("conv_id", (F.col("k") + 1).alias("depth"), "n_turns", "d", "bytes")
    tail = turns.join(convs.drop("base"), "conv_id").filter("k >= h").select("conv_id", (F.col("k") + 1 - F.col("h") + F.col("taken")).alias("depth"), "n_turns", "d", "bytes")
    return convs.select("conv_id", "n_turns"), head.unionByName(tail)


def _key(depth: Column, words: list[Column]) -> Column:
    return F.md5(F.concat_ws(",", depth, *words).cast("binary"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, last, node, parent, bytes): each conversation's nodes, without the root. turns: conv_id, depth, n_turns, d, bytes."""
    mixed = F.md5(F.concat_ws(",", "depth", "d").cast("binary"))
    words = {w: F.conv(F.substring(mixed, 8 * k + 1, 8), 16, 10).cast("long") for k, w in enumerate(WORDS)}
    rows = turns.withColumns(words | {f"own_{w}": c for w, c in words.items()}).drop("d")
    rows = running(rows, "conv_id", "depth", WORDS)
    node = _key(F.col("depth"), [F.col(w) for w in WORDS])
    parent = F.when(F.col("depth") == 1, ROOT).otherwise(_key(F.col("depth") - 1, [F.col(w) - F.col(f"own_{w}") for w in WORDS]))
    return rows.select("conv_id", "depth", (F.col("depth") == F.col("n_turns")).alias("last"), node.alias("node"), parent.alias("parent"), "bytes")


def ends(rows: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the conversations that end at a node. rows: conv_id, node.

    Ids are joined in blocks of IDS ids' width; a node of one block is hashed in place, and the blocks
    of others run through one hash in their order, a few at a time.
    """
    block = F.shiftright("conv_id", IDS.bit_length() - 1)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = cut(rows.groupBy("node", block.alias("block")).agg(joined.alias("ids")))
    per_node = blocks.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("ids").alias("ids"))
    short = per_node.filter("n = 1").select("node", F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    long = blocks.join(per_node.filter("n > 1").select("node"), "node", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, node, state = pa.schema([("node", pa.string()), ("ends_sha256", pa.string())]), None, None
        for batch in batches:
            done = []
            for name, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if name == node:
                    state.update(b"," + ids.encode())
                else:
                    if state:
                        done.append((node, state.hexdigest()))
                    node, state = name, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done, strict=True)], schema=schema)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], schema=schema)

    hashed = long.repartition("node").sortWithinPartitions("node", "block").select("node", "ids").mapInArrow(run, "node string, ends_sha256 string")
    return short.unionByName(hashed)


def subtree_sums(paths: DataFrame, names: list[str]) -> DataFrame:
    """(node, names) with each column of `names` summed over the node's subtree.

    paths: node, path, depth, light (light edges above the path), top (the path's first depth), up (at the
    top: the path that it hangs on, null at the root's), and the columns of `names`, a node's own values.
    """
    spark = paths.sparkSession
    base, out = scratch(spark, "paths"), scratch(spark, "sums")
    paths.write.partitionBy("light").parquet(base)
    levels, hung = spark.read.parquet(base).agg(F.max("light")).first()[0], None
    for light in range(levels, -1, -1):
        level = spark.read.parquet(f"{base}/light={light}")
        if hung is not None:
            level = level.join(hung, ["path", "depth"], "left").withColumns({c: F.col(c) + F.coalesce(f"add_{c}", F.lit(0)) for c in names}).drop(*(f"add_{c}" for c in names))
        running(level, "path", "depth", names, backwards=True).write.parquet(f"{out}/light={light}")
        tops = spark.read.parquet(f"{out}/light={light}").filter("depth = top AND up IS NOT NULL")
        hung = tops.groupBy(F.col("up").alias("path"), (F.col("depth") - 1).alias("depth")).agg(*(F.sum(c).alias(f"add_{c}") for c in names))
    return spark.read.parquet(out).select("node", *names)


def trie(turns: DataFrame) -> DataFrame:
    """The trie's nodes over turns (conv_id, k, d, bytes), one row each; no rows without a conversation."""
    convs, parts = rebuilt(turns)
    rows = cut(prefixes(parts))
    nodes = cut(rows.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.min("parent").alias("parent"), F.min("bytes").alias("bytes")))
    # the child with most members, of equals the one with the smallest
    children = nodes.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"), (-F.max(F.struct("n_convs", (-F.col("conv_id")).alias("c")))["c"]).alias("heavy"))
    known = cut(nodes.join(children.withColumnRenamed("parent", "node"), "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    # the root, under which most nodes may lie, is one row: its figures go into the plan instead of a join
    number = lambda x: F.lit(x).cast("long")
    whole = convs.agg(F.count(F.lit(1)), F.min("conv_id")).first()
    below_root, heavy = children.filter(F.col("parent") == ROOT).select("n_children", "heavy").first() or (0, None)
    stem = convs.groupBy().count().filter("count > 0").select(F.lit(ROOT).alias("node"), number(whole[1]).alias("conv_id"), number(0).alias("depth"), number(None).alias("parent_conv_id"), number(whole[0]).alias("n_convs"), number(below_root).alias("n_children"))
    if not whole[0]:
        return stem.select("*", number(0).alias("n_leaves"), number(0).alias("saved_tokens"), F.lit("").alias("ends_sha256"))
    above = known.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("heavy").alias("_heavy"))
    deep = known.filter("depth > 1").join(above, "parent").withColumn("light", F.col("conv_id") != F.col("_heavy")).drop("_heavy")
    shallow = known.filter("depth = 1").withColumns({"parent_conv_id": number(whole[1]), "light": F.col("conv_id") != number(heavy)})
    linked = cut(deep.unionByName(shallow))
    # a leaf's first member carries the leaf's path, which begins at its last light edge
    leaves = linked.filter("n_children = 0").select("conv_id")
    chains = rows.join(leaves, "conv_id", "left_semi").select("conv_id", "depth", "node", "parent")
    edges = chains.join(linked.filter("light").select("node"), "node", "left_semi").groupBy("conv_id").agg(F.max("depth").alias("top"), F.count(F.lit(1)).alias("light"))
    carried = chains.join(edges, "conv_id", "left").withColumns({"top": F.coalesce("top", number(0)), "light": F.coalesce("light", number(0))})
    own = linked.select("node", number(F.col("n_children") == 0).alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    paths = cut(carried.filter("depth >= top").join(own, "node").withColumnRenamed("conv_id", "path"))
    first = number((paths.filter("top = 0").select("path").first() or [whole[1]])[0])
    tops = paths.filter("depth = top").select("node", "parent")
    where = paths.select(F.col("node").alias("parent"), F.col("path").alias("up"))
    hung = tops.join(where, "parent").select("node", "up").unionByName(tops.filter(F.col("parent") == ROOT).select("node", first.alias("up")))
    trunk = stem.select("node", first.alias("path"), "depth", number(0).alias("top"), number(0).alias("light"), number(int(not below_root)).alias("n_leaves"), number(0).alias("saved_tokens"), number(None).alias("up"))
    sums = subtree_sums(paths.drop("parent").join(hung, "node", "left").unionByName(trunk), ["n_leaves", "saved_tokens"])
    last = rows.filter("last").select("node", "conv_id").unionByName(convs.filter("n_turns = 0").select(F.lit(ROOT).alias("node"), "conv_id"))
    out = linked.select(*stem.columns).unionByName(stem).join(sums, "node").join(ends(last), "node", "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = ordered(digests(conversations(spark, sf_dir)), [F.col("turn").asc_nulls_first(), F.col("d")])
    return trie(placed(turns).select("conv_id", "k", "d", "bytes")).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


_TURN = "md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || ':' || coalesce(text, ''))"
_BIT = "list_reduce(list_prepend(xor(c, b), range(8)), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda c, b: {_BIT}), 4294967295)"
#: Keys are hashes of whole prefixes here, and subtree sums go over all pairs of a node and one above it.
ORACLE = f"""WITH t AS (SELECT conv_id, {_TURN} AS d, strlen(coalesce(text, '')) AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_TURN}) AS k FROM conversations WHERE conv_id IS NOT NULL),
v AS (SELECT conv_id, list(d ORDER BY k) AS ds, list(b ORDER BY k) AS bs, {_CRC} % {HEADS} AS h FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, coalesce(o.ds[1:c.h], []) || c.ds[c.h + 1:] AS ds, coalesce(o.bs[1:c.h], []) || c.bs[c.h + 1:] AS bs FROM v c LEFT JOIN v o ON o.conv_id = c.conv_id - c.conv_id % {FAMILY}),
p AS (SELECT conv_id, d, md5(d::VARCHAR || array_to_string(ds[1:d], ',')) AS node, d = len(ds) AS last, CASE WHEN d > 0 THEN bs[d] ELSE 0 END AS b FROM (SELECT *, unnest(range(len(ds) + 1)) AS d FROM r)),
n AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, min(b) AS b, list(conv_id ORDER BY conv_id) FILTER (last) AS e FROM p GROUP BY node, d),
u AS (SELECT n.node, p.node AS parent FROM n JOIN p ON p.conv_id = n.conv_id AND p.d = n.d - 1), k AS (SELECT parent AS node, count(*) AS n_children FROM u GROUP BY parent),
s AS (SELECT p.node, sum((n.n_convs - 1) * n.b) AS saved, count(*) FILTER (k.node IS NULL) AS n_leaves FROM n LEFT JOIN k USING (node) JOIN p ON p.conv_id = n.conv_id AND p.d <= n.d GROUP BY p.node)
SELECT n.conv_id, n.d AS depth, o.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(array_to_string(n.e, ','), '')) AS ends_sha256
FROM n JOIN s USING (node) LEFT JOIN k USING (node) LEFT JOIN u ON u.node = n.node LEFT JOIN n o ON o.node = u.parent"""
