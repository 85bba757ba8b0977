"""Sharding by a hierarchical weighted hash tree.

Every row descends region -> rack -> shard.  At each node every child makes a hash draw
``-ln(u(key, child)) / weight`` and the smallest draw wins, so children receive rows in
proportion to their weights and a changed weight moves rows only into or out of that child.
A node's weight is its own setting, not recomputed from below: changing one shard's weight
re-deals only the rows of its rack, changing a rack's weight only those of its region.
A shard added to a finished tree opens a region of its own with the weight of one shard, so it
takes its fair share of every other region and no other row moves.

Nulls: a null key is the text ``null``; a null text has size 8 and a null crc32.  Repeated rows
get the same shard and neighbouring slots.  An empty table gives an empty result.  Only the key,
the text and the listed result columns are used, so extra columns of any name do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Buckets per shard for numbering: the counts table has shards x SLOT_BUCKETS rows at most.
SLOT_BUCKETS = 256


@dataclass(frozen=True)
class Node:
    """A region, a rack or (without children) a shard."""

    name: str
    weight: float
    children: tuple["Node", ...] = ()
    shard: int | None = None


def grid(regions: int, racks: int, shards: int) -> tuple[Node, ...]:
    """Even tree with regions x racks x shards leaves, numbered from 0."""
    out, n = [], 0
    for r in range(regions):
        rack_nodes = []
        for k in range(racks):
            leaves = tuple(Node(f"{r}/{k}/{s}", 1.0, (), n + s) for s in range(shards))
            n += shards
            rack_nodes.append(Node(f"{r}/{k}", float(shards), leaves))
        out.append(Node(f"{r}", float(racks * shards), tuple(rack_nodes)))
    return tuple(out)


def grow(tree: tuple[Node, ...], weight: float = 1.0) -> tuple[Node, ...]:
    """One more shard, in a region of its own."""
    n, r = 1 + max(leaves(tree), default=-1), len(tree)
    leaf = Node(f"{r}/0/0", weight, (), n)
    return (*tree, Node(f"{r}", weight, (Node(f"{r}/0", weight, (leaf,)),)))


def leaves(nodes: tuple[Node, ...]) -> list[int]:
    return [x for n in nodes for x in ([n.shard] if n.shard is not None else leaves(n.children))]


def draw(key: Column, name: Column, weight: Column) -> Column:
    """-ln(u)/weight with u from the first 52 bits of md5(key:node)."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), name)), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(1 << 52)) / weight


def _children(nodes: tuple[Node, ...]) -> Column:
    live = [n for n in nodes if n.weight > 0]
    if not live or any(n.weight < 0 for n in nodes):
        raise ValueError("a tree needs children with weights of 0 or more, one above 0 at each node")
    return F.array(*(F.struct(F.lit(n.name).alias("name"), F.lit(float(n.weight)).alias("weight"),
                              F.lit(-1 if n.shard is None else n.shard).alias("shard")) for n in live))


def _winner(key: Column, children: Column) -> Column:
    return F.array_min(F.transform(children, lambda c: F.struct(
        draw(key, c["name"], c["weight"]).alias("d"), c["name"].alias("name"), c["shard"].alias("shard"))))


def descend(df: DataFrame, key: Column, tree: tuple[Node, ...], out: str) -> DataFrame:
    """Adds column ``out``: the shard of ``key``.  One projection for each of the three levels."""
    def of(nodes: tuple[Node, ...], parent: Column) -> Column:
        pairs = [x for n in nodes if n.weight > 0 for x in (F.lit(n.name), _children(n.children))]
        return F.element_at(F.create_map(*pairs), parent)

    racks = tuple(k for r in tree if r.weight > 0 for k in r.children)
    region, rack = f"__{out}_region", f"__{out}_rack"
    return (df.withColumn(region, _winner(key, _children(tree))["name"])
            .withColumn(rack, _winner(key, of(tree, F.col(region)))["name"])
            .withColumn(out, _winner(key, of(racks, F.col(rack)))["shard"].cast("int"))
            .drop(region, rack))


def assign(docs: DataFrame, tree: tuple[Node, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, grown_shard of every row.

    Slots are gapless within a shard: rows are numbered within (shard, hash bucket of the key)
    and shifted by the counts of the buckets before, so no shard is sorted in one task.  The
    counts come from a scan of the key alone; they are shards x SLOT_BUCKETS rows, hence the
    broadcast.  Only narrow rows shuffle, never texts.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    bucket = F.conv(F.substring(F.md5(F.concat(key, F.lit("#slot"))), 1, 4), 16, 10).cast("int") % SLOT_BUCKETS

    def placed(df: DataFrame) -> DataFrame:
        return descend(df, key, tree, "shard").withColumn("bucket", bucket)

    counts = placed(docs.select(id_col)).groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))

    rows = placed(docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.col(text_col)).cast("long").alias("text_crc32")))
    rows = descend(rows, key, grow(tree), "grown_shard")
    at = Window.partitionBy("shard", "bucket").orderBy(F.col(id_col), "size", "text_crc32")
    return (rows.withColumn("rank", F.row_number().over(at) - 1)
            .join(F.broadcast(starts), ["shard", "bucket"])
            .select(F.col(id_col), "size", "text_crc32", "shard",
                    (F.col("start") + F.col("rank")).cast("long").alias("slot"), "grown_shard"))
