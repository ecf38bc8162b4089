"""Sharding by a hierarchical tree of weighted hash draws.

Each document descends from the root over regions and racks to a shard. At every node it reaches, each child draws an exponential
variable from the hash of doc_id and the child's name, with the weight below the child as its rate, and the child with the smallest
draw is taken: in proportion to its weight. A node's weight is the sum of its shards' as built. So a change of weights moves
documents only between the subtrees that it touches and their siblings, and what stays in a subtree whose weights are the same
stays at its place there.

A shard that is added to a tree as built hangs at the root with its own weight, next to the regions. All other draws stay as they were,
so it takes documents only into itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlake.llm.common import running_offsets, settle, table

SHARDS = 24
#: Shards of a rack, racks of a region, in the default tree.
RACK, REGION = 2, 4

#: Regions of racks of shards with their weights; at the root also shards by themselves, that were added later.
Tree = dict[int | str, dict[int, dict[int, float]] | float]


def default_tree(shards: int) -> Tree:
    """Regions of racks of shards with weight 1, filled in order."""
    tree: Tree = {}
    for shard in range(shards):
        rack = shard // RACK
        tree.setdefault(rack // REGION, {}).setdefault(rack, {})[shard] = 1.0
    return tree


def grown(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard, at the root."""
    return tree | {f"+{shard}": weight}


def weight_of(node: dict | float) -> float:
    return sum(map(weight_of, node.values())) if isinstance(node, dict) else max(0.0, float(node))


def nodes_of(tree: Tree) -> list[dict]:
    """The tree's nodes, the root first: name, weight, children (their numbers), and region, rack and shard as far as they are fixed."""
    found: list[dict] = []

    def add(name: str, node: dict | float, way: tuple[int | None, ...]) -> int:
        own = {"name": name, "weight": weight_of(node), "children": [], "way": way}
        found.append(own)
        number = len(found) - 1
        if isinstance(node, dict):
            for key, child in sorted(node.items(), key=lambda x: (isinstance(x[0], str), x[0])):
                if weight_of(child) > 0:
                    added = isinstance(key, str)
                    own["children"].append(add(f"{name}/{key}", child, (None, None, int(key[1:])) if added else (*way, key)))
        return number

    add("", tree, ())
    return found


def assigned(docs: DataFrame, tree: Tree, region: str, rack: str, shard: str) -> DataFrame:
    """Add the three columns; region and rack are null for a shard at the root. A null doc_id is a key like any other. Ties (of equal hashes)
    go to the smaller numbers. Shards without weight get nothing."""
    nodes = nodes_of(tree)
    children = F.array(*(F.array(*(F.struct(F.lit(k).alias("node"), F.lit(nodes[k]["name"]).alias("name"), F.lit(nodes[k]["weight"]).alias("weight")) for k in x["children"])) if x["children"]
                         else F.expr("CAST(array() AS array<struct<node:int,name:string,weight:double>>)") for x in nodes))
    uniform = lambda name: (F.xxhash64("doc_id", F.lit("shard"), name).cast("double") + F.lit(2.0**63 + 1)) / F.lit(2.0**64 + 2048)
    at = F.lit(0)
    for level in range(3):
        own = F.get(children, at)
        drawn = F.array_min(F.transform(own, lambda x: F.struct((-F.log(uniform(x["name"])) / x["weight"]).alias("draw"), x["node"].alias("node"))))["node"]
        docs = docs.withColumn(f"_{level}", F.coalesce(drawn, at))  # a shard has no children
        at = F.col(f"_{level}")
    ways = [([None, None, None] if len(x["way"]) < 3 else list(x["way"])) for x in nodes]
    for name, k in ((region, 0), (rack, 1), (shard, 2)):
        docs = docs.withColumn(name, F.get(F.array(*(F.lit(w[k]).cast("int") for w in ways)), at))
    return docs.drop("_0", "_1", "_2")


def sharded(docs: DataFrame, tree: Tree, later: Tree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, region, rack, shard, slot (from 0 in each shard without gaps) and grown_shard, one row per document.

    The law is "key": the doc_id and the tree decide alone, so copies of a text go where their ids send them. grown_shard is the shard in the
    tree ``later`` (null: none given). size is the text's bytes in UTF-8 plus 8; a null text has no bytes. Repeated rows share their shard
    and have slots of their own, in an order that their texts' checksums decide. Very long texts are rows like any other. Other columns are
    not read; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = settle(assigned(rows, tree, "region", "rack", "shard"), "shards")
    counts = settle(rows.groupBy("shard").agg(F.count("*").alias("shard_rows")), "counts")
    rows = rows.join(counts, "shard").withColumn("order", F.xxhash64("doc_id", F.lit("slot"), "text_crc32")).withColumn("one", F.lit(1).cast("long"))
    rows = running_offsets(rows, "shard", "order", "one", "shard_rows", "size", "text_crc32").withColumnRenamed("offset", "slot")
    if later is None:
        return rows.withColumn("grown_shard", F.lit(None).cast("int"))
    return assigned(rows, later, "grown_region", "grown_rack", "grown_shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = default_tree(SHARDS)
    rows = sharded(table(spark, sf_dir, "documents"), tree, grown(tree, SHARDS))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard", "region", "rack")
