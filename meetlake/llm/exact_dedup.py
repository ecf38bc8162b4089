"""Exact deduplication by Patricia tries.

Texts are equal when they are identical after lower-casing A-Z. Each task puts the full byte strings of its input rows into a
compressed radix trie, whose terminal nodes store the number of rows and the identifier that stays. A task thereby sends one
owner for each distinct text on, however often the text repeats: hot groups shrink before anything is shuffled, and no task holds
its rows. Owners then meet by length and content hash. A length-and-hash that only one owner has is settled; the full texts of the
others go to the partition of their length and hash, into that partition's trie, which merges equal ones byte by byte. Where very many
tasks own a text, their owners are merged in groups first.

A trie that outgrows its budget spills by subtree: the heaviest child of the root hands its terminals to the output and is
forgotten. Equal texts that come later in an input task get another owner, which the partition's trie joins to the first; there
the texts are sorted by length and hash, and a spill waits for the next of these, so it parts no group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlake.llm.common import BATCH_BYTES, ascii_lower, settle, slices, table, texts_of

#: A task's trie spills subtrees when it holds more bytes than this.
TRIE_BYTES = 96 << 20
#: Owners of one length and hash that are merged in one task.
FAN = 256
#: Bytes that a node takes besides its label.
NODE = 400


class Node:
    """A trie node: the bytes on the edge above it, its children by their first byte, and for a text that ends here its owners (the first
    stands for the text), the identifier that stays and the number of rows."""

    __slots__ = ("best", "children", "label", "n", "owners")

    def __init__(self, label: bytes):
        self.label, self.children, self.owners, self.best, self.n = label, {}, None, None, 0


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] == b[:lo], a[:hi] != b[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class Trie:
    """A compressed radix trie over byte strings."""

    def __init__(self):
        self.root, self.bytes = Node(b""), 0

    def end(self, text: bytes) -> Node:
        """The node where a text ends."""
        node, rest = self.root, text
        while rest:
            child = node.children.get(rest[0])
            if child is None:
                child = node.children[rest[0]] = Node(rest)
                self.bytes += len(rest) + NODE
                return child
            n = common(child.label, rest)
            if n < len(child.label):  # split the edge
                upper = Node(child.label[:n])
                child.label = child.label[n:]
                upper.children[child.label[0]] = child
                node.children[rest[0]] = child = upper
                self.bytes += NODE
            node, rest = child, rest[n:]
        return node

    def spill(self, limit: int) -> Iterator[tuple[bytes, Node]]:
        """Forget the heaviest subtrees below the root until no more than ``limit`` bytes are held; the texts and nodes that end there."""
        if not limit:
            if self.root.owners is not None:
                yield b"", self.root
            self.root.owners, self.root.best, self.root.n = None, None, 0
        weights = {first: sum(len(x.label) + NODE for _, x in walked(child)) for first, child in self.root.children.items()}
        for first in sorted(weights, key=lambda k: -weights[k]):
            if self.bytes <= limit:
                return
            yield from ((text, x) for text, x in walked(self.root.children.pop(first), True) if x.owners is not None)
            self.bytes -= weights[first]


def walked(top: Node, whole: bool = False) -> Iterator[tuple[bytes, Node]]:
    """All nodes of a subtree; with ``whole``, each with the bytes down to it."""
    todo = [(b"", top)]
    while todo:
        above, node = todo.pop()
        above = above + node.label if whole else above
        yield above, node
        todo.extend((above, x) for x in node.children.values())


def better(a: int | None, b: int | None, largest: bool) -> int | None:
    """Which of two identifiers stays; null never beats another."""
    if a is None or b is None:
        return b if a is None else a
    return max(a, b) if largest else min(a, b)


def typed(fields: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in fields.split(", "))])


def record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def place(text: bytes) -> tuple[int, int]:
    """A text's length and content hash."""
    return len(text), xxhash.xxh3_64_intdigest(text) - (1 << 63)


LOCAL = "row boolean, doc_id long, owner long, best long, n long, length long, hash long, sha binary, text binary"
MERGED = "child long, owner long, best long, n long, length long, hash long, text binary"


def recorded(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows, the last field of which is a text or null, in batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + len(row[-1] or b"")
        if size > BATCH_BYTES:
            yield record(held, schema)
            held, size = [], 0
    if held:
        yield record(held, schema)


def local_owners(largest: bool, budget: int):
    """A task's rows as they come, each with its owner (unique to task and text, until that is spilled), and in the end, or when they are spilled, the
    owners with the best identifier, the number of rows, and the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, number, trie = typed(LOCAL), TaskContext.get().partitionId() << 36, Trie()

        def spilled(limit: int) -> Iterator[pa.RecordBatch]:
            return recorded(((False, None, x.owners[0], x.best, x.n, *place(text), hashlib.sha256(text).digest(), text) for text, x in trie.spill(limit)), schema)

        for batch in slices(batches, "text"):
            owners = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                node = trie.end(ascii_lower(text))
                if node.owners is None:
                    node.owners, number = [number], number + 1
                node.best, node.n = better(node.best, doc_id, largest), node.n + 1
                owners.append(node.owners[0])
            none = [pa.nulls(len(owners), x) for x in schema.types[3:]]
            yield pa.RecordBatch.from_arrays([pa.array([True] * len(owners)), batch.column("doc_id").cast(pa.int64()), pa.array(owners, pa.int64()), *none], schema=schema)
            if trie.bytes > budget:
                yield from spilled(budget // 2)
        yield from spilled(0)

    return run


def merge_owners(largest: bool, budget: int, texts: bool):
    """Each owner (child) with the one that stands for its text, the best identifier and the number of rows, of rows sorted by length and
    hash; with ``texts`` the first of them has the text, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, key, trie = typed(MERGED), None, Trie()

        def spilled(limit: int) -> Iterator[pa.RecordBatch]:
            ended = ((place(text), text if texts else None, x) for text, x in trie.spill(limit))
            return recorded(((child, x.owners[0], x.best, x.n, *at, None if k else text) for at, text, x in ended for k, child in enumerate(x.owners)), schema)

        for batch in slices(batches, "text"):
            columns = [batch.column(x).to_pylist() for x in ("length", "hash", "owner", "best", "n", "text")]
            for length, digest, owner, best, n, text in zip(*columns, strict=True):
                if (length, digest) != key:
                    if trie.bytes > budget:
                        yield from spilled(budget // 2)
                    key = length, digest
                node = trie.end(text)
                if node.owners is None:
                    node.owners = []
                node.owners.append(owner)
                trie.bytes += 40
                node.best, node.n = better(node.best, best, largest), node.n + n
        yield from spilled(0)

    return run


def exact_duplicates(docs: DataFrame, keep: str = "smallest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id (the row of its group that stays), group_size, kept, text_sha256.

    keep: "smallest" or "largest" doc_id stays. Null texts count as empty ones, so null and empty texts form one group. Of
    repeated rows (same id, same text) each counts in group_size and each is returned, kept alike; a repeated id with different
    texts belongs to a group by each text. A null doc_id is kept only where its group has no other. Other columns, whatever
    their names, are not read. An empty table gives no rows. Very long texts are one edge of a trie each.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    largest, key = keep == "largest", ["length", "hash"]
    local = settle(docs.select("doc_id", "text").mapInArrow(local_owners(largest, trie_bytes), LOCAL), "owners")
    owners = local.where("not row").select("owner", "best", "n", "sha", *key)
    met = settle(owners.groupBy(*key).agg(F.count("*").alias("owners")).where("owners > 1"), "met")
    # Only texts whose length and hash another task has seen, too, move: each to the partition of its length and hash.
    again = local.where("not row").select("owner", "best", "n", "text", *key).join(met, key)

    def merged(rows: DataFrame, texts: bool, *salt: str) -> DataFrame:
        return rows.repartition(*key, *salt).sortWithinPartitions(*key, *salt).mapInArrow(merge_owners(largest, trie_bytes, texts), MERGED)

    if met.where(F.col("owners") > FAN).isEmpty():
        found = merged(again, False).select("child", "best", "n")
    else:
        salt = F.pmod(F.xxhash64("owner"), F.ceil(F.col("owners") / FAN))
        first = settle(merged(again.where(F.col("owners") > FAN).withColumn("salt", salt), True, "salt"), "first")
        fewer = first.where("child = owner").select("owner", "best", "n", "text", *key)
        last = settle(merged(again.where(F.col("owners") <= FAN).select(*fewer.columns).unionByName(fewer), False).select("child", "best", "n"), "last")
        through = first.where("child <> owner").select("child", "owner").join(last.withColumnRenamed("child", "owner"), "owner")
        found = last.unionByName(through.select("child", "best", "n"))
    found = found.select(F.col("child").alias("owner"), F.col("best").alias("_best"), F.col("n").alias("_n"))
    facts = owners.join(found, "owner", "left").select("owner", F.coalesce("_best", "best").alias("keep_id"), F.coalesce("_n", "n").alias("group_size"), F.lower(F.hex("sha")).alias("text_sha256"))
    rows = local.where("row").select("doc_id", "owner").join(facts, "owner")
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def clean(docs: DataFrame) -> DataFrame:
    """One row of each group, with all its columns: that of the smallest doc_id. Of repeated rows one stays; a null doc_id stays only
    where its group has no other. Null and empty texts are one group; texts are compared whole, however long; an empty table gives no rows."""
    found = exact_duplicates(docs)
    dropped = found.where("not kept and doc_id is not null").select("doc_id").distinct()
    left = docs.join(dropped, "doc_id", "left_anti")
    # Rows that repeat an id, or have none, are told apart by their text.
    odd = found.where("kept or doc_id is null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id")
    odd = settle(odd, "odd")
    if odd.isEmpty():
        return left
    again = left.join(odd.withColumnRenamed("doc_id", "_odd"), F.col("doc_id").eqNullSafe(F.col("_odd"))).drop("_odd")
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = found.where("keep_id is not null").select(F.col("text_sha256").alias("_sha"), F.col("keep_id").alias("_keep")).distinct()
    again = again.withColumn("_sha", F.sha2(lower, 256)).join(groups, "_sha", "left").where("_keep is null or _keep = doc_id")
    return left.join(odd.withColumnRenamed("doc_id", "_odd"), F.col("doc_id").eqNullSafe(F.col("_odd")), "left_anti").unionByName(again.dropDuplicates(["_sha"]).drop("_sha", "_keep"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
