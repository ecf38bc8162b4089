"""Near-duplicates by an LSH forest.

1. Every whole text becomes its set of hashed word shingles and a MinHash signature. Documents with the same set are one class.
2. The forest: each class stands in several orders of differently chosen minima of its signature, in the bucket of those that
   share its two leading minima. Classes of a bucket whose signatures agree on most minima are tied, with a wide margin below the
   threshold; a task hands on each class with the smallest it is tied to. The depth follows the region: in a small bucket two leading
   minima are enough, and all pairs are compared; a crowded one is sorted by all its minima, so that the neighbours of a class are
   those with the longest common prefixes, and these are tied first. Then each class outside the largest group so far is compared
   with all whose sizes allow the threshold. Very crowded buckets are cut into blocks, and each two blocks meet in a task. So no cap
   on partners loses a pair that shares a bucket.
3. Classes that ties connect form a neighbourhood. It holds every document that one of its own could be linked with, so the
   exact similarity is needed inside neighbourhoods only. A small one is read once, with whole texts, and linked on full shingle
   sets. A large one is cut into blocks, each with the same few leaders, and linked block by block; leaders bring together what
   copies one text. What lies in the largest group then needs no comparison among itself; only the rest of the neighbourhood meets
   all its blocks.
4. Links, followed to their end, give the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meetlake.llm.common import ascii_lower, settle, slices, table, texts_of

#: Minima in a signature, orders of the forest, and neighbours that a crowded bucket ties first; a bucket of more rows is crowded.
MINIMA, ORDERS, NEIGHBOURS = 64, 16, 10
#: Rows of a bucket share so many leading minima.
LEAST_DEPTH = 2
#: A block of a bucket holds about so many rows.
CROWD = 20_000
#: Signatures are tied when they agree on this share of minima less than the threshold: over four standard deviations of the estimate.
MARGIN = 0.22
#: A block of a neighbourhood holds about so many shingles and rows, and so many leaders besides.
BLOCK, ROWS, LEADERS = 1_000_000, 400, 6
U64 = np.uint64


@lru_cache(1)
def constants() -> dict[str, np.ndarray]:
    draw = np.random.default_rng(20_011).integers
    odd = lambda n, kind: draw(0, 2**32, n, np.uint64).astype(kind) * kind(2) + kind(1)
    return {
        "bytes": draw(1, 2**63, 256, np.uint64),
        "spots": draw(1, 2**63, 64, np.uint64) | U64(1),
        "times": odd(MINIMA, np.uint32),
        "plus": draw(0, 2**32, MINIMA, np.uint64).astype(np.uint32),
        "orders": np.array([np.roll(np.random.default_rng(7 + t // 8).permutation(MINIMA), 8 * (t % 8)) for t in range(64)]),
    }


def powers(n: int, _held: list[np.ndarray] = []) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """The first n powers of an odd number modulo 2**64, and those of its inverse."""
    if not _held or len(_held[0]) < n:
        base = 0x9E3779B97F4A7C15
        size, inverse = max(1 << 16, 1 << (n - 1).bit_length()), pow(base, -1, 1 << 64)
        up, down = np.ones(size, U64), np.ones(size, U64)
        up[1:], down[1:] = U64(base), U64(inverse)
        _held[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _held[0][:n], _held[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def shingles(text: str, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles: A-Z lower-cased, words cut at ASCII white space; a text with
    fewer words has one, an empty one none."""
    data = np.frombuffer(ascii_lower(text), np.uint8)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.empty(0, U64)
    up, down = powers(len(data))
    sums = np.concatenate([[U64(0)], np.cumsum(constants()["bytes"][data] * up, dtype=U64)])
    word = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))
    spots = constants()["spots"]
    n = min(words, len(word))
    total = np.zeros(len(word) - n + 1, U64)
    for k in range(n):
        total += word[k : len(word) - n + 1 + k] * spots[k]
    return np.unique(mixed(total + U64(n)))


def signature(hashes: np.ndarray) -> np.ndarray:
    """MINIMA minima of a set's hashes, of 32 bits each."""
    short = (hashes >> U64(32)).astype(np.uint32)
    kept = constants()
    least = np.full(MINIMA, 2**32 - 1, np.uint32)
    for start in range(0, len(short), 4096):
        part = short[start : start + 4096, None] * kept["times"] + kept["plus"]
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(least, part.min(axis=0), out=least)
    return least


def signed(words: int):
    """doc_id, hash of the set (null: no words), its size, and of the minima all upper 16 bits and all lower 8 bits."""
    schema = pa.schema([("doc_id", pa.int64()), ("set", pa.binary()), ("n", pa.int64()), ("upper", pa.binary()), ("lower", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches, "text", 4 << 20):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                own = shingles(text, words)
                if not len(own):
                    rows.append((doc_id, None, 0, None, None))
                    continue
                least = signature(own)
                upper = (least >> np.uint32(16)).astype(">u2").tobytes()
                rows.append((doc_id, xxhash.xxh3_128_digest(own.tobytes()), len(own), upper, (least & np.uint32(255)).astype(np.uint8).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run, "doc_id long, set binary, n long, upper binary, lower binary"


class Forest:
    """Union-find over any hashable keys; the smallest key is the root."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.parent.get(x, x)
        while up != x:
            above = self.parent.get(up, up)
            self.parent[x] = above
            x, up = above, self.parent.get(above, above)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def stars(self) -> Iterator[pa.RecordBatch]:
        """Every key that isn't a root with its root: as few pairs as a spanning forest has, and the fewest rounds to follow."""
        keys = list(self.parent)
        for start in range(0, len(keys), 100_000):
            part = keys[start : start + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([self.root(x) for x in part], pa.int64())], schema=TIES)


TIES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many minima agree, row by row."""
    return (a == b).view(U64).sum(axis=-1) * U64(0x0101010101010101) >> U64(56)


def crowded(tree: int, ids: np.ndarray, sizes: np.ndarray, lower: np.ndarray, percent: int, least: float, forest: Forest) -> None:
    """Adds a crowded bucket's ties to the forest: between neighbours in the order of all minima, then of every class outside the largest group with
    all classes whose sizes allow a link (similarity is at most the ratio of sizes)."""
    deep = np.ascontiguousarray(lower[:, constants()["orders"][tree]]).view(f"S{MINIMA}").ravel()
    order = np.argsort(deep, kind="stable")
    for gap in range(1, min(NEIGHBOURS, len(ids) - 1) + 1):
        a, b = order[:-gap], order[gap:]
        at = agreeing(lower[a], lower[b]) >= least * MINIMA
        for x, y in zip(ids[a[at]].tolist(), ids[b[at]].tolist(), strict=True):
            forest.join(x, y)
    order = np.argsort(sizes, kind="stable")
    ids, sizes, lower = ids[order], sizes[order], np.ascontiguousarray(lower[order])
    begins, ends = np.searchsorted(100 * sizes, percent * sizes), np.searchsorted(percent * sizes, 100 * sizes, "right")
    roots, counts = np.unique([forest.root(x) for x in ids.tolist()], return_counts=True)
    largest = int(roots[counts.argmax()])
    for i, x in enumerate(ids.tolist()):
        if forest.root(x) != forest.root(largest):
            span = slice(begins[i], ends[i])
            at = agreeing(lower[span], lower[i]) >= least * MINIMA
            for y in ids[span][at].tolist():
                forest.join(x, y)


def tied(percent: int):
    """Ties in sorted rows (tree, bucket, pair, doc_id, n, lower): rows of the same tree, bucket and pair of blocks follow each
    other, and a task keeps one bucket's rows and a forest of its ties."""
    least = percent / 100 - MARGIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()

        def close(rows: tuple[np.ndarray, ...], starts: np.ndarray, size: np.ndarray) -> None:
            bucket, tree, ids, sizes, lower = rows
            small = np.repeat(size <= NEIGHBOURS + 1, size)
            for gap in range(1, min(NEIGHBOURS, len(ids) - 1) + 1):
                at = np.flatnonzero((bucket[:-gap] == bucket[gap:]) & small[gap:])
                at = at[agreeing(lower[at], lower[at + gap]) >= least * MINIMA]
                for x, y in zip(ids[at].tolist(), ids[at + gap].tolist(), strict=True):
                    forest.join(x, y)
            for k in np.flatnonzero(size > NEIGHBOURS + 1):
                span = slice(starts[k], starts[k] + size[k])
                crowded(int(tree[starts[k]]), ids[span], sizes[span], lower[span], percent, least, forest)

        held, last, number = None, None, 0
        for batch in batches:
            names = list(zip(batch.column("tree").to_pylist(), batch.column("bucket").to_pylist(), batch.column("pair").to_pylist(), strict=True))
            if not names:
                continue
            new = np.array([x != y for x, y in zip(names, [last, *names], strict=False)])
            bucket, last = number + np.cumsum(new), names[-1]
            number = int(bucket[-1])
            lower = np.frombuffer(b"".join(batch.column("lower").to_pylist()), np.uint8).reshape(-1, MINIMA)
            rows = (bucket, *(batch.column(x).to_numpy(zero_copy_only=False) for x in ("tree", "doc_id", "n")), lower)
            if held is not None:
                rows = tuple(np.concatenate([x, y]) for x, y in zip(held, rows, strict=True))
            done = int(np.searchsorted(rows[0], number))
            if done:
                _, starts, size = np.unique(rows[0][:done], return_index=True, return_counts=True)
                close(tuple(x[:done] for x in rows), starts, size)
            held = tuple(x[done:] for x in rows)
        if held is not None:
            close(held, np.array([0]), np.array([len(held[0])]))
        yield from forest.stars()

    return run


def components(links: DataFrame) -> DataFrame:
    """id and component (the smallest id that it reaches) of every id in the links (a, b).

    Each round points every id and its neighbours to the smallest of them, first from larger to smaller ids, then
    among the smaller ones, until nothing changes: the number of rounds grows with the logarithm of a component's size. Minima
    are taken before rows meet, so an id with very many links costs its task one row for each task before.
    """
    links = settle(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links")
    before = None
    while True:
        both = links.union(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        large = settle(large, "large")
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        small = small.select("v", "u", "m").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).union(least.select("v", F.col("m").alias("u"))).distinct()
        links = settle(small, "small")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == before:
            return links.groupBy("v").agg(F.min("u").alias("component")).withColumnRenamed("v", "id").union(links.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct())
        before = now


def linked_sets(ids: np.ndarray, sets: list[np.ndarray], percent: int, forest: Forest, rest: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Links that connect what is linked among these sets, as a spanning forest. With ``rest``, only these are asked.

    An inverted index over the sets gives one set's intersections with all others exactly, in one pass over its shingles'
    postings. First, in the order of how typical their shingles are, those sets are asked that no asked one has been linked to.
    Then all others are asked, too, but for those in the group that was the largest then. A set is asked against all. So two
    sets go uncompared only where both already are in one group.
    """
    sizes = np.array([len(x) for x in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, code = np.unique(flat, return_inverse=True)
    order = np.argsort(code, kind="stable")
    posts, begins = owner[order], np.concatenate([[0], np.cumsum(np.bincount(code))])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    common = np.diff(begins)
    typical = np.add.reduceat(common[code], ends[:-1]) / sizes
    turns = np.argsort(-typical, kind="stable").tolist()
    grouped, asked = np.zeros(len(sets), bool), np.zeros(len(sets), bool)

    def ask(i: int) -> Iterator[tuple[int, int]]:
        asked[i] = True
        own = code[ends[i] : ends[i + 1]]
        shared = own[common[own] > 1]
        if len(shared):
            spans = [posts[begins[c] : begins[c + 1]] for c in shared]
            both = np.bincount(np.concatenate(spans), minlength=len(sets))
            both[i] = 0
            for j in np.flatnonzero(100 * both >= percent * (sizes + sizes[i] - both)).tolist():
                grouped[j] = True
                if forest.join(int(ids[i]), int(ids[j])):
                    yield int(ids[i]), int(ids[j])

    if rest is not None:
        for i in np.flatnonzero(rest).tolist():
            yield from ask(i)
        return
    for i in turns:
        if not grouped[i]:
            yield from ask(i)
    roots, counts = np.unique([forest.root(int(x)) for x in ids], return_counts=True)
    largest = int(roots[counts.argmax()])
    for i in turns:
        if not asked[i] and forest.root(int(ids[i])) != forest.root(largest):
            yield from ask(i)


def linked(words: int, percent: int, again: bool = False):
    """Exact links among the rows (block, doc_id, text) of each block; a block's rows follow each other. With ``again``, rows also have
    their group so far and whether they are of the rest, and what is asked is how the rest links to other groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets, groups, rest = None, [], [], [], []

        def close() -> Iterator[pa.RecordBatch]:
            forest = Forest()
            for x, y in zip(ids, groups, strict=False):
                forest.join(x, y)
            pairs = list(linked_sets(np.array(ids), sets, percent, forest, np.array(rest) if again else None)) if len(ids) > 1 else []
            if pairs and not again:
                yield from forest.stars()
            elif pairs:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs, strict=True)], schema=TIES)

        for batch in slices(batches, "text", 4 << 20):
            more = [batch.column(x).to_pylist() for x in ("group", "rest")] if again else [[None] * batch.num_rows] * 2
            for block, doc_id, text, group, odd in zip(batch.column("block").to_pylist(), batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), *more, strict=True):
                if block != now:
                    yield from close()
                    now, ids, sets, groups, rest = block, [], [], [], []
                if ids and ids[-1] == doc_id:
                    continue  # a repeated row
                ids.append(doc_id)
                sets.append(shingles(text, words))
                if again:
                    groups.append(group)
                    rest.append(odd)
        yield from close()

    return run


def block_pairs(blocks: Column) -> Column:
    """The pairs of blocks that a row of the block ``own`` goes to, so that each two blocks meet."""
    return F.when(blocks == 1, F.array(F.lit("0"))).otherwise(
        F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.concat_ws("-", F.least(k, F.col("own")), F.greatest(k, F.col("own"))))
    )


def exact_groups(docs: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """id and component of the linked documents within neighbourhoods. members: id, component (the neighbourhood), n (shingles)."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def links(dealt: DataFrame, again: bool) -> DataFrame:
        dealt = settle(dealt, "dealt")  # its size is then known: while it is small, only its documents' texts move
        texts = docs.join(dealt, docs.doc_id == dealt.id).select("block", "doc_id", "text", *(["group", "rest"] if again else []))
        return texts.repartition(tasks, "block").sortWithinPartitions("block", "doc_id").mapInArrow(linked(words, percent, again), "a long, b long")

    def all_of(number: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), number - 1))

    totals = members.groupBy("component").agg(F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.count("*") / ROWS)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int")
    placed = settle(members.join(totals, "component").select("id", "component", "blocks", own.alias("own")), "placed")
    large = placed.where("blocks > 1")
    first = Window.partitionBy("component").orderBy(F.xxhash64("id", F.lit("leader")), "id")
    leaders = large.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= LEADERS).withColumn("at", all_of(F.col("blocks"))).where("at <> own")
    dealt = placed.select("id", "component", F.col("own").alias("at")).union(leaders.select("id", "component", "at"))
    found = settle(links(dealt.select("id", F.concat_ws(":", "component", "at").alias("block")), False), "found")
    groups = components(found)
    if large.isEmpty():
        return groups
    groups = settle(groups, "groups")
    grouped = large.join(groups.withColumnRenamed("component", "group"), "id", "left").withColumn("group", F.coalesce("group", "id"))
    sizes = grouped.groupBy("component", "group").agg(F.count("*").alias("rows"))
    main = sizes.groupBy("component").agg(F.max(F.struct("rows", "group"))["group"].alias("main"), (F.sum("rows") - F.max("rows")).alias("others"))
    grouped = settle(grouped.join(main.where("others > 0"), "component"), "grouped").withColumn("rest", F.col("group") != F.col("main"))
    if grouped.isEmpty():  # one group each
        return groups
    parts = F.ceil(F.col("others") / ROWS).cast("int")
    grouped = grouped.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id", F.lit("rest")), F.col("parts").cast("long")).cast("int"))
    name = F.concat_ws(":", "component", "i", "j").alias("block")
    every = grouped.withColumn("i", all_of(F.col("parts"))).withColumn("j", F.col("own")).where("not rest or i <> part")
    rest = grouped.where("rest").withColumn("i", F.col("part")).withColumn("j", all_of(F.col("blocks")))
    asked = every.select("id", name, "group", F.lit(False).alias("rest")).union(rest.select("id", name, "group", F.lit(True).alias("rest")))
    more = settle(links(asked, True), "more")
    return groups if more.isEmpty() else components(groups.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept (that is itself), one row per document.

    Documents are linked when 100 times the size of their shingle sets' intersection is at least ``percent`` times that of their
    union. A shingle is ``words`` successive words; a text with fewer has all its words as one; a null or empty text, or one of
    white space alone, has none and is linked with nothing. Repeated rows get the same result each; a null doc_id has a null
    component, isn't kept and links nothing. Other columns are not read. An empty table gives no rows.

    What the forest could miss: a pair that shares no bucket, i.e. no two leading minima in any order. Each order gives a pair its
    ``threshold ** 2`` chance to share one, independently for the first eight orders and nearly so for the rest.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    run, kind = signed(words)
    rows = settle(slim.mapInArrow(run, kind), "signed")
    some = rows.where("set is not null and doc_id is not null")
    classes = some.groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("upper").alias("upper"), F.first("lower").alias("lower"))
    classes = settle(classes, "classes")

    minimum = lambda i: F.substring("upper", 2 * int(i) + 1, 2)
    bucket = lambda t: F.concat(*(minimum(i) for i in constants()["orders"][t][:LEAST_DEPTH]))
    orders = F.array(*(F.struct(F.lit(t).cast("short").alias("tree"), bucket(t).alias("bucket")) for t in range(ORDERS)))
    stood = classes.select(F.explode(orders).alias("o"), "doc_id", "n", "lower").select("o.tree", "o.bucket", "doc_id", "n", "lower")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = stood.groupBy("tree", "bucket").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("blocks")).where("blocks > 1")
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks").cast("long")).cast("int")
    stood = stood.join(settle(full, "full"), ["tree", "bucket"], "left").withColumn("own", own)
    stood = stood.select("tree", "bucket", F.explode(block_pairs(F.coalesce("blocks", F.lit(1)))).alias("pair"), "doc_id", "n", "lower")
    # A bucket's pair of blocks stays in one task, so no number of partitions parts what is to be compared.
    ordered = stood.repartition(tasks, "tree", "bucket", "pair").sortWithinPartitions("tree", "bucket", "pair")
    ties = ordered.mapInArrow(tied(percent), "a long, b long")
    near = components(ties)  # neighbourhoods

    members = settle(near.join(classes.select(F.col("doc_id").alias("id"), "n"), "id").select("id", "component", "n"), "members")
    groups = exact_groups(slim, members, words, percent)

    leaders = classes.select("set", F.col("doc_id").alias("id"))
    led = leaders.join(groups, "id", "left").select("set", F.coalesce("component", "id").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.select("doc_id", "set", "n").join(led, "set", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)


def clean(docs: DataFrame) -> DataFrame:
    """One document of each group, that of the smallest doc_id, with all its columns; the pipeline's shingles take five words. Documents
    without words or doc_id stay; rows that repeat an id stay or go together; an empty table gives no rows."""
    dropped = near_duplicates(docs).where("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m.b, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id
"""
