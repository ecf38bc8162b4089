"""Mixing sources to target weights by a low-discrepancy schedule.

Slots are numbered; slot i takes the fractional part of i times the golden ratio as its point, and the point falls into the source
whose share of the cumulative weights covers it. Sources thereby alternate as evenly as their weights allow in every stretch
of the mix. Slots are ranked within their source, and rank k takes the k-th block of equally many words from the source's
documents, which stand in a hashed order and start over when they are used up. A source that the points leave short of its
target gets its last blocks in slots at the end.

Everything is DataFrame expressions. Ranks and running word counts are taken in buckets, so that no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meetlake.llm.common import running_offsets, settle, table, text_col

#: Weights of the sources in order, repeating; the mix's size as a share of all words; how often a word is taken at most.
WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2
#: Words in a block, slots ranked together.
BLOCK, CHUNK = 1024, 16_384
GOLDEN = (5**0.5 - 1) / 2
WORD = r"[^\x20\x09-\x0D]+"


def golden_point(i: Column) -> Column:
    """The fractional part of (i + 1) times the golden ratio, exact enough for any i: the upper and lower 20 bits apart."""
    high, low = F.shiftright(i, 20).cast("double"), F.expr("1D") + i.bitwiseAND(F.lit((1 << 20) - 1)).cast("double")
    step = (GOLDEN * (1 << 20)) % 1.0
    x = high * F.lit(step)
    x = x - F.floor(x) + low * F.lit(GOLDEN)
    return x - F.floor(x)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """s (rank of the source by code point, null last), source, source_rows, source_size, target, want (target in whole words).

    Targets are a common level times the weight, but never above ``repeats`` times the size; the level is the one at which they
    sum to ``share`` of all words. The windows run over one row for each source.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    totals = sizes.groupBy("source").agg(F.count("*").alias("source_rows"), F.sum("size").alias("source_size"))
    ranked = totals.withColumn("s", F.row_number().over(one) - 1).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("s") % len(weights) + 1))
    ranked = ranked.withColumn("cap", F.lit(repeats) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "s")
    before, after, everything = (by_ratio.rowsBetween(*x) for x in ((Window.unboundedPreceding, -1), (0, Window.unboundedFollowing), (Window.unboundedPreceding, Window.unboundedFollowing)))
    ranked = ranked.withColumn("all", F.sum("source_size").over(everything))
    level = (F.lit(share) * F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level).withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct(F.col("ratio"), F.col("s"), F.col("level")))).over(everything)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return ranked.withColumn("target", target).withColumn("want", F.least(F.floor(F.col("target") + 0.5), F.col("cap"))).select("s", "source", "source_rows", "source_size", "target", "want")


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """s, k (rank within the source) and slot, one row for each block of each source (settled, with s and want), all slots different.

    Points fall as the weights call for. A source may get a few more of them than it has blocks, whose slots stay empty, or a few
    less; its last blocks then follow in slots behind all points, source by source.
    """
    spark = sources.sparkSession
    slots = F.ceil(F.col("want") / block)
    n, total = sources.agg(F.count("*"), F.coalesce(F.sum(slots), F.lit(0))).first()
    cells = 1024 + 4 * n  # a source's interval is found by the cell of the point
    high = F.sum(slots).over(Window.orderBy("s")) / F.lit(float(max(1, total)))
    bounds = sources.where("want > 0").select("s", (high - slots / F.lit(float(max(1, total)))).alias("low"), high.alias("high"))
    bounds = bounds.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))))
    points = spark.range(int(total)).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("x")).withColumn("cell", F.least(F.floor(F.col("x") * cells), F.lit(cells - 1)))
    dealt = points.join(settle(bounds, "bounds"), "cell").where("low <= x and x < high").select("s", "slot", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = dealt.groupBy("s", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("s", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    ranked = dealt.withColumn("own", F.row_number().over(Window.partitionBy("s", "chunk").orderBy("slot")) - 1)
    ranked = ranked.join(starts, ["s", "chunk"]).select("s", (F.col("start") + F.col("own")).alias("k"), "slot")
    blocks = sources.select("s", slots.alias("blocks"))
    short = blocks.join(counts.groupBy("s").agg(F.sum("n").alias("got")), "s", "left").withColumn("left", F.greatest(F.lit(0), F.col("blocks") - F.coalesce("got", F.lit(0))))
    behind = F.sum("left").over(Window.orderBy("s")) - F.col("left")
    short = short.withColumn("behind", behind).where("left > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("left") - 1)))
    last = short.select("s", (F.col("blocks") - F.col("left") + F.col("i")).alias("k"), (F.lit(int(total)) + F.col("behind") + F.col("i")).alias("slot"))
    return ranked.join(blocks, "s").where("k < blocks").select("s", "k", "slot").union(last)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The documents with sizes and targets, and the mix.

    Documents: row (unique), doc_id, source, size (words), s, source_size, target, want, offset (words before it in its source's
    order). Mix: slot, row, doc_id, pass, from_word, to_word: the words of documents in the order of the slots. A source's words in the mix are its target, rounded; each of its words is taken as often as any other, but
    for one more round that the target may break off. Null texts have no words; a null source is a source, the last; repeated
    rows are rows of their own; a null doc_id takes part; other columns are not read. An empty table gives an empty mix.
    """
    sizes = docs.select("doc_id", "source", F.regexp_count(text_col(), F.lit(WORD)).cast("long").alias("size"), F.xxhash64("source", "text").alias("print"))
    sizes = settle(sizes.withColumn("row", F.monotonically_increasing_id()), "sizes")
    sources = settle(source_targets(sizes, weights, share), "sources")
    own = sizes.join(sources.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    own = own.withColumn("order", F.xxhash64("doc_id", F.lit("mix"), "print"))
    placed = settle(running_offsets(own, "s", "order", "size", "source_rows", "print").drop("order"), "placed")
    passes = F.sequence(F.lit(0).cast("long"), F.floor((F.col("want") - F.col("offset") - 1) / F.col("source_size")))
    parts = placed.where("size > 0 and offset < want").withColumn("pass", F.explode(passes))
    parts = parts.withColumn("start", F.col("offset") + F.col("pass") * F.col("source_size")).withColumn("stop", F.least(F.col("start") + F.col("size"), F.col("want")))
    parts = parts.withColumn("k", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))))
    first, last = F.greatest("start", F.col("k") * block), F.least(F.col("stop"), (F.col("k") + 1) * block)
    pieces = parts.select("s", "k", "row", "doc_id", "pass", (first - F.col("start")).alias("from_word"), (last - F.col("start")).alias("to_word"))
    return placed, pieces.join(schedule(sources, block), ["s", "k"]).select("slot", "row", "doc_id", "pass", "from_word", "to_word")


def taken(docs: DataFrame) -> DataFrame:
    """The documents of mix(), with what their slots take of each: taken (words), first_slot and last_slot (null where none does), slot_sum (the
    sum of its words' slots) and passes (number and first slot of each time that it is begun, in order)."""
    placed, pieces = mix(docs)
    words = F.col("to_word") - F.col("from_word")
    begun = pieces.groupBy("row", "pass").agg(F.sum(words).alias("words"), F.min("slot").alias("slot"), F.max("slot").alias("last"), F.sum(words * F.col("slot")).alias("sum"))
    sums = begun.groupBy("row").agg(
        F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.max("last").alias("last_slot"), F.sum("sum").alias("slot_sum"), F.array_sort(F.collect_list(F.struct("pass", "slot"))).alias("passes")
    )
    return placed.join(sums, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "last_slot", "slot_sum")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix, whole, each as often as the mix takes its words, rounded, in the order of the slots in which they begin.

    All columns stay. Documents without words (null, empty or blank texts) stay once each, at the end. Of an id that repeats with other texts
    or sources each row has its own count; rows that repeat in all three are taken alike, as often as the one that is taken most. A null doc_id
    takes part; texts are counted whole; an empty table gives no rows.
    """
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    best = F.max(F.struct(times.alias("times"), F.transform("passes", lambda x: x["slot"]).alias("slots")))
    counts = taken(docs).groupBy(F.col("doc_id").alias("_id"), F.col("print").alias("_print")).agg(best.alias("_best"))
    repeated = docs.withColumn("_own", F.xxhash64("source", "text")).join(counts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_print"))).where("_best.times > 0")
    each = repeated.withColumn("_time", F.explode(F.sequence(F.lit(0), F.col("_best.times") - 1))).withColumn("_slot", F.get("_best.slots", F.col("_time")))
    return each.orderBy(F.col("_slot").asc_nulls_last(), "_id", "_own").select(*docs.columns)
