r"""Importance resampling towards a target distribution, by hashed n-grams.

A document's features are its runs of consecutive words; each falls into one of ``BUCKETS`` by the CRC-32 of its bytes. The buckets'
counts in the target and in all documents give a gain for each bucket, a document's weight is the floored mean of its features'
gains, and a Gumbel variable from the digest of its id turns the weights into a draw without replacement: the highest scores win.

CRCs are taken in matrices: the distinct features of a batch are grouped by their number of bytes, each group is a two-dimensional
array of bytes, and one step for each column updates the CRCs of all its rows. Buckets are then scattered back to the features'
places. Longer features are cut into rows of ``PIECE`` bytes first, whose CRCs a linear shift joins.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meetlake.llm.common import ascii_lower, settle, slices, table, texts_of

#: Buckets of features; the longest run of words; the seed of the draws; percent of the documents drawn, and the words that they need.
BUCKETS, WORDS, SEED, PERCENT, LEAST = 10_000, 1, 2024, 10, 20
#: Longer features are cut into rows of so many bytes.
PIECE = 256
#: In UTF-8: every byte of a character outside ASCII belongs to a word.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@lru_cache(1)
def steps() -> np.ndarray:
    """What a byte adds to a CRC-32: the remainders of all bytes by the reflected polynomial."""
    found = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        found = np.where(found & 1, np.uint32(0xEDB88320) ^ (found >> 1), found >> 1).astype(np.uint32)
    return found


def columns(rows: np.ndarray, states: np.ndarray) -> np.ndarray:
    """The states after the bytes of their rows, column by column."""
    for column in rows.T:
        states = steps()[(states ^ column) & 0xFF] ^ (states >> 8)
    return states


@lru_cache(1)
def shifts() -> np.ndarray:
    """What each value of each of a state's four bytes becomes after PIECE bytes of zero; the states' bytes add up by exclusive or."""
    states = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
    return columns(np.zeros((1024, PIECE), np.uint8), states).reshape(4, 256)


def crcs(features: list[bytes]) -> np.ndarray:
    """The CRC-32 of each feature, as zlib gives it."""
    found = np.empty(len(features), np.uint32)
    lengths = np.fromiter(map(len, features), np.int64, len(features))
    order = np.argsort(lengths, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
        length = int(lengths[own[0]])
        rows = np.frombuffer(b"".join(features[i] for i in own), np.uint8).reshape(len(own), length)
        states, head = np.full(len(own), 0xFFFFFFFF, np.uint32), length % PIECE
        states = columns(rows[:, :head], states)
        if length > PIECE - 1:
            pieces = rows[:, head:].reshape(-1, PIECE)
            added = columns(pieces, np.zeros(len(pieces), np.uint32)).reshape(len(own), -1)
            for column in added.T:
                states = shifts()[0][states & 0xFF] ^ shifts()[1][states >> 8 & 0xFF] ^ shifts()[2][states >> 16 & 0xFF] ^ shifts()[3][states >> 24] ^ column
        found[own] = states ^ np.uint32(0xFFFFFFFF)
    return found


class Hasher:
    """Buckets of texts' features; the distinct words of a batch are hashed once."""

    def __init__(self, buckets: int = BUCKETS, words: int = WORDS):
        self.buckets, self.words = buckets, words

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The buckets of all features of the texts, one text after the other; of each text the number of features, and of words."""
        known: dict[bytes, int] = {}
        places: list[int] = []
        counts, lengths = [], []
        for text in texts:
            own, before = WORD.findall(ascii_lower(text)), len(places)
            for n in range(1, self.words + 1):
                runs = own if n == 1 else [b" ".join(own[i : i + n]) for i in range(len(own) - n + 1)]
                places.extend([known.setdefault(x, len(known)) for x in runs])
            counts.append(len(places) - before)
            lengths.append(len(own))
        hashed = crcs(list(known)) % np.uint32(self.buckets)
        return hashed[np.array(places, np.int64)].astype(np.int64), np.array(counts, np.int64), np.array(lengths, np.int64)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, words: int = WORDS) -> DataFrame:
    """bucket and n, how many features of all texts fall into it; each task hands on a row for each of its buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = Hasher(buckets, words), np.zeros(buckets, np.int64)
        for batch in slices(batches, "text"):
            total += np.bincount(hasher(texts_of(batch.column("text")))[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, words: int = WORDS) -> np.ndarray:
    """The gain of each bucket: 1,000 times the logarithm of its smoothed share in the target over that in ``docs``, floored.
    Collects a row for each bucket. Without any features on either side all gains follow from the smoothing alone."""
    both = [{r.bucket: r.n for r in bucket_counts(x, buckets, words).collect()} for x in (docs, target)]
    s_all, t_all = (sum(x.values()) for x in both)
    s, t = both
    return np.array([math.floor(1000 * math.log((t.get(b, 0) + 1) * (s_all + buckets) / ((s.get(b, 0) + 1) * (t_all + buckets)))) for b in range(buckets)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, words: int = WORDS) -> DataFrame:
    """doc_id, n_features, n_words, weight and print (the text's checksum, which orders rows that share an id)."""
    table_ = docs.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket
    names = ["doc_id", "n_features", "n_words", "weight", "print"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(len(table_.value), words)
        for batch in slices(batches, "text"):
            found, counts, lengths = hasher(texts_of(batch.column("text")))
            sums = np.diff(np.concatenate([[0], np.cumsum(table_.value[found])])[np.concatenate([[0], np.cumsum(counts)])])
            weight = np.where(counts > 0, sums // np.maximum(counts, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *map(pa.array, (counts, lengths, weight)), batch.column("print")], names=names)

    return docs.select("doc_id", "text", F.crc32("text").alias("print")).mapInArrow(run, "doc_id long, n_features long, n_words long, weight long, print long")


def ranked(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Add ``rank``: 1, 2, 3, ... for the floored ``percent`` of the rows that are ``fit``, by score from the highest, ties by doc_id; else null.

    Counts by score tell the lowest score that is drawn (as many rows come to the driver as scores differ, which are thousandths of
    logarithms). The rows from it on are sorted over all tasks, and each task's rows get their places from the counts of those before.
    """
    counts = sorted(((r.score, r.n) for r in rows.where("fit").groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    left = draws = percent * sum(n for _, n in counts) // 100
    lowest = None
    for score, n in counts:
        if left <= 0:
            break
        lowest, left = score, left - n
    if lowest is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    inside = F.col("fit") & (F.col("score") >= lowest)
    order = F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("print"), F.col("weight")
    placed = settle(rows.where(inside).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("place", 33)  # the upper bits are the task's number, the lower ones the row's within it
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("part").alias("_part"), before.alias("_start"))
    rank = F.col("_start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    first = placed.join(starts, part == F.col("_part")).withColumn("rank", F.when(rank <= draws, rank)).drop("place", "_part", "_start")
    return rows.where(~inside).withColumn("rank", F.lit(None).cast("long")).unionByName(first)


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, seed: int = SEED, buckets: int = BUCKETS, words: int = WORDS) -> DataFrame:
    """doc_id, n_features, n_words, weight, score and rank (null for what isn't drawn), one row per document.

    Null and empty texts, and texts without words, have no features and weight 0. Ties of scores go to the smaller doc_id, a null one
    last; a null doc_id draws by the seed alone. Repeated rows each take part; texts are read whole, however long; only doc_id and text
    are read of ``docs`` and text of ``target``; an empty table gives no rows, and an empty target a uniform one.
    """
    rows = weighted(docs, gains(docs, target, buckets, words), words)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(2.0**32)
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform)))
    rows = settle(rows.withColumn("score", score).withColumn("fit", F.col("n_words") >= least), "weighted")
    return ranked(rows, percent).drop("fit", "print")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


SQL = r"""
WITH RECURSIVE step(b, c, k) AS (SELECT b, b, 0 FROM range(256) r(b)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS cs FROM step WHERE k = 8),
doc AS (SELECT row_number() OVER () AS row_, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM documents),
item AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
own AS (SELECT row_, unnest(words) AS word FROM doc),
vocabulary AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM own UNION SELECT DISTINCT word FROM item)),
hashed AS (SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
  lambda c, b: xor(cs[(xor(c, b) & 255) + 1], c >> 8))) % 10000 AS bucket FROM vocabulary, tab),
s AS (SELECT bucket, count(*) AS n FROM own JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM item JOIN hashed USING (word) GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000) AS DOUBLE)
  / CAST((coalesce(s.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000) AS DOUBLE))) AS BIGINT) AS g FROM (SELECT DISTINCT bucket FROM hashed) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
mean AS (SELECT row_, sum(g) AS g, count(*) AS n FROM own JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY row_),
scored AS (SELECT doc_id, len(words) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE CAST((g - ((g % n) + n) % n) // n AS BIGINT) END AS weight,
  CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM doc LEFT JOIN mean USING (row_)),
drawn AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score, n_features >= 20 AS fit FROM scored),
placed AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS place FROM drawn)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
  CASE WHEN fit AND place <= (10 * (SELECT count(*) FROM drawn WHERE fit)) // 100 THEN place END AS rank FROM placed
"""
