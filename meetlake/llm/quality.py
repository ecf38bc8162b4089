"""Quality by supervised embeddings of words and their parts.

A word's features are itself and the runs of three to five characters of it, its ends marked; each falls into one of ``BUCKETS`` by a
hash and has a vector there. A word that follows itself gives one more feature. A document is the average of its features' vectors, and a softmax over a linear map of that gives the
classes' probabilities. Vectors and map are learned together by stochastic gradient descent in numpy, document after document, from a
bounded sample of labelled rows; of very long documents a sample of their features teaches.

Learned vectors are rounded to parts of 2**20 and summed as whole numbers, so a text has one score whatever it stands next to.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlake.llm.common import settle, slices, table, texts_of

#: Labelled rows to learn from, at most, and the distinct features of each that teach, at most (whole texts are scored).
SAMPLE, TAUGHT = 6_000, 1_500
#: Buckets and length of the vectors; lengths of the runs of characters.
BUCKETS, WIDTH, RUNS = 1 << 17, 12, (3, 4, 5)
#: Rounds over the sample, the first step's size (the steps shrink to nothing), and what draws vectors back to zero.
ROUNDS, RATE, SEED = 12, 2.0, 11
#: Texts at or above this score are good.
THRESHOLD = 0.5
#: Characters of distinct words whose features are computed at once; words that a worker remembers.
AT_ONCE, REMEMBERED = 1 << 17, 400_000
ONE = 1 << 20
SAME = "\x00="


def words_of(text: str) -> list[str]:
    """The words of a text; for each that follows itself one more, which stands for that alone: a pair of words, whatever the word."""
    own = text.split()
    return own + [SAME] * sum(map(operator.eq, own, own[1:]))


def mixed(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64)


def features(words: list[str], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of words, buckets) of all features of the words, in pieces; places don't fall within a piece."""
    yield np.arange(len(words)), mixed(np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words)), buckets)
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), np.fromiter((len(w) + 2 for w in words), np.int64, len(words)))
    for start in range(0, len(codes), AT_ONCE):
        for n in RUNS:
            own = codes[start : start + AT_ONCE + n - 1]
            m = len(own) - n + 1
            if m <= 0:
                continue
            h = np.full(m, n, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + own[k : k + m]
            first, last = owner[start : start + m], owner[start + n - 1 : start + n - 1 + m]
            whole = first == last
            yield first[whole], mixed(h[whole], buckets)


class Model:
    """Vectors (whole numbers, in parts of ONE) by bucket, and the map from an average vector to the classes' logarithms."""

    def __init__(self, vectors: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.vectors = np.round(np.clip(vectors, -1000, 1000) * ONE).astype(np.int32)
        self.weights, self.bias = weights.astype(float), bias.astype(float)

    def probabilities(self, averages: np.ndarray) -> np.ndarray:
        x = averages @ self.weights + self.bias
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)


class Averages:
    """Average vectors of texts; the sums of words seen before are remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.sums = np.zeros((1024, self.model.vectors.shape[1] + 1), np.int64)  # the last column counts features

    def learn(self, words: list[str]) -> None:
        """Sums of new words, which have the next places in ``known``."""
        first = len(self.known) - len(words)
        if len(self.known) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros((max(len(self.sums), len(words)), self.sums.shape[1]), np.int64)])
        start = held = 0
        for end, word in enumerate([*words, None]):
            if word is None or held > AT_ONCE:
                for places, buckets in features(words[start:end], len(self.model.vectors)):
                    if len(places):
                        edges = np.flatnonzero(np.diff(places, prepend=-1))
                        rows = first + start + places[edges]
                        self.sums[rows, :-1] += np.add.reduceat(self.model.vectors[buckets], edges, axis=0, dtype=np.int64)
                        self.sums[rows, -1] += np.diff(np.append(edges, len(places)))
                start, held = end, 0
            held += len(word or "")

    def __call__(self, texts: list[str]) -> np.ndarray:
        """An average for each text; of a text without words zeros."""
        if len(self.known) > REMEMBERED:
            self.forget()
        split = [words_of(text) for text in texts]
        before, known = len(self.known), self.known
        places = [[known.setdefault(w, len(known)) for w in own] for own in split]
        self.learn(list(known)[before:])
        total = np.array([self.sums[own].sum(axis=0) if own else np.zeros(self.sums.shape[1], np.int64) for own in places]).reshape(len(texts), -1)
        return total[:, :-1] / np.maximum(total[:, -1:], 1) / ONE


def bag(text: str, draw: int, buckets: int = BUCKETS, most: int = TAUGHT) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of a text with their numbers; ``most`` of them, drawn by a hash of bucket and ``draw``, if there are more."""
    words = words_of(text)
    total = np.zeros(buckets, np.int64)
    held = start = 0
    for end in range(1, len(words) + 1):
        held += len(words[end - 1])
        if held > AT_ONCE or end == len(words):
            for _, found in features(words[start:end], buckets):
                total += np.bincount(found, minlength=buckets)
            held, start = 0, end
    found = np.flatnonzero(total)
    if len(found) > most:
        order = mixed((found.astype(np.uint64) + np.uint64(draw & (2**63 - 1))) * np.uint64(0xD6E8FEB86659FD93), 1 << 32)
        found = np.sort(found[np.argpartition(order, most)[:most]])
    return found, total[found]


def descended(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int = 2, buckets: int = BUCKETS, width: int = WIDTH, rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """A model learned from bags of features with labels, one document a step, in a shuffled order.

    Vectors start at zero, so features that no document shows add nothing. A vector's step is scaled by the steps that it has taken
    (Adagrad), so that rare features learn as far as frequent ones.
    """
    chance = np.random.default_rng(SEED)
    vectors, taken = np.zeros((buckets, width), np.float32), np.full(buckets, 1e-6, np.float32)
    weights, bias = chance.normal(0, 1, (width, classes)).astype(np.float32), np.log((np.bincount(labels, minlength=classes) + 1) / (len(labels) + classes)).astype(np.float32)
    shares = [(n / n.sum()).astype(np.float32) for _, n in bags]
    target = np.eye(classes, dtype=np.float32)[labels]
    step, steps = 0, rounds * len(bags)
    for _ in range(rounds):
        for i in chance.permutation(len(bags)):
            own, share = bags[i][0], shares[i]
            if not len(own):
                continue
            now = rate * (1 - step / steps)
            step += 1
            average = share @ vectors[own]
            p = average @ weights + bias
            p = np.exp(p - p.max())
            lean = p / p.sum() - target[i]
            toward = weights @ lean
            taken[own] += share * share * float(toward @ toward)
            vectors[own] -= (now * 0.05 * share / np.sqrt(taken[own]))[:, None] * toward
            weights -= now * 0.05 * np.outer(average, lean)
            bias -= now * 0.02 * lean
    return Model(vectors, weights, bias)


def learn(docs: DataFrame, labels: DataFrame, usable: Column | None = None, rows: int = SAMPLE, label: str = "quality") -> Model:
    """A model from at most ``rows`` labelled documents where ``usable``, by the hash of doc_id; of repeated labels the largest counts.
    Their bags, ``TAUGHT`` features each at most, come to the driver. Without labels the score is one half everywhere."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).where(F.lit(True) if usable is None else usable).groupBy("doc_id").agg(F.max(label).alias("label"))
    chosen = settle(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "labelled")
    sample = docs.select("doc_id", "text").join(chosen, "doc_id")
    kinds = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = texts_of(batch.column("text"))
            keys = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "replace")) >> 1 for t in texts]
            bags = [bag(t, k) for t, k in zip(texts, keys, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), batch.column("doc_id").cast(pa.int64()), batch.column("label").cast(pa.int32()), pa.array([b for b, _ in bags], kinds), pa.array([n for _, n in bags], kinds)], names=["key", "doc_id", "label", "found", "n"]
            )

    got = sample.mapInArrow(run, "key long, doc_id long, label int, found array<int>, n array<int>")
    once = got.groupBy("doc_id").agg(F.min_by(F.struct("key", "label", "found", "n"), "key").alias("d")).select("d.*")  # an id may repeat with other texts
    got = once.dropDuplicates(["key", "label"]).toArrow().sort_by([("key", "ascending"), ("label", "ascending")])
    bags = [(f.values.to_numpy(), n.values.to_numpy()) for f, n in zip(got["found"], got["n"], strict=True)]
    held = np.array(got["label"].to_pylist(), np.int64)
    if len(set(held.tolist())) < 2:
        return Model(np.zeros((BUCKETS, WIDTH)), np.zeros((WIDTH, 2)), np.zeros(2))
    return descended(bags, held)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (the probability of label 1) and vector (the document's average), for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS * WIDTH numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        averages = Averages(shared.value)
        for batch in slices(batches, "text"):
            found = averages(texts_of(batch.column("text")))
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, found.shape[1]), pa.int32()), pa.array(found.ravel().astype(np.float32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(shared.value.probabilities(found)[:, 1]), vectors], names=["doc_id", "score", "vector"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, vector array<float>")


def quality(docs: DataFrame, labels: DataFrame, usable: Column | None = None, rows: int = SAMPLE, label: str = "quality") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from THRESHOLD on) and vector, one row per document.

    Null, empty and blank texts have no features and get the score of the classes' shares. Equal texts have equal scores; repeated rows
    are each scored; a null doc_id stays null and teaches nothing; copies among the labelled texts teach once. Texts are scored whole,
    however long; other columns are not read; an empty table gives no rows.
    """
    return scored(docs, learn(docs, labels, usable, rows, label)).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out())
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")
