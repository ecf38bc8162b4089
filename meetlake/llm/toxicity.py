"""Toxicity by a weighted lexicon.

Texts are folded first: compatibility forms, accents and look-alike letters become plain ones, and digits or signs inside words
become the letters that they stand for; a word with accents is also read with them, as they may tell it from a harmless one. An Aho-Corasick automaton over the folded words finds the lexicon's terms (whole words and
word beginnings) and its exception phrases; terms inside an exception don't count. The weights that are found, as a sum and as a
share of the text's length, give the score through a logistic curve.

The lexicon starts from fixed insults and is completed from labelled texts: words and word beginnings that are far likelier in
toxic ones. A bounded sample of labelled rows serves for that; near copies in it count once. Rows that the lexicon was made
from are not used to fit the curve.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlake.llm.common import settle, slices, table, texts_of

#: Labelled rows to learn from, at most; the terms learned, at most; and the fewest toxic documents of the sample that show a term.
SAMPLE, TERMS, SUPPORT = 20_000, 4_096, 8
#: A learned term is so much likelier among the words of toxic texts (as a logarithm); this share of the texts with it is toxic.
LEAST_WEIGHT, LEAST_SHARE = 1.5, 0.2
#: Terms of at least this weight hardly occur in other texts.
STRONG = 4.0
#: The weight of a fixed term that the sample says nothing about.
FIXED_WEIGHT = 4.0
#: Word beginnings of so many letters are learned.
BEGINNINGS = range(3, 8)
#: Texts at or above this score are toxic.
THRESHOLD = 0.7

# Common insults.
INSULTS = (
    "idiot", "idiots", "moron", "morons", "stupid", "dumb", "loser", "losers", "scum", "trash", "worthless", "pathetic",
    "disgusting", "clown", "imbecile", "retard", "bastard", "bitch", "asshole", "shit", "bullshit", "fuck", "fucking", "cunt",
    "slut", "whore", "dickhead", "dumbass", "jackass", "vermin", "degenerate", "subhuman", "filthy", "idiota", "imbécil",
    "estúpido", "basura", "cabrón", "mierda", "idiote", "connard", "salaud", "ordure", "merde", "dummkopf", "arschloch", "abschaum",
    "scheiße", "vollidiot",
)
# Phrases in which such a word is harmless.
EXCEPTIONS = (
    "trash can", "trash cans", "trash bin", "trash bag", "trash bags", "trash collection", "take out the trash", "clown fish",
    "circus clown", "dumb bell", "dumb bells", "dumb waiter", "not stupid", "not an idiot", "no idiot", "not a moron", "not a loser",
    "scum line", "pond scum", "soap scum", "sore loser",
)
# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "н": "h", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ս": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "l", "ɴ": "n", "ʀ": "r", "ꜱ": "s", "ᴛ": "t", "ø": "o", "ł": "l", "đ": "d",
}
# Digits and signs that stand for letters inside words; 1, ! and | stand for two.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}


@lru_cache(1)
def plain_letters() -> dict[int, str | None]:
    """What str.translate() needs to fold single characters: look-alikes, accents and compatibility forms; invisible ones go."""
    found: dict[int, str | None] = {}
    for code in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2100, 0x2150), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)).lower()
        if base != chr(code) and base.isascii() and base.isalnum():
            found[code] = base
    found |= {ord(k): v for k, v in LOOKALIKES.items()}
    found |= {ord(k.upper()): v for k, v in LOOKALIKES.items() if len(k.upper()) == 1 and not k.upper().isascii()}
    return found | {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x300, 0x370))}


@lru_cache(1)
def accents() -> tuple[dict[int, str | None], dict[int, str | None]]:
    """plain_letters() without the accented Latin letters, and these alone."""
    every = plain_letters()
    return {k: v for k, v in every.items() if not 0xDF < k < 0x250}, {k: v for k, v in every.items() if 0xDF < k < 0x250}


ACCENTED = re.compile("\\w*[\u00e0-\u024f]\\w*")
MIXED = re.compile(r"(?<![a-z0-9@$!|])[a-z]*+[0-9@$!|][a-z0-9@$!|]*")
APART = re.compile(r"[\W_]+")
READINGS = str.maketrans(STAND_INS), str.maketrans(STAND_INS | {"1": "l", "!": "l", "|": "l"})


def read_mixed(match: re.Match) -> str:
    """A word with digits or signs as letters; both readings where it has a sign that stands for two."""
    word = match[0].rstrip("!|@$")
    if not word.isalnum() and not re.search("[a-z]", word) or word.isdigit() or word.isalpha() or not word:
        return match[0]
    first, second = (word.translate(x) for x in READINGS)
    return first if first == second else f"{first} {second}"


def fold(text: str) -> str:
    """The folded words of a text, a space before, between and after them; a word with accents stands twice, without and with them."""
    text = text.casefold()
    if not text.isascii():
        others, latin = accents()
        text = ACCENTED.sub(lambda m: f"{m[0].translate(latin)} {m[0]}", text.translate(others))
    return f" {APART.sub(' ', MIXED.sub(read_mixed, text)).strip()} "


class Matcher:
    """Finds a lexicon's terms; they begin with a space, and end with one if they are whole words."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.automaton = ahocorasick.Automaton()
        for term, weight in weights.items():
            self.automaton.add_word(term, (len(term), weight))
        for phrase in exceptions:
            self.automaton.add_word(fold(phrase), (len(fold(phrase)), None))
        self.automaton.make_automaton()

    def find(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of each word that is hit, by its heaviest term, outside exception phrases."""
        hits: dict[int, tuple[int, float]] = {}
        excepted: list[tuple[int, int]] = []
        for end, (n, weight) in self.automaton.iter(folded):
            start = end + 1 - n
            if weight is None:
                excepted.append((start, end))  # the space at its end may begin another term
            elif start not in hits or weight > hits[start][1]:
                hits[start] = end + 1, weight
        return [(s, e, w) for s, (e, w) in sorted(hits.items()) if not any(a <= s < b for a, b in excepted)]


def features(strong, total, words):
    """What the curve sees: the weight of strong terms, that of all, and its share in 1,000 words, as logarithms."""
    return np.log1p(strong), np.log1p(total), np.log1p(1000 * total / (words + 10))


def weighed(matcher: Matcher, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Of each text the number of words, and its hits."""
    words, found = [], []
    for text in texts:
        folded = fold(text)
        words.append(folded.count(" ") - 1 if len(folded) > 2 else 0)
        found.append(matcher.find(folded))
    return np.array(words, float), found


def curved(words: np.ndarray, found: list[list[tuple[int, int, float]]], curve: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, and the weights that they come from: of strong terms, and of all."""
    strong = np.array([sum(w for _, _, w in x if w >= STRONG) for x in found], float)
    total = np.array([sum(w for _, _, w in x) for x in found], float)
    x = np.column_stack(features(strong, total, words))
    return 1 / (1 + np.exp(-np.clip(curve[0] + x @ np.array(curve[1:]), -30, 30))), strong, total


def sampled(docs: DataFrame, labels: DataFrame, usable: Column, rows: int) -> DataFrame:
    """doc_id, toxic and text of at most ``rows`` labelled documents, by the hash of doc_id; of repeated labels the largest counts."""
    marked = labels.where("doc_id is not null and toxic is not null").where(usable).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = settle(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "labelled")
    return docs.select("doc_id", "text").join(chosen, "doc_id")


def learn_terms(sample: DataFrame, terms: int = TERMS, support: int = SUPPORT) -> dict[str, float]:
    """Terms with weights: the sample's, and the fixed ones that it says nothing about. Collects ``terms`` rows at most."""

    kind = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            prints, lists = [], []
            for text in texts_of(batch.column("text")):
                own = fold(text).split()
                runs = {" ".join(own[i : i + 4]) for i in range(max(1, len(own) - 3))}
                prints.append(min(xxhash.xxh3_64_intdigest(x) for x in runs) >> 1)
                lists.append([{"word": w, "n": n} for w, n in sorted(Counter(own).items())])
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.int64()), batch.column("toxic").cast(pa.int64()), pa.array(lists, kind)], names=["print", "toxic", "words"])

    once = sample.select("toxic", "text").mapInArrow(words, "print long, toxic long, words array<struct<word:string,n:long>>")
    once = settle(once.dropDuplicates(["print", "toxic"]), "words")
    each = once.select("toxic", F.explode("words").alias("w")).select("toxic", "w.word", "w.n")
    counts = each.groupBy("word").agg(F.count("*").alias("docs"), F.sum("toxic").alias("bad"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("toxic")).alias("bad_n"))
    counts = settle(counts, "counts")
    n, bad = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad_n"), F.lit(0))).first()
    whole = F.concat(F.lit(" "), "word", F.lit(" "))
    begun = F.array(whole, *(F.when(F.length("word") >= k, F.concat(F.lit(" "), F.substring("word", 1, k))) for k in BEGINNINGS))
    sums = [F.sum(x).alias(x) for x in ("docs", "bad", "n", "bad_n")]
    by_term = counts.select(F.explode(begun).alias("term"), "docs", "bad", "n", "bad_n").where("term is not null").groupBy("term").agg(*sums)
    weight = F.log((F.col("bad_n") + 0.5) / (bad + 1)) - F.log((F.col("n") - F.col("bad_n") + 0.5) / (n - bad + 1))
    fixed = {fold(x): FIXED_WEIGHT for x in INSULTS}
    known = by_term.where(F.col("term").isin(list(fixed)) & (F.col("docs") >= support)).select("term", weight.alias("weight"))
    learned = by_term.where((F.col("bad") >= support) & (F.col("bad") >= LEAST_SHARE * F.col("docs"))).select("term", "bad", weight.alias("weight")).where(F.col("weight") >= LEAST_WEIGHT)
    found = learned.orderBy(F.desc(F.col("bad") * F.col("weight")), "term").limit(terms).select("term", "weight").union(known)
    return {t: w for t, w in (fixed | {r.term: r.weight for r in found.collect()}).items() if w > 0}


def scored(docs: DataFrame, weights: dict[str, float], curve: list[float]) -> DataFrame:
    """doc_id, score, and of each hit its place in the folded text and its weight, for every document."""
    kinds = "doc_id long, score double, words long, strong double, total double, hits array<struct<start:int,end:int,weight:double>>"
    terms = docs.sparkSession.sparkContext.broadcast(weights)  # TERMS and the fixed ones at most
    hit = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("weight", pa.float64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("words", pa.int64()), ("strong", pa.float64()), ("total", pa.float64()), ("hits", hit)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms.value)
        for batch in slices(batches, "text"):
            words, found = weighed(matcher, texts_of(batch.column("text")))
            scores, strong, total = curved(words, found, curve)
            hits = [[{"start": s, "end": e, "weight": w} for s, e, w in x] for x in found]
            columns = [pa.array(scores), pa.array(words.astype(np.int64)), pa.array(strong), pa.array(total), pa.array(hits, hit)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, kinds)


def kept(docs: DataFrame, weights: dict[str, float], curve: list[float]) -> DataFrame:
    """The rows that aren't toxic (score under THRESHOLD), with all their columns, in one pass. Null and empty texts have no hits and stay;
    repeated rows are judged alike; an empty table gives no rows."""
    terms = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms.value)
        for batch in slices(batches, "text"):
            words, found = weighed(matcher, texts_of(batch.column("text")))
            yield batch.filter(pa.array(curved(words, found, curve)[0] < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def fit_curve(sample: DataFrame, weights: dict[str, float], ridge: float = 0.01) -> list[float]:
    """The logistic curve over the features, by Newton's method on the sample's rows (collected: four numbers each)."""
    plain = scored(sample, weights, [0.0] * 4).select("doc_id", "words", "strong", "total")
    rows = plain.join(sample.select("doc_id", "toxic"), "doc_id").select("strong", "total", "words", "toxic").toPandas()
    if rows.toxic.nunique() < 2:
        return [-3.0, 1.0, 0.5, 0.5]  # nothing to learn from: a hit makes a text suspect, several make it toxic
    x = np.column_stack([np.ones(len(rows)), *features(rows.strong, rows.total, rows.words)])
    y, w = rows.toxic.to_numpy(float), np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(4), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return [float(v) for v in w]


def learn(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = SAMPLE) -> tuple[dict[str, float], list[float]]:
    """A lexicon and a curve, from at most ``rows`` labelled rows where ``usable``: two thirds for the lexicon, the rest for the curve."""
    sample = settle(sampled(docs, labels, usable, rows), "sample")
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3))
    weights = learn_terms(sample.where(part != 0))
    return weights, fit_curve(sample.where(part == 0), weights)


def toxicity(docs: DataFrame, labels: DataFrame, usable: Column | None = None, rows: int = SAMPLE) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from THRESHOLD on), words and hits, one row per document.

    Null and empty texts have no hits and get the curve's lowest score. Documents without a label count in no way; without any
    labels the fixed terms and a fixed curve serve. Repeated rows are each scored; a null doc_id stays null and teaches nothing;
    other columns are not read; very long texts are scored whole; an empty table gives no rows.
    """
    weights, curve = learn(docs, labels, F.lit(True) if usable is None else usable, rows)
    return scored(docs, weights, curve).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def taught(spark: SparkSession, sf_dir: str) -> tuple[dict[str, float], list[float]]:
    """The lexicon and curve of the tables, from the labelled rows that aren't held out."""
    return learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(table(spark, sf_dir, "documents"), *taught(spark, sf_dir))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't toxic, as kept(), by a lexicon learned from the tables in ``sf_dir``."""
    return kept(docs, *taught(spark, sf_dir))
