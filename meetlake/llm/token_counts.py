"""Token counts through a digest cache.

The cache is a table of content digest, tokenizer-version digest and number of tokens. Documents are reduced to digests, which join it
by both; of those that it doesn't have, each distinct content is encoded once, by the library, and its count is appended. Then all
counts come from the cache. Contents are normalised only where the tokenizer can't tell the difference: for a SentencePiece model
that writes spaces as its space mark, the mark in a text is a space. Any other change could change the count.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlake.llm.common import settle, shared_dir, slices, table, texts_of

LIMIT = 4096
CACHE = "digest binary, version string, n_tokens long"
COUNTED = "digest binary, n_tokens long"
MARK = "\u2581"


def version(model: bytes, library: str) -> str:
    """Digest of what decides about counts: the model's content, and the library with its version."""
    return hashlib.sha256(model + b"\0" + library.encode()).hexdigest()


@lru_cache(2)
def counter(model: bytes, kind: str):
    """texts -> numbers of tokens, without special tokens, truncation or padding."""
    if kind == "model":
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        return lambda texts: [len(x) for x in lib.encode(texts, num_threads=1)]
    import tokenizers

    lib = tokenizers.Tokenizer.from_str(model.decode())
    lib.no_truncation()
    lib.no_padding()
    return lambda texts: [len(x.ids) for x in lib.encode_batch(texts, add_special_tokens=False)]


def normalised(text: Column, model: bytes, kind: str) -> Column:
    """A text as the tokenizer sees it, as far as that is certain not to change its tokens."""
    if kind == "model":
        import sentencepiece

        lib, probe = sentencepiece.SentencePieceProcessor(model_proto=model), f" {MARK}a{MARK} {MARK}{MARK}\n{MARK} "
        if lib.normalize(probe) == lib.normalize(probe.replace(MARK, " ")):
            return F.replace(text, F.lit(MARK), F.lit(" "))
    return text


def token_counts(docs: DataFrame, model_path: str, cache: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens, one row per document; counts that ``cache`` lacks are appended to it.

    ``cache`` is a folder in a shared store. Its rows are never changed, and a job that fails half way appends nothing, or rows that a
    later one finds; a count found twice is taken once. Null texts count as empty (no tokens). Repeated rows are each returned, and a
    repeated id with another text has that text's count; a null doc_id stays null; other columns are not read. Very long texts are encoded
    whole. An empty table gives no rows and appends nothing.

    Each task sends a content once, whatever the number of its copies; the copies' digests meet the counts in a plain join, which Spark
    splits where one digest fills a partition.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as file:
        content = file.read()
    kind = model_path.rpartition(".")[2]
    import sentencepiece
    import tokenizers

    own = version(content, f"sentencepiece {sentencepiece.__version__}" if kind == "model" else f"tokenizers {tokenizers.__version__}")
    path = cache.rstrip("/")
    model = spark.sparkContext.broadcast(content)  # a tokenizer's size
    spark.createDataFrame([], CACHE).write.mode("append").partitionBy("version").parquet(path)  # so that it can be read
    known = spark.read.schema(CACHE).parquet(path)

    text = F.coalesce("text", F.lit(""))
    seen = normalised(text, content, kind)
    contents = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(seen, 256)).alias("digest"), F.lit(own).alias("version"), seen.alias("text"))
    distinct = contents.groupBy("digest", "version").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model.value, kind)
        for batch in slices(batches, "text", 4 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(count(texts_of(batch.column("text"))), pa.int64())], names=["digest", "n_tokens"])

    fresh = distinct.join(known, ["digest", "version"], "left_anti").select("digest", "text").mapInArrow(run, COUNTED)
    fresh.withColumn("version", F.lit(own)).write.mode("append").partitionBy("version").parquet(path)
    counts = settle(spark.read.schema(CACHE).parquet(path).where(F.col("version") == own).groupBy("digest", "version").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return contents.drop("text").join(counts, ["digest", "version"]).select("doc_id", "n_bytes", "n_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, which starts empty: every distinct text is encoded."""
    import public_tokenizers

    cache = f"{shared_dir(spark)}/meetlake-{uuid.uuid4().hex}/token-cache"
    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), cache)
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
