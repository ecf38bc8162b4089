"""The index of meetings' passages: what it holds, where it is kept, and what of it must be made anew.

Two tables lie in a shared folder, both partitioned by a bucket of the meeting: heads (a meeting's model, fingerprint and version) and vectors (its
passages with codes of eight bits). Only buckets with stale meetings are written again, vectors first, then heads; a reader joins the two on the
fingerprint, so what a broken write leaves is never seen, and the meeting is made anew by the next refresh.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlake.functions import text as X
from meetlake.operators.passages import chunks, in_order, parts
from meetlake.operators.retrieval import quantised
from meetlake.sources.settled import settle

#: A meeting's document: one row each version.
DOCUMENT = (
    "meeting_id long, version long, title string, summary string, notes array<struct<note_idx:int,note_id:int,ts:string,tag:string,text:string>>, "
    "lines array<struct<utt_idx:int,speaker:int,start_s:double,end_s:double,text:string>>, names map<string,string>"
)
HEADS = "meeting_id long, model_id string, fingerprint string, version long, passages long, bucket int"
VECTORS = "meeting_id long, fingerprint string, kind string, a int, b int, text_hash string, made long, codes array<tinyint>, bucket int"
# Tokens of a part of a meeting's title and summary, and the fewest characters of a note.
PART, NOTE = 440, 6


def latest(documents: DataFrame) -> DataFrame:
    """The last version of each meeting."""
    whole = F.struct(*documents.columns)
    return documents.groupBy("meeting_id").agg(F.max_by(whole, F.struct("version", F.xxhash64("title", "summary", F.to_json("lines")))).alias("d")).select("d.*")


def fingerprints(documents: DataFrame) -> DataFrame:
    """meeting_id, version and fingerprint: a digest of title, summary, notes as they are shown, lines' texts, speakers and starts, and names by
    speaker, each ended by a zero byte."""
    end = F.lit("\0")
    note = lambda n: F.concat(F.lit("#"), n["note_id"].cast("string"), F.lit(" ["), n["ts"], F.lit("] "), F.coalesce(F.concat(F.lit("("), n["tag"], F.lit(") ")), F.lit("")), n["text"])
    notes = F.array_join(F.transform(F.array_sort(F.coalesce("notes", F.array().cast("array<struct<note_idx:int,note_id:int,ts:string,tag:string,text:string>>"))), note), "\n")
    lines = F.transform(F.array_sort("lines"), lambda x: F.concat(x["text"], end, x["speaker"].cast("string"), end, x["start_s"].cast("string"), end))
    names = F.transform(F.array_sort(F.map_entries("names")), lambda x: F.concat(x["key"], end, x["value"], end))
    empty = F.array().cast("array<string>")
    whole = F.concat(F.coalesce("title", F.lit("")), end, F.coalesce("summary", F.lit("")), end, notes, end, F.array_join(F.coalesce(lines, empty), ""), F.array_join(F.coalesce(names, empty), ""))
    return documents.select("meeting_id", "version", F.sha2(whole, 256).alias("fingerprint"))


def session_units(documents: DataFrame, tokens: Callable[[Column], Column] = X.token_estimate) -> DataFrame:
    """meeting_id, kind, a, b and text of what an index holds: the title and summary in parts of PART tokens, notes of NOTE characters and more, and
    chunks of lines, which stand with their speaker's name where there is one."""
    shown = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("summary", F.lit("")))
    head = documents.select("meeting_id", F.posexplode(F.split(shown, "\n")).alias("utt_idx", "text")).withColumn("text", F.regexp_replace("text", r"^[\s&&[^\n]]+|[\s&&[^\n]]+$", "")).where("text <> ''")
    head = head.withColumn("tokens", tokens(F.col("text")))
    placed = head.join(parts(head, PART), ["meeting_id", "utt_idx"])
    joined = placed.groupBy("meeting_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("utt_idx", "text"))), lambda x: x["text"]), "\n").alias("text"))
    whole = joined.select("meeting_id", F.lit("meeting").alias("kind"), F.col("part").cast("int").alias("a"), F.lit(0).alias("b"), "text")
    note = documents.select("meeting_id", F.explode("notes").alias("n")).where(F.char_length("n.text") >= NOTE).select("meeting_id", F.lit("note").alias("kind"), F.col("n.note_idx").alias("a"), F.lit(0).alias("b"), F.col("n.text").alias("text"))
    each = documents.select("meeting_id", F.col("names"), F.explode("lines").alias("l")).select("meeting_id", "l.*", F.nullif(F.try_element_at("names", F.col("l.speaker").cast("string")), F.lit("")).alias("name"))
    lines = each.withColumn("text", X.chunk_line(F.col("text"), F.col("name"))).withColumn("tokens", tokens(F.col("text"))).drop("name")
    spans, texts = chunks(lines), in_order(lines, "text").select("meeting_id", F.col("lines.text").alias("texts"))
    chunk = spans.join(texts, "meeting_id").select("meeting_id", F.lit("chunk").alias("kind"), "a", "b", F.array_join(F.slice("texts", F.col("a") + 1, F.col("b") - F.col("a") + 1), "\n").alias("text"))
    return whole.unionByName(note).unionByName(chunk)


class Store:
    """An index below ``path``, a folder that all machines share, for one embedding model."""

    def __init__(self, spark: SparkSession, path: str, model_id: str, buckets: int = 16):
        self.spark, self.path, self.model_id, self.buckets = spark, path.rstrip("/"), model_id, buckets
        for name, kind in (("heads", HEADS), ("vectors", VECTORS)):
            spark.createDataFrame([], kind).write.mode("ignore").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def _read(self, name: str, kind: str) -> DataFrame:
        return self.spark.read.schema(kind).parquet(f"{self.path}/{name}")

    def heads(self) -> DataFrame:
        return self._read("heads", HEADS)

    def vectors(self) -> DataFrame:
        """Passages of whole meetings only."""
        return self._read("vectors", VECTORS).join(self.heads().select("meeting_id", "fingerprint"), ["meeting_id", "fingerprint"], "left_semi")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("meeting_id"), F.lit(self.buckets)).cast("int")

    def replace(self, heads: DataFrame, vectors: DataFrame) -> None:
        """Puts meetings (settled heads, with ``bucket``) in the place of what is stored of them; other buckets aren't touched."""
        self._put("vectors", VECTORS, heads, vectors)
        self._put("heads", HEADS, heads, heads)

    def _put(self, name: str, kind: str, heads: DataFrame, new: DataFrame) -> None:
        touched = heads.select("bucket").distinct()
        kept = self._read(name, kind).join(touched, "bucket", "left_semi").join(heads.select("meeting_id"), "meeting_id", "left_anti")
        both = settle(kept.select(*new.columns).unionByName(new), name)  # read before it is overwritten
        both.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{name}")


def stale(documents: DataFrame, store: Store) -> DataFrame:
    """meeting_id, version and fingerprint of meetings whose index is missing, of another model or of other content; a version older than
    the stored one is no news."""
    wanted = fingerprints(documents)
    have = store.heads().select("meeting_id", F.col("model_id").alias("_model"), F.col("fingerprint").alias("_print"), F.col("version").alias("_version"))
    fresh = (F.col("_model") == store.model_id) & (F.col("_print") == F.col("fingerprint"))
    joined = wanted.join(have, "meeting_id", "left")
    return joined.where(F.col("_model").isNull() | ~fresh & (F.col("version") >= F.col("_version"))).select("meeting_id", "version", "fingerprint")


def refresh(store: Store, documents: DataFrame, embed: Callable[[DataFrame], DataFrame], tokens: Callable[[Column], Column] = X.token_estimate) -> None:
    """Brings the index of these meetings up to date. Of a stale one the vectors whose model, kind and text are as before are taken over, the other
    texts go through ``embed`` (adds ``vector``, of length one, to rows with ``text``), each distinct one once. Doing it again changes nothing,
    so a repeated micro-batch does no harm; called with the whole library it works off the backlog."""
    now = settle(latest(documents), "documents")
    todo = settle(stale(now, store).withColumn("bucket", store.bucket()), "todo")
    if todo.isEmpty():
        return
    digest = F.sha2(F.concat("kind", F.lit("\0"), "text"), 256)
    units = session_units(now.join(todo.select("meeting_id"), "meeting_id", "left_semi"), tokens).withColumn("text_hash", digest)
    units = settle(units.join(todo, "meeting_id"), "units")
    model = store.heads().where(F.col("model_id") == store.model_id).select("meeting_id")
    old = store.vectors().join(model, "meeting_id", "left_semi").groupBy("meeting_id", "text_hash").agg(F.min_by(F.struct("made", "codes"), F.struct("kind", "a")).alias("_old"))
    known = settle(units.join(old, ["meeting_id", "text_hash"], "left"), "known")
    fresh = embed(known.where("_old is null").select("text_hash", "text").dropDuplicates(["text_hash"])).select("text_hash", quantised(F.col("vector")).alias("_codes"))
    both = known.join(fresh, "text_hash", "left")
    vectors = both.select("meeting_id", "fingerprint", "kind", "a", "b", "text_hash", F.coalesce("_old.made", "version").alias("made"), F.coalesce("_old.codes", "_codes").alias("codes"), "bucket")
    sizes = units.groupBy("meeting_id").agg(F.count("*").alias("passages"))
    heads = todo.join(sizes, "meeting_id", "left").select("meeting_id", F.lit(store.model_id).alias("model_id"), "fingerprint", "version", F.coalesce("passages", F.lit(0)).alias("passages"), "bucket")
    store.replace(settle(heads, "heads"), settle(vectors, "vectors"))
