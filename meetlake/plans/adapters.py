"""Meeting tables made from the given ones, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Dimensions of the given vectors.
DIMS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """A table as it is read, dealt to all cores if its files give fewer tasks: for what works hard on each text. A large table's files give more."""
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= tasks else rows.repartition(tasks)


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as utterances: 15 characters take a second, one at least."""
    rows = table(spark, sf_dir, "conversations")
    seconds = F.greatest(F.lit(1.0), F.char_length("text") / F.lit(15.0))
    end = F.round(F.sum(seconds).over(Window.partitionBy("conv_id").orderBy("turn")), 3)
    rows = rows.withColumn("end_s", end).withColumn("start_s", F.coalesce(F.lag("end_s").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(0.0)))
    speaker = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    return rows.select(F.col("conv_id").alias("meeting_id"), F.col("turn").alias("utt_idx"), speaker.alias("speaker"), "start_s", "end_s", "text")


UTT = """utt_ AS (SELECT conv_id AS meeting_id, turn AS utt_idx, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS speaker, text,
    round(sum(greatest(1.0::DOUBLE, length(text) / 15.0::DOUBLE)) OVER (PARTITION BY conv_id ORDER BY turn), 3) AS end_s FROM conversations),
utt AS (SELECT meeting_id, utt_idx, speaker, coalesce(lag(end_s) OVER (PARTITION BY meeting_id ORDER BY utt_idx), 0.0) AS start_s, end_s, text FROM utt_)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as turns of eight speakers; a day is a meeting."""
    rows = table(spark, sf_dir, "events")
    start = (F.hour("ts") * 3_600_000 + F.minute("ts") * 60_000 + F.floor(F.expr("extract(second from ts)") * 1000)) / F.lit(1000.0)
    rows = rows.select(F.col("ts").cast("date").cast("string").alias("meeting_id"), F.col("event_id").alias("turn_id"), (F.col("user_id") % 8).cast("int").alias("speaker"), start.alias("start_s"), "value")
    return rows.withColumn("end_s", F.round(F.col("start_s") + F.col("value") * 6, 3)).drop("value").where("end_s > start_s")


TURNS = """turn_ AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS meeting_id, event_id AS turn_id, CAST(user_id % 8 AS INT) AS speaker,
    ((epoch_us(ts) - epoch_us(date_trunc('day', ts))) // 1000) / 1000.0::DOUBLE AS start_s, value FROM events),
turns AS (SELECT meeting_id, turn_id, speaker, start_s, round(start_s + value * 6, 3) AS end_s FROM turn_ WHERE round(start_s + value * 6, 3) > start_s)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as meetings of lines."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("meeting_id"), F.posexplode(F.split("text", "\n")).alias("utt_idx", "text"))
    return rows


LINES = """line_ AS (SELECT doc_id AS meeting_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
lines AS (SELECT meeting_id, CAST(i AS INT) AS utt_idx, ls[i + 1] AS text FROM (SELECT meeting_id, ls, unnest(range(len(ls))) AS i FROM line_))"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as vectors of twenty meetings."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", (F.col("vec_id") % 20).alias("meeting_id"), F.col("label").alias("person"), F.col("embedding").cast("array<double>").alias("vector"))


VECTORS = "vecs AS (SELECT vec_id, vec_id % 20 AS meeting_id, label AS person, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings)"


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as questions, with the vectors of the same numbers."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lower("text").alias("query"))
    return asked.join(vectors(spark, sf_dir).select(F.col("vec_id").alias("query_id"), "vector"), "query_id", "left")


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the mean probability of a speaker in each minute."""
    rows = table(spark, sf_dir, "events")
    frame = (F.hour("ts") * 60 + F.minute("ts"))
    mean = F.round(F.avg(F.col("value") / (1 + F.col("value"))), 6)
    return rows.groupBy(F.col("ts").cast("date").cast("string").alias("meeting_id"), frame.cast("long").alias("frame"), (F.col("user_id") % 8).cast("int").alias("speaker")).agg(mean.alias("prob"))


PROBS = """probs AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS meeting_id, hour(ts) * 60 + minute(ts) AS frame, CAST(user_id % 8 AS INT) AS speaker,
    round(avg(value / (1 + value)), 6) AS prob FROM events GROUP BY ALL)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sound levels by minute: each event's share of a loud one."""
    rows = table(spark, sf_dir, "events")
    frame = (F.hour("ts") * 60 + F.minute("ts")).cast("long")
    rms = F.round(F.avg("value") / 10_000, 9)
    return rows.groupBy(F.col("ts").cast("date").cast("string").alias("meeting_id"), frame.alias("frame")).agg(rms.alias("rms"), F.round(F.max("value") / 1000, 9).alias("peak"), F.count("*").alias("n"))


FRAMES = """frames AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS meeting_id, hour(ts) * 60 + minute(ts) AS frame,
    round(avg(value) / 10000, 9) AS rms, round(max(value) / 1000, 9) AS peak, count(*) AS n FROM events GROUP BY ALL)"""
