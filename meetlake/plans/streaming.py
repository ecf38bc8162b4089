"""Registered queries of the live path: streams over the given tables, run until they have read all."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlake.functions import text as X
from meetlake.plans import adapters as A
from meetlake.plans import passages
from meetlake.streaming import live as V


def folder(spark: SparkSession) -> str:
    """The folder that all machines share; a temporary one where none is set."""
    sc = spark.sparkContext
    return sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir() or f"file://{tempfile.mkdtemp(prefix='meetlake-')}"


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    schema = A.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def pieces(rows: DataFrame) -> DataFrame:
    """Events as live pieces of a day: four speakers, half a minute each."""
    at = F.hour("ts") * 3600.0 + F.minute("ts") * 60 + F.second("ts")
    return rows.select(
        F.col("ts").cast("date").cast("string").alias("meeting_id"), F.col("event_id").alias("seq"), (F.col("user_id") % 4).cast("int").alias("speaker"), at.alias("start_s"), (at + 30).alias("end_s"),
        F.concat(F.col("event_type"), F.lit(" ")).alias("text"), (at + 30).alias("fed_s"), (at + 25).alias("committed_s"),
    )


def live_freeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.replayed(spark, V.frozen_lines(pieces(streamed(spark, sf_dir, "events"))), folder(spark))


FREEZE = """WITH p AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS meeting_id, event_id AS seq, CAST(user_id % 4 AS INT) AS speaker, hour(ts) * 3600.0::DOUBLE + minute(ts) * 60 + second(ts) AS a, event_type || ' ' AS text FROM events),
o AS (SELECT *, CASE WHEN speaker <> lag(speaker) OVER (PARTITION BY meeting_id ORDER BY seq) THEN 1 ELSE 0 END AS o FROM p),
r AS (SELECT *, sum(o) OVER (PARTITION BY meeting_id ORDER BY seq) AS segment FROM o),
s AS (SELECT meeting_id, segment, any_value(speaker) AS speaker, arg_min(a, seq) AS start_s, max(a) + 30 AS end_s, string_agg(text, '' ORDER BY seq) AS text FROM r GROUP BY ALL),
l AS (SELECT meeting_id, least(max(a) + 15, max(a) + 25) AS lim FROM p GROUP BY ALL),
k AS (SELECT s.*, max(end_s) OVER (PARTITION BY s.meeting_id ORDER BY segment) AS latest, max(segment) OVER (PARTITION BY s.meeting_id) AS last, lim FROM s JOIN l ON l.meeting_id = s.meeting_id)
SELECT meeting_id, CAST(segment AS BIGINT) AS segment, speaker, start_s, end_s, text FROM k WHERE latest <= lim AND segment < last"""


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streamed(spark, sf_dir, "conversations")
    lines = rows.select(F.col("conv_id").alias("meeting_id"), F.col("turn").alias("utt_idx"), X.token_estimate(F.col("text")).alias("tokens"))
    # Turns of one conversation may lie in several files; a window closes by order, so all files make one micro-batch here.
    return V.replayed(spark, V.windowed(lines, 300), folder(spark))


def event_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "kept").when(F.col("event_type") == "view", "dropped").when(F.col("event_type") == "error", "error").otherwise("fed")
    rows = streamed(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("meeting_id"), F.hour("ts").alias("window"), kind.alias("kind"), F.floor("value").alias("tokens"))
    return V.replayed(spark, V.rollup(rows), folder(spark), "complete")


ROLLUP = """SELECT user_id % 20 AS meeting_id, CAST(hour(ts) AS INT) AS "window", CAST(sum(floor(value)) AS BIGINT) AS tokens, count(*) FILTER (WHERE event_type = 'purchase') AS kept, count(*) FILTER (WHERE event_type = 'view') AS dropped,
count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY ALL"""


def guard_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streamed(spark, sf_dir, "events").groupBy(F.col("user_id").alias("meeting_id")).agg(F.count("*").alias("lines"), F.count_if(F.col("event_type") == "error").alias("off"))
    return V.replayed(spark, rows, folder(spark), "complete", V.alarms)


GUARD = """SELECT user_id AS meeting_id, count(*) AS lines, count(*) FILTER (WHERE event_type = 'error') AS off FROM events GROUP BY ALL
HAVING count(*) >= 10 AND count(*) FILTER (WHERE event_type = 'error') / count(*) > 0.2"""


def turn_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.turns(spark, sf_dir).select("meeting_id", F.col("turn_id").alias("arrival"), F.floor(F.col("start_s") / 300).cast("double").alias("start_s"), "end_s", F.col("speaker").cast("string").alias("label"), (F.col("end_s") * 2).alias("confidence"))
    return V.upserted_turns(rows)


UPSERT = f"""WITH {A.TURNS} SELECT meeting_id, floor(start_s / 300) AS start_s, max(end_s) AS end_s, CAST(arg_max(speaker, turn_id) AS VARCHAR) AS label, arg_max(end_s * 2, turn_id) AS confidence, count(*) AS statements FROM turns GROUP BY meeting_id, floor(start_s / 300)"""


def generation_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders computed under their customer's old generation are overtaken where that has moved on."""
    rows = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("meeting_id"), (F.col("o_orderkey") % 2).alias("generation"), "o_orderkey")
    now = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("meeting_id"), (F.col("c_nationkey") % 2).cast("long").alias("generation"))
    return V.current_only(rows, now)


GENERATION = "SELECT o_custkey AS meeting_id, o_orderkey % 2 AS generation, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 2 = c_nationkey % 2"


def final_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = A.utterances(spark, sf_dir).select("meeting_id", "utt_idx", "speaker")
    final = lines.where("meeting_id % 3 = 0").withColumn("speaker", F.col("speaker") + 10)
    return V.rewritten(lines, final)


REWRITE = f"WITH {A.UTT} SELECT meeting_id, utt_idx, CASE WHEN meeting_id % 3 = 0 THEN speaker + 10 ELSE speaker END AS speaker, meeting_id % 3 = 0 AS is_final FROM utt"


QUERIES = {
    "live_freeze": (live_freeze, FREEZE),
    "stream_windows": (stream_windows, passages.READ_WINDOWS_SQL.replace("utt_idx, part FROM st", "utt_idx, part AS \"window\" FROM st")),
    "event_rollup": (event_rollup, ROLLUP),
    "guard_stream": (guard_stream, GUARD),
    "turn_upsert": (turn_upsert, UPSERT),
    "generation_guard": (generation_guard, GENERATION),
    "final_rewrite": (final_rewrite, REWRITE),
}
