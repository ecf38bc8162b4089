"""The live path: frozen lines, turn updates, reading windows, running counts, and refreshes of an index."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PIECE = "meeting_id, seq, speaker, start_s, end_s, text, fed_s, committed_s"
FROZEN = "meeting_id string, segment long, speaker int, start_s double, end_s double, text string"


def frozen_lines(pieces: DataFrame, settle: float = 15.0) -> DataFrame:
    """Segments of a live transcript, each once, when they are final: ended before the audio fed less the settling time and before
    the last committed turn's end, and not the last one. Streaming.

    pieces: meeting_id, seq, speaker, start_s, end_s, text, fed_s (audio fed so far), committed_s (end of the committed turns). Pieces of a
    meeting come in order between micro-batches, and are sorted by seq within one. The state is a meeting's open segments: what the
    settling time covers.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, fed, committed, packed = state.get if state.exists else (0, 0.0, 0.0, "[]")
        open_ = json.loads(packed)
        rows = pd.concat(list(batches)).sort_values("seq")
        for speaker, start, end, text in zip(rows.speaker, rows.start_s, rows.end_s, rows.text, strict=True):
            if open_ and open_[-1][0] == int(speaker):
                open_[-1][2], open_[-1][3] = max(open_[-1][2], float(end)), open_[-1][3] + text
            else:
                open_.append([int(speaker), float(start), float(end), text])
        fed, committed = max(fed, float(rows.fed_s.max())), max(committed, float(rows.committed_s.max()))
        done = []
        while len(open_) > 1 and open_[0][2] <= min(fed - settle, committed):
            done.append((key[0], number, *open_.pop(0)))
            number += 1
        state.update((number, fed, committed, json.dumps(open_)))
        yield pd.DataFrame(done, columns=["meeting_id", "segment", "speaker", "start_s", "end_s", "text"])

    kept = "number long, fed double, committed double, open string"
    return pieces.groupBy("meeting_id").applyInPandasWithState(run, FROZEN, kept, "append", GroupStateTimeout.NoTimeout)


def settled_lines(pieces: DataFrame, settle: float = 15.0) -> DataFrame:
    """What frozen_lines() has emitted once all pieces are in, as a batch job."""
    w = Window.partitionBy("meeting_id").orderBy("seq")
    opens = F.coalesce((F.col("speaker") != F.lag("speaker").over(w)).cast("int"), F.lit(0))
    runs = pieces.withColumn("_o", opens).withColumn("segment", F.sum("_o").over(w)).groupBy("meeting_id", "segment")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
    segments = runs.agg(F.first("speaker").alias("speaker"), F.min_by("start_s", "seq").alias("start_s"), F.max("end_s").alias("end_s"), text.alias("text"))
    limits = pieces.groupBy("meeting_id").agg(F.least(F.max("fed_s") - settle, F.max("committed_s")).alias("_limit"))
    own = Window.partitionBy("meeting_id")
    latest = F.max("end_s").over(own.orderBy("segment").rowsBetween(Window.unboundedPreceding, 0))
    found = segments.join(limits, "meeting_id").withColumn("_latest", latest).withColumn("_last", F.max("segment").over(own))
    return found.where("_latest <= _limit and segment < _last").select("meeting_id", F.col("segment").cast("long").alias("segment"), "speaker", "start_s", "end_s", "text")


def upserted_turns(turns: DataFrame, within: float = 0.01) -> DataFrame:
    """Turns of which later statements (starts within ``within`` seconds) extend the end and replace label and confidence.
    turns: meeting_id, arrival, start_s, end_s, label, confidence."""
    w = Window.partitionBy("meeting_id").orderBy("start_s", "arrival")
    new = F.coalesce((F.col("start_s") - F.lag("start_s").over(w) > within).cast("int"), F.lit(1))
    same = turns.withColumn("_n", new).withColumn("_turn", F.sum("_n").over(w)).groupBy("meeting_id", "_turn")
    return same.agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.max_by("label", "arrival").alias("label"), F.max_by("confidence", "arrival").alias("confidence"), F.count("*").alias("statements")).drop("_turn")


def windowed(lines: DataFrame, budget: int = 1500) -> DataFrame:
    """Stable lines with the number of the reading window that they close into, as windows close. Streaming.
    lines: meeting_id, utt_idx, tokens. The state is the open window's token count and number."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window, used = state.get if state.exists else (0, 0)
        out = []
        rows = pd.concat(list(batches)).sort_values("utt_idx")
        for i, n in zip(rows.utt_idx, rows.tokens, strict=True):
            if used and used + int(n) > budget:
                window, used = window + 1, 0
            used += int(n)
            out.append((key[0], int(i), window))
        state.update((window, used))
        yield pd.DataFrame(out, columns=["meeting_id", "utt_idx", "window"])

    return lines.groupBy("meeting_id").applyInPandasWithState(run, "meeting_id long, utt_idx long, window int", "window int, used int", "append", GroupStateTimeout.NoTimeout)


def rollup(events: DataFrame) -> DataFrame:
    """Counts of a note-writer's events by meeting and window; serves batches and streams. events: meeting_id, window, kind, tokens."""
    kind = lambda x: F.count_if(F.col("kind") == x)
    return events.groupBy("meeting_id", "window").agg(F.sum("tokens").alias("tokens"), kind("kept").alias("kept"), kind("dropped").alias("dropped"), kind("error").alias("errors"))


def alarms(counts: DataFrame, least: int = 10, most: float = 0.2) -> DataFrame:
    """Meetings whose rate of errors is too high. counts: meeting_id, lines, off."""
    return counts.where((F.col("lines") >= least) & (F.col("off") / F.col("lines") > most))


def current_only(rows: DataFrame, generations: DataFrame) -> DataFrame:
    """Rows of a computation that nothing has overtaken: their generation is still the meeting's. Both: meeting_id, generation."""
    return rows.join(generations, ["meeting_id", "generation"], "left_semi")


def rewritten(live: DataFrame, final: DataFrame) -> DataFrame:
    """Live lines, but for meetings with a final transcript that one's alone."""
    return live.join(final.select("meeting_id").distinct(), "meeting_id", "left_anti").withColumn("is_final", F.lit(False)).unionByName(final.withColumn("is_final", F.lit(True)))


def replayed(spark: SparkSession, stream: DataFrame, folder: str, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All that a stream has to offer now, through its operators into a table below ``folder``, which is shared. In complete mode each
    micro-batch replaces the table, else it adds to it under its own number, so that a repeated one replaces itself."""
    out = f"{folder.rstrip('/')}/meetlake-{uuid.uuid4().hex}"

    def write(rows: DataFrame, number: int) -> None:
        rows = rows if each is None else each(rows)
        rows.write.mode("overwrite").parquet(f"{out}/rows/batch={0 if mode == 'complete' else number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    shown = stream if each is None else each(stream)
    return spark.read.schema(shown.schema).parquet(f"{out}/rows/*")
