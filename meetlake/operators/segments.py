"""Segmentation of a meeting's sound and text: islands of frames and pieces, votes, and level decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meetlake.functions import text as X


def turn_islands(probs: DataFrame, at_least: float = 0.5, pad: int = 20, frames: int = 1) -> DataFrame:
    """Turns: runs of frames of a speaker at or above a probability, padded on both sides within the meeting's frames, if long
    enough, with their mean. probs: meeting_id, frame, speaker, prob (one row for each frame and speaker)."""
    last = probs.groupBy("meeting_id").agg(F.max("frame").alias("_last"))
    w = Window.partitionBy("meeting_id", "speaker").orderBy("frame")
    runs = probs.where(F.col("prob") >= at_least).withColumn("_run", F.col("frame") - F.row_number().over(w))
    turns = runs.groupBy("meeting_id", "speaker", "_run").agg(F.min("frame").alias("_a"), (F.max("frame") + 1).alias("_b"), F.avg("prob").alias("confidence"))
    turns = turns.where(F.col("_b") - F.col("_a") >= frames).join(last, "meeting_id")
    return turns.select("meeting_id", "speaker", F.greatest(F.lit(0).cast("long"), F.col("_a") - pad).alias("start_frame"), F.least(F.col("_last") + 1, F.col("_b") + pad).alias("end_frame"), "confidence")


def at_share(values: DataFrame, keys: list[str], value: str, order: list, shares: dict[str, float]) -> DataFrame:
    """Elements at int(share * (n - 1)) of the sorted values, by name: no interpolation."""
    w = Window.partitionBy(*keys)
    ranked = values.withColumn("_i", F.row_number().over(w.orderBy(value, *order)) - 1).withColumn("_n", F.count("*").over(w))
    return ranked.groupBy(*keys).agg(*(F.max(F.when(F.col("_i") == F.floor(F.lit(s) * (F.col("_n") - 1)), F.col(value))).alias(name) for name, s in shares.items()))


def voiced_runs(frames: DataFrame, gap: int = 10, least: int = 15) -> DataFrame:
    """Runs of frames louder than the highest of three floors (30 dB below the 95th percentile, -55 dB, 6 dB above the 10th), with gaps
    under ``gap`` frames bridged and runs under ``least`` dropped. frames: meeting_id, frame, db."""
    floors = at_share(frames, ["meeting_id"], "db", ["frame"], {"_p95": 0.95, "_p10": 0.10})
    loud = frames.join(floors, "meeting_id").where(F.col("db") > F.greatest(F.col("_p95") - 30, F.lit(-55.0), F.col("_p10") + 6))
    w = Window.partitionBy("meeting_id").orderBy("frame")
    opens = F.coalesce(F.col("frame") - F.lag("frame").over(w) - 1 >= gap, F.lit(True))
    runs = loud.withColumn("_new", opens.cast("int")).withColumn("run", F.sum("_new").over(w)).groupBy("meeting_id", "run")
    runs = runs.agg(F.min("frame").alias("start_frame"), (F.max("frame") + 1).alias("end_frame"))
    return runs.where(F.col("end_frame") - F.col("start_frame") >= least).drop("run")


def speaker_segments(pieces: DataFrame) -> DataFrame:
    """Runs of pieces of one speaker, untagged pieces staying in the open run; speakers are numbered as they appear.
    pieces: meeting_id, pos, speaker (null: untagged), start_s, end_s, text."""
    w = Window.partitionBy("meeting_id").orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    tagged = pieces.withColumn("_s", F.coalesce("speaker", F.last("speaker", ignorenulls=True).over(before)))
    opens = F.coalesce(F.col("_s") != F.lag("_s").over(w), F.col("_s").isNotNull() | F.lag("pos").over(w).isNull()).cast("int")
    runs = tagged.withColumn("_open", opens).withColumn("segment", F.sum("_open").over(w)).groupBy("meeting_id", "segment")
    runs = runs.agg(
        F.first("_s", ignorenulls=True).alias("label"), F.min("pos").alias("first_pos"), F.count("*").alias("pieces"), F.sum(F.col("speaker").isNull().cast("int")).alias("untagged"),
        F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda p: p["text"]), "").alias("text"),
    )
    first = F.min("first_pos").over(Window.partitionBy("meeting_id", "label"))
    return runs.withColumn("_first", first).withColumn("speaker", F.dense_rank().over(Window.partitionBy("meeting_id").orderBy("_first")) - 1).drop("_first")


def word_vote(chars: DataFrame) -> DataFrame:
    """Each word (run of ASCII letters, digits and apostrophes; any other character alone) with the speaker and flag that most of its
    characters have. chars: meeting_id, pos, ch, label, snapped, confidence."""
    w = Window.partitionBy("meeting_id").orderBy("pos")
    inner = F.col("ch").rlike("^[A-Za-z0-9']$")
    joined = inner & F.coalesce(F.lag(inner).over(w), F.lit(False))
    words = chars.withColumn("_new", (~joined).cast("int")).withColumn("word", F.sum("_new").over(w))
    votes = words.groupBy("meeting_id", "word", "label", "snapped").agg(F.count("*").alias("n"), F.min("confidence").alias("confidence"), F.collect_list(F.struct("pos", "ch")).alias("_c"))
    text = F.array_join(F.transform(F.array_sort(F.flatten(F.collect_list("_c"))), lambda c: c["ch"]), "")
    won = votes.groupBy("meeting_id", "word").agg(text.alias("text"), F.min_by(F.struct("label", "snapped", "confidence"), F.struct(-F.col("n"), "label", "snapped")).alias("v"))
    return won.select("meeting_id", "word", "text", "v.label", "v.snapped", "v.confidence")


def place_characters(deltas: DataFrame, per_char: float = 0.09) -> DataFrame:
    """Characters of text deltas placed at the right end of their delta's span, ``per_char`` seconds each (less where they don't fit).
    deltas: meeting_id, delta, start_s, end_s, text."""
    n = F.char_length("text")
    step = F.least(F.lit(per_char), (F.col("end_s") - F.col("start_s")) / F.greatest(F.lit(1), n))
    each = deltas.withColumn("_step", step).withColumn("_from", F.col("end_s") - n * F.col("_step"))
    each = each.select("*", F.posexplode(F.split("text", "")).alias("i", "ch")).where("ch <> ''")
    return each.select("meeting_id", "delta", "i", "ch", (F.col("_from") + F.col("i") * F.col("_step")).alias("start_s"), (F.col("_from") + (F.col("i") + 1) * F.col("_step")).alias("end_s"))


def gain(frames: DataFrame, quiet: float = 0.003, target: float = 0.045, most: float = 8.0, lead: int = 100) -> DataFrame:
    """Input gain of a recording, decided on its first audible frames: 1 unless their 95th percentile is under the target, and never so much
    that the peak's would clip. frames: meeting_id, frame, rms, peak."""
    w = Window.partitionBy("meeting_id").orderBy("frame")
    audible = frames.where(F.col("rms") > quiet).withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= lead)
    level = at_share(audible, ["meeting_id"], "rms", ["frame"], {"level": 0.95})
    cap = at_share(audible, ["meeting_id"], "peak", ["frame"], {"cap": 0.999})
    wanted = F.least(F.lit(most), F.lit(target) / F.col("level"), F.lit(0.98) / F.greatest(F.col("cap"), F.lit(1e-6)))
    return level.join(cap, "meeting_id").withColumn("gain", F.when(F.col("level") < target, F.greatest(F.lit(1.0), wanted)).otherwise(1.0))


def delta_spans(deltas: DataFrame) -> DataFrame:
    """Deltas charged with the audio since the last charged point. deltas: meeting_id, seq, horizon_s."""
    w = Window.partitionBy("meeting_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    charged = F.coalesce(F.max("horizon_s").over(w), F.lit(0.0))
    return deltas.withColumn("from_s", charged).withColumn("to_s", F.greatest("horizon_s", charged))


def speaker_changes(lines: DataFrame) -> DataFrame:
    """Lines that another speaker's line precedes, with that speaker."""
    before = F.lag("speaker").over(Window.partitionBy("meeting_id").orderBy("utt_idx"))
    return lines.withColumn("before", before).where("before <> speaker").select("meeting_id", "utt_idx", "before", "speaker", F.col("start_s").alias("at"))


def closed_segments(pieces: DataFrame, seconds: float = 10.0) -> DataFrame:
    """Segments of one speaker each, closed before a piece of the same speaker that comes ``seconds`` or more after their start and a
    sentence's end, or twice as long after it; untagged pieces stay in the open segment and close none.

    Punctuation at the head of another speaker's piece goes back to the open segment; a piece of nothing else changes no speaker.
    pieces: meeting_id, pos, speaker (null: untagged), start_s, end_s, text (not empty). A fold over each speaker's run.
    """
    w = Window.partitionBy("meeting_id").orderBy("pos")
    head = X.leading_marks(F.col("text"))
    bare = (head == F.col("text")) & (F.row_number().over(w) > 1)
    rows = pieces.withColumn("_bare", bare).withColumn("_open", F.last(F.when(~F.col("_bare"), F.col("speaker")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    starts = F.row_number().over(w) > 1
    turns = starts & F.col("speaker").isNotNull() & ~F.col("speaker").eqNullSafe(F.col("_open"))
    rows = rows.withColumn("_turns", turns).withColumn("_head", F.when(F.col("_turns"), head).otherwise(""))
    # What is handed back stands as a row of its own before the piece, without a speaker or times.
    part = lambda k, speaker, text, a, b: F.struct(F.lit(k).alias("k"), speaker.alias("speaker"), text.alias("text"), a.alias("start_s"), b.alias("end_s"))
    none = F.lit(None)
    back = F.when(F.col("_head") != "", part(0, none.cast(pieces.schema["speaker"].dataType), F.col("_head"), none.cast("double"), none.cast("double")))
    own = F.when(F.char_length("_head") < F.char_length("text"), part(1, F.col("speaker"), F.col("text").substr(F.char_length("_head") + 1, F.char_length("text")), F.col("start_s"), F.col("end_s")))
    each = rows.select("meeting_id", "pos", F.explode(F.filter(F.array(back, own), lambda x: x.isNotNull())).alias("x")).select("meeting_id", "pos", "x.*")
    w = Window.partitionBy("meeting_id").orderBy("pos", "k")
    tagged = each.withColumn("_s", F.coalesce("speaker", F.last("speaker", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))))
    opens = F.coalesce(F.col("_s") != F.lag("_s").over(w), F.col("_s").isNotNull() | F.lag("pos").over(w).isNull()).cast("int")
    runs = tagged.withColumn("_new", opens).withColumn("run", F.sum("_new").over(w)).groupBy("meeting_id", "run")
    runs = runs.agg(F.first("_s", ignorenulls=True).alias("speaker"), F.array_sort(F.collect_list(F.struct("pos", "k", F.col("speaker").isNotNull().alias("own"), "text", "start_s", "end_s"))).alias("rows"))

    def step(s: Column, x: Column) -> Column:
        long = s["b"] - s["a"]
        shut = x["own"] & s["text"].isNotNull() & (((long >= seconds) & X.ends_sentence(s["text"])) | (long >= 2 * seconds))
        fresh = s["text"].isNull() | shut
        made = F.struct(s["first"].alias("first"), s["a"].alias("start_s"), s["b"].alias("end_s"), s["text"].alias("text"))
        done = F.when(shut, F.concat(s["done"], F.array(made))).otherwise(s["done"])
        a = F.when(fresh, x["start_s"]).otherwise(s["a"])
        return F.struct(F.when(fresh, x["pos"].cast("long")).otherwise(s["first"]).alias("first"), a.alias("a"), F.when(fresh, x["end_s"]).otherwise(F.greatest(s["b"], x["end_s"])).alias("b"), F.when(fresh, x["text"]).otherwise(F.concat(s["text"], x["text"])).alias("text"), done.alias("done"))

    start = F.expr("named_struct('first', cast(null as bigint), 'a', cast(null as double), 'b', cast(null as double), 'text', cast(null as string), 'done', cast(array() as array<struct<first:bigint,start_s:double,end_s:double,text:string>>))")
    folded = runs.withColumn("s", F.aggregate("rows", start, step))
    last = F.struct(F.col("s.first").alias("first"), F.col("s.a").alias("start_s"), F.col("s.b").alias("end_s"), F.col("s.text").alias("text"))
    found = folded.select("meeting_id", "run", "speaker", F.posexplode(F.concat("s.done", F.array(last))).alias("part", "x")).select("meeting_id", "run", "part", "speaker", "x.*")
    return found.withColumn("segment", F.row_number().over(Window.partitionBy("meeting_id").orderBy("run", "part"))).drop("run", "part")
