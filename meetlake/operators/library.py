"""The library of meetings: finishing, updating, deleting and listing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meetlake.functions import text as X


def speech(lines: DataFrame) -> DataFrame:
    """Whether a meeting's lines have a letter or digit outside sound tags."""
    return lines.groupBy("meeting_id").agg(F.bool_or(X.clean(F.col("text")).rlike(r"[\p{L}\p{N}]")).alias("has_speech"))


def finalised(meetings: DataFrame, default: str = "Meeting") -> DataFrame:
    """Titles by precedence (the source's, the generated one, the first line's first 20 characters), and no notes without speech."""
    own = lambda c: F.nullif(F.trim(c), F.lit(""))
    title = F.coalesce(own("source_title"), own("generated_title"), own(F.substring("first_line", 1, 20)), F.lit(default))
    spoken = F.col("has_speech")
    return meetings.select("meeting_id", title.alias("title"), F.when(spoken, F.col("notes")).alias("notes"), F.when(spoken, "done").otherwise("no speech").alias("status"))


def finished(runs: DataFrame, stored: DataFrame, started: DataFrame, silent: str = "No speech", nothing: str = "No notes", default: str = "Meeting") -> DataFrame:
    """What a run leaves in the library: meeting_id, title, summary, notes, reader, lines_from and names_from.

    A meeting without speech has no notes and a status for title and summary (a summary that says more stays); else the generated title counts, then the
    first line's first 20 characters, then the default. A title that came with the recording comes before all of these. A run that only wrote a new
    summary keeps the stored lines and names as they are now, and the stored title if it isn't the one with which the run ``started``; a new
    transcript of a meeting that has named speakers carries these names over (timeline.carried_names()).

    runs: meeting_id, kind (new, summary, transcript), source_title, generated_title, first_line (null: no lines), summary, notes, reader, has_speech;
    stored: meeting_id, title, named (has named speakers and lines); started: meeting_id, title.
    """
    said = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    now = stored.select("meeting_id", F.col("title").alias("_now"), F.col("named").alias("_named"))
    both = runs.join(now, "meeting_id", "left").join(started.select("meeting_id", F.col("title").alias("_then")), "meeting_id", "left")
    own = F.when(~F.col("has_speech"), silent).when(said("generated_title"), F.col("generated_title")).otherwise(F.coalesce(F.substring("first_line", 1, 20), F.lit(default)))
    title = F.when(said("source_title"), F.col("source_title")).otherwise(own)
    again = (F.col("kind") == "summary") & F.col("_now").isNotNull()
    edited = again & ~F.col("_now").eqNullSafe(F.col("_then"))
    summary = F.when(~F.col("has_speech") & (~said("summary") | (F.col("summary") == nothing)), silent).otherwise(F.coalesce("summary", F.lit("")))
    carried = (F.col("kind") == "transcript") & F.coalesce("_named", F.lit(False)) & F.col("first_line").isNotNull()
    return both.select(
        "meeting_id", F.when(edited, F.col("_now")).otherwise(title).alias("title"), summary.alias("summary"), F.when(F.col("has_speech"), F.col("notes")).alias("notes"), F.when(F.col("has_speech") & (summary != ""), F.col("reader")).alias("reader"),
        F.when(again, "stored").otherwise("run").alias("lines_from"), F.when(again, "stored").when(carried, "carried").otherwise("run").alias("names_from"),
    )


def found_first(meetings: DataFrame, hits: DataFrame) -> DataFrame:
    """The meetings of a list that a search has found, with ``rank`` in the order of its hits. hits: query_id, meeting_id, rank."""
    return meetings.join(hits.select("query_id", "meeting_id", "rank"), "meeting_id")


def upserted(rows: DataFrame, updates: DataFrame, gone: DataFrame, key: str = "meeting_id", version: str = "version") -> DataFrame:
    """The latest version of each row that isn't deleted."""
    both = rows.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))  # of equal versions the update counts, then the larger row
    order = [F.desc(version), F.desc("_new"), *(F.desc(c) for c in rows.columns)]
    latest = both.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r", "_new")
    return latest.join(gone, key, "left_anti")


def cascaded(children: DataFrame, gone: DataFrame, key: str = "meeting_id") -> DataFrame:
    """A child table without the rows of deleted meetings."""
    return children.join(gone, key, "left_anti")


def kept_audio(gone: DataFrame, audio: DataFrame) -> DataFrame:
    """Of deleted meetings' recordings, those that nothing else uses. audio: meeting_id, audio."""
    theirs = audio.join(gone, "meeting_id").select("audio").distinct()
    return theirs.join(audio.join(gone, "meeting_id", "left_anti"), "audio", "left_anti")


def days(meetings: DataFrame) -> DataFrame:
    """Meetings by day, with how many are done and the last one's number."""
    return meetings.groupBy(F.to_date("date").alias("day")).agg(F.count("*").alias("meetings"), F.count_if("done").alias("done"), F.max("meeting_id").alias("last_meeting"))


def filtered(meetings: DataFrame, links: DataFrame, person: str | None = None, done_only: bool = False) -> DataFrame:
    """The library as shown: all or done meetings, of everybody or one person, newest first."""
    shown = meetings.where("done") if done_only else meetings
    if person is not None:
        shown = shown.join(links.where(F.col("person_id") == person).select("meeting_id").distinct(), "meeting_id", "left_semi")
    return shown.orderBy(F.desc("date"), "meeting_id")


def stale_summaries(meetings: DataFrame, reader: str) -> DataFrame:
    """Meetings whose summary another reader wrote, and whose recording is there."""
    return meetings.where((F.col("reader") != reader) & (F.coalesce("summary", F.lit("")) != "") & F.col("audio").isNotNull())


def unprocessed(jobs: DataFrame, meetings: DataFrame) -> DataFrame:
    """Recordings that no meeting was made of yet."""
    return jobs.join(meetings, "meeting_id", "left_anti")
