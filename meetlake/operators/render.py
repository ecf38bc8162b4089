"""Meetings as texts: transcripts, subtitles, lyrics, and the facts of a mail."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meetlake.functions import text as X


# Signs that end a sentence or a part of one.
SENTENCE, COMMA = frozenset("。？！?!."), frozenset("，、,；;：:")
# An export's headings of transcript, summary, actions and notes.
HEADINGS = ("Transcript", "Summary", "Action items", "Agent")
WIDE = re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), X.WIDE) + "]")


def joined(rows: DataFrame, keys: list[str], order: str, line: Column, separator: str, name: str) -> DataFrame:
    """Lines of each key in order, as one text."""
    rows = rows.select(*keys, F.struct(F.col(order).alias("o"), line.alias("line")).alias("_x"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_x")), lambda x: x["line"]), separator).alias(name))


def transcript(lines: DataFrame, markdown: bool = False) -> DataFrame:
    """Lines that aren't blank, with clock and name. lines: meeting_id, utt_idx, start_s, name, text."""
    text, at = F.regexp_replace("text", r"^\s+|\s+$", ""), X.long_clock(F.col("start_s"))
    line = F.concat(F.lit("- `"), at, F.lit("` **"), "name", F.lit("** "), text) if markdown else F.concat(F.lit("["), at, F.lit("] "), "name", F.lit(": "), text)
    return joined(lines.where(text != ""), ["meeting_id"], "utt_idx", line, "\n", "transcript")


def rendered_notes(notes: DataFrame) -> DataFrame:
    """meeting_id and its notes as lines, in order. notes: meeting_id, note_id, ts, tag, text."""
    line = F.concat(F.lit("#"), F.col("note_id").cast("string"), F.lit(" ["), "ts", F.lit("] "), F.coalesce(F.concat(F.lit("("), "tag", F.lit(") ")), F.lit("")), "text")
    return notes.groupBy("meeting_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("note_id", line.alias("line")))), lambda x: x["line"]).alias("notes"))


def exported(lines: DataFrame, heads: DataFrame, markdown: bool = False, headings: tuple[str, ...] = HEADINGS) -> DataFrame:
    """Whole exports: title, summary, action items, notes and transcript; what is null or empty is left out with its heading. A meeting without lines or
    without a head has an export too. heads: meeting_id, title, summary, actions, notes (lines, as of rendered_notes())."""
    whole, summary, actions, notes = headings
    both = transcript(lines, markdown).join(heads, "meeting_id", "full")
    listed, title = F.coalesce("notes", F.array().cast("array<string>")), F.coalesce("title", F.lit(""))

    def part(text: Column, before: str, after: str = "\n\n") -> Column:
        return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.concat(F.lit(before), text, F.lit(after)))

    if markdown:
        head = F.concat(F.lit("# "), F.when(title == "", whole).otherwise(title), F.lit("\n\n"))
        parts = [part(F.col("summary"), f"## {summary}\n\n"), part(F.col("actions"), f"## {actions}\n\n"), part(F.array_join(F.transform(listed, lambda x: F.concat(F.lit("- "), x)), "\n"), f"## {notes}\n\n")]
        text = F.concat(head, *parts, F.lit(f"## {whole}\n\n"), F.coalesce("transcript", F.lit("")), F.lit("\n"))
    else:
        parts = [part(F.col("summary"), ""), part(F.col("actions"), f"{actions}\n"), part(F.array_join(listed, "\n"), "")]
        text = F.concat(title, F.lit("\n\n"), *parts, F.coalesce("transcript", F.lit("")))
    return both.select("meeting_id", text.alias("export"))


def lyrics(lines: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Lines that aren't blank as lyrics, each ended by a line feed; with titles (meeting_id, title) after a tag of the title, where there is one."""
    if titles is not None:
        tag = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("[ti:"), "title", F.lit("]\n"))).otherwise("")
        return lyrics(lines).join(titles, "meeting_id", "left").select("meeting_id", F.concat(tag, "lyrics").alias("lyrics"))
    text = F.trim(F.replace("text", F.lit("\n"), F.lit(" ")))
    line = F.concat(F.lit("["), X.lyric_clock(F.col("start_s")), F.lit("]"), "name", F.lit(": "), text)
    return joined(lines.where(text != ""), ["meeting_id"], "utt_idx", F.concat(line, F.lit("\n")), "", "lyrics")


def cut_cue(text: str, soft: int, hard: int) -> list[str]:
    """A text without a sentence's end inside, cut after a comma from ``soft`` cells on, and at ``hard`` cells back at the last space, which goes."""
    found, start, cells = [], 0, 0
    for i, ch in enumerate(text):
        cells += 2 if WIDE.match(ch) else 1
        if ch in SENTENCE or cells >= soft and ch in COMMA:
            stop, after = i + 1, i + 1
        elif cells >= hard:
            space = text.rfind(" ", start + 1, i + 1)
            stop, after = (space, space + 1) if space > start else (i + 1, i + 1)
        else:
            continue
        found.append(text[start:stop])
        start, cells = after, sum(2 if WIDE.match(c) else 1 for c in text[after : i + 1])
    return [*found, text[start:]]


def cues(lines: DataFrame, soft: int = 32, hard: int = 64) -> DataFrame:
    """Cues of each line: a line of up to ``hard`` cells is one; a longer one is cut after each sentence's end, and what is left with ``soft`` cells or
    more as cut_cue() cuts it. Pieces are trimmed, empty ones go, and times follow their shares of characters; a line that doesn't end after
    its start lasts a second. lines: meeting_id, utt_idx, start_s, end_s, name, text."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else cut_cue(x, soft, hard))

    text = X.one_cue(F.col("text"))
    end = F.when(F.col("end_s") > F.col("start_s"), F.col("end_s")).otherwise(F.col("start_s") + 1)
    shown = lines.select("meeting_id", "utt_idx", "name", "start_s", end.alias("end_s"), text.alias("_text")).where("_text <> ''")
    ended = F.split("_text", f"(?<=[{''.join(sorted(SENTENCE))}])")
    parts = shown.select("*", F.posexplode(F.when(X.width(F.col("_text")) <= hard, F.array("_text")).otherwise(ended)).alias("_s", "_part"))
    whole_ = (F.col("_part") == F.col("_text")) & (X.width(F.col("_text")) <= hard)
    fine = whole_ | (X.width(F.col("_part")) < soft)
    pieces = parts.withColumn("_cut", cut(F.when(~fine, F.col("_part")))).select("*", F.posexplode(F.coalesce("_cut", F.array("_part"))).alias("_c", "_piece"))
    pieces = pieces.withColumn("_piece", F.when(whole_, F.col("_piece")).otherwise(F.regexp_replace("_piece", r"^[ \t]+|[ \t]+$", ""))).where("_piece <> ''")
    w = Window.partitionBy("meeting_id", "utt_idx")
    ordered, n = w.orderBy("_s", "_c"), F.char_length("_piece")
    used, whole = F.sum(n).over(ordered), F.sum(n).over(w)
    long = F.col("end_s") - F.col("start_s")
    return pieces.select(
        "meeting_id", "utt_idx", (F.row_number().over(ordered) - 1).alias("cue"), "name", (F.col("start_s") + long * (used - n) / whole).alias("start_s"), (F.col("start_s") + long * used / whole).alias("end_s"), F.col("_piece").alias("text")
    )


def subtitles(cue_rows: DataFrame, vtt: bool = False) -> DataFrame:
    """An SRT or VTT text for each meeting."""
    n = F.row_number().over(Window.partitionBy("meeting_id").orderBy("utt_idx", "cue"))
    rows = cue_rows.withColumn("n", n)
    times = lambda sign: F.concat(X.subtitle_clock(F.col("start_s"), sign), F.lit(" --> "), X.subtitle_clock(F.col("end_s"), sign), F.lit("\n"))
    if vtt:
        line = F.concat(times("."), X.escape_markup(X.one_cue(F.col("name"))), F.lit(": "), X.escape_markup(F.col("text")), F.lit("\n"))
        return joined(rows, ["meeting_id"], "n", line, "\n", "subtitles").withColumn("subtitles", F.concat(F.lit("WEBVTT\n\n"), "subtitles"))
    line = F.concat(F.col("n").cast("string"), F.lit("\n"), times(","), X.one_cue(F.col("name")), F.lit(": "), "text", F.lit("\n"))
    return joined(rows, ["meeting_id"], "n", line, "\n", "subtitles")


def facts(lines: DataFrame) -> DataFrame:
    """Participants by name as they first speak, unnamed speakers, and length in minutes (half to even). lines: name is null if unnamed."""
    firsts = lines.where("name is not null").groupBy("meeting_id", "name").agg(F.min("speaker").alias("o"))
    names = joined(firsts, ["meeting_id"], "o", F.col("name"), ", ", "participants")
    whole = lines.groupBy("meeting_id").agg(F.max("end_s").alias("seconds"), F.countDistinct(F.when(F.col("name").isNull(), F.col("speaker"))).alias("unnamed"))
    return whole.join(names, "meeting_id", "left").select("meeting_id", F.coalesce("participants", F.lit("")).alias("participants"), "unnamed", F.bround(F.col("seconds") / 60).cast("int").alias("minutes"))


def owner_groups(items: DataFrame, names: DataFrame) -> DataFrame:
    """Action items under their owners (``S2:`` at the start), owners as they first appear, those without an owner last; where no item
    of a meeting has one they aren't grouped. items: meeting_id, pos, text; names: meeting_id, speaker, name."""
    form = r"^S(\d+)\s*[:：]\s*"
    number = F.regexp_extract("text", form, 1).try_cast("int") - 1
    owned = items.withColumn("speaker", number).join(names, ["meeting_id", "speaker"], "left")
    own = owned.withColumn("owner", F.when(F.col("speaker").isNotNull(), F.coalesce("name", F.format_string("Speaker %d", F.col("speaker") + 1))))
    line = F.when(F.col("owner").isNotNull(), F.regexp_replace("text", form, "")).otherwise(F.col("text"))
    groups = own.withColumn("line", line).groupBy("meeting_id", "owner").agg(F.min("pos").alias("first"), F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("items"))
    order = Window.partitionBy("meeting_id").orderBy(F.col("owner").isNull(), "first")
    return groups.withColumn("ord", F.row_number().over(order)).select("meeting_id", "ord", "owner", "n", "items")
