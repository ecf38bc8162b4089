"""Passages of a meeting: chunks, reading windows, texts, and what of an index must be made anew."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meetlake.functions import text as X

# Signs after which a line that is too long is cut.
CUTS = frozenset("。？！?!；;，,")


def in_order(lines: DataFrame, *fields: str) -> DataFrame:
    """One row for each meeting, with its lines as an array sorted by utt_idx. A meeting has at most some thousands of lines."""
    return lines.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("utt_idx", *fields))).alias("lines"))


def chunks(lines: DataFrame, tokens: int = 200, seconds: float = 40.0) -> DataFrame:
    """meeting_id, chunk, a, b (positions of lines from 0): lines are added while tokens and seconds allow; the next chunk starts at the
    last line of one with several. lines: meeting_id, utt_idx, start_s, end_s, tokens.

    A fold that holds the open chunk (first line, tokens, start) and the finished ones. A line that doesn't fit closes the
    chunk; it is then alone, or joins the last line if the two fit.
    """
    def step(state: Column, line: Column, i: Column) -> Column:
        fits = (state["tokens"] + line["tokens"] <= tokens) & (line["end_s"] - state["start"] <= seconds)
        last_fits = (state["last_tokens"] + line["tokens"] <= tokens) & (line["end_s"] - state["last_start"] <= seconds)
        shared = state["a"] < i - 1
        made = F.struct(state["a"].alias("a"), (i - 1).alias("b"))
        # After a chunk with several lines the next has that chunk's last line; if this line doesn't fit with it, it stands alone.
        alone = F.struct((i - 1).alias("a"), (i - 1).alias("b"))
        opened = lambda a, n, t, done: F.struct(a.alias("a"), n.alias("tokens"), t.alias("start"), line["tokens"].alias("last_tokens"), line["start_s"].alias("last_start"), done.alias("done"))
        return (
            F.when(i == 0, opened(F.lit(0), line["tokens"], line["start_s"], state["done"]))
            .when(fits, opened(state["a"], state["tokens"] + line["tokens"], state["start"], state["done"]))
            .when(shared & last_fits, opened(i - 1, state["last_tokens"] + line["tokens"], state["last_start"], F.concat(state["done"], F.array(made))))
            .when(shared, opened(i, line["tokens"], line["start_s"], F.concat(state["done"], F.array(made, alone))))
            .otherwise(opened(i, line["tokens"], line["start_s"], F.concat(state["done"], F.array(made))))
        )

    meetings = in_order(lines, "start_s", "end_s", "tokens")
    numbered = F.transform("lines", lambda x, i: F.struct(i.alias("i"), x["start_s"].alias("start_s"), x["end_s"].alias("end_s"), x["tokens"].cast("int").alias("tokens")))
    none = F.expr("cast(array() as array<struct<a:int,b:int>>)")
    start = F.struct(F.lit(0).alias("a"), F.lit(0).alias("tokens"), F.lit(0.0).alias("start"), F.lit(0).alias("last_tokens"), F.lit(0.0).alias("last_start"), none.alias("done"))
    n = F.size("lines")
    folded = meetings.withColumn("s", F.aggregate(numbered, start, lambda s, x: step(s, x, x["i"])))
    last = F.struct(F.col("s.a").alias("a"), (n - 1).alias("b"))
    tail = F.when(F.col("s.a") < n - 1, F.array(last, F.struct((n - 1).alias("a"), (n - 1).alias("b")))).otherwise(F.array(last))
    return folded.select("meeting_id", F.posexplode(F.concat("s.done", tail)).alias("chunk", "c")).select("meeting_id", "chunk", "c.a", "c.b")


def parts(lines: DataFrame, budget: int, name: str = "part") -> DataFrame:
    """Lines with the number of their part: a part closes before the line that would pass the budget. lines: meeting_id, utt_idx, tokens."""
    def step(s: Column, x: Column) -> Column:
        closes = (s["n"] > 0) & (s["n"] + x["tokens"] > budget)
        n, part = F.when(closes, x["tokens"]).otherwise(s["n"] + x["tokens"]), s["part"] + closes.cast("int")
        return F.struct(n.alias("n"), part.alias("part"), F.concat(s["out"], F.array(F.struct(x["utt_idx"].alias("utt_idx"), part.alias("part")))).alias("out"))

    meetings = lines.select("meeting_id", F.col("utt_idx").cast("long").alias("utt_idx"), F.col("tokens").cast("int").alias("tokens"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("part"), F.expr("cast(array() as array<struct<utt_idx:bigint,part:int>>)").alias("out"))
    folded = in_order(meetings, "tokens").select("meeting_id", F.explode(F.aggregate("lines", start, step)["out"]).alias("o"))
    return folded.select("meeting_id", "o.utt_idx", F.col("o.part").alias(name))


def span_texts(spans: DataFrame, lines: DataFrame, cut: int | None = None) -> DataFrame:
    """Spans (meeting_id, a, b and others) with the text of their lines, joined by spaces, cut to a length, and the first line's start."""
    keys = spans.columns
    joined = spans.join(lines.select("meeting_id", "utt_idx", "start_s", F.col("text").alias("_text")), "meeting_id").where("utt_idx between a and b")
    found = joined.groupBy(*keys).agg(F.min("start_s").alias("start_s"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("utt_idx", "_text"))), lambda x: x["_text"]), " ").alias("text"))
    return found if cut is None else found.withColumn("text", F.substring("text", 1, cut))


def reused(wanted: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Passages whose vector is stored for the same model and text, and those to embed. Both: model_id, text_hash, text."""
    keys = ["model_id", "text_hash", "text"]
    return wanted.join(stored.dropDuplicates(keys), keys), wanted.join(stored, keys, "left_anti")


def stale(meetings: DataFrame, index: DataFrame) -> DataFrame:
    """Meetings without an index of the current model and content. Both: meeting_id, model_id, fingerprint."""
    return meetings.join(index, ["meeting_id", "model_id", "fingerprint"], "left_anti")


def fingerprints(lines: DataFrame) -> DataFrame:
    """A digest of each meeting's lines: starts, speakers and texts in order."""
    row = F.concat_ws("|", F.col("utt_idx").cast("string"), F.col("speaker").cast("string"), "text")
    rows = lines.select("meeting_id", "utt_idx", row.alias("row")).groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("utt_idx", "row"))).alias("rows"))
    return rows.select("meeting_id", F.sha2(F.array_join(F.transform("rows", lambda x: x["row"]), "\n"), 256).alias("fingerprint"))


def units(notes: DataFrame, chunks_: DataFrame, meetings: DataFrame, cut: int = 200, least: int = 6) -> DataFrame:
    """What an index holds of each meeting: notes of ``least`` characters and more, chunks, and the meeting itself by its title or its summary's
    first line; texts are cut. notes: meeting_id, note_idx, text; chunks: meeting_id, a, b, text; meetings: meeting_id, title, summary.
    Returns meeting_id, kind, a, b, text."""
    note = notes.where(F.char_length("text") >= least).select("meeting_id", F.lit("note").alias("kind"), F.col("note_idx").cast("long").alias("a"), F.col("note_idx").cast("long").alias("b"), "text")
    chunk = chunks_.select("meeting_id", F.lit("chunk").alias("kind"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "text")
    shown = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.nullif(F.trim(F.substring_index(F.regexp_replace("summary", r"^\s+", ""), "\n", 1)), F.lit("")))
    whole = meetings.select("meeting_id", F.lit("meeting").alias("kind"), F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b"), shown.alias("text")).where("text is not null")
    return note.unionByName(chunk).unionByName(whole).withColumn("text", F.substring("text", 1, cut))


def cut_long(text: str, header: str, budget: int, tokens: Callable[[str], int]) -> list[str]:
    """Pieces of a text, each with its header within the budget: as much as fits, back to a sign in its second half where there is one."""
    rest, found = text, []
    while rest:
        low, high = 1, len(rest)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if tokens(header + rest[:middle]) <= budget else (low, middle - 1)
        sign = max((i for i, c in enumerate(rest[:low]) if c in CUTS), default=-1)
        cut = sign + 1 if sign >= low // 2 else low
        found.append(rest[:cut])
        rest = rest[cut:]
    return found


def reading_segments(lines: DataFrame, budget: int, seconds: int = 20, tokens: Callable[[Column], Column] = X.token_estimate, count: Callable[[str], int] = X.estimated) -> DataFrame:
    """meeting_id, utt_idx, piece, window, segment (from 0 in its window), text and tokens: how a note-writer reads a meeting.

    A window closes before the line that would pass the budget of tokens. Within it a segment ends with the line that starts ``seconds`` or more after
    the one before it ended (the first: after the window's first line). A line that alone is over the budget is read in pieces. Lines count with their
    header. lines: meeting_id, utt_idx, start (whole seconds), label, text; tokens and count are the same rule for columns and for strings.
    """
    header = F.concat(F.lit("["), X.clock(F.col("start")), F.lit("] "), F.coalesce(F.concat("label", F.lit(": ")), F.lit("")))
    sized = lines.withColumn("_h", header).withColumn("tokens", tokens(F.concat("_h", "text")))

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series, headers: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else cut_long(x, h, budget, count) for x, h in zip(texts, headers, strict=True)], dtype=object)

    long = F.col("tokens") > budget
    parts_ = sized.select("meeting_id", "utt_idx", "start", "_h", F.posexplode(F.coalesce(cut(F.when(long, F.col("text")), F.when(long, F.col("_h"))), F.array("text"))).alias("piece", "text"))
    parts_ = parts_.withColumn("tokens", tokens(F.concat("_h", "text")).cast("int"))
    rows = parts_.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct(F.col("utt_idx").cast("long").alias("utt_idx"), "piece", F.col("start").cast("int").alias("start"), "tokens"))).alias("lines"))
    kind = "array<struct<utt_idx:bigint,piece:int,window:int,segment:int>>"

    def step(s: Column, x: Column) -> Column:
        opens = (s["n"] == 0) | (s["used"] + x["tokens"] > budget)
        window = s["window"] + opens.cast("int")
        segment = F.when(opens, 0).otherwise(s["segment"] + s["closed"].cast("int"))
        end = F.when(opens, x["start"] + seconds).otherwise(s["end"])
        closes = x["start"] >= end
        out = F.concat(s["out"], F.array(F.struct(x["utt_idx"].alias("utt_idx"), x["piece"].alias("piece"), window.alias("window"), segment.alias("segment"))))
        return F.struct(F.lit(1).alias("n"), F.when(opens, x["tokens"]).otherwise(s["used"] + x["tokens"]).alias("used"), window.alias("window"), segment.alias("segment"), closes.alias("closed"), F.when(closes, x["start"] + seconds).otherwise(end).alias("end"), out.alias("out"))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("used"), F.lit(-1).alias("window"), F.lit(0).alias("segment"), F.lit(False).alias("closed"), F.lit(0).alias("end"), F.array().cast(kind).alias("out"))
    placed = rows.select("meeting_id", F.explode(F.aggregate("lines", start, step)["out"]).alias("o")).select("meeting_id", "o.*")
    return placed.join(parts_.select("meeting_id", F.col("utt_idx").cast("long").alias("utt_idx"), "piece", "text", "tokens"), ["meeting_id", "utt_idx", "piece"])
