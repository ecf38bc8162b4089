"""Notes of meetings: guards, minutes, caps, compaction, near copies and repaired times."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meetlake.functions import text as X

# Tags, and how proposals and decisions are worded, by language.
KNOWN_TAGS = ("DECISION", "ACTION", "NUMBER", "OPEN-ISSUE", "PROPOSAL")
PRIORITY = ("DECISION", "OPEN-ISSUE", "ACTION")
PROPOSAL_CUES = {
    "zh": "^(建議|提議|可以|可考慮|考慮|希望|應該|應|或許|是否|討論|研議)|建議|提議|可考慮",
    "en": r"(?i)\b(maybe|perhaps|possibly|we could|could we|should we|shall we|how about|what if|let'?s think about|think about|propos(e|es|ed|ing|al)|suggest(s|ed|ing|ion)?|not sure|unsure|undecided|consider(s|ed|ing)?)\b|\?",
}
DECIDED = {"zh": "通過|決定|決議|同意|定案", "en": r"(?i)\b(agreed|agrees|decided|confirmed|approved|accepted|settled|finali[sz]ed|will go with|going with|chose|chosen)\b"}


def reclassified(notes: DataFrame, language: str = "en") -> DataFrame:
    """Decisions and actions that are worded as proposals, without a word of decision, become proposals."""
    worded = F.col("text").rlike(PROPOSAL_CUES[language]) & ~F.col("text").rlike(DECIDED[language])
    return notes.withColumn("tag", F.when(F.upper("tag").isin("DECISION", "ACTION") & worded, "PROPOSAL").otherwise(F.col("tag")))


def known_tag(tag: Column) -> Column:
    """No tag is fine; others are compared without case."""
    return tag.isNull() | F.upper(tag).isin(*KNOWN_TAGS)


def parsed(lines: DataFrame) -> DataFrame:
    """Reply lines with kind (note, malformed, ignored, other), ts, tag and text. lines: meeting_id, utt_idx, text."""
    line = F.trim("text")
    form = r"^NOTE\s+\[(\d+:\d\d(?::\d\d)?)\]\s*(?:\(([A-Za-z-]+)\)\s*)?(\S.*)$"
    kind = F.when(line == "", "ignored").when(line == "NEXT", "ignored").when(line.rlike(form), "note").when(line.rlike(r"^NOTE\b"), "malformed").otherwise("other")
    part = lambda k: F.regexp_extract(line, form, k)
    return lines.select("meeting_id", "utt_idx", kind.alias("kind"), part(1).alias("ts"), F.nullif(part(2), F.lit("")).alias("tag"), part(3).alias("text"))


def guard_counts(lines: DataFrame, least: int = 10, most: float = 0.2) -> DataFrame:
    """Of each meeting's replies: lines that count, notes, other, malformed and unknown-tag lines, their rate, and whether that is too much."""
    rows = parsed(lines)
    n = lambda c: F.count_if(c)
    unknown = (F.col("kind") == "note") & ~known_tag(F.col("tag"))
    found = rows.groupBy("meeting_id").agg(n(F.col("kind") != "ignored").alias("lines"), n(F.col("kind") == "note").alias("notes"), n(F.col("kind") == "other").alias("other"), n(F.col("kind") == "malformed").alias("malformed"), n(unknown).alias("unknown"))
    off = F.col("other") + F.col("malformed") + F.col("unknown")
    rate = F.when(F.col("lines") > 0, off / F.col("lines")).otherwise(0.0)
    return found.withColumn("rate", rate).withColumn("exceeds", (F.col("lines") >= least) & (F.col("rate") > most))


def minutes(notes: DataFrame, sections: DataFrame, empty: str = "- None") -> DataFrame:
    """One text for each meeting: its notes under the sections' headings, in order. notes: meeting_id, pos, ts, tag, text (reclassified);
    sections: ord, heading, tag."""
    items = notes.withColumn("_tag", F.upper("tag")).join(sections.select("ord", F.col("tag").alias("_tag")), "_tag")
    line = F.concat(F.lit("- "), F.regexp_replace("text", "。+$", ""), F.lit(" ["), F.col("ts"), F.lit("]"))
    listed = items.groupBy("meeting_id", "ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("items"))
    every = notes.select("meeting_id").distinct().join(sections.select("ord", "heading"))
    whole = every.join(listed, ["meeting_id", "ord"], "left").select("meeting_id", "ord", F.concat(F.lit("【"), "heading", F.lit("】\n"), F.coalesce("items", F.lit(empty))).alias("section"))
    return whole.groupBy("meeting_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "section"))), lambda x: x["section"]), "\n").alias("minutes"))


def actions(notes: DataFrame, edits: DataFrame) -> DataFrame:
    """A meeting's action items as lines; a user's text replaces them, a blank one or "-" means none. edits: meeting_id, edited."""
    items = notes.where("upper(tag) = 'ACTION'").groupBy("meeting_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.lit("- "), "text", F.lit(" ["), "ts", F.lit("]")).alias("line")))), lambda x: x["line"]), "\n").alias("derived"))
    both = items.join(edits, "meeting_id", "full")
    edited = F.trim("edited")
    return both.withColumn("actions", F.when(F.col("edited").isNull(), F.col("derived")).when((edited == "") | (edited == "-"), None).otherwise(F.col("edited"))).where("actions is not null").select("meeting_id", "actions")


def capped(notes: DataFrame, keep: int = 12) -> DataFrame:
    """At most ``keep`` notes of a window: decisions and actions first, the newest first; then numbers, open issues, and the rest, the
    oldest first; renumbered in their order. notes: meeting_id, window, pos, tag."""
    tag = F.upper("tag")
    rank = F.when(tag.isin("DECISION", "ACTION"), 0).when(tag == "NUMBER", 1).when(tag == "OPEN-ISSUE", 2).otherwise(3)
    order = F.when(F.coalesce(tag.isin("DECISION", "ACTION"), F.lit(False)), -F.col("pos")).otherwise(F.col("pos"))
    w = Window.partitionBy("meeting_id", "window").orderBy(rank, order)
    kept = notes.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")
    return kept.withColumn("note_id", F.row_number().over(Window.partitionBy("meeting_id").orderBy("window", "pos")))


def compacted(notes: DataFrame, budget: int, overhead: int = 24) -> DataFrame:
    """What of a journal fits a budget of characters: tags by priority, the newest first, skipping what doesn't fit; in journal order, with
    the number left out. A fold over the meeting's ordered notes. notes: meeting_id, pos, tag, text."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PRIORITY)), F.upper("tag")), F.lit(0)), F.lit(len(PRIORITY) + 1))
    row = F.struct(rank.alias("rank"), (-F.col("pos")).alias("neg"), (F.char_length("text") + overhead).cast("int").alias("cost"))
    start = F.struct(F.lit(0).alias("used"), F.expr("cast(array() as array<bigint>)").alias("kept"))
    step = lambda s, x: F.when(s["used"] + x["cost"] <= budget, F.struct((s["used"] + x["cost"]).alias("used"), F.concat(s["kept"], F.array((-x["neg"]).cast("long"))).alias("kept"))).otherwise(s)
    folded = notes.groupBy("meeting_id").agg(F.array_sort(F.collect_list(row)).alias("rows")).withColumn("s", F.aggregate("rows", start, step))
    return folded.select("meeting_id", F.array_sort("s.kept").alias("kept"), (F.size("rows") - F.size("s.kept")).alias("omitted"))


def near_copies(notes: DataFrame, back: int = 30, above: float = 0.6) -> DataFrame:
    """Notes whose character pairs are like those of one of the ``back`` notes before; notes: meeting_id, pos, text. Null texts are empty, and empty ones are
    like nothing. A task walks its meetings' notes in order and holds ``back`` sets of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = object(), deque(maxlen=back)
        for batch in batches:
            out = []
            for meeting, pos, text in zip(*(batch.column(c).to_pylist() for c in ("meeting_id", "pos", "text")), strict=True):
                if meeting != at:
                    at = meeting
                    held.clear()
                own = {text[i : i + 2] for i in range(len(text or "") - 1)}
                least = above * len(own)  # two sets can't be alike if one is smaller than this share of the other
                like = [p for p, x in held if len(x) >= least and above * len(x) <= len(own) and len(own & x) / max(1, len(own | x)) > above]
                if like:
                    out.append((meeting, pos, like[0], len(like)))
                held.append((pos, own))
            kinds = (batch.schema.field("meeting_id").type, batch.schema.field("pos").type, batch.schema.field("pos").type, pa.int32())
            columns = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["meeting_id", "pos", "first_like", "n_like"])

    rows = notes.select("meeting_id", "pos", "text").repartition("meeting_id").sortWithinPartitions("meeting_id", "pos")
    meeting, pos = (notes.schema[c].dataType.simpleString() for c in ("meeting_id", "pos"))
    return rows.mapInArrow(run, f"meeting_id {meeting}, pos {pos}, first_like {pos}, n_like int")


def journal(notes: DataFrame, keep: int = 12, back: int = 30, above: float = 0.6) -> DataFrame:
    """What becomes of each note (meeting_id, window, pos, fate): ``duplicate`` where its pairs of UTF-16 units are like those of one of the last ``back``
    notes, which are those kept in earlier windows and this window's that aren't copies; ``cap`` where its window has ``keep`` better ones, ranked as by
    capped(); else ``kept``. Null texts are empty, and empty ones are like nothing. notes: meeting_id, window, pos, tag, text.

    Every decision rests on those before it, so a task walks its meetings' notes in order; it holds ``back`` sets of pairs and one window, however long
    the meeting is.
    """
    first = {"DECISION": 0, "ACTION": 0, "NUMBER": 1, "OPEN-ISSUE": 2}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kept, open_notes, out = object(), [], [], []

        def pairs(text: str) -> set[bytes]:
            units = text.encode("utf-16-le", "surrogatepass")
            return {units[i : i + 4] for i in range(0, len(units) - 2, 2)}

        def close() -> None:
            ranks = [first.get((tag or "").upper(), 3) for _, tag, _ in open_notes]
            best = set(sorted(range(len(ranks)), key=lambda i: (ranks[i], i if ranks[i] else -i))[:keep])
            out.extend((*at, pos, "kept" if i in best else "cap") for i, (pos, _, _) in enumerate(open_notes))
            kept[:] = [*kept, *(own for i, (_, _, own) in enumerate(open_notes) if i in best)][-back:]
            open_notes.clear()

        def handed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in out], schema)
            out.clear()
            return batch

        schema = None
        for batch in batches:
            schema = schema or pa.schema([*(batch.schema.field(c) for c in ("meeting_id", "window", "pos")), pa.field("fate", pa.string())])
            for meeting, window, pos, tag, text in zip(*(batch.column(c).to_pylist() for c in ("meeting_id", "window", "pos", "tag", "text")), strict=True):
                if (meeting, window) != at:
                    close()
                    kept[:] = kept if isinstance(at, tuple) and at[0] == meeting else []
                    at = (meeting, window)
                own = pairs(text or "")
                seen = [*kept, *(x for _, _, x in open_notes)][-back:]
                if any(len(own & x) / max(1, len(own | x)) > above for x in seen):
                    out.append((meeting, window, pos, "duplicate"))
                else:
                    open_notes.append((pos, tag, own))
            yield handed()
        close()
        if out:
            yield handed()

    rows = notes.select("meeting_id", "window", "pos", "tag", "text").repartition("meeting_id").sortWithinPartitions("meeting_id", "window", "pos")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in notes.select("meeting_id", "window", "pos").schema)
    return rows.mapInArrow(run, f"{kinds}, fate string")


def snapped(cites: DataFrame, known: DataFrame, within: int = 30) -> DataFrame:
    """Cited times moved to the closest known time of the meeting (the earliest of equals), where one is near enough.
    cites: meeting_id, cite_id, t; known: meeting_id, k (whole seconds). Known times are met by buckets of ``within`` seconds."""
    bucket = F.floor(F.col("t") / within)
    asked = cites.withColumn("_b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    near = asked.join(known.distinct().withColumn("_b", F.floor(F.col("k") / within)), ["meeting_id", "_b"]).where(F.abs(F.col("k") - F.col("t")) <= within)
    best = near.groupBy("meeting_id", "cite_id").agg(F.min_by("k", F.struct(F.abs(F.col("k") - F.col("t")), "k")).alias("snapped"))
    return cites.join(best, ["meeting_id", "cite_id"], "left")


# The form of a time stamp's bracket, and what stands between its items.
STAMP = r"(?<!\[)\[(?:[0-9:：\t\n\f\r\p{Z},，、;；\-–~～]*\p{Nd}[0-9:：\t\n\f\r\p{Z},，、;；\-–~～]*)\](?!\])"
BETWEEN = r"[\t\n\f\r\p{Z},，、;；\-–~～]+"


def spans_of(item: Column) -> Column:
    """The ranges of seconds that a cited item can mean: m:ss or h:mm:ss one second; m:s that second, or a cut-off m:s0 to m:s9 where that is a
    time. Null for a bare number or nonsense."""
    kind = "array<struct<low:int,high:int>>"
    span = lambda low, high: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))
    n = lambda k: F.get(F.split(item, ":"), F.lit(k)).try_cast("int")
    whole, short = n(0) * 60 + n(1), n(0) * 60 + n(1) * 10
    return (
        F.when(item.rlike(r"^[0-9]{1,3}:[0-5][0-9]$"), F.array(span(whole, whole)))
        .when(item.rlike(r"^[0-9]{1,3}:[0-5]$"), F.array(span(whole, whole), span(short, short + 9)))
        .when(item.rlike(r"^[0-9]{1,3}:[6-9]$"), F.array(span(whole, whole)))
        .when(item.rlike(r"^[0-9]{1,3}:[0-5][0-9]:[0-5][0-9]$"), F.array(span(n(0) * 3600 + n(1) * 60 + n(2), n(0) * 3600 + n(1) * 60 + n(2))))
        .otherwise(F.lit(None).cast(kind))
    )


def repaired(texts: DataFrame, known: DataFrame, within: int = 30) -> DataFrame:
    """texts (meeting_id, text_id, text and others) with ``repaired``: each time stamp tag is checked against the meeting's times. A tag may hold a list or
    a range; each item becomes the closest known time (the earliest of equals) if that is within ``within`` seconds of what the item can mean,
    else it goes; a time stands once in a tag. Other brackets, and tags in double brackets, stay. known: meeting_id, ts, pos (of several
    spellings of a time the first counts). text_id is unique.

    Texts are cut at their tags; only items travel. Each distinct item of a meeting meets the known times once, in buckets of ``within`` seconds. What is
    made of them is merged with the texts: a planner that estimates it by the texts' file takes it for small and would send it through the driver.
    """
    cut = texts.withColumn("_tags", F.regexp_extract_all("text", F.lit(STAMP), F.lit(0)))
    tags = cut.where(F.size("_tags") > 0).select("meeting_id", "text_id", F.posexplode("_tags").alias("tag", "_inner"))
    listed = F.split(F.translate(F.regexp_replace("_inner", r"^\[|\]$", ""), "：", ":"), BETWEEN)
    items = tags.select("meeting_id", "text_id", "tag", F.posexplode(listed).alias("item", "_item"))
    kinds = items.select("meeting_id", "_item").distinct().withColumn("_spans", spans_of(F.col("_item"))).where("_spans is not null")
    number = lambda k: F.get(F.split("ts", ":"), F.lit(k)).try_cast("int")
    second = F.when(F.col("ts").rlike(r"^-?\d+:-?\d+$"), number(0) * 60 + number(1)).when(F.col("ts").rlike(r"^-?\d+:-?\d+:-?\d+$"), number(0) * 3600 + number(1) * 60 + number(2))
    times = known.withColumn("k", second).where("k is not null").groupBy("meeting_id", "k").agg(F.min_by("ts", "pos").alias("ts")).withColumn("_b", F.floor(F.col("k") / within))
    spread = F.flatten(F.transform("_spans", lambda s: F.sequence(F.floor((s["low"] - within) / within), F.floor((s["high"] + within) / within))))
    asked = kinds.withColumn("_b", F.explode(F.array_distinct(spread)))
    far = F.array_min(F.transform("_spans", lambda s: F.when(F.col("k").between(s["low"], s["high"]), 0).otherwise(F.least(F.abs(F.col("k") - s["low"]), F.abs(F.col("k") - s["high"])))))
    near = asked.join(times, ["meeting_id", "_b"]).withColumn("_far", far).where(F.col("_far") <= within)
    best = near.groupBy("meeting_id", "_item").agg(F.min_by("ts", F.struct("_far", "k")).alias("ts"))
    shown = F.array_join(F.transform(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("item", "ts"))), lambda x: x["ts"])), lambda t: F.concat(F.lit("["), t, F.lit("]"))), " ")
    made = items.join(best.hint("merge"), ["meeting_id", "_item"]).groupBy("meeting_id", "text_id", "tag").agg(shown.alias("_shown")).groupBy("meeting_id", "text_id").agg(F.map_from_entries(F.collect_list(F.struct("tag", "_shown"))).alias("_made"))
    pieces = F.transform(F.split("text", STAMP, -1), lambda p, i: F.concat(p, F.coalesce(F.try_element_at("_made", i), F.lit(""))))
    return cut.join(made.hint("merge"), ["meeting_id", "text_id"], "left").withColumn("repaired", F.when(F.size("_tags") > 0, F.array_join(pieces, "")).otherwise(F.col("text"))).drop("_tags", "_made")


def language(lines: DataFrame, least: int = 20) -> DataFrame:
    """zh or en by each meeting's CJK characters and Latin words of two letters and more; null where there are too few of both."""
    counts = lines.groupBy("meeting_id").agg(F.sum(X.count(F.col("text"), f"[{X.LANGUAGE_CJK}]")).alias("characters"), F.sum(X.count(F.col("text"), "[A-Za-z]{2,}")).alias("words"))
    units = F.col("characters") + F.col("words")
    return counts.withColumn("language", F.when(units >= least, F.when(F.col("words") > F.col("characters"), "en").otherwise("zh")))
