"""Minutes as letters: one model of a meeting, written plain for a mail and short for a chat, in the meeting's language.

What a language says comes from a table (lang, key, value); a key that it lacks is taken from the fallback language. Both forms have budgets of
characters, and lose items by fixed steps until they fit; what they leave out they count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meetlake.operators.mail import DROPS, named_texts

#: Keys of the table of strings. ``months`` and ``weekdays`` (from Monday) are lists with bars; braces stand for what is filled in.
KEYS = (
    "subject", "greeting", "intro", "chat_intro", "facts_heading", "summary_heading", "plain_heading", "colon", "disclaimer", "footer", "bullet", "label_date", "label_time", "label_duration", "label_participants",
    "date_long", "date_short", "duration_hm", "duration_m", "unnamed", "list_sep", "owner_none", "more", "attachments", "months", "weekdays",
)
# Characters that a chat message may have.
CHAT = 2_000
OWNER = r"^S(\d{1,2})(?![A-Za-z0-9_])"


def worded(meetings: DataFrame, strings: DataFrame, fallback: str) -> DataFrame:
    """meetings with ``s``, a struct of KEYS in the meeting's language. The table has a few rows for each language."""
    wide = strings.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_m"))
    base = wide.where(F.col("lang") == fallback).select(F.col("_m").alias("_base"))  # one row
    both = meetings.join(wide, "lang", "left").crossJoin(base)
    text = lambda k: F.coalesce(F.try_element_at("_m", F.lit(k)), F.try_element_at("_base", F.lit(k)), F.lit("")).alias(k)
    return both.withColumn("s", F.struct(*map(text, KEYS))).drop("_m", "_base")


def filled(text: Column, **values: Column) -> Column:
    for key, value in values.items():
        text = F.replace(text, F.lit(f"{{{key}}}"), value.cast("string"))
    return text


def headed(s: Column, heading: Column) -> Column:
    return filled(s["plain_heading"], h=heading, H=F.upper(heading))


def facts(rows: DataFrame) -> DataFrame:
    """Adds date_long, date_short and the lines of a meeting's facts. Minutes are rounded, halves to even."""
    s, at = F.col("s"), F.col("started")
    part = lambda k, i: F.coalesce(F.get(F.split(s[k], r"\|"), i), F.lit(""))
    dates = {"y": F.year(at), "mo": F.month(at), "d": F.dayofmonth(at), "wd": part("weekdays", F.weekday(at)), "mon": part("months", F.month(at) - 1)}
    minutes = F.bround(F.col("seconds") / 60).cast("int")
    long = F.when(minutes >= 60, filled(s["duration_hm"], h=F.floor(minutes / 60), m=minutes % 60)).otherwise(filled(s["duration_m"], m=minutes))
    end = F.timestamp_micros(F.unix_micros(at.cast("timestamp")) + F.floor(F.col("seconds") * 1_000_000).cast("long"))
    people = F.concat(F.coalesce("participants", F.array().cast("array<string>")), F.when(F.col("unnamed") > 0, F.array(filled(s["unnamed"], n=F.col("unnamed")))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("date_long", filled(s["date_long"], **dates)).withColumn("date_short", filled(s["date_short"], **dates))
    time = F.concat(F.date_format(at, "HH:mm"), F.lit("–"), F.date_format(end, "HH:mm"))
    line = lambda key, value: F.concat(s[key], s["colon"], value, F.lit("\n"))
    joined = F.aggregate(people, F.struct(F.lit("").alias("t"), F.lit(True).alias("f")), lambda a, x: F.struct(F.concat(a["t"], F.when(a["f"], "").otherwise(s["list_sep"]), x).alias("t"), F.lit(False).alias("f")))["t"]
    return rows.withColumn("facts", F.concat(line("label_date", F.col("date_long")), line("label_time", time), line("label_duration", long), line("label_participants", joined)))


def letters(
    meetings: DataFrame, items: DataFrame, names: DataFrame, sections: DataFrame, strings: DataFrame, fallback: str = "en", budget: int | None = None, summary: bool = True, minutes: bool = True, only: tuple[str, ...] | None = None,
    attachments: tuple[str, ...] = (),
) -> DataFrame:
    """meeting_id, subject, plain, chat and truncated (the plain form left something out), one row for each meeting.

    meetings: meeting_id, lang, title, summary, started (local time), seconds, participants, unnamed; items: meeting_id, pos, tag, text, ts; names:
    meeting_id, speaker, name (S2 in texts becomes the second speaker's name); sections: lang, ord, heading, tag; strings: lang, key, value.

    Options: without the summary, without minutes, ``only`` these tags, a line about attachments. Actions stand under their owners (S2 at the start), in
    the order in which they appear, those without one last; if none has one they aren't grouped. The chat has neither facts nor summary, and CHAT
    characters; ``budget`` limits the plain form (null: none). Each form is tried with ever fewer items, at DROPS' steps, until it fits; the last
    one stands in any case. A meeting's items meet in one row, as they do in the letter.
    """
    rows = facts(worded(meetings, strings, fallback))
    told = named_texts(rows.select("meeting_id", F.regexp_replace("summary", r"^\s+|\s+$", "").alias("summary")), names, "summary")
    paragraphs = F.filter(F.transform(F.split(F.coalesce("summary", F.lit("")), "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    rows = rows.drop("summary").join(told.select("meeting_id", paragraphs.alias("paragraphs")), "meeting_id")

    wanted = items if only is None else items.where(F.col("tag").isin(list(only)))
    owned = wanted.join(names.select("meeting_id", (F.col("speaker") + 1).alias("_n"), F.col("name").alias("_owner")), (wanted.meeting_id == names.meeting_id) & (F.regexp_extract("text", OWNER, 1).try_cast("int") == F.col("_n")) & (F.col("tag") == "ACTION"), "left")
    owned = owned.select(wanted.meeting_id, "pos", "tag", "text", "ts", "_owner")
    spoken = named_texts(owned, names)
    bare = F.when(F.startswith("text", "_owner"), F.regexp_replace(F.substring("text", F.char_length("_owner") + 1, F.char_length("text")), "^ +", "")).otherwise(F.col("text"))
    spoken = spoken.withColumn("_bare", F.when(F.col("_owner").isNotNull(), bare).otherwise(F.col("text"))).join(rows.select("meeting_id", "lang"), "meeting_id")
    headings = sections.select("lang", "ord", "tag", "heading")
    own = sections.select("lang").distinct().withColumn("_there", F.lit(True))
    placed = spoken.join(own, "lang", "left").withColumn("lang", F.when(F.col("_there"), F.col("lang")).otherwise(F.lit(fallback))).join(headings, ["lang", "tag"])
    one = placed.groupBy("meeting_id", "ord", "tag", "heading").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "ts", F.col("_owner").alias("owner"), F.col("_bare").alias("bare")))).alias("items"))
    whole = one.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("ord", "tag", "heading", "items"))).alias("sections"))
    rows = rows.join(whole, "meeting_id", "left")

    limits = [{}]
    for tag, most in DROPS:
        limits.append(limits[-1] | {tag: most})
    limit = lambda key, v: F.get(F.array(*(F.lit(x.get(key)).cast("int") for x in limits)), v)
    s, none = F.col("s"), F.col("s.owner_none")

    def item(x: Column, text: Column) -> Column:
        return F.concat(s["bullet"], text, F.when(x["ts"].isNotNull(), F.concat(F.lit(" ["), x["ts"], F.lit("]"))).otherwise(""), F.lit("\n"))

    def section(x: Column, v: Column) -> Column:
        most = F.when(x["tag"] == "PROPOSAL", limit("PROPOSAL", v)).when(x["tag"] == "NUMBER", limit("NUMBER", v)).when(x["tag"] == "OPEN-ISSUE", limit("OPEN-ISSUE", v))
        kept = F.when(most.isNull(), x["items"]).otherwise(F.slice(x["items"], F.lit(1), F.coalesce(most, F.lit(0))))
        owners = F.array_distinct(F.transform(kept, lambda i: F.coalesce(i["owner"], none)))
        order = F.concat(F.filter(owners, lambda o: o != none), F.filter(owners, lambda o: o == none))
        group = lambda o: F.concat(o, F.lit("\n"), F.array_join(F.transform(F.filter(kept, lambda i: F.coalesce(i["owner"], none) == o), lambda i: item(i, i["bare"])), ""))
        body = F.when(F.exists(kept, lambda i: i["owner"].isNotNull()), F.array_join(F.transform(order, group), "")).otherwise(F.array_join(F.transform(kept, lambda i: item(i, i["text"])), ""))
        left = F.size(x["items"]) - F.size(kept)
        return F.when(F.size(kept) > 0, F.concat(F.lit("\n"), headed(s, x["heading"]), F.lit("\n"), body, F.when(left > 0, F.concat(filled(s["more"], n=left), F.lit("\n"))).otherwise(""))).otherwise("")

    every = F.coalesce("sections", F.array().cast(rows.schema["sections"].dataType)) if minutes else F.array().cast(rows.schema["sections"].dataType)
    tried = rows.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(len(limits) - 1))))
    listed = F.array_join(F.transform(every, lambda x: section(x, F.col("v"))), "")
    shown = F.when(limit("summary", F.col("v")).isNull(), F.col("paragraphs")).otherwise(F.slice("paragraphs", F.lit(1), F.coalesce(limit("summary", F.col("v")), F.lit(0))))
    lead = F.when(F.size(shown) > 0, F.concat(F.lit("\n"), headed(s, s["summary_heading"]), F.lit("\n"), F.array_join(F.transform(shown, lambda p: F.concat(p, F.lit("\n\n"))), ""))).otherwise("") if summary else F.lit("")
    about = {"title": F.col("title"), "date_long": F.col("date_long"), "date_short": F.col("date_short")}
    files = F.array_join(F.array(*map(F.lit, attachments)), "|") if attachments else None
    enclosed = F.concat(F.lit("\n"), filled(s["attachments"], files=F.replace(files, F.lit("|"), s["list_sep"])), F.lit("\n")) if attachments else F.lit("")
    plain = F.concat(s["greeting"], F.lit("\n\n"), filled(s["intro"], **about), F.lit("\n\n"), headed(s, s["facts_heading"]), F.lit("\n"), F.col("facts"), lead, listed, enclosed, F.lit("\n--\n"), s["disclaimer"], F.lit("\n"), s["footer"], F.lit("\n"))
    chat = F.concat(filled(s["chat_intro"], **about), F.lit("\n"), listed)
    tidy = lambda t: F.concat(F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", ""), F.lit("\n"))
    written = tried.select("meeting_id", "v", filled(s["subject"], **about).alias("subject"), plain.alias("plain"), chat.alias("chat"))

    def first(text: str, most: int | None) -> Column:
        """The least cut form that fits, else the most cut one."""
        fits = F.lit(True) if most is None else F.char_length(text) <= most
        return F.min_by(F.struct("v", text, "subject"), F.struct((~fits).alias("a"), F.when(fits, F.col("v")).otherwise(-F.col("v")).alias("b")))

    best = written.groupBy("meeting_id").agg(first("plain", budget).alias("p"), first("chat", CHAT).alias("c"))
    return best.select("meeting_id", "p.subject", tidy(F.col("p.plain")).alias("plain"), tidy(F.col("c.chat")).alias("chat"), (F.col("p.v") > 0).alias("truncated"))
