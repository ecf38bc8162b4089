"""Registered query of letters in languages: conversations' minutes for mail and chat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlake.operators import letters as L
from meetlake.plans import adapters as A

_EN = {
    "subject": "Minutes: {title} ({date_short})", "greeting": "Hello,", "intro": "these are the minutes of {title}, held on {date_long}.", "chat_intro": "Minutes of {title}, {date_short}", "facts_heading": "Meeting", "summary_heading": "Summary", "plain_heading": "{H}", "colon": ": ",
    "disclaimer": "Written by a program; please check what matters.", "footer": "Sent by meetlake", "bullet": "- ", "label_date": "Date", "label_time": "Time", "label_duration": "Length", "label_participants": "Present", "date_long": "{wd}, {mon} {d}, {y}", "date_short": "{mon} {d}", "duration_hm": "{h} h {m} min",
    "duration_m": "{m} min", "unnamed": "{n} unnamed", "list_sep": ", ", "owner_none": "Nobody yet", "more": "… and {n} more", "attachments": "Attached: {files}", "months": "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec", "weekdays": "Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday",
}
_DE = {"subject": "Protokoll: {title} ({date_short})", "greeting": "Guten Tag,", "summary_heading": "Zusammenfassung", "plain_heading": "[{h}]", "date_long": "{d}.{mo}.{y}", "date_short": "{d}.{mo}.", "owner_none": "Offen", "more": "… {n} weitere", "list_sep": " / "}
HEADINGS = {"en": ("Decisions", "Actions", "Open issues", "Proposals", "Numbers"), "de": ("Beschlüsse", "Aufgaben", "Offenes", "Vorschläge", "Zahlen")}
TAGS = ("DECISION", "ACTION", "OPEN-ISSUE", "PROPOSAL", "NUMBER")


def tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """sections and strings; German has only some strings of its own."""
    sections = [(lang, k, heading, TAGS[k]) for lang, own in HEADINGS.items() for k, heading in enumerate(own)]
    strings = [(lang, key, value) for lang, own in (("en", _EN), ("de", _DE)) for key, value in own.items()]
    return spark.createDataFrame(sections, "lang string, ord int, heading string, tag string"), spark.createDataFrame(strings, "lang string, key string, value string")


def inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations as meetings in three languages (for one of them there are no strings), with every turn an item; users are Guest."""
    lines = A.utterances(spark, sf_dir)
    k = F.col("meeting_id")
    started = F.timestamp_seconds(F.lit(1_700_000_000) + k * 86_400 * 3 + k * 977)
    whole = lines.groupBy("meeting_id").agg(F.max("end_s").alias("seconds"), F.min_by("text", "utt_idx").alias("first"))
    summary = F.when(k % 4 != 0, F.concat(F.lit(" S2 said: "), "first", F.lit("\n\n\n\nIt went on.\n\nIt ended. ")))
    lang = F.get(F.array(F.lit("en"), F.lit("de"), F.lit("fr")), (k % 3).cast("int"))
    meetings = whole.select("meeting_id", lang.alias("lang"), F.concat(F.lit("Talk "), k.cast("string")).alias("title"), summary.alias("summary"), started.alias("started"), "seconds", F.when(k % 2 == 0, F.array(F.lit("Guest"), F.lit("Bot"))).otherwise(F.array().cast("array<string>")).alias("participants"), (k % 3).cast("int").alias("unnamed"))
    n = F.col("utt_idx")
    tag = F.get(F.array(*map(F.lit, TAGS)), ((k + n) % 5).cast("int"))
    text = F.concat(F.when((n % 3 == 0), "S2 ").when(n % 3 == 1, "S3 ").otherwise(""), F.regexp_replace("text", r"\s+", " "))
    items = lines.select("meeting_id", n.alias("pos"), tag.alias("tag"), text.alias("text"), F.when(n % 4 != 0, F.concat((n + 1).cast("string"), F.lit(":05"))).alias("ts"))
    names = whole.where("meeting_id % 5 <> 0").select("meeting_id", F.lit(1).alias("speaker"), F.lit("Guest").alias("name"))
    return meetings, items, names


def meeting_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    meetings, items, names = inputs(spark, sf_dir)
    return L.letters(meetings, items, names, *tables(spark), budget=2500, attachments=("minutes.pdf", "talk.srt"))


QUERIES = {"meeting_letters": (meeting_letters, None)}
