"""Sources: files of meetings, people, feeds and dictionaries as tables. All read with Spark's own readers, so any store does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meetlake.functions import text as X

LINE = "struct<speaker:int,start:double,end:double,text:string,tokenTimes:array<double>>"
NOTE = "struct<id:int,window:int,ts:string,tag:string,text:string>"
MEETING = (
    f"id string, date timestamp, title string, summary string, seconds double, lines array<{LINE}>, notes array<{NOTE}>, audio string, speakerNames map<string,string>, "
    "speakerPeople map<string,string>, reader string, actionsEdited string, legacyNotes string, readerGuard struct<lines:int,notes:int,nonNote:int,unknownTag:int,malformed:int>, _corrupt_record string"
)
# The keys of a person and of a contact in a directory document.
KNOWN = ("id", "name", "note", "aliases", "created", "lastUsed", "voiceEnabled", "me", "emails", "contact")
CONTACT = ("platform", "key", "id", "name", "org", "linked", "synced", "missing")


def library(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A folder of meeting documents, one JSON file each (or with ``lines`` one a line), newest first; unreadable ones are passed over."""
    rows = spark.read.schema(MEETING).option("multiLine", not lines).option("mode", "PERMISSIVE").json(path)
    return rows.where("_corrupt_record is null and id is not null").drop("_corrupt_record").orderBy(F.desc("date"), "id")


def utterances(meetings: DataFrame) -> DataFrame:
    rows = meetings.select(F.col("id").alias("meeting_id"), F.posexplode("lines").alias("utt_idx", "l"))
    return rows.select("meeting_id", "utt_idx", "l.speaker", F.col("l.start").alias("start_s"), F.col("l.end").alias("end_s"), "l.text", F.col("l.tokenTimes").alias("token_times"))


def notes(meetings: DataFrame) -> DataFrame:
    rows = meetings.select(F.col("id").alias("meeting_id"), F.posexplode("notes").alias("note_idx", "n"))
    return rows.select("meeting_id", "note_idx", F.col("n.id").alias("note_id"), "n.window", "n.ts", X.seconds_of(F.col("n.ts")).alias("ts_s"), "n.tag", "n.text")


def speaker_links(meetings: DataFrame) -> DataFrame:
    """Names and people of speakers; keys that are no numbers are dropped."""
    pairs = lambda c, name: meetings.select(F.col("id").alias("meeting_id"), F.explode(c).alias("k", name)).withColumn("speaker", F.col("k").try_cast("int")).where("speaker is not null").drop("k")
    return pairs("speakerNames", "name").join(pairs("speakerPeople", "person_id"), ["meeting_id", "speaker"], "full")


def segment_records(spark: SparkSession, path: str) -> DataFrame:
    """Records closed by 0x1e with fields parted by 0x1f: speaker, start, end, text, and perhaps milliseconds of code points. Short ones
    and ones without numbers are dropped."""
    rows = spark.read.option("lineSep", "\x1e").text(path).select(F.split("value", "\x1f", 5).alias("f"))
    f = lambda k: F.col("f")[k]
    rows = rows.where(F.size("f") >= 4).select(f(0).try_cast("int").alias("speaker"), f(1).try_cast("double").alias("start_s"), f(2).try_cast("double").alias("end_s"), f(3).alias("text"), F.when(F.size("f") > 4, F.filter(F.transform(F.split(f(4), ","), lambda x: x.try_cast("int")), lambda x: x.isNotNull())).alias("char_ms"))
    return rows.where("speaker is not null and start_s is not null and end_s is not null")


def note_journal(rows: DataFrame) -> DataFrame:
    """Journal texts (meeting_id, journal) as notes: lines of the form ``#id [m:ss] (TAG) text``; others are ignored."""
    form = r"^#(\d+) \[(\d+:\d\d(?::\d\d)?)\] (?:\(([^)]+)\) )?(.*)$"
    lines = rows.select("meeting_id", F.posexplode(F.split("journal", "\n")).alias("line", "l")).where(F.col("l").rlike(form))
    part = lambda k: F.regexp_extract("l", form, k)
    n = F.row_number().over(Window.partitionBy("meeting_id").orderBy("line")) - 1
    return lines.select("meeting_id", n.alias("note_idx"), part(1).cast("int").alias("note_id"), part(2).alias("ts"), F.nullif(part(3), F.lit("")).alias("tag"), part(4).alias("text"))


def under_headings(lines: DataFrame, keys: list[str], order: str, heading: Column) -> DataFrame:
    """Lines with the last heading before them; ``heading`` is null on lines that are none."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("_h", heading).withColumn("heading", F.last("_h", ignorenulls=True).over(w))


def sectioned_notes(rows: DataFrame) -> DataFrame:
    """Texts (meeting_id, notes) with ``KEY:`` lines as items of sections: an item may stand on the key's line; bullets, ``[c1]`` and range
    anchors go, and so do marks of emptiness."""
    form = r"^([A-Z][A-Z_ -]+):\s*(.*)$"
    lines = rows.select("meeting_id", F.posexplode(F.split("notes", "\n")).alias("pos", "l"))
    keyed = under_headings(lines, ["meeting_id"], "pos", F.nullif(F.regexp_extract("l", form, 1), F.lit("")))
    item = F.when(F.col("_h").isNotNull(), F.regexp_extract("l", form, 2)).otherwise(F.regexp_replace("l", r"^\s*(?:[-*•]|\d+[.)])\s*", ""))
    item = F.trim(F.regexp_replace(item, r"\s*\[(?:c\d+|\d+:\d\d\s*[-–]\s*\d+:\d\d)\]", ""))
    return keyed.select("meeting_id", F.col("heading").alias("section"), "pos", item.alias("item")).where("section is not null").where(~F.lower("item").isin("", "-", "none", "n/a", "無", "无"))


def minutes(rows: DataFrame, sections: DataFrame) -> DataFrame:
    """Minutes texts (meeting_id, minutes) as items with heading, tag, text and time; empty items are dropped. sections: heading, tag."""
    lines = rows.select("meeting_id", F.posexplode(F.split("minutes", "\n")).alias("pos", "l")).withColumn("l", F.trim("l"))
    headed = under_headings(lines, ["meeting_id"], "pos", F.nullif(F.regexp_extract("l", "^【(.+)】$", 1), F.lit("")))
    form = r"^-\s*(.*?)\s*(?:\[(\d+:\d{2}(?::\d{2})?)\])?\s*$"
    items = headed.where(F.col("l").rlike(form) & F.col("heading").isNotNull()).select("meeting_id", "pos", "heading", F.regexp_extract("l", form, 1).alias("text"), F.nullif(F.regexp_extract("l", form, 2), F.lit("")).alias("ts"))
    return items.where(~F.col("text").isin("無", "无", "None", "-", "")).join(sections, "heading", "left")


def transcript_lines(rows: DataFrame) -> DataFrame:
    """Lines ``[m:ss] speaker: text`` (meeting_id, pos, line); a speaker has at most 20 characters, else all is text."""
    form = r"^\[(\d+:\d\d(?::\d\d)?)\]\s*(.*)$"
    rest = F.regexp_extract("line", form, 2)
    who = F.regexp_extract(rest, r"^(S\d+|[^:：]{1,20})[:：]\s*(.*)$", 1)
    text = F.when(who == "", rest).otherwise(F.regexp_extract(rest, r"^(S\d+|[^:：]{1,20})[:：]\s*(.*)$", 2))
    return rows.where(F.col("line").rlike(form)).select("meeting_id", "pos", X.seconds_of(F.regexp_extract("line", form, 1)).alias("start"), F.nullif(who, F.lit("")).alias("speaker"), text.alias("text"))


def people(spark: SparkSession, path: str) -> DataFrame:
    """A directory document: people with a text as id and a name that isn't blank, of one id the first; broken entries are passed over, fields of
    another kind than they should have count as missing.

    person_id, name, note, aliases, created, last_used, voice_enabled, me, emails (address, from; objects or texts, once by key), contact (null where it
    isn't an object with a key) and extra: a JSON object of the keys that aren't ours, which directory_documents() writes back.
    """
    rows = spark.read.option("multiLine", True).schema("people array<string>").json(path)
    each = rows.select(F.posexplode("people").alias("pos", "_json")).withColumn("_v", F.try_parse_json("_json"))
    kind = lambda v: F.schema_of_variant(v)
    get = lambda v, key, to: F.try_variant_get(v, f"$.{key}", to)
    trimmed = lambda c: F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))
    text = lambda v, key: F.when(kind(get(v, key, "variant")) == "STRING", get(v, key, "string"))
    listed = lambda key: F.coalesce(get(F.col("_v"), key, "array<variant>"), F.array().cast("array<variant>"))
    each = each.where(F.startswith(kind(F.col("_v")), F.lit("OBJECT"))).withColumn("id", text(F.col("_v"), "id")).withColumn("name", trimmed(text(F.col("_v"), "name"))).where("trim(id) <> '' and name is not null")
    first = each.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).where("_r = 1")
    own = lambda e: F.when(kind(e) == "STRING", F.struct(trimmed(e.cast("string")).alias("address"), F.lit("user").alias("from"))).when(F.startswith(kind(e), F.lit("OBJECT")), F.struct(trimmed(text(e, "address")).alias("address"), F.coalesce(F.nullif(text(e, "from"), F.lit("")), F.lit("user")).alias("from")))
    found = F.filter(F.transform(listed("emails"), own), lambda e: e["address"].isNotNull())
    key = lambda e: F.when(F.contains(e["address"], F.lit("@")), X.email_key(e["address"])).otherwise(e["address"])
    once = F.filter("_e", lambda e, i: F.array_position(F.transform("_e", key), key(e)) == i + 1)
    c = get(F.col("_v"), "contact", "variant")
    linked = F.startswith(kind(c), F.lit("OBJECT"))
    rest = lambda keys: F.map_filter(F.from_json(keys[0], "map<string,variant>"), lambda k, v: ~k.isin(*keys[1]) | ((k == "contact") & F.lit(keys[2]) & ~F.startswith(kind(v), F.lit("OBJECT"))))
    written = lambda m: F.when(F.size(m) > 0, F.to_json(m))
    contact = F.when(linked & (F.trim(text(c, "key")) != ""), F.struct(
        F.coalesce(trimmed(text(c, "platform")), F.lit("android")).alias("platform"), text(c, "key").alias("key"), get(c, "id", "bigint").alias("id"), trimmed(text(c, "name")).alias("name"), trimmed(text(c, "org")).alias("org"),
        F.coalesce(get(c, "linked", "bigint"), F.lit(0)).alias("linked"), F.coalesce(get(c, "synced", "bigint"), F.lit(0)).alias("synced"), F.coalesce(get(c, "missing", "boolean"), F.lit(False)).alias("missing"), written(rest((F.to_json(c), CONTACT, False))).alias("raw"),
    ))
    aliases = F.transform(F.filter(listed("aliases"), lambda a: (kind(a) == "STRING") & (F.trim(a.cast("string")) != "")), lambda a: a.cast("string"))
    return first.withColumn("_e", found).select(
        F.col("id").alias("person_id"), "name", trimmed(text(F.col("_v"), "note")).alias("note"), aliases.alias("aliases"), F.coalesce(get(F.col("_v"), "created", "bigint"), F.lit(0)).alias("created"), F.coalesce(get(F.col("_v"), "lastUsed", "bigint"), F.lit(0)).alias("last_used"),
        F.coalesce(get(F.col("_v"), "voiceEnabled", "boolean"), F.lit(True)).alias("voice_enabled"), F.coalesce(get(F.col("_v"), "me", "boolean"), F.lit(False)).alias("me"), once.alias("emails"), contact.alias("contact"), written(rest(("_json", KNOWN, True))).alias("extra"),
    )


def podcast_feed(spark: SparkSession, path: str, most: int = 30) -> DataFrame:
    """Items of landed feeds that have sound, with their first such enclosure; ``most`` of each feed."""
    enclosure = "struct<_type:string,_url:string>"
    rows = spark.read.format("xml").option("rowTag", "item").schema(f"title string, pubDate string, `itunes:duration` string, enclosure array<{enclosure}>").load(path)
    rows = rows.select(F.input_file_name().alias("feed"), F.monotonically_increasing_id().alias("_n"), "title", F.col("pubDate").alias("published"), X.duration_text(F.col("`itunes:duration`")).alias("duration"), F.get(F.filter("enclosure", lambda e: e["_type"].startswith("audio/")), F.lit(0)).alias("e"))
    rows = rows.where("e is not null").withColumn("pos", F.row_number().over(Window.partitionBy("feed").orderBy("_n"))).where(F.col("pos") <= most)
    return rows.select("feed", "pos", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Episode")).alias("title"), "published", "duration", F.col("e._url").alias("url"), X.url_extension(F.col("e._url")).alias("extension"))


def podcast_series(spark: SparkSession, path: str) -> DataFrame:
    """Landed search results as series; those without a feed are dropped."""
    rows = spark.read.option("multiLine", True).schema("results array<struct<collectionName:string,artistName:string,feedUrl:string>>").json(path)
    return rows.select(F.explode("results").alias("r")).where("r.feedUrl is not null").select(F.coalesce("r.collectionName", F.lit("")).alias("name"), F.coalesce("r.artistName", F.lit("")).alias("artist"), F.col("r.feedUrl").alias("feed"))


def script_dictionary(spark: SparkSession, path: str, reverse: bool = False) -> DataFrame:
    """Tab-separated entries ``key values...`` without comments: the first value, or reversed each value with its first key; no identities."""
    rows = spark.read.text(path).withColumn("_n", F.monotonically_increasing_id()).where(~F.col("value").startswith("#") & F.col("value").contains("\t"))
    rows = rows.select("_n", F.split_part("value", F.lit("\t"), F.lit(1)).alias("key"), F.split(F.split_part("value", F.lit("\t"), F.lit(2)), " ").alias("values"))
    rows = rows.select("_n", F.explode("values").alias("key"), F.col("key").alias("to")) if reverse else rows.select("_n", "key", F.col("values")[0].alias("to"))
    return rows.where("key <> to and key <> ''").groupBy("key").agg(F.min_by("to", "_n").alias("to"))


def cards(spark: SparkSession, path: str, fields: list[str], lines: bool = False) -> DataFrame:
    """Configuration documents (one a file, or with ``lines`` one a line) as one row for each card and language: what the language doesn't set is the card's own. Fields are texts;
    languages: an object of such fields by language. The card itself has the language null."""
    own = ", ".join(f"`{f}` string" for f in fields)
    rows = spark.read.option("multiLine", not lines).schema(f"id string, {own}, languages map<string, struct<{own.replace(' string', ':string')}>>").json(path).where("id is not null")
    each = rows.select("id", *fields, F.explode(F.map_concat(F.create_map(F.lit(""), F.lit(None).cast(rows.schema["languages"].dataType.valueType)), F.coalesce("languages", F.create_map().cast(rows.schema["languages"].dataType)))).alias("language", "_own"))
    return each.select("id", F.nullif("language", F.lit("")).alias("language"), *(F.coalesce(F.col("_own")[f], F.col(f)).alias(f) for f in fields))


def directory_documents(people: DataFrame) -> DataFrame:
    """People as documents (person_id, document): their fields, null ones left out, and the keys that are not ours as they were read, in ``extra`` (a JSON
    object or null); where both have a key ours counts."""
    entries = lambda c: F.from_json(c, "map<string,variant>")
    own = entries(F.to_json(F.struct(F.col("person_id").alias("id"), *(c for c in people.columns if c not in ("person_id", "extra")))))
    rest = F.map_filter(F.coalesce(entries("extra"), F.create_map().cast("map<string,variant>")), lambda k, v: ~F.map_contains_key(own, k))
    return people.select("person_id", F.to_json(F.map_concat(own, rest)).alias("document"))
