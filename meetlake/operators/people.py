"""People: names and links of speakers, the directory, and voices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meetlake.functions import text as X
from meetlake.operators.retrieval import dense
from meetlake.operators.script import folded
from meetlake.sources.settled import settle


def display_name(name: Column, speaker: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.format_string("Speaker %d", (speaker + 1).cast("int")))


def resolved(links: DataFrame, people: DataFrame) -> DataFrame:
    """Links with the directory's name; where the person is gone the link's own name stays, without a person."""
    own = people.select("person_id", F.col("name").alias("_name"))
    found = links.join(own, "person_id", "left")
    return found.select("meeting_id", "speaker", F.coalesce("_name", "name").alias("name"), F.when(F.col("_name").isNotNull(), F.col("person_id")).alias("person_id"))


def bootstrap(names: DataFrame, people: DataFrame) -> DataFrame:
    """The directory completed from the names that meetings use: names with the same key are one person, the newest meeting's spelling
    counts, labels don't. Existing people come first. An id is the digest of the key, so running again adds nobody.
    names: meeting_id, date, speaker, name; people: person_id, name, last_used."""
    known = people.withColumn("key", X.name_key(F.col("name"))).groupBy("key").agg(F.min_by(F.struct("person_id", "name"), "person_id").alias("p"), F.max("last_used").alias("used"))
    used = names.where(X.is_person_name(F.col("name"))).withColumn("key", X.name_key(F.col("name")))
    newest = used.groupBy("key").agg(F.min_by(F.trim("name"), F.struct((-F.unix_seconds(F.col("date").cast("timestamp"))).alias("d"), "meeting_id", "speaker")).alias("spelling"), F.max("date").alias("newest"), F.countDistinct("meeting_id").alias("meetings"))
    both = newest.join(known, "key", "full")
    return both.select(
        F.coalesce("p.person_id", F.substring(F.sha2("key", 256), 1, 16)).alias("person_id"), F.coalesce("p.name", "spelling").alias("name"), F.greatest("used", "newest").alias("last_used"),
        F.coalesce("meetings", F.lit(0)).alias("meetings"), F.col("p").isNull().alias("created"),
    )


def linked_up(names: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The directory and all links after every speaker's name that isn't linked yet has been looked up by its key, or made a person.

    names: meeting_id, date (epoch seconds), speaker, name, person_id (the link, or null); people: person_id, name, created, last_used. A link to
    somebody in the directory stays and is no use of the person; one to nobody is looked up like no link. Labels like "Speaker 2" get none.
    The first of the directory's people with a key (by person_id) has it; a new person's spelling is that of the newest meeting, then of
    the smallest speaker, and its id the digest of the key. Run on its own result nothing changes. Returns people (person_id, name, created, last_used)
    and links (meeting_id, speaker, name, person_id, added).
    """
    there = people.select(F.col("person_id").alias("_there"))
    marked = names.join(there, F.col("person_id") == F.col("_there"), "left")
    valid = marked.where("_there is not null").select("meeting_id", "speaker", "name", "person_id", F.lit(False).alias("added"))
    free = marked.where("_there is null").where(X.is_person_name(F.col("name"))).withColumn("_key", X.name_key(F.col("name"))).drop("person_id")
    known = people.withColumn("_key", X.name_key(F.col("name"))).groupBy("_key").agg(F.min("person_id").alias("person_id"))
    first = free.groupBy("_key").agg(F.min_by(F.struct(F.trim("name").alias("name"), "date"), F.struct((-F.col("date")).alias("d"), "meeting_id", "speaker")).alias("f"), F.max("date").alias("used"))
    owners = first.join(known, "_key", "left").withColumn("_new", F.col("person_id").isNull()).withColumn("person_id", F.coalesce("person_id", F.substring(F.sha2("_key", 256), 1, 16)))
    made = owners.where("_new").select("person_id", F.col("f.name").alias("name"), F.col("f.date").alias("created"), F.col("used").alias("last_used"))
    used = owners.where("not _new").select("person_id", "used")
    touched = people.join(used, "person_id", "left").select("person_id", "name", "created", F.greatest("last_used", "used").alias("last_used"))
    added = free.join(owners.select("_key", "person_id"), "_key").select("meeting_id", "speaker", F.trim("name").alias("name"), "person_id", F.lit(True).alias("added"))
    return touched.unionByName(made), valid.unionByName(added)


def usage(links: DataFrame, meetings: DataFrame) -> DataFrame:
    """Of each person: meetings, the newest date and that meeting's title. meetings: meeting_id, date, title."""
    each = links.where("person_id is not null").select("person_id", "meeting_id").distinct().join(meetings, "meeting_id")
    return each.groupBy("person_id").agg(F.count("*").alias("meetings"), F.max("date").alias("newest"), F.max_by("title", F.struct("date", "meeting_id")).alias("title"))


def chips(people: DataFrame, used: DataFrame, sign: str = " · ", one: str = "meeting", many: str = "meetings") -> DataFrame:
    """person_id, ord and chip, a person's name with the number of meetings: who was in most meetings first, then by name. used: as of usage()."""
    counted = people.join(used.select("person_id", "meetings"), "person_id", "left").withColumn("meetings", F.coalesce("meetings", F.lit(0)))
    text = F.concat("name", F.lit(sign), F.col("meetings").cast("string"), F.lit(" "), F.when(F.col("meetings") == 1, one).otherwise(many))
    return ordered(counted.withColumn("chip", text), [F.desc("meetings"), F.asc("name"), F.asc("person_id")], "ord").select("person_id", "ord", "chip")


def ordered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with their place in one order over all of them, from 1: sorted over all tasks, each of which counts on from the rows before it."""
    placed = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_place", 33)  # the task's number; the lower bits are the row's within it
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_start"))
    return placed.join(starts, part == F.col("_part")).withColumn(name, F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_place", "_part", "_start")


def homonyms(people: DataFrame) -> DataFrame:
    """People whose name's key others have too."""
    keyed = people.withColumn("key", X.name_key(F.col("name")))
    shared = keyed.groupBy("key").agg(F.count("*").alias("same")).where("same > 1")
    return keyed.join(shared, "key").select("person_id", "name", "same")


def mentioned(questions: DataFrame, names: DataFrame, dictionaries: Sequence[DataFrame] = ()) -> DataFrame:
    """People that a question names: a name with Latin letters or digits as whole words, another one of two characters as a part.
    questions: query_id, query; names: person_id, name (aliases as rows of their own).

    Whole words are looked up by the name's first word, so that questions and names meet on a key; names without Latin letters meet by
    their first two characters. ``dictionaries`` bring questions and names to one script, phrases before characters.
    """
    if dictionaries:
        questions = folded(questions.withColumn("_low", F.lower("query")), "_low", dictionaries, "_one").select("query_id", F.col("_one").alias("query"))
        names = folded(names.withColumn("_low", F.lower("name")), "_low", dictionaries, "_one").select("person_id", F.col("_one").alias("name"))
    keyed = names.select("person_id", X.name_key(F.col("name")).alias("_key")).where("_key <> ''").distinct()
    latin = F.col("_key").rlike("[a-z0-9]")
    first = F.regexp_extract("_key", r"[\p{IsAlphabetic}\p{N}]+", 0)
    starts = keyed.withColumn("_start", F.when(latin, first).when(F.char_length("_key") >= 2, F.substring("_key", 1, 2))).where("_start is not null")
    asked = questions.select("query_id", X.name_key(F.col("query")).alias("_q"))
    words = F.regexp_extract_all("_q", F.lit(r"[\p{IsAlphabetic}\p{N}]+"), F.lit(0))
    # Only a text with other letters than Latin ones can have a name without any.
    parts = F.when(F.col("_q").rlike(r"[\p{IsAlphabetic}&&[^\p{IsLatin}]]"), X.pairs(F.col("_q"))).otherwise(F.array().cast("array<string>"))
    keys = asked.select("query_id", F.explode(F.array_distinct(F.concat(words, parts))).alias("_start"))
    # Texts stay out of this join: a question gets its candidates as one row, and is searched once.
    plain = F.regexp_replace("_key", r"[^\p{IsAlphabetic}\p{N}]+", " ")
    offered = starts.select("_start", F.struct("person_id", "_key", F.concat(F.lit(" "), plain, F.lit(" ")).alias("_plain"), latin.alias("_latin")).alias("_who"))
    candidates = keys.join(offered, "_start").groupBy("query_id").agg(F.collect_set("_who").alias("_all"))
    bare = asked.withColumn("_bare", F.concat(F.lit(" "), F.regexp_replace("_q", r"[^\p{IsAlphabetic}\p{N}]+", " "), F.lit(" ")))
    held = lambda w: F.when(w["_latin"], F.contains(F.col("_bare"), w["_plain"])).otherwise(F.contains(F.col("_q"), w["_key"]))
    return bare.join(candidates, "query_id").select("query_id", F.explode(F.filter("_all", held)).alias("_who")).select("query_id", "_who.person_id").distinct()


def voices(exemplars: DataFrame, keys: list[str], dims: int) -> DataFrame:
    """Mean unit vectors weighted by seconds, of length one again: one sum for each dimension, so that partial sums are made before
    the shuffle. exemplars: keys, seconds, vector."""
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    unit = exemplars.withColumn("_len", F.sqrt(square("vector"))).where("_len > 0")
    whole = unit.groupBy(*keys).agg(F.sum("seconds").alias("seconds"), F.count("*").alias("exemplars"))
    each = unit.select(*keys, (F.col("seconds") / F.col("_len")).alias("_w"), F.posexplode(F.slice("vector", 1, dims)).alias("_dim", "_x"))
    sums = each.groupBy(*keys, "_dim").agg(F.sum(F.col("_w") * F.col("_x")).alias("_x"))
    mean = sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_dim", "_x"))), lambda d: d["_x"]).alias("_v")).withColumn("_t", F.sqrt(square("_v"))).where("_t > 0")
    return whole.join(mean, keys).select(*keys, "seconds", "exemplars", F.transform("_v", lambda x: x / F.col("_t")).alias("vector"))


def suggested(speakers: DataFrame, people: DataFrame, dims: int, excluded: DataFrame | None = None, low: float = 0.5, high: float = 0.7, margin: float = 0.05, most: int = 3) -> DataFrame:
    """Who a speaker may be, by voice: pairs are assigned one to one, the best first; up to ``most`` people that no other speaker owns;
    the first is likely if it is clearly ahead of the next in the speaker's whole list, else possible.
    speakers: meeting_id, speaker, vector; people: person, vector; excluded: meeting_id, speaker, person. The people's voices are a stated set that all
    speakers are held against, in blocks; of pairs below ``low`` only those leave a task that may be the next of a speaker's list."""
    from meetlake.operators.timeline import one_to_one

    asked = speakers.withColumn("spare", F.lit(1))
    if excluded is not None:
        counts = excluded.groupBy("meeting_id", "speaker").agg(F.count("*").alias("_n"))
        asked = speakers.join(counts, ["meeting_id", "speaker"], "left").withColumn("spare", (F.coalesce("_n", F.lit(0)) + 1).cast("int"))
    asked = asked.select(F.struct("meeting_id", "speaker").alias("query_id"), "vector", "spare")
    pairs = settle(dense(people.select("person", "vector"), asked, low).select("query_id.meeting_id", "query_id.speaker", "person", F.col("cosine").alias("score")), "pairs")
    if excluded is not None:
        pairs = pairs.join(excluded, ["meeting_id", "speaker", "person"], "left_anti")
    w = Window.partitionBy("meeting_id", "speaker").orderBy(F.desc("score"), "person")
    ranked = pairs.withColumn("next", F.coalesce(F.lead("score").over(w), F.lit(-1.0))).where(F.col("score") >= low)
    owned = one_to_one(ranked.select("meeting_id", "speaker", "person", "score"), ["meeting_id"], "speaker", "person", [F.desc("score"), "speaker", "person"])
    owners = owned.select("meeting_id", "person", F.col("speaker").alias("owner"))
    free = ranked.join(owners, ["meeting_id", "person"], "left").where("owner is null or owner = speaker")
    listed = free.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    likely = (F.col("rank") == 1) & (F.col("score") >= high) & (F.col("score") - F.col("next") >= margin)
    return listed.select("meeting_id", "speaker", "rank", "person", "score", F.when(likely, "likely").otherwise("possible").alias("level"))


def newest(rows: DataFrame, keys: list[str], order: list, keep: int) -> DataFrame:
    """The newest rows of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= keep).drop("_r")


def merged(people: DataFrame, merges: DataFrame) -> DataFrame:
    """People merged into others: names and aliases of both without the name that stays, the newest use, the oldest creation.
    people: person_id, name, aliases, created, last_used; merges: from_id, into_id."""
    target = people.join(merges, people.person_id == merges.from_id, "left").withColumn("_id", F.coalesce("into_id", "person_id"))
    order = F.struct((F.col("_id") != F.col("person_id")).alias("o"), "person_id", "name", "aliases")
    rows = target.groupBy("_id").agg(F.array_sort(F.collect_list(order)).alias("rows"), F.min("created").alias("created"), F.max("last_used").alias("last_used"))
    name = F.col("rows")[0]["name"]
    every = F.flatten(F.transform("rows", lambda r: F.concat(F.array(r["name"]), r["aliases"])))
    return rows.select(F.col("_id").alias("person_id"), name.alias("name"), F.filter(F.array_distinct(every), lambda a: a != name).alias("aliases"), "created", "last_used")


def named_speakers(mentions: DataFrame, links: DataFrame) -> DataFrame:
    """Of each question the meetings with people that it names, and these people's speakers there. mentions: query_id, person_id; links: meeting_id,
    speaker, person_id."""
    met = mentions.join(links.where("person_id is not null"), "person_id")
    return met.groupBy("query_id", "meeting_id").agg(F.array_sort(F.collect_set("speaker")).alias("speakers"))


def relinked(links: DataFrame, edits: DataFrame) -> DataFrame:
    """Links after edits of the directory, with ``changed``. edits: seq, kind, person_id, meeting_id, value: rename (to value), merge (into value), split
    (one meeting's links go to the person value), delete (the name stays) and clear (it goes, too). Of each kind a person's last edit counts;
    a split comes before a merge, and this before names. links: meeting_id, speaker, name, person_id."""
    last = lambda kinds, *keys: edits.where(F.col("kind").isin(*kinds)).groupBy("person_id", *keys).agg(F.max_by(F.struct("kind", "value"), "seq").alias("_e"))
    was = links.withColumn("_was", F.struct("name", "person_id"))
    for kinds, keys in ((["split"], ["meeting_id"]), (["merge"], [])):
        was = was.join(last(kinds, *keys), ["person_id", *keys], "left").withColumn("person_id", F.coalesce("_e.value", "person_id")).drop("_e")
    named = was.join(last(["rename"]), "person_id", "left").withColumn("name", F.coalesce("_e.value", "name")).drop("_e")
    gone = named.join(last(["delete", "clear"]), "person_id", "left")
    name = F.when(F.coalesce(F.col("_e.kind") == "clear", F.lit(False)), None).otherwise(F.col("name"))
    after = gone.select("meeting_id", "speaker", name.alias("name"), F.when(F.col("_e").isNull(), F.col("person_id")).alias("person_id"), "_was")
    return after.withColumn("changed", ~(F.col("name").eqNullSafe(F.col("_was.name")) & F.col("person_id").eqNullSafe(F.col("_was.person_id")))).drop("_was")
