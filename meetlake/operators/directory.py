"""The directory of people after a log of edits, applied in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meetlake.functions import text as X

#: What people look like: last_used and created in epoch seconds, e-mails in order (the first is the default).
PEOPLE = (
    "person_id string, name string, note string, aliases array<string>, created long, last_used long, voice_enabled boolean, me boolean, "
    "emails array<struct<address:string,from:string>>, contact struct<platform:string,key:string,name:string,org:string,linked:long>"
)
#: What edits look like. flag: the person is "me" (create), the address becomes the default (email_add), addresses go (contact_unlink).
EDITS = "person_id string, seq long, at long, kind string, value string, flag boolean, contact struct<platform:string,key:string,name:string,org:string,emails:array<string>>"
USER, CONTACT = "user", "contact"
EMAILS = "array<struct<address:string,from:string,key:string>>"


def plain(text: Column) -> Column:
    """Trimmed; null if nothing is left."""
    return F.nullif(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(""))


def living(people: DataFrame, edits: DataFrame) -> DataFrame:
    """people with those that edits create, without those that they delete, and ``_born``: the edit that made a person (null: was there).
    Ids are never used twice; what is done to a person before the creation or to one that isn't there does nothing."""
    made = edits.where((F.col("kind") == "create") & plain(F.col("value")).isNotNull())
    first = made.groupBy("person_id").agg(F.min_by(F.struct("seq", "at", "value", "flag"), "seq").alias("c"))
    made_by_kind = first.select(
        "person_id", plain(F.col("c.value")).alias("name"), F.lit(None).cast("string").alias("note"), F.array().cast("array<string>").alias("aliases"), F.col("c.at").alias("created"), F.col("c.at").alias("last_used"),
        F.lit(True).alias("voice_enabled"), F.coalesce("c.flag", F.lit(False)).alias("me"), F.array().cast("array<struct<address:string,from:string>>").alias("emails"),
        F.lit(None).cast("struct<platform:string,key:string,name:string,org:string,linked:long>").alias("contact"), F.col("c.seq").alias("_born"),
    ).join(people, "person_id", "left_anti")
    both = people.withColumn("_born", F.lit(None).cast("long")).unionByName(made_by_kind)
    gone = edits.where("kind = 'delete'").groupBy("person_id").agg(F.max("seq").alias("_gone"))
    return both.join(gone, "person_id", "left").where("_gone is null or _gone < _born").drop("_gone")


def email_steps(edits: DataFrame) -> DataFrame:
    """Edits of notes, addresses and contacts as steps (person_id, seq, sub, op, address, key, ...): linking a contact adds its addresses, in
    order, and then sets the link."""
    plain_edits = edits.where(F.col("kind").isin("note", "email_add", "email_remove", "email_default", "contact_unlink")).withColumn("sub", F.lit(0)).withColumn("op", F.col("kind"))
    linked = edits.where("kind = 'contact_link' and contact is not null")
    chosen = F.when(F.col("value").isNotNull(), F.array("value")).otherwise(F.array().cast("array<string>"))
    added = linked.select("*", F.posexplode(F.concat(chosen, F.coalesce("contact.emails", F.array().cast("array<string>")))).alias("sub", "_address")).withColumn("value", F.col("_address")).drop("_address").withColumn("op", F.lit("email_contact"))
    every = plain_edits.unionByName(added).unionByName(linked.withColumn("sub", F.lit(1_000_000)).withColumn("op", F.lit("contact_link")))
    address = F.regexp_replace(X.nfkc(F.regexp_replace("value", r"^\s+|\s+$", "")), r"^\s+|\s+$", "")
    steps = every.withColumn("address", F.when(F.startswith("op", F.lit("email")), address))
    steps = steps.where(~F.col("op").isin("email_add", "email_contact") | X.is_email(F.col("address")))
    key = F.when(F.contains("address", F.lit("@")), X.email_key(F.col("address"))).otherwise(F.col("address"))
    org, name = (plain(F.col(f"contact.{x}")) for x in ("org", "name"))
    link = F.when(F.col("contact.key").isNotNull(), F.struct("contact.platform", "contact.key", name.alias("name"), org.alias("org"), F.col("at").alias("linked")))
    return steps.select("person_id", "seq", "sub", "op", "address", key.alias("key"), F.coalesce("flag", F.lit(False)).alias("flag"), F.when(F.col("op") == "note", plain(F.col("value"))).alias("note"), F.when(F.col("op") == "contact_link", link).alias("link"), F.when(F.col("op") == "contact_link", org).alias("org"))


def stepped(state: Column, step: Column) -> Column:
    """note, emails and contact after one more step."""
    emails, op = state["emails"], step["op"]
    own, rest = F.filter(emails, lambda e: e["key"] == step["key"]), F.filter(emails, lambda e: e["key"] != step["key"])
    had = F.size(own) > 0
    origin = F.when(op == "email_contact", CONTACT).otherwise(USER)
    new = F.when(had, F.get(own, F.lit(0))).otherwise(F.struct(step["address"].alias("address"), origin.alias("from"), step["key"].alias("key")))
    first = (op == "email_add") & step["flag"] | ~had & (F.size(emails) == 0)
    added = F.when(first, F.concat(F.array(new), rest)).when(had, emails).otherwise(F.concat(emails, F.array(new)))
    unlinked = F.when(step["flag"], F.filter(emails, lambda e: e["from"] != CONTACT)).otherwise(F.transform(emails, lambda e: F.struct(e["address"].alias("address"), F.lit(USER).alias("from"), e["key"].alias("key"))))
    after = F.when(op.isin("email_add", "email_contact"), added).when(op == "email_remove", rest).when(op == "email_default", F.concat(own, rest)).when(op == "contact_unlink", unlinked).otherwise(emails)
    note = F.when(op == "note", step["note"]).when(op == "contact_link", F.coalesce(state["note"], step["org"])).otherwise(state["note"])
    contact = F.when(op == "contact_link", F.coalesce(step["link"], state["contact"])).when(op != "contact_unlink", state["contact"])
    return F.struct(note.alias("note"), after.cast(EMAILS).alias("emails"), contact.alias("contact"))


def directory_after(people: DataFrame, edits: DataFrame) -> DataFrame:
    """people (PEOPLE) after edits (EDITS), in the order of ``seq``.

    create (value: name), rename (drops an equal alias), note, touch (``at``), voice_on, voice_off, me (only this person is, of all), email_add,
    email_remove, email_default, contact_link (value: the address that was tapped), contact_unlink, delete.

    What only the last or largest edit decides is aggregated before anything is gathered; only steps on notes, addresses and contacts, whose
    order matters, are folded, one person's in an array.
    """
    now = living(people, edits)
    mine = edits.join(now.select("person_id", "_born"), "person_id").where("_born is null or seq > _born").drop("_born")
    name = F.when(F.col("kind") == "rename", plain(F.col("value")))
    voice = F.when(F.col("kind").isin("voice_on", "voice_off"), F.col("kind"))
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("seq")))
    whole = mine.where(F.col("kind").isin("rename", "voice_on", "voice_off", "touch")).groupBy("person_id").agg(
        last(name).alias("_name"), F.collect_set(name).alias("_names"), last(voice).alias("_voice"), F.max(F.when(F.col("kind") == "touch", F.col("at"))).alias("_touched")
    )
    steps = email_steps(mine)
    folds = steps.groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct("seq", "sub", "op", "address", "key", "flag", "note", "link", "org"))).alias("_steps"))
    keyed = F.transform("emails", lambda e: F.struct(e["address"].alias("address"), e["from"].alias("from"), F.when(F.contains(e["address"], F.lit("@")), X.email_key(e["address"])).otherwise(e["address"]).alias("key")))
    start = F.struct(F.col("note").alias("note"), keyed.cast(EMAILS).alias("emails"), F.col("contact").alias("contact"))
    owner = edits.where("kind = 'me'").agg(F.max_by(F.struct("person_id", "seq"), "seq").alias("_me"))  # one row
    found = now.join(whole, "person_id", "left").join(folds, "person_id", "left").crossJoin(owner)
    found = found.withColumn("_s", F.when(F.col("_steps").isNull(), start).otherwise(F.aggregate("_steps", start, stepped)))
    # An edit about "me" clears all others; people made after it have what they were made with
    later = F.col("_me").isNull() | (F.col("_born") > F.col("_me.seq"))
    me = F.when(F.coalesce(later, F.lit(False)), F.col("me")).otherwise(F.col("person_id") == F.col("_me.person_id"))
    return found.select(
        "person_id", F.coalesce("_name", "name").alias("name"), F.col("_s.note").alias("note"), F.when(F.col("_names").isNull(), F.col("aliases")).otherwise(F.filter("aliases", lambda a: ~F.array_contains("_names", a))).alias("aliases"), "created",
        F.greatest("last_used", "_touched").alias("last_used"), F.coalesce(F.col("_voice") == "voice_on", "voice_enabled").alias("voice_enabled"), me.alias("me"),
        F.transform("_s.emails", lambda e: F.struct(e["address"].alias("address"), e["from"].alias("from"))).alias("emails"), F.col("_s.contact").alias("contact"),
    )
