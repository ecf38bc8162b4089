"""Voices: which speech counts, what is learned of whom, and how that follows the links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meetlake.operators.retrieval import dot
from meetlake.sources.settled import settle

NOBODY = -9


def voice_lines(lines: DataFrame, sparse: float = 0.4) -> DataFrame:
    """Lines whose speaker is nobody where there are far fewer characters a second than usual in the meeting (its upper middle)."""
    rate = F.char_length(F.regexp_replace("text", r"\s", "")) / F.greatest(F.lit(0.5), F.col("end_s") - F.col("start_s"))
    rated = lines.withColumn("_rate", rate)
    w = Window.partitionBy("meeting_id")
    placed = rated.where("end_s > start_s").withColumn("_i", F.row_number().over(w.orderBy("_rate", "utt_idx")) - 1).withColumn("_n", F.count("*").over(w))
    usual = placed.where(F.col("_i") == F.floor(F.col("_n") / 2)).select("meeting_id", F.col("_rate").alias("_usual"))
    found = rated.join(usual, "meeting_id", "left")
    return found.withColumn("speaker", F.when(F.col("_rate") < sparse * F.col("_usual"), NOBODY).otherwise(F.col("speaker"))).drop("_rate", "_usual")


def known(exemplars: DataFrame) -> DataFrame:
    """Learned people: meetings, seconds, and outliers that wait. exemplars: person, meeting_id, seconds, confirmed."""
    return exemplars.groupBy("person").agg(F.countDistinct("meeting_id").alias("meetings"), F.sum("seconds").alias("seconds"), F.count_if(~F.col("confirmed")).alias("pending"))


def without_meeting(exemplars: DataFrame, meetings: DataFrame, dims: int) -> DataFrame:
    """Voices of people for each of these meetings, made without it. meetings: for_meeting. A stated set against all exemplars: sums of all
    less the meeting's own, so nothing is summed twice."""
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    each = exemplars.where("confirmed").withColumn("_l", length).where("_l > 0").select("person", "meeting_id", "seconds", F.col("_l"), F.posexplode("vector").alias("dim", "x")).where(F.col("dim") < dims)
    part = each.withColumn("x", F.col("seconds") * F.col("x") / F.col("_l"))
    whole = part.groupBy("person", "dim").agg(F.sum("x").alias("_all"))
    own = part.join(meetings, part.meeting_id == meetings.for_meeting).groupBy("for_meeting", "person", "dim").agg(F.sum("x").alias("_own"))
    asked = own.select("for_meeting", "person").distinct()
    left = asked.join(whole, "person").join(own, ["for_meeting", "person", "dim"], "left").withColumn("x", F.col("_all") - F.coalesce("_own", F.lit(0.0)))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("for_meeting", "person")))
    return left.withColumn("_n", norm).where("_n > 1e-9").select("for_meeting", "person", "dim", (F.col("x") / F.col("_n")).alias("x"))


def sums(exemplars: DataFrame, keys: list[str]) -> DataFrame:
    """keys, total and n: sums of unit vectors weighted by seconds (a thousandth at least), and how many there are."""
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    weight = F.greatest(F.col("seconds").cast("double"), F.lit(1e-3)) / F.when(F.col("_l") > 0, F.col("_l")).otherwise(1.0)
    each = exemplars.withColumn("_l", length).select(*keys, F.posexplode(F.transform("vector", lambda x: x.cast("double"))).alias("_d", "_x"), weight.alias("_w"))
    parts = each.groupBy(*keys, "_d").agg(F.sum(F.col("_x") * F.col("_w")).alias("_x"), F.count("*").alias("n"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_x"))), lambda x: x["_x"]).alias("total"), F.max("n").alias("n"))


def cosine(a: str, b: str) -> Column:
    """0 where a vector has no length or lengths differ."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / F.nullif(size, F.lit(0.0))).otherwise(0.0)


def synced(links: DataFrame, people: DataFrame, vectors: DataFrame, old: DataFrame, least: float = 10.0, outlier: float = 0.35, dates: DataFrame | None = None, cap: int = 30) -> DataFrame:
    """Exemplars (person, meeting_id, speaker, seconds, confirmed, vector) that follow the links of every meeting in ``links``.

    An old exemplar goes if its speaker is linked to somebody else now, or nobody. Each linked speaker of a person whose voice may be learned,
    with enough speech, gives the exemplar of that person and meeting; of several speakers the last one's vector stays. Confirmed is what the old
    exemplar that stayed was; without one, whether the first of these speakers is near enough to the person's confirmed exemplars of other
    meetings, or there are none. Those are the sums of all less the meeting's own, so nothing is summed for each meeting anew. Every meeting is
    held against the exemplars as they were before. With ``dates`` (meeting_id, date) the newest ``cap`` of a person stay.

    links: meeting_id, speaker, person; people: person, voice_enabled; vectors: meeting_id, speaker, seconds, vector; old: as the result.
    """
    fields = ["person", "meeting_id", "speaker", "seconds", "confirmed", "vector"]
    touched = links.select("meeting_id").distinct()
    elsewhere = old.join(touched, "meeting_id", "left_anti").select(fields)
    stayed = old.join(touched, "meeting_id", "left_semi").join(links.select("meeting_id", "speaker", "person"), ["meeting_id", "speaker", "person"], "left_semi").select(fields)
    usable = people.where("voice_enabled").select("person")
    wanted = links.join(usable, "person").join(vectors, ["meeting_id", "speaker"]).where(F.col("seconds") >= least).select("person", "meeting_id", "speaker", "seconds", "vector")
    one = wanted.groupBy("person", "meeting_id").agg(F.min_by("vector", "speaker").alias("_first"), F.max_by(F.struct("speaker", "seconds", "vector"), "speaker").alias("_last"))
    sure = old.where("confirmed")
    whole = sums(sure, ["person"]).select("person", F.col("total").alias("_all"), F.col("n").alias("_n"))
    own = sums(sure.join(touched, "meeting_id", "left_semi"), ["person", "meeting_id"]).select("person", "meeting_id", F.col("total").alias("_own"), F.col("n").alias("_m"))
    before = stayed.groupBy("person", "meeting_id").agg(F.min_by("confirmed", "speaker").alias("_was"))
    found = one.join(whole, "person", "left").join(own, ["person", "meeting_id"], "left").join(before, ["person", "meeting_id"], "left")
    others = F.when(F.col("_own").isNull(), F.col("_all")).otherwise(F.zip_with("_all", "_own", lambda a, b: a - b))
    alone = F.coalesce("_n", F.lit(0)) - F.coalesce("_m", F.lit(0)) <= 0
    fits = alone | (F.round(cosine("_first", "_others"), 9) >= outlier)
    put = found.withColumn("_others", others).select("person", "meeting_id", "_last.speaker", "_last.seconds", F.coalesce("_was", fits).alias("confirmed"), "_last.vector")
    result = elsewhere.unionByName(stayed.join(put, ["person", "meeting_id"], "left_anti")).unionByName(put)
    if dates is None:
        return result
    newest = Window.partitionBy("person").orderBy(F.desc_nulls_last("date"), "meeting_id", "speaker")
    return result.join(dates, "meeting_id", "left").withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= cap).select(fields)


def followed(exemplars: DataFrame, edits: DataFrame) -> DataFrame:
    """Exemplars after directory edits in the order of ``seq``: a meeting, a person, or a person's exemplar of a meeting is removed; a person's
    exemplars, or the one of a meeting, move to another person.

    edits: seq, kind (remove or move), person (null: anybody), meeting_id (null: any), to. What an edit concerns is a person and a meeting, so
    exemplars that share both move as one. Each round applies to each such pair the first edit that concerns it after its last one, found by one sort
    of pairs and edits, so rounds are as many as a pair has moves.
    """
    state = settle(exemplars.select("person", "meeting_id").distinct().select(F.col("person").alias("_of"), "person", "meeting_id", F.lit(-1).cast("long").alias("_at")), "pairs")
    log = settle(edits.where("person is not null or meeting_id is not null").select(F.col("person").alias("_p"), F.col("meeting_id").alias("_m"), F.struct(F.col("seq").cast("long").alias("seq"), "kind", "to").alias("_e")), "edits")
    marks = log.select("_p", "_m", F.col("_e.seq").alias("_t"), F.lit(1).alias("_side"), "_e")
    nobody, nowhere = (F.lit(None).cast(exemplars.schema[c].dataType) for c in ("person", "meeting_id"))
    keys = [(F.col("person"), F.col("meeting_id")), (F.col("person"), nowhere), (nobody, F.col("meeting_id"))]
    kept = None
    while True:
        # At one number a pair stands before the edit in falling order, so its own last edit doesn't count again.
        asked = state.withColumn("_k", F.explode(F.array(*(F.struct(p.alias("p"), m.alias("m")) for p, m in keys)))).select(F.col("_k.p").alias("_p"), F.col("_k.m").alias("_m"), F.col("_at").alias("_t"), F.lit(0).alias("_side"), F.struct("_of", "person", "meeting_id", "_at").alias("_row"))
        until = Window.partitionBy("_p", "_m").orderBy(F.desc("_t"), "_side").rowsBetween(Window.unboundedPreceding, 0)
        met = marks.unionByName(asked, allowMissingColumns=True).withColumn("_next", F.last("_e", ignorenulls=True).over(until)).where("_side = 0")
        first = settle(met.groupBy("_row").agg(F.min_by("_next", "_next.seq").alias("_e")).select("_row.*", "_e"), "hits")
        done = first.where("_e is null").select("_of", "person", "meeting_id")
        kept = done if kept is None else kept.unionByName(done)
        state = first.where("_e.kind = 'move'").select("_of", F.coalesce("_e.to", "person").alias("person"), "meeting_id", F.col("_e.seq").alias("_at"))
        if state.isEmpty():
            break
    now = kept.select(F.col("_of"), F.col("meeting_id").alias("_in"), F.col("person").alias("_now"))
    same = F.col("person").eqNullSafe(F.col("_of")) & F.col("meeting_id").eqNullSafe(F.col("_in"))
    return exemplars.join(now, same).withColumn("person", F.col("_now")).select(*exemplars.columns)
