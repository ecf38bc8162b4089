"""Registered queries of notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlake.functions import text as X
from meetlake.operators import notes as N
from meetlake.operators import render as D
from meetlake.plans import adapters as A

TAGS = ("DECISION", "ACTION", "NUMBER", "OPEN-ISSUE", "PROPOSAL", "OTHER")
_TAG_SQL = "['DECISION', 'ACTION', 'NUMBER', 'OPEN-ISSUE', 'PROPOSAL', 'OTHER'][1 + (meeting_id * 7 + utt_idx * 5 + length(text)) % 6]"


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines as notes; every third one is worded as a proposal, every ninth as a decision too."""
    rows = A.lines(spark, sf_dir).where("text <> ''")
    tag = F.element_at(F.array(*map(F.lit, TAGS)), (1 + (F.col("meeting_id") * 7 + F.col("utt_idx") * 5 + F.char_length("text")) % 6).cast("int"))
    words = F.when((F.col("meeting_id") + F.col("utt_idx")) % 9 == 0, F.lit("we decided, maybe: ")).when((F.col("meeting_id") + F.col("utt_idx")) % 3 == 0, F.lit("maybe ")).otherwise("")
    rows = rows.withColumn("tag", tag).withColumn("text", F.concat(words, "text"))
    return rows.select("meeting_id", F.col("utt_idx").cast("long").alias("pos"), X.clock(F.col("utt_idx") * 37).alias("ts"), "tag", "text", F.floor(F.col("utt_idx") / 20).alias("window"))


NOTES = f"""{A.LINES}, nt AS (SELECT meeting_id, CAST(utt_idx AS BIGINT) AS pos, CASE WHEN utt_idx * 37 >= 3600 THEN printf('%d:%02d:%02d', utt_idx * 37 // 3600, utt_idx * 37 % 3600 // 60, utt_idx * 37 % 60) ELSE printf('%d:%02d', utt_idx * 37 // 60, utt_idx * 37 % 60) END AS ts,
  {_TAG_SQL} AS tag, CASE WHEN (meeting_id + utt_idx) % 9 = 0 THEN 'we decided, maybe: ' WHEN (meeting_id + utt_idx) % 3 = 0 THEN 'maybe ' ELSE '' END || text AS text, utt_idx // 20 AS "window", (meeting_id + utt_idx) % 3 = 0 AND (meeting_id + utt_idx) % 9 <> 0 AS cue0
  FROM lines WHERE text <> ''),
rc AS (SELECT *, CASE WHEN tag IN ('DECISION', 'ACTION') AND regexp_matches(text, '(?i)\\b(maybe|perhaps|possibly|we could|could we|should we|shall we|how about|what if|let''?s think about|think about|propos(e|es|ed|ing|al)|suggest(s|ed|ing|ion)?|not sure|unsure|undecided|consider(s|ed|ing)?)\\b|\\?')
  AND NOT regexp_matches(text, '(?i)\\b(agreed|agrees|decided|confirmed|approved|accepted|settled|finali[sz]ed|will go with|going with|chose|chosen)\\b') THEN 'PROPOSAL' ELSE tag END AS tag2 FROM nt)"""
NOTES = NOTES.replace("\\\\", "\\")


def proposal_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.reclassified(notes(spark, sf_dir)).select("meeting_id", "pos", "tag", "text")


SECTIONS = [(0, "Decisions", "DECISION"), (1, "Actions", "ACTION"), (2, "Open issues", "OPEN-ISSUE"), (3, "Proposals", "PROPOSAL"), (4, "Numbers", "NUMBER")]


def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = spark.createDataFrame(SECTIONS, "ord int, heading string, tag string")
    return N.minutes(N.reclassified(notes(spark, sf_dir)), sections)


MINUTES = f"""WITH {NOTES}, sc(ord, heading, tag) AS (VALUES {", ".join(map(str, SECTIONS))}),
it AS (SELECT meeting_id, ord, string_agg('- ' || regexp_replace(text, '。+$', '') || ' [' || ts || ']', chr(10) ORDER BY pos) AS items FROM rc JOIN sc ON sc.tag = rc.tag2 GROUP BY ALL),
ev AS (SELECT m.meeting_id, sc.ord, '【' || heading || '】' || chr(10) || coalesce(items, '- None') AS section FROM (SELECT DISTINCT meeting_id FROM rc) m CROSS JOIN sc LEFT JOIN it ON it.meeting_id = m.meeting_id AND it.ord = sc.ord)
SELECT meeting_id, string_agg(section, chr(10) ORDER BY ord) AS minutes FROM ev GROUP BY ALL"""


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action items, where every tenth meeting's were edited and every twentieth's deleted."""
    rows = N.reclassified(notes(spark, sf_dir))
    meetings = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("meeting_id")).where("meeting_id % 10 = 0")
    edits = meetings.withColumn("edited", F.when(F.col("meeting_id") % 20 == 0, " - ").otherwise("- edited by hand"))
    return N.actions(rows, edits)


ACTIONS = f"""WITH {NOTES}, d AS (SELECT meeting_id, string_agg('- ' || text || ' [' || ts || ']', chr(10) ORDER BY pos) AS derived FROM rc WHERE tag2 = 'ACTION' GROUP BY ALL),
e AS (SELECT doc_id AS meeting_id, CASE WHEN doc_id % 20 = 0 THEN ' - ' ELSE '- edited by hand' END AS edited FROM documents WHERE doc_id % 10 = 0),
b AS (SELECT coalesce(d.meeting_id, e.meeting_id) AS meeting_id, CASE WHEN edited IS NULL THEN derived WHEN trim(edited) IN ('', '-') THEN NULL ELSE edited END AS actions FROM d FULL JOIN e ON d.meeting_id = e.meeting_id)
SELECT meeting_id, actions FROM b WHERE actions IS NOT NULL"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines as a note-writer's replies, of which some keep to the protocol."""
    k = (F.col("meeting_id") + F.col("utt_idx")) % 7
    start = F.when(k == 0, "NOTE [1:02] (DECISION) ").when(k == 1, "NOTE [0:30] ").when(k == 2, "NOTE [0:31] (WISH) ").when(k == 3, "NOTE ").otherwise("")
    return A.lines(spark, sf_dir).withColumn("text", F.when(k == 4, "NEXT").otherwise(F.concat(start, "text")))


REPLIES = f"""{A.LINES}, rp AS (SELECT meeting_id, utt_idx, CASE (meeting_id + utt_idx) % 7 WHEN 0 THEN 'NOTE [1:02] (DECISION) ' || text WHEN 1 THEN 'NOTE [0:30] ' || text WHEN 2 THEN 'NOTE [0:31] (WISH) ' || text WHEN 3 THEN 'NOTE ' || text WHEN 4 THEN 'NEXT' ELSE text END AS raw FROM lines),
ps AS (SELECT *, trim(raw) AS l, regexp_matches(trim(raw), '^NOTE\\s+\\[(\\d+:\\d\\d(?::\\d\\d)?)\\]\\s*(?:\\(([A-Za-z-]+)\\)\\s*)?(\\S.*)$') AS good FROM rp)""".replace("\\\\", "\\")


def guard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = N.guard_counts(replies(spark, sf_dir))
    return found.withColumn("rate", F.round("rate", 6))


GUARD = rf"""WITH {REPLIES}, k AS (SELECT meeting_id, CASE WHEN l IN ('', 'NEXT') THEN 'ignored' WHEN good THEN 'note' WHEN regexp_matches(l, '^NOTE\b') THEN 'malformed' ELSE 'other' END AS kind,
  good AND upper(regexp_extract(l, '^NOTE\s+\[\d+:\d\d(?::\d\d)?\]\s*\(([A-Za-z-]+)\)', 1)) NOT IN ('', 'DECISION', 'ACTION', 'NUMBER', 'OPEN-ISSUE', 'PROPOSAL') AS odd FROM ps),
c AS (SELECT meeting_id, count(*) FILTER (WHERE kind <> 'ignored') AS lines, count(*) FILTER (WHERE kind = 'note') AS notes, count(*) FILTER (WHERE kind = 'other') AS other, count(*) FILTER (WHERE kind = 'malformed') AS malformed, count(*) FILTER (WHERE kind = 'note' AND odd) AS unknown FROM k GROUP BY ALL)
SELECT *, round(CASE WHEN lines > 0 THEN (other + malformed + unknown) / lines ELSE 0.0 END, 6) AS rate, lines >= 10 AND CASE WHEN lines > 0 THEN (other + malformed + unknown) / lines ELSE 0.0 END > 0.2 AS exceeds FROM c"""


def note_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.capped(notes(spark, sf_dir)).select("meeting_id", "window", "pos", "note_id")


CAP = f"""WITH {NOTES}, r AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, "window" ORDER BY CASE WHEN tag IN ('DECISION', 'ACTION') THEN 0 WHEN tag = 'NUMBER' THEN 1 WHEN tag = 'OPEN-ISSUE' THEN 2 ELSE 3 END, CASE WHEN tag IN ('DECISION', 'ACTION') THEN -pos ELSE pos END) AS r FROM nt)
SELECT meeting_id, "window", pos, row_number() OVER (PARTITION BY meeting_id ORDER BY "window", pos) AS note_id FROM r WHERE r <= 12"""


def journal_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = N.compacted(notes(spark, sf_dir), 900)
    return found.select("meeting_id", F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept"), "omitted")


COMPACT = f"""WITH RECURSIVE {NOTES}, o AS (SELECT meeting_id, pos, length(text) + 24 AS cost, row_number() OVER (PARTITION BY meeting_id ORDER BY CASE tag WHEN 'DECISION' THEN 1 WHEN 'OPEN-ISSUE' THEN 2 WHEN 'ACTION' THEN 3 ELSE 4 END, pos DESC) AS r, count(*) OVER (PARTITION BY meeting_id) AS n FROM nt),
g AS (SELECT meeting_id, 0::BIGINT AS r, 0::BIGINT AS used, []::BIGINT[] AS kept, n FROM (SELECT DISTINCT meeting_id, n FROM o)
  UNION ALL SELECT g.meeting_id, o.r, CASE WHEN used + cost <= 900 THEN used + cost ELSE used END, CASE WHEN used + cost <= 900 THEN list_append(kept, pos) ELSE kept END, g.n FROM g JOIN o ON o.meeting_id = g.meeting_id AND o.r = g.r + 1)
SELECT meeting_id, array_to_string(list_sort(kept), ',') AS kept, n - len(kept) AS omitted FROM g WHERE r = n"""


def near_duplicate_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.lines(spark, sf_dir).where("text <> ''").select("meeting_id", F.col("utt_idx").alias("pos"), "text")
    return N.near_copies(rows)


NEAR = f"""WITH {A.LINES}, n AS (SELECT meeting_id, utt_idx AS pos, text, row_number() OVER (PARTITION BY meeting_id ORDER BY utt_idx) AS i FROM lines WHERE text <> ''),
b AS (SELECT *, CASE WHEN length(text) >= 2 THEN list_distinct(list_transform(range(1, length(text)), lambda k: text[k:k+1])) ELSE [] END AS p FROM n),
j AS (SELECT a.meeting_id, a.pos, o.pos AS other, len(list_intersect(a.p, o.p)) AS x, len(a.p) AS u, len(o.p) AS v FROM b a JOIN b o ON o.meeting_id = a.meeting_id AND o.i < a.i AND o.i >= a.i - 30)
SELECT meeting_id, pos, min(other) AS first_like, CAST(count(*) AS INT) AS n_like FROM j WHERE x / greatest(1, u + v - x) > 0.6 GROUP BY ALL"""


def journal_fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.journal(notes(spark, sf_dir))


def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.language(A.lines(spark, sf_dir))


LANGUAGE = rf"""WITH {A.LINES}, c AS (SELECT meeting_id, CAST(sum(len(regexp_extract_all(text, '[\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}\x{{3040}}-\x{{30FF}}]'))) AS BIGINT) AS characters, CAST(sum(len(regexp_extract_all(text, '[A-Za-z]{{2,}}'))) AS BIGINT) AS words FROM lines GROUP BY ALL)
SELECT *, CASE WHEN characters + words >= 20 THEN CASE WHEN words > characters THEN 'en' ELSE 'zh' END END AS language FROM c"""


def timestamp_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cited times against the starts of the conversations' lines."""
    cites = A.table(spark, sf_dir, "events").select((F.col("event_id") % 97).alias("meeting_id"), F.col("event_id").alias("cite_id"), F.floor(F.col("value") * 2).alias("t"))
    known = A.utterances(spark, sf_dir).select("meeting_id", F.floor("start_s").alias("k"))
    return N.snapped(cites, known).select("meeting_id", "cite_id", "t", "snapped")


SNAP = f"""WITH {A.UTT}, c AS (SELECT event_id % 97 AS meeting_id, event_id AS cite_id, CAST(floor(value * 2) AS BIGINT) AS t FROM events),
b AS (SELECT cite_id, arg_min(k, row(abs(k - t), k)) AS k FROM c JOIN (SELECT DISTINCT meeting_id, CAST(floor(start_s) AS BIGINT) AS k FROM utt) u ON u.meeting_id = c.meeting_id AND abs(k - t) <= 30 GROUP BY ALL)
SELECT c.meeting_id, c.cite_id, c.t, b.k AS snapped FROM c LEFT JOIN b ON b.cite_id = c.cite_id"""


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in brackets of notes with one, two or no times, in order and as seconds."""
    k = F.col("pos") % 3
    rows = notes(spark, sf_dir).withColumn("text", F.concat("text", F.when(k == 0, F.concat(F.lit(" ["), "ts", F.lit("]"))).when(k == 1, F.concat(F.lit(" ["), "ts", F.lit(", 1:05]"))).otherwise("")))
    each = rows.select("meeting_id", "pos", F.posexplode(X.anchors(F.col("text"))).alias("i", "anchor"))
    return each.withColumn("seconds", X.seconds_of(F.col("anchor")))


ANCHORS = f"""WITH {NOTES}, a AS (SELECT meeting_id, pos, unnest(CASE pos % 3 WHEN 0 THEN [row(0, ts, pos * 37)] WHEN 1 THEN [row(0, ts, pos * 37), row(1, '1:05', 65)] ELSE [] END) AS x FROM nt)
SELECT meeting_id, pos, CAST(x[1] AS INT) AS i, x[2] AS anchor, CAST(x[3] AS INT) AS seconds FROM a"""


def owner_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes(spark, sf_dir).where("tag = 'ACTION'")
    items = rows.withColumn("text", F.when(F.col("pos") % 4 != 0, F.concat(F.lit("S"), (F.col("pos") % 4).cast("string"), F.lit(": "), "text")).otherwise(F.col("text")))
    names = rows.select("meeting_id").distinct().withColumn("speaker", F.lit(0)).withColumn("name", F.concat(F.lit("Owner "), F.col("meeting_id").cast("string")))
    return D.owner_groups(items.select("meeting_id", "pos", "text"), names)


OWNERS = f"""WITH {NOTES}, i AS (SELECT meeting_id, pos, text, CASE WHEN pos % 4 = 1 THEN 'Owner ' || meeting_id WHEN pos % 4 > 1 THEN 'Speaker ' || (pos % 4) END AS owner FROM nt WHERE tag = 'ACTION'),
g AS (SELECT meeting_id, owner, min(pos) AS f, count(*) AS n, string_agg(text, chr(10) ORDER BY pos) AS items FROM i GROUP BY ALL)
SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY owner IS NULL, f) AS ord, owner, n, items FROM g"""


def valid_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited times that some line of the meeting starts at."""
    cites = A.table(spark, sf_dir, "events").select((F.col("event_id") % 97).alias("meeting_id"), F.col("event_id").alias("cite_id"), F.floor(F.col("value") * 2).alias("t"))
    starts = A.utterances(spark, sf_dir).select("meeting_id", F.floor("start_s").alias("t"))
    return cites.join(starts, ["meeting_id", "t"], "left_semi").select("meeting_id", "cite_id", "t")


VALID = f"""WITH {A.UTT}, c AS (SELECT event_id % 97 AS meeting_id, event_id AS cite_id, CAST(floor(value * 2) AS BIGINT) AS t FROM events)
SELECT c.* FROM c WHERE EXISTS (SELECT 1 FROM utt u WHERE u.meeting_id = c.meeting_id AND CAST(floor(u.start_s) AS BIGINT) = c.t)"""


def reader_event_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a note-writer's: per meeting and window the tokens, notes kept and dropped, and errors."""
    rows = A.table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("meeting_id"), F.hour("ts").alias("window"), "event_type", F.floor("value").alias("tokens"))
    kind = lambda x: F.count_if(F.col("event_type") == x)
    return rows.groupBy("meeting_id", "window").agg(F.sum("tokens").alias("tokens"), kind("purchase").alias("kept"), kind("view").alias("dropped"), kind("error").alias("errors"), F.count("*").alias("events"))


ROLLUP = """SELECT user_id % 20 AS meeting_id, CAST(hour(ts) AS INT) AS "window", CAST(sum(floor(value)) AS BIGINT) AS tokens, count(*) FILTER (WHERE event_type = 'purchase') AS kept, count(*) FILTER (WHERE event_type = 'view') AS dropped,
count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) AS events FROM events GROUP BY ALL"""

QUERIES = {
    "proposal_guard": (proposal_guard, f"WITH {NOTES} SELECT meeting_id, pos, tag2 AS tag, text FROM rc"),
    "minutes": (minutes, MINUTES),
    "actions": (actions, ACTIONS),
    "guard_counts": (guard_counts, GUARD),
    "note_cap": (note_cap, CAP),
    "journal_compaction": (journal_compaction, COMPACT),
    "near_duplicate_notes": (near_duplicate_notes, NEAR),
    "journal_fates": (journal_fates, None),
    "language_detect": (language_detect, LANGUAGE),
    "timestamp_snap": (timestamp_snap, SNAP),
    "anchors": (anchors, ANCHORS),
    "owner_groups": (owner_groups, OWNERS),
    "valid_citations": (valid_citations, VALID),
    "reader_event_rollup": (reader_event_rollup, ROLLUP),
}
