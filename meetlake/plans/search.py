"""Registered queries of script folding, routing by people, reading segments, imports and links to the directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlake.functions import text as X
from meetlake.operators import library as L
from meetlake.operators import mail as M
from meetlake.operators import notes as N
from meetlake.operators import passages as P
from meetlake.operators import people as O
from meetlake.operators import retrieval as R
from meetlake.operators.script import OTHER, staged
from meetlake.plans import adapters as A
from meetlake.plans import people as Q
from meetlake.plans.passages import TOKENS
from meetlake.plans.retrieval import LEXICAL, LIBRARY_RRF, ROUTING, dense_hits, keyword_hits, library_rrf

#: A dictionary of phrases that overlap and lie inside each other, and one of characters that also reads what the first one writes.
PHRASES = (("tion", "XN"), ("ing", "NG"), ("the", "D7"), ("ti", "7"), ("in", "1"), ("he", "H"), ("and", "and"), ("nd", "Q"))
CHARACTERS = (("X", "ks"), ("7", "s"), ("e", "i"), ("Q", "nt"))


def dictionaries(spark: SparkSession) -> list[DataFrame]:
    return [spark.createDataFrame(list(x), "key string, to string") for x in (PHRASES, CHARACTERS)]


def fold_sql(text: str) -> str:
    """The two stages as SQL: phrases are marked from the left, the longest first, and then written; characters follow."""
    marked = f"regexp_replace({text}, '({'|'.join(k for k, _ in PHRASES)})', chr(1) || '\\1' || chr(2), 'g')"
    for key, to in PHRASES:
        marked = f"replace({marked}, chr(1) || '{key}' || chr(2), '{to}')"
    for key, to in CHARACTERS:
        marked = f"replace({marked}, '{key}', '{to}')"
    return f"CASE WHEN regexp_matches({text}, '{OTHER}') THEN {text} ELSE {marked} END"


def script_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents through both dictionaries."""
    found = staged(A.spread(A.table(spark, sf_dir, "documents").select("doc_id", "text")), dictionaries(spark), "doc_id")
    return found.select("doc_id", F.sha2("text", 256).alias("text_sha256"))


STAGES = f"SELECT doc_id, sha256({fold_sql('text')}) AS text_sha256 FROM documents"


def lexical_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lexical_hits with both sides in one script: a word is found in either spelling."""
    rows = A.lines(spark, sf_dir).where("text <> ''").select("meeting_id", F.col("utt_idx").alias("pos"), "text")
    kind = F.when(F.col("pos") == 0, "title").when(F.col("pos") == 1, "summary").when(F.col("pos") % 2 == 0, "note").otherwise("line")
    word = lambda k: F.split_part("text", F.lit(" "), F.lit(k))
    asked = A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.replace(F.concat_ws(" ", word(2), word(3)), F.lit("tion"), F.lit("ksN")).alias("query"), (F.col("item_id") * 5).alias("open_meeting"))
    return R.lexical(rows.withColumn("kind", kind), asked, dictionaries=dictionaries(spark)).select("query_id", "meeting_id", "rank", "kind", "pos", "score")


_word = lambda k: fold_sql(f"lower(replace(split_part(text, ' ', {k}), 'tion', 'ksN'))")
LEXICAL_SCRIPT = LEXICAL.replace("lower(text) AS text", fold_sql("lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))") + " AS text").replace("lower(split_part(text, ' ', 2))", _word(2)).replace("lower(split_part(text, ' ', 3))", _word(3))


def routing_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meetings for questions of which some name people, whose meetings come first where they have a hit; a third of these people have none. Of each
    question also how many meetings its people were in."""
    names = A.table(spark, sf_dir, "benchmark").where("item_id % 3 = 0").select(F.concat(F.lit("p"), F.col("item_id").cast("string")).alias("person_id"), F.split_part("text", F.lit(" "), F.lit(3)).alias("name"))
    names = names.where(F.col("name").rlike("^[A-Za-z]+$"))
    number = F.expr("cast(substring(person_id, 2) as bigint)")
    links = names.select("person_id", F.explode(F.when(number % 9 == 0, F.array(F.lit(99))).otherwise(F.array((number * 7) % 20, (number * 11) % 20))).alias("meeting_id"), F.lit(1).alias("speaker"))
    asked = A.queries(spark, sf_dir).select("query_id", "query")
    named = O.named_speakers(O.mentioned(asked, names), links)
    words = keyword_hits(spark, sf_dir, 3, "meeting_id").select("query_id", "meeting_id", F.round("score", 6).alias("score"))
    near = dense_hits(spark, sf_dir).select("query_id", "meeting_id", F.col("cosine").alias("score"))
    counts = named.groupBy("query_id").agg(F.count("*").alias("meetings"))
    return R.routed(near, words, named=named).join(counts, "query_id", "left").select("query_id", "rank", "meeting_id", F.round("score", 6).alias("score"), F.coalesce("meetings", F.lit(0)).alias("meetings"))


_HEAD, _TAIL = ROUTING.split("rk AS (", 1)
ROUTING_NAMED = f"""{_HEAD}nm AS (SELECT item_id AS p, lower(split_part(text, ' ', 3)) AS k FROM benchmark WHERE item_id % 3 = 0 AND regexp_matches(split_part(text, ' ', 3), '^[A-Za-z]+$')),
qq AS (SELECT item_id AS query_id, ' ' || regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' ' AS q FROM benchmark),
lk AS (SELECT p, unnest(CASE WHEN p % 9 = 0 THEN [99] ELSE [(p * 7) % 20, (p * 11) % 20] END) AS meeting_id FROM nm),
na AS (SELECT DISTINCT query_id, lk.meeting_id FROM qq JOIN nm ON contains(q, ' ' || k || ' ') JOIN lk ON lk.p = nm.p),
al AS (SELECT 0 AS l, query_id, meeting_id, t FROM d2 UNION ALL SELECT 1, query_id, meeting_id, t FROM k2),
am AS (SELECT al.*, na.meeting_id IS NOT NULL AS hit, bool_or(na.meeting_id IS NOT NULL) OVER (PARTITION BY al.query_id) AS few FROM al LEFT JOIN na ON na.query_id = al.query_id AND na.meeting_id = al.meeting_id),
rk AS (SELECT query_id, meeting_id, row_number() OVER (PARTITION BY l, query_id ORDER BY round(t, 9) DESC, meeting_id) AS r FROM am WHERE hit OR NOT few),
fu AS (SELECT query_id, meeting_id, sum(1.0::DOUBLE / (60 + r)) AS score FROM rk GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, meeting_id) AS rank FROM fu)
SELECT query_id, rank, meeting_id, round(score, 6) AS score, (SELECT count(*) FROM na WHERE na.query_id = t.query_id) AS meetings FROM t WHERE rank <= 2"""


def reading_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as they are read in windows of 120 tokens and segments of 20 seconds; longer lines in pieces."""
    rows = A.utterances(spark, sf_dir).select("meeting_id", "utt_idx", F.floor("start_s").cast("int").alias("start"), F.concat(F.lit("S"), (F.col("speaker") + 1).cast("string")).alias("label"), "text")
    return P.reading_segments(rows, 120)


_tokens = lambda x: TOKENS.replace("text,", f"{x},")
SEGMENTS = rf"""WITH RECURSIVE {A.UTT}, l0 AS (SELECT meeting_id, utt_idx, CAST(floor(start_s) AS INT) AS s, speaker, text FROM utt),
l AS (SELECT *, '[' || CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END || '] S' || (speaker + 1) || ': ' AS h FROM l0),
c AS (SELECT meeting_id, utt_idx, s, h, -1 AS piece, '' AS own, text AS rest FROM l
  UNION ALL SELECT meeting_id, utt_idx, s, h, piece + 1, substring(rest, 1, cut), substring(rest, cut + 1) FROM (
    SELECT *, CASE WHEN piece = -1 AND {_tokens('(h || rest)')} <= 120 THEN length(rest) WHEN sign - 1 >= lo // 2 THEN sign ELSE lo END AS cut FROM (
      SELECT *, length(regexp_extract(substring(rest, 1, CAST(lo AS INT)), '(?s)^(.*[。？！?!；;，,])', 1)) AS sign FROM (
        SELECT *, greatest(1, list_max(list_filter(range(1, length(rest) + 1), lambda k: {_tokens('(h || substring(rest, 1, CAST(k AS INT)))')} <= 120))) AS lo FROM c WHERE rest <> '' OR piece = -1)))),
p AS (SELECT meeting_id, utt_idx, piece, s, own AS text, {_tokens('(h || own)')} AS tokens, row_number() OVER (PARTITION BY meeting_id ORDER BY utt_idx, piece) AS i FROM c WHERE piece >= 0),
r AS (SELECT meeting_id, utt_idx, piece, i, 0 AS w, 0 AS g, tokens AS used, s + 20 AS e, false AS closed, text, tokens FROM p WHERE i = 1
  UNION ALL SELECT p.meeting_id, p.utt_idx, p.piece, p.i, r.w + CASE WHEN o.opens THEN 1 ELSE 0 END, CASE WHEN o.opens THEN 0 ELSE r.g + CASE WHEN r.closed THEN 1 ELSE 0 END END, CASE WHEN o.opens THEN p.tokens ELSE r.used + p.tokens END,
    CASE WHEN o.opens THEN p.s + 20 WHEN p.s >= r.e THEN p.s + 20 ELSE r.e END, NOT o.opens AND p.s >= r.e, p.text, p.tokens
  FROM r JOIN p ON p.meeting_id = r.meeting_id AND p.i = r.i + 1, LATERAL (SELECT r.used + p.tokens > 120 AS opens) o)
SELECT meeting_id, utt_idx, piece, w AS "window", g AS segment, text, CAST(tokens AS INT) AS tokens FROM r"""


def import_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as interchange documents of four kinds, by notes (a journal, a journal, sections, prose) and action items (as the notes give them,
    edited, none, blank); every eleventh is broken."""
    lines = A.utterances(spark, sf_dir)
    k = F.col("meeting_id")
    spoken = lines.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct(F.col("utt_idx").cast("int").alias("index"), F.col("start_s").alias("start"), F.col("end_s").alias("end"), "text", "speaker"))).alias("utterances"))
    notes = F.when(k % 4 < 2, F.concat(F.lit("#1 [0:05] (ACTION) Send it "), k.cast("string"), F.lit("\n#2 [0:09] (ACTION) Maybe wait\nno note\n#3 [1:00] Seen"))).when(k % 4 == 2, "TOPIC: Plans\n- one\nDECISIONS:\n- two").otherwise("only prose")
    own = F.concat(F.lit("- Send it "), k.cast("string"), F.lit(" [0:05]"))
    actions = F.when(k % 5 == 0, F.concat(F.lit(" "), own, F.lit("\n"))).when(k % 5 == 1, F.concat(own, F.lit(" edited"))).when(k % 5 == 2, "-").when(k % 5 == 3, "  ")
    names = F.create_map(F.lit("0"), F.struct(F.lit("").alias("name"), F.lit("x").alias("person")), F.lit("1"), F.struct(F.lit("Ann").alias("name"), F.lit("").alias("person")))
    body = F.struct(F.when(k % 3 != 0, "T").alias("title"), F.lit("S").alias("summary"), notes.alias("notes"), actions.alias("action_items"), F.lit("m1").alias("llm_model"), names.alias("speaker_names"), "utterances")
    documents = spoken.select("meeting_id", F.when(k % 11 == 0, "{broken").otherwise(F.to_json(body)).alias("manifest"))

    def derived(rows: DataFrame) -> DataFrame:
        told = N.reclassified(rows.withColumn("pos", F.col("note_idx")))
        return N.actions(told, told.select("meeting_id", F.lit(None).cast("string").alias("edited")).where("false"))

    meetings, spoken_lines, links, kept = M.imported(documents, derived)
    sizes = spoken_lines.groupBy("meeting_id").agg(F.count("*").alias("lines")).join(kept.groupBy("meeting_id").agg(F.count("*").alias("notes")), "meeting_id", "left").join(links.groupBy("meeting_id").agg(F.max(F.concat_ws("/", "name", F.coalesce("person_id", F.lit("nobody")))).alias("link")), "meeting_id", "left")
    return meetings.join(sizes, "meeting_id").withColumn("notes", F.coalesce("notes", F.lit(0)))


IMPORT = f"""WITH {A.UTT}, m AS (SELECT meeting_id AS k, count(*) AS lines, arg_max(end_s, utt_idx) AS seconds FROM utt WHERE meeting_id % 11 <> 0 GROUP BY ALL)
SELECT k AS meeting_id, CASE WHEN k % 3 <> 0 THEN 'T' ELSE '' END AS title, 'S' AS summary, seconds, 'm1' AS reader, CASE WHEN k % 4 = 2 THEN 'TOPIC: Plans' || chr(10) || '- one' || chr(10) || 'DECISIONS:' || chr(10) || '- two' END AS legacy_notes,
  CASE k % 5 WHEN 0 THEN CASE WHEN k % 4 >= 2 THEN '- Send it ' || k || ' [0:05]' END WHEN 1 THEN '- Send it ' || k || ' [0:05] edited' END AS actions_edited, lines, CASE WHEN k % 4 < 2 THEN 3 ELSE 0 END AS notes, 'Ann/nobody' AS link FROM m"""


def directory_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' customers looked up in the directory, or added to it: links of all speakers, with the person's last use."""
    people = Q.directory(spark, sf_dir).select("person_id", "name", F.lit(1).cast("long").alias("created"), F.lit(2).cast("long").alias("last_used"))
    names = Q.order_links(spark, sf_dir).withColumn("date", F.unix_seconds(F.col("date").cast("timestamp")))
    after, links = O.linked_up(names, people)
    return links.join(after.select("person_id", F.col("name").alias("person"), "last_used"), "person_id")


LINKED = f"""WITH {Q.LINKS}, {Q.PEOPLE}, v AS (SELECT meeting_id, speaker, lk.name, lk.person_id, false AS added FROM lk JOIN pp ON pp.person_id = lk.person_id),
f AS (SELECT meeting_id, CAST(epoch(date) AS BIGINT) AS d, speaker, lk.name, {Q.KEY.replace('name', 'lk.name')} AS key FROM lk LEFT JOIN pp ON pp.person_id = lk.person_id WHERE pp.person_id IS NULL AND NOT regexp_matches(trim(lk.name), '(?i)^speaker\\s*\\d+$')),
n AS (SELECT key, arg_min(trim(name), row(-d, meeting_id, speaker)) AS spelling, max(d) AS used FROM f GROUP BY key), k AS (SELECT {Q.KEY} AS key, min(person_id) AS person_id FROM pp GROUP BY 1),
o AS (SELECT n.*, coalesce(k.person_id, substring(sha256(n.key), 1, 16)) AS person_id, k.person_id IS NULL AS made FROM n LEFT JOIN k ON k.key = n.key),
w AS (SELECT pp.person_id, pp.name, greatest(2, coalesce(o.used, 2)) AS last_used FROM pp LEFT JOIN o ON o.person_id = pp.person_id AND NOT made UNION ALL SELECT person_id, spelling, used FROM o WHERE made),
l AS (SELECT * FROM v UNION ALL SELECT f.meeting_id, f.speaker, trim(f.name), o.person_id, true FROM f JOIN o ON o.key = f.key)
SELECT l.meeting_id, l.speaker, l.name, l.person_id, l.added, w.name AS person, w.last_used FROM l JOIN w ON w.person_id = l.person_id"""

def person_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.chips(Q.directory(spark, sf_dir), Q.usage(spark, sf_dir))


CHIPS = f"""WITH {Q.PEOPLE}, u AS ({Q.USAGE}), c AS (SELECT pp.person_id, pp.name, coalesce(meetings, 0) AS n FROM pp LEFT JOIN u ON u.person_id = pp.person_id)
SELECT person_id, row_number() OVER (ORDER BY n DESC, name, person_id) AS ord, name || ' · ' || n || CASE n WHEN 1 THEN ' meeting' ELSE ' meetings' END AS chip FROM c"""


def library_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of twenty meetings those that are done and found by each question, in the order of its hits."""
    meetings = spark.range(20).select(F.col("id").alias("meeting_id"), F.concat(F.lit("Meeting "), F.col("id").cast("string")).alias("title"), (F.col("id") % 4 != 0).alias("done"), F.lit(1).alias("date"))
    hits = R.top(library_rrf(spark, sf_dir), ["query_id"], [F.desc("score"), "meeting_id"], 20)
    return L.found_first(L.filtered(meetings, hits, done_only=True), hits).select("query_id", "rank", "meeting_id", "title")


FOUND = f"""WITH h AS ({LIBRARY_RRF}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, meeting_id) AS rank FROM h)
SELECT query_id, rank, meeting_id, 'Meeting ' || meeting_id AS title FROM r WHERE meeting_id % 4 <> 0"""


def lenient_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of events in forms good and bad."""
    n = F.col("event_id")
    text = F.get(F.array(F.concat((n % 70).cast("string"), F.lit(":"), (n % 60).cast("string")), F.concat(F.lit("1:"), (n % 60).cast("string"), F.lit(":7.5")), F.concat(F.lit("x:"), n.cast("string"), F.lit(":9")), n.cast("string"), F.lit("1:2:3:4"), F.lit("")), (n % 6).cast("int"))
    return A.table(spark, sf_dir, "events").select("event_id", X.lenient_seconds(text).alias("seconds"))


LENIENT = """WITH t AS (SELECT event_id AS n, CASE event_id % 6 WHEN 0 THEN (event_id % 70) || ':' || (event_id % 60) WHEN 1 THEN '1:' || (event_id % 60) || ':7.5' WHEN 2 THEN 'x:' || event_id || ':9' WHEN 3 THEN CAST(event_id AS VARCHAR) WHEN 4 THEN '1:2:3:4' ELSE '' END AS x FROM events),
p AS (SELECT n, list_filter(list_transform(string_split(x, ':'), lambda y: TRY_CAST(y AS DOUBLE)), lambda y: y IS NOT NULL) AS p FROM t)
SELECT n AS event_id, CASE len(p) WHEN 3 THEN p[1] * 3600 + p[2] * 60 + p[3] WHEN 2 THEN p[1] * 60 + p[2] ELSE 0.0 END AS seconds FROM p"""

QUERIES = {
    "script_stages": (script_stages, STAGES),
    "lexical_script": (lexical_script, LEXICAL_SCRIPT),
    "routing_named": (routing_named, ROUTING_NAMED),
    "reading_segments": (reading_segments, SEGMENTS),
    "import_documents": (import_documents, IMPORT),
    "directory_links": (directory_links, LINKED),
    "person_chips": (person_chips, CHIPS),
    "library_found": (library_found, FOUND),
    "lenient_times": (lenient_times, LENIENT),
}
