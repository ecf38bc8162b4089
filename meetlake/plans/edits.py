"""Registered queries of edits, answers, mails and voices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meetlake.functions import text as X
from meetlake.operators import ask as K
from meetlake.operators import edits as E
from meetlake.operators import library as L
from meetlake.operators import mail as M
from meetlake.operators import passages as P
from meetlake.operators import render as D
from meetlake.operators import retrieval as T
from meetlake.operators import voice as V
from meetlake.operators.people import ordered
from meetlake.operators.script import converted
from meetlake.operators.snap import snapped_pieces
from meetlake.plans import adapters as A
from meetlake.plans import notes as N
from meetlake.plans import passages as Q
from meetlake.plans import people as O
from meetlake.plans import retrieval as R
from meetlake.sources.settled import settle


def relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant turn after the fourth goes to speaker 5, then every fifth line to speaker 6; how many lines each has."""
    lines = A.utterances(spark, sf_dir)
    edits = lines.where("speaker = 2 and utt_idx > 3").select("meeting_id", "utt_idx", F.lit(1).alias("seq"), F.lit(5).alias("new_speaker"))
    edits = edits.unionByName(lines.where("utt_idx % 5 = 4").select("meeting_id", "utt_idx", F.lit(2).alias("seq"), F.lit(6).alias("new_speaker")))
    links = lines.select("meeting_id", "speaker").distinct().withColumn("name", F.lit("n"))
    new, left = E.relabelled(lines, edits, links)
    counts = new.groupBy("meeting_id", "speaker").agg(F.count("*").alias("lines"))
    return counts.join(left, ["meeting_id", "speaker"], "left").select("meeting_id", "speaker", "lines", F.col("name").isNotNull().alias("linked"))


RELABEL = f"""WITH {A.UTT}, n AS (SELECT meeting_id, utt_idx, speaker AS old, CASE WHEN utt_idx % 5 = 4 THEN 6 WHEN speaker = 2 AND utt_idx > 3 THEN 5 ELSE speaker END AS speaker FROM utt),
c AS (SELECT meeting_id, speaker, count(*) AS lines FROM n GROUP BY ALL)
SELECT meeting_id, speaker, lines, EXISTS (SELECT 1 FROM n WHERE n.meeting_id = c.meeting_id AND n.old = c.speaker) AS linked FROM c"""


def other_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.other_speakers(A.utterances(spark, sf_dir)).withColumn("others", F.array_join(F.col("others").cast("array<string>"), ","))


OTHERS = f"""WITH {A.UTT}, a AS (SELECT DISTINCT meeting_id, speaker FROM utt)
SELECT u.meeting_id, u.utt_idx, coalesce(string_agg(CAST(a.speaker AS VARCHAR), ',' ORDER BY a.speaker), '') AS others FROM utt u LEFT JOIN a ON a.meeting_id = u.meeting_id AND a.speaker <> u.speaker GROUP BY ALL"""


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.utterances(spark, sf_dir).withColumn("token_times", F.lit(None).cast("array<double>"))


def token_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.token_starts(timed(spark, sf_dir)).select("meeting_id", "utt_idx", "k", "token", "at")


_TOKENS = r"(?:^[^\p{L}\p{N}]+)?[\p{L}\p{N}]+[^\p{L}\p{N}]*|^[^\p{L}\p{N}]+$"
TOKEN_STARTS = rf"""WITH {A.UTT}, t AS (SELECT *, regexp_extract_all(text, '{_TOKENS}') AS ts FROM utt), e AS (SELECT meeting_id, utt_idx, start_s, end_s, ts, unnest(range(len(ts))) AS k FROM t),
v AS (SELECT *, ts[k + 1] AS token, greatest(1, length(regexp_replace(ts[k + 1], '[\s\x0B]', '', 'g'))) AS n FROM e)
SELECT meeting_id, utt_idx, CAST(k AS INT) AS k, token, start_s + (end_s - start_s) * coalesce(sum(n) OVER (PARTITION BY meeting_id, utt_idx ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER (PARTITION BY meeting_id, utt_idx) AS at FROM v"""


def boundary_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = A.utterances(spark, sf_dir)
    moves = lines.where("utt_idx = 0").select("meeting_id", F.lit(0).alias("seam"), (2 + F.col("meeting_id") % 5).alias("k"))
    return E.moved_boundaries(lines, moves).withColumn("start_s", F.round("start_s", 3)).withColumn("end_s", F.round("end_s", 3))


def line_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = A.utterances(spark, sf_dir)
    splits = lines.where("utt_idx = 1").select("meeting_id", "utt_idx", F.lit(3).alias("k"), F.lit(9).alias("new_speaker"))
    return E.split_lines(lines, splits).withColumn("start_s", F.round("start_s", 3)).withColumn("end_s", F.round("end_s", 3))


def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as edits, undos and redos: how many hold, and the last that does."""
    action = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "redo").otherwise("edit")
    found = E.edit_state(A.table(spark, sf_dir, "events").select(F.col("user_id").alias("meeting_id"), F.col("event_id").alias("seq"), action.alias("action")))
    return found.select("meeting_id", F.size("done").alias("holds"), F.try_element_at("done", F.lit(-1)).alias("last"), F.size("undone").alias("undone"))


def long_line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.long_lines(A.utterances(spark, sf_dir)).withColumn("start_s", F.round("start_s", 3)).withColumn("end_s", F.round("end_s", 3))


def sentence_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = A.lines(spark, sf_dir).select("meeting_id", F.col("utt_idx").alias("pos"), (F.col("utt_idx") % 3).alias("speaker"), F.when(F.col("utt_idx") % 2 == 0, F.concat("text", F.lit("! so"))).otherwise(F.col("text")).alias("text"))
    return E.sentence_snapped(lines)


_END = "[。？！?!]"
SNAPPED = f"""WITH RECURSIVE {A.LINES}, p AS (SELECT meeting_id, CAST(utt_idx AS BIGINT) AS pos, CASE WHEN utt_idx % 2 = 0 THEN text || '! so' ELSE text END AS text, lead(utt_idx) OVER (PARTITION BY meeting_id ORDER BY utt_idx) IS NOT NULL AS more FROM lines),
s AS (SELECT meeting_id, pos, text AS t, more FROM p WHERE pos = 0
  UNION ALL SELECT p.meeting_id, p.pos, CASE WHEN s.more AND regexp_matches(s.t, '(?s){_END}.{{1,3}}$') THEN regexp_extract(s.t, '(?s)^(.*{_END})(.{{1,3}})$', 2) ELSE '' END || p.text, p.more FROM s JOIN p ON p.meeting_id = s.meeting_id AND p.pos = s.pos + 1)
SELECT meeting_id, pos, CASE WHEN more AND regexp_matches(t, '(?s){_END}.{{1,3}}$') THEN regexp_extract(t, '(?s)^(.*{_END})(.{{1,3}})$', 1) ELSE t END AS text FROM s"""


def offsets(lines: DataFrame) -> DataFrame:
    return lines.groupBy("meeting_id").agg(F.lit(40_000.0).alias("offset_s"))


def enrolment_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = A.turns(spark, sf_dir).withColumnRenamed("turn_id", "utt_idx")
    return E.enrolment(turns, offsets(turns)).withColumn("start_s", F.round("start_s", 3)).withColumn("end_s", F.round("end_s", 3))


def enrolment_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = A.turns(spark, sf_dir).withColumnRenamed("turn_id", "utt_idx")
    times = turns.select("meeting_id", F.col("utt_idx").alias("q_id"), F.round(F.col("start_s") / 500, 3).alias("t"))
    found = E.from_enrolment(times, E.enrolment(turns, offsets(turns)), offsets(turns))
    return found.select("meeting_id", "q_id", "t", F.round("original", 3).alias("original"))


def enrolment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = A.turns(spark, sf_dir).withColumnRenamed("turn_id", "utt_idx")
    played = turns.select("meeting_id", "utt_idx", F.round(F.col("start_s") / 500, 3).alias("start_s"), F.round(F.col("start_s") / 500 + F.col("utt_idx") % 9, 3).alias("end_s"))
    found = E.lines_from_enrolment(played, E.enrolment(turns, offsets(turns)), offsets(turns))
    return found.select("meeting_id", "utt_idx", F.round("original_start", 3).alias("original_start"), F.round("original_end", 3).alias("original_end"))


CLIPS = f"""{A.TURNS}, us AS (SELECT t.*, f.o, row_number() OVER (PARTITION BY t.meeting_id ORDER BY f.o, t.start_s - t.end_s, t.turn_id) AS i FROM turns t JOIN (SELECT meeting_id, speaker, min(turn_id) AS o FROM turns GROUP BY ALL) f ON f.meeting_id = t.meeting_id AND f.speaker = t.speaker
  WHERE t.end_s <= 40000 AND t.end_s - t.start_s >= 1),
fo AS (SELECT meeting_id AS m, 0::BIGINT AS i, -1 AS speaker, 0.0::DOUBLE AS got, false AS shut, 0.0::DOUBLE AS total, NULL::DOUBLE AS a, NULL::DOUBLE AS b FROM (SELECT DISTINCT meeting_id FROM us)
  UNION ALL SELECT m, u.i, u.speaker, g.got + CASE WHEN takes THEN n ELSE 0 END, NOT takes, total + CASE WHEN takes THEN n ELSE 0 END, CASE WHEN takes THEN u.start_s END, CASE WHEN takes THEN u.start_s + n END
  FROM fo JOIN us u ON u.meeting_id = fo.m AND u.i = fo.i + 1, LATERAL (SELECT CASE WHEN fo.speaker = u.speaker THEN fo.got ELSE 0.0::DOUBLE END AS got, fo.speaker = u.speaker AND fo.shut AS closed) g,
    LATERAL (SELECT least(-(u.start_s - u.end_s), 6 - g.got, 60 - fo.total) AS n) k, LATERAL (SELECT NOT g.closed AND n >= 1 AS takes) t),
cl AS (SELECT m AS meeting_id, row_number() OVER (PARTITION BY m ORDER BY i) - 1 AS clip, speaker, a AS start_s, b AS end_s FROM fo WHERE a IS NOT NULL)"""
ENROLMENT_CLIPS = f"WITH RECURSIVE {CLIPS} SELECT meeting_id, CAST(clip AS INT) AS clip, speaker, round(start_s, 3) AS start_s, round(end_s, 3) AS end_s FROM cl"
_LAID = """la AS (SELECT *, coalesce(sum(end_s - start_s + 1.0::DOUBLE) OVER (PARTITION BY meeting_id ORDER BY clip ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS p FROM cl),
lz AS (SELECT *, p + (end_s - start_s + 1.0::DOUBLE) AS z FROM la), le AS (SELECT meeting_id, max(z) AS w FROM lz GROUP BY ALL)"""
ENROLMENT_MAP = f"""WITH RECURSIVE {CLIPS}, {_LAID}, t AS (SELECT meeting_id, turn_id AS q_id, round(start_s / 500, 3) AS t FROM turns)
SELECT t.meeting_id, q_id, t, round(CASE WHEN lz.p IS NOT NULL THEN least(lz.start_s + t - lz.p, lz.end_s) ELSE t - coalesce(w, 0.0) + 40000 END, 3) AS original
FROM t LEFT JOIN le ON le.meeting_id = t.meeting_id LEFT JOIN lz ON lz.meeting_id = t.meeting_id AND t.t >= lz.p AND t.t < lz.z"""
ENROLMENT_LINES = f"""WITH RECURSIVE {CLIPS}, {_LAID}, t AS (SELECT meeting_id, turn_id AS utt_idx, round(start_s / 500, 3) AS a, round(start_s / 500 + turn_id % 9, 3) AS b FROM turns),
j AS (SELECT t.*, coalesce(w, 0.0) AS w, x.start_s AS s1, x.end_s AS e1, x.p AS p1, y.start_s AS s2, y.end_s AS e2, y.p AS p2 FROM t LEFT JOIN le ON le.meeting_id = t.meeting_id
  LEFT JOIN lz x ON x.meeting_id = t.meeting_id AND t.a >= x.p AND t.a < x.z LEFT JOIN lz y ON y.meeting_id = t.meeting_id AND t.b >= y.p AND t.b < y.z)
SELECT meeting_id, utt_idx, round(CASE WHEN p1 IS NULL THEN a - w + 40000 WHEN a - p1 < e1 - s1 THEN s1 + (a - p1) WHEN p2 IS NULL THEN 40000 WHEN p2 = p1 THEN e1 ELSE s2 END, 3) AS original_start,
  round(CASE WHEN p1 IS NULL THEN CASE WHEN p2 IS NULL THEN b - w + 40000 ELSE least(s2 + b - p2, e2) END WHEN a - p1 < e1 - s1 THEN greatest(s1 + (a - p1), least(e1, s1 + (b - p1)))
    WHEN p2 IS NULL THEN greatest(40000, b - w + 40000) WHEN p2 = p1 THEN e1 ELSE least(e2, s2 + (b - p2)) END, 3) AS original_end FROM j"""


def unindexed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations without an index, in chunks by estimated tokens, with their texts cut."""
    return P.span_texts(P.chunks(Q.counted(spark, sf_dir)), A.utterances(spark, sf_dir), 1200)


UNINDEXED = Q.PASSAGE_TEXT.replace("1, 200)", "1, 1200)")


def ask_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by meaning and by words are found once, for the routing and for the candidates."""
    near = settle(R.dense_hits(spark, sf_dir).select("query_id", "meeting_id", F.col("vec_id").alias("passage"), "cosine", (F.col("vec_id") % 3 == 0).alias("is_note"), (F.col("vec_id") % 7 == 0).alias("named")), "near")
    words = settle(R.keyword_hits(spark, sf_dir, 16, "meeting_id").select("query_id", "meeting_id", F.col("doc_id").alias("passage"), F.round("score", 6).alias("score")), "words")
    routed = T.routed(near.select("query_id", "meeting_id", F.col("cosine").alias("score")), words.select("query_id", "meeting_id", "score"))
    return K.candidates(near, words, routed.select("query_id", "meeting_id"))


def ask_fusion_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ask_candidates(spark, sf_dir).where("rank <= 20").select("query_id", "rank", "passage", "meeting_id", "routed", F.round("score", 6).alias("score"))


ASK = f"""WITH {R.ROUTING[5:].replace("SELECT query_id, rank, meeting_id, round(score, 6) AS score FROM t WHERE rank <= 2", ", ro AS (SELECT query_id, meeting_id FROM t WHERE rank <= 2)")},
da AS (SELECT dn.query_id, dn.meeting_id, dn.vec_id AS passage, ro.meeting_id IS NOT NULL AS routed, round(cosine + CASE WHEN vec_id % 3 = 0 OR vec_id % 7 = 0 THEN 0.05 ELSE 0.0 END, 9) AS by_ FROM dn LEFT JOIN ro ON ro.query_id = dn.query_id AND ro.meeting_id = dn.meeting_id),
wa AS (SELECT bm.query_id, doc_id % 20 AS meeting_id, doc_id AS passage, ro.meeting_id IS NOT NULL AS routed, round(score, 6) AS by_ FROM bm LEFT JOIN ro ON ro.query_id = bm.query_id AND ro.meeting_id = doc_id % 20),
un AS (SELECT 0 AS l, * FROM da UNION ALL SELECT 1 AS l, * FROM wa),
tr AS (SELECT *, row_number() OVER (PARTITION BY l, query_id, meeting_id ORDER BY by_ DESC, passage) AS r1 FROM un),
rk2 AS (SELECT *, row_number() OVER (PARTITION BY l, query_id ORDER BY by_ DESC, passage) AS rk FROM tr WHERE r1 <= CASE WHEN routed THEN 16 ELSE 4 END),
fz AS (SELECT query_id, meeting_id, passage, routed, sum(1.0::DOUBLE / (60 + rk)) AS score, min(row(l, rk)) AS seen FROM rk2 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY routed DESC, round(score, 12) DESC, seen, passage) AS rank FROM fz)
SELECT query_id, rank, passage, meeting_id, routed, round(score, 6) AS score FROM o WHERE rank <= 20"""


def excerpt_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts chosen from candidates that stand for chunks of conversations."""
    found = ask_candidates(spark, sf_dir).where("rank <= 40")
    lines = Q.counted(spark, sf_dir).select("meeting_id", F.col("utt_idx").cast("int").alias("utt_idx"), "text", "tokens")
    size = lines.groupBy("meeting_id").agg(F.count("*").alias("n"))
    meetings = size.agg(F.count("*").alias("m"), F.min("meeting_id").alias("o"))
    found = found.crossJoin(meetings).withColumn("meeting_id", F.col("o") + F.col("passage") % F.col("m")).join(size, "meeting_id")  # a passage stands for two lines of a conversation
    a = (F.floor(F.col("passage") / F.col("m")) % F.col("n")).cast("int")
    spans = found.select("query_id", "rank", "meeting_id", a.alias("a"), (a + 1).alias("b"), "score")
    texts = P.span_texts(spans, lines.withColumn("start_s", F.lit(0.0))).withColumn("tokens", X.token_estimate(F.col("text")))
    return K.selected(texts.drop("start_s"), lines).withColumn("score", F.round("score", 6))


def pool_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found excerpts of all questions of a conversation, numbered through; questions stand in conversations of four."""
    found = R.hybrid_rrf_top3(spark, sf_dir).select(F.floor(F.col("query_id") / 4).alias("conversation"), F.col("query_id").alias("turn"), F.col("rank").alias("pos"), "doc_id")
    return K.pooled(found)


POOL = f"""WITH x AS ({R.HYBRID}) SELECT CAST(query_id // 4 AS BIGINT) AS conversation, query_id AS turn, rank AS pos, doc_id, row_number() OVER (PARTITION BY query_id // 4 ORDER BY query_id, rank) AS k FROM x"""


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that cite excerpts by number, with places put in and runs collapsed."""
    pool = settle(pool_numbers(spark, sf_dir).select("conversation", "k", F.col("doc_id").alias("meeting_id"), (F.col("doc_id") % 100).alias("sec")), "pool")
    answers = pool.select("conversation").distinct().withColumn("answer", F.concat(F.lit("As said [[1]], [[1]] and [2], [[2]], [[3]] but not [[99]] of "), F.col("conversation").cast("string")))
    return K.expanded(answers, pool).select("conversation", K.collapsed(F.col("expanded")).alias("answer"))


CITATIONS = f"""WITH x AS ({R.HYBRID}), p AS (SELECT CAST(query_id // 4 AS BIGINT) AS c, '[[' || doc_id || '@' || (doc_id % 100) || ']]' AS tag, row_number() OVER (PARTITION BY query_id // 4 ORDER BY query_id, rank) AS k FROM x),
t AS (SELECT c, max(tag) FILTER (WHERE k = 1) AS a, max(tag) FILTER (WHERE k = 2) AS b, max(tag) FILTER (WHERE k = 3) AS d FROM p GROUP BY ALL)
SELECT c AS conversation, 'As said ' || a || ' and ' || b || CASE WHEN b = d THEN '' ELSE ', ' || d END || ' but not [[99]] of ' || c AS answer FROM t"""


def citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    cites = A.table(spark, sf_dir, "events").select((F.col("event_id") % 10).alias("conversation"), F.col("event_id").alias("cite_id"), (F.col("user_id") % 20).alias("meeting_id"), F.floor("value").alias("sec"))
    pool = A.table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 10).alias("conversation"), F.col("vec_id").alias("k"), (F.col("vec_id") % 17).alias("meeting_id"), (F.col("vec_id") % 200).alias("sec"))
    return K.checked(cites, pool)


CHECK = """WITH c AS (SELECT event_id % 10 AS conversation, event_id AS cite_id, user_id % 20 AS meeting_id, CAST(floor(value) AS BIGINT) AS sec FROM events),
p AS (SELECT vec_id % 10 AS conversation, vec_id AS k, vec_id % 17 AS meeting_id, vec_id % 200 AS sec FROM embeddings)
SELECT c.conversation, c.cite_id, c.meeting_id, arg_min(p.sec, row(abs(p.sec - c.sec), k)) AS sec FROM c JOIN p ON p.conversation = c.conversation AND p.meeting_id = c.meeting_id GROUP BY ALL"""


def in_meeting_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes and lines with a word, and passages near it, in order, for each of the words."""
    words = A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lower(F.split_part("text", F.lit(" "), F.lit(2))).alias("q")).where("char_length(q) >= 4")
    lines = A.lines(spark, sf_dir).where("text <> ''").withColumn("pos", F.col("meeting_id") * 1_048_576 + F.col("utt_idx"))
    hits = T.containing(lines.withColumn("t", F.lower("text")), words, "t", "q")
    found = settle(hits.select("query_id", "pos", "utt_idx", F.when(F.col("utt_idx") % 2 == 0, F.col("text")).alias("text")), "found")  # only notes show their text
    notes = found.where("utt_idx % 2 = 0").select("query_id", "pos", (F.col("utt_idx") * 10).alias("t"), "text")
    said = found.where("utt_idx % 2 = 1").select("query_id", F.col("pos").alias("utt_idx"))
    vec = A.table(spark, sf_dir, "embeddings")
    near = vec.select((F.col("vec_id") % 40).alias("query_id"), (F.col("vec_id") % 2 == 0).alias("is_note"), (F.col("vec_id") % 30).alias("t"), F.col("vec_id").alias("a"), (F.col("vec_id") + 900).alias("b"), F.concat(F.lit("vec "), F.col("vec_id").cast("string")).alias("text"))
    return K.in_meeting(notes, said, near).select("query_id", "rank", "kind", "at", "text", "by_meaning")


IN_MEETING = f"""WITH {A.LINES}, w AS (SELECT item_id AS query_id, lower(split_part(text, ' ', 2)) AS q FROM benchmark), l AS (SELECT *, meeting_id * 1048576 + utt_idx AS pos FROM lines WHERE text <> ''),
h AS (SELECT query_id, utt_idx, pos, text FROM l JOIN w ON contains(lower(text), q) WHERE length(q) >= 4),
nt AS (SELECT query_id, pos, utt_idx * 10 AS t, text FROM h WHERE utt_idx % 2 = 0), ln AS (SELECT query_id, pos FROM h WHERE utt_idx % 2 = 1),
v AS (SELECT vec_id % 40 AS query_id, vec_id % 2 = 0 AS is_note, vec_id % 30 AS t, vec_id AS a, vec_id + 900 AS b, 'vec ' || vec_id AS text FROM embeddings),
e AS (SELECT query_id, 0 AS kind, CAST(t AS DOUBLE) AS at_, pos, text, false AS by_meaning FROM nt UNION ALL SELECT query_id, 1, CAST(pos AS DOUBLE), 0, NULL, false FROM ln
  UNION ALL SELECT query_id, 0, CAST(t AS DOUBLE), 1099511627776, text, true FROM v WHERE is_note AND NOT EXISTS (SELECT 1 FROM nt WHERE nt.query_id = v.query_id AND nt.text = v.text)
  UNION ALL SELECT query_id, 1, CAST(a AS DOUBLE), 0, NULL, true FROM v WHERE NOT is_note AND NOT EXISTS (SELECT 1 FROM ln WHERE ln.query_id = v.query_id AND ln.pos BETWEEN v.a AND greatest(v.a, v.b))),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kind, at_, pos, text) AS rank FROM e)
SELECT query_id, rank, kind, at_ AS "at", text, by_meaning FROM r WHERE rank <= 50"""


def speaker_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.notes(spark, sf_dir).withColumn("text", F.concat(F.lit("S1 told S2, not S3 or xS1: "), "text"))
    names = rows.select("meeting_id").distinct().select("meeting_id", F.explode(F.array(F.struct(F.lit(0).alias("s"), F.concat(F.lit("P"), F.col("meeting_id").cast("string")).alias("n")), F.struct(F.lit(1).alias("s"), F.lit("Guest").alias("n")))).alias("x")).select("meeting_id", F.col("x.s").alias("speaker"), F.col("x.n").alias("name"))
    return M.named_texts(rows, names).select("meeting_id", "pos", "text")


REFS = f"""WITH {N.NOTES} SELECT meeting_id, pos, 'P' || meeting_id || ' told Guest, not S3 or xS1: ' || text AS text FROM nt"""


def recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("meeting_id"), F.col("l_linenumber").alias("speaker"), (F.col("l_suppkey") % 7).alias("person_id"))
    people = links.select("person_id").distinct().select("person_id", (F.col("person_id") == 3).alias("me"), F.when(F.col("person_id") != 5, F.array(F.concat(F.lit("p"), F.col("person_id").cast("string"), F.lit("@X.org")))).alias("emails"))
    last = A.table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("meeting_id"), (F.col("o_orderkey") % 7).alias("person_id"), F.lit("p2@x.org").alias("address"))
    found = M.recipients(links, people, last)
    return found.withColumn("speakers", F.array_join(F.col("speakers").cast("array<string>"), ","))


RECIPIENTS = """WITH l AS (SELECT l_orderkey AS m, l_linenumber AS s, l_suppkey % 7 AS p FROM lineitem), g AS (SELECT m, p, min(s) AS f, string_agg(DISTINCT s, ',' ORDER BY s) AS speakers FROM l GROUP BY ALL)
SELECT m AS meeting_id, row_number() OVER (PARTITION BY m ORDER BY f, p) AS ord, p AS person_id, speakers, CASE WHEN p <> 5 THEN 'p' || p || '@X.org' END AS address,
p <> 5 AND CASE WHEN m % 2 = 0 AND EXISTS (SELECT 1 FROM orders WHERE o_orderkey = m) THEN p = m % 7 OR p = 2 ELSE p <> 3 END AS checked FROM g"""


def scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as shares with the suppliers of their items; some suppliers are deleted by id, one by address."""
    items = A.table(spark, sf_dir, "lineitem")
    rows = items.groupBy(F.col("l_orderkey").alias("share_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: F.struct((x["l_suppkey"]).alias("person"), F.concat(F.lit("s"), x["l_suppkey"].cast("string"), F.lit("@x.org")).alias("address"))).alias("recipients"))
    gone = spark.createDataFrame([(1, None), (4, None), (None, "s2@X.org")], "person long, address string")
    return M.scrubbed(rows, gone).select("share_id", F.array_join(F.transform("recipients", lambda r: r["person"].cast("string")), ",").alias("left"))


SCRUB = """WITH i AS (SELECT DISTINCT l_orderkey FROM lineitem) SELECT i.l_orderkey AS share_id, coalesce(string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_linenumber, l_suppkey), '') AS "left"
FROM i LEFT JOIN lineitem l ON l.l_orderkey = i.l_orderkey AND l_suppkey NOT IN (1, 2, 4) GROUP BY ALL"""


def last_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("meeting_id"), F.col("event_id").alias("pos"), F.when(F.col("event_type").isin("view", "click"), "mail").otherwise("chat").alias("channel"), F.col("value").alias("at"), F.col("event_type").alias("status"))
    return M.last_shares(rows)


LAST_SHARE = """SELECT user_id % 50 AS meeting_id, arg_max(value, event_id) AS "at", arg_max(event_type, event_id) AS status FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL"""


def meeting_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' notes as mails that fit 1,500 characters where they can."""
    docs = A.table(spark, sf_dir, "documents").where("text <> ''")
    meetings = docs.select(F.col("doc_id").alias("meeting_id"), F.concat(F.lit("Minutes "), F.col("doc_id").cast("string")).alias("title"), F.concat(F.lit("Language: "), "lang").alias("facts"), F.col("text").alias("summary"))
    return M.mails(meetings, N.notes(spark, sf_dir), spark.createDataFrame(N.SECTIONS, "ord int, heading string, tag string"), 1500)


def manifest_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as interchange documents and read again: their lines."""
    lines = A.utterances(spark, sf_dir)
    meetings = lines.select("meeting_id").distinct().withColumn("title", F.lit("T")).withColumn("summary", F.lit(None).cast("string"))
    links = lines.select("meeting_id", "speaker").distinct().withColumn("name", F.lit("n")).withColumn("person_id", F.lit(None).cast("string"))
    return M.from_manifest(M.manifest(meetings, lines.withColumn("utt_idx", F.col("utt_idx").cast("int")), links))[1]


ROUND_TRIP = f"WITH {A.UTT} SELECT meeting_id, CAST(utt_idx AS INT) AS utt_idx, speaker, start_s, end_s, text FROM utt"


def sparse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of conversations, every fourth stretched, that belong to nobody for their few words."""
    lines = A.utterances(spark, sf_dir).withColumn("end_s", F.when(F.col("utt_idx") % 4 == 3, F.round(F.col("start_s") + 5 * (F.col("end_s") - F.col("start_s")), 3)).otherwise(F.col("end_s")))
    return V.voice_lines(lines).select("meeting_id", "utt_idx", "speaker")


SPARSE = rf"""WITH {A.UTT}, l AS (SELECT meeting_id, utt_idx, speaker, start_s, CASE WHEN utt_idx % 4 = 3 THEN round(start_s + 5 * (end_s - start_s), 3) ELSE end_s END AS e, length(regexp_replace(text, '[\s\x0B]', '', 'g')) AS n FROM utt),
r AS (SELECT *, n / greatest(0.5, e - start_s) AS rate FROM l), k AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY rate, utt_idx) - 1 AS i, count(*) OVER (PARTITION BY meeting_id) AS c FROM r WHERE e > start_s),
u AS (SELECT meeting_id, rate AS u FROM k WHERE i = c // 2)
SELECT r.meeting_id, utt_idx, CASE WHEN rate < 0.4 * u THEN -9 ELSE speaker END AS speaker FROM r LEFT JOIN u ON u.meeting_id = r.meeting_id"""


def learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.exemplars(spark, sf_dir).withColumn("confirmed", F.col("vec_id") % 9 != 0)


def voice_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.known(learned(spark, sf_dir))


KNOWN = f"WITH {A.VECTORS} SELECT person, count(DISTINCT meeting_id) AS meetings, sum(1.0::DOUBLE + vec_id % 50) AS seconds, count(*) FILTER (WHERE vec_id % 9 = 0) AS pending FROM vecs GROUP BY ALL"


def voice_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    meetings = learned(spark, sf_dir).select(F.col("meeting_id").alias("for_meeting")).distinct()
    return V.without_meeting(learned(spark, sf_dir), meetings, A.DIMS).withColumn("x", F.round("x", 6))


LEAVE = f"""WITH {A.VECTORS}, e AS (SELECT person, meeting_id, 1.0::DOUBLE + vec_id % 50 AS s, vector, sqrt(list_dot_product(vector, vector)) AS l FROM vecs WHERE vec_id % 9 <> 0),
d AS (SELECT person, meeting_id, s, l, unnest(vector) AS v, unnest(range(64)) AS dim FROM e), f AS (SELECT DISTINCT meeting_id AS m, person FROM e),
x AS (SELECT f.m, f.person, dim, sum(s * v / l) AS x FROM f JOIN d ON d.person = f.person AND d.meeting_id <> f.m GROUP BY ALL)
SELECT m AS for_meeting, person, CAST(dim AS INT) AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY m, person)), 6) AS x FROM x"""


def first_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each speaker of a meeting."""
    lines = A.utterances(spark, sf_dir)
    return lines.groupBy("meeting_id", "speaker").agg(F.min_by(F.struct("utt_idx", "text"), F.struct("start_s", "utt_idx")).alias("l")).select("meeting_id", "speaker", "l.utt_idx", "l.text")


FIRST_LINE = f"WITH {A.UTT} SELECT meeting_id, speaker, arg_min(utt_idx, row(start_s, utt_idx)) AS utt_idx, arg_min(text, row(start_s, utt_idx)) AS text FROM utt GROUP BY ALL"


def picker_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People to pick for a meeting: in it, the five used last, the others by meetings and name. Customers of one nation are in the meeting."""
    used = O.usage(spark, sf_dir).select("person_id", "meetings", "newest")
    rows = O.directory(spark, sf_dir).select("person_id", "name").join(used, "person_id", "left").join(A.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("person_id"), "c_nationkey"), "person_id")
    rows = rows.withColumn("within", F.col("c_nationkey") == 1).withColumn("meetings", F.coalesce("meetings", F.lit(0)))
    recent = rows.where("not within and newest is not null").orderBy(F.desc("newest"), "person_id").limit(5).select("person_id", F.lit(True).alias("recent"))
    section = F.when(F.col("within"), 0).when(F.col("recent"), 1).otherwise(2)
    listed = rows.join(recent, "person_id", "left").select("person_id", "name", "meetings", section.alias("section"), X.name_key(F.col("name")).alias("key"))
    placed = ordered(listed, [F.asc("section"), F.desc("meetings"), F.asc("key"), F.asc("person_id")], "place")  # nearly all people are in one section
    starts = placed.groupBy("section").agg(F.min("place").alias("start"))
    return placed.join(starts, "section").select("person_id", "name", "meetings", "section", (F.col("place") - F.col("start") + 1).alias("ord"))


PICKER = f"""WITH {O.LINKS}, {O.PEOPLE}, u AS (SELECT person_id, count(*) AS meetings, max(date) AS newest FROM lk WHERE person_id IS NOT NULL GROUP BY ALL),
r AS (SELECT pp.person_id, pp.name, coalesce(u.meetings, 0) AS meetings, u.newest, c.c_nationkey = 1 AS w FROM pp LEFT JOIN u ON u.person_id = pp.person_id JOIN customer c ON c.c_custkey = pp.c_custkey),
n AS (SELECT person_id FROM r WHERE NOT w AND newest IS NOT NULL ORDER BY newest DESC, person_id LIMIT 5),
s AS (SELECT person_id, name, meetings, CASE WHEN w THEN 0 WHEN person_id IN (SELECT person_id FROM n) THEN 1 ELSE 2 END AS section FROM r)
SELECT *, row_number() OVER (PARTITION BY section ORDER BY meetings DESC, {O.KEY}, person_id) AS ord FROM s"""


def same_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People who share an address-book entry with others, and with how many: customers of one nation, segment and rounded balance."""
    w = Window.partitionBy("c_nationkey", "c_mktsegment")
    return A.table(spark, sf_dir, "customer").withColumn("others", F.count("*").over(w) - 1).where("others > 0").select("c_custkey", "others")


SAME = "WITH c AS (SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) - 1 AS others FROM customer) SELECT * FROM c WHERE others > 0"


def stale_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("meeting_id"), F.col("o_orderpriority").alias("reader"), F.when(F.col("o_orderkey") % 4 != 0, "s").alias("summary"), F.when(F.col("o_orderkey") % 5 != 0, "a").alias("audio"))
    return L.stale_summaries(rows, "1-URGENT").select("meeting_id")


STALE_SUMMARIES = "SELECT o_orderkey AS meeting_id FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0"


def unprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as recordings that no line item belongs to with a quantity over 45."""
    jobs = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("meeting_id"))
    return L.unprocessed(jobs, A.table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("meeting_id")))


UNPROCESSED = "SELECT o_orderkey AS meeting_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)"


def md_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.transcript(Q.named(spark, sf_dir), markdown=True)


MD = Q.TXT.replace("'[' ||", "'- `' ||").replace("'] '", "'` **'").replace("': '", "'** '")

def full_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as the meetings of the documents with their ids: a document's source is the title, its first line the summary, its lines are the notes."""
    lines, rows = Q.named(spark, sf_dir), N.notes(spark, sf_dir)
    numbered = rows.withColumn("note_id", F.row_number().over(Window.partitionBy("meeting_id").orderBy("pos")))
    notes = D.rendered_notes(numbered.withColumn("tag", F.when(F.col("tag") != "OTHER", F.col("tag"))))
    summary = rows.groupBy("meeting_id").agg(F.min_by("text", "pos").alias("summary"))
    titles = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("meeting_id"), F.when(F.col("doc_id") % 5 > 0, F.col("source")).alias("title"))
    heads = titles.join(summary, "meeting_id", "left").join(N.actions(spark, sf_dir), "meeting_id", "left").join(notes, "meeting_id", "left")
    heads = heads.join(lines.select("meeting_id").distinct(), "meeting_id", "left_semi")
    plain = D.exported(lines, heads).withColumnRenamed("export", "txt")
    return plain.join(D.exported(lines, heads, markdown=True).withColumnRenamed("export", "md"), "meeting_id").join(D.lyrics(lines, titles), "meeting_id", "left")


_ACTS = N.ACTIONS[N.ACTIONS.index("d AS (SELECT meeting_id, string_agg") : N.ACTIONS.rindex("SELECT meeting_id, actions")].rstrip()
FULL = f"""WITH {N.NOTES}, {_ACTS}, ac AS (SELECT * FROM b WHERE actions IS NOT NULL), tx AS ({Q.TXT}), mx AS ({MD}), lx AS ({Q.LRC}),
nn AS (SELECT meeting_id, '#' || row_number() OVER (PARTITION BY meeting_id ORDER BY pos) || ' [' || ts || '] ' || CASE WHEN tag <> 'OTHER' THEN '(' || tag || ') ' ELSE '' END || text AS line, pos, text FROM nt),
nj AS (SELECT meeting_id, string_agg(line, chr(10) ORDER BY pos) AS plain, string_agg('- ' || line, chr(10) ORDER BY pos) AS listed, arg_min(text, pos) AS summary FROM nn GROUP BY ALL),
ti AS (SELECT doc_id AS meeting_id, CASE WHEN doc_id % 5 > 0 THEN source ELSE '' END AS title FROM documents),
ms AS (SELECT DISTINCT conv_id AS meeting_id FROM conversations)
SELECT m.meeting_id, coalesce(title, '') || chr(10) || chr(10) || coalesce(summary || chr(10) || chr(10), '') || coalesce('Action items' || chr(10) || actions || chr(10) || chr(10), '') || coalesce(plain || chr(10) || chr(10), '') || coalesce(tx.transcript, '') AS txt,
  '# ' || coalesce(nullif(title, ''), 'Transcript') || chr(10) || chr(10) || coalesce('## Summary' || chr(10) || chr(10) || summary || chr(10) || chr(10), '') || coalesce('## Action items' || chr(10) || chr(10) || actions || chr(10) || chr(10), '')
  || coalesce('## Agent' || chr(10) || chr(10) || listed || chr(10) || chr(10), '') || '## Transcript' || chr(10) || chr(10) || coalesce(mx.transcript, '') || chr(10) AS md,
  coalesce('[ti:' || nullif(title, '') || ']' || chr(10), '') || lyrics AS lyrics
FROM ms m LEFT JOIN ti ON ti.meeting_id = m.meeting_id LEFT JOIN nj ON nj.meeting_id = m.meeting_id LEFT JOIN ac ON ac.meeting_id = m.meeting_id
LEFT JOIN tx ON tx.meeting_id = m.meeting_id LEFT JOIN mx ON mx.meeting_id = m.meeting_id LEFT JOIN lx ON lx.meeting_id = m.meeting_id"""


def script_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with German and French letters by a dictionary."""
    words = spark.createDataFrame(list(zip("äöüéèêç", "aoueeec", strict=True)), "key string, to string")
    found = converted(A.table(spark, sf_dir, "documents").select("doc_id", "text"), words, "doc_id")
    return found.select("doc_id", F.sha2("text", 256).alias("text_sha256"))


SCRIPT = "SELECT doc_id, sha256(translate(text, 'äöüéèêç', 'aoueeec')) AS text_sha256 FROM documents"


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' first lines as titles."""
    return A.table(spark, sf_dir, "documents").select("doc_id", X.title_cut(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"))


TITLES = r"""WITH t AS (SELECT doc_id, split_part(text, chr(10), 1) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 40 THEN t WHEN NOT contains(t, ' ') THEN substring(t, 1, 40) WHEN length(t) <= 60 THEN t
ELSE regexp_replace(regexp_extract(substring(t, 1, 61), '(?s)^(.*) ', 1), '[,;:\- ]+$', '') END AS title FROM t"""


def speaker_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of the conversations, labels late by three characters, moved to the turns' starts: how many have which label."""
    lines = A.utterances(spark, sf_dir).withColumn("label", F.col("speaker").cast("string"))
    whole = lines.withColumn("_n", F.char_length("text")).where("_n > 0")
    order = Window.partitionBy("meeting_id").orderBy("utt_idx")
    # A line's first three characters have the labels of the three before it, which the three lines before it hold; a meeting's first three keep their own.
    near = F.collect_list(F.struct("label", F.least(F.lit(3), F.col("_n")).alias("n"))).over(order.rowsBetween(-3, -1))
    before = F.flatten(F.transform("_near", lambda x: F.array_repeat(x["label"], x["n"])))
    late = F.slice("_before", F.greatest(F.lit(1), F.size("_before") - 2), F.lit(3))
    whole = whole.withColumn("_near", near).withColumn("_pos", F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_before", before)
    heads = F.slice(F.concat(F.array_repeat("label", F.lit(3) - F.least(F.lit(3), F.size("_before"))), late), F.lit(1), F.least(F.lit(3), F.col("_n")))
    cuts = F.concat(F.transform(heads, lambda x, i: F.struct(i.alias("first"), F.lit(1).alias("n"), x.alias("label"))), F.when(F.col("_n") > 3, F.array(F.struct(F.lit(3).alias("first"), (F.col("_n") - 3).alias("n"), "label"))).otherwise(F.array()))
    step = (F.col("end_s") - F.col("start_s")) / F.col("_n")
    pieces = whole.select("meeting_id", "_pos", "text", "start_s", step.alias("step_s"), F.inline(cuts))
    pieces = pieces.select("meeting_id", (F.col("_pos") + F.col("first")).alias("pos"), F.substring("text", F.col("first") + 1, F.col("n")).alias("text"), "label", "start_s", "step_s", "first")
    turns = lines.select("meeting_id", "label", F.greatest(F.lit(0.0), F.col("start_s") - 0.3).alias("start_s"), "end_s")
    chars = snapped_pieces(pieces, turns).select("meeting_id", "label", F.explode(F.split("text", "")).alias("ch")).where("ch <> ''")
    return chars.groupBy("meeting_id", "label").agg(F.count("*").alias("characters"), F.sum(F.crc32("ch")).alias("digest"))


QUERIES = {
    "script_convert": (script_convert, SCRIPT),
    "titles": (titles, TITLES),
    "speaker_snap": (speaker_snap, None),
    "relabel": (relabel, RELABEL),
    "other_speakers": (other_speakers, OTHERS),
    "token_starts": (token_starts, TOKEN_STARTS),
    "boundary_moves": (boundary_moves, None),
    "line_splits": (line_splits, None),
    "edit_log": (edit_log, None),
    "long_line_split": (long_line_split, None),
    "sentence_snap": (sentence_snap, SNAPPED),
    "enrolment_clips": (enrolment_clips, ENROLMENT_CLIPS),
    "enrolment_map": (enrolment_map, ENROLMENT_MAP),
    "enrolment_lines": (enrolment_lines, ENROLMENT_LINES),
    "unindexed_chunks": (unindexed_chunks, UNINDEXED),
    "ask_fusion_routed": (ask_fusion_routed, ASK),
    "excerpt_selection": (excerpt_selection, None),
    "pool_numbers": (pool_numbers, POOL),
    "citations": (citations, CITATIONS),
    "citation_check": (citation_check, CHECK),
    "in_meeting_results": (in_meeting_results, IN_MEETING),
    "speaker_refs": (speaker_refs, REFS),
    "recipients": (recipients, RECIPIENTS),
    "scrub": (scrub, SCRUB),
    "last_share": (last_share, LAST_SHARE),
    "meeting_mail": (meeting_mail, None),
    "manifest_round_trip": (manifest_round_trip, ROUND_TRIP),
    "sparse_lines": (sparse_lines, SPARSE),
    "voice_known": (voice_known, KNOWN),
    "voice_leave_one_out": (voice_leave_one_out, LEAVE),
    "first_line": (first_line, FIRST_LINE),
    "picker_sections": (picker_sections, PICKER),
    "same_contact": (same_contact, SAME),
    "stale_summaries": (stale_summaries, STALE_SUMMARIES),
    "unprocessed": (unprocessed, UNPROCESSED),
    "md_export": (md_export, MD),
    "full_exports": (full_exports, FULL),
}
