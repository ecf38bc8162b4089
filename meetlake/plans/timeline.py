"""Registered queries on meeting time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meetlake.operators import segments as S
from meetlake.operators import timeline as T
from meetlake.plans import adapters as A


def talk_time_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.talk_time(A.utterances(spark, sf_dir)).select("meeting_id", "speaker", "lines", F.round("seconds", 3).alias("seconds"), F.round("percent", 4).alias("percent"))


TALK = f"""WITH {A.UTT}, s AS (SELECT meeting_id, greatest(0, speaker) AS speaker, count(*) AS lines, sum(greatest(0.0, end_s - start_s)) AS seconds FROM utt GROUP BY ALL)
SELECT meeting_id, speaker, lines, round(seconds, 3) AS seconds, round(100 * seconds / sum(seconds) OVER (PARTITION BY meeting_id), 4) AS percent FROM s"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as times asked of the conversations."""
    n = F.col("event_id") % 97
    return A.table(spark, sf_dir, "events").select(n.alias("meeting_id"), F.col("event_id").alias("q_id"), F.floor(F.col("value") * 3).cast("double").alias("t"))


def asof_note_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = A.utterances(spark, sf_dir).select("meeting_id", "utt_idx", "start_s")
    return T.line_at(questions(spark, sf_dir), lines).select("meeting_id", "q_id", "t", "utt_idx")


ASOF = f"""WITH {A.UTT}, q AS (SELECT event_id % 97 AS meeting_id, event_id AS q_id, floor(value * 3) AS t FROM events),
f AS (SELECT meeting_id, min(utt_idx) AS f FROM utt GROUP BY ALL),
b AS (SELECT q.q_id, max(utt_idx) AS u FROM q JOIN utt ON utt.meeting_id = q.meeting_id AND utt.start_s <= q.t + 0.999 GROUP BY ALL)
SELECT q.meeting_id, q.q_id, q.t, coalesce(b.u, f.f, -1) AS utt_idx FROM q LEFT JOIN b ON b.q_id = q.q_id LEFT JOIN f ON f.meeting_id = q.meeting_id"""


def pieces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns of even numbers as they are, and those of odd ones as spans of a few seconds."""
    turns = A.turns(spark, sf_dir)
    spans = turns.where("turn_id % 2 = 1").select("meeting_id", F.col("turn_id").alias("span_id"), "start_s", F.round(F.col("start_s") + 2 + F.col("turn_id") % 5, 3).alias("end_s"))
    return spans, turns.where("turn_id % 2 = 0").select("meeting_id", "turn_id", "speaker", F.col("start_s").alias("t_start"), F.col("end_s").alias("t_end"))


def turn_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, turns = pieces(spark, sf_dir)
    return T.attribute(spans, turns).select("meeting_id", "span_id", "speaker", "snapped")


ATTRIBUTION = f"""WITH {A.TURNS}, s AS (SELECT meeting_id, turn_id AS span_id, start_s, round(start_s + 2 + turn_id % 5, 3) AS end_s FROM turns WHERE turn_id % 2 = 1),
t AS (SELECT meeting_id, turn_id, speaker, start_s AS a, end_s AS b FROM turns WHERE turn_id % 2 = 0),
p AS (SELECT s.meeting_id, s.span_id, t.turn_id, t.speaker, t.a, t.b, least(s.end_s, t.b) - greatest(s.start_s, t.a) AS ov, s.start_s, s.end_s FROM s JOIN t ON t.meeting_id = s.meeting_id),
o AS (SELECT meeting_id, span_id, arg_min(speaker, row(-ov, a, turn_id)) AS speaker FROM p WHERE ov > 0 GROUP BY ALL),
e AS (SELECT meeting_id, span_id, arg_max(row(speaker, b), row(b, b, turn_id, speaker)) FILTER (WHERE b <= start_s) AS l, arg_max(row(speaker, a), row(-a, -a, turn_id, speaker)) FILTER (WHERE a >= end_s) AS r,
  any_value(start_s) AS start_s, any_value(end_s) AS end_s FROM p ANTI JOIN o USING (meeting_id, span_id) GROUP BY ALL)
SELECT meeting_id, span_id, speaker, false AS snapped FROM o
UNION ALL SELECT meeting_id, span_id, CASE WHEN r IS NULL OR (l IS NOT NULL AND start_s - l[2] <= r[2] - end_s) THEN l[1] ELSE r[1] END, true FROM e WHERE l IS NOT NULL OR r IS NOT NULL"""


def turn_attribution_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, where whoever spoke last goes on in what no turn covers."""
    spans, turns = pieces(spark, sf_dir)
    return T.attribute(spans, turns, previous=True).select("meeting_id", "span_id", "speaker", "snapped")


PREVIOUS = f"""{ATTRIBUTION[:ATTRIBUTION.index("e AS (")]}
e AS (SELECT meeting_id, span_id, arg_min(speaker, row(-b, a, turn_id)) FILTER (WHERE b <= end_s) AS l, arg_min(speaker, row(a, turn_id)) AS f FROM p ANTI JOIN o USING (meeting_id, span_id) GROUP BY ALL)
SELECT meeting_id, span_id, speaker, false AS snapped FROM o UNION ALL SELECT meeting_id, span_id, coalesce(l, f), true FROM e"""


def renumbered(turns: DataFrame) -> DataFrame:
    return turns.withColumn("speaker", (F.col("speaker") * 3 + 1) % 8).withColumn("start_s", F.round(F.col("start_s") + 1, 3))


def speaker_carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = A.turns(spark, sf_dir).select("meeting_id", "speaker", "start_s", "end_s")
    return T.carry_over(turns, renumbered(turns).where("end_s > start_s")).select("meeting_id", "old_speaker", "new_speaker", F.round("seconds", 3).alias("seconds"))


CARRY = f"""WITH RECURSIVE {A.TURNS}, o AS (SELECT meeting_id, speaker, start_s, end_s FROM turns),
n AS (SELECT meeting_id, (speaker * 3 + 1) % 8 AS speaker, round(start_s + 1, 3) AS start_s, end_s FROM o WHERE end_s > round(start_s + 1, 3)),
ot AS (SELECT meeting_id, speaker, sum(end_s - start_s) AS t FROM o GROUP BY ALL), nt AS (SELECT meeting_id, speaker, sum(end_s - start_s) AS t FROM n GROUP BY ALL),
m AS (SELECT o.meeting_id, o.speaker AS os, n.speaker AS ns, sum(least(o.end_s, n.end_s) - greatest(o.start_s, n.start_s)) AS sec FROM o JOIN n ON n.meeting_id = o.meeting_id AND o.start_s < n.end_s AND n.start_s < o.end_s GROUP BY ALL),
k AS (SELECT m.*, row_number() OVER (PARTITION BY m.meeting_id ORDER BY sec DESC, os, ns) AS rk FROM m JOIN ot ON ot.meeting_id = m.meeting_id AND ot.speaker = os JOIN nt ON nt.meeting_id = m.meeting_id AND nt.speaker = ns
  WHERE sec >= 0.6 * nt.t AND sec >= 0.5 * ot.t),
g AS (SELECT meeting_id, 0::BIGINT AS rk, []::INT[] AS os, []::INT[] AS ns, NULL::INT AS a, NULL::INT AS b, NULL::DOUBLE AS sec FROM (SELECT DISTINCT meeting_id FROM k)
  UNION ALL SELECT g.meeting_id, k.rk, CASE WHEN list_contains(g.os, k.os) OR list_contains(g.ns, k.ns) THEN g.os ELSE list_append(g.os, k.os) END,
    CASE WHEN list_contains(g.os, k.os) OR list_contains(g.ns, k.ns) THEN g.ns ELSE list_append(g.ns, k.ns) END,
    CASE WHEN list_contains(g.os, k.os) OR list_contains(g.ns, k.ns) THEN NULL ELSE k.os END, k.ns, k.sec
  FROM g JOIN k ON k.meeting_id = g.meeting_id AND k.rk = g.rk + 1)
SELECT meeting_id, a AS old_speaker, b AS new_speaker, round(sec, 3) AS seconds FROM g WHERE a IS NOT NULL"""


def clean_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = A.turns(spark, sf_dir).withColumnRenamed("turn_id", "utt_idx")
    spans = T.sampled_speech(T.clean_speech(turns), least=5.0)
    return spans.select("meeting_id", "speaker", "utt_idx", "turn", "third", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"))


CLEAN = f"""WITH {A.TURNS}, c AS (SELECT meeting_id, turn_id AS utt_idx, speaker, start_s + 0.1 AS a, end_s - 0.1 AS b FROM turns t
  WHERE NOT EXISTS (SELECT 1 FROM turns o WHERE o.meeting_id = t.meeting_id AND o.speaker <> t.speaker AND o.start_s < t.end_s AND t.start_s < o.end_s) AND (end_s - 0.1) - (start_s + 0.1) >= 1.5),
e AS (SELECT c.*, b - a AS len, CAST(greatest(0, least(2, floor(3 * a / max(b) OVER (PARTITION BY meeting_id)))) AS INT) AS third FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, speaker, third ORDER BY len DESC, utt_idx) AS turn FROM e),
s AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY meeting_id, speaker ORDER BY turn, third ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef, sum(len) OVER (PARTITION BY meeting_id, speaker) AS al FROM r)
SELECT meeting_id, speaker, utt_idx, turn, third, round(a, 3) AS start_s, round(a + least(len, 60 - bef), 3) AS end_s FROM s WHERE bef < 60 AND al >= 5"""


def stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = A.turns(spark, sf_dir).select("meeting_id", F.col("turn_id").alias("utt_idx"), "speaker", "start_s", "end_s")
    seam = turns.groupBy("meeting_id").agg(F.lit(43_200.0).alias("seam_s"))
    prior = turns.where("end_s <= 43200 and speaker < 6")
    found = T.stitch(prior, renumbered(turns).where("end_s > start_s and start_s >= 36000"), seam)
    return found.groupBy("meeting_id", "speaker", "resumed").agg(F.count("*").alias("lines"), F.round(F.sum("end_s"), 2).alias("ends"))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes with events as chunks of sound of a minute."""
    return A.frames(spark, sf_dir).select("meeting_id", F.col("frame").alias("idx"), (F.col("frame") * 60.0).alias("start_s"), F.lit(60.0).alias("seconds"), F.when(F.col("n") > 1, 1.0).otherwise(F.col("peak")).alias("peak"))


def silence_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.silence_cuts(levels(spark, sf_dir), 0.05, 60.0).select("meeting_id", "idx", "at", "cut", "total")


CUTS = f"""{A.FRAMES}, l AS (SELECT meeting_id, frame AS idx, frame * 60.0::DOUBLE AS start_s, CASE WHEN n > 1 THEN 1.0 ELSE peak END AS peak FROM frames),
p AS (SELECT *, sum(CASE WHEN peak >= 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY idx) AS pause FROM l),
r AS (SELECT *, 60.0::DOUBLE * (row_number() OVER (PARTITION BY meeting_id, pause ORDER BY idx) - 1) AS run FROM p WHERE peak < 0.05),
c AS (SELECT meeting_id, min(idx) AS idx, min(start_s) AS at, 60.0::DOUBLE * count(*) AS cut FROM r WHERE run >= 60 GROUP BY meeting_id, pause),
cuts AS (SELECT *, sum(cut) OVER (PARTITION BY meeting_id ORDER BY idx) AS total FROM c)"""


def time_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = T.silence_cuts(levels(spark, sf_dir), 0.05, 60.0)
    turns = A.turns(spark, sf_dir).select("meeting_id", F.col("turn_id").alias("q_id"), F.col("start_s").alias("t"))
    return T.restore_times(turns, cuts).select("meeting_id", "q_id", F.round("t", 3).alias("t"), F.round("original", 3).alias("original"))


RESTORE = f"""WITH {CUTS}, {A.TURNS}, k AS (SELECT t.turn_id, max(total) AS total FROM turns t JOIN cuts c ON c.meeting_id = t.meeting_id AND c.at - (c.total - c.cut) <= t.start_s GROUP BY ALL)
SELECT t.meeting_id, t.turn_id AS q_id, round(t.start_s, 3) AS t, round(t.start_s + coalesce(k.total, 0), 3) AS original FROM turns t LEFT JOIN k ON k.turn_id = t.turn_id"""


def turn_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.turn_islands(A.probabilities(spark, sf_dir), 0.9)
    return found.select("meeting_id", "speaker", "start_frame", "end_frame", F.round("confidence", 8).alias("confidence"))


ISLANDS = f"""WITH {A.PROBS}, m AS (SELECT meeting_id, max(frame) AS last FROM probs GROUP BY ALL),
r AS (SELECT *, frame - row_number() OVER (PARTITION BY meeting_id, speaker ORDER BY frame) AS run FROM probs WHERE prob >= 0.9),
t AS (SELECT meeting_id, speaker, min(frame) AS a, max(frame) + 1 AS b, avg(prob) AS c FROM r GROUP BY meeting_id, speaker, run)
SELECT t.meeting_id, speaker, greatest(0, a - 20) AS start_frame, least(last + 1, b + 20) AS end_frame, round(c, 8) AS confidence FROM t JOIN m ON m.meeting_id = t.meeting_id"""


def decibels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.frames(spark, sf_dir).select("meeting_id", "frame", F.round(10 * F.log10(F.col("rms") * F.col("rms") + 1e-10), 6).alias("db"))


def voiced_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.voiced_runs(decibels(spark, sf_dir), 10, 15)


VOICED = f"""WITH {A.FRAMES}, d AS (SELECT meeting_id, frame, round(10 * log10(rms * rms + 1e-10), 6) AS db FROM frames),
k AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY db, frame) - 1 AS i, count(*) OVER (PARTITION BY meeting_id) AS n FROM d),
p AS (SELECT meeting_id, max(CASE WHEN i = floor(0.95 * (n - 1)) THEN db END) AS p95, max(CASE WHEN i = floor(0.1 * (n - 1)) THEN db END) AS p10 FROM k GROUP BY ALL),
l AS (SELECT d.* FROM d JOIN p ON p.meeting_id = d.meeting_id WHERE db > greatest(p95 - 30, -55.0, p10 + 6)),
g AS (SELECT *, coalesce(frame - lag(frame) OVER (PARTITION BY meeting_id ORDER BY frame) - 1 >= 10, true) AS new FROM l),
r AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY frame) AS run FROM g)
SELECT meeting_id, min(frame) AS start_frame, max(frame) + 1 AS end_frame FROM r GROUP BY meeting_id, run HAVING max(frame) + 1 - min(frame) >= 15"""


def speaker_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of three speakers in order; every seventh isn't tagged."""
    pieces = A.turns(spark, sf_dir).select("meeting_id", F.col("turn_id").alias("pos"), F.when(F.col("turn_id") % 7 != 0, F.col("speaker") % 3).alias("speaker"), "start_s", "end_s", F.concat(F.col("speaker").cast("string"), F.lit(" ")).alias("text"))
    return S.speaker_segments(pieces).select("meeting_id", "segment", "speaker", "first_pos", "pieces", "untagged", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"), "text")


SEGMENTS = f"""WITH {A.TURNS}, p AS (SELECT meeting_id, turn_id AS pos, CASE WHEN turn_id % 7 <> 0 THEN speaker % 3 END AS speaker, start_s, end_s, speaker || ' ' AS text FROM turns),
t AS (SELECT *, coalesce(speaker, last_value(speaker IGNORE NULLS) OVER (PARTITION BY meeting_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS s FROM p),
o AS (SELECT *, CASE WHEN coalesce(s <> lag(s) OVER (PARTITION BY meeting_id ORDER BY pos), s IS NOT NULL OR lag(pos) OVER (PARTITION BY meeting_id ORDER BY pos) IS NULL) THEN 1 ELSE 0 END AS opens FROM t),
r AS (SELECT *, sum(opens) OVER (PARTITION BY meeting_id ORDER BY pos) AS segment FROM o),
g AS (SELECT meeting_id, segment, max(s) AS label, min(pos) AS first_pos, count(*) AS pieces, count(*) FILTER (WHERE speaker IS NULL) AS untagged, min(start_s) AS a, max(end_s) AS b, string_agg(text, '' ORDER BY pos) AS text FROM r GROUP BY ALL),
f AS (SELECT *, min(first_pos) OVER (PARTITION BY meeting_id, label) AS f FROM g)
SELECT meeting_id, segment, dense_rank() OVER (PARTITION BY meeting_id ORDER BY f) - 1 AS speaker, first_pos, pieces, untagged, round(a, 3) AS start_s, round(b, 3) AS end_s, text FROM f"""


def speaker_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.speaker_changes(A.utterances(spark, sf_dir))


CHANGES = f"""WITH {A.UTT}, l AS (SELECT *, lag(speaker) OVER (PARTITION BY meeting_id ORDER BY utt_idx) AS before FROM utt)
SELECT meeting_id, utt_idx, before, speaker, start_s AS at FROM l WHERE before <> speaker"""


def gain_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.gain(A.frames(spark, sf_dir).select("meeting_id", "frame", (F.col("rms") * 5).alias("rms"), "peak"))
    return found.select("meeting_id", F.round("level", 6).alias("level"), F.round("cap", 6).alias("cap"), F.round("gain", 5).alias("gain"))


GAIN = f"""WITH {A.FRAMES}, a AS (SELECT meeting_id, frame, rms * 5 AS rms, peak, row_number() OVER (PARTITION BY meeting_id ORDER BY frame) AS i FROM frames WHERE rms * 5 > 0.003),
b AS (SELECT * FROM a WHERE i <= 100),
k AS (SELECT meeting_id, rms, peak, row_number() OVER (PARTITION BY meeting_id ORDER BY rms, frame) - 1 AS ri, row_number() OVER (PARTITION BY meeting_id ORDER BY peak, frame) - 1 AS pi, count(*) OVER (PARTITION BY meeting_id) AS n FROM b),
v AS (SELECT meeting_id, max(CASE WHEN ri = floor(0.95 * (n - 1)) THEN rms END) AS level, max(CASE WHEN pi = floor(0.999 * (n - 1)) THEN peak END) AS cap FROM k GROUP BY ALL)
SELECT meeting_id, round(level, 6) AS level, round(cap, 6) AS cap, round(CASE WHEN level < 0.045 THEN greatest(1.0, least(8.0, 0.045 / level, 0.98 / greatest(cap, 1e-6))) ELSE 1.0 END, 5) AS gain FROM v"""


def delta_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = A.turns(spark, sf_dir).select("meeting_id", F.col("turn_id").alias("seq"), F.col("end_s").alias("horizon_s"))
    return S.delta_spans(deltas).select("meeting_id", "seq", F.round("from_s", 3).alias("from_s"), F.round("to_s", 3).alias("to_s"))


DELTAS = f"""WITH {A.TURNS}, c AS (SELECT meeting_id, turn_id AS seq, end_s, coalesce(max(end_s) OVER (PARTITION BY meeting_id ORDER BY turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM turns)
SELECT meeting_id, seq, round(f, 3) AS from_s, round(greatest(end_s, f), 3) AS to_s FROM c"""


def char_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = A.turns(spark, sf_dir).select("meeting_id", F.col("turn_id").alias("delta"), "start_s", "end_s", F.repeat(F.col("turn_id").cast("string"), F.lit(3)).alias("text"))
    return S.place_characters(deltas).select("meeting_id", "delta", "i", "ch", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"))


PLACED = f"""WITH {A.TURNS}, d AS (SELECT meeting_id, turn_id AS delta, start_s, end_s, repeat(CAST(turn_id AS VARCHAR), 3) AS text FROM turns),
s AS (SELECT *, length(text) AS n, least(0.09, (end_s - start_s) / greatest(1, length(text))) AS step FROM d),
e AS (SELECT *, unnest(range(n)) AS i FROM s)
SELECT meeting_id, delta, CAST(i AS INT) AS i, text[i + 1] AS ch, round(end_s - n * step + i * step, 3) AS start_s, round(end_s - n * step + (i + 1) * step, 3) AS end_s FROM e"""


def word_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of the conversations' texts, with speakers that change within words."""
    chars = A.utterances(spark, sf_dir).select(F.concat_ws("-", F.col("meeting_id").cast("string"), F.col("utt_idx").cast("string")).alias("meeting_id"), F.posexplode(F.split("text", "")).alias("pos", "ch")).where("ch <> ''")
    chars = chars.select("meeting_id", "pos", "ch", F.concat(F.lit("S"), (F.floor(F.col("pos") / 7) % 3).cast("string")).alias("label"), (F.col("pos") % 11 == 0).alias("snapped"), F.round(F.lit(1.0) / (1 + F.col("pos") % 9), 4).alias("confidence"))
    return S.word_vote(chars)


VOTE = r"""WITH u AS (SELECT conv_id || '-' || turn AS meeting_id, text, unnest(range(length(text))) AS pos FROM conversations),
c AS (SELECT meeting_id, CAST(pos AS INT) AS pos, text[pos + 1] AS ch, 'S' || (pos // 7) % 3 AS label, pos % 11 = 0 AS snapped, round(1.0::DOUBLE / (1 + pos % 9), 4) AS confidence FROM u),
n AS (SELECT *, regexp_matches(ch, '^[A-Za-z0-9'']$') AS inn FROM c),
w AS (SELECT *, sum(CASE WHEN inn AND coalesce(lp, false) THEN 0 ELSE 1 END) OVER (PARTITION BY meeting_id ORDER BY pos) AS word FROM (SELECT *, lag(inn) OVER (PARTITION BY meeting_id ORDER BY pos) AS lp FROM n)),
v AS (SELECT meeting_id, word, label, snapped, count(*) AS n, min(confidence) AS confidence FROM w GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, word ORDER BY n DESC, label, snapped) AS r FROM v),
t AS (SELECT meeting_id, word, string_agg(ch, '' ORDER BY pos) AS text FROM w GROUP BY ALL)
SELECT t.meeting_id, t.word, t.text, k.label, k.snapped, k.confidence FROM t JOIN k ON k.meeting_id = t.meeting_id AND k.word = t.word WHERE r = 1"""

QUERIES = {
    "talk_time_share": (talk_time_share, TALK),
    "asof_note_line": (asof_note_line, ASOF),
    "turn_attribution": (turn_attribution, ATTRIBUTION),
    "turn_attribution_previous": (turn_attribution_previous, PREVIOUS),
    "speaker_carry_over": (speaker_carry_over, CARRY),
    "clean_speech": (clean_speech, CLEAN),
    "stitch": (stitch, None),
    "silence_cuts": (silence_cuts, f'WITH {CUTS} SELECT meeting_id, idx, "at", cut, total FROM cuts'),
    "time_restore": (time_restore, RESTORE),
    "turn_islands": (turn_islands, ISLANDS),
    "voiced_runs": (voiced_runs, VOICED),
    "speaker_segments": (speaker_segments, SEGMENTS),
    "speaker_changes": (speaker_changes, CHANGES),
    "gain_decision": (gain_decision, GAIN),
    "delta_placement": (delta_placement, DELTAS),
    "char_placement": (char_placement, PLACED),
    "word_vote": (word_vote, VOTE),
}
