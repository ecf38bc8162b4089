"""Registered queries of passages and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlake.functions import text as X
from meetlake.operators import passages as P
from meetlake.operators import people as O
from meetlake.operators import render as N
from meetlake.operators import retrieval as R
from meetlake.plans import adapters as A

#: token_estimate() of texts without CJK characters, in SQL.
TOKENS = r"(len(regexp_extract_all(text, '[\p{L}\p{N}]+')) * 4 + 2) // 3"


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.utterances(spark, sf_dir).withColumn("tokens", X.token_estimate(F.col("text")))


def chunks_200_40(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.chunks(counted(spark, sf_dir))


CHUNKS = f"""{A.UTT}, tk AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY utt_idx) - 1 AS i, {TOKENS} AS tokens FROM utt),
cu AS (SELECT *, sum(tokens) OVER (PARTITION BY meeting_id ORDER BY i) AS cum, count(*) OVER (PARTITION BY meeting_id) AS n FROM tk),
nx AS (SELECT a.meeting_id, a.i, a.n, max(b.i) AS b FROM cu a JOIN cu b ON b.meeting_id = a.meeting_id AND b.i >= a.i AND (b.i = a.i OR (b.cum - a.cum + a.tokens <= 200 AND b.end_s - a.start_s <= 40)) GROUP BY ALL),
ch AS (SELECT meeting_id, 0::BIGINT AS chunk, i, n, b FROM nx WHERE i = 0
  UNION ALL SELECT nx.meeting_id, ch.chunk + 1, nx.i, nx.n, nx.b FROM ch JOIN nx ON nx.meeting_id = ch.meeting_id AND nx.i = CASE WHEN ch.b > ch.i THEN ch.b ELSE ch.b + 1 END)"""


def parts_of(budget: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return P.parts(counted(spark, sf_dir), budget)

    sql = f"""WITH RECURSIVE {A.UTT}, tk AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY utt_idx) - 1 AS i, {TOKENS} AS tokens FROM utt),
st AS (SELECT meeting_id, utt_idx, i, tokens AS n, 0 AS part FROM tk WHERE i = 0
  UNION ALL SELECT tk.meeting_id, tk.utt_idx, tk.i, CASE WHEN st.n > 0 AND st.n + tk.tokens > {budget} THEN tk.tokens ELSE st.n + tk.tokens END, st.part + CASE WHEN st.n > 0 AND st.n + tk.tokens > {budget} THEN 1 ELSE 0 END
  FROM st JOIN tk ON tk.meeting_id = st.meeting_id AND tk.i = st.i + 1)
SELECT meeting_id, utt_idx, part FROM st"""
    return query, sql


def passage_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = A.utterances(spark, sf_dir)
    return P.span_texts(P.chunks(counted(spark, sf_dir)), lines, 200)


PASSAGE_TEXT = f"""WITH RECURSIVE {CHUNKS} SELECT ch.meeting_id, chunk, ch.i AS a, ch.b AS b, min(u.start_s) AS start_s, substring(string_agg(u.text, ' ' ORDER BY u.utt_idx), 1, 200) AS text
FROM ch JOIN utt u ON u.meeting_id = ch.meeting_id AND u.utt_idx BETWEEN ch.i AND ch.b GROUP BY ALL"""


def vector_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as passages; those of even numbers are stored, a third of them for another model."""
    rows = A.table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2("text", 256).alias("text_hash"), F.lit("m1").alias("model_id"))
    stored = rows.where("doc_id % 2 = 0").select("text", "text_hash", F.when(F.col("doc_id") % 3 == 0, "m0").otherwise("m1").alias("model_id"))
    have, lack = P.reused(rows, stored)
    return have.select("doc_id", F.lit(True).alias("reused")).unionByName(lack.select("doc_id", F.lit(False).alias("reused")))


REUSE = """SELECT doc_id, EXISTS (SELECT 1 FROM documents o WHERE o.text = d.text AND o.doc_id % 2 = 0 AND o.doc_id % 3 <> 0) AS reused FROM documents d"""


def stale_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations against an index made before every fifth one's second turn changed its speaker."""
    lines = A.utterances(spark, sf_dir)
    old = lines.withColumn("speaker", F.when((F.col("meeting_id") % 5 == 0) & (F.col("utt_idx") == 1), 7).otherwise(F.col("speaker")))
    index = P.fingerprints(old).withColumn("model_id", F.when(F.col("meeting_id") % 7 == 0, "m0").otherwise("m1"))
    return P.stale(P.fingerprints(lines).withColumn("model_id", F.lit("m1")), index).select("meeting_id", "fingerprint")


STALE = f"""WITH {A.UTT}, f AS (SELECT meeting_id, sha256(string_agg(utt_idx || '|' || speaker || '|' || text, chr(10) ORDER BY utt_idx)) AS fingerprint, bool_or(utt_idx = 1) AS two FROM utt GROUP BY ALL)
SELECT meeting_id, fingerprint FROM f WHERE meeting_id % 7 = 0 OR (meeting_id % 5 = 0 AND two)"""


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.utterances(spark, sf_dir).withColumn("name", O.display_name(F.when(F.col("speaker") == 2, "Assistant"), F.col("speaker")))


NAME = "CASE speaker WHEN 2 THEN 'Assistant' ELSE 'Speaker ' || (speaker + 1) END"
CLOCK = "CASE WHEN floor(start_s) >= 3600 THEN printf('%d:%02d:%02d', CAST(floor(start_s) AS BIGINT) // 3600, CAST(floor(start_s) AS BIGINT) % 3600 // 60, CAST(floor(start_s) AS BIGINT) % 60) ELSE printf('%02d:%02d', CAST(floor(start_s) AS BIGINT) // 60, CAST(floor(start_s) AS BIGINT) % 60) END"


def txt_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.transcript(named(spark, sf_dir))


TXT = rf"""WITH {A.UTT}, t AS (SELECT meeting_id, utt_idx, '[' || {CLOCK} || '] ' || {NAME} || ': ' || regexp_replace(text, '^\s+|\s+$', '', 'g') AS line FROM utt WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> '')
SELECT meeting_id, string_agg(line, chr(10) ORDER BY utt_idx) AS transcript FROM t GROUP BY ALL"""


def lrc_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.lyrics(named(spark, sf_dir))


LRC = f"""WITH {A.UTT}, c AS (SELECT *, CAST(floor(start_s * 100) AS BIGINT) AS cs, trim(replace(text, chr(10), ' ')) AS x FROM utt)
SELECT meeting_id, string_agg(printf('[%02d:%02d.%02d]', cs // 6000, cs // 100 % 60, cs % 100) || {NAME} || ': ' || x || chr(10), '' ORDER BY utt_idx) AS lyrics FROM c WHERE x <> '' GROUP BY ALL"""


def srt_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.subtitles(N.cues(named(spark, sf_dir)))


def vtt_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.subtitles(N.cues(named(spark, sf_dir)), vtt=True)


def meeting_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.utterances(spark, sf_dir).withColumn("name", F.when(F.col("speaker") == 2, "Assistant").when((F.col("speaker") == 1) & (F.col("meeting_id") % 3 == 0), "Visitor"))
    return N.facts(rows)


FACTS = f"""WITH {A.UTT}, r AS (SELECT *, CASE WHEN speaker = 2 THEN 'Assistant' WHEN speaker = 1 AND meeting_id % 3 = 0 THEN 'Visitor' END AS name FROM utt),
p AS (SELECT meeting_id, name, min(speaker) AS o FROM r WHERE name IS NOT NULL GROUP BY ALL), q AS (SELECT meeting_id, string_agg(name, ', ' ORDER BY o) AS participants FROM p GROUP BY ALL),
w AS (SELECT meeting_id, max(end_s) AS s, count(DISTINCT speaker) FILTER (WHERE name IS NULL) AS unnamed FROM r GROUP BY ALL)
SELECT w.meeting_id, coalesce(participants, '') AS participants, unnamed, CAST(round_even(s / 60, 0) AS INT) AS minutes FROM w LEFT JOIN q ON q.meeting_id = w.meeting_id"""


def reader_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances as a note-writer reads them: cleaned, with a short label and whole seconds; empty ones go."""
    rows = A.utterances(spark, sf_dir).withColumn("text", X.clean(F.col("text"))).where("text <> ''")
    return rows.select("meeting_id", "utt_idx", F.concat(F.lit("S"), (F.col("speaker") + 1).cast("string")).alias("label"), F.floor("start_s").cast("int").alias("start"), "text")


READER = rf"""WITH {A.UTT}, c AS (SELECT *, trim(regexp_replace(regexp_replace(text, '\[[A-Za-z][A-Za-z _-]*\]', '', 'g'), '[\s\x0B]+', ' ', 'g')) AS x FROM utt)
SELECT meeting_id, utt_idx, 'S' || (speaker + 1) AS label, CAST(floor(start_s) AS INT) AS start, x AS text FROM c WHERE x <> ''"""


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "documents").select("doc_id", X.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens"), X.width(F.coalesce("text", F.lit(""))).alias("cells"))


TOKEN_COUNTS = f"SELECT doc_id, CAST({TOKENS} AS INT) AS tokens, CAST(length(text) AS INT) AS cells FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)"


def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of conversations that contain the second word of a benchmark text, without case."""
    asked = A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lower(F.split_part("text", F.lit(" "), F.lit(2))).alias("q")).where("char_length(q) >= 4")
    lines = A.utterances(spark, sf_dir).select("meeting_id", "utt_idx", F.lower("text").alias("t"))
    found = R.containing(lines, asked, "t", "q")
    return found.select("query_id", "meeting_id", "utt_idx", F.instr("t", F.col("q")).alias("at"), X.snippet(F.col("t"), F.col("q")).alias("snippet"))


SUBSTRING = f"""WITH {A.UTT}, q AS (SELECT item_id AS query_id, lower(split_part(text, ' ', 2)) AS q FROM benchmark)
SELECT query_id, meeting_id, utt_idx, CAST(instr(lower(text), q) AS INT) AS at, CASE WHEN instr(lower(text), q) > 25 THEN '…' || substring(lower(text), instr(lower(text), q) - 24) ELSE lower(text) END AS snippet FROM utt JOIN q ON contains(lower(text), q) WHERE length(q) >= 4"""


READ_WINDOWS, READ_WINDOWS_SQL = parts_of(300)
MEETING_PARTS, MEETING_PARTS_SQL = parts_of(440)

QUERIES = {
    "chunks_200_40": (chunks_200_40, f"WITH RECURSIVE {CHUNKS} SELECT meeting_id, chunk, i AS a, b FROM ch"),
    "read_windows": (READ_WINDOWS, READ_WINDOWS_SQL),
    "meeting_parts": (MEETING_PARTS, MEETING_PARTS_SQL),
    "passage_text": (passage_text, PASSAGE_TEXT),
    "vector_reuse": (vector_reuse, REUSE),
    "stale_index": (stale_index, STALE),
    "txt_export": (txt_export, TXT),
    "lrc_export": (lrc_export, LRC),
    "srt_export": (srt_export, None),
    "vtt_export": (vtt_export, None),
    "meeting_facts": (meeting_facts, FACTS),
    "reader_lines": (reader_lines, READER),
    "token_estimates": (token_counts, TOKEN_COUNTS),
    "substring_search": (substring_search, SUBSTRING),
}
