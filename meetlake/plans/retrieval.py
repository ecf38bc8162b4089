"""Registered queries of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlake.functions import text as X
from meetlake.operators import retrieval as R
from meetlake.plans import adapters as A


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.spread(A.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", X.fold(F.col("text")).alias("text"))


def keyword_hits(spark: SparkSession, sf_dir: str, best: int | None = None, per: str | None = None) -> DataFrame:
    """Documents by words, in twenty meetings; with ``best`` only what can be among so many of a question, or of a question and ``per``."""
    return R.bm25(folded(spark, sf_dir).withColumn("meeting_id", F.col("doc_id") % 20), A.queries(spark, sf_dir), best=best, per=per)


def dense_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dense(A.vectors(spark, sf_dir), A.queries(spark, sf_dir))


BM25 = r"""d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ts FROM documents),
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark),
size AS (SELECT count(*) AS n, greatest(1.0, sum(coalesce(len(ts), 0)) / count(*)) AS mean FROM d),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT q.query_id, tf.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d.ts) / mean))) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN d USING (doc_id), size GROUP BY ALL)"""
DENSE = """qv AS (SELECT item_id AS query_id, v.vector FROM benchmark JOIN vecs v ON v.vec_id = item_id),
dn AS (SELECT qv.query_id, v.vec_id, v.meeting_id, v.person, round(list_dot_product(v.vector, qv.vector), 9) AS cosine FROM vecs v, qv
  WHERE round(list_dot_product(v.vector, qv.vector), 9) >= 0.45)"""


def bm25_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = R.top(keyword_hits(spark, sf_dir, 10), ["query_id"], [F.desc(F.round("score", 6)), "doc_id"], 10)
    return hits.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


BM25_TOP10 = f"""WITH {BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm)
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 10"""


def dense_topk_per_meeting(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = R.top(dense_hits(spark, sf_dir), ["query_id", "meeting_id"], [F.desc("cosine"), "vec_id"], 3)
    return hits.select("query_id", "meeting_id", "rank", "vec_id", F.round("cosine", 6).alias("cosine"))


DENSE_TOPK = f"""WITH {A.VECTORS}, {DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, meeting_id ORDER BY cosine DESC, vec_id) AS rank FROM dn)
SELECT query_id, meeting_id, rank, vec_id, round(cosine, 6) AS cosine FROM r WHERE rank <= 3"""


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, score and the lists of each query's hits: the best 16 of both lists, fused."""
    words = R.top(keyword_hits(spark, sf_dir, 16), ["query_id"], [F.desc(F.round("score", 6)), "doc_id"], 16)
    near = R.top(dense_hits(spark, sf_dir).withColumnRenamed("vec_id", "doc_id"), ["query_id"], [F.desc("cosine"), "doc_id"], 16)
    return R.fused([(near, 1.0), (words, 1.0)], ["query_id", "doc_id"])


def hybrid_rrf_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = R.top(hybrid(spark, sf_dir), ["query_id"], [F.desc(F.round("score", 9)), "doc_id"], 3)
    return hits.select("query_id", "rank", "doc_id", F.round("score", 6).alias("rrf_score"))


LISTS = f"""WITH {BM25}, {A.VECTORS}, {DENSE},
kw AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm),
dr AS (SELECT query_id, vec_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM dn),
both_ AS (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) AS w, 1 AS f FROM dr WHERE rank <= 16 UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank), 2 FROM kw WHERE rank <= 16),
fu AS (SELECT query_id, doc_id, sum(w) AS score, bit_or(f) AS found FROM both_ GROUP BY ALL)"""
HYBRID = f"""{LISTS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM fu)
SELECT query_id, rank, doc_id, round(score, 6) AS rrf_score FROM r WHERE rank <= 3"""


def hit_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fused hits with where they were found: by meaning only, by words only, or both."""
    found = F.when(F.col("found") == 1, "meaning").when(F.col("found") == 2, "words").otherwise("both")
    return hybrid(spark, sf_dir).select("query_id", "doc_id", found.alias("found_by"), F.round("score", 6).alias("score"))


HIT_UNION = f"""{LISTS} SELECT query_id, doc_id, CASE found WHEN 1 THEN 'meaning' WHEN 2 THEN 'words' ELSE 'both' END AS found_by, round(score, 6) AS score FROM fu"""


def library_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meetings by their best fused passage, the lexical list weighing 0.3, plus a little for the number of their passages. Every fourth
    passage stands for its whole meeting."""
    kind = F.when(F.col("passage") % 4 == 0, "meeting").otherwise("chunk")
    words = keyword_hits(spark, sf_dir, 3, "meeting_id").select("query_id", "meeting_id", F.col("doc_id").alias("passage"), F.round("score", 6).alias("score")).withColumn("kind", kind)
    near = dense_hits(spark, sf_dir).select("query_id", "meeting_id", F.col("vec_id").alias("passage"), F.col("cosine").alias("score")).withColumn("kind", kind)
    return R.fused_library(near, words).select("query_id", "meeting_id", "passages", F.round("score", 6).alias("score"))


LIBRARY_RRF = f"""WITH {BM25}, {A.VECTORS}, {DENSE},
kb AS (SELECT *, doc_id % 20 AS meeting_id, CASE doc_id % 4 WHEN 0 THEN 'meeting' ELSE 'chunk' END AS kind FROM bm),
k1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, meeting_id ORDER BY round(score, 6) DESC, kind, doc_id) AS r1, max(round(score, 6)) OVER (PARTITION BY query_id, meeting_id) AS lead_ FROM kb),
kw AS (SELECT query_id, meeting_id, doc_id, lead_, row_number() OVER (PARTITION BY query_id ORDER BY lead_ DESC, meeting_id, r1) AS rank FROM k1 WHERE r1 <= 3),
db AS (SELECT *, CASE vec_id % 4 WHEN 0 THEN 'meeting' ELSE 'chunk' END AS kind FROM dn),
d0 AS (SELECT *, row_number() OVER (PARTITION BY query_id, meeting_id, kind ORDER BY cosine DESC, vec_id) AS r0 FROM db),
d1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, meeting_id ORDER BY cosine DESC, kind, vec_id) AS r1, max(cosine) OVER (PARTITION BY query_id, meeting_id) AS lead_ FROM d0 WHERE kind = 'chunk' OR r0 = 1),
dr AS (SELECT query_id, meeting_id, vec_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY lead_ DESC, meeting_id, r1) AS rank FROM d1 WHERE r1 <= 3),
fu AS (SELECT query_id, meeting_id, doc_id, sum(w) AS score FROM (
  SELECT query_id, meeting_id, doc_id, 1.0::DOUBLE / (60 + rank - 1) AS w FROM dr
  UNION ALL SELECT query_id, meeting_id, doc_id, 0.3::DOUBLE / (60 + rank - 1) FROM kw WHERE query_id IN (SELECT query_id FROM dr)) GROUP BY ALL)
SELECT query_id, meeting_id, count(*) AS passages, round(max(score) + 0.1 * ln(count(*)), 6) AS score FROM fu GROUP BY ALL
UNION ALL SELECT query_id, meeting_id, count(*), max(lead_) FROM kw WHERE query_id NOT IN (SELECT query_id FROM dr) GROUP BY ALL"""


def lexical_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as meetings: their first line is a title, the second a summary, others notes or lines; each is asked for the second and third word of a
    benchmark text, one meeting being open."""
    rows = A.lines(spark, sf_dir).where("text <> ''").select("meeting_id", F.col("utt_idx").alias("pos"), "text")
    kind = F.when(F.col("pos") == 0, "title").when(F.col("pos") == 1, "summary").when(F.col("pos") % 2 == 0, "note").otherwise("line")
    asked = A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat_ws(" ", F.split_part("text", F.lit(" "), F.lit(2)), F.split_part("text", F.lit(" "), F.lit(3))).alias("query"), (F.col("item_id") * 5).alias("open_meeting"))
    return R.lexical(rows.withColumn("kind", kind), asked).select("query_id", "meeting_id", "rank", "kind", "pos", "score")


LEXICAL = rf"""WITH {A.LINES}, t AS (SELECT meeting_id, utt_idx AS pos, lower(text) AS text, CASE WHEN utt_idx = 0 THEN 'title' WHEN utt_idx = 1 THEN 'summary' WHEN utt_idx % 2 = 0 THEN 'note' ELSE 'line' END AS kind FROM lines WHERE text <> ''),
q AS (SELECT item_id AS query_id, item_id * 5 AS open_meeting, lower(split_part(text, ' ', 2)) AS a, lower(split_part(text, ' ', 3)) AS b FROM benchmark),
h AS (SELECT query_id, meeting_id, kind, pos, CASE kind WHEN 'title' THEN 1.0 WHEN 'line' THEN 0.8 ELSE 0.9 END::DOUBLE AS score FROM t JOIN q ON contains(text, a) AND contains(text, b)
  WHERE a || b <> '' AND (kind <> 'line' OR meeting_id = open_meeting)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, meeting_id ORDER BY score DESC, kind, pos) AS rank FROM h)
SELECT query_id, meeting_id, rank, kind, pos, score FROM r WHERE rank <= 3"""

#: Han characters for letters, so that pairs of characters are searched.
HAN = "".join(chr(0x4E00 + 37 * k) for k in range(26))


def bm25_han(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search in Han script: every Latin letter of documents and benchmark texts stands for a character."""
    han = lambda c: F.translate(F.lower(c), "abcdefghijklmnopqrstuvwxyz", HAN)
    docs = A.spread(A.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", han("text").alias("text"))
    asked = A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), han("text").alias("query"))
    hits = R.top(R.bm25(docs, asked, best=10), ["query_id"], [F.desc(F.round("score", 6)), "doc_id"], 10)
    return hits.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


_HAN_TERMS = rf"""flatten(list_transform(regexp_extract_all(x, '[\x{{4E00}}-\x{{9FFF}}]+|[^\P{{L}}\x{{4E00}}-\x{{9FFF}}]+|\p{{N}}+'), lambda w: CASE WHEN regexp_matches(w, '^[\x{{4E00}}-\x{{9FFF}}]') AND length(w) > 1 THEN list_transform(range(1, length(w)), lambda i: w[i:i+1]) ELSE [w] END))"""
BM25_HAN = rf"""WITH dx AS (SELECT doc_id, translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', '{HAN}') AS x FROM documents), d AS (SELECT doc_id, {_HAN_TERMS} AS ts FROM dx),
qx AS (SELECT item_id AS query_id, translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', '{HAN}') AS x FROM benchmark), q AS (SELECT DISTINCT query_id, unnest({_HAN_TERMS}) AS term FROM qx),
{BM25[BM25.index("size AS"):]}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm)
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 10"""


def meeting_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = keyword_hits(spark, sf_dir, 3, "meeting_id").select("query_id", "meeting_id", F.round("score", 6).alias("score"))
    near = dense_hits(spark, sf_dir).select("query_id", "meeting_id", F.col("cosine").alias("score"))
    return R.routed(near, words).select("query_id", "rank", "meeting_id", F.round("score", 6).alias("score"))


ROUTING = f"""WITH {BM25}, {A.VECTORS}, {DENSE},
k1 AS (SELECT query_id, doc_id % 20 AS meeting_id, round(score, 6) AS s, row_number() OVER (PARTITION BY query_id, doc_id % 20 ORDER BY round(score, 6) DESC) AS r FROM bm),
k2 AS (SELECT query_id, meeting_id, sum(s) AS t FROM k1 WHERE r <= 3 GROUP BY ALL),
d1 AS (SELECT query_id, meeting_id, cosine AS s, row_number() OVER (PARTITION BY query_id, meeting_id ORDER BY cosine DESC) AS r FROM dn),
d2 AS (SELECT query_id, meeting_id, sum(s) / 3 AS t FROM d1 WHERE r <= 3 GROUP BY ALL),
rk AS (SELECT query_id, meeting_id, row_number() OVER (PARTITION BY query_id ORDER BY round(t, 9) DESC, meeting_id) AS r FROM d2
  UNION ALL SELECT query_id, meeting_id, row_number() OVER (PARTITION BY query_id ORDER BY round(t, 9) DESC, meeting_id) FROM k2),
fu AS (SELECT query_id, meeting_id, sum(1.0::DOUBLE / (60 + r)) AS score FROM rk GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, meeting_id) AS rank FROM fu)
SELECT query_id, rank, meeting_id, round(score, 6) AS score FROM t WHERE rank <= 2"""

QUERIES = {
    "hybrid_rrf_top3": (hybrid_rrf_top3, HYBRID),
    "bm25_top10": (bm25_top10, BM25_TOP10),
    "dense_topk_per_meeting": (dense_topk_per_meeting, DENSE_TOPK),
    "hit_union": (hit_union, HIT_UNION),
    "library_rrf": (library_rrf, LIBRARY_RRF),
    "meeting_routing": (meeting_routing, ROUTING),
    "lexical_hits": (lexical_hits, LEXICAL),
    "bm25_han": (bm25_han, BM25_HAN),
}
