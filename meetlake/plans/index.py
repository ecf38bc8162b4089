"""Registered queries of the index: refreshed by a stream of edits, kept in codes of eight bits; turns that statements extend; time stamps mended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlake.operators import index_store as I
from meetlake.operators import notes as N
from meetlake.operators import retrieval as R
from meetlake.plans import adapters as A
from meetlake.plans.passages import TOKENS
from meetlake.plans.retrieval import DENSE
from meetlake.plans.streaming import folder, streamed
from meetlake.sources.settled import fresh_path
from meetlake.streaming import live
from meetlake.streaming import refresh as S

#: Dimensions of the vectors that stand for an embedding model's.
DIMS = 16


def documents(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    """Conversations as meetings' documents. The second version changes every fifth line of every third meeting, the title of every fourth, and
    leaves every seventh out."""
    lines = A.utterances(spark, sf_dir)
    changed = (F.lit(version) == 2) & (F.col("meeting_id") % 3 == 0) & (F.col("utt_idx") % 5 == 0)
    lines = lines.withColumn("text", F.concat("text", F.when(changed, " edited since").otherwise("")))
    whole = lines.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct(F.col("utt_idx").cast("int").alias("utt_idx"), "speaker", "start_s", "end_s", "text"))).alias("lines"))
    title = F.concat(F.lit("Meeting "), F.col("meeting_id").cast("string"), F.when((F.lit(version) == 2) & (F.col("meeting_id") % 4 == 0), " again").otherwise(""))
    notes = F.transform(F.filter("lines", lambda x: x["utt_idx"] % 3 == 0), lambda x: F.struct(x["utt_idx"].alias("note_idx"), x["utt_idx"].alias("note_id"), F.lit("0:01").alias("ts"), F.lit(None).cast("string").alias("tag"), F.when(x["utt_idx"] % 9 == 0, "short").otherwise(x["text"]).alias("text")))
    names = F.create_map(F.lit("2"), F.lit("Assistant"))
    found = whole.select("meeting_id", F.lit(version).cast("long").alias("version"), title.alias("title"), F.concat(F.lit(" first line \n\n"), F.get("lines", F.lit(0))["text"]).alias("summary"), notes.alias("notes"), "lines", names.alias("names"))
    return found.where("meeting_id % 7 <> 0") if version == 2 else found


def embedded(rows: DataFrame) -> DataFrame:
    """Vectors of length one, made of digests of the texts: what stands here for an embedding model."""
    digit = lambda i: F.conv(F.substring(F.md5(F.concat("text", F.lit("#"), i.cast("string"))), 1, 4), 16, 10).cast("double") / 65535 * 2 - 1
    raw = rows.withColumn("_v", F.transform(F.sequence(F.lit(0), F.lit(DIMS - 1)), digit))
    length = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    return raw.withColumn("_l", length).withColumn("vector", F.transform("_v", lambda x: x / F.col("_l"))).drop("_v", "_l")


def index_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after a stream that brought two versions of the library, one after the other: codes as text, and the version of the document for
    which each was embedded."""
    path = fresh_path(spark, "library")
    kinds = documents(spark, sf_dir, 1).schema
    store = I.Store(spark, fresh_path(spark, "index"), "m1")
    for version in (1, 2):
        documents(spark, sf_dir, version).write.parquet(f"{path}/version={version}")
        S.follow(spark.readStream.schema(kinds).parquet(f"{path}/*"), store, embedded, f"{path}-checkpoint")
    return store.vectors().select("meeting_id", "kind", "a", "b", "made", F.array_join(F.transform("codes", lambda x: x.cast("string")), ",").alias("codes"))


REFRESH = rf"""WITH RECURSIVE {A.UTT},
v AS (SELECT 1 AS v UNION ALL SELECT 2), l AS (SELECT v, u.meeting_id, utt_idx, speaker, start_s, end_s, text || CASE WHEN v = 2 AND u.meeting_id % 3 = 0 AND utt_idx % 5 = 0 THEN ' edited since' ELSE '' END AS raw FROM utt u, v WHERE v = 1 OR u.meeting_id % 7 <> 0),
ln AS (SELECT *, CASE speaker WHEN 2 THEN 'Assistant: ' || raw ELSE raw END AS text FROM l),
tk AS (SELECT *, row_number() OVER (PARTITION BY v, meeting_id ORDER BY utt_idx) - 1 AS i, {TOKENS} AS tokens FROM ln),
cu AS (SELECT *, sum(tokens) OVER (PARTITION BY v, meeting_id ORDER BY i) AS cum, count(*) OVER (PARTITION BY v, meeting_id) AS n FROM tk),
nx AS (SELECT a.v, a.meeting_id, a.i, a.n, max(b.i) AS b FROM cu a JOIN cu b ON b.v = a.v AND b.meeting_id = a.meeting_id AND b.i >= a.i AND (b.i = a.i OR (b.cum - a.cum + a.tokens <= 200 AND b.end_s - a.start_s <= 40)) GROUP BY ALL),
ch AS (SELECT v, meeting_id, i, n, b FROM nx WHERE i = 0 UNION ALL SELECT nx.v, nx.meeting_id, nx.i, nx.n, nx.b FROM ch JOIN nx ON nx.v = ch.v AND nx.meeting_id = ch.meeting_id AND nx.i = CASE WHEN ch.b > ch.i THEN ch.b ELSE ch.b + 1 END),
u0 AS (SELECT ch.v, ch.meeting_id, 'chunk' AS kind, ch.i AS a, ch.b, string_agg(text, chr(10) ORDER BY tk.i) AS text FROM ch JOIN tk ON tk.v = ch.v AND tk.meeting_id = ch.meeting_id AND tk.i BETWEEN ch.i AND ch.b GROUP BY ch.v, ch.meeting_id, ch.i, ch.b
  UNION ALL SELECT v, meeting_id, 'note', utt_idx, 0, raw FROM l WHERE utt_idx % 3 = 0 AND utt_idx % 9 <> 0 AND length(raw) >= 6),
h0 AS (SELECT v, meeting_id, 0 AS p, 'Meeting ' || meeting_id || CASE WHEN v = 2 AND meeting_id % 4 = 0 THEN ' again' ELSE '' END AS text FROM l WHERE utt_idx = 0 UNION ALL SELECT v, meeting_id, 1, 'first line' FROM l WHERE utt_idx = 0
  UNION ALL SELECT v, meeting_id, 2 + i, trim(x, ' ' || chr(9)) FROM (SELECT v, meeting_id, string_split(raw, chr(10)) AS xs, unnest(range(len(string_split(raw, chr(10))))) AS i, unnest(string_split(raw, chr(10))) AS x FROM l WHERE utt_idx = 0) WHERE trim(x, ' ' || chr(9)) <> ''),
h AS (SELECT *, row_number() OVER (PARTITION BY v, meeting_id ORDER BY p) AS i, {TOKENS} AS tokens FROM h0),
pa AS (SELECT v, meeting_id, i, text, tokens AS n, 0 AS part FROM h WHERE i = 1 UNION ALL SELECT h.v, h.meeting_id, h.i, h.text, CASE WHEN pa.n > 0 AND pa.n + h.tokens > 440 THEN h.tokens ELSE pa.n + h.tokens END, pa.part + CASE WHEN pa.n > 0 AND pa.n + h.tokens > 440 THEN 1 ELSE 0 END
  FROM pa JOIN h ON h.v = pa.v AND h.meeting_id = pa.meeting_id AND h.i = pa.i + 1),
un AS (SELECT * FROM u0 UNION ALL SELECT v, meeting_id, 'meeting', part, 0, string_agg(text, chr(10) ORDER BY i) FROM pa GROUP BY v, meeting_id, part),
la AS (SELECT meeting_id, max(v) AS v FROM l GROUP BY meeting_id),
k AS (SELECT un.*, EXISTS (SELECT 1 FROM un o WHERE o.v = 1 AND o.meeting_id = un.meeting_id AND o.kind = un.kind AND o.text = un.text) AS old FROM un JOIN la ON la.meeting_id = un.meeting_id AND la.v = un.v),
e AS (SELECT *, list_transform(range({DIMS}), lambda j: CAST('0x' || substring(md5(text || '#' || j), 1, 4) AS INT) / 65535.0::DOUBLE * 2 - 1) AS x FROM k)
SELECT meeting_id, kind, CAST(a AS INT) AS a, CAST(b AS INT) AS b, CASE WHEN old THEN 1 ELSE v END AS made,
  array_to_string(list_transform(x, lambda y: CAST(greatest(-127, least(127, round(y / sqrt(list_dot_product(x, x)) * 127))) AS INT)), ',') AS codes FROM e"""


def code_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors kept in codes of eight bits in the index's table, asked for benchmark texts' vectors."""
    path = fresh_path(spark, "codes")
    A.vectors(spark, sf_dir).select("vec_id", "meeting_id", R.quantised(F.col("vector")).alias("codes"), F.pmod(F.xxhash64("meeting_id"), F.lit(16)).alias("bucket")).write.partitionBy("bucket").parquet(path)
    stored = spark.read.schema("vec_id long, meeting_id long, codes array<tinyint>, bucket int").parquet(path).drop("bucket")
    hits = R.quantised_hits(stored, A.queries(spark, sf_dir).select("query_id", "vector"))
    return hits.select("query_id", "meeting_id", "vec_id", F.round("cosine", 6).alias("cosine"))


CODES = f"""WITH {A.VECTORS}, {DENSE.split("dn AS")[0].rstrip().rstrip(",")},
c AS (SELECT vec_id, meeting_id, list_transform(vector, lambda x: greatest(-127.0::DOUBLE, least(127.0::DOUBLE, round(x * 127)))) AS codes FROM vecs)
SELECT query_id, meeting_id, vec_id, round(round(list_dot_product(codes, vector) / 127, 9), 6) AS cosine FROM c, qv WHERE round(list_dot_product(codes, vector) / 127, 9) >= 0.45"""


def statements(rows: DataFrame) -> DataFrame:
    """Events as statements about turns: 200 a meeting, seven seconds apart; a turn's start is stated again within some milliseconds, every sixth
    time without a label, every tenth long after."""
    n = F.col("event_id")
    at = (n % 200) * 7.0
    start = F.floor(at / 20) * 20 + (n % 4) * 0.004 - F.when(n % 10 == 0, 60.0).otherwise(0.0)
    return rows.select(F.floor(n / 200).alias("meeting_id"), n.alias("arrival"), F.round(start, 3).alias("start_s"), (at + F.col("user_id") % 9).alias("end_s"), F.when(n % 6 == 0, "").otherwise((F.col("user_id") % 4).cast("string")).alias("label"), F.round(F.col("user_id") % 100 / 100, 2).alias("confidence"), (at + 2).alias("fed_s"))


def turn_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statements by one stream; a table's files may hold them in any order, so they make one micro-batch here."""
    return live.replayed(spark, S.closed_turns(statements(streamed(spark, sf_dir, "events"))), folder(spark))


TURNS = """WITH RECURSIVE s AS (SELECT event_id // 200 AS m, event_id AS n, (event_id % 200) * 7.0::DOUBLE AS at_, user_id AS u FROM events),
t AS (SELECT m, row_number() OVER (PARTITION BY m ORDER BY n) AS i, round(floor(at_ / 20) * 20 + (n % 4) * 0.004::DOUBLE - CASE WHEN n % 10 = 0 THEN 60 ELSE 0 END, 3) AS a, at_ + u % 9 AS b, CASE WHEN n % 6 = 0 THEN '' ELSE CAST(u % 4 AS VARCHAR) END AS l, round((u % 100) / 100.0::DOUBLE, 2) AS c, at_ + 2 AS fed FROM s),
r AS (SELECT m, 0::BIGINT AS i, -1e300::DOUBLE AS fed, CAST([] AS STRUCT(a DOUBLE, b DOUBLE, l VARCHAR, c DOUBLE, n BIGINT)[]) AS open, CAST([] AS STRUCT(a DOUBLE, b DOUBLE, l VARCHAR, c DOUBLE, n BIGINT)[]) AS done FROM (SELECT DISTINCT m FROM t)
  UNION ALL SELECT r.m, t.i, k.f,
    CASE WHEN own IS NOT NULL THEN list_transform(still, lambda x: CASE WHEN x.a = own THEN {'a': x.a, 'b': greatest(x.b, t.b), 'l': CASE t.l WHEN '' THEN x.l ELSE t.l END, 'c': t.c, 'n': x.n + 1} ELSE x END)
      WHEN t.a > k.f - 15 THEN list_sort(list_append(still, {'a': t.a, 'b': t.b, 'l': t.l, 'c': t.c, 'n': 1::BIGINT})) ELSE still END,
    list_concat(r.done, list_filter(r.open, lambda x: x.b <= k.f - 15))
  FROM r JOIN t ON t.m = r.m AND t.i = r.i + 1, LATERAL (SELECT greatest(r.fed, t.fed) AS f) k, LATERAL (SELECT list_filter(r.open, lambda x: x.b > k.f - 15) AS still) g, LATERAL (SELECT list_filter(still, lambda x: round(abs(x.a - t.a), 9) <= 0.01)[1].a AS own) o),
f AS (SELECT m, arg_max(row(list_concat(done, list_filter(open, lambda x: x.b <= fed - 15))), i)[1] AS done FROM r GROUP BY m)
SELECT m AS meeting_id, x.a AS start_s, x.b AS end_s, x.l AS label, x.c AS confidence, x.n AS statements FROM (SELECT m, unnest(done) AS x FROM f)"""


def clock(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60
    return F.when(seconds >= 3600, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def repaired_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as texts that cite times in all forms, and as the times that their meeting knows."""
    rows = A.table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("meeting_id"), F.col("event_id").alias("n"))
    known = rows.select("meeting_id", clock((F.col("n") * 37) % 7200).alias("ts"), F.col("n").alias("pos"))
    t = (F.col("n") * 53) % 7300
    cut = F.concat(F.floor(t / 60).cast("string"), F.lit(":"), (F.col("n") % 10).cast("string"))
    text = F.concat(F.lit("At ["), clock(t), F.lit("] and ["), cut, F.lit("，"), clock(t + 900), F.lit(" – "), clock(t + 901), F.lit(";7] or [["), clock(t), F.lit("]], [21] not [a 1:02] [1：05、"), clock(t), F.lit("] [12:60:1] end ["), clock(t + 3), F.lit("]"))
    return N.repaired(rows.select("meeting_id", F.col("n").alias("text_id"), text.alias("text")), known)


MEND = r"""WITH ev AS (SELECT user_id % 50 AS m, event_id AS n FROM events),
kn AS (SELECT m, s AS k, arg_min(c, n) AS ts FROM (SELECT m, n, (n * 37) % 7200 AS s, CASE WHEN (n * 37) % 7200 >= 3600 THEN printf('%d:%02d:%02d', (n * 37) % 7200 // 3600, (n * 37) % 7200 // 60 % 60, (n * 37) % 7200 % 60) ELSE printf('%d:%02d', (n * 37) % 7200 // 60, (n * 37) % 7200 % 60) END AS c FROM ev) GROUP BY ALL),
x AS (SELECT m, n, (n * 53) % 7300 AS t FROM ev),
c AS (SELECT *, CASE WHEN t >= 3600 THEN printf('%d:%02d:%02d', t // 3600, t // 60 % 60, t % 60) ELSE printf('%d:%02d', t // 60, t % 60) END AS c0, CASE WHEN t + 900 >= 3600 THEN printf('%d:%02d:%02d', (t + 900) // 3600, (t + 900) // 60 % 60, (t + 900) % 60) ELSE printf('%d:%02d', (t + 900) // 60, (t + 900) % 60) END AS c1,
  CASE WHEN t + 901 >= 3600 THEN printf('%d:%02d:%02d', (t + 901) // 3600, (t + 901) // 60 % 60, (t + 901) % 60) ELSE printf('%d:%02d', (t + 901) // 60, (t + 901) % 60) END AS c2, CASE WHEN t + 3 >= 3600 THEN printf('%d:%02d:%02d', (t + 3) // 3600, (t + 3) // 60 % 60, (t + 3) % 60) ELSE printf('%d:%02d', (t + 3) // 60, (t + 3) % 60) END AS c3,
  (t // 60) || ':' || (n % 10) AS cut FROM x),
it AS (SELECT m, n, 0 AS tag, 0 AS item, [{'a': t, 'b': t}] AS sp FROM c
  UNION ALL SELECT m, n, 1, 0, CASE WHEN n % 10 <= 5 THEN [{'a': t // 60 * 60 + n % 10, 'b': t // 60 * 60 + n % 10}, {'a': t // 60 * 60 + n % 10 * 10, 'b': t // 60 * 60 + n % 10 * 10 + 9}] ELSE [{'a': t // 60 * 60 + n % 10, 'b': t // 60 * 60 + n % 10}] END FROM c
  UNION ALL SELECT m, n, 1, 1, [{'a': t + 900, 'b': t + 900}] FROM c UNION ALL SELECT m, n, 1, 2, [{'a': t + 901, 'b': t + 901}] FROM c
  UNION ALL SELECT m, n, 2, 0, [{'a': 65, 'b': 65}] FROM c UNION ALL SELECT m, n, 2, 1, [{'a': t, 'b': t}] FROM c UNION ALL SELECT m, n, 3, 0, [{'a': t + 3, 'b': t + 3}] FROM c),
un AS (SELECT m, n, tag, item, unnest(sp) AS s FROM it),
d AS (SELECT un.m, un.n, tag, item, kn.k, kn.ts, min(CASE WHEN kn.k BETWEEN s.a AND s.b THEN 0 ELSE least(abs(kn.k - s.a), abs(kn.k - s.b)) END) AS far FROM un JOIN kn ON kn.m = un.m AND kn.k BETWEEN s.a - 30 AND s.b + 30 GROUP BY ALL),
be AS (SELECT m, n, tag, item, arg_min(ts, row(far, k)) AS ts FROM d GROUP BY ALL), fi AS (SELECT m, n, tag, ts, min(item) AS item FROM be GROUP BY ALL),
sh AS (SELECT m, n, tag, string_agg('[' || ts || ']', ' ' ORDER BY item) AS s FROM fi GROUP BY ALL),
p AS (SELECT m, n, coalesce(max(s) FILTER (WHERE tag = 0), '') AS s0, coalesce(max(s) FILTER (WHERE tag = 1), '') AS s1, coalesce(max(s) FILTER (WHERE tag = 2), '') AS s2, coalesce(max(s) FILTER (WHERE tag = 3), '') AS s3 FROM sh GROUP BY ALL)
SELECT c.m AS meeting_id, c.n AS text_id, 'At [' || c0 || '] and [' || cut || '，' || c1 || ' – ' || c2 || ';7] or [[' || c0 || ']], [21] not [a 1:02] [1：05、' || c0 || '] [12:60:1] end [' || c3 || ']' AS text,
  'At ' || coalesce(s0, '') || ' and ' || coalesce(s1, '') || ' or [[' || c0 || ']],  not [a 1:02] ' || coalesce(s2, '') || '  end ' || coalesce(s3, '') AS repaired
FROM c LEFT JOIN p ON p.m = c.m AND p.n = c.n"""

QUERIES = {
    "index_refresh": (index_refresh, REFRESH),
    "code_search": (code_search, CODES),
    "turn_stream": (turn_stream, TURNS),
    "repaired_times": (repaired_times, MEND),
}
