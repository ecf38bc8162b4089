"""Registered queries of people, voices and the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meetlake.functions import text as X
from meetlake.operators import library as L
from meetlake.operators import people as O
from meetlake.plans import adapters as A


def order_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as meetings, each with its customer as a speaker, under one of 997 names in different spellings."""
    rows = A.table(spark, sf_dir, "orders")
    n = F.col("o_custkey") % 997
    name = F.when(n % 10 == 0, F.concat(F.lit("Speaker "), n.cast("string"))).when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" PERSON  "), n.cast("string"))).otherwise(F.concat(F.lit("Person "), n.cast("string")))
    return rows.select(F.col("o_orderkey").alias("meeting_id"), F.col("o_orderdate").cast("date").alias("date"), (F.col("o_orderkey") % 4).cast("int").alias("speaker"), name.alias("name"), F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("person_id"))


LINKS = """lk AS (SELECT o_orderkey AS meeting_id, CAST(o_orderdate AS DATE) AS date, CAST(o_orderkey % 4 AS INT) AS speaker, o_custkey,
  CASE WHEN o_custkey % 997 % 10 = 0 THEN 'Speaker ' || (o_custkey % 997) WHEN o_orderkey % 3 = 0 THEN ' PERSON  ' || (o_custkey % 997) ELSE 'Person ' || (o_custkey % 997) END AS name,
  CASE WHEN o_custkey % 2 = 0 THEN 'c' || o_custkey END AS person_id FROM orders)"""


def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two customers in three as people."""
    rows = A.table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0")
    return rows.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("person_id"), F.concat(F.lit("Person "), (F.col("c_custkey") % 997).cast("string")).alias("name"), F.lit("1990-01-01").cast("date").alias("last_used"))


PEOPLE = "pp AS (SELECT 'c' || c_custkey AS person_id, 'Person ' || (c_custkey % 997) AS name, DATE '1990-01-01' AS last_used, c_custkey FROM customer WHERE c_custkey % 3 <> 0)"
KEY = "trim(regexp_replace(lower(name), ' +', ' ', 'g'))"


def link_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.resolved(order_links(spark, sf_dir), directory(spark, sf_dir))


RESOLVE = f"WITH {LINKS}, {PEOPLE} SELECT lk.meeting_id, lk.speaker, coalesce(pp.name, lk.name) AS name, pp.person_id FROM lk LEFT JOIN pp ON pp.person_id = lk.person_id"


def entity_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = O.bootstrap(order_links(spark, sf_dir), directory(spark, sf_dir))
    return found.withColumn("last_used", F.col("last_used").cast("string"))


BOOTSTRAP = f"""WITH {LINKS}, {PEOPLE}, p AS (SELECT {KEY} AS key, min(person_id) AS person_id, arg_min(name, person_id) AS name, max(last_used) AS used FROM pp GROUP BY 1),
u AS (SELECT {KEY} AS key, trim(name) AS spelling, * FROM lk WHERE NOT regexp_matches(trim(name), '(?i)^speaker\\s*\\d+$')),
n AS (SELECT key, arg_min(spelling, row(-epoch(date), meeting_id, speaker)) AS spelling, max(date) AS newest, count(DISTINCT meeting_id) AS meetings FROM u GROUP BY key)
SELECT coalesce(p.person_id, substring(sha256(n.key), 1, 16)) AS person_id, coalesce(p.name, n.spelling) AS name, CAST(greatest(p.used, n.newest) AS VARCHAR) AS last_used, coalesce(meetings, 0) AS meetings, p.key IS NULL AS created
FROM n FULL JOIN p ON p.key = n.key"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    meetings = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("meeting_id"), F.col("o_orderdate").cast("date").alias("date"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"))
    return O.usage(order_links(spark, sf_dir).select("meeting_id", "person_id"), meetings).withColumn("newest", F.col("newest").cast("string"))


USAGE = f"""WITH {LINKS} SELECT person_id, count(*) AS meetings, CAST(max(date) AS VARCHAR) AS newest, arg_max('Order ' || meeting_id, row(date, meeting_id)) AS title FROM lk WHERE person_id IS NOT NULL GROUP BY ALL"""


def homonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.homonyms(directory(spark, sf_dir))


HOMONYMS = f"WITH {PEOPLE}, k AS (SELECT *, count(*) OVER (PARTITION BY {KEY}) AS same FROM pp) SELECT person_id, name, same FROM k WHERE same > 1"


def name_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as questions; the benchmark texts' first two words as names."""
    names = A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("person_id"), F.regexp_extract("text", r"^([A-Za-z]+)\s+([A-Za-z]+)", 0).alias("name"))
    asked = A.spread(A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query")))
    return O.mentioned(asked, names)


MENTIONS = r"""WITH n AS (SELECT item_id AS person_id, trim(regexp_replace(lower(regexp_extract(text, '^([A-Za-z]+)\s+([A-Za-z]+)', 0)), '\s+', ' ', 'g')) AS k FROM benchmark),
q AS (SELECT doc_id AS query_id, ' ' || regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g') || ' ' AS q FROM documents)
SELECT DISTINCT query_id, person_id FROM q JOIN n ON contains(q, ' ' || k || ' ') WHERE k <> ''"""


def exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.vectors(spark, sf_dir).withColumn("seconds", (1 + F.col("vec_id") % 50).cast("double"))


def voice_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = O.voices(exemplars(spark, sf_dir), ["person"], A.DIMS)
    return found.select("person", "seconds", "exemplars", F.posexplode("vector").alias("dim", "x")).withColumn("x", F.round("x", 6))


CENTROIDS = f"""WITH {A.VECTORS}, e AS (SELECT person, 1.0::DOUBLE + vec_id % 50 AS s, vector, sqrt(list_dot_product(vector, vector)) AS l FROM vecs),
d AS (SELECT person, s, l, unnest(vector) AS v, unnest(range(64)) AS dim FROM e), m AS (SELECT person, dim, sum(s * v / l) AS x FROM d GROUP BY ALL),
t AS (SELECT person, sqrt(sum(x * x)) AS t FROM m GROUP BY ALL), c AS (SELECT person, sum(s) AS seconds, count(*) AS exemplars FROM e GROUP BY ALL)
SELECT m.person, c.seconds, c.exemplars, CAST(m.dim AS INT) AS dim, round(x / t, 6) AS x FROM m JOIN t ON t.person = m.person JOIN c ON c.person = m.person"""


def voice_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a speaker of its meeting, against the voices of the labels."""
    people = O.voices(exemplars(spark, sf_dir), ["person"], A.DIMS).select("person", "vector")
    speakers = A.vectors(spark, sf_dir).select("meeting_id", F.col("vec_id").alias("speaker"), "vector")
    return O.suggested(speakers, people, A.DIMS, low=0.05, high=0.2, margin=0.01).withColumn("score", F.round("score", 6))


def exemplar_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.newest(A.vectors(spark, sf_dir).select("person", "meeting_id", "vec_id"), ["person", "meeting_id"], [F.desc("vec_id")], 3).select("person", "meeting_id", "vec_id")


EXEMPLAR_CAP = f"WITH {A.VECTORS}, r AS (SELECT *, row_number() OVER (PARTITION BY person, meeting_id ORDER BY vec_id DESC) AS r FROM vecs) SELECT person, meeting_id, vec_id FROM r WHERE r <= 3"


def keep_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 20 events of a user that say something."""
    rows = A.table(spark, sf_dir, "events").where("event_type <> 'error'").select("user_id", "event_id", "ts")
    return O.newest(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")], 20).select("user_id", "event_id")


KEEP = "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type <> 'error') SELECT user_id, event_id FROM r WHERE r <= 20"


def person_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one nation and segment merged into the first."""
    rows = A.table(spark, sf_dir, "customer")
    people = rows.select(F.col("c_custkey").alias("person_id"), F.concat(F.lit("N"), (F.col("c_custkey") % 50).cast("string")).alias("name"), F.array(F.col("c_mktsegment")).alias("aliases"), F.col("c_custkey").alias("created"), (F.col("c_custkey") * 2).alias("last_used"))
    first = F.min("c_custkey").over(Window.partitionBy("c_nationkey", "c_mktsegment"))
    merges = rows.select(F.col("c_custkey").alias("from_id"), first.alias("into_id")).where("from_id <> into_id")
    return O.merged(people, merges).withColumn("aliases", F.array_join("aliases", "|"))


MERGE = """WITH p AS (SELECT c_custkey AS id, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS k, 'N' || (c_custkey % 50) AS name, c_mktsegment AS seg FROM customer),
a AS (SELECT k, id, name AS a, 0 AS o FROM p UNION ALL SELECT k, id, seg, 1 FROM p),
d AS (SELECT k, a, min(row(id, o)) AS f FROM a GROUP BY ALL), n AS (SELECT k, arg_min(name, id) AS name, min(id) AS created, max(id) * 2 AS last_used FROM p GROUP BY ALL)
SELECT n.k AS person_id, n.name, coalesce(string_agg(d.a, '|' ORDER BY d.f), '') AS aliases, created, last_used FROM n LEFT JOIN d ON d.k = n.k AND d.a <> n.name GROUP BY ALL"""


def meetings_by_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person's meetings, the newest first, numbered."""
    each = order_links(spark, sf_dir).where("person_id is not null").select("person_id", "meeting_id", "date").distinct()
    n = F.row_number().over(Window.partitionBy("person_id").orderBy(F.desc("date"), "meeting_id"))
    return each.select("person_id", n.alias("n"), "meeting_id")


BY_PERSON = f"WITH {LINKS} SELECT person_id, row_number() OVER (PARTITION BY person_id ORDER BY date DESC, meeting_id) AS n, meeting_id FROM (SELECT DISTINCT person_id, meeting_id, date FROM lk WHERE person_id IS NOT NULL)"


def email_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses made of customers' names, some of them no addresses, with their keys."""
    k = F.col("c_custkey") % 5
    address = F.when(k == 0, F.concat("c_name", F.lit("@Example.COM"))).when(k == 1, F.concat(F.lit("."), "c_name", F.lit("@x.org"))).when(k == 2, F.concat("c_name", F.lit("@host"))).when(k == 3, F.concat(F.lit("a b@"), F.lit("x.org"))).otherwise(F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@Mail.x.org")))
    rows = A.table(spark, sf_dir, "customer").select("c_custkey", address.alias("address"))
    return rows.withColumn("valid", X.is_email(F.col("address"))).withColumn("key", F.when(F.col("valid"), X.email_key(F.col("address"))))


EMAILS = """WITH a AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_name || '@Example.COM' WHEN 1 THEN '.' || c_name || '@x.org' WHEN 2 THEN c_name || '@host' WHEN 3 THEN 'a b@x.org' ELSE 'u' || c_custkey || '@Mail.x.org' END AS address FROM customer)
SELECT c_custkey, address, c_custkey % 5 IN (0, 4) AS valid, CASE WHEN c_custkey % 5 IN (0, 4) THEN split_part(address, '@', 1) || '@' || lower(split_part(address, '@', 2)) END AS key FROM a"""


def library_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.days(A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("meeting_id"), F.col("o_orderdate").alias("date"), (F.col("o_orderstatus") == "F").alias("done"))).withColumn("day", F.col("day").cast("string"))


DAYS = "SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, count(*) AS meetings, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, max(o_orderkey) AS last_meeting FROM orders GROUP BY ALL"


def no_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as meetings, with whether anyone says anything."""
    return L.speech(A.lines(spark, sf_dir))


SPEECH = rf"""WITH {A.LINES} SELECT meeting_id, bool_or(regexp_matches(regexp_replace(text, '\[[A-Za-z][A-Za-z _-]*\]', '', 'g'), '[\p{{L}}\p{{N}}]')) AS has_speech FROM lines GROUP BY ALL"""


def finalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as finished recordings: their titles, notes and states."""
    rows = A.table(spark, sf_dir, "orders")
    meetings = rows.select(
        F.col("o_orderkey").alias("meeting_id"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderpriority")).alias("source_title"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("About "), "o_orderstatus")).alias("generated_title"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit("The first line of a meeting, whole")).alias("first_line"), (F.col("o_orderkey") % 7 != 0).alias("has_speech"), F.lit("notes").alias("notes"),
    )
    return L.finalised(meetings)


FINALISE = """SELECT o_orderkey AS meeting_id, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 0 THEN 'About ' || o_orderstatus WHEN o_orderkey % 2 = 0 THEN trim(substring('The first line of a meeting, whole', 1, 20)) ELSE 'Meeting' END AS title,
CASE WHEN o_orderkey % 7 <> 0 THEN 'notes' END AS notes, CASE WHEN o_orderkey % 7 <> 0 THEN 'done' ELSE 'no speech' END AS status FROM orders"""


def finish_reruns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs that are new, write a summary again, or a transcript; half of the customers' meetings are stored, some under a title that was
    changed while the run was on."""
    k = F.col("o_orderkey")
    rows = A.table(spark, sf_dir, "orders")
    kind = F.get(F.array(F.lit("new"), F.lit("summary"), F.lit("transcript")), (k % 3).cast("int"))
    runs = rows.select(
        k.alias("meeting_id"), kind.alias("kind"), F.when(k % 5 == 0, F.col("o_orderpriority")).when(k % 5 == 1, "").alias("source_title"), F.when(k % 4 == 0, F.concat(F.lit("About "), "o_orderstatus")).when(k % 4 == 1, "").alias("generated_title"),
        F.when(k % 2 == 0, F.lit("The first line of a meeting, whole")).alias("first_line"), F.when(k % 11 == 0, "No notes").when(k % 11 == 1, "").otherwise(F.concat(F.lit("For "), "o_orderpriority")).alias("summary"), F.lit("notes").alias("notes"), F.lit("m1").alias("reader"), (k % 7 != 0).alias("has_speech"),
    )
    stored = rows.where("o_custkey % 2 = 0").select(k.alias("meeting_id"), F.concat(F.lit("Title "), (k % 3 + F.when(k % 8 == 0, 1).otherwise(0)).cast("string")).alias("title"), (k % 10 != 0).alias("named"))
    return L.finished(runs, stored, rows.select(k.alias("meeting_id"), F.concat(F.lit("Title "), (k % 3).cast("string")).alias("title")))


FINISH = """WITH o AS (SELECT *, o_orderkey AS k, o_orderkey % 7 <> 0 AS sp, o_custkey % 2 = 0 AS st, CASE o_orderkey % 11 WHEN 0 THEN 'No notes' WHEN 1 THEN '' ELSE 'For ' || o_orderpriority END AS su FROM orders),
s AS (SELECT *, CASE WHEN NOT sp AND su IN ('', 'No notes') THEN 'No speech' ELSE su END AS s2 FROM o)
SELECT k AS meeting_id, CASE WHEN k % 3 = 1 AND st AND k % 8 = 0 THEN 'Title 2' WHEN k % 5 = 0 THEN o_orderpriority WHEN NOT sp THEN 'No speech' WHEN k % 4 = 0 THEN 'About ' || o_orderstatus WHEN k % 2 = 0 THEN 'The first line of a ' ELSE 'Meeting' END AS title,
  s2 AS summary, CASE WHEN sp THEN 'notes' END AS notes, CASE WHEN sp AND s2 <> '' THEN 'm1' END AS reader, CASE WHEN k % 3 = 1 AND st THEN 'stored' ELSE 'run' END AS lines_from,
  CASE WHEN k % 3 = 1 AND st THEN 'stored' WHEN k % 3 = 2 AND st AND k % 10 <> 0 AND k % 2 = 0 THEN 'carried' ELSE 'run' END AS names_from FROM s"""


def upsert_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items after updates of their orders and deletions of cancelled ones: child rows go with their meeting."""
    orders = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("meeting_id"), F.col("o_totalprice").alias("value"), F.lit(0).alias("version"))
    updates = orders.where("meeting_id % 4 = 0").withColumn("value", F.col("value") * 2).withColumn("version", F.lit(1))
    gone = orders.where("meeting_id % 9 = 0").select("meeting_id")
    kept = L.upserted(orders, updates, gone)
    items = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("meeting_id"), "l_linenumber")
    children = L.cascaded(items, gone).groupBy("meeting_id").agg(F.count("*").alias("children"))
    return kept.join(children, "meeting_id", "left").select("meeting_id", F.round("value", 2).alias("value"), "version", F.coalesce("children", F.lit(0)).alias("children"))


UPSERT = """WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT o_orderkey AS meeting_id, round(CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice * 2 ELSE o_totalprice END, 2) AS value, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS version, coalesce(c.n, 0) AS children
FROM orders LEFT JOIN c ON c.l_orderkey = o_orderkey WHERE o_orderkey % 9 <> 0"""

QUERIES = {
    "link_resolve": (link_resolve, RESOLVE),
    "entity_bootstrap": (entity_bootstrap, BOOTSTRAP),
    "usage": (usage, USAGE),
    "homonyms": (homonyms, HOMONYMS),
    "name_mentions": (name_mentions, MENTIONS),
    "voice_centroids": (voice_centroids, CENTROIDS),
    "voice_suggest": (voice_suggest, None),
    "exemplar_cap": (exemplar_cap, EXEMPLAR_CAP),
    "keep_last_n": (keep_last_n, KEEP),
    "person_merge": (person_merge, MERGE),
    "meetings_by_person": (meetings_by_person, BY_PERSON),
    "email_rules": (email_rules, EMAILS),
    "library_days": (library_days, DAYS),
    "no_speech": (no_speech, SPEECH),
    "finalise": (finalise, FINALISE),
    "finish_reruns": (finish_reruns, FINISH),
    "upsert_cascade": (upsert_cascade, UPSERT),
}
