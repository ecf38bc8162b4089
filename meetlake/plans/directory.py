"""Registered queries of the directory: its log of edits, and the voices that follow it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meetlake.operators import directory as D
from meetlake.operators import voice as V
from meetlake.plans import adapters as A

#: Kinds of edits by an event's number modulo 13; every tenth of the last kind deletes somebody instead.
KINDS = ("create", "rename", "note", "touch", "voice_on", "voice_off", "email_add", "email_add", "email_remove", "email_default", "contact_link", "contact_unlink", "me")


def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as edits of 150 people and of those that are made on the way."""
    n, user = F.col("event_id"), F.col("user_id")
    kind = F.when((n % 130 == 12), "delete").otherwise(F.get(F.array(*map(F.lit, KINDS)), (n % 13).cast("int")))
    person = F.when(n % 13 == 0, F.concat(F.lit("n"), n.cast("string"))).when(n % 5 == 0, F.concat(F.lit("n"), (n - n % 13 - 13 * (user % 7)).cast("string"))).otherwise(F.concat(F.lit("c"), (user % 150 + 1).cast("string")))
    number = F.floor(n / 13).cast("long")
    address = F.when(n % 39 == 6, "bad@host").when(n % 2 == 0, F.concat(F.lit(" u"), (number % 3).cast("string"), F.lit("@Host.org"))).otherwise(F.concat(F.lit("u"), (number % 3).cast("string"), F.lit("@hOST.ORG")))
    value = F.when(kind.isin("create", "rename"), F.when(number % 9 == 0, "  ").otherwise(F.concat(F.lit(" Name "), (number % 5).cast("string")))).when(kind == "note", F.when(number % 4 == 0, " ").otherwise(F.concat(F.lit("note "), number.cast("string"))))
    value = value.when(F.startswith(kind, F.lit("email")), address).when((kind == "contact_link") & (number % 2 == 0), address)
    emails = F.array(F.concat(F.lit("u"), (number % 4).cast("string"), F.lit("@host.org")), F.lit("not an address"), F.concat(F.lit("p"), (number % 6).cast("string"), F.lit("@x.io")))
    contact = F.when(kind == "contact_link", F.struct(F.lit("ios").alias("platform"), F.when(number % 5 != 0, F.concat(F.lit("k"), number.cast("string"))).alias("key"), F.lit(" Full Name ").alias("name"), F.when(number % 3 == 0, F.concat(F.lit("Org "), number.cast("string"))).alias("org"), emails.alias("emails")))
    flag = F.when(n % 13 == 7, True).when(kind == "contact_unlink", number % 2 == 0).when(kind == "create", number % 11 == 0).otherwise(False)
    return A.table(spark, sf_dir, "events").select(person.alias("person_id"), n.alias("seq"), (n * 10).alias("at"), kind.alias("kind"), value.alias("value"), flag.alias("flag"), contact.alias("contact"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    emails = F.when(k % 3 == 0, F.array(F.struct(F.lit("u1@host.org").alias("address"), F.lit("contact").alias("from")))).otherwise(F.array().cast("array<struct<address:string,from:string>>"))
    return A.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), k.cast("string")).alias("person_id"), F.col("c_name").alias("name"), F.when(k % 4 == 0, "old note").alias("note"), F.array(F.lit("Name 1"), F.col("c_mktsegment")).alias("aliases"), k.cast("long").alias("created"),
        (k * 100).cast("long").alias("last_used"), (k % 6 != 0).alias("voice_enabled"), (k == 7).alias("me"), emails.alias("emails"), F.lit(None).cast("struct<platform:string,key:string,name:string,org:string,linked:long>").alias("contact"),
    )


def directory_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory after its log; lists and contacts as texts."""
    found = D.directory_after(people(spark, sf_dir), edit_log(spark, sf_dir))
    emails = F.array_join(F.transform("emails", lambda e: F.concat(e["address"], F.lit("/"), e["from"])), "|")
    contact = F.concat_ws("|", "contact.platform", "contact.key", "contact.name", F.coalesce("contact.org", F.lit("-")), F.col("contact.linked").cast("string"))
    return found.withColumn("emails", emails).withColumn("contact", F.when(F.col("contact").isNotNull(), contact)).withColumn("aliases", F.array_join("aliases", "|"))


LOG = """WITH RECURSIVE e0 AS (SELECT event_id AS n, user_id AS u, event_id // 13 AS q, CASE WHEN event_id % 130 = 12 THEN 'delete' ELSE ['create', 'rename', 'note', 'touch', 'voice_on', 'voice_off', 'email_add', 'email_add', 'email_remove', 'email_default', 'contact_link', 'contact_unlink', 'me'][CAST(event_id % 13 AS INT) + 1] END AS kind FROM events),
e AS (SELECT n AS seq, n * 10 AS at_, kind, q, CASE WHEN n % 13 = 0 THEN 'n' || n WHEN n % 5 = 0 THEN 'n' || (n - n % 13 - 13 * (u % 7)) ELSE 'c' || (u % 150 + 1) END AS p,
  CASE WHEN n % 39 = 6 THEN 'bad@host' WHEN n % 2 = 0 THEN 'u' || (q % 3) || '@Host.org' ELSE 'u' || (q % 3) || '@hOST.ORG' END AS address,
  CASE WHEN q % 9 <> 0 THEN 'Name ' || (q % 5) END AS name, CASE WHEN q % 4 <> 0 THEN 'note ' || q END AS note,
  CASE WHEN n % 13 = 7 THEN true WHEN kind = 'contact_unlink' THEN q % 2 = 0 WHEN kind = 'create' THEN q % 11 = 0 ELSE false END AS flag FROM e0),
base AS (SELECT 'c' || c_custkey AS p, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN 'old note' END AS note, ['Name 1', c_mktsegment] AS aliases, CAST(c_custkey AS BIGINT) AS created, CAST(c_custkey * 100 AS BIGINT) AS last_used, c_custkey % 6 <> 0 AS voice, c_custkey = 7 AS me,
  CASE WHEN c_custkey % 3 = 0 THEN [{'a': 'u1@host.org', 'f': 'contact', 'k': 'u1@host.org'}] ELSE [] END AS emails, NULL::BIGINT AS born FROM customer
  UNION ALL SELECT p, name, NULL, [], at_, at_, true, flag, [], seq FROM e WHERE kind = 'create' AND name IS NOT NULL),
gone AS (SELECT p, max(seq) AS g FROM e WHERE kind = 'delete' GROUP BY p),
b AS (SELECT base.* FROM base LEFT JOIN gone ON gone.p = base.p WHERE g IS NULL OR g < born),
m AS (SELECT e.* FROM e JOIN b ON b.p = e.p WHERE born IS NULL OR seq > born),
w AS (SELECT p, arg_max(name, seq) FILTER (WHERE kind = 'rename' AND name IS NOT NULL) AS name, list(name) FILTER (WHERE kind = 'rename' AND name IS NOT NULL) AS names, arg_max(kind, seq) FILTER (WHERE kind IN ('voice_on', 'voice_off')) AS voice, max(at_) FILTER (WHERE kind = 'touch') AS t FROM m GROUP BY p),
st AS (SELECT p, seq, 0 AS sub, kind AS op, address AS a, flag, note, q, at_ FROM m WHERE kind IN ('note', 'email_remove', 'email_default', 'contact_unlink') OR (kind = 'email_add' AND address <> 'bad@host')
  UNION ALL SELECT p, seq, 0, 'email_contact', address, flag, NULL, q, at_ FROM m WHERE kind = 'contact_link' AND q % 2 = 0 AND address <> 'bad@host'
  UNION ALL SELECT p, seq, 1, 'email_contact', 'u' || (q % 4) || '@host.org', flag, NULL, q, at_ FROM m WHERE kind = 'contact_link'
  UNION ALL SELECT p, seq, 2, 'email_contact', 'p' || (q % 6) || '@x.io', flag, NULL, q, at_ FROM m WHERE kind = 'contact_link'
  UNION ALL SELECT p, seq, 3, 'contact_link', NULL, flag, NULL, q, at_ FROM m WHERE kind = 'contact_link'),
s AS (SELECT *, lower(a) AS k, row_number() OVER (PARTITION BY p ORDER BY seq, sub) AS i FROM st),
r AS (SELECT p, 0::BIGINT AS i, note, emails, NULL::VARCHAR AS contact FROM b
  UNION ALL SELECT r.p, s.i,
    CASE WHEN op = 'note' THEN s.note WHEN op = 'contact_link' AND r.note IS NULL AND q % 3 = 0 THEN 'Org ' || q ELSE r.note END,
    CASE WHEN op IN ('email_add', 'email_contact') THEN CASE WHEN (op = 'email_add' AND flag) OR len(emails) = 0 THEN list_concat([coalesce(list_filter(emails, lambda x: x.k = s.k)[1], {'a': s.a, 'f': CASE op WHEN 'email_contact' THEN 'contact' ELSE 'user' END, 'k': s.k})], list_filter(emails, lambda x: x.k <> s.k))
        WHEN len(list_filter(emails, lambda x: x.k = s.k)) > 0 THEN emails ELSE list_concat(emails, [{'a': s.a, 'f': CASE op WHEN 'email_contact' THEN 'contact' ELSE 'user' END, 'k': s.k}]) END
      WHEN op = 'email_remove' THEN list_filter(emails, lambda x: x.k <> s.k) WHEN op = 'email_default' THEN list_concat(list_filter(emails, lambda x: x.k = s.k), list_filter(emails, lambda x: x.k <> s.k))
      WHEN op = 'contact_unlink' THEN CASE WHEN flag THEN list_filter(emails, lambda x: x.f <> 'contact') ELSE list_transform(emails, lambda x: {'a': x.a, 'f': 'user', 'k': x.k}) END ELSE emails END,
    CASE WHEN op = 'contact_link' AND q % 5 <> 0 THEN 'ios|k' || q || '|Full Name|' || CASE q % 3 WHEN 0 THEN 'Org ' || q ELSE '-' END || '|' || at_ WHEN op = 'contact_unlink' THEN NULL ELSE contact END
  FROM r JOIN s ON s.p = r.p AND s.i = r.i + 1),
f AS (SELECT p, arg_max(row(note, emails, contact), i) AS z FROM r GROUP BY p),
mine AS (SELECT arg_max(p, seq) AS p, max(seq) AS seq FROM e WHERE kind = 'me')
SELECT b.p AS person_id, coalesce(w.name, b.name) AS name, z[1] AS note, array_to_string(list_filter(aliases, lambda x: NOT coalesce(list_contains(w.names, x), false)), '|') AS aliases, created, greatest(last_used, coalesce(w.t, last_used)) AS last_used,
  coalesce(w.voice = 'voice_on', b.voice) AS voice_enabled, CASE WHEN (SELECT seq FROM mine) IS NULL OR coalesce(born > (SELECT seq FROM mine), false) THEN me ELSE b.p = (SELECT p FROM mine) END AS me,
  array_to_string(list_transform(z[2], lambda x: x.a || '/' || x.f), '|') AS emails, z[3] AS contact
FROM b LEFT JOIN w ON w.p = b.p JOIN f ON f.p = b.p"""


def exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as what speakers sound like; every ninth isn't confirmed."""
    rows = A.vectors(spark, sf_dir).withColumn("seconds", (1 + F.col("vec_id") % 50).cast("double")).withColumn("confirmed", F.col("vec_id") % 9 != 0)
    return rows.select("person", "meeting_id", F.col("vec_id").alias("speaker"), "seconds", "confirmed", "vector")


def exemplar_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers of all meetings, linked to people of whom every third isn't learned; every seventh is linked to another person than before, and every fourth
    vector was an exemplar, one for each person and meeting."""
    rows = exemplars(spark, sf_dir)
    before = rows.where("speaker % 4 = 0").groupBy("person", "meeting_id").agg(F.max_by(F.struct("speaker", "seconds", "confirmed", "vector"), "speaker").alias("e")).select("person", "meeting_id", "e.*")
    links = rows.where("speaker % 11 <> 0").select("meeting_id", "speaker", F.when(F.col("speaker") % 7 == 0, (F.col("person") + 1) % 10).otherwise(F.col("person")).alias("person"))
    who = rows.select("person").distinct().withColumn("voice_enabled", F.col("person") % 3 != 0)
    return V.synced(links, who, rows.select("meeting_id", "speaker", "seconds", "vector"), before, outlier=0.35).drop("vector")


SYNC = f"""WITH {A.VECTORS}, x AS (SELECT person AS p, meeting_id AS m, vec_id AS s, 1.0::DOUBLE + vec_id % 50 AS t, vec_id % 9 <> 0 AS c, vector AS v FROM vecs),
old AS (SELECT * FROM x WHERE s % 4 = 0 QUALIFY row_number() OVER (PARTITION BY p, m ORDER BY s DESC) = 1),
lk AS (SELECT m, s, CASE WHEN s % 7 = 0 THEN (p + 1) % 10 ELSE p END AS p FROM x WHERE s % 11 <> 0),
stay AS (SELECT old.* FROM old JOIN lk ON lk.m = old.m AND lk.s = old.s AND lk.p = old.p),
el AS (SELECT old.* FROM old WHERE m NOT IN (SELECT m FROM lk)),
wa AS (SELECT lk.p, lk.m, lk.s, x.t, x.v FROM lk JOIN x ON x.m = lk.m AND x.s = lk.s WHERE lk.p % 3 <> 0 AND lk.p IN (SELECT p FROM x) AND x.t >= 10),
one AS (SELECT p, m, arg_min(v, s) AS v1, max(s) AS s, arg_max(t, s) AS t FROM wa GROUP BY ALL),
u AS (SELECT p, m, d, t * val / CASE WHEN l > 0 THEN l ELSE 1 END AS y FROM (SELECT p, m, t, sqrt(list_dot_product(v, v)) AS l, unnest(v) AS val, unnest(range(64)) AS d FROM old WHERE c)),
ce AS (SELECT one.p, one.m, u.d, sum(u.y) AS y FROM one JOIN u ON u.p = one.p AND u.m <> one.m GROUP BY ALL), cl AS (SELECT p, m, list(y ORDER BY d) AS y FROM ce GROUP BY ALL),
put AS (SELECT one.p, one.m, one.s, one.t, coalesce((SELECT bool_and(c) FROM stay WHERE stay.p = one.p AND stay.m = one.m), cl.y IS NULL OR round(list_dot_product(v1, y) / sqrt(list_dot_product(v1, v1) * list_dot_product(y, y)), 9) >= 0.35) AS c
  FROM one LEFT JOIN cl ON cl.p = one.p AND cl.m = one.m)
SELECT p AS person, m AS meeting_id, s AS speaker, t AS seconds, c AS confirmed FROM put UNION ALL SELECT p, m, s, t, c FROM el
UNION ALL SELECT p, m, s, t, c FROM stay WHERE NOT EXISTS (SELECT 1 FROM put WHERE put.p = stay.p AND put.m = stay.m)"""


def exemplar_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as edits of thirty meetings and ten people that exemplars follow; a person's exemplars may move several times."""
    rows = exemplars(spark, sf_dir)
    n = F.col("event_id")
    kind = F.when(n % 97 == 0, "remove").when(n % 61 == 0, "move")
    edits = A.table(spark, sf_dir, "events").where(kind.isNotNull()).select(
        n.alias("seq"), kind.alias("kind"), F.when(n % 5 != 0, F.col("user_id") % 10).alias("person"), F.when((n % 3 != 0) | (kind == "remove"), F.col("user_id") % 20).alias("meeting_id"), F.when(kind == "move", (n % 10)).alias("to")
    ).where("person is not null or (kind = 'remove' and meeting_id is not null)")
    return V.followed(rows.withColumn("person", F.col("person").cast("long")), edits).select("speaker", "meeting_id", "person")


MOVES = """WITH RECURSIVE e AS (SELECT event_id AS seq, CASE WHEN event_id % 97 = 0 THEN 'remove' WHEN event_id % 61 = 0 THEN 'move' END AS kind, CASE WHEN event_id % 5 <> 0 THEN user_id % 10 END AS p, CASE WHEN event_id % 3 <> 0 OR event_id % 97 = 0 THEN user_id % 20 END AS m, event_id % 10 AS t FROM events),
d AS (SELECT * FROM e WHERE kind IS NOT NULL AND (p IS NOT NULL OR (kind = 'remove' AND m IS NOT NULL))),
o AS (SELECT *, row_number() OVER (ORDER BY seq) AS i FROM d),
r AS (SELECT vec_id AS s, vec_id % 20 AS m, CAST(label AS BIGINT) AS p, 0::BIGINT AS i, false AS gone FROM embeddings
  UNION ALL SELECT r.s, r.m, CASE WHEN hit AND o.kind = 'move' THEN o.t ELSE r.p END, o.i, r.gone OR (hit AND o.kind = 'remove')
  FROM r JOIN o ON o.i = r.i + 1, LATERAL (SELECT NOT r.gone AND (o.p IS NULL OR o.p = r.p) AND (o.m IS NULL OR o.m = r.m) AS hit) h)
SELECT s AS speaker, m AS meeting_id, p AS person FROM r WHERE i = (SELECT count(*) FROM o) AND NOT gone"""

QUERIES = {
    "directory_log": (directory_log, LOG),
    "exemplar_sync": (exemplar_sync, SYNC),
    "exemplar_moves": (exemplar_moves, MOVES),
}
