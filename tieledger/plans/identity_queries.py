"""Evidence, the manifest, fuzzy names and what else identity needs, over the given tables.

The similarity of names is written out in SQL: greedy matches of letters within the window, one letter a step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieledger.functions.names import fuzzy_score, name_ratio
from tieledger.operators import graph, identity, metrics
from tieledger.plans.registry import Registry, joined, r6, us
from tieledger.plans.source_queries import _AUTO, _LOCAL, _PHONED, _SUB, _TOKEN  # noqa: F401
from tieledger.sources.tables import cut

Q = Registry()


def fuzzy_sql(pairs: str) -> str:
    """CTEs over ``pairs``, a SELECT of distinct (na, nb), that end with scored(na, nb, score)."""
    return f"""
fz AS ({pairs}),
fp AS (SELECT na, nb, trim(regexp_replace(lower(strip_accents(na)), '[^a-z0-9]+', ' ', 'g')) AS x, trim(regexp_replace(lower(strip_accents(nb)), '[^a-z0-9]+', ' ', 'g')) AS y FROM fz),
ft AS (SELECT *, list_distinct(string_split(x, ' ')) AS ta, list_distinct(string_split(y, ' ')) AS tb FROM fp),
fs AS (SELECT *, list_sort(list_intersect(ta, tb)) AS co, list_sort(list_filter(ta, lambda t: NOT list_contains(tb, t))) AS oa, list_sort(list_filter(tb, lambda t: NOT list_contains(ta, t))) AS ob FROM ft),
fj AS (SELECT *, array_to_string(co, ' ') AS s1, array_to_string(list_concat(co, oa), ' ') AS s2, array_to_string(list_concat(co, ob), ' ') AS s3 FROM fs),
ji AS (SELECT DISTINCT a, b FROM (SELECT x AS a, y AS b FROM fj UNION ALL SELECT s1, s2 FROM fj UNION ALL SELECT s1, s3 FROM fj UNION ALL SELECT s2, s3 FROM fj) WHERE a <> '' AND b <> '' AND a <> b),
js AS (SELECT a, b, 0 AS i, b AS free, '' AS got, cast([] AS int[]) AS places FROM ji
 UNION ALL SELECT a, b, i + 1, CASE WHEN p > 0 THEN substr(free, 1, lo + p - 1) || chr(1) || substr(free, lo + p + 1) ELSE free END, CASE WHEN p > 0 THEN got || substr(a, i + 1, 1) ELSE got END, CASE WHEN p > 0 THEN list_append(places, cast(lo + p AS int)) ELSE places END
 FROM (SELECT *, cast(instr(substr(free, lo + 1, hi - lo), substr(a, i + 1, 1)) AS int) AS p FROM (SELECT *, cast(greatest(0, i - w) AS int) AS lo, cast(least(length(b), i + w + 1) AS int) AS hi FROM (SELECT *, greatest(0, greatest(length(a), length(b)) // 2 - 1) AS w FROM js WHERE i < length(a))))),
jd AS (SELECT a, b, length(got) AS n, len(list_filter(range(1, length(got) + 1), lambda k: substr(got, k, 1) <> substr(b, list_sort(places)[k], 1))) AS swapped,
 CASE WHEN substr(a, 1, 1) <> substr(b, 1, 1) THEN 0 WHEN substr(a, 2, 1) <> substr(b, 2, 1) OR least(length(a), length(b)) < 2 THEN 1 WHEN substr(a, 3, 1) <> substr(b, 3, 1) OR least(length(a), length(b)) < 3 THEN 2 WHEN substr(a, 4, 1) <> substr(b, 4, 1) OR least(length(a), length(b)) < 4 THEN 3 ELSE 4 END AS pre FROM js WHERE i = length(a)),
jq AS (SELECT a, b, pre, CASE WHEN n = 0 THEN 0.0::double ELSE (n::double / length(a) + n::double / length(b) + (n - swapped / 2.0::double) / n) / 3 END AS jaro FROM jd),
jw AS (SELECT a, b, jaro + pre * 0.1::double * (1 - jaro) AS s FROM jq),
scored AS (SELECT na, nb, round(greatest(CASE WHEN x = y THEN 1.0 ELSE coalesce(j1.s, 0) END, CASE WHEN s1 = s2 OR s1 = s3 OR s2 = s3 THEN 1.0 ELSE greatest(coalesce(j2.s, 0), coalesce(j3.s, 0), coalesce(j4.s, 0)) END) + 1e-12::double, 3) AS score FROM fj
 LEFT JOIN jw j1 ON j1.a = x AND j1.b = y LEFT JOIN jw j2 ON j2.a = s1 AND j2.b = s2 LEFT JOIN jw j3 ON j3.a = s1 AND j3.b = s3 LEFT JOIN jw j4 ON j4.a = s2 AND j4.b = s3)"""


def recursive(ctes: str, final: str) -> str:
    return f"SELECT * FROM (WITH RECURSIVE {ctes} {final})"


# evidence


def shown(e: DataFrame) -> DataFrame:
    return e.select(joined("nodes"), "name", "name_source", "source", us("first_at"), us("last_at"), "thread_id", "group_name")


def _rows(nodes: str, source: str, name: str = "NULL", name_source: str = "NULL", first: str = "NULL", last: str = "NULL", thread: str = "NULL", group: str = "NULL") -> str:
    return f"SELECT {nodes} AS nodes, cast({name} AS varchar) AS name, cast({name_source} AS varchar) AS name_source, '{source}' AS source, cast({first} AS bigint) AS first_at, cast({last} AS bigint) AS last_at, cast({thread} AS varchar) AS thread_id, cast({group} AS varchar) AS group_name"


_LID = "split_part(split_part({j}, '@', 1), ':', 1)"
_E1 = f"""SELECT * FROM ({_rows("CASE WHEN jid LIKE '%@lid' THEN 'lid:' || " + _LID.replace('{j}', 'jid') + " || coalesce(',phone:' || contact_phone, '') ELSE 'phone:' || contact_phone END", 'wa_contact', 'named', "'wa_contact'")} FROM {_PHONED} WHERE jid NOT LIKE '%@lid' OR named IS NOT NULL OR contact_phone IS NOT NULL)"""
_E2 = _rows("'phone:+' || split_part(chat_jid, '@', 1)", "wa_dm", first="min(ts) * 1000000", last="max(ts) * 1000000", thread="chat_jid") + " FROM {wa_messages} WHERE chat_jid LIKE '%@s.whatsapp.net' GROUP BY chat_jid"
_E3 = f"""SELECT * FROM ({_rows("concat_ws(',', 'lid:' || lid, 'phone:+' || phone)", 'wa_group', "nullif(trim(sender_name), '')", "'wa_group_sender'", 'a * 1000000', 'b * 1000000', 'chat_jid', 'chat_name')} FROM (
 SELECT g.*, CASE WHEN lid IS NULL THEN split_part(sender_jid, '@', 1) ELSE m.pn END AS phone FROM (SELECT chat_jid, sender_jid, CASE WHEN sender_jid LIKE '%@lid' THEN {_LID.replace('{j}', 'sender_jid')} END AS lid, min(ts) AS a, max(ts) AS b, arg_max(sender_name, ts) FILTER (trim(sender_name) <> '') AS sender_name, max(chat_name) AS chat_name
  FROM {{wa_messages}} WHERE chat_jid LIKE '%@g.us' AND from_me = 0 GROUP BY 1, 2) g LEFT JOIN (SELECT lid AS l, pn FROM {{lid_map}}) m ON m.l = g.lid) WHERE phone IS NOT NULL OR coalesce(trim(sender_name), '') <> '')"""
_BOT = f"(regexp_matches(split_part({{e}}, '@', 1), '{_LOCAL}') OR regexp_matches(split_part({{e}}, '@', 1), '{_TOKEN}') OR regexp_matches(split_part({{e}}, '@', 2), '{_SUB}'))"
_E4 = f"""SELECT * FROM ({_rows("'email:' || email", 'X', 'name', 'via', 'epoch_us(sent_at)', 'epoch_us(sent_at)', "'mail:' || thread_id").replace("'X' AS source", 'via AS source')} FROM (
 SELECT thread_id, sent_at, replace(lower(from_email), '+x', '') AS email, from_name AS name, 'gmail_from' AS via FROM {{mail_people}} WHERE kind NOT IN (1, 4) AND from_email NOT LIKE 'no-reply%'
 UNION ALL SELECT thread_id, sent_at, to_email, NULL, 'gmail_to_cc' FROM {{mail_people}} WHERE kind NOT IN (1, 4) AND from_email NOT LIKE 'no-reply%'
 UNION ALL SELECT thread_id, sent_at, 'cc' || substr(thread_id, 3, 2) || '@post.test', 'Cc Person', 'gmail_to_cc' FROM {{mail_people}} WHERE kind = 2 AND from_email NOT LIKE 'no-reply%') WHERE email <> 'u.7@mail1.test')"""
_E5 = _rows("concat_ws(',', lower('email:' || email), 'phone:' || phone)", "google_contact", "nullif(name, '')", "'google_contact'") + " FROM {book}"


def mails(v) -> DataFrame:
    kind = F.col("kind")
    quoted_name = F.concat(F.lit('"'), "from_name", F.lit('" <'), "from_email", F.lit(">"))
    cc = F.concat(F.lit("Cc Person <cc"), F.substring("thread_id", 3, 2), F.lit("@post.test>"))
    heads = F.create_map(F.lit("from"), quoted_name, F.lit("to"), F.concat("to_email", F.lit(", broken entry")), F.when(kind == 1, "list-id").when(kind == 4, "precedence").otherwise("x-other"), F.lit("bulk"), F.when(kind == 2, "cc").otherwise("x-cc"), cc)
    return v("mail_people").select("thread_id", "sent_at", heads.alias("headers"))


def book(v) -> DataFrame:
    phones = F.array(F.concat(F.substring("phone", 1, 5), F.lit(" "), F.expr("substring(phone, 6)")))
    return v("book").select("name", phones.alias("phones"), F.array_compact(F.array("email")).alias("emails"))


#: What each channel's evidence is made of; each is built on its own, since that of mail is written in steps.
EVIDENCE = (
    lambda v: identity.evidence_contacts(v("contacts"), v("lid_map")),
    lambda v: identity.evidence_dms(v("wa_messages")),
    lambda v: identity.evidence_groups(v("wa_messages"), v("lid_map")),
    lambda v: identity.evidence_mail(mails(v), ["u.7@mail1.test"]),
    lambda v: identity.evidence_address_book(book(v)),
)


def evidence(v) -> list[DataFrame]:
    return [make(v) for make in EVIDENCE]


for _k, (_name, _sql) in enumerate([("evidence_contacts", _E1), ("evidence_direct_threads", _E2), ("evidence_groups", _E3), ("evidence_mail", _E4), ("evidence_address_book", _E5)]):

    @Q.add(_name, _sql)
    def _(v, k=_k):
        return shown(EVIDENCE[k](v))


#: All evidence, its nodes, and the component of each: the least node that links lead to.
_GRAPH = f"""ev AS ({_E1} UNION ALL {_E2} UNION ALL {_E3} UNION ALL {_E4} UNION ALL {_E5}),
nd AS (SELECT *, split_part(nodes, ',', 1) AS first FROM ev),
ed AS (SELECT DISTINCT first AS a, unnest(string_split(nodes, ',')) AS b FROM nd),
lk AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed{{more}}),
rc(a, b) AS (SELECT DISTINCT a, a FROM lk UNION SELECT rc.a, lk.b FROM rc JOIN lk ON lk.a = rc.b),
cm AS (SELECT a AS node, min(b) AS component FROM rc GROUP BY 1)"""
_BUCKETS = """bh AS (SELECT component, coalesce(string_agg(substr(node, 7), ',' ORDER BY node) FILTER (node LIKE 'phone:%'), '') AS phones, coalesce(string_agg(substr(node, 7), ',' ORDER BY node) FILTER (node LIKE 'email:%'), '') AS emails,
  coalesce(string_agg(substr(node, 5), ',' ORDER BY node) FILTER (node LIKE 'lid:%'), '') AS lids FROM {cm} GROUP BY 1),
pl AS (SELECT ev.*, c.component FROM (SELECT *, split_part(nodes, ',', 1) AS first FROM ev) ev JOIN {cm} c ON c.node = ev.first),
bs AS (SELECT component, coalesce(string_agg(DISTINCT CASE WHEN source = 'wa_group' THEN coalesce(group_name, thread_id) END, ',' ORDER BY CASE WHEN source = 'wa_group' THEN coalesce(group_name, thread_id) END), '') AS groups, min(first_at) AS first_seen, max(last_at) AS last_seen, count(DISTINCT thread_id) AS thread_count,
  bool_or(source IN ('wa_dm', 'wa_contact', 'wa_group', 'google_contact')) AS chat, bool_or(source IN ('gmail_from', 'gmail_to_cc')) AS mail, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM pl GROUP BY 1),
bn AS (SELECT component, name FROM (SELECT component, trim(name) AS name, row_number() OVER (PARTITION BY component ORDER BY CASE name_source WHEN 'wa_contact' THEN 1 WHEN 'google_contact' THEN 2 WHEN 'gmail_from' THEN 3 WHEN 'gmail_to_cc' THEN 4 WHEN 'wa_group_sender' THEN 5 ELSE 6 END, -length(trim(name)), trim(name)) AS n FROM pl WHERE trim(name) <> '') WHERE n = 1),
bk AS (SELECT bh.component AS min_node, phones, emails, lids, groups, first_seen, last_seen, thread_count, chat, mail, sources, name FROM bh LEFT JOIN bs USING (component) LEFT JOIN bn USING (component))"""


def all_evidence(v) -> DataFrame:
    return reduce(DataFrame.unionByName, evidence(v))


def buckets(v) -> DataFrame:
    """All evidence as one row per component; evidence and components are read several times, so both are written."""
    rows = cut(all_evidence(v))
    return identity.summarize_buckets(rows, cut(identity.node_components(rows)))


def bucket_columns(b: DataFrame) -> DataFrame:
    flags = F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in (*identity.CHAT, *identity.MAIL)]))), ",")
    return b.select("min_node", joined("phones"), joined("emails"), joined("lids"), joined("groups"), us("first_seen"), us("last_seen"), "thread_count", flags.alias("sources"), "name")


@Q.add("bucket_summary", recursive(_GRAPH.replace("{more}", "") + ", " + _BUCKETS.replace("{cm}", "cm"), "SELECT min_node, phones, emails, lids, groups, first_seen, last_seen, thread_count, sources, name FROM bk"))
def _(v):
    return bucket_columns(buckets(v))


#: Pairs of chat and mail buckets that may merge; then chat buckets in order take the best mail bucket that is free.
_TOKENS = "list_sort(list_distinct(string_split(trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', ' ', 'g')), ' ')))"
_BRIDGE = f"""sd AS (SELECT min_node, name, chat, {_TOKENS} AS t FROM {{bk}} WHERE name IS NOT NULL AND chat <> mail),
pr AS (SELECT c.min_node AS chat_node, m.min_node AS mail_node, c.name AS na, m.name AS nb, least(len(c.t), len(m.t)) AS short FROM sd c JOIN sd m ON c.chat AND NOT m.chat AND (len(list_intersect(c.t, m.t)) >= 2 OR least(len(c.t), len(m.t)) < 2)),
{fuzzy_sql('SELECT DISTINCT na, nb FROM pr')},
cd AS (SELECT chat_node, mail_node, score, dense_rank() OVER (ORDER BY chat_node) AS k FROM pr JOIN scored USING (na, nb) WHERE score >= CASE WHEN short >= 2 THEN 0.85 ELSE 0.92 END),
gr(k, used, chat_node, mail_node, score) AS (SELECT 0::bigint, cast([] AS varchar[]), NULL::varchar, NULL::varchar, NULL::double
 UNION ALL SELECT gr.k + 1, CASE WHEN b.mail_node IS NULL THEN used ELSE list_append(used, b.mail_node) END, b.chat_node, b.mail_node, b.score FROM gr LEFT JOIN LATERAL (SELECT c.chat_node, c.mail_node, c.score FROM cd c WHERE c.k = gr.k + 1 AND NOT list_contains(gr.used, c.mail_node) ORDER BY c.score DESC, c.mail_node LIMIT 1) b ON true WHERE gr.k < (SELECT max(k) FROM cd)),
br AS (SELECT chat_node, mail_node, score FROM gr WHERE chat_node IS NOT NULL)"""
_M1 = _GRAPH.replace("{more}", "") + ", " + _BUCKETS.replace("{cm}", "cm") + ", " + _BRIDGE.replace("{bk}", "bk")
_SECOND = """, l2 AS (SELECT component AS a, node AS b FROM cm UNION SELECT node, component FROM cm UNION SELECT chat_node, mail_node FROM br UNION SELECT mail_node, chat_node FROM br),
r2(a, b) AS (SELECT DISTINCT a, a FROM l2 UNION SELECT r2.a, l2.b FROM r2 JOIN l2 ON l2.a = r2.b), c2 AS (SELECT a AS node, min(b) AS component FROM r2 GROUP BY 1), """
_B2 = _BUCKETS.replace("{cm}", "c2").replace("bh AS", "bh2 AS").replace("pl AS", "pl2 AS").replace("bs AS", "bs2 AS").replace("bn AS", "bn2 AS").replace("bk AS", "bk2 AS").replace("FROM pl ", "FROM pl2 ").replace("FROM bh LEFT JOIN bs USING (component) LEFT JOIN bn", "FROM bh2 bh LEFT JOIN bs2 USING (component) LEFT JOIN bn2")


@Q.add("manifest", recursive(_M1 + _SECOND + _B2, "SELECT 'local-' || substr(sha1(min_node), 1, 12) AS id, min_node, phones, emails, lids, groups, thread_count, name FROM bk2 WHERE NOT list_contains(string_split(emails, ','), 'u.14@mail1.test') AND NOT list_contains(string_split(phones, ','), '+919000000003') AND coalesce(lower(name), '') <> 'customer#000000005'"))
def _(v):
    rows = identity.build_manifest(all_evidence(v), ["u.14@mail1.test"], ["+919000000003"], ["CUSTOMER#000000005"])
    return rows.select("id", "min_node", joined("phones"), joined("emails"), joined("lids"), joined("groups"), "thread_count", "name")


_FLAT = "SELECT *, split_part(nodes, ',', 1) AS node FROM ({e})"


@Q.add("self_removal", "SELECT cast(c_custkey AS varchar) AS min_node FROM {customer} WHERE c_custkey % 10 <> 3 AND c_custkey % 7 <> 2 AND lower(c_name) NOT LIKE '%5' AND c_custkey % 4 <> 1")
def _(v):
    key, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    buckets = v("customer").select(
        text.alias("min_node"), F.array(F.lit("x@x.test"), F.when(key % 10 == 3, "me@x.test").otherwise(F.concat(F.lit("u"), text))).alias("emails"), F.array(F.when(key % 7 == 2, "+1").otherwise(F.concat(F.lit("+9"), text))).alias("phones"),
        F.when(key % 4 == 1, "Me Myself").when(F.col("c_name").endswith("5"), "ME").otherwise(F.when(key % 6 != 0, F.col("c_name"))).alias("name"),
    )
    return identity.drop_self(buckets, ["me@x.test"], ["+1"], ["me myself", "Me"]).select("min_node")


@Q.add("stable_ids", "SELECT o_orderkey, 'local-' || substr(sha1('phone:+' || cast(o_custkey AS varchar)), 1, 12) AS id FROM {orders}")
def _(v):
    return v("orders").select("o_orderkey", identity.local_id(F.concat(F.lit("phone:+"), F.col("o_custkey").cast("string"))).alias("id"))


@Q.add("enrichment_preserved", """
SELECT b.min_node, CASE WHEN length(k.name) > coalesce(length(b.name), 0) THEN k.name ELSE b.name END AS name, k.person_id, k.category FROM (SELECT cast(s_suppkey AS varchar) AS min_node, CASE WHEN s_suppkey % 3 <> 0 THEN s_name END AS name, s_suppkey AS k FROM {supplier}) b
LEFT JOIN (SELECT b2.s_suppkey AS k, coalesce(max('C' || cast(c_custkey AS varchar)) FILTER (c_custkey = b2.s_suppkey), max('C' || cast(c_custkey AS varchar)) FILTER (c_custkey = b2.s_suppkey + 1)) AS person_id FROM {supplier} b2 JOIN {customer} c ON (c.c_custkey = b2.s_suppkey AND c.c_custkey % 2 = 0) OR (c.c_custkey = b2.s_suppkey + 1) GROUP BY 1) x ON x.k = b.k
LEFT JOIN (SELECT 'C' || cast(c_custkey AS varchar) AS person_id, CASE WHEN c_custkey % 5 = 0 THEN 'X' ELSE 'The long name ' || c_name END AS name, lower(c_mktsegment) AS category FROM {customer}) k ON k.person_id = x.person_id""")
def _(v):
    """A bucket's phone is a card's of the same number, its e-mail one of the next; the phone's card comes first."""
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    phone, mail = lambda k: F.array(F.concat(F.lit("+"), k.cast("string"))), lambda k: F.array(F.concat(F.lit("m"), k.cast("string")))
    buckets = v("supplier").select(s.cast("string").alias("min_node"), F.when(s % 3 != 0, F.col("s_name")).alias("name"), phone(s).alias("phones"), mail(s + 1).alias("emails"))
    none = F.array().cast("array<string>")
    known = v("customer").select(F.concat(F.lit("C"), c.cast("string")).alias("person_id"), F.when(c % 5 == 0, "X").otherwise(F.concat(F.lit("The long name "), "c_name")).alias("name"), F.lower("c_mktsegment").alias("category"), F.lit("").alias("relationship_to_me"), F.lit("").alias("company"), F.lit("").alias("title"), F.when(c % 2 == 0, phone(c)).otherwise(none).alias("phones"), mail(c).alias("emails"))
    return identity.merge_enriched(buckets, known).select("min_node", "name", "person_id", "category")


# names


def _names_sql(alias: str) -> str:
    """A name of words of the customer's segment, key and part names, with slips in some."""
    return f"""SELECT c_custkey AS k, upper(substr(p_name, 1, 1)) || substr(p_name, 2) || ' ' || CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN substr(lower(c_mktsegment), 2) ELSE replace(lower(c_mktsegment), 'e', 'é') END || CASE WHEN c_custkey % 5 = 0 THEN ' Jr' ELSE '' END AS {alias} FROM {{customer}} JOIN {{part}} ON p_partkey = c_custkey % 40"""


def named(v, alias: str) -> DataFrame:
    p = v("part").where("p_partkey < 40").select(F.col("p_partkey").alias("pk"), "p_name")
    rows = v("customer").withColumn("pk", F.col("c_custkey") % 40).join(p, "pk")
    low, key = F.lower("c_mktsegment"), F.col("c_custkey")
    last = F.when(key % 4 == 0, low).when(key % 4 == 1, F.expr("substring(lower(c_mktsegment), 2)")).otherwise(F.regexp_replace(low, "e", "é"))
    name = F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"), F.lit(" "), last, F.when(key % 5 == 0, " Jr").otherwise(""))
    return rows.select(key.alias("k"), name.alias(alias))


@Q.add("fuzzy_scores", recursive(fuzzy_sql(f"SELECT DISTINCT na, nb FROM ({_names_sql('na')}) x JOIN (SELECT k - 1 AS k, nb FROM ({_names_sql('nb')})) y USING (k)"), "SELECT na, nb, score FROM scored"))
def _(v):
    """Each customer's name against that of the next."""
    pairs = named(v, "na").join(named(v, "nb").withColumn("k", F.col("k") - 1), "k").select("na", "nb").distinct()
    return pairs.withColumn("score", fuzzy_score(F.col("na"), F.col("nb")))


_SIDES = """SELECT 'phone:' || cast(c_custkey AS varchar) AS min_node, 'First' || cast(c_custkey % 97 AS varchar) || ' Last' || cast(c_custkey AS varchar) AS name, true AS chat, false AS mail FROM {customer}
UNION ALL SELECT 'email:' || cast(c_custkey AS varchar), CASE WHEN c_custkey % 3 = 0 THEN 'Last' || cast(c_custkey AS varchar) || ' First' || cast(c_custkey % 97 AS varchar) || ' Jr' WHEN c_custkey % 3 = 1 THEN 'First' || cast(c_custkey % 97 AS varchar) || ' Last' || cast(c_custkey - c_custkey % 2 AS varchar) ELSE 'Last' || cast(c_custkey AS varchar) END, false, true FROM {customer}"""


def sides(v):
    key, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    first, last = F.concat(F.lit("First"), (key % 97).cast("string")), F.concat(F.lit("Last"), text)
    turned = F.when(key % 3 == 0, F.concat_ws(" ", last, first, F.lit("Jr"))).when(key % 3 == 1, F.concat_ws(" ", first, F.concat(F.lit("Last"), (key - key % 2).cast("string")))).otherwise(last)
    flags = lambda on: [F.lit(f == on).alias(f) for f in (*identity.CHAT, *identity.MAIL)]
    chat = v("customer").select(F.concat(F.lit("phone:"), text).alias("min_node"), F.concat_ws(" ", first, last).alias("name"), *flags("wa_dm"))
    return chat.unionByName(v("customer").select(F.concat(F.lit("email:"), text).alias("min_node"), turned.alias("name"), *flags("gmail_from")))


@Q.add("cross_channel_bridge", recursive(f"bk AS ({_SIDES}), " + _BRIDGE.replace("{bk}", "bk"), "SELECT chat_node, mail_node, score FROM br"))
def _(v):
    """All customers as chat buckets against all, with their names turned round, cut or a neighbour's, as mail buckets."""
    return identity.cross_channel_bridge(identity.cross_channel_candidates(sides(v)))


#: A name from the first words of each document; of every third, from one.
_NAMED = f"""SELECT * FROM (SELECT cast(doc_id AS varchar) AS id, doc_id % 97 AS thread, CASE WHEN doc_id % 3 = 0 THEN split_part(text, ' ', 1) ELSE split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) END AS name FROM {{documents}}) WHERE len(list_filter({_TOKENS}, lambda t: t <> '')) > 0"""


def titled(v) -> DataFrame:
    word = lambda n: F.split_part("text", F.lit(" "), F.lit(n))
    name = F.when(F.col("doc_id") % 3 == 0, word(1)).otherwise(F.concat_ws(" ", word(1), word(2)))
    return v("documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("id"), (F.col("doc_id") % 97).alias("thread_id"), name.alias("name"))


#: All pairs of documents, with the score of their names.
_ALL_PAIRS = f"nm AS ({_NAMED}), pr AS (SELECT x.id AS id_a, y.id AS id_b, x.thread = y.thread AS shared, least(x.name, y.name) AS na, greatest(x.name, y.name) AS nb FROM nm x JOIN nm y ON x.id < y.id), {fuzzy_sql('SELECT DISTINCT na, nb FROM pr')}"


@Q.add("name_candidates", recursive(_ALL_PAIRS, "SELECT id_a, id_b, score, score >= 0.9 OR (score >= 0.7 AND shared) AS auto FROM pr JOIN scored USING (na, nb) WHERE score >= 0.6"))
def _(v):
    """All pairs from the score for review on; persons of one thread need less likeness to merge."""
    return identity.name_pairs(titled(v).select("id", "name"), titled(v)).select("id_a", "id_b", "score", "auto")


@Q.add("name_merges", recursive(_ALL_PAIRS, "SELECT id_a, id_b, score FROM pr JOIN scored USING (na, nb) WHERE score >= 0.9 OR (score >= 0.7 AND shared)"))
def _(v):
    """What merges by itself; other pairs are not asked for."""
    return identity.name_pairs(titled(v).select("id", "name"), titled(v), 0.9).where("auto").select("id_a", "id_b", "score")


@Q.add("participant_links", recursive(f"""nm AS ({_NAMED}), pe AS (SELECT 'P' || id AS id, name FROM nm WHERE cast(id AS int) % 2 = 0), pa AS (SELECT DISTINCT name FROM nm WHERE cast(id AS int) % 2 = 1),
 pr AS (SELECT x.name AS na, y.name AS nb, y.id FROM pa x, pe y), {fuzzy_sql('SELECT DISTINCT na, nb FROM pr')}, best AS (SELECT na, arg_max(id, (score, id)) AS person_id, max(score) AS score FROM pr JOIN scored USING (na, nb) WHERE score >= 0.85 GROUP BY 1)""",
    "SELECT id AS interaction_id, na AS name, person_id, score FROM nm JOIN best ON best.na = nm.name WHERE cast(id AS int) % 2 = 1"))
def _(v):
    """The names on odd documents against persons from the even ones."""
    rows = titled(v)
    persons = rows.where("cast(id AS long) % 2 = 0").select(F.concat(F.lit("P"), "id").alias("id"), "name")
    return identity.link_participants(rows.where("cast(id AS long) % 2 = 1").select("id", F.array("name").alias("participants")), persons).select("interaction_id", "name", "person_id", "score")


_CANON = """SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN 'Ramon' || w || ' Berrios' || w WHEN 1 THEN '~ Ramon' || w || ' B' WHEN 2 THEN 'Solo' || w WHEN 3 THEN 'Solo' || w || ' Other' || w || ' Third' WHEN 4 THEN 'Lone' || w || ' Wolf' ELSE 'Mail' || w || ' Owner' END AS name, w FROM (
 SELECT c_custkey, chr(97 + cast(c_custkey // 6 % 26 AS int)) || chr(97 + cast(c_custkey // 156 % 26 AS int)) || chr(97 + cast(c_custkey // 4056 % 26 AS int)) AS w FROM {customer})"""


@Q.add("canonical_names", f"""
SELECT cast(k AS varchar) AS id, CASE k % 6 WHEN 0 THEN 'Ramon' || w || ' Berrios' || w WHEN 1 THEN 'Ramon' || w || ' Berrios' || w WHEN 2 THEN CASE WHEN k + 1 <= (SELECT max(c_custkey) FROM {{customer}}) THEN 'Solo' || w || ' Other' || w || ' Third' ELSE name END WHEN 3 THEN name ELSE name END AS display_name FROM ({_CANON})""")
def _(v):
    """Families of six: a name and its abbreviation, a first name alone and in full, two others."""
    key = F.col("c_custkey")
    w = F.concat(*[F.char((97 + F.floor(key / d) % 26).cast("int")) for d in (6, 156, 4056)])
    forms = [F.concat(F.lit("Ramon"), w, F.lit(" Berrios"), w), F.concat(F.lit("~ Ramon"), w, F.lit(" B")), F.concat(F.lit("Solo"), w), F.concat(F.lit("Solo"), w, F.lit(" Other"), w, F.lit(" Third")), F.concat(F.lit("Lone"), w, F.lit(" Wolf")), F.concat(F.lit("Mail"), w, F.lit(" Owner"))]
    rows = v("customer").select(key.cast("string").alias("id"), F.get(F.array(*forms), (key % 6).cast("int")).alias("name"), F.array(F.concat(F.lit("h"), key.cast("string"))).alias("handles"))
    return identity.canonical_names(rows).select("id", "display_name")


@Q.add("jid_names", """
SELECT jid, name FROM (SELECT cast(c_custkey AS varchar) || '@lid' AS jid, c_custkey AS k, 1 AS lid FROM {customer} UNION ALL SELECT cast(919000000000 + c_custkey AS varchar) || '@s.whatsapp.net', c_custkey, 0 FROM {customer}) j
JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 IN (0, 3) THEN 'Lid ' || c_name END AS ln, CASE WHEN c_custkey % 4 IN (1, 3) THEN 'Phone ' || c_name END AS pn FROM {customer}) n USING (k)
CROSS JOIN LATERAL (SELECT CASE WHEN j.lid = 1 THEN coalesce(n.ln, CASE WHEN m.l IS NOT NULL THEN n.pn END) ELSE coalesce(n.pn, CASE WHEN m.l IS NOT NULL THEN n.ln END) END AS name FROM (SELECT (SELECT max(lid) FROM {lid_map} WHERE lid = cast(j.k AS varchar)) AS l) m) WHERE name IS NOT NULL""")
def _(v):
    key, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    lid, phone = F.concat(text, F.lit("@lid")).alias("jid"), F.concat((key + 919000000000).cast("string"), F.lit("@s.whatsapp.net")).alias("jid")
    rows = v("customer").select(lid, F.when((key % 4).isin(0, 3), F.concat(F.lit("Lid "), "c_name")).otherwise("").alias("name"))
    rows = rows.unionByName(v("customer").select(phone, F.when((key % 4).isin(1, 3), F.concat(F.lit("Phone "), "c_name")).otherwise(" ").alias("name")))
    return identity.resolve_jid_names(rows, v("lid_map"))


@Q.add("seeded_identities", """
SELECT 'i' || cast(c_custkey AS varchar) AS id, CASE WHEN s.k IS NOT NULL AND s.k % 3 <> 1 THEN 'Seed ' || cast(s.k AS varchar) ELSE c_name END AS name, CASE WHEN s.k IS NOT NULL AND s.k % 2 = 0 THEN 'team' ELSE lower(c_mktsegment) END AS category,
       'i' || CASE WHEN s.k IS NULL THEN cast(c_custkey AS varchar) ELSE s.least END AS component FROM {customer} LEFT JOIN (SELECT c_custkey // 7 AS k, min(cast(c_custkey AS varchar)) AS least FROM {customer} WHERE c_custkey % 7 < 3 GROUP BY 1) s ON c_custkey % 7 < 3 AND s.k = c_custkey // 7""")
def _(v):
    """A seed has the handles of the first three of each seven identities."""
    key, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    own = v("customer").select(F.concat(F.lit("i"), text).alias("id"), F.col("c_name").alias("name"), F.lower("c_mktsegment").alias("category"), F.array(F.concat(F.lit("h"), text)).alias("handles"))
    k = F.floor(key / 7)
    seeds = v("customer").where("c_custkey % 7 < 3").groupBy(k.alias("k")).agg(F.collect_list(F.concat(F.lit("h"), text)).alias("handles"))
    seeds = seeds.select(F.col("k").cast("string").alias("seed_id"), "handles", F.when(F.col("k") % 3 != 1, F.concat(F.lit("Seed "), F.col("k").cast("string"))).alias("name"), F.when(F.col("k") % 2 == 0, "team").alias("category"))
    return identity.apply_seeds(own, seeds).select("id", "name", "category", F.expr("substring(component, 3)").alias("component"))


# graph, contacts, chunks


@Q.add("self_fallback", """
SELECT user_id, coalesce(CASE WHEN user_id = 't0' THEN 'P3' END, n) AS self_id FROM (SELECT p.user_id, min(p.id) AS n FROM {persons} p JOIN {customer} c ON p.id = 'P' || cast(c.c_custkey AS varchar) WHERE lower(c_name) LIKE 'custom%' GROUP BY 1)""")
def _(v):
    nodes = v("persons").join(v("customer").select(F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name")), "id").select("user_id", F.col("id").alias("person_id"), "name")
    phones = nodes.select("user_id", F.concat(F.lit("+"), "person_id").alias("phone"), "person_id")
    tenants = nodes.select("user_id").distinct().select("user_id", F.when(F.col("user_id") == "t0", "+P3").otherwise("+none").alias("phone"), F.lit("Custom.er@x.test").alias("email"))
    return graph.self_fallback(nodes.withColumn("name", F.col("name")), phones, tenants.withColumn("email", F.lit("CUSTOMer.x@x.test")))


@Q.add("contact_classes", """
SELECT k, CASE WHEN d IN ('gov.test', 'vc.test') THEN CASE d WHEN 'gov.test' THEN 'gov' ELSE 'investor' END WHEN k % 10 = 4 THEN 'team' WHEN contains(lower(name), 'mom') THEN 'friend' WHEN n <= 1 AND d IS NULL THEN 'other' WHEN s >= 2 THEN 'needs_review' WHEN n >= 3 AND phone THEN CASE WHEN n >= 10 THEN 'needs_review' ELSE 'other' END WHEN n >= 3 THEN 'needs_review' ELSE 'other' END AS category FROM (
 SELECT c_custkey AS k, CASE WHEN c_custkey % 10 = 5 THEN 'Mom of ' || c_name WHEN c_custkey % 10 = 6 THEN '+91 ' || cast(900000 + c_custkey AS varchar) ELSE c_name END AS name, c_custkey % 10 = 6 AS phone, CASE c_custkey % 6 WHEN 1 THEN 'gov.test' WHEN 2 THEN 'vc.test' WHEN 3 THEN 'acme.test' END AS d, c_custkey % 14 AS n, 1 + (c_custkey % 3 = 0)::int AS s FROM {customer})""")
def _(v):
    key = F.col("c_custkey")
    name = F.when(key % 10 == 5, F.concat(F.lit("Mom of "), "c_name")).when(key % 10 == 6, F.concat(F.lit("+91 "), (key + 900000).cast("string"))).otherwise(F.col("c_name"))
    rows = v("customer").select(key.alias("k"), name.alias("name"), F.when(key % 6 == 1, "gov.test").when(key % 6 == 2, "vc.test").when(key % 6 == 3, "acme.test").alias("email_domain"), F.when(key % 3 == 0, F.array(F.lit("dm"), F.lit("mail"))).otherwise(F.array(F.lit("dm"))).alias("sources"), (key % 14).alias("interactions"))
    domains = v("region").select(F.explode(F.array(F.struct(F.lit("gov.test").alias("d"), F.lit("gov").alias("c")), F.struct(F.lit("vc.test").alias("d"), F.lit("investor").alias("c")))).alias("x")).select(F.col("x.d").alias("email_domain"), F.col("x.c").alias("category"), F.lit("Co").alias("company")).distinct()
    team = rows.where("k % 10 = 4").select("name")
    return metrics.classify_contacts(rows, domains, team, r"\bmom\b").select("k", "category")


@Q.add("interaction_chunks", "SELECT user_id, id, cast((row_number() OVER (PARTITION BY user_id ORDER BY id) - 1) // 30 AS bigint) AS chunk FROM {order_obs} WHERE kind = 'interaction'")
def _(v):
    return metrics.chunk(v("order_obs").where("kind = 'interaction'"), "id").select("user_id", "id", "chunk")


@Q.add("bucket_profile", recursive(_GRAPH.replace("{more}", "") + ", " + _BUCKETS.replace("{cm}", "cm"), """
SELECT concat_ws('+', CASE WHEN list_contains(s, 'wa_dm') THEN 'wa_dm' END, CASE WHEN list_contains(s, 'wa_contact') THEN 'wa_contact' END, CASE WHEN list_contains(s, 'wa_group') THEN 'wa_group' END, CASE WHEN list_contains(s, 'google_contact') THEN 'google_contact' END, CASE WHEN list_contains(s, 'gmail_from') THEN 'gmail_from' END, CASE WHEN list_contains(s, 'gmail_to_cc') THEN 'gmail_to_cc' END) AS sources,
 count(*) AS humans, round(quantile_cont(size, 0.5), 6) AS p50, round(quantile_cont(size, 0.95), 6) AS p95, max(size) AS largest FROM (SELECT coalesce(string_split(sources, ','), []) AS s, n AS size FROM bk JOIN (SELECT component, count(*) AS n FROM cm GROUP BY 1) z ON z.component = bk.min_node) GROUP BY 1"""))
def _(v):
    return metrics.bucket_profile(buckets(v)).select("sources", "humans", r6("p50"), r6("p95"), F.col("largest").cast("long").alias("largest"))
