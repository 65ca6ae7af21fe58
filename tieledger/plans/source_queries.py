"""Readers, writers, projections into the ledger and streams over the given tables.

What is read here was written from the given tables a moment before, to the folder that driver and executors share.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieledger.functions import normalize as N
from tieledger.functions import words as W
from tieledger.operators import activity, cards, intake, links
from tieledger.plans.adapters import AS_OF
from tieledger.plans.ledger_queries import _CARDS, _person_cards
from tieledger.plans.registry import Registry, joined, us
from tieledger.sources import readers, writers
from tieledger.sources.tables import shared_dir
from tieledger.streaming import streams

Q = Registry()


def _folder(df: DataFrame) -> str:
    return f"{shared_dir(df.sparkSession)}/tieledger-{uuid.uuid4().hex}"


def quoted(values) -> str:
    return "(" + ", ".join(f"'{x}'" for x in values) + ")"


# readers and writers


@Q.add("message_store_read", """
SELECT chat_jid, ts, kind, CASE WHEN kind = 'group' THEN coalesce(name, own) ELSE coalesce(own, name) END AS chat_name, length(text) AS characters FROM (
 SELECT 'c' || cast(conv_id AS varchar) AS chat_jid, turn AS ts, text, CASE WHEN turn % 2 = 0 THEN 'own ' || role END AS own, CASE WHEN conv_id % 5 <> 0 THEN CASE WHEN conv_id % 3 = 0 THEN 'group' ELSE 'direct' END END AS kind,
        CASE WHEN conv_id % 5 <> 0 AND conv_id % 4 <> 0 THEN 'chat ' || cast(conv_id AS varchar) END AS name FROM {conversations})""")
def _(v):
    jid, to = F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("chat_jid"), _folder(v("conversations"))
    v("conversations").select(jid, F.col("turn").alias("ts"), "text", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("own "), "role")).alias("chat_name")).write.parquet(f"{to}/messages.parquet")
    chats = v("conversations").select("conv_id", jid).where("conv_id % 5 <> 0").distinct()
    chats.select(F.col("chat_jid").alias("jid"), F.when(F.col("conv_id") % 3 == 0, "group").otherwise("direct").alias("kind"), F.when(F.col("conv_id") % 4 != 0, F.concat(F.lit("chat "), F.col("conv_id").cast("string"))).alias("name")).write.parquet(f"{to}/chats.parquet")
    return readers.read_messages(v("conversations").sparkSession, to).select("chat_jid", "ts", "kind", "chat_name", F.length("text").alias("characters"))


@Q.add("mail_export_read", """
SELECT cast(o_orderkey AS varchar) AS id, 'th' || cast(o_custkey AS varchar) AS thread_id, CASE WHEN o_orderkey % 8 <> 5 THEN epoch_us(o_orderdate) END AS sent_at,
       CASE WHEN o_orderkey % 3 = 0 THEN 'later@mail.test' ELSE 'c' || cast(o_custkey AS varchar) || '@mail.test' END AS sender, o_orderpriority AS subject, CASE WHEN o_orderkey % 4 = 0 THEN 'IMPORTANT' ELSE '' END AS labels
FROM {orders} WHERE o_orderkey % 10 <> 7""")
def _(v):
    key = F.col("o_orderkey").cast("string")
    header = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    first = [header("From", F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@mail.test"))), header("Subject", F.col("o_orderpriority"))]
    headers = F.when(F.col("o_orderkey") % 3 == 0, F.array(*first, header("FROM", F.lit("later@mail.test")))).otherwise(F.array(*first))
    mail = F.struct(
        key.alias("id"), F.concat(F.lit("th"), F.col("o_custkey").cast("string")).alias("threadId"), F.when(F.col("o_orderkey") % 8 == 5, "unknown").otherwise(F.unix_millis("o_orderdate").cast("string")).alias("internalDate"),
        F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit("IMPORTANT"))).alias("labelIds"), F.struct(headers.alias("headers")).alias("payload"),
    )
    to = _folder(v("orders"))
    v("orders").select(F.when(F.col("o_orderkey") % 10 == 7, F.concat(F.lit("{broken "), key)).otherwise(F.to_json(mail)).alias("value")).write.text(to)
    rows = readers.read_mail(v("orders").sparkSession, to)
    return rows.select("id", "thread_id", us("sent_at"), F.element_at("headers", "from").alias("sender"), F.element_at("headers", "subject").alias("subject"), F.coalesce(F.array_join("labels", ","), F.lit("")).alias("labels"))


@Q.add("contact_export_read", """
SELECT CASE WHEN c_custkey % 6 <> 0 THEN c_name END AS name, CASE WHEN c_custkey % 4 <> 0 THEN '+' || cast(c_custkey AS varchar) ELSE '' END AS phones, CASE WHEN c_custkey % 5 <> 0 THEN lower(c_mktsegment) || '@mail.test' ELSE '' END AS emails FROM {customer}""")
def _(v):
    """Each address book has 500 entries, as one JSON document in a file of its own."""
    key, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    name = F.when(key % 6 != 0, F.when(key % 2 == 0, F.array(F.struct(F.col("c_name").alias("displayName"), F.lit(None).cast("string").alias("unstructuredName")))).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("displayName"), F.col("c_name").alias("unstructuredName")))))
    phone = F.when(key % 4 != 0, F.array(F.struct(F.when(key % 2 == 0, F.concat(F.lit("+"), text)).alias("canonicalForm"), F.concat(F.lit("+"), text).alias("value"))))
    mail = F.when(key % 5 != 0, F.array(F.struct(F.concat(F.lower("c_mktsegment"), F.lit("@mail.test")).alias("value"))))
    entry = F.struct(name.alias("names"), phone.alias("phoneNumbers"), mail.alias("emailAddresses"))
    books = v("customer").groupBy(F.floor(key / 500).alias("book")).agg(F.to_json(F.struct(F.collect_list(entry).alias("connections"))).alias("value"))
    to = _folder(books)
    books.repartition("book").write.partitionBy("book").text(to)
    return readers.read_contacts(books.sparkSession, to).select("name", joined("phones"), joined("emails"))


@Q.add("observation_lines", """
SELECT reason, count(*) AS n FROM (SELECT CASE o_orderkey % 12 WHEN 0 THEN 'json' WHEN 1 THEN 'confidence' WHEN 2 THEN 'payload' WHEN 3 THEN 'evidence_pointer' WHEN 4 THEN 'kind' ELSE 'valid' END AS reason FROM {orders}) GROUP BY 1
UNION ALL SELECT 'total_lines', count(*) FROM {orders}""")
def _(v):
    k = F.col("o_orderkey") % 12
    payload = F.struct(F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("target_person_id"), F.when(k != 2, F.col("o_orderpriority")).alias("content"))
    line = F.struct(
        F.lit("t").alias("user_id"), F.col("o_orderkey").cast("string").alias("id"), F.lit("2024-01-01T00:00:00Z").alias("observed_at"), F.lit("importer").alias("observer"), F.when(k == 4, "rumour").otherwise("note").alias("kind"),
        F.when(k == 3, "").otherwise("p").alias("evidence_pointer"), F.when(k == 1, 7.0).otherwise(0.5).alias("confidence"), F.lit("r").alias("reasoning"), payload.alias("payload"),
    )
    to = _folder(v("orders"))
    v("orders").select(F.when(k == 0, F.concat(F.lit("{half "), F.col("o_orderkey").cast("string"))).otherwise(F.to_json(line)).alias("value")).write.text(to)
    valid, rejects, summary = readers.read_observations(v("orders").sparkSession, to)
    reasons = valid.select(F.lit("valid").alias("reason")).unionByName(rejects.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    return reasons.unionByName(summary.select(F.lit("total_lines").alias("reason"), F.col("total_lines").alias("n")))


_CSV = "SELECT 't' || cast(c_nationkey % 3 AS varchar) AS user_id, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE trim(c_name) END AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE lower('C' || cast(c_custkey AS varchar) || '@Mail.test') END AS email, CASE WHEN c_custkey % 4 = 0 THEN 'other' ELSE lower(c_mktsegment) END AS category FROM {customer}"


@Q.add("contact_csv_import", f"""
SELECT user_id, name, email, category, sha256(user_id || '|' || name || '|' || coalesce(email, '')) AS id, 'csv://' || sha256(user_id || '|' || name || '|' || coalesce(email, '')) AS evidence_pointer,
       '{{"name":"' || name || '","company":null,"category":"' || category || '","emails":[' || coalesce('"' || email || '"', '') || ']}}' AS payload FROM ({_CSV}) WHERE name <> ''""")
def _(v):
    key, to = F.col("c_custkey"), _folder(v("customer"))
    rows = v("customer").select(
        F.concat(F.lit("t"), (F.col("c_nationkey") % 3).cast("string")).alias("user_id"), F.when(key % 7 == 0, " ").otherwise(F.concat(F.lit(" "), "c_name")).alias("name"), F.lit(" ").alias("company"),
        F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("C"), key.cast("string"), F.lit("@Mail.test "))).alias("email"), F.when(key % 4 != 0, F.lower("c_mktsegment")).alias("category"),
    )
    rows.write.option("header", True).csv(to)
    read = rows.sparkSession.read.option("header", True).schema(rows.schema).csv(to)
    return intake.import_contacts_csv(read).select("user_id", "name", "email", "category", "id", "evidence_pointer", "payload")


@Q.add("manifest_write", "SELECT 'local-' || cast(c_custkey AS varchar) AS id, c_name AS name, 'u' || cast(c_custkey AS varchar) AS handle FROM {customer}")
def _(v):
    key, to = F.col("c_custkey").cast("string"), _folder(v("customer"))
    rows = v("customer").select(F.concat(F.lit("phone:"), key).alias("min_node"), F.concat(F.lit("local-"), key).alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("u"), key).alias("handle"))
    writers.write_manifest(rows, to)
    return rows.sparkSession.read.schema("id string, name string, handle string").json(to)


@Q.add("ledger_write", "SELECT user_id, kind, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM {obs} GROUP BY 1, 2")
def _(v):
    """Two appends to a partitioned table, and what it then holds."""
    to = _folder(v("obs"))
    for part in (0, 1):
        writers.write_table(v("obs").where(f"seq % 2 = {part}"), to, ["user_id", "kind"])
    return v("obs").sparkSession.read.parquet(to).groupBy("user_id", "kind").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@Q.add("graph_write", "SELECT user_id, CASE WHEN user_id = 't1' THEN 'Z' || id ELSE id END AS person_id FROM {persons} WHERE user_id <> 't1' OR length(id) % 2 = 0")
def _(v):
    """All tenants' nodes, then one tenant's anew: others stay."""
    to, nodes = _folder(v("persons")), v("persons").select("user_id", F.col("id").alias("person_id"))
    writers.write_graph(nodes, nodes, to)
    anew = nodes.where("user_id = 't1' AND length(person_id) % 2 = 0").withColumn("person_id", F.concat(F.lit("Z"), "person_id"))
    writers.write_graph(anew, anew, to)
    return writers.read_graph(nodes.sparkSession, to)[0].select("user_id", "person_id")


# projections into the ledger


@Q.add("cleaned_texts", "SELECT doc_id, substr(text, 1, 160) AS preview, length(text) AS characters FROM {documents}")
def _(v):
    dirty = F.concat(F.substring("text", 1, 20), F.lit("\x00"), F.expr("substring(text, 21)"), F.lit("\x00"))
    clean = N.clean_text(dirty)
    return v("documents").select("doc_id", N.safe_slice(clean, 160).alias("preview"), F.length(clean).alias("characters"))


@Q.add("manifest_observations", """
SELECT 'hand://h' || cast(c_custkey AS varchar) AS evidence_pointer, CASE WHEN c_custkey % 4 <> 0 THEN c_name WHEN c_custkey % 3 = 0 THEN 'mail' || cast(c_custkey AS varchar) WHEN c_custkey % 2 = 0 AND c_custkey % 8 = 0 THEN '+' || cast(c_custkey AS varchar) ELSE 'unknown' END AS name,
       'Rules only, from ' || CASE WHEN c_custkey % 5 = 0 AND c_custkey % 2 = 0 THEN 'wa_dm+gmail_from' WHEN c_custkey % 5 = 0 THEN 'wa_dm' WHEN c_custkey % 2 = 0 THEN 'gmail_from' ELSE 'unknown' END AS reasoning
FROM {customer}""")
def _(v):
    key, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    none = F.array().cast("array<string>")
    flags = F.struct((key % 5 == 0).alias("wa_dm"), F.lit(False).alias("wa_contact"), F.lit(False).alias("wa_group"), (key % 2 == 0).alias("gmail_from"), F.lit(None).cast("boolean").alias("google_contact"))
    rows = v("customer").select(
        F.concat(F.lit("h"), text).alias("id"), F.when(key % 4 != 0, F.concat(F.lit(" "), "c_name", F.lit(" "))).otherwise(F.lit(" ")).alias("name"), F.when(key % 8 == 0, F.array(F.concat(F.lit("+"), text))).otherwise(none).alias("phones"),
        F.when(key % 3 == 0, F.array(F.concat(F.lit("mail"), text, F.lit("@x.test")))).otherwise(none).alias("emails"), F.lit(AS_OF).cast("timestamp").alias("first_seen"), flags.alias("source_provenance"),
    )
    return intake.manifest_to_observations(rows, "hand", "importer").select("evidence_pointer", "name", "reasoning")


def _slug(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@Q.add("activity_observations", f"""
SELECT channel, summary, 'activity://' || {_slug('o_orderpriority')} || '/P' || cast(o_custkey AS varchar) || '/' || substr({_slug('title')}, 1, 96) AS evidence_pointer,
       '{{"channel":"' || channel || '","summary":"' || summary || '","target_person_id":"P' || cast(o_custkey AS varchar) || '","activity_type":"' || kind || '","title":"' || title || '"}}' AS payload
FROM (SELECT *, CASE WHEN kind = 'meeting' THEN 'meeting' ELSE 'slack' END AS channel, CASE WHEN o_orderkey % 3 = 0 THEN title ELSE 'note on ' || o_orderstatus END AS summary FROM (
 SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'meeting' WHEN 1 THEN 'call' ELSE 'chat' END AS kind, '# Call ' || o_orderpriority || ' / No. ' || cast(o_orderkey AS varchar) || '!' AS title FROM {{orders}}))""")
def _(v):
    key = F.col("o_orderkey")
    rows = v("orders").select(
        F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("person_id"), F.when(key % 4 == 0, "meeting").when(key % 4 == 1, "call").otherwise("chat").alias("type"),
        F.concat(F.lit("# Call "), "o_orderpriority", F.lit(" / No. "), key.cast("string"), F.lit("!")).alias("title"), F.when(key % 3 != 0, F.concat(F.lit("note on "), "o_orderstatus")).otherwise("").alias("notes"),
        F.col("o_orderpriority").alias("source"), F.col("o_orderdate").alias("occurred_at"),
    )
    return intake.activities_to_observations(rows).select("channel", "summary", "evidence_pointer", "payload")


@Q.add("note_observations", """
SELECT 'note' AS kind, 'note://P' || cast(o_custkey AS varchar) || '/' || cast(cast(epoch(o_orderdate) AS bigint) AS varchar) AS evidence_pointer,
       '{"target_person_id":"P' || cast(o_custkey AS varchar) || '","content":"about ' || o_orderpriority || '","source":"manual"}' AS payload FROM {orders}""")
def _(v):
    rows = v("orders").select(F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("person_id"), F.concat(F.lit("about "), "o_orderpriority").alias("content"), F.col("o_orderdate").alias("noted_at"))
    return intake.notes_to_observations(rows).select("kind", "evidence_pointer", "payload")


_MAILS = """(SELECT l.user_id, l.person_id, string_agg(DISTINCT e, ',' ORDER BY e) AS emails FROM (SELECT user_id, id, unnest(from_json(payload->'$.emails', '["VARCHAR"]')) AS e FROM {person_obs}) o JOIN {links} l ON l.user_id = o.user_id AND l.observation_id = o.id GROUP BY 1, 2)"""


@Q.add("email_append", f"""
SELECT user_id, person_id, emails AS old_value, CASE WHEN list_contains(string_split(emails, ','), email) THEN emails ELSE (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT unnest(list_append(string_split(emails, ','), email)) AS x)) END AS new_value
FROM (SELECT *, CASE WHEN length(person_id) % 2 = 0 THEN string_split(emails, ',')[1] ELSE 'new' || lower(person_id) || '@mail.test' END AS email FROM {_MAILS})""")
def _(v):
    own = _person_cards(v).select("user_id", "person_id", F.array_sort("emails").alias("emails"))
    asked = own.select("user_id", "person_id", F.when(F.length("person_id") % 2 == 0, F.upper(F.get("emails", F.lit(0)))).otherwise(F.concat(F.lit(" New"), "person_id", F.lit("@mail.test "))).alias("email"))
    return intake.emails_to_corrections(asked, own).select("user_id", "person_id", joined("old_value"), F.array_join(F.array_sort("new_value"), ",").alias("new_value"))


@Q.add("merge_audit", """
SELECT id, epoch_us(applied_at) AS applied_at FROM (SELECT 'a' || cast(o_orderkey AS varchar) AS id, o_orderdate AS applied_at, CASE o_orderkey % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'llm' WHEN 2 THEN 'user' ELSE 'robot' END AS source, cast(o_orderkey % 13 AS double) / 10 AS confidence, o_orderkey % 5 = 0 AS reverted FROM {orders})
WHERE source <> 'robot' AND confidence BETWEEN 0 AND 1 AND NOT reverted""")
def _(v):
    key = F.col("o_orderkey")
    rows = v("orders").select(F.concat(F.lit("a"), key.cast("string")).alias("id"), F.col("o_orderdate").alias("applied_at"), F.when(key % 4 == 0, "auto").when(key % 4 == 1, "llm").when(key % 4 == 2, "user").otherwise("robot").alias("source"), ((key % 13) / 10).alias("confidence"), F.when(key % 5 == 0, F.col("o_orderdate")).alias("reverted_at"), (key % 2).alias("half"))
    audit = intake.append_merge_audit(intake.append_merge_audit(None, rows.where("half = 0")), rows.where("half = 1"))
    return intake.active_merges(audit).select("id", us("applied_at"))


@Q.add("person_observations", "SELECT l.user_id, l.person_id, o.id, o.kind FROM {obs} o JOIN {links} l ON l.user_id = o.user_id AND l.observation_id = o.id")
def _(v):
    return cards.person_observations(v("obs"), v("links")).select("user_id", "person_id", "id", "kind")


for _how, _sql in (("phone", "list_contains(string_split(phones, ','), '+919000000017')"), ("email", "list_contains(string_split(lower(emails), ','), 'u33@mail5.test')")):

    @Q.add(f"person_search_by_{_how}", f"SELECT person_id FROM (SELECT l.user_id, l.person_id, string_agg(DISTINCT p, ',') AS phones, string_agg(DISTINCT e, ',') AS emails FROM (SELECT user_id, id, unnest(from_json(payload->'$.phones', '[\"VARCHAR\"]')) AS p, NULL AS e FROM {{person_obs}} UNION ALL SELECT user_id, id, NULL, unnest(from_json(payload->'$.emails', '[\"VARCHAR\"]')) FROM {{person_obs}}) o JOIN {{links}} l ON l.user_id = o.user_id AND l.observation_id = o.id GROUP BY 1, 2) WHERE {_sql}")
    def _(v, how=_how):
        asked = {"phone": "+919000000017", "email": "U33@Mail5.test"}[how]
        return cards.search_persons(_person_cards(v), **{how: asked}, limit=50).select("person_id")


# filters


_LOCAL = "^(" + "|".join(W.BOT_LOCAL_PARTS) + ")$"
_TOKEN = "(^|[-_.])(" + "|".join(W.BOT_TOKENS) + ")([-_.]|$)"
_SUB = "^(" + "|".join(W.BOT_SUBDOMAINS) + r")\."


@Q.add("bot_addresses", f"""
SELECT doc_id, email, local IN (SELECT 'x') OR domain IN {quoted(W.BOT_DOMAINS)} OR regexp_matches(local, '{_LOCAL}') OR regexp_matches(local, '{_TOKEN}') OR regexp_matches(domain, '{_SUB}') AS bot FROM (
 SELECT doc_id, email, split_part(email, '@', 1) AS local, split_part(email, '@', 2) AS domain FROM (
  SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN w || '@' || lang || '.test' WHEN 1 THEN 'no-reply.' || w || '@x.test' WHEN 2 THEN w || '@mail.' || lang || '.test' WHEN 3 THEN w || '@notifications.github.com' WHEN 4 THEN 'alerts@' || w || '.test' WHEN 5 THEN w || 'info@x.test' WHEN 6 THEN 'info@x.test' ELSE w || '-bounces@x.test' END AS email
  FROM (SELECT doc_id, coalesce(lang, 'xx') AS lang, regexp_extract(lower(text), '[a-z]+') AS w FROM {{documents}})))""")
def _(v):
    w, lang, k = F.regexp_extract(F.lower("text"), "[a-z]+", 0), F.coalesce("lang", F.lit("xx")), F.col("doc_id") % 8
    forms = [F.concat(w, F.lit("@"), lang, F.lit(".test")), F.concat(F.lit("no-reply."), w, F.lit("@x.test")), F.concat(w, F.lit("@mail."), lang, F.lit(".test")), F.concat(w, F.lit("@notifications.github.com")), F.concat(F.lit("alerts@"), w, F.lit(".test")), F.concat(w, F.lit("info@x.test")), F.lit("info@x.test"), F.concat(w, F.lit("-bounces@x.test"))]
    rows = v("documents").where("text IS NOT NULL").select("doc_id", F.get(F.array(*forms), k.cast("int")).alias("email"))
    return rows.select("doc_id", "email", N.is_bot_email(F.col("email")).alias("bot"))


@Q.add("bulk_mails", """
SELECT o_orderkey, o_orderkey % 4 = 1 OR o_orderkey % 4 = 2 OR (o_orderkey % 4 = 3 AND contains(lower(o_orderpriority), 'low')) AS bulk FROM {orders}""")
def _(v):
    k = F.col("o_orderkey") % 4
    header = F.when(k == 1, "list-unsubscribe").when(k == 2, "list-id").when(k == 3, "precedence").otherwise("subject")
    value = F.when(F.lower("o_orderpriority").contains("low"), F.lit("Bulk; x")).otherwise(F.col("o_orderpriority"))
    return v("orders").select("o_orderkey", N.is_bulk_mail(F.create_map(F.lit("from"), F.lit("a@b.c"), header, value)).alias("bulk"))


_PHONED = """(SELECT c.*, CASE WHEN c.jid LIKE '%@lid' THEN '+' || m.pn ELSE '+' || coalesce(c.phone, replace(c.jid, '@s.whatsapp.net', '')) END AS contact_phone, coalesce(nullif(trim(full_name), ''), nullif(trim(push_name), ''), nullif(trim(first_name), '')) AS named
 FROM {contacts} c LEFT JOIN {lid_map} m ON c.jid LIKE '%@lid' AND m.lid = split_part(split_part(c.jid, '@', 1), ':', 1))"""


@Q.add("resolvable_contacts", f"SELECT jid, contact_phone FROM {_PHONED} WHERE jid NOT LIKE '%@lid' OR named IS NOT NULL OR contact_phone IS NOT NULL")
def _(v):
    return N.filter_resolvable(v("contacts"), v("lid_map")).select("jid", "contact_phone")


_AUTO = "|".join(f"({p})" for p in W.AUTO_EVENTS)


@Q.add("calendar_filter", f"""
SELECT CASE WHEN regexp_matches(lower(summary), '{_AUTO}') OR more = 0 THEN 'auto' WHEN start_at > TIMESTAMP '2024-02-20 12:00:00' THEN 'far_future' WHEN more > 8 THEN 'org_wide' ELSE 'kept' END AS reason, count(*) AS n FROM (
 SELECT summary, CASE WHEN more = 0 THEN 0 ELSE more END AS more, start_at FROM {{attended}}) GROUP BY 1""")
def _(v):
    guests = F.when(F.col("more") == 0, F.array().cast("array<string>")).otherwise(F.concat(F.array(F.lit("Me@self.test")), F.transform(F.sequence(F.lit(1), F.greatest(F.col("more"), F.lit(1)).cast("int")), lambda i: F.concat(F.lit("g"), i.cast("string"), F.lit("@x.test")))))
    rows = v("attended").select("summary", "start_at", guests.alias("attendee_emails"))
    return activity.filter_calendar(rows, "2024-02-20 12:00:00", ["me@self.test"], ahead=0)[1].select("reason", F.col("count").alias("n"))


@Q.add("human_members", """
SELECT member_id FROM (SELECT CASE WHEN s_suppkey % 50 = 7 THEN 'USLACKBOT' ELSE 'U' || cast(s_suppkey AS varchar) END AS member_id, CASE WHEN s_suppkey % 6 = 0 THEN 'chad' WHEN s_suppkey % 6 = 1 THEN 'github-actions' ELSE lower(s_name) END AS name, coalesce(s_suppkey % 9 = 0, false) AS bot FROM {supplier})
WHERE NOT bot AND member_id <> 'USLACKBOT' AND name NOT IN ('wazowski', 'chad', 'axe', 'kite', 'slackbot')""")
def _(v):
    key = F.col("s_suppkey")
    rows = v("supplier").select(F.when(key % 50 == 7, "USLACKBOT").otherwise(F.concat(F.lit("U"), key.cast("string"))).alias("member_id"), F.when(key % 6 == 0, "Chad").when(key % 6 == 1, "github-actions").alias("real_name"), F.col("s_name").alias("name"), F.when(key % 3 == 0, key % 9 == 0).alias("is_bot"))
    return activity.filter_members(rows).select("member_id")


_GUESTS = "list_filter([guest, second], lambda x: NOT (lower(x) = 'me@self.test' OR contains(lower(x), 'resource.calendar') OR lower(x) LIKE 'no-reply@%'))"


def attendees():
    each = [F.struct(F.col(c).alias("email"), F.concat(F.lit("Name of "), c).alias("name")) for c in ("guest", "second")]
    return F.when(F.col("more") == 5, F.array(each[1])).otherwise(F.array(*each))


@Q.add("eligible_meetings", f"""
SELECT meeting_id, array_to_string(a, ',') AS attendees FROM (SELECT *, CASE WHEN more = 5 THEN list_filter({_GUESTS}, lambda x: x = second) ELSE {_GUESTS} END AS a FROM {{attended}}) WHERE lower(status) <> 'cancelled' AND event_type <> 'outOfOffice' AND NOT all_day AND len(a) > 0""")
def _(v):
    rows = activity.eligible_meetings(v("attended").withColumn("attendees", attendees()), ["Me@self.test"])
    return rows.select("meeting_id", F.array_join(F.transform("attendees", lambda a: a["email"]), ",").alias("attendees"))


@Q.add("meeting_briefs", f"""
SELECT m.user_id, m.meeting_id, string_agg(m.email || '=' || coalesce(c.name, 'Name of ' || m.raw) || '=' || coalesce(c.person_id, ''), ',' ORDER BY m.email) AS attendees FROM (
 SELECT user_id, meeting_id, lower(e) AS email, e AS raw FROM (SELECT user_id, meeting_id, unnest(CASE WHEN more = 5 THEN [second] ELSE [guest, second] END) AS e FROM {{attended}} WHERE generated_at IS NULL OR brief_md = '' OR generated_at < TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR)) m
LEFT JOIN (SELECT user_id, email, person_id, name FROM (SELECT *, row_number() OVER (PARTITION BY user_id, email ORDER BY person_id, name) AS n FROM (
  SELECT DISTINCT e.user_id, e.email, e.person_id, c.name FROM (SELECT l.user_id, l.person_id, lower(unnest(from_json(o.payload->'$.emails', '["VARCHAR"]'))) AS email FROM {{person_obs}} o JOIN {{links}} l ON l.user_id = o.user_id AND l.observation_id = o.id) e JOIN ({_CARDS}) c ON c.person_id = e.person_id)) WHERE n = 1) c
 ON c.user_id = m.user_id AND c.email = m.email GROUP BY 1, 2""")
def _(v):
    rows = activity.meeting_context(v("attended").withColumn("attendees", attendees()), _person_cards(v), AS_OF)
    shown = F.transform("attendees", lambda a: F.concat_ws("=", a["email"], a["name"], F.coalesce(a["person_id"], F.lit(""))))
    return rows.select("user_id", "meeting_id", F.array_join(shown, ",").alias("attendees"))


@Q.add("email_backfill", """
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN a.p IS NULL OR a.e IS NULL THEN 'invalid' WHEN k.n IS NULL THEN 'no_match' WHEN k.n > 1 THEN 'ambiguous' WHEN list_contains(k.emails, a.e) THEN 'present' ELSE 'candidate' END AS reason FROM (
  SELECT CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE '+1' || cast(5550000000 + s_suppkey AS varchar) END AS p, CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE 'u' || cast(s_suppkey AS varchar) || '@mail.test' END AS e FROM {supplier}) a
 LEFT JOIN (SELECT p, count(DISTINCT id) AS n, list(e) AS emails FROM (SELECT c_custkey AS id, '+1' || cast(5550000000 + CASE WHEN c_custkey % 6 = 1 THEN c_custkey - 1 ELSE c_custkey END AS varchar) AS p, CASE WHEN c_custkey % 4 = 2 THEN 'u' || cast(c_custkey AS varchar) || '@mail.test' ELSE 'other@mail.test' END AS e FROM {customer} WHERE c_custkey % 3 <> 2) GROUP BY 1) k ON k.p = a.p) GROUP BY 1""")
def _(v):
    key, own = F.col("s_suppkey"), F.col("c_custkey")
    pairs = v("supplier").select(F.when(key % 10 == 0, "12").when(key % 2 == 0, F.concat(F.lit("+1 "), (key + 5550000000).cast("string"))).otherwise((key + 5550000000).cast("string")).alias("phone"), F.when(key % 11 == 0, "nobody").otherwise(F.concat(F.lit("U"), key.cast("string"), F.lit("+x@Mail.test"))).alias("email"))
    known = v("customer").where("c_custkey % 3 <> 2").select(own.cast("string").alias("person_id"), F.array(F.concat(F.lit("+1"), (F.when(own % 6 == 1, own - 1).otherwise(own) + 5550000000).cast("string"))).alias("phones"), F.array(F.when(own % 4 == 2, F.concat(F.lit("u"), own.cast("string"), F.lit("@mail.test"))).otherwise("other@mail.test")).alias("emails"))
    return activity.backfill_emails(pairs, known)[1].select("reason", F.col("count").alias("n"))


# streams


def _stream(rows: DataFrame, parts: list[str]) -> Iterator[DataFrame]:
    """The rows as a stream of files that grows between runs: before each, by those of the next condition, in order."""
    to = _folder(rows)
    for condition in parts:
        rows.where(condition).write.mode("append").parquet(to)
        yield rows.sparkSession.readStream.schema(rows.schema).parquet(to)


@Q.add("streamed_raw_events", """
SELECT user_id, source, source_event_id, arg_min(body, (part, seq)) AS body FROM (SELECT *, CASE WHEN seq < 1000000000 AND seq % 2 = 0 THEN 0 WHEN seq >= 1000000000 THEN 1 ELSE 2 END AS part FROM {raw}) GROUP BY 1, 2, 3""")
def _(v):
    """Originals of even events, then what is replayed, then the other originals: the first row of a key stays."""
    to = _folder(v("raw"))
    for stream in _stream(v("raw"), ["seq < 1000000000 AND seq % 2 = 0", "seq >= 1000000000", "seq < 1000000000 AND seq % 2 = 1"]):
        streams.stream_raw_events(stream, f"{to}/raw", f"{to}/state").awaitTermination()
    return v("raw").sparkSession.read.parquet(f"{to}/raw").select("user_id", "source", "source_event_id", "body")


_STREAM_KEY = """sha256(kind || ':' || evidence_pointer || ':' || CASE WHEN kind = 'correction' THEN coalesce(payload->>'$.target_person_id', '') || ':' || coalesce(payload->>'$.field', '') || ':' || coalesce(payload->>'$.new_value', '') ELSE '' END)"""


@Q.add("streamed_observations", f"SELECT user_id, kind, count(DISTINCT {_STREAM_KEY}) AS n FROM {{order_obs}} GROUP BY 1, 2")
def _(v):
    """All rows in two batches, then all once more under another checkpoint."""
    rows, to = v("order_obs").withColumn("ingested_at", F.col("observed_at")), _folder(v("order_obs"))
    for k in range(2):
        for stream in _stream(rows, ["seq % 2 = 0", "seq % 2 = 1"]):
            streams.stream_observations(stream, f"{to}/obs", f"{to}/links", f"{to}/state{k}").awaitTermination()
    return rows.sparkSession.read.parquet(f"{to}/obs").groupBy("user_id", "kind").agg(F.count("*").alias("n"))


@Q.add("observer_tick", f"""
SELECT user_id, epoch_us(max(w)) AS last_tick_at FROM (SELECT user_id, min(occurred_at) + INTERVAL 60 DAY AS w FROM {{raw}} WHERE user_id = 't1' GROUP BY 1 UNION ALL SELECT user_id, max(occurred_at) + INTERVAL 1 DAY FROM {{raw}} WHERE user_id = 't2' GROUP BY 1
 UNION ALL SELECT r.user_id, TIMESTAMP '{AS_OF}' FROM {{raw}} r LEFT JOIN (SELECT min(occurred_at) + INTERVAL 60 DAY AS w FROM {{raw}} WHERE user_id = 't1') m ON true WHERE r.user_id = 't0' OR (r.user_id = 't1' AND r.occurred_at > m.w)) GROUP BY 1""")
def _(v):
    raw = v("raw").withColumn("ingested_at", F.col("occurred_at"))
    marks = raw.where("user_id = 't1'").groupBy("user_id").agg((F.min("occurred_at") + F.expr("INTERVAL 60 DAYS")).alias("last_tick_at"))
    marks = marks.unionByName(raw.where("user_id = 't2'").groupBy("user_id").agg((F.max("occurred_at") + F.expr("INTERVAL 1 DAY")).alias("last_tick_at")))
    to, stream = _folder(raw), list(_stream(raw, ["seq % 3 = 0", "seq % 3 = 1", "seq % 3 = 2"]))[-1]
    for _ in range(2):  # the second run finds nothing new
        streams.stream_ticks(stream, f"{to}/marks", f"{to}/state", AS_OF, marks)
    return streams.watermarks(raw.sparkSession, f"{to}/marks").select("user_id", us("last_tick_at"))


@Q.add("streamed_interactions", """
SELECT DISTINCT user_id, 'whatsapp://message/' || source_event_id AS evidence_pointer FROM {events_once} WHERE source = 'whatsapp' AND phone IS NOT NULL AND thread_id NOT LIKE '%@g.us'""")
def _(v):
    rows, to = v("events_once"), _folder(v("events_once"))
    for k in range(2):
        for stream in _stream(rows, ["seq % 2 = 0", "seq % 2 = 1"]):
            streams.stream_interactions(stream, f"{to}/obs", f"{to}/links", f"{to}/state{k}").awaitTermination()
    return rows.sparkSession.read.parquet(f"{to}/obs").select("user_id", "evidence_pointer")


@Q.add("streamed_thread_stats", "SELECT user_id, thread_id, count(*) AS message_count, epoch_us(min(occurred_at)) AS first_at, epoch_us(max(occurred_at)) AS last_at FROM {events_once} WHERE source = 'whatsapp' AND thread_id LIKE '%@s.whatsapp.net' GROUP BY 1, 2")
def _(v):
    to = _folder(v("events_once"))
    for stream in _stream(v("events_once"), ["seq % 3 = 0", "seq % 3 = 1", "seq % 3 = 2"]):
        streams.stream_thread_stats(stream, f"{to}/stats", f"{to}/state").awaitTermination()
    now = v("events_once").sparkSession.read.parquet(f"{to}/stats").groupBy("user_id", "thread_id").agg(F.max_by(F.struct("message_count", "first_at", "last_at"), "batch").alias("x"))
    return now.select("user_id", "thread_id", "x.message_count", F.unix_micros("x.first_at").alias("first_at"), F.unix_micros("x.last_at").alias("last_at"))


@Q.add("daily_delta", """
SELECT w.user_id, w.person_id, coalesce(m.n, 0) AS messages FROM (SELECT a.user_id, a.person_id, s.pass_at FROM (
  SELECT l.user_id, l.person_id FROM {obs} o JOIN {links} l ON l.user_id = o.user_id AND l.observation_id = o.id WHERE o.observed_at >= TIMESTAMP '2024-01-06 00:00:00' - INTERVAL 1 DAY
  UNION SELECT user_id, person_id FROM {snaps} WHERE pass_at >= TIMESTAMP '2024-01-06 00:00:00' - INTERVAL 1 DAY) a LEFT JOIN (SELECT user_id, person_id, max(pass_at) AS pass_at FROM {snaps} GROUP BY 1, 2) s ON s.user_id = a.user_id AND s.person_id = a.person_id) w
LEFT JOIN (SELECT p.user_id, p.person_id, least(count(*), 30) AS n FROM (SELECT l.user_id, l.person_id, o.observed_at + INTERVAL 27 DAY AS at FROM {order_obs} o JOIN {links} l ON l.user_id = o.user_id AND l.observation_id = o.id) p
 LEFT JOIN (SELECT user_id, person_id, max(pass_at) AS pass_at FROM {snaps} GROUP BY 1, 2) s ON s.user_id = p.user_id AND s.person_id = p.person_id WHERE s.pass_at IS NULL OR p.at > s.pass_at GROUP BY 1, 2) m ON m.user_id = w.user_id AND m.person_id = w.person_id
WHERE w.pass_at IS NULL OR m.n > 0""")
def _(v):
    said = v("order_obs").join(v("links").withColumnRenamed("observation_id", "id"), ["user_id", "id"]).select("user_id", "person_id", (F.col("observed_at") + F.expr("INTERVAL 27 DAYS")).alias("at"), F.col("id").alias("text"))
    rows = streams.daily_delta(v("obs"), v("links"), v("snaps"), said, "2024-01-06 00:00:00")
    return rows.select("user_id", "person_id", F.coalesce(F.size("messages"), F.lit(0)).cast("long").alias("messages"))
