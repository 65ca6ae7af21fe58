"""Intake, links and cards over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tieledger.operators import cards, intake, links
from tieledger.plans.adapters import AS_OF
from tieledger.plans.registry import Registry, joined, us
from tieledger.sources.tables import shared_dir
from tieledger.sources.versions import Versions

Q = Registry()

#: DuckDB: the newest value that a rule sets, for the oracle of the card fold.
_ROWS = """
rows AS (SELECT l.user_id, l.person_id, o.kind, o.payload, row_number() OVER (PARTITION BY l.user_id, l.person_id ORDER BY o.observed_at, o.ingested_at, o.id) AS n,
                o.observed_at, o.id, o.payload->>'$.field' AS field, json_type(o.payload, '$.new_value') AS nt, o.payload->>'$.new_value' AS nv
         FROM obs o JOIN links l ON l.user_id = o.user_id AND l.observation_id = o.id)"""


def _set_plain(name: str) -> str:
    return f"""set_{name} AS (SELECT user_id, person_id, arg_max(v, n) AS {name} FROM (
        SELECT user_id, person_id, n, CASE WHEN kind = 'person' THEN payload->>'$.{name}' ELSE nv END AS v FROM rows
        WHERE (kind = 'person' AND json_type(payload, '$.{name}') = 'VARCHAR' AND payload->>'$.{name}' <> '') OR (kind = 'correction' AND field = '{name}' AND nt = 'VARCHAR')) GROUP BY ALL)"""


def _set_null(name: str) -> str:
    return f"""set_{name} AS (SELECT user_id, person_id, last(v ORDER BY n) AS {name} FROM (
        SELECT user_id, person_id, n, nullif(CASE WHEN kind = 'person' THEN payload->>'$.{name}' ELSE nv END, '') AS v FROM rows
        WHERE (kind = 'person' AND json_type(payload, '$.{name}') IN ('VARCHAR', 'NULL')) OR (kind = 'correction' AND field = '{name}' AND nt IN ('VARCHAR', 'NULL'))) GROUP BY ALL)"""


def _set_list(name: str) -> str:
    return f"""cut_{name} AS (SELECT user_id, person_id, max(n) AS c FROM rows WHERE kind = 'correction' AND field = '{name}' AND nt = 'ARRAY' GROUP BY ALL),
    item_{name} AS (SELECT r.user_id, r.person_id, r.n, u.pos, json_extract_string(r.arr, '$[' || u.pos || ']') AS v FROM (
        SELECT *, CASE WHEN kind = 'person' THEN json_extract(payload, '$.{name}') WHEN field = '{name}' AND nt = 'ARRAY' THEN json_extract(payload, '$.new_value') END AS arr FROM rows) r,
        (SELECT unnest(range(0, 5)) AS pos) u WHERE r.arr IS NOT NULL AND u.pos < json_array_length(r.arr)),
    first_{name} AS (SELECT i.user_id, i.person_id, i.v, min(i.n * 10 + i.pos) AS o FROM item_{name} i LEFT JOIN cut_{name} c ON c.user_id = i.user_id AND c.person_id = i.person_id WHERE c.c IS NULL OR i.n >= c.c GROUP BY ALL),
    set_{name} AS (SELECT user_id, person_id, string_agg(v, ',' ORDER BY o) AS {name} FROM first_{name} GROUP BY ALL)"""


def _join(name: str) -> str:
    return f"LEFT JOIN set_{name} ON set_{name}.user_id = b.user_id AND set_{name}.person_id = b.person_id"


_FOLD = f"""SELECT * FROM (WITH {_ROWS}, {_set_plain('name')}, {_set_plain('category')}, {_set_plain('relationship_to_me')}, {_set_null('company')}, {_set_list('phones')}, {_set_list('emails')},
b AS (SELECT user_id, person_id, max(observed_at) AS u, count(*) FILTER (kind = 'interaction') AS activity_count,
      max(CASE WHEN kind = 'interaction' THEN n END) AS last_n FROM rows GROUP BY ALL)
SELECT b.user_id, b.person_id, set_name.name, set_company.company, set_category.category, coalesce(set_relationship_to_me.relationship_to_me, '') AS relationship_to_me,
       coalesce(set_phones.phones, '') AS phones, coalesce(set_emails.emails, '') AS emails, epoch_us(b.u) AS updated_at, b.activity_count,
       coalesce(nullif(r.payload->>'$.channel', ''), CASE WHEN b.last_n IS NOT NULL THEN 'interaction' END) AS last_type, coalesce(r.payload->>'$.title', r.payload->>'$.summary') AS last_title,
       cast(floor(epoch(TIMESTAMP '{AS_OF}' - r.observed_at) / 86400) AS bigint) AS days_ago
FROM b LEFT JOIN rows r ON r.user_id = b.user_id AND r.person_id = b.person_id AND r.n = b.last_n
{_join('name')} {_join('company')} {_join('category')} {_join('relationship_to_me')} {_join('phones')} {_join('emails')})"""


def folded(v):
    return cards.fold_person_cards(v("obs"), v("links"), AS_OF)


@Q.add("card_fold", _FOLD.replace("FROM obs o JOIN links l", "FROM {obs} o JOIN {links} l"))
def _(v):
    return folded(v).select("user_id", "person_id", "name", "company", "category", "relationship_to_me", joined("phones"), joined("emails"), us("updated_at"), "activity_count", F.col("last_activity.type").alias("last_type"), F.col("last_activity.title").alias("last_title"), "days_ago")


@Q.add("card_fold_by_days", _FOLD.replace("FROM obs o JOIN links l", "FROM {obs} o JOIN {links} l"))
def _(v):
    """Stored states, to which every batch adds only its own rows."""
    obs, links = v("obs"), v("links")
    versions = Versions(obs.sparkSession, f"{shared_dir(obs.sparkSession)}/cards-{uuid.uuid4().hex}")
    for k in range(3):
        states = cards.advance_cards(versions, obs.where(f"pmod(xxhash64(id), 3) = {k}"), links.where(f"pmod(xxhash64(observation_id), 3) = {k}"), f"day {k}")
    return cards.finish_cards(states, AS_OF).select("user_id", "person_id", "name", "company", "category", "relationship_to_me", joined("phones"), joined("emails"), us("updated_at"), "activity_count", F.col("last_activity.type").alias("last_type"), F.col("last_activity.title").alias("last_title"), "days_ago")


@Q.add("raw_event_ingest", """
SELECT user_id, source, source_event_id, body FROM (SELECT *, row_number() OVER (PARTITION BY user_id, source, source_event_id ORDER BY seq) AS n FROM {raw}) WHERE n = 1
AND (user_id, source, source_event_id) NOT IN (SELECT (user_id, source, source_event_id) FROM {raw} WHERE seq % 3 = 0 AND seq < 1000000000)""")
def _(v):
    new, _counts = intake.ingest_raw_events(v("raw").where("seq % 3 = 0 AND seq < 1000000000"), v("raw"))
    return new.select("user_id", "source", "source_event_id", "body")


@Q.add("raw_event_ingest_counts", "SELECT count(DISTINCT (user_id, source, source_event_id)) AS inserted, count(*) - count(DISTINCT (user_id, source, source_event_id)) AS duplicates FROM {raw}")
def _(v):
    return intake.ingest_raw_events(None, v("raw"))[1]


@Q.add("raw_event_validation", """
SELECT coalesce(reason, 'valid') AS reason, count(*) AS n, sum(length(body)) AS characters FROM (
 SELECT CASE WHEN seq % 50 = 0 THEN 'source' WHEN seq % 50 = 1 THEN 'occurred_at' WHEN seq % 50 = 2 THEN 'direction' WHEN seq % 50 = 3 THEN 'body_preview' END AS reason,
        CASE WHEN seq % 50 = 3 THEN repeat('x', 600) WHEN seq % 50 = 4 THEN repeat('y', 160) ELSE body END AS body FROM {raw}) GROUP BY 1""")
def _(v):
    k = F.col("seq") % 50
    rows = v("raw").select(
        "user_id", F.when(k == 0, "fax").otherwise(F.col("source")).alias("source"), "source_event_id", F.when(k != 1, F.col("occurred_at")).alias("occurred_at"),
        F.when(k == 2, "up").otherwise(F.col("direction")).alias("direction"), F.when(k == 3, F.repeat(F.lit("x"), 600)).when(k == 4, F.repeat(F.lit("y"), 300)).otherwise(F.col("body")).alias("body_preview"),
    )
    valid, rejected = intake.validate_raw_events(rows)
    both = valid.select(F.lit("valid").alias("reason"), "body_preview").unionByName(rejected.select("reason", "body_preview"))
    return both.groupBy("reason").agg(F.count("*").alias("n"), F.sum(F.length("body_preview")).alias("characters"))


@Q.add("observation_validation", """
SELECT coalesce(CASE WHEN seq % 40 = 0 THEN 'observer' WHEN seq % 40 = 1 THEN 'confidence' WHEN seq % 40 = 2 THEN 'evidence_pointer' WHEN seq % 40 = 3 THEN 'payload' END, 'valid') AS reason, kind, count(*) AS n FROM {obs} GROUP BY 1, 2""")
def _(v):
    k = F.col("seq") % 40
    rows = v("obs").withColumns({
        "observer": F.when(k != 0, F.lit("importer")), "confidence": F.when(k == 1, F.lit(1.5)).otherwise(F.lit(0.5)).cast("decimal(4,3)"), "reasoning": F.lit("from the table"),
        "evidence_pointer": F.when(k == 2, F.repeat(F.lit("p"), 513)).otherwise(F.col("evidence_pointer")), "payload": F.when(k == 3, F.lit("{}")).otherwise(F.col("payload")),
    })
    valid, rejected = intake.validate_observations(rows)
    both = valid.select(F.lit("valid").alias("reason"), "kind").unionByName(rejected.select("reason", "kind"))
    return both.groupBy("reason", "kind").agg(F.count("*").alias("n"))


_KEY = """sha256(kind || ':' || evidence_pointer || ':' || CASE WHEN kind = 'correction' THEN coalesce(payload->>'$.target_person_id', '') || ':' || coalesce(payload->>'$.field', '') || ':' || coalesce(payload->>'$.new_value', '') ELSE '' END)"""


@Q.add("observation_ingest", f"""
SELECT user_id, dedup_key, arg_min(id, seq) AS id FROM (SELECT *, {_KEY} AS dedup_key FROM {{obs}}) GROUP BY user_id, dedup_key""")
def _(v):
    new, _counts = intake.ingest_observations(None, v("obs"))
    return new.select("user_id", "dedup_key", "id")


@Q.add("interaction_projection", """
SELECT user_id, 'whatsapp://message/' || source_event_id AS evidence_pointer, CASE WHEN sender_name IS NULL OR sender_name = 'me' THEN phone ELSE sender_name END AS peer,
       CASE WHEN direction = 'out' THEN 'Outbound' ELSE 'Inbound' END || ' WhatsApp message: ' || coalesce(nullif(body, ''), '(no preview)') AS summary
FROM {events_once} WHERE source = 'whatsapp' AND phone IS NOT NULL AND thread_id NOT LIKE '%@g.us'""")
def _(v):
    return intake.project_interactions(v("events_once")).select("user_id", "evidence_pointer", "peer", "summary")


@Q.add("message_projection", """
SELECT 'c' || cast(conv_id AS varchar) || '|' || cast(turn AS varchar) AS source_event_id, CASE WHEN role = 'user' THEN 'in' ELSE 'out' END AS direction, turn * 1000000 AS occurred_at,
       substr(coalesce(nullif(text, ''), 'shown'), 1, 160) AS body_preview, CASE WHEN role = 'user' AND conv_id % 2 = 0 THEN '+' || cast(91000 + conv_id AS varchar) ELSE '' END AS phones FROM {conversations}""")
def _(v):
    jid = F.when(F.col("conv_id") % 2 == 0, F.concat((F.col("conv_id") + 91000).cast("string"), F.lit("@s.whatsapp.net"))).otherwise(F.concat(F.col("conv_id").cast("string"), F.lit("@lid")))
    rows = v("conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("chat_jid"), F.col("turn").cast("string").alias("msg_id"), jid.alias("sender_jid"), F.lit("N").alias("sender_name"), F.col("turn").alias("ts"),
        F.when(F.col("role") == "user", 0).otherwise(1).alias("from_me"), "text", F.lit("shown").alias("display_text"), F.lit(None).cast("string").alias("media_caption"), F.lit(None).cast("string").alias("media_type"),
    )
    return intake.messages_to_raw_events(rows).select("source_event_id", "direction", us("occurred_at"), "body_preview", F.array_join("participant_phones", ",").alias("phones"))


@Q.add("projection_stats", """
SELECT r.user_id, CASE WHEN thread_id LIKE '%@g.us' THEN 'group' WHEN r.phone IS NULL THEN 'no_phone' WHEN r.phone = '+919000000008' THEN 'self' WHEN pm.phone IS NULL THEN 'unresolved' ELSE 'projected' END AS reason, count(*) AS count
FROM {raw} r LEFT JOIN (SELECT DISTINCT user_id, '+' || phone AS phone FROM {bridge}) pm ON pm.user_id = r.user_id AND pm.phone = r.phone GROUP BY 1, 2""")
def _(v):
    known = v("bridge").select("user_id", F.concat(F.lit("+"), "phone").alias("phone")).distinct()
    return intake.projection_stats(v("raw"), known, "+919000000008")


@Q.add("lid_bridge_upsert", """
SELECT user_id, lid, arg_max(phone, seq) AS phone, epoch_us(max(last_seen)) AS last_seen FROM (
  SELECT user_id, lid, phone, last_seen, -1 AS seq FROM {bridge}
  UNION ALL SELECT user_id, trim(split_part(jid, '@', 1)), '91' || cast(seq % 5 AS varchar), occurred_at, seq FROM {raw} WHERE jid LIKE '%@lid' AND seq % 2 = 1) GROUP BY 1, 2""")
def _(v):
    batch = v("raw").where("jid LIKE '%@lid' AND seq % 2 = 1").select("user_id", F.concat(F.lit(" "), F.split_part("jid", F.lit("@"), F.lit(1))).alias("lid"), F.concat(F.lit("91"), (F.col("seq") % 5).cast("string")).alias("phone"), F.col("occurred_at").alias("last_seen"), "seq")
    return intake.upsert_lid_bridge(v("bridge"), batch).select("user_id", "lid", "phone", us("last_seen"))


@Q.add("topic_replacement", """
SELECT user_id, person_id, topic, weight FROM (SELECT *, row_number() OVER (PARTITION BY user_id, person_id, topic ORDER BY seq DESC) AS n FROM {topics} WHERE seq % 20 < 10) WHERE n = 1
UNION ALL SELECT user_id, person_id, topic, weight FROM (SELECT *, row_number() OVER (PARTITION BY user_id, person_id, topic ORDER BY seq DESC) AS n FROM {topics} WHERE seq % 20 >= 10) WHERE n = 1
AND (user_id, person_id) NOT IN (SELECT (user_id, person_id) FROM {topics} WHERE seq % 20 < 10)""")
def _(v):
    old = intake.replace_topics(None, v("topics").where("seq % 20 >= 10"))
    return intake.replace_topics(old, v("topics").where("seq % 20 < 10").withColumn("topic", F.concat(F.lit(" "), F.upper("topic"))))


@Q.add("meeting_upsert", """
SELECT user_id, meeting_id, arg_max(title, seq) AS title, epoch_us(arg_max(start_at, seq)) AS start_at, arg_max(brief_md, CASE WHEN brief_md <> '' THEN seq END) AS brief_md FROM {meetings} GROUP BY 1, 2""")
def _(v):
    rows = v("meetings").withColumn("end_at", F.col("start_at"))
    both = intake.upsert_meetings(None, rows)
    return both.select("user_id", "meeting_id", "title", us("start_at"), "brief_md")


@Q.add("snapshot_append", """
SELECT s.user_id, s.person_id, s.id FROM {snaps} s JOIN {persons} p ON p.user_id = s.user_id AND p.id = s.person_id WHERE s.pass_kind <> 'resolver'""")
def _(v):
    rows = v("snaps").withColumns({"card_state": F.lit(None).cast("string"), "diff_summary": F.lit(None).cast("string"), "pass_kind": F.when(F.col("pass_kind") == "resolver", "other").otherwise(F.col("pass_kind"))})
    return intake.append_snapshots(None, rows, v("persons")).select("user_id", "person_id", "id")


_EVENTS = """
SELECT user_id, payload->>'$.person_id' AS person_id, unnest(list_append(from_json(payload->'$.merged_observation_ids', '["VARCHAR"]'), id)) AS observation_id, 'add' AS op, seq, id AS "by" FROM {merge_obs} WHERE kind = 'merge'
UNION ALL SELECT user_id, payload->>'$.person_id', unnest(from_json(payload->'$.split_off_observation_ids', '["VARCHAR"]')), 'remove', seq, id FROM {merge_obs} WHERE kind = 'split'"""


@Q.add("link_events", _EVENTS + " UNION ALL SELECT user_id, payload->>'$.target_person_id', id, 'add', seq, id FROM {order_obs}")
def _(v):
    rows = v("merge_obs").select("user_id", "id", "kind", "payload", "seq").unionByName(v("order_obs").select("user_id", "id", "kind", "payload", "seq"))
    return links.link_events(rows)


@Q.add("link_replay", f"""
SELECT user_id, person_id, observation_id, arg_min("by", seq) AS linked_by_observation_id, min(seq) AS linked_seq FROM (
  SELECT *, max(CASE WHEN op = 'remove' THEN seq END) OVER (PARTITION BY user_id, person_id, observation_id) AS gone FROM ({_EVENTS})) WHERE op = 'add' AND (gone IS NULL OR seq > gone) GROUP BY 1, 2, 3""")
def _(v):
    return links.resolve_links(links.link_events(v("merge_obs")))


@Q.add("person_materialization", "SELECT user_id, payload->>'$.person_id' AS id, min(seq) AS created_seq FROM {merge_obs} WHERE kind = 'merge' GROUP BY 1, 2")
def _(v):
    return links.materialize_persons(v("merge_obs"))


_HANDLES = """SELECT user_id, id, observed_at, seq, 'phone:' || unnest(from_json(payload->'$.phones', '["VARCHAR"]')) AS handle FROM {person_obs}
UNION ALL SELECT user_id, id, observed_at, seq, 'email:' || lower(unnest(from_json(payload->'$.emails', '["VARCHAR"]'))) FROM {person_obs}"""


@Q.add("merge_building", f"""
SELECT user_id, id, bridges, 'merge://' || replace(bridges, ',', '+') || CASE WHEN n = 1 THEN '' ELSE '#' || id END AS evidence_pointer FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, bridges ORDER BY id) AS n FROM (SELECT user_id, id, string_agg(DISTINCT handle, ',' ORDER BY handle) AS bridges FROM ({_HANDLES}) GROUP BY 1, 2))""")
def _(v):
    return links.build_merges(v("person_obs")).select("user_id", "id", joined("bridges"), "evidence_pointer")


@Q.add("bridge_aware_persons", f"""
SELECT user_id, id, CASE WHEN n = 1 THEN p WHEN n = 0 THEN 'new' ELSE 'conflict' END AS person_id FROM (
 SELECT h.user_id, h.id, count(DISTINCT b.person_id) AS n, min(b.person_id) AS p FROM ({_HANDLES}) h LEFT JOIN (SELECT user_id, 'phone:+' || phone AS handle, 'L' || lid AS person_id FROM {{bridge}}) b ON b.user_id = h.user_id AND b.handle = h.handle GROUP BY 1, 2)""")
def _(v):
    index = v("bridge").select("user_id", F.concat(F.lit("phone:+"), "phone").alias("handle"), F.concat(F.lit("L"), "lid").alias("person_id"))
    merges, conflicts = links.assign_person_ids(v("person_obs"), index)
    one = merges.select("user_id", "id", F.when(F.col("is_new"), "new").otherwise(F.col("person_id")).alias("person_id"))
    return one.unionByName(conflicts.select("user_id", "id", F.lit("conflict").alias("person_id")))


@Q.add("autolinked_persons", f"""
SELECT user_id, person_id, id AS observation_id FROM (WITH RECURSIVE h AS ({_HANDLES}), own AS (SELECT l.user_id, l.observation_id AS id, l.person_id FROM {{links}} l JOIN {{person_obs}} o ON o.user_id = l.user_id AND o.id = l.observation_id WHERE l.observation_id LIKE 'p%' AND o.payload->>'$.company' IS NOT NULL),
 r(round, user_id, id, person_id) AS (SELECT 0, user_id, id, person_id FROM own
  UNION ALL SELECT round, user_id, id, person_id FROM (SELECT q.round + 1 AS round, f.user_id, f.id, arg_min(q.person_id, (q.observed_at, q.id, q.person_id)) AS person_id FROM (SELECT r.round, r.user_id, h.handle, h.observed_at, r.id, r.person_id FROM r JOIN h ON h.user_id = r.user_id AND h.id = r.id WHERE r.round < 12) q
   JOIN h f ON f.user_id = q.user_id AND f.handle = q.handle WHERE (f.user_id, f.id) NOT IN (SELECT (user_id, id) FROM own) GROUP BY 1, 2, 3))
 SELECT user_id, id, person_id, round, row_number() OVER (PARTITION BY user_id, id ORDER BY round) AS n FROM r) WHERE n = 1 AND round > 0""")
def _(v):
    """Persons of observations that name a company are known; others take theirs by a shared handle, and so on."""
    known = v("links").join(v("person_obs").where("get_json_object(payload, '$.company') IS NOT NULL").select("user_id", F.col("id").alias("observation_id")), ["user_id", "observation_id"], "left_semi").where("observation_id LIKE 'p%'")
    return links.autolink_persons(v("person_obs"), known).select("user_id", "person_id", "observation_id")


@Q.add("provenance_wipe", """
SELECT p.user_id, p.id FROM {persons} p WHERE (p.user_id, p.id) NOT IN (SELECT (user_id, person_id) FROM {links}) OR (p.user_id, p.id) IN (
 SELECT (l.user_id, l.person_id) FROM {links} l JOIN {obs} o ON o.id = l.observation_id WHERE o.evidence_pointer NOT LIKE 'csv://%')""")
def _(v):
    return links.wipe_provenance(v("obs"), v("links"), v("persons"), ["csv://"])[2]


@Q.add("orphan_observations", "SELECT id, kind FROM {person_obs} WHERE id NOT IN (SELECT observation_id FROM {links} WHERE length(observation_id) % 2 = 0)")
def _(v):
    return links.orphan_observations(v("person_obs"), v("links").where("length(observation_id) % 2 = 0")).select("id", "kind")


@Q.add("card_rows", """
SELECT user_id, person_id, id, kind FROM (SELECT l.user_id, l.person_id, o.id, o.kind, row_number() OVER (PARTITION BY l.user_id, l.person_id, o.kind ORDER BY o.observed_at DESC, o.id DESC) AS n
 FROM {obs} o JOIN {links} l ON l.user_id = o.user_id AND l.observation_id = o.id) WHERE n <= 2 OR kind IN ('person', 'correction')""")
def _(v):
    return cards.card_rows(v("obs"), v("links"), 2).select("user_id", "person_id", "id", "kind")


@Q.add("card_documents", """
SELECT user_id, person_id, name, total, epoch_us(last_touch) AS last_touch, least(ni, 20) AS interactions, least(nn, 10) AS notes, least(nc, 10) AS corrections FROM (
 SELECT l.user_id, l.person_id, count(*) AS total, count(*) FILTER (o.kind = 'interaction') AS ni, count(*) FILTER (o.kind = 'note') AS nn, count(*) FILTER (o.kind = 'correction') AS nc,
        max(o.observed_at) FILTER (o.kind = 'interaction') AS last_touch, arg_max(o.payload->>'$.name', (o.observed_at, o.id)) FILTER (o.kind = 'person') AS name
 FROM {obs} o JOIN {links} l ON l.user_id = o.user_id AND l.observation_id = o.id GROUP BY 1, 2)""")
def _(v):
    made = cards.assemble_cards(cards.card_rows(v("obs"), v("links"), 50))
    return made.select("user_id", "person_id", "name", "total", us("last_touch"), F.size("interactions").cast("long").alias("interactions"), F.size("recent_notes").cast("long").alias("notes"), F.size("recent_corrections").cast("long").alias("corrections"))


_CARDS = """SELECT user_id, person_id, arg_max(payload->>'$.name', (observed_at, id)) AS name, arg_max(payload->>'$.category', (observed_at, id)) AS category,
 arg_max(payload->>'$.emails', (observed_at, id)) AS emails FROM (SELECT o.*, l.person_id FROM {person_obs} o JOIN {links} l ON l.user_id = o.user_id AND l.observation_id = o.id) GROUP BY 1, 2"""


def _person_cards(v):
    """Cards from person rows alone."""
    return cards.fold_person_cards(v("obs").where("kind = 'person'"), v("links"), AS_OF)


@Q.add("enriched_persons", "SELECT user_id, person_id FROM (" + _FOLD.replace("FROM obs o JOIN links l", "FROM {obs} o JOIN {links} l") + ") WHERE coalesce(category, 'other') <> 'other' OR (relationship_to_me <> '' AND relationship_to_me NOT LIKE 'Appears in%')")
def _(v):
    return cards.enriched_persons(folded(v)).select("user_id", "person_id")


@Q.add("person_search", f"SELECT person_id, name FROM ({_CARDS}) WHERE contains(lower(name), 'customer#00000001') ORDER BY name NULLS LAST, person_id LIMIT 25")
def _(v):
    return cards.search_persons(_person_cards(v), name="CUSTOMER#00000001", limit=25).select("person_id", "name")


@Q.add("name_prefix_match", f"""
SELECT user_id, query, person_id, rank FROM (SELECT c.user_id, q.query, c.person_id, row_number() OVER (PARTITION BY c.user_id, q.query ORDER BY c.name, c.person_id) AS rank
 FROM ({_CARDS}) c JOIN (SELECT DISTINCT 't' || cast(n_nationkey % 3 AS varchar) AS user_id, 'customer#0000' || lpad(cast(n_nationkey AS varchar), 3, '0') AS query FROM {{nation}}) q ON q.user_id = c.user_id
 WHERE lower(c.name) LIKE q.query || '%' OR lower(c.name) LIKE '% ' || q.query || '%') WHERE rank <= 8""")
def _(v):
    asked = v("nation").selectExpr("'t' || cast(n_nationkey % 3 AS string) AS user_id", "'Customer#0000' || lpad(cast(n_nationkey AS string), 3, '0') AS query")
    return cards.match_by_prefix(_person_cards(v), asked).select("user_id", "query", "person_id", F.col("rank").cast("long").alias("rank"))


@Q.add("persons_by_email", f"""
SELECT h.user_id, substr(h.handle, 7) AS email, min(l.person_id) AS person_id FROM ({_HANDLES}) h JOIN {{links}} l ON l.user_id = h.user_id AND l.observation_id = h.id
WHERE h.handle LIKE 'email:%' AND substr(h.handle, 7) IN (SELECT 'u' || cast(s_suppkey AS varchar) || '@mail' || cast(s_suppkey % 7 AS varchar) || '.test' FROM {{supplier}}) GROUP BY 1, 2""")
def _(v):
    mail = F.concat(F.lit(" U"), F.col("s_suppkey").cast("string"), F.lit("@mail"), (F.col("s_suppkey") % 7).cast("string"), F.lit(".test"))
    tenants = v("persons").select("user_id").distinct()
    asked = v("supplier").select(mail.alias("email")).join(tenants, F.lit(True))  # each address for each of the few tenants
    return cards.persons_by_email(_person_cards(v), asked)


@Q.add("top_topics", "SELECT user_id, person_id, topic, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, person_id ORDER BY weight DESC, topic) AS rank FROM (SELECT DISTINCT user_id, person_id, topic, weight FROM {topics})) WHERE rank <= 2")
def _(v):
    rows = v("topics").select("user_id", "person_id", "topic", "weight").distinct()
    return cards.top_topics(rows, 2).select("user_id", "person_id", "topic", "weight", F.col("rank").cast("long").alias("rank"))


@Q.add("snapshot_history", "SELECT user_id, person_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, person_id ORDER BY pass_at DESC, id DESC) AS rank FROM {snaps}) WHERE rank <= 3")
def _(v):
    return cards.snapshot_history(v("snaps"), 3).select("user_id", "person_id", "id", F.col("rank").cast("long").alias("rank"))


@Q.add("latest_summary", "SELECT user_id, person_id, arg_max(id, (pass_at, id)) AS id FROM {snaps} WHERE pass_kind = 'summary' GROUP BY 1, 2")
def _(v):
    return cards.latest_summary(v("snaps")).select("user_id", "person_id", "id")


@Q.add("field_corrections", f"""
SELECT c.user_id, c.person_id, f.field, CASE f.field WHEN 'name' THEN c.name ELSE c.category END AS old_value, f.new_value FROM ({_CARDS}) c JOIN (
 SELECT user_id, id, 'category' AS field, 'team' AS new_value FROM {{persons}} UNION ALL SELECT user_id, id, 'name', 'Customer#' || lpad(substr(id, 2), 9, '0') FROM {{persons}}) f ON f.user_id = c.user_id AND f.id = c.person_id
WHERE f.new_value IS DISTINCT FROM CASE f.field WHEN 'name' THEN c.name ELSE c.category END""")
def _(v):
    fields = F.create_map(F.lit("category"), F.lit("team"), F.lit("name"), F.concat(F.lit("Customer#"), F.lpad(F.substring("id", 2, 20), 9, "0")))
    patches = v("persons").select("user_id", F.col("id").alias("person_id"), fields.alias("fields"))
    return intake.patches_to_corrections(patches, _person_cards(v)).select("user_id", "person_id", "field", "old_value", "new_value")
