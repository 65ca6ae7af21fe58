"""Pages, activity, meetings, messages and reports over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tieledger.operators import activity, identity, links, metrics

from tieledger.plans.adapters import AS_OF
from tieledger.plans.ledger_queries import _person_cards
from tieledger.plans.registry import Registry, joined, r6, us

Q = Registry()

@Q.add("observation_page", "SELECT id, epoch_us(observed_at) AS observed_at FROM {obs} WHERE kind = 'interaction' AND (observed_at, id) < (TIMESTAMP '2024-01-05 00:05:00', 'o0') ORDER BY observed_at DESC, id DESC LIMIT 100")
def _(v):
    return activity.observations_page(v("obs"), kind="interaction", cursor=("2024-01-05 00:05:00", "o0"), limit=100).select("id", us("observed_at"))


@Q.add("raw_event_page", "SELECT source_event_id AS id, epoch_us(occurred_at) AS occurred_at FROM {events_once} WHERE source = 'whatsapp' AND (occurred_at, source_event_id) > (TIMESTAMP '2024-01-10 00:00:00', 'm0') ORDER BY occurred_at, source_event_id LIMIT 200")
def _(v):
    rows = v("events_once").withColumnRenamed("source_event_id", "id")
    return activity.raw_events_page(rows, "whatsapp", ("2024-01-10 00:00:00", "m0"), 200).select("id", us("occurred_at"))


@Q.add("person_page", "SELECT user_id, id FROM {persons} WHERE id > 'P12' ORDER BY id LIMIT 50")
def _(v):
    return activity.persons_page(v("persons"), "P12", 50)


@Q.add("active_since", f"""
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.person_id, b.person_id) AS person_id, epoch_us(greatest(a.m, b.m)) AS last_activity_at, coalesce(a.n, 0) + coalesce(b.n, 0) AS activity_count FROM (
 SELECT l.user_id, l.person_id, max(o.observed_at) AS m, count(*) AS n FROM {{obs}} o JOIN {{links}} l ON l.user_id = o.user_id AND l.observation_id = o.id WHERE o.observed_at >= TIMESTAMP '2024-01-05 00:10:00' GROUP BY 1, 2) a
FULL JOIN (SELECT user_id, person_id, max(pass_at) AS m, count(*) AS n FROM {{snaps}} WHERE pass_at >= TIMESTAMP '2024-01-05 00:10:00' GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.person_id = b.person_id
WHERE (coalesce(a.user_id, b.user_id), coalesce(a.person_id, b.person_id)) NOT IN (SELECT (user_id, person_id) FROM {{snaps}} WHERE pass_kind = 'summary' AND pass_at > TIMESTAMP '2024-02-08 00:10:00' - INTERVAL 7 DAY)""")
def _(v):
    rows = activity.persons_active_since(v("obs"), v("links"), v("snaps"), "2024-01-05 00:10:00", True, "2024-02-08 00:10:00")
    return rows.select("user_id", "person_id", us("last_activity_at"), "activity_count")


@Q.add("stale_persons", """
SELECT user_id, person_id, epoch_us(newest) AS newest, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY newest NULLS FIRST, person_id) AS rank FROM (
 SELECT p.user_id, p.id AS person_id, max(o.observed_at) AS newest FROM {persons} p LEFT JOIN {links} l ON l.user_id = p.user_id AND l.person_id = p.id LEFT JOIN {person_obs} o ON o.user_id = l.user_id AND o.id = l.observation_id GROUP BY 1, 2)
 WHERE newest IS NULL OR newest < TIMESTAMP '2024-01-16 00:00:00' - INTERVAL 14 DAY) WHERE rank <= 40""")
def _(v):
    rows = activity.stale_persons(v("persons"), v("obs"), v("links"), "2024-01-16 00:00:00", most=40)
    return rows.select("user_id", "person_id", us("newest"), F.col("rank").cast("long").alias("rank"))


@Q.add("tick_tenants", """
SELECT r.user_id, epoch_us(r.newest) AS newest FROM (SELECT user_id, max(occurred_at) AS newest FROM {raw} GROUP BY 1) r LEFT JOIN (SELECT user_id, min(occurred_at) + INTERVAL 60 DAY AS w FROM {raw} WHERE user_id = 't1' GROUP BY 1) w ON w.user_id = r.user_id
WHERE w.w IS NULL OR r.newest > w.w""")
def _(v):
    raw = v("raw").withColumn("ingested_at", F.col("occurred_at"))
    marks = raw.where("user_id = 't1'").groupBy("user_id").agg((F.min("occurred_at") + F.expr("INTERVAL 60 DAYS")).alias("last_tick_at"))
    return activity.tick_tenants(raw, marks, AS_OF).select("user_id", us("newest"))


@Q.add("upcoming_meetings", "SELECT user_id, meeting_id, seq, epoch_us(start_at) AS start_at FROM {meetings} WHERE start_at >= TIMESTAMP '2024-02-19 00:10:00' AND start_at < TIMESTAMP '2024-02-19 00:10:00' + INTERVAL 1 HOUR")
def _(v):
    return activity.upcoming_meetings(v("meetings"), 1, "2024-02-19 00:10:00").select("user_id", "meeting_id", "seq", us("start_at"))


@Q.add("sender_names", """
SELECT sender_jid, name, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY sender_jid ORDER BY n DESC, newest DESC, name) AS rank FROM (SELECT sender_jid, sender_name AS name, count(*) AS n, max(ts) AS newest FROM {chat} GROUP BY 1, 2)) WHERE rank <= 3""")
def _(v):
    return activity.sender_names(v("chat")).select("sender_jid", "name", "n", F.col("rank").cast("long").alias("rank"))


@Q.add("person_messages", """
SELECT user_id, person_id, ts, text, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, person_id ORDER BY ts DESC, text) AS rank FROM (
 SELECT p.user_id, p.id AS person_id, c.ts, min(c.text) AS text FROM (SELECT turn + conv_id * 100 AS ts, text, CASE WHEN conv_id % 3 = 0 THEN cast(919000000000 + conv_id AS varchar) || '@s.whatsapp.net' WHEN turn % 2 = 0 THEN cast(conv_id AS varchar) || '@lid' ELSE cast(919000000000 + conv_id AS varchar) || '@s.whatsapp.net' END AS jid FROM {conversations}) c
 JOIN (SELECT user_id, id, cast(919000000000 + cast(substr(id, 2) AS bigint) AS varchar) AS digits FROM {persons}) p ON c.jid = p.digits || '@s.whatsapp.net' OR c.jid = (SELECT max(lid) FROM {lid_map} WHERE pn = p.digits) || '@lid' GROUP BY 1, 2, 3, substr(c.text, 1, 40))) WHERE rank <= 3""")
def _(v):
    """A third of the chats are direct; in the others senders go by a device id or a phone."""
    phone = F.concat((F.col("conv_id") + 919000000000).cast("string"), F.lit("@s.whatsapp.net"))
    direct = F.col("conv_id") % 3 == 0
    chats = v("conversations").select(F.when(direct, phone).otherwise("club@g.us").alias("chat_jid"), F.when(F.col("turn") % 2 == 0, F.concat(F.col("conv_id").cast("string"), F.lit(":7@lid"))).otherwise(phone).alias("sender_jid"), (F.col("turn") + F.col("conv_id") * 100).alias("ts"), "text")
    own = v("persons").select("user_id", F.col("id").alias("person_id"), F.array(F.concat(F.lit("+"), (F.expr("substring(id, 2)").cast("long") + 919000000000).cast("string"))).alias("phones"))
    return activity.person_messages(own, chats, v("lid_map"), limit=3).select("user_id", "person_id", "ts", "text", F.col("rank").cast("long").alias("rank"))


@Q.add("message_filter_counts", """
SELECT count(*) AS total, count(*) FILTER (b) AS business_filtered, count(*) FILTER (NOT b AND s) AS spam_filtered, count(*) FILTER (NOT b AND NOT s) AS kept FROM (
 SELECT ts % 5 = 0 AS b, ts % 3 = 0 AS s FROM {chat})""")
def _(v):
    jid = F.when(F.col("ts") % 5 == 0, F.concat("chat_jid", F.lit("@broadcast"))).otherwise(F.col("chat_jid"))
    text = F.when(F.col("ts") % 3 == 0, F.concat(F.lit("Your OTP is 4711. "), "text")).otherwise(F.col("text"))
    return activity.filter_messages(v("chat").withColumns({"chat_jid": jid, "text": text}))[1]


@Q.add("dm_quality", """
SELECT chat_jid, round((0.3 + 0.7 * least(own, n - own) / greatest(own, n - own)) * (0.5 + 0.5 * t / n), 6) AS quality FROM (
 SELECT chat_jid, count(*) AS n, count(*) FILTER (from_me = 1) AS own, count(*) FILTER (length(text) % 3 <> 0) AS t FROM {chat} GROUP BY 1)""")
def _(v):
    rows = v("chat").withColumn("text", F.when(F.length("text") % 3 != 0, F.col("text")))
    return metrics.dm_quality(rows).select("chat_jid", r6("quality"))


@Q.add("rule_topics", """
SELECT user_id, person_id, token, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, person_id ORDER BY n DESC, token) AS rank FROM (
 SELECT 't' AS user_id, sender_jid AS person_id, token, count(*) AS n FROM (SELECT sender_jid, unnest(regexp_extract_all(lower(text), '[a-zäöüßéèêçñíóúáà]{4,}')) AS token FROM {chat}) WHERE token NOT IN ('with', 'that', 'this', 'sich', 'dans') GROUP BY 1, 2, 3)) WHERE rank <= 10""")
def _(v):
    rows = v("chat").select(F.lit("t").alias("user_id"), F.col("sender_jid").alias("person_id"), "text")
    stop = v("chat").limit(1).select(F.explode(F.array(*map(F.lit, ("with", "that", "this", "sich", "dans")))).alias("token"))
    return metrics.rule_topics(rows, stop).select("user_id", "person_id", "token", "n", F.col("rank").cast("long").alias("rank"))


@Q.add("channel_stats", """
SELECT r.user_id, p.id AS person_id, r.source AS channel, count(*) AS message_count, epoch_us(min(occurred_at)) AS first_at, epoch_us(max(occurred_at)) AS last_at, count(*) FILTER (direction = 'out') AS outgoing,
 round(count(*) FILTER (direction = 'out') / count(*), 2) AS reply_ratio, arg_max(body, (occurred_at, source_event_id)) AS last_preview FROM {events_once} r JOIN {persons} p ON p.user_id = r.user_id AND r.phone = '+' || cast(919000000000 + cast(substr(p.id, 2) AS bigint) AS varchar) GROUP BY 1, 2, 3""")
def _(v):
    phone = F.concat(F.lit("+"), (F.substring("id", 2, 20).cast("long") + 919000000000).cast("string"))
    rows = metrics.channel_stats(v("events_once"), v("persons").select("user_id", F.col("id").alias("person_id"), phone.alias("phone")), AS_OF)
    return rows.select("user_id", "person_id", "channel", "message_count", us("first_at"), us("last_at"), "outgoing", "reply_ratio", "last_preview")


@Q.add("thread_concentration", """
SELECT user_id, count(*) FILTER (run - n < 0.5 * total) AS threads_50, count(*) FILTER (run - n < 0.8 * total) AS threads_80, round(count(*) FILTER (n = 1) / count(*), 6) AS single_share FROM (
 SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY n DESC, thread_id ROWS UNBOUNDED PRECEDING) AS run, sum(n) OVER (PARTITION BY user_id) AS total FROM (SELECT user_id, thread_id, count(*) AS n FROM {events_once} WHERE thread_id IS NOT NULL GROUP BY 1, 2)) GROUP BY 1""")
def _(v):
    return metrics.thread_concentration(v("events_once")).select("user_id", "threads_50", "threads_80", r6("single_share"))


@Q.add("thread_interactions", "SELECT 't' || cast(l_partkey % 3 AS varchar) AS user_id, 'g' || cast(l_partkey AS varchar) AS thread_id, string_agg(DISTINCT 'S' || cast(l_suppkey AS varchar), ',' ORDER BY 'S' || cast(l_suppkey AS varchar)) AS participants, count(DISTINCT l_suppkey) AS message_count FROM {lineitem} GROUP BY 1, 2")
def _(v):
    rows = v("group_members").withColumnRenamed("last_at", "occurred_at")
    return metrics.thread_interactions(rows).select("user_id", "thread_id", joined("participants"), "message_count")


_P = "(SELECT l.user_id, l.person_id, o.observed_at, o.id, o.payload->>'$.category' AS category FROM {person_obs} o JOIN {links} l ON l.user_id = o.user_id AND l.observation_id = o.id)"


@Q.add("category_distribution", f"SELECT user_id, category, count(*) AS n FROM (SELECT user_id, person_id, arg_max(coalesce(category, '__none__'), (observed_at, id)) AS category FROM {_P} GROUP BY 1, 2) GROUP BY 1, 2")
def _(v):
    return metrics.category_distribution(v("obs"), v("links"))


@Q.add("promoted_persons", f"SELECT user_id, person_id, \"now\", was FROM (SELECT user_id, person_id, max(category) FILTER (n = 1) AS \"now\", max(category) FILTER (n = 2) AS was FROM (SELECT *, row_number() OVER (PARTITION BY user_id, person_id ORDER BY observed_at DESC, id DESC) AS n FROM {_P}) GROUP BY 1, 2) WHERE was = 'other' AND \"now\" <> 'other'")
def _(v):
    return metrics.promoted_persons(v("obs"), v("links"))


_METRICS = """SELECT user_id, 'observations:' || kind AS metric, count(*) AS n FROM {obs} GROUP BY 1, 2 UNION ALL SELECT user_id, 'persons', count(*) FROM {persons} GROUP BY 1 UNION ALL SELECT user_id, 'links', count(*) FROM {links} GROUP BY 1
UNION ALL SELECT user_id, 'persons_without_rows', count(*) FROM {persons} WHERE (user_id, id) NOT IN (SELECT (l.user_id, l.person_id) FROM {links} l JOIN {person_obs} o ON o.id = l.observation_id) GROUP BY 1"""


@Q.add("ledger_metrics", _METRICS)
def _(v):
    return metrics.ledger_metrics(v("obs"), v("links"), v("persons"))


@Q.add("run_delta", f"SELECT a.user_id, a.metric, coalesce(b.n, 0) AS before, a.n AS after, a.n - coalesce(b.n, 0) AS change FROM ({_METRICS}) a LEFT JOIN (SELECT user_id, 'observations:person' AS metric, count(*) AS n FROM {{person_obs}} WHERE substr(id, 1, 1) = 'p' GROUP BY 1) b ON a.user_id = b.user_id AND a.metric = b.metric")
def _(v):
    before = v("person_obs").where("substr(id, 1, 1) = 'p'").groupBy("user_id").agg(F.count("*").alias("n")).withColumn("metric", F.lit("observations:person"))
    return metrics.run_delta(before, metrics.ledger_metrics(v("obs"), v("links"), v("persons")))


@Q.add("name_quality", """
SELECT user_id, quality, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 6) AS share FROM (
 SELECT user_id, CASE WHEN regexp_matches(name, '^\\+?\\d{6,}$') THEN 'phone_as_name' ELSE 'real' END AS quality FROM (SELECT l.user_id, l.person_id, arg_max(o.payload->>'$.name', (o.observed_at, o.id)) AS name FROM {person_obs} o JOIN {links} l ON l.user_id = o.user_id AND l.observation_id = o.id GROUP BY 1, 2)) GROUP BY 1, 2""")
def _(v):
    return metrics.name_quality(_person_cards(v)).select("user_id", "quality", "n", r6("share"))


@Q.add("duplicate_handles", """
SELECT user_id, phone, count(DISTINCT person_id) AS persons FROM (SELECT l.user_id, l.person_id, unnest(from_json(o.payload->'$.phones', '["VARCHAR"]')) AS phone FROM {person_obs} o JOIN {links} l ON l.user_id = o.user_id AND l.observation_id = o.id) GROUP BY 1, 2 HAVING count(DISTINCT person_id) > 1""")
def _(v):
    return metrics.duplicate_handles(_person_cards(v))


@Q.add("topic_merge", """
SELECT user_id, person_id, topic, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, person_id ORDER BY weight DESC, topic) AS rank FROM (
 SELECT user_id, person_id, topic, round(w / max(w) OVER (PARTITION BY user_id, person_id), 6) AS weight FROM (SELECT user_id, person_id, topic, sum(weight) AS w FROM {topics} GROUP BY 1, 2, 3 HAVING sum(weight) > 0)) WHERE weight >= 0.15) WHERE rank <= 20""")
def _(v):
    rows = v("topics").where("weight > 0")
    return metrics.merge_topics(rows).select("user_id", "person_id", "topic", r6("weight"), F.col("rank").cast("long").alias("rank"))


@Q.add("topic_histogram", """
SELECT user_id, CASE WHEN n = 0 THEN '0' WHEN n <= 3 THEN '1-3' WHEN n <= 6 THEN '4-6' WHEN n <= 10 THEN '7-10' WHEN n <= 15 THEN '11-15' ELSE '16+' END AS bucket, count(*) AS persons FROM (
 SELECT p.user_id, p.id, count(t.topic) AS n FROM {persons} p LEFT JOIN {topics} t ON t.user_id = p.user_id AND t.person_id = p.id GROUP BY 1, 2) GROUP BY 1, 2""")
def _(v):
    return metrics.topic_summary(v("persons").withColumnRenamed("id", "person_id"), v("topics"))[1]


@Q.add("contact_rollup", """
SELECT user_id, name, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS interactions, round(sum(score) + least(count(*) * 0.02, 1), 6) AS score FROM (
 SELECT user_id, coalesce(sender_name, 'unknown') AS name, CASE source WHEN 'whatsapp' THEN 'dm' ELSE source END AS source, cast(seq % 7 AS double) / 10 AS score FROM {events_once}) GROUP BY 1, 2 HAVING count(DISTINCT source) > 1 OR min(source) <> 'dm' OR count(*) >= 2""")
def _(v):
    rows = v("events_once").select("user_id", F.coalesce("sender_name", F.lit("unknown")).alias("name"), F.when(F.col("source") == "whatsapp", "dm").otherwise(F.col("source")).alias("source"), F.col("occurred_at").alias("at"), ((F.col("seq") % 7) / 10).alias("score"), F.col("body").alias("text"))
    return metrics.rollup_contacts(rows).select("user_id", "name", joined("sources"), "interactions", r6("score"))


@Q.add("interaction_dedup", """
SELECT user_id, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, person, channel ORDER BY observed_at, id) AS n FROM (
 SELECT user_id, id, observed_at, payload->>'$.target_person_id' AS person, payload->>'$.channel' AS channel FROM {order_obs} WHERE kind = 'interaction')) WHERE n = 1""")
def _(v):
    get = lambda k: F.get_json_object("payload", f"$.{k}")
    rows = v("order_obs").where("kind = 'interaction'").select("user_id", "id", "observed_at", F.array(F.lit("me"), get("target_person_id")).alias("participants"), get("channel").alias("channel"))
    return metrics.dedup_interactions(rows).select("user_id", "id")


@Q.add("recurring_meetings", """
SELECT s.user_id, s.id, coalesce(g.occurrences, 0) AS occurrences, g.cadence FROM (SELECT *, 'Weekly' AS k FROM (SELECT 't' AS user_id, o_custkey, 'o' || cast(o_orderkey AS varchar) AS id, o_orderdate FROM {orders})) s LEFT JOIN (
 SELECT o_custkey, n AS occurrences, newest, CASE WHEN med < 1.5 THEN 'daily' WHEN med < 5 THEN 'every ' || cast(cast(round_even(med, 0) AS int) AS varchar) || ' days' WHEN med < 8 THEN 'weekly' WHEN med < 16 THEN 'biweekly' ELSE 'monthly' END AS cadence FROM (
  SELECT o_custkey, n, newest, med, (SELECT count(*) FROM unnest(gaps) AS t(g) WHERE g >= 0.5 * med AND g <= 1.5 * med) AS even, len(gaps) AS ng FROM (
   SELECT o_custkey, count(*) AS n, arg_max(id, (o_orderdate, id)) AS newest, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS gaps, list_sort(list(gap) FILTER (gap IS NOT NULL))[cast(floor((count(*) - 1) / 2) AS int) + 1] AS med FROM (
    SELECT o_custkey, 'o' || cast(o_orderkey AS varchar) AS id, o_orderdate, (epoch_us(o_orderdate) - epoch_us(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, 'o' || cast(o_orderkey AS varchar)))) / 86400000000.0 AS gap FROM {orders}) GROUP BY 1) WHERE n >= 3) WHERE even >= 0.6 * ng) g ON g.o_custkey = s.o_custkey
WHERE g.newest IS NULL OR g.newest = s.id""")
def _(v):
    rows = v("orders").select(F.lit("t").alias("user_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("Sync "), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("summary"), F.col("o_orderdate").alias("start_at"), F.array(F.concat(F.lit("C"), F.col("o_custkey").cast("string"))).alias("attendees"))
    return metrics.collapse_recurring(rows).select("user_id", "id", F.coalesce("occurrences", F.lit(0)).alias("occurrences"), "cadence")


@Q.add("group_junk", """
SELECT g AS group_jid, concat_ws(',', CASE WHEN m > 20 AND o = 0 THEN NULL END, CASE WHEN t > 10 AND x > 0.8 * t THEN 'broadcast_ratio' END, CASE WHEN p_name LIKE '%ring%' THEN 'commercial_keyword' END) AS reasons FROM (
 SELECT 'g' || cast(p_partkey AS varchar) AS g, p_name, coalesce(t, 0) AS t, coalesce(x, 0) AS x, 0 AS m, 0 AS o FROM {part} LEFT JOIN (
  SELECT l_partkey, sum(n) AS t, max(n) AS x FROM (SELECT l_partkey, CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE l_suppkey END AS s, count(*) AS n FROM {lineitem} GROUP BY 1, 2) GROUP BY 1) ON l_partkey = p_partkey)""")
def _(v):
    group = F.concat(F.lit("g"), F.col("l_partkey").cast("string")).alias("group_jid")
    sent = v("lineitem").select(group, F.when(F.col("l_partkey") % 5 == 0, 1).otherwise(F.col("l_suppkey")).cast("string").alias("sender"), F.lit(0).alias("from_me"))
    members = v("lineitem").select(group, F.col("l_suppkey").cast("string").alias("user_jid"))
    chats = v("part").select(F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("group_jid"), F.regexp_replace("p_name", ".*ring.*", "big sale").alias("name"))
    return identity.classify_groups(sent, members, chats).select("group_jid", joined("reasons"))


@Q.add("resolved_observations", """
SELECT string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT id, CASE WHEN k % 11 = 3 THEN k - 1 ELSE k END AS g FROM (SELECT id, cast(substr(id, 2) AS bigint) AS k FROM {person_obs})) GROUP BY g HAVING count(*) > 1""")
def _(v):
    own = links.handles(v("person_obs")).where("handle LIKE 'phone:%'").select("id", "handle")
    lids = v("bridge").select("lid", F.col("phone").alias("pn"))
    return identity.resolve_observations(own, lids).select(joined("ids"))


@Q.add("best_names", """
SELECT chat_jid, name FROM (SELECT chat_jid, name, row_number() OVER (PARTITION BY chat_jid ORDER BY src, -length(name), name) AS n FROM (
 SELECT chat_jid, 'Some ' || sender_name || repeat('x', cast(ts % 3 AS int)) AS name, CASE WHEN ts % 2 = 0 THEN 1 ELSE 3 END AS src FROM {chat} WHERE ts % 5 <> 0)) WHERE n = 1""")
def _(v):
    name = F.concat(F.lit("Some "), "sender_name", F.repeat(F.lit("x"), (F.col("ts") % 3).cast("int")))
    rows = v("chat").select("chat_jid", F.when(F.col("ts") % 5 == 0, "+919000000001").otherwise(name).alias("name"), F.when(F.col("ts") % 2 == 0, "wa_contact").otherwise("gmail_from").alias("name_source"))
    return identity.pick_best_name(rows, ["chat_jid"])


@Q.add("enrichment_batches", "SELECT user_id, person_id, cast(floor((row_number() OVER (PARTITION BY user_id ORDER BY person_id) - 1) / 30) AS bigint) AS batch FROM (SELECT l.user_id, l.person_id, arg_max(o.payload->>'$.name', (o.observed_at, o.id)) AS name, arg_max(o.payload->>'$.category', (o.observed_at, o.id)) AS category FROM {person_obs} o JOIN {links} l ON l.user_id = o.user_id AND l.observation_id = o.id GROUP BY 1, 2) WHERE category = 'other' AND name NOT LIKE '+%'")
def _(v):
    none = v("topics").select("user_id", "person_id", F.lit(1).alias("rank"), F.lit(1).alias("ts"), F.col("topic").alias("text"))
    return activity.enrichment_context(_person_cards(v), none).select("user_id", "person_id", "batch")


@Q.add("delta_context", """
SELECT w.user_id, w.person_id, coalesce(m.n, 0) AS messages FROM (SELECT p.user_id, p.id AS person_id, max(s.pass_at) AS pass_at FROM {persons} p LEFT JOIN {snaps} s ON s.user_id = p.user_id AND s.person_id = p.id GROUP BY 1, 2) w LEFT JOIN (
 SELECT p.user_id, p.person_id, least(count(*), 30) AS n FROM (SELECT l.user_id, l.person_id, o.observed_at + INTERVAL 27 DAY AS at FROM {order_obs} o JOIN {links} l ON l.user_id = o.user_id AND l.observation_id = o.id) p
 LEFT JOIN (SELECT user_id, person_id, max(pass_at) AS pass_at FROM {snaps} GROUP BY 1, 2) s ON s.user_id = p.user_id AND s.person_id = p.person_id WHERE s.pass_at IS NULL OR p.at > s.pass_at GROUP BY 1, 2) m ON m.user_id = w.user_id AND m.person_id = w.person_id
WHERE w.pass_at IS NULL OR m.n > 0""")
def _(v):
    said = v("order_obs").join(v("links").withColumnRenamed("observation_id", "id"), ["user_id", "id"]).select("user_id", "person_id", (F.col("observed_at") + F.expr("INTERVAL 27 DAYS")).alias("at"), F.col("id").alias("text"))
    rows = activity.delta_context(v("persons").withColumnRenamed("id", "person_id"), v("snaps"), said)
    return rows.select("user_id", "person_id", F.coalesce(F.size("messages"), F.lit(0)).cast("long").alias("messages"))
