"""The person graph over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieledger.operators import cards, graph
from tieledger.operators.components import connected_components
from tieledger.operators.links import handles
from tieledger.plans.adapters import AS_OF
from tieledger.plans.registry import Registry, r6, us
from tieledger.sources.tables import cut

Q = Registry()

_PHONES = """(SELECT user_id, phone, arg_min(person_id, (observed_at, id)) AS person_id FROM (
 SELECT o.user_id, o.id, o.observed_at, l.person_id, unnest(from_json(o.payload->'$.phones', '["VARCHAR"]')) AS phone FROM {person_obs} o JOIN {links} l ON l.user_id = o.user_id AND l.observation_id = o.id) GROUP BY 1, 2)"""
_DMS = """(SELECT user_id, thread_id, '+' || replace(thread_id, '@s.whatsapp.net', '') AS phone, count(*) AS message_count, min(occurred_at) AS first_at, max(occurred_at) AS last_at
 FROM {events_once} WHERE source = 'whatsapp' AND thread_id LIKE '%@s.whatsapp.net' GROUP BY 1, 2)"""


def _weight(n: str, at: str) -> str:
    return f"CASE WHEN {n} <= 0 THEN 0 ELSE ln(1 + {n}) * exp(-greatest(0, coalesce(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us({at}), 0) / 86400000000.0) / 180) END"


_DM_EDGES = f"""(SELECT e.*, {_weight('message_count', 'last_at')} AS weight FROM (
 SELECT d.user_id, least(p.person_id, s.self_id) AS a, greatest(p.person_id, s.self_id) AS b, 'DM' AS type, sum(d.message_count) AS message_count, min(d.first_at) AS first_at, max(d.last_at) AS last_at
 FROM {_DMS} d JOIN {_PHONES} p ON p.user_id = d.user_id AND p.phone = d.phone JOIN {{self_ids}} s ON s.user_id = d.user_id WHERE p.person_id <> s.self_id GROUP BY 1, 2, 3) e)"""
_MAILS = """(SELECT l.user_id, l.person_id, count(*) AS message_count, min(o.observed_at) AS first_at, max(o.observed_at) AS last_at FROM {obs} o JOIN {links} l ON l.user_id = o.user_id AND l.observation_id = o.id
 WHERE o.kind = 'interaction' AND o.payload->>'$.channel' = 'email' GROUP BY 1, 2)"""
_MAIL_EDGES = f"""(SELECT m.user_id, least(m.person_id, s.self_id) AS a, greatest(m.person_id, s.self_id) AS b, 'EMAILED' AS type, message_count, {_weight('message_count', 'last_at')} AS weight
 FROM {_MAILS} m JOIN {{self_ids}} s ON s.user_id = m.user_id WHERE m.person_id <> s.self_id)"""
_GROUP_ROWS = """(SELECT user_id, thread_id, phone, count(*) AS message_count, max(occurred_at) AS last_at FROM (
 SELECT r.user_id, r.thread_id, coalesce(r.phone, '+' || b.phone) AS phone, r.occurred_at FROM {events_once} r LEFT JOIN {bridge} b ON b.user_id = r.user_id AND b.lid = split_part(r.jid, '@', 1) AND r.jid LIKE '%@lid'
 WHERE r.thread_id LIKE '%@g.us') WHERE phone IS NOT NULL GROUP BY 1, 2, 3)"""
_IN_GROUPS = f"(SELECT g.user_id, g.thread_id, p.person_id, g.last_at FROM {_GROUP_ROWS} g JOIN {_PHONES} p ON p.user_id = g.user_id AND p.phone = g.phone)"


def _shared(members: str, me: str) -> str:
    return f"""(WITH gm AS {members}, gs AS (SELECT user_id, thread_id, person_id, max(last_at) AS last_at FROM (
  SELECT * FROM gm UNION ALL SELECT g.user_id, g.thread_id, s.self_id, max(g.last_at) FROM gm g JOIN {me} s ON s.user_id = g.user_id GROUP BY 1, 2, 3) GROUP BY 1, 2, 3)
 SELECT x.user_id, x.person_id AS a, y.person_id AS b, count(DISTINCT x.thread_id) AS group_count, max(greatest(x.last_at, y.last_at)) AS last_at
 FROM gs x JOIN gs y ON y.user_id = x.user_id AND y.thread_id = x.thread_id AND x.person_id < y.person_id
 WHERE (x.user_id, x.thread_id) IN (SELECT (user_id, thread_id) FROM gs GROUP BY user_id, thread_id HAVING count(*) BETWEEN 2 AND 30) GROUP BY 1, 2, 3)"""


_GROUP_EDGES = f"(SELECT user_id, a, b, 'SHARED_GROUP' AS type, {_weight('group_count', 'last_at')} AS weight FROM {_shared(_IN_GROUPS, '{self_ids}')})"
_EDGES = f"(SELECT user_id, a, b, type, weight FROM {_DM_EDGES} UNION ALL SELECT user_id, a, b, type, weight FROM {_MAIL_EDGES} UNION ALL SELECT user_id, a, b, type, weight FROM {_GROUP_EDGES})"
_SHARED = _shared("(SELECT user_id, thread_id, person_id, last_at FROM {group_members})", "{group_self}")


def phones(v):
    return graph.phone_person_map(v("obs"), v("links"))


def dms(v):
    return graph.dm_thread_stats(v("events_once"))


def dm_edges(v):
    return graph.dm_edges(dms(v), phones(v), v("self_ids"), AS_OF)


def mail_edges(v):
    return graph.emailed_edges(graph.email_interactions(v("obs"), v("links")), v("self_ids"), AS_OF)


def group_rows(v):
    """Group contacts by phone, device ids by way of the bridge."""
    raw = _with_arrays(v)
    return graph.resolve_group_members(graph.group_thread_phones(raw), graph.group_thread_lids(raw), v("bridge"))[0]


class Contacts:
    """What nodes and edges share, each worked out and written once."""

    def __init__(self, v):
        self.phones, self.dms, self.groups = cut(phones(v)), cut(dms(v)), cut(group_rows(v))
        self.mails, self.selves = cut(graph.email_interactions(v("obs"), v("links"))), v("self_ids")

    def edges(self):
        cols = ["user_id", "a", "b", "type", "weight"]
        members = self.groups.join(self.phones, ["user_id", "phone"]).select("user_id", "thread_id", "person_id", "last_at")
        made = [graph.dm_edges(self.dms, self.phones, self.selves, AS_OF), graph.emailed_edges(self.mails, self.selves, AS_OF), graph.shared_group_edges(members, self.selves, AS_OF)]
        return cut(reduce(DataFrame.unionByName, [x.select(*cols) for x in made]))


def all_edges(v):
    return Contacts(v).edges()


def nodes(v, contacts=None, edges=None):
    """Persons with the time of their last contact and their score."""
    c = contacts or Contacts(v)
    # fields come from person rows alone, times from all
    rows = v("obs").withColumns({"kind": F.when(F.col("kind") == "person", "person").otherwise("seen")})
    made = graph.graph_nodes(cards.fold_person_cards(rows, v("links"), AS_OF).where("person_rows > 0"))
    made = graph.last_interaction(made, c.dms, c.groups, c.mails, c.phones)
    return graph.score_nodes(made, edges if edges is not None else c.edges())


_NODES = f"""(SELECT n.user_id, n.person_id, n.name, n.category, n.first_seen, n.last_seen, coalesce(t.seen_at, n.last_seen) AS last_interaction_at, coalesce(e.n, 0) AS edge_count, 2 * ln(1 + coalesce(e.n, 0)) AS score FROM (
 SELECT l.user_id, l.person_id, arg_max(o.payload->>'$.name', (o.observed_at, o.id)) FILTER (o.kind = 'person') AS name, arg_max(o.payload->>'$.category', (o.observed_at, o.id)) FILTER (o.kind = 'person') AS category,
        min(o.observed_at) AS first_seen, max(o.observed_at) AS last_seen FROM {{obs}} o JOIN {{links}} l ON l.user_id = o.user_id AND l.observation_id = o.id GROUP BY 1, 2
 HAVING count(*) FILTER (o.kind = 'person') > 0) n
 LEFT JOIN (SELECT user_id, person_id, max(seen_at) AS seen_at FROM (SELECT d.user_id, p.person_id, d.last_at AS seen_at FROM {_DMS} d JOIN {_PHONES} p ON p.user_id = d.user_id AND p.phone = d.phone
            UNION ALL SELECT user_id, person_id, last_at FROM {_IN_GROUPS} UNION ALL SELECT user_id, person_id, last_at FROM {_MAILS}) GROUP BY 1, 2) t ON t.user_id = n.user_id AND t.person_id = n.person_id
 LEFT JOIN (SELECT user_id, x, count(*) AS n FROM (SELECT user_id, a AS x FROM {_EDGES} UNION ALL SELECT user_id, b FROM {_EDGES}) GROUP BY 1, 2) e ON e.user_id = n.user_id AND e.x = n.person_id)"""


@Q.add("going_cold", f"""
SELECT user_id, person_id, name, epoch_us(last_interaction_at) AS last_interaction_at, round(score, 6) AS score, cast(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_interaction_at)) / 86400000000.0) AS bigint) AS days_since
FROM {_NODES} WHERE score > 1 AND epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_interaction_at) > 14 * 86400000000""")
def _(v):
    return graph.going_cold(nodes(v), AS_OF, min_score=1.0).select("user_id", "person_id", "name", us("last_interaction_at"), r6("score"), "days_since")


@Q.add("phone_person_map", f"SELECT user_id, phone, person_id FROM {_PHONES}")
def _(v):
    return phones(v)


@Q.add("dm_thread_stats", f"SELECT user_id, phone, message_count, epoch_us(first_at) AS first_at, epoch_us(last_at) AS last_at FROM {_DMS}")
def _(v):
    return dms(v).select("user_id", "phone", "message_count", us("first_at"), us("last_at"))


def _with_arrays(v):
    return v("events_once").withColumns({
        "participant_phones": F.array_compact(F.array("phone")), "participants_raw": F.array(F.struct("jid", F.col("sender_name").alias("name"))),
    })


@Q.add("group_thread_phones", "SELECT user_id, thread_id, phone, count(*) AS message_count, epoch_us(max(occurred_at)) AS last_at FROM {events_once} WHERE thread_id LIKE '%@g.us' AND phone IS NOT NULL GROUP BY 1, 2, 3")
def _(v):
    return graph.group_thread_phones(_with_arrays(v)).select("user_id", "thread_id", "phone", "message_count", us("last_at"))


@Q.add("group_thread_lids", "SELECT user_id, thread_id, split_part(jid, '@', 1) AS lid, count(*) AS message_count, epoch_us(max(occurred_at)) AS last_at FROM {events_once} WHERE thread_id LIKE '%@g.us' AND jid LIKE '%@lid' GROUP BY 1, 2, 3")
def _(v):
    return graph.group_thread_lids(_with_arrays(v)).select("user_id", "thread_id", "lid", "message_count", us("last_at"))


@Q.add("group_member_resolution", """
SELECT user_id, thread_id, phone, count(*) AS message_count, epoch_us(max(occurred_at)) AS last_at FROM (
 SELECT r.user_id, r.thread_id, coalesce(r.phone, '+' || b.phone) AS phone, r.occurred_at FROM {events_once} r LEFT JOIN {bridge} b ON b.user_id = r.user_id AND b.lid = split_part(r.jid, '@', 1) AND r.jid LIKE '%@lid'
 WHERE r.thread_id LIKE '%@g.us') WHERE phone IS NOT NULL GROUP BY 1, 2, 3""")
def _(v):
    return group_rows(v).select("user_id", "thread_id", "phone", "message_count", us("last_at"))


@Q.add("email_interaction_stats", f"SELECT user_id, person_id, message_count, epoch_us(first_at) AS first_at, epoch_us(last_at) AS last_at FROM {_MAILS}")
def _(v):
    return graph.email_interactions(v("obs"), v("links")).select("user_id", "person_id", "message_count", us("first_at"), us("last_at"))


@Q.add("dm_edges", f"SELECT user_id, a, b, cast(message_count AS bigint) AS message_count, epoch_us(first_at) AS first_at, epoch_us(last_at) AS last_at, round(weight, 6) AS weight FROM {_DM_EDGES}")
def _(v):
    return dm_edges(v).select("user_id", "a", "b", "message_count", us("first_at"), us("last_at"), r6("weight"))


@Q.add("emailed_edges", f"SELECT user_id, a, b, message_count, round(weight, 6) AS weight FROM {_MAIL_EDGES}")
def _(v):
    return mail_edges(v).select("user_id", "a", "b", "message_count", r6("weight"))


@Q.add("shared_group_edges", f"SELECT user_id, a, b, group_count, epoch_us(last_at) AS last_at, round({_weight('group_count', 'last_at')}, 6) AS weight FROM {_SHARED}")
def _(v):
    return graph.shared_group_edges(v("group_members"), v("group_self"), AS_OF).select("user_id", "a", "b", "group_count", us("last_at"), r6("weight"))


@Q.add("graph_nodes", f"SELECT user_id, person_id, name, category, epoch_us(first_seen) AS first_seen, epoch_us(last_seen) AS last_seen, epoch_us(last_interaction_at) AS last_interaction_at, edge_count, round(score, 6) AS score FROM {_NODES}")
def _(v):
    return nodes(v).select("user_id", "person_id", "name", "category", us("first_seen"), us("last_seen"), us("last_interaction_at"), "edge_count", r6("score"))


@Q.add("graph_merge_stats", f"""
SELECT 'nodes_written' AS what, (SELECT count(*) FROM {{persons}} WHERE length(id) % 2 = 0) AS n UNION ALL SELECT 'nodes_pruned', (SELECT count(*) FROM {{persons}} WHERE length(id) % 2 = 1)
UNION ALL SELECT 'edges_written', (SELECT count(*) FROM {_EDGES} WHERE length(a) % 2 = 0 AND length(b) % 2 = 0) UNION ALL SELECT 'edges_pruned', (SELECT count(*) FROM {_EDGES} WHERE length(a) % 2 = 1 OR length(b) % 2 = 1)""")
def _(v):
    old = v("persons").withColumnRenamed("id", "person_id")
    edges = all_edges(v)
    return graph.merge_graph(old, edges, old.where("length(person_id) % 2 = 0"), edges)[2]


@Q.add("graph_totals", f"""
SELECT user_id, count(*) AS persons, count(*) FILTER (score > 2 AND epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_interaction_at) > 14 * 86400000000) AS going_cold FROM {_NODES} GROUP BY 1""")
def _(v):
    c = Contacts(v)
    edges = c.edges()
    return graph.graph_view(nodes(v, c, edges), edges, AS_OF)[2]


@Q.add("graph_neighbors", f"SELECT user_id, a AS person_id, b AS neighbor_id, type FROM {_EDGES} UNION ALL SELECT user_id, b, a, type FROM {_EDGES}")
def _(v):
    asked = v("persons").select("user_id", F.col("id").alias("person_id"))
    return graph.neighbors(all_edges(v), asked).select("user_id", "person_id", "neighbor_id", "type")


@Q.add("connected_core", f"""
SELECT user_id, person_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, person_id) AS r FROM {_NODES} WHERE edge_count > 0) WHERE r <= 200
UNION SELECT n.user_id, n.person_id FROM {_NODES} n JOIN {{self_ids}} s ON s.user_id = n.user_id AND s.self_id = n.person_id""")
def _(v):
    c = Contacts(v)
    edges = c.edges()
    return graph.connected_core(nodes(v, c, edges), edges, v("self_ids"))[0].select("user_id", "person_id")


@Q.add("co_presence", """
SELECT user_id, a, b, evidence, sources, round(least(least(evidence * 0.15, 0.7) + CASE WHEN sources > 1 THEN 0.2 ELSE 0 END, 1.0), 6) AS strength FROM (
 SELECT x.user_id, x.person_id AS a, y.person_id AS b, count(*) AS evidence, count(DISTINCT x.source) AS sources FROM (
   SELECT DISTINCT 't' AS user_id, l_returnflag AS source, l_orderkey AS event_id, 'S' || cast(l_suppkey AS varchar) AS person_id FROM {lineitem}) x JOIN (
   SELECT DISTINCT l_returnflag AS source, l_orderkey AS event_id, 'S' || cast(l_suppkey AS varchar) AS person_id FROM {lineitem}) y ON y.source = x.source AND y.event_id = x.event_id AND x.person_id < y.person_id GROUP BY 1, 2, 3)""")
def _(v):
    rows = v("lineitem").select(F.lit("t").alias("user_id"), F.col("l_returnflag").alias("source"), F.col("l_orderkey").alias("event_id"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("person_id"))
    return graph.co_presence_edges(rows).select("user_id", "a", "b", "evidence", "sources", r6("strength"))


_REFERRED = """(SELECT 'P' || cast(c_custkey // d AS varchar) AS x, 'P' || cast(c_custkey AS varchar) AS y FROM {customer} CROSS JOIN (SELECT 3 AS d UNION ALL SELECT 7 AS d) WHERE c_custkey > 0)"""


@Q.add("intro_path_hops", f"""
SELECT 'P0' AS source, 'P' || cast(c_custkey AS varchar) AS target, hops FROM {{customer}} LEFT JOIN (SELECT n, min(h) AS hops FROM (WITH RECURSIVE e AS (SELECT x, y FROM {_REFERRED} UNION SELECT y, x FROM {_REFERRED}),
 r(n, h) AS (SELECT 'P0', 0 UNION SELECT e.y, h + 1 FROM r JOIN e ON e.x = r.n WHERE h < 4) SELECT n, h FROM r) GROUP BY 1) ON n = 'P' || cast(c_custkey AS varchar)""")
def _(v):
    """From the first customer to all others, over who introduced whom; some are farther than four hops."""
    key = F.col("c_custkey")
    one = [v("customer").where("c_custkey > 0").select(F.lit("t").alias("user_id"), F.concat(F.lit("P"), F.floor(key / d).cast("string")).alias("a"), F.concat(F.lit("P"), key.cast("string")).alias("b"), F.lit(kind).alias("type"), (key % 5 + 1.0).alias("weight")) for d, kind in ((3, "DM"), (7, "EMAILED"))]
    pairs = v("customer").select(F.lit("t").alias("user_id"), F.lit("P0").alias("source"), F.concat(F.lit("P"), key.cast("string")).alias("target"))
    return graph.intro_paths(one[0].unionByName(one[1]), pairs).select("source", "target", "hops")


def _introductions(v) -> DataFrame:
    key = F.col("c_custkey")
    one = [v("customer").where("c_custkey > 0").select(F.lit("t").alias("user_id"), F.concat(F.lit("P"), F.floor(key / d).cast("string")).alias("a"), F.concat(F.lit("P"), key.cast("string")).alias("b"), F.lit(kind).alias("type"), (key % 5 + 1.0).alias("weight")) for d, kind in ((3, "DM"), (7, "EMAILED"))]
    return one[0].unionByName(one[1])


def _level(n: int) -> str:
    """Nodes first reached from each source after n hops, with the smallest path."""
    new = f"SELECT l.s, e.y AS n, min({{'path': list_append(l.path, e.y), 'types': list_append(l.types, e.type), 'weight': l.weight + e.weight}}) AS m FROM l{n - 1} l JOIN best e ON e.x = l.n GROUP BY 1, 2"
    before = " UNION ALL ".join(f"SELECT s, n FROM l{k}" for k in range(n))
    return f"l{n} AS (SELECT s, n, m.path AS path, m.types AS types, m.weight AS weight FROM ({new}) WHERE (s, n) NOT IN ({before}))"


@Q.add("intro_paths", f"""WITH each AS (SELECT 'P' || cast(c_custkey // 3 AS varchar) AS a, 'P' || cast(c_custkey AS varchar) AS b, 'DM' AS type, c_custkey % 5 + 1.0::double AS weight FROM {{customer}} WHERE c_custkey > 0
 UNION ALL SELECT 'P' || cast(c_custkey // 7 AS varchar), 'P' || cast(c_custkey AS varchar), 'EMAILED', c_custkey % 5 + 1.0::double FROM {{customer}} WHERE c_custkey > 0),
best AS (SELECT x, y, e.type AS type, e.weight AS weight FROM (SELECT x, y, max({{'weight': weight, 'type': type}}) AS e FROM (SELECT a AS x, b AS y, type, weight FROM each UNION ALL SELECT b, a, type, weight FROM each) GROUP BY 1, 2)),
l0 AS (SELECT 'P' || cast(c_custkey AS varchar) AS s, s AS n, [s] AS path, cast([] AS varchar[]) AS types, 0.0::double AS weight FROM {{customer}}), {", ".join(map(_level, range(1, 5)))},
reached AS ({" UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(5))}), asked AS (SELECT 'P' || cast(c_custkey AS varchar) AS source, 'P' || cast(c_custkey * 7 % (SELECT count(*) FROM {{customer}}) AS varchar) AS target FROM {{customer}})
SELECT source, target, len(path) - 1 AS hops, array_to_string(path, ',') AS path, array_to_string(types, ',') AS types, weight FROM asked LEFT JOIN reached ON s = source AND n = target""")
def _(v):
    """Each customer asks for a way to another: shortest, then by the smallest path, over the heaviest of parallel ties."""
    c = v("customer")
    n = c.count()
    pairs = c.select(F.lit("t").alias("user_id"), F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("source"), F.concat(F.lit("P"), (F.col("c_custkey") * 7 % n).cast("string")).alias("target"))
    found = graph.intro_paths(_introductions(v), pairs)
    return found.select("source", "target", "hops", F.array_join("path", ",").alias("path"), F.array_join("types", ",").alias("types"), "weight")


@Q.add("manifest_network", """
SELECT x.p AS a, y.p AS b, count(*) AS value FROM (SELECT DISTINCT l_suppkey AS g, 'p' || cast(l_partkey AS varchar) AS p FROM {lineitem}) x JOIN (SELECT DISTINCT l_suppkey AS g, 'p' || cast(l_partkey AS varchar) AS p FROM {lineitem}) y ON y.g = x.g AND x.p < y.p
WHERE x.p IN (SELECT 'p' || cast(l_partkey AS varchar) FROM {lineitem} GROUP BY l_partkey ORDER BY count(*) DESC, 'p' || cast(l_partkey AS varchar) LIMIT 200)
  AND y.p IN (SELECT 'p' || cast(l_partkey AS varchar) FROM {lineitem} GROUP BY l_partkey ORDER BY count(*) DESC, 'p' || cast(l_partkey AS varchar) LIMIT 200) GROUP BY 1, 2""")
def _(v):
    rows = v("lineitem").groupBy(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("id")).agg(F.count("*").alias("thread_count"), F.collect_set("l_suppkey").alias("groups"))
    return graph.manifest_network(rows)


@Q.add("self_resolution", """
SELECT p.user_id, arg_max(l.person_id, (o.observed_at, o.id)) AS self_id FROM (SELECT DISTINCT user_id FROM {persons}) p
JOIN (SELECT user_id, id, observed_at, unnest(from_json(payload->'$.emails', '["VARCHAR"]')) AS email FROM {person_obs}) o ON o.user_id = p.user_id AND o.email LIKE 'u1_@mail%' JOIN {links} l ON l.user_id = o.user_id AND l.observation_id = o.id GROUP BY 1""")
def _(v):
    mails = [f"U{k}@mail{m}.test" for k in range(10, 20) for m in range(7)]
    profiles = v("persons").select("user_id").distinct().withColumns({"emails": F.array(*map(F.lit, mails)), "phones": F.array().cast("array<string>")})
    return graph.resolve_self(v("obs"), v("links"), profiles).where("self_id IS NOT NULL")


_STARS = """SELECT user_id || id AS a, user_id || 'phone:' || unnest(from_json(payload->'$.phones', '["VARCHAR"]')) AS b FROM {person_obs}
UNION ALL SELECT user_id || id, user_id || 'email:' || unnest(from_json(payload->'$.emails', '["VARCHAR"]')) FROM {person_obs}"""


@Q.add("identity_components", f"""
SELECT node, min(other) AS component FROM (WITH RECURSIVE e AS (SELECT a, b FROM ({_STARS}) UNION SELECT b, a FROM ({_STARS})), r AS (SELECT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other)
SELECT * FROM r) GROUP BY node""")
def _(v):
    own = handles(v("person_obs")).select(F.concat("user_id", "id").alias("a"), F.concat("user_id", "handle").alias("b"))
    return connected_components(own)
