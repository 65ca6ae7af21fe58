"""The given tables in the shape of the ledger, as SQL that Spark and DuckDB both accept.

A view's name in braces stands for another view or for a given table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieledger.sources.tables import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations", "documents", "pages")
#: Fixed time that stands for now, behind all events.
AS_OF = "2024-02-20 00:00:00"

_TENANT = "'t' || cast(cast(floor({k} / 10) AS bigint) % 3 AS string)"


def _tenant(key: str) -> str:
    return _TENANT.replace("{k}", key)


def _phone(key: str) -> str:
    return f"cast(919000000000 + {key} AS string)"


VIEWS = {
    "raw": f"""
        SELECT {_tenant("user_id")} AS user_id,
               CASE event_type WHEN 'click' THEN 'whatsapp' WHEN 'view' THEN 'whatsapp' WHEN 'purchase' THEN 'gmail' WHEN 'signup' THEN 'calendar' ELSE 'linear' END AS source,
               'm' || cast(event_id AS string) AS source_event_id, event_id + 1000000000 * r AS seq, ts AS occurred_at,
               CASE WHEN event_id % 2 = 0 THEN 'in' ELSE 'out' END AS direction,
               CASE event_type WHEN 'click' THEN {_phone("user_id")} || '@s.whatsapp.net' WHEN 'view' THEN 'g' || cast(event_id % 37 AS string) || '@g.us' END AS thread_id,
               CASE WHEN event_type = 'view' AND event_id % 4 = 1 THEN cast(user_id AS string) || '@lid' WHEN event_type IN ('click', 'view') THEN {_phone("user_id")} || '@s.whatsapp.net' END AS jid,
               CASE WHEN event_type = 'click' OR (event_type = 'view' AND event_id % 4 <> 1) THEN '+' || {_phone("user_id")} END AS phone,
               CASE WHEN event_id % 3 = 0 THEN 'Peer ' || cast(user_id AS string) WHEN event_id % 3 = 1 THEN 'me' END AS sender_name,
               CASE WHEN r = 1 THEN 'replayed' ELSE props END AS body
        FROM {{events}} CROSS JOIN (SELECT 0 AS r UNION ALL SELECT 1 AS r) AS twice
        WHERE r = 0 OR event_id % 10 = 0""",
    "events_once": "SELECT * FROM {raw} WHERE seq < 1000000000",
    "bridge": f"""
        SELECT {_tenant("user_id")} AS user_id, cast(user_id AS string) AS lid, {_phone("user_id")} AS phone, max(ts) AS last_seen
        FROM {{events}} WHERE user_id % 7 <> 0 GROUP BY user_id""",
    "person_obs": f"""
        SELECT {_tenant("c_custkey")} AS user_id, CASE WHEN r = 0 THEN 'p' ELSE 'q' END || cast(c_custkey AS string) AS id,
               TIMESTAMP '2024-01-01 00:00:00' + (c_custkey + 100000 * r) * INTERVAL '1' SECOND AS observed_at,
               'person' AS kind, 'csv://' || cast(c_custkey AS string) || '/' || cast(r AS string) AS evidence_pointer, 2 * c_custkey + r AS seq,
               '{{"name":"' || CASE WHEN c_custkey % 9 = 4 THEN '+91' || cast(9000000000 + c_custkey AS string) WHEN r = 1 THEN 'Dr ' || c_name ELSE c_name END || '"'
               || CASE c_custkey % 6 WHEN 5 THEN '' WHEN 1 THEN ',"company":null' WHEN 2 THEN ',"company":""' ELSE ',"company":"Co ' || cast((c_custkey + r) % 20 AS string) || '"' END
               || ',"category":"' || CASE WHEN r = 0 AND c_custkey % 2 = 0 THEN 'other' ELSE lower(c_mktsegment) END || '"'
               || ',"relationship_to_me":"' || CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Appears in groups' ELSE 'Met at work ' || cast(c_nationkey AS string) END || '"'
               || ',"phones":["+' || {_phone("c_custkey")} || '"' || CASE WHEN c_custkey % 11 = 3 THEN ',"+' || {_phone("c_custkey - 1")} || '"' ELSE '' END || ']'
               || ',"emails":["u' || cast(c_custkey - r * (c_custkey % 2) AS string) || '@mail' || cast(c_custkey % 7 AS string) || '.test"]}}' AS payload
        FROM {{customer}} CROSS JOIN (SELECT 0 AS r UNION ALL SELECT 1 AS r) AS twice
        WHERE r = 0 OR c_custkey % 5 = 0""",
    "order_obs": f"""
        SELECT {_tenant("o_custkey")} AS user_id, 'o' || cast(o_orderkey AS string) AS id,
               TIMESTAMP '2024-01-05 00:00:00' + (o_orderkey % 2000000) * INTERVAL '1' SECOND AS observed_at,
               CASE WHEN o_orderkey % 5 = 2 THEN 'note' WHEN o_orderkey % 5 = 3 THEN 'correction' ELSE 'interaction' END AS kind,
               'order://' || cast(o_orderkey - (o_orderkey % 20 = 19)::int AS string) AS evidence_pointer, 10000000 + o_orderkey AS seq,
               '{{"target_person_id":"P' || cast(o_custkey AS string) || '"' ||
               CASE WHEN o_orderkey % 5 = 2 THEN ',"content":"note ' || o_orderpriority || '"'
                    WHEN o_orderkey % 5 = 3 THEN CASE o_orderkey % 4
                         WHEN 0 THEN ',"field":"category","new_value":"team"'
                         WHEN 1 THEN ',"field":"company","new_value":null'
                         WHEN 2 THEN ',"field":"emails","new_value":["fix' || cast(o_orderkey AS string) || '@mail.test","u' || cast(o_custkey AS string) || '@mail.test"]'
                         ELSE ',"field":"name","new_value":"Fixed ' || cast(o_custkey AS string) || '"' END
                    ELSE ',"channel":"' || CASE o_orderkey % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'meeting' ELSE 'whatsapp' END || '","summary":"about ' || o_orderpriority || '"' ||
                         CASE WHEN o_orderkey % 4 = 0 THEN ',"title":"T ' || o_orderstatus || '"' ELSE '' END END || '}}' AS payload
        FROM {{orders}}""",
    "obs": """
        SELECT user_id, id, observed_at, observed_at AS ingested_at, kind, evidence_pointer, seq, payload FROM {person_obs}
        UNION ALL SELECT user_id, id, observed_at, observed_at, kind, evidence_pointer, seq, payload FROM {order_obs}""",
    "links": f"""
        SELECT user_id, 'P' || substr(id, 2) AS person_id, id AS observation_id FROM {{person_obs}}
        UNION ALL
        SELECT {_tenant("o_custkey")} AS user_id, 'P' || cast(o_custkey AS string) AS person_id, 'o' || cast(o_orderkey AS string) AS observation_id FROM {{orders}} WHERE o_orderkey % 7 <> 0""",
    "persons": f"SELECT {_tenant('c_custkey')} AS user_id, 'P' || cast(c_custkey AS string) AS id FROM {{customer}}",
    "self_ids": "SELECT user_id, min(id) AS self_id FROM {persons} GROUP BY user_id",
    "merge_obs": f"""
        SELECT {_tenant("o_custkey")} AS user_id, CASE WHEN o_orderkey % 4 = 3 THEN 'sp' ELSE 'mg' END || cast(o_orderkey AS string) AS id, CASE WHEN o_orderkey % 4 = 3 THEN 'split' ELSE 'merge' END AS kind,
               o_orderkey AS seq,
               '{{"person_id":"P' || cast(o_custkey AS string) || '","' || CASE WHEN o_orderkey % 4 = 3 THEN 'split_off_observation_ids' ELSE 'merged_observation_ids' END || '":["p' || cast(o_custkey AS string) || '","p' || cast(o_custkey + 1 AS string) || '"]}}' AS payload
        FROM {{orders}}""",
    "group_members": f"""
        SELECT 't' || cast(l_partkey % 3 AS string) AS user_id, 'g' || cast(l_partkey AS string) AS thread_id, 'S' || cast(l_suppkey AS string) AS person_id, max(l_shipdate) AS last_at
        FROM {{lineitem}} GROUP BY l_partkey, l_suppkey""",
    "group_self": "SELECT 't0' AS user_id, 'S0' AS self_id UNION ALL SELECT 't1' AS user_id, 'S1' AS self_id",
    "chat": """
        SELECT 'c' || cast(conv_id AS string) AS chat_jid, turn AS ts, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS from_me, text,
               'n' || cast((conv_id + turn) % 7 AS string) AS sender_name, 'j' || cast(conv_id % 20 AS string) AS sender_jid FROM {conversations}""",
    "topics": f"""
        SELECT {_tenant("c_custkey")} AS user_id, 'P' || cast(c_custkey AS string) AS person_id, 'topic ' || cast((c_custkey * k) % 17 AS string) AS topic,
               cast((c_custkey * 7 + k * 13) % 50 AS double) / 10 AS weight, 10 * c_custkey + k AS seq
        FROM {{customer}} CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 AS k UNION ALL SELECT 3 AS k UNION ALL SELECT 5 AS k) AS ks WHERE (c_custkey + k) % 4 <> 0""",
    "snaps": f"""
        SELECT {_tenant("o_custkey")} AS user_id, 'P' || cast(o_custkey AS string) AS person_id, 's' || cast(o_orderkey AS string) AS id,
               CASE o_orderkey % 3 WHEN 0 THEN 'summary' WHEN 1 THEN 'enricher' ELSE 'resolver' END AS pass_kind,
               TIMESTAMP '2024-02-01 00:00:00' + (o_orderkey % 1500000) * INTERVAL '1' SECOND AS pass_at
        FROM {{orders}} WHERE o_orderkey % 3 <> 1 OR o_orderkey % 2 = 0""",
    "meetings": f"""
        SELECT {_tenant("o_custkey")} AS user_id, 'm' || cast(o_orderkey % 4000 AS string) AS meeting_id, 'Sync ' || o_orderpriority AS title,
               TIMESTAMP '2024-02-19 00:00:00' + (o_orderkey % 300000) * INTERVAL '1' SECOND AS start_at, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'brief ' || cast(o_orderkey AS string) END AS brief_md, o_orderkey AS seq
        FROM {{orders}}""",
    "lid_map": "SELECT lid, phone AS pn FROM {bridge}",
    "contacts": f"""
        SELECT CASE WHEN c_custkey % 4 = 0 THEN cast(c_custkey AS string) || ':2@lid' ELSE {_phone("c_custkey")} || '@s.whatsapp.net' END AS jid,
               CASE WHEN c_custkey % 4 = 1 THEN {_phone("c_custkey")} END AS phone, CASE WHEN c_custkey % 3 = 1 THEN ' ' WHEN c_custkey % 3 = 2 THEN 'Push Name' || cast(c_custkey AS string) END AS push_name,
               CASE WHEN c_custkey % 5 = 0 THEN c_name END AS full_name, cast(NULL AS string) AS first_name
        FROM {{customer}}""",
    "wa_messages": f"""
        SELECT CASE WHEN event_type = 'click' THEN {_phone("user_id")} || '@s.whatsapp.net' ELSE 'g' || cast(event_id % 37 AS string) || '@g.us' END AS chat_jid,
               'm' || cast(event_id AS string) AS msg_id, event_id * 60 AS ts, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS from_me,
               CASE WHEN event_id % 2 = 0 THEN cast(user_id AS string) || ':1@lid' ELSE {_phone("user_id")} || '@s.whatsapp.net' END AS sender_jid,
               CASE WHEN event_id % 3 = 0 THEN 'Member Nr' || cast(user_id AS string) WHEN event_id % 3 = 1 THEN ' ' END AS sender_name, 'Club ' || cast(event_id % 37 AS string) AS chat_name, props AS text
        FROM {{events}} WHERE event_type IN ('click', 'view')""",
    "mail_people": """
        SELECT 'th' || cast(o_orderkey AS string) AS thread_id, TIMESTAMP '2024-01-03 00:00:00' + (o_orderkey % 900000) * INTERVAL '1' SECOND AS sent_at, o_orderkey % 6 AS kind,
               CASE WHEN o_orderkey % 11 = 0 THEN 'no-reply@list' || cast(o_custkey % 5 AS string) || '.test' ELSE 'U.' || cast(o_custkey AS string) || '+x@mail' || cast(o_custkey % 7 AS string) || '.test' END AS from_email,
               CASE WHEN o_custkey % 2 = 0 THEN 'Name' || cast(o_custkey AS string) || ' Push' ELSE 'Sender Nr' || cast(o_custkey AS string) END AS from_name, 'u.' || cast((o_custkey * 7) % 1000 AS string) || '@mail1.test' AS to_email
        FROM {orders}""",
    "book": f"""
        SELECT CASE WHEN s_suppkey % 4 = 1 THEN '' ELSE s_name END AS name, '+' || {_phone("s_suppkey")} AS phone, CASE WHEN s_suppkey % 3 <> 0 THEN 'S.' || cast(s_suppkey AS string) || '@Mail1.test' END AS email
        FROM {{supplier}}""",
    "attended": f"""
        SELECT {_tenant("o_custkey")} AS user_id, 'm' || cast(o_orderkey AS string) AS meeting_id, TIMESTAMP '2024-02-19 00:00:00' + (o_orderkey % 300000) * INTERVAL '1' SECOND AS start_at,
               CASE o_orderkey % 7 WHEN 0 THEN 'Flight to ' || o_orderstatus WHEN 1 THEN 'Birthday' ELSE 'Sync ' || o_orderpriority END AS summary, CASE WHEN o_orderkey % 9 = 0 THEN 'Cancelled' ELSE 'confirmed' END AS status,
               CASE WHEN o_orderkey % 13 = 0 THEN 'outOfOffice' ELSE 'default' END AS event_type, o_orderkey % 17 = 0 AS all_day,
               'u' || cast(o_custkey AS string) || '@mail' || cast(o_custkey % 7 AS string) || '.test' AS guest, CASE o_orderkey % 4 WHEN 0 THEN 'ME@self.test' WHEN 1 THEN 'room@resource.calendar.test' WHEN 2 THEN 'no-reply@x.test' ELSE 'Other@post.test' END AS second,
               o_orderkey % 12 AS more, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'brief' END AS brief_md, CASE WHEN o_orderkey % 5 <> 0 THEN TIMESTAMP '2024-02-17 12:00:00' + (o_orderkey % 200000) * INTERVAL '1' SECOND END AS generated_at
        FROM {{orders}}""",
}


def needed(names: list[str], sql: str = "") -> list[str]:
    """Views that these and the SQL stand on, each behind those it needs."""
    out: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in out:
            for inner in re.findall(r"\{(\w+)\}", VIEWS[name]):
                add(inner)
            out.append(name)

    for name in [*names, *re.findall(r"\{(\w+)\}", sql)]:
        add(name)
    return out


def view(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """A view as a DataFrame over the given tables."""
    made = {} if made is None else made
    if name not in made:
        if name in TABLES:
            own = table(spark, sf_dir, name)
            made[name] = own.withColumns({c: F.col(c).cast("timestamp") for c, t in own.dtypes if t == "timestamp_ntz"})
        else:
            sql = VIEWS[name]
            made[name] = spark.sql(_plain(sql), **{x: view(spark, sf_dir, x, made) for x in set(re.findall(r"\{(\w+)\}", sql))})
    return made[name]


def _plain(sql: str) -> str:
    """Spark's formatter reads doubled braces as plain ones, as the f-strings above leave them for JSON."""
    out, depth = [], re.split(r"(\{\w+\})", sql)
    for part in depth:
        out.append(part if re.fullmatch(r"\{\w+\}", part) else part.replace("{", "{{").replace("}", "}}"))
    return "".join(out)


def oracle(sql: str, *views: str) -> str:
    """DuckDB SQL: the views as WITH clauses before the query; in both a name in braces becomes the bare name."""
    bare = lambda x: re.sub(r"\{(\w+)\}", r"\1", x)
    heads = [f"{n} AS ({bare(VIEWS[n])})" for n in needed(list(views), sql)]
    return ("WITH " + ",\n".join(heads) + "\n" if heads else "") + bare(sql)
