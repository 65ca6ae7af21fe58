"""Which observation belongs to which person: a replay of merges, splits and targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieledger.operators.intake import payload_map
from tieledger.sources.tables import cut

_IDS = "array<string>"


def link_events(obs: DataFrame) -> DataFrame:
    """obs (user_id, id, kind, payload, seq) -> user_id, person_id, observation_id, op (add, remove), seq, by."""
    p = payload_map(F.col("payload"))
    event = "array<struct<person_id:string,observation_id:string,op:string>>"

    def each(person: str, ids, op: str):
        return F.transform(ids, lambda x: F.struct(F.element_at(p, person).alias("person_id"), x.alias("observation_id"), F.lit(op).alias("op"))).cast(event)

    merged = F.from_json(F.element_at(p, "merged_observation_ids"), _IDS)
    # the ledger is read and its payloads are parsed once: a row's events are one array
    made = (
        F.when(F.col("kind") == "merge", each("person_id", F.when(F.size(merged) > 0, F.concat(merged, F.array("id"))), "add"))
        .when(F.col("kind") == "split", each("person_id", F.from_json(F.element_at(p, "split_off_observation_ids"), _IDS), "remove"))
        .otherwise(each("target_person_id", F.array("id"), "add"))
    )
    rows = obs.where("kind IN ('merge', 'split', 'correction', 'interaction', 'note')").select("user_id", F.explode(made).alias("e"), "seq", F.col("id").alias("by"))
    return rows.select("user_id", "e.person_id", "e.observation_id", "e.op", "seq", "by").where("person_id IS NOT NULL AND observation_id IS NOT NULL")


def resolve_links(events: DataFrame) -> DataFrame:
    """A pair is linked if its last event adds it; ``linked_by`` is the first one to do so after the last removal.

    One aggregation per pair, with its last removal and its additions, which are as many as events name that pair; events are read once.
    """
    added = F.collect_list(F.when(F.col("op") == "add", F.struct("seq", "by")))
    pairs = events.groupBy("user_id", "person_id", "observation_id").agg(added.alias("adds"), F.max(F.when(F.col("op") == "remove", F.col("seq"))).alias("gone"))
    first = F.array_min(F.filter("adds", lambda a: F.col("gone").isNull() | (a["seq"] > F.col("gone"))))
    left = pairs.select("user_id", "person_id", "observation_id", first.alias("first")).where("first IS NOT NULL")
    return left.select("user_id", "person_id", "observation_id", F.col("first.by").alias("linked_by_observation_id"), F.col("first.seq").alias("linked_seq"))


def materialize_persons(obs: DataFrame) -> DataFrame:
    """Persons that merges name, with the first merge's place in the ledger."""
    person = F.element_at(payload_map(F.col("payload")), "person_id")
    return obs.where("kind = 'merge'").groupBy("user_id", person.alias("id")).agg(F.min("seq").alias("created_seq")).where("id IS NOT NULL")


def handles(obs: DataFrame) -> DataFrame:
    """Person observations -> (user_id, id, observed_at, seq, handle), one row per phone and e-mail."""
    p = payload_map(F.col("payload"))
    phones = F.transform(F.coalesce(F.from_json(F.element_at(p, "phones"), _IDS), F.array().cast(_IDS)), lambda x: F.concat(F.lit("phone:"), x))
    emails = F.transform(F.coalesce(F.from_json(F.element_at(p, "emails"), _IDS), F.array().cast(_IDS)), lambda x: F.concat(F.lit("email:"), F.lower(x)))
    return obs.where("kind = 'person'").select("user_id", "id", "observed_at", "seq", F.explode(F.array_distinct(F.concat(phones, emails))).alias("handle"))


def autolink_persons(obs: DataFrame, links: DataFrame) -> DataFrame:
    """New links of unlinked person observations that share a handle with a linked one.

    The person of the earliest linked observation wins, then the smallest.  Rounds go on until nothing is added, since a
    link may carry the next one.  Per handle only the winner is kept before the join, so a shared office phone costs one row.
    """
    every = cut(handles(obs))
    linked = links.select("user_id", F.col("observation_id").alias("id"), "person_id")
    added = None
    while True:
        owner = every.join(linked, ["user_id", "id"]).groupBy("user_id", "handle").agg(F.min(F.struct("observed_at", "id", "person_id")).alias("first"))
        free = every.join(linked.select("user_id", "id"), ["user_id", "id"], "left_anti")
        new = cut(free.join(owner, ["user_id", "handle"]).groupBy("user_id", "id").agg(F.min("first").alias("first")).select("user_id", "id", F.col("first.person_id").alias("person_id")))
        if new.isEmpty():
            break
        added = new if added is None else added.unionByName(new)
        linked = linked.unionByName(new)
    none = linked.limit(0)
    return (none if added is None else added).select("user_id", "person_id", F.col("id").alias("observation_id"))


def build_merges(obs: DataFrame) -> DataFrame:
    """One merge for each person observation that has a bridge: sorted bridges, and a pointer made of them."""
    bridges = handles(obs).groupBy("user_id", "id").agg(F.array_sort(F.collect_set("handle")).alias("bridges"))
    joined = F.array_join("bridges", "+")
    pointer = F.concat(F.lit("merge://"), F.when(F.length(joined) > 500, F.sha1(joined)).otherwise(joined))
    same = bridges.withColumn("pointer", pointer).groupBy("user_id", "pointer").agg(F.sort_array(F.collect_list(F.struct("id", "bridges"))).alias("x"))
    rows = same.select("user_id", "pointer", F.posexplode("x").alias("k", "x"))
    return rows.select("user_id", F.col("x.id").alias("id"), "x.bridges", F.when(F.col("k") == 0, F.col("pointer")).otherwise(F.concat_ws("#", "pointer", "x.id")).alias("evidence_pointer"))


def assign_person_ids(obs: DataFrame, bridge_index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """bridge_index (user_id, handle, person_id): the one person hit, or a new id; two or more are a conflict."""
    hit = handles(obs).join(bridge_index, ["user_id", "handle"], "left").groupBy("user_id", "id").agg(F.array_sort(F.collect_set("person_id")).alias("persons"))
    new = F.concat(F.lit("person-"), F.substring(F.sha1("id"), 1, 12))
    merges = hit.where(F.size("persons") <= 1).select("user_id", "id", F.coalesce(F.get("persons", F.lit(0)), new).alias("person_id"), (F.size("persons") == 0).alias("is_new"))
    return merges, hit.where(F.size("persons") > 1)


def wipe_provenance(obs: DataFrame, links: DataFrame, persons: DataFrame, prefixes: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without observations of these pointers, their links, and persons left without links."""
    from functools import reduce

    hit = reduce(lambda a, b: a | b, [F.col("evidence_pointer").startswith(p) for p in prefixes])
    gone = obs.where(hit).select("user_id", F.col("id").alias("observation_id"))
    left = links.join(gone, ["user_id", "observation_id"], "left_anti")
    person = ["user_id", F.col("person_id").alias("id")]
    had = links.select(*person).distinct().join(left.select(*person).distinct(), ["user_id", "id"], "left_anti")
    return obs.where(~hit), left, persons.join(had, ["user_id", "id"], "left_anti")


def orphan_observations(obs: DataFrame, links: DataFrame) -> DataFrame:
    return obs.where("kind IN ('person', 'merge')").join(links.select("user_id", F.col("observation_id").alias("id")), ["user_id", "id"], "left_anti")
