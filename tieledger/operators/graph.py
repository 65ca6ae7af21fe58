"""A weighted person graph from direct, group and mail contact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tieledger.functions.normalize import is_junk_label
from tieledger.functions.scoring import days_between, edge_weight, knows_strength
from tieledger.operators.cards import PERSON, person_observations
from tieledger.operators.links import handles
from tieledger.sources.tables import cut


def phone_person_map(obs: DataFrame, links: DataFrame) -> DataFrame:
    """Per phone the person of the earliest person observation."""
    phones = handles(obs).where("handle LIKE 'phone:%'").select("user_id", "id", "observed_at", F.substr("handle", F.lit(7)).alias("phone"))
    linked = phones.join(links.select("user_id", "person_id", F.col("observation_id").alias("id")), ["user_id", "id"])
    return linked.groupBy("user_id", "phone").agg(F.min_by("person_id", F.struct("observed_at", "id")).alias("person_id"))


def dm_thread_stats(raw: DataFrame) -> DataFrame:
    direct = raw.where("source = 'whatsapp' AND thread_id LIKE '%@s.whatsapp.net'")
    phone = F.concat(F.lit("+"), F.regexp_replace("thread_id", r"@s\.whatsapp\.net$", ""))
    return direct.groupBy("user_id", "thread_id", phone.alias("phone")).agg(F.count("*").alias("message_count"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"))


def group_thread_phones(raw: DataFrame) -> DataFrame:
    """raw with participant_phones: count and last time of each phone in each group thread."""
    rows = raw.where("source = 'whatsapp' AND thread_id LIKE '%@g.us'").select("user_id", "thread_id", "occurred_at", F.explode("participant_phones").alias("phone"))
    return rows.groupBy("user_id", "thread_id", "phone").agg(F.count("*").alias("message_count"), F.max("occurred_at").alias("last_at"))


def group_thread_lids(raw: DataFrame) -> DataFrame:
    """Group rows whose first participant goes by a device id."""
    jid = F.get("participants_raw", F.lit(0))["jid"]
    rows = raw.where("source = 'whatsapp' AND thread_id LIKE '%@g.us'").withColumn("jid", jid).where("jid LIKE '%@lid'")
    lid = F.split_part("jid", F.lit("@"), F.lit(1))
    return rows.groupBy("user_id", "thread_id", lid.alias("lid")).agg(F.count("*").alias("message_count"), F.max("occurred_at").alias("last_at"))


def email_interactions(obs: DataFrame, links: DataFrame) -> DataFrame:
    mails = obs.where("kind = 'interaction'").where(F.get_json_object("payload", "$.channel") == "email")
    return person_observations(mails, links).groupBy(*PERSON).agg(F.count("*").alias("message_count"), F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at"))


def resolve_group_members(phones: DataFrame, lids: DataFrame, bridge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Group rows by phone, device ids by way of the bridge; and how many were resolved or dropped."""
    digits = F.regexp_replace("phone", "[^0-9]", "")
    known = bridge.select("user_id", "lid", F.when(digits != "", F.concat(F.lit("+"), digits)).alias("phone"))
    joined = lids.join(known, ["user_id", "lid"], "left")
    stats = joined.groupBy("user_id").agg(F.count_if(F.col("phone").isNotNull()).alias("resolved"), F.count_if(F.col("phone").isNull()).alias("dropped"))
    cols = ["user_id", "thread_id", "phone", "message_count", "last_at"]
    rows = phones.select(*cols).unionByName(joined.where("phone IS NOT NULL").select(*cols))
    return rows.groupBy("user_id", "thread_id", "phone").agg(F.sum("message_count").alias("message_count"), F.max("last_at").alias("last_at")), stats


def graph_nodes(cards: DataFrame) -> DataFrame:
    """One node per card; a card knows the first and last time of all its rows."""
    return cards.select(*PERSON, "name", "category", "company", "title", "relationship_to_me", F.size("phones").alias("phone_count"), F.size("emails").alias("email_count"), "first_seen", F.col("updated_at").alias("last_seen"))


def last_interaction(nodes: DataFrame, dms: DataFrame, groups: DataFrame, mails: DataFrame, phone_map: DataFrame) -> DataFrame:
    """Newest of direct, group and mail times of a person, else when it was last seen."""
    by_phone = dms.select("user_id", "phone", "last_at").unionByName(groups.select("user_id", "phone", "last_at"))
    times = by_phone.join(phone_map, ["user_id", "phone"]).select(*PERSON, "last_at").unionByName(mails.select(*PERSON, "last_at"))
    newest = times.groupBy(*PERSON).agg(F.max("last_at").alias("at"))
    return nodes.join(newest, PERSON, "left").withColumn("last_interaction_at", F.coalesce("at", "last_seen")).drop("at")


def _pairs_with_self(rows: DataFrame, self_ids: DataFrame) -> DataFrame:
    """rows with person_id and self (user_id, self_id) -> a < b; self and tenants without self drop out."""
    joined = rows.join(self_ids, "user_id").where("person_id <> self_id")
    return joined.withColumns({"a": F.least("person_id", "self_id"), "b": F.greatest("person_id", "self_id")})


def dm_edges(stats: DataFrame, phone_map: DataFrame, self_ids: DataFrame, as_of) -> DataFrame:
    when = F.lit(as_of).cast("timestamp")
    pairs = _pairs_with_self(stats.join(phone_map, ["user_id", "phone"]), self_ids).groupBy("user_id", "a", "b")
    out = pairs.agg(F.sum("message_count").alias("message_count"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
    return out.withColumn("type", F.lit("DM")).withColumn("weight", edge_weight(F.col("message_count"), F.col("last_at"), when))


def shared_group_edges(members: DataFrame, self_ids: DataFrame, as_of, max_members: int = 30) -> DataFrame:
    """members (user_id, thread_id, person_id, last_at).  Self is put in every thread before the cut to 2..max members.

    A thread's members are cut to one more than ``max_members`` while they are brought together, so that a row never holds
    more.  What travels is one row for each member of a thread, with those that follow on it: all threads of two persons meet where the
    first of them is, and are counted there.  Self, who is in every thread, comes last and so has no such row.
    """
    when, by = F.lit(as_of).cast("timestamp"), ["user_id", "thread_id"]
    once = members.groupBy(*by, "person_id").agg(F.max("last_at").alias("last_at"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("person_id"))
    rows = once.withColumn("r", rank).where(F.col("r") <= max_members + 1).groupBy(*by).agg(F.collect_list(F.struct("person_id", "last_at")).alias("m"))
    rows = rows.where(F.size("m") <= max_members).join(self_ids, "user_id", "left")
    newest = F.array_max(F.transform("m", lambda x: x["last_at"]))
    me = F.struct(F.col("self_id").alias("person_id"), newest.alias("last_at"))
    own = F.when(F.col("self_id").isNull(), F.array_sort("m")).otherwise(F.array_append(F.array_sort(F.filter("m", lambda x: x["person_id"] != F.col("self_id"))), me))
    rows = rows.select(*by, own.alias("m")).where(F.size("m").between(2, max_members))
    after = lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: F.struct(y["person_id"].alias("other"), F.greatest(x["last_at"], y["last_at"]).alias("at")))
    firsts = F.transform("m", lambda x, i: F.struct(x["person_id"].alias("first"), after(x, i).alias("others")))
    dealt = rows.select(*by, F.explode(firsts).alias("f")).select(*by, "f.first", "f.others").where(F.size("others") > 0).repartition("user_id", "first")
    each = dealt.select(*by, "first", F.explode("others").alias("o")).select(*by, "first", "o.other", "o.at")
    # counted apart from the list, which is then made only where it is asked for
    out = each.groupBy("user_id", "first", "other").agg(F.array_sort(F.collect_list("thread_id")).alias("group_ids"), F.max("at").alias("last_at"), F.count("thread_id").alias("group_count"))
    turned = F.col("other") < F.col("first")
    ends = [F.when(turned, F.col(y)).otherwise(F.col(x)).alias(n) for n, x, y in (("a", "first", "other"), ("b", "other", "first"))]
    out = out.select("user_id", *ends, "group_ids", "last_at", "group_count")
    return out.withColumn("type", F.lit("SHARED_GROUP")).withColumn("weight", edge_weight(F.col("group_count"), F.col("last_at"), when))


def emailed_edges(stats: DataFrame, self_ids: DataFrame, as_of) -> DataFrame:
    when = F.lit(as_of).cast("timestamp")
    out = _pairs_with_self(stats, self_ids).select("user_id", "a", "b", "message_count", F.col("message_count").alias("thread_count"), "first_at", "last_at")
    return out.withColumn("type", F.lit("EMAILED")).withColumn("weight", edge_weight(F.col("message_count"), F.col("last_at"), when))


def merge_graph(old_nodes: DataFrame, old_edges: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The new graph: edges whose both ends exist; and how many rows were written and pruned."""
    ids = nodes.select("user_id", F.col("person_id").alias("a"))
    kept = edges.join(ids, ["user_id", "a"], "left_semi").join(ids.withColumnRenamed("a", "b"), ["user_id", "b"], "left_semi")
    key = ["user_id", "type", "a", "b"]
    counts = [
        nodes.agg(F.lit("nodes_written").alias("what"), F.count("*").alias("n")),
        kept.agg(F.lit("edges_written").alias("what"), F.count("*").alias("n")),
        old_nodes.join(nodes, PERSON, "left_anti").agg(F.lit("nodes_pruned").alias("what"), F.count("*").alias("n")),
        old_edges.select(*key).join(kept.select(*key), key, "left_anti").agg(F.lit("edges_pruned").alias("what"), F.count("*").alias("n")),
    ]
    stats = counts[0]
    for more in counts[1:]:
        stats = stats.unionByName(more)
    return nodes, kept, stats


def both_ends(edges: DataFrame) -> DataFrame:
    return edges.select("user_id", F.col("a").alias("x"), F.col("b").alias("y"), "type", "weight").unionByName(edges.select("user_id", F.col("b").alias("x"), F.col("a").alias("y"), "type", "weight"))


def score_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree score ``2 ln(1 + edges)``; counting is combined on the map side, so a node in every thread is no hot spot."""
    degree = both_ends(edges).groupBy("user_id", F.col("x").alias("person_id")).agg(F.count("*").alias("edge_count"))
    n = F.coalesce("edge_count", F.lit(0))
    return nodes.join(degree, PERSON, "left").withColumn("edge_count", n).withColumn("score", 2 * F.log1p(n.cast("double")))


def going_cold(nodes: DataFrame, as_of, days: int = 14, min_score: float = 2.0) -> DataFrame:
    since = days_between(F.lit(as_of).cast("timestamp"), F.col("last_interaction_at"))
    return nodes.withColumn("days_since", F.floor(since).cast("long")).where((F.col("score") > min_score) & (since > days)).orderBy("last_interaction_at", "person_id")


def graph_view(nodes: DataFrame, edges: DataFrame, as_of) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes with defaults and labels, each edge once, and totals per tenant."""
    shown = nodes.withColumn("category", F.coalesce("category", F.lit("other"))).withColumn("label", F.when(~is_junk_label(F.col("name")), F.col("name")))
    once = edges.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")}).dropDuplicates(["user_id", "type", "a", "b"])
    cold = going_cold(nodes, as_of).groupBy("user_id").agg(F.count("*").alias("going_cold"))
    stats = nodes.groupBy("user_id").agg(F.count("*").alias("persons")).join(cold, "user_id", "left").na.fill(0, ["going_cold"])
    return shown, once, stats


def neighbors(edges: DataFrame, ids: DataFrame, types: list[str] | None = None) -> DataFrame:
    own = both_ends(edges)
    own = own.where(F.col("type").isin(*types)) if types else own
    asked = ids.select("user_id", F.col("person_id").alias("x"))
    return own.join(asked, ["user_id", "x"]).select("user_id", F.col("x").alias("person_id"), F.col("y").alias("neighbor_id"), "type", "weight")


#: Neighbours of a node that meet in one key of a join, about.
NEIGHBORS = 1 << 16


def _onward(front: DataFrame, step: DataFrame, hubs: DataFrame) -> DataFrame:
    """Rows of ``front`` with each step from where they stand; the steps of a hub are dealt into parts, and what stands there goes to all of them."""
    front = front.join(hubs, ["user_id", "at"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0))))).drop("parts")
    return front.join(step, ["user_id", "at", "part"]).drop("part")


def _frontier(starts: DataFrame, step: DataFrame, hubs: DataFrame, hops: int, back: bool) -> list[DataFrame]:
    """starts (user_id, end) -> for 0 to ``hops`` hops the nodes (user_id, end, at) first reached then, with the smallest path between, in reading order.

    Of a path only what lies between ``end`` and ``at`` is carried along.
    """
    key = ["user_id", "end"]
    none = F.array().cast("array<string>")
    levels = [starts.select(*key, F.col("end").alias("at"), none.alias("inner"), none.alias("types"), F.lit(0.0).alias("weight"))]
    for hop in range(hops):
        rows = _onward(levels[-1], step, hubs)
        passed = F.array("at") if hop else none
        both = (F.concat(passed, "inner"), F.concat(F.array("t"), "types")) if back else (F.concat("inner", passed), F.concat("types", F.array("t")))
        rows = rows.select(*key, F.col("next").alias("at"), F.struct(both[0].alias("inner"), both[1].alias("types"), (F.col("weight") + F.col("w")).alias("weight")).alias("m"))
        for level in levels:
            rows = rows.join(level.select(*key, "at"), [*key, "at"], "left_anti")
        levels.append(cut(rows.groupBy(*key, "at").agg(F.min("m").alias("m")).select(*key, "at", "m.inner", "m.types", "m.weight")))
    return levels


#: So many times more ends on one side, and all hops are gone from the other.
FEWER = 4096


def _sides(n_sources: int, n_targets: int, max_hops: int) -> tuple[int, int]:
    """Hops to go from the sources and from the targets: half each, but all from a side with far fewer ends."""
    if n_sources * FEWER <= n_targets:
        return max_hops, 0
    if n_targets * FEWER <= n_sources:
        return 0, max_hops
    return (max_hops + 1) // 2, max_hops // 2


def intro_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = 4) -> DataFrame:
    """pairs (user_id, source, target) -> hops, path, edge types and weights of the shortest path, at most ``max_hops``.

    Of equal paths the smallest node list wins, of parallel edges the heaviest.  Levels go out from the different sources and from the different
    targets, half the hops each (all from one side where it has far fewer ends), and pairs with one end share its levels.  A pair is settled by the least sum of levels at which
    the two sides hold a common node.  Of such nodes the one whose path is smallest counts: for a given node and number
    of hops on either side, the smallest path is the smallest one to it with the smallest one from it.  A level of the sources meets those of the targets
    that follow on it at once.
    """
    best = both_ends(edges).groupBy("user_id", "x", "y").agg(F.max(F.struct("weight", "type")).alias("e"))
    degree = best.groupBy("user_id", F.col("x").alias("at")).agg(F.ceil(F.count("*") / NEIGHBORS).cast("int").alias("parts"))
    hubs = cut(degree.where("parts > 1"))
    step = best.select("user_id", F.col("x").alias("at"), F.col("y").alias("next"), F.col("e.weight").alias("w"), F.col("e.type").alias("t")).join(hubs, ["user_id", "at"], "left")
    step = cut(step.withColumn("part", F.pmod(F.xxhash64("next"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts"))
    asked = cut(pairs.select("user_id", "source", "target").where("source IS NOT NULL AND target IS NOT NULL").distinct())
    ends = lambda c: asked.select("user_id", F.col(c).alias("end")).distinct()
    forth, from_there = _sides(ends("source").count(), ends("target").count(), max_hops)
    out, back = _frontier(ends("source"), step, hubs, forth, False), _frontier(ends("target"), step, hubs, from_there, True)
    # levels that meet at once: of all that go on from one side, or one of the sources' with those of the targets' that follow on it
    meetings: dict[int, list[int]] = {}
    for hops in range(max_hops + 1):
        i = min(forth, max(hops - from_there, (hops + 1) // 2))
        meetings.setdefault(i, []).append(hops - i)
    groups = [(list(meetings), [0])] if from_there == 0 else [([i], js) for i, js in meetings.items()]
    left, found = asked, []
    for near_levels, far_levels in groups:
        side = lambda levels, ks, end, n, k: reduce(DataFrame.unionByName, [levels[x].select("user_id", F.col("end").alias(end), "at", *[F.col(c).alias(f"{c}{n}") for c in ("inner", "types", "weight")], F.lit(x).alias(k)) for x in ks])
        near, far = side(out, near_levels, "source", 1, "i"), side(back, far_levels, "target", 2, "j")
        # a side that has gone no hop has one row for each of its ends, so it comes first: pairs with the other side's nodes would be as many as both multiplied
        if from_there == 0:
            met_ = left.join(far, ["user_id", "target"]).join(near, ["user_id", "source", "at"])
        else:
            met_ = left.join(near, ["user_id", "source"]).join(far, ["user_id", "target", "at"])
        none = F.array().cast("array<string>")
        between = F.when((F.col("i") > 0) & (F.col("j") > 0), F.array("at")).otherwise(none)
        last = F.when(F.col("i") + F.col("j") > 0, F.array("target")).otherwise(none)
        whole = F.struct((F.col("i") + F.col("j")).alias("hops"), F.concat(F.array("source"), "inner1", between, "inner2", last).alias("path"), F.concat("types1", "types2").alias("types"), (F.col("weight1") + F.col("weight2")).alias("weight"))
        done = cut(met_.groupBy("user_id", "source", "target").agg(F.min(whole).alias("m")).select("user_id", "source", "target", "m.path", "m.types", "m.weight"))
        found.append(done)
        left = left.join(done, ["user_id", "source", "target"], "left_anti")
    paths = reduce(DataFrame.unionByName, found)
    return pairs.select("user_id", "source", "target").distinct().join(paths, ["user_id", "source", "target"], "left").withColumn("hops", F.when(F.col("path").isNotNull(), F.size("path") - 1))


def connected_core(nodes: DataFrame, edges: DataFrame, self_ids: DataFrame, n: int = 200) -> tuple[DataFrame, DataFrame]:
    """Self and the ``n`` best-scored persons with an edge, per tenant; edges among them with positive weight."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "person_id"))
    linked = nodes.where("edge_count > 0").withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")
    own = nodes.join(self_ids.select("user_id", F.col("self_id").alias("person_id")), PERSON, "left_semi")
    core = linked.unionByName(own.join(linked, PERSON, "left_anti"))
    ids = core.select("user_id", F.col("person_id").alias("a"))
    kept = edges.where("weight > 0").join(ids, ["user_id", "a"], "left_semi").join(ids.withColumnRenamed("a", "b"), ["user_id", "b"], "left_semi")
    return core, kept


def co_presence_edges(memberships: DataFrame, max_members: int = 30) -> DataFrame:
    """memberships (user_id, source, event_id, person_id) -> pairs seen together, with evidence, sources and strength."""
    by = ["user_id", "source", "event_id"]
    once = memberships.select(*by, "person_id").distinct()
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("person_id"))
    rows = once.withColumn("r", rank).where(F.col("r") <= max_members + 1).groupBy(*by).agg(F.array_sort(F.collect_list("person_id")).alias("m")).where(F.size("m").between(2, max_members))
    each = F.flatten(F.transform("m", lambda x, i: F.transform(F.filter("m", lambda y, j: j > i), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = rows.select("user_id", "source", F.explode(each).alias("p")).select("user_id", "source", "p.*").groupBy("user_id", "a", "b").agg(F.count("*").alias("evidence"), F.count_distinct("source").alias("sources"))
    return pairs.withColumn("strength", knows_strength(F.col("evidence"), F.col("sources") > 1))


def manifest_network(manifest: DataFrame, n: int = 200) -> DataFrame:
    """Pairs of the ``n`` most active manifest rows that share a group, with the number shared."""
    top = manifest.orderBy(F.desc("thread_count"), "id").limit(n).select("id", F.explode("groups").alias("g"))
    a, b = top.withColumnRenamed("id", "a"), top.withColumnRenamed("id", "b")
    return a.join(b, "g").where("a < b").groupBy("a", "b").agg(F.count_distinct("g").alias("value"))


def resolve_self(obs: DataFrame, links: DataFrame, profiles: DataFrame) -> DataFrame:
    """profiles (user_id, emails, phones): newest person observation with a self e-mail, else with a self phone."""
    known = handles(obs).join(links.select("user_id", "person_id", F.col("observation_id").alias("id")), ["user_id", "id"])

    def by(kind: str, col: str) -> DataFrame:
        asked = profiles.select("user_id", F.explode(col).alias("v")).select("user_id", F.concat(F.lit(f"{kind}:"), F.lower(F.trim("v"))).alias("handle"))
        return known.join(asked, ["user_id", "handle"]).groupBy("user_id").agg(F.max_by("person_id", F.struct("observed_at", "id")).alias(kind))

    out = profiles.select("user_id").join(by("email", "emails"), "user_id", "left").join(by("phone", "phones"), "user_id", "left")
    return out.select("user_id", F.coalesce("email", "phone").alias("self_id"))


def self_fallback(nodes: DataFrame, phone_map: DataFrame, profiles: DataFrame) -> DataFrame:
    """profiles (user_id, phone, email): the phone's person, else the first node whose name begins like the address."""
    by_phone = profiles.join(phone_map, ["user_id", "phone"]).select("user_id", F.col("person_id").alias("p"))
    head = F.substring(F.lower(F.split_part("email", F.lit("@"), F.lit(1))), 1, 6)
    asked = profiles.select("user_id", head.alias("head")).where("head <> ''")
    by_name = nodes.join(asked, "user_id").where(F.startswith(F.lower("name"), F.col("head"))).groupBy("user_id").agg(F.min("person_id").alias("n"))
    return profiles.select("user_id").join(by_phone, "user_id", "left").join(by_name, "user_id", "left").select("user_id", F.coalesce("p", "n").alias("self_id"))
