"""Ledger, cards, identity and graph on small tables of invented persons."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tieledger.operators import activity, cards, graph, identity, intake, links, metrics
from tieledger.operators.components import connected_components
from tieledger.sources import readers, writers
from tieledger.streaming import streams

OBS = "user_id string, id string, observed_at timestamp, ingested_at timestamp, kind string, evidence_pointer string, seq long, payload string"


def observations(spark, rows):
    made = [("t", i, n, kind, payload) for n, (i, kind, payload) in enumerate(rows)]
    df = spark.createDataFrame([(t, i, n, k, json.dumps(p)) for t, i, n, k, p in made], "user_id string, id string, seq long, kind string, payload string")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq") * 86400)
    return df.withColumns({"observed_at": at, "ingested_at": at, "evidence_pointer": F.concat(F.lit("x://"), "id")})


def linked(spark, ids, person="P"):
    return spark.createDataFrame([("t", person, i) for i in ids], "user_id string, person_id string, observation_id string")


def test_fold(spark):
    rows = [
        ("1", "person", {"name": "Ann", "company": "Old", "phones": ["+911"], "emails": ["a@acme.test"], "category": "other", "relationship_to_me": "friend of a friend"}),
        ("2", "person", {"name": "", "company": None, "phones": ["+912", "+911"], "title": "Lead"}),
        ("3", "correction", {"target_person_id": "P", "field": "emails", "new_value": ["b@acme.test", "b@acme.test"]}),
        ("4", "person", {"name": "Ann Lee", "emails": ["a@acme.test"], "title": ""}),
        ("5", "correction", {"target_person_id": "P", "field": "phones", "new_value": "wrong type"}),
        ("6", "interaction", {"channel": "meeting", "summary": "met"}),
        ("7", "interaction", {"channel": "", "summary": "met again", "title": "Lunch"}),
    ]
    obs = observations(spark, rows)
    card = cards.fold_person_cards(obs, linked(spark, [r[0] for r in rows]), "2023-11-30 22:13:20").first()
    assert (card["name"], card["company"], card["title"], card["category"], card["relationship_to_me"]) == ("Ann Lee", None, None, "other", "friend of a friend")
    assert card["phones"] == ["+911", "+912"] and card["emails"] == ["b@acme.test", "a@acme.test"]
    assert card["activity_count"] == 2 and card["last_activity"]["type"] == "interaction" and card["last_activity"]["title"] == "Lunch" and card["days_ago"] == 10


def test_documents(spark):
    rows = [(f"i{k}", "interaction", {"channel": "email", "summary": f"s{k}"}) for k in range(25)] + [(f"c{k}", "correction", {"field": "name", "new_value": str(k)}) for k in range(15)]
    doc = cards.assemble_cards(cards.card_rows(observations(spark, rows), linked(spark, [r[0] for r in rows]))).first()
    assert len(doc["interactions"]) == 20 and len(doc["recent_corrections"]) == 10 and doc["total"] == 40
    assert [x["text"] for x in doc["interactions"]][-1] == "s24"


def test_ingest_twice_is_once(spark):
    raw = spark.createDataFrame([("t", "whatsapp", "a", 1, "one"), ("t", "whatsapp", "a", 2, "two"), ("t", "whatsapp", "b", 3, "x")], "user_id string, source string, source_event_id string, seq long, body string")
    new, counts = intake.ingest_raw_events(None, raw)
    assert sorted(r["body"] for r in new.collect()) == ["one", "x"] and tuple(counts.first()) == (2, 1)
    again, counts = intake.ingest_raw_events(new, raw)
    assert again.count() == 0 and tuple(counts.first()) == (0, 3)


def test_links(spark):
    rows = [
        ("m1", "merge", {"person_id": "P", "merged_observation_ids": ["a", "b"]}),
        ("s1", "split", {"person_id": "P", "split_off_observation_ids": ["b"]}),
        ("m2", "merge", {"person_id": "P", "merged_observation_ids": ["a"]}),
        ("n1", "note", {"target_person_id": "P", "content": "x"}),
    ]
    got = {(r["observation_id"], r["linked_by_observation_id"]) for r in links.resolve_links(links.link_events(observations(spark, rows))).collect()}
    assert got == {("a", "m1"), ("m1", "m1"), ("m2", "m2"), ("n1", "n1")}


def test_autolink_goes_on(spark):
    rows = [("a", "person", {"name": "A", "phones": ["+1"]}), ("b", "person", {"name": "B", "phones": ["+1", "+2"]}), ("c", "person", {"name": "C", "phones": ["+2"]}), ("d", "person", {"name": "D", "phones": ["+9"]})]
    got = links.autolink_persons(observations(spark, rows), linked(spark, ["a"]))
    assert {(r["observation_id"], r["person_id"]) for r in got.collect()} == {("b", "P"), ("c", "P")}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 120)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in list(parent)}


def test_no_components(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_manifest(spark):
    chats = spark.createDataFrame([("911111111111@s.whatsapp.net", "m1", 100, 0, "911111111111@s.whatsapp.net", "Ann", "Ann"), ("g1@g.us", "m2", 200, 0, "77:2@lid", "Bob Stone", "Club"), ("g1@g.us", "m3", 300, 1, None, None, "Club")], "chat_jid string, msg_id string, ts long, from_me int, sender_jid string, sender_name string, chat_name string")
    lids = spark.createDataFrame([("77", "912222222222")], "lid string, pn string")
    book = spark.createDataFrame([("Bob Q Stone", ["+91 22222 22222"], ["bob@acme.test"])], "name string, phones array<string>, emails array<string>")
    mail = spark.createDataFrame([("th", 1, {"from": "Ann Marie Poe <ann@acme.test>", "to": "me@acme.test"}), ("th2", 2, {"from": "x@acme.test", "list-id": "l"})], "thread_id string, s long, headers map<string,string>").withColumn("sent_at", F.timestamp_seconds("s"))
    contacts = spark.createDataFrame([("911111111111@s.whatsapp.net", "911111111111", None, "Ann Marie Poe", None)], "jid string, phone string, push_name string, full_name string, first_name string")
    parts = [identity.evidence_contacts(contacts, lids), identity.evidence_dms(chats), identity.evidence_groups(chats, lids), identity.evidence_mail(mail, ["me@acme.test"]), identity.evidence_address_book(book)]
    evidence = parts[0]
    for p in parts[1:]:
        evidence = evidence.unionByName(p)
    got = {r["name"]: r for r in identity.build_manifest(evidence, ["me@acme.test"], [], []).collect()}
    assert set(got) == {"Ann Marie Poe", "Bob Q Stone"}
    ann, bob = got["Ann Marie Poe"], got["Bob Q Stone"]
    assert ann["phones"] == ["+911111111111"] and ann["emails"] == ["ann@acme.test"]  # bridged by name
    assert bob["phones"] == ["+912222222222"] and bob["lids"] == ["77"] and bob["groups"] == ["Club"] and bob["id"].startswith("local-")


def test_blocked_bridge_agrees_with_exhaustive(spark):
    draw = random.Random(4)
    first, last = ["ann", "bert", "carla", "dora", "emil"], ["stone", "rivers", "hill", "woods"]
    rows = [(f"phone:{i}", f"{draw.choice(first)} {draw.choice(last)}", True, False) for i in range(20)] + [(f"email:{i}", f"{draw.choice(last)} {draw.choice(first)}", False, True) for i in range(20)]
    df = spark.createDataFrame(rows, "min_node string, name string, wa_dm boolean, gmail_from boolean")
    df = df.withColumns({c: F.lit(False) for c in ("wa_contact", "wa_group", "google_contact", "gmail_to_cc")})
    a, b = (sorted(tuple(r) for r in identity.cross_channel_candidates(df, exhaustive=e).select("chat_node", "mail_node", "score").collect()) for e in (False, True))
    assert a == b and a
    pairs = identity.cross_channel_bridge(identity.cross_channel_candidates(df)).collect()
    assert len({r["mail_node"] for r in pairs}) == len(pairs) == len({r["chat_node"] for r in pairs})


def test_one_token_names_that_begin_unlike(spark):
    """No pair over the cutoff is missed, whatever the first letters."""
    draw, letters = random.Random(8), "abcdeorst"
    base = ["katherine", "catherine", "joanna", "johanna", "mohammed", "muhammed", "jonathan", "jonatan", "yonathan", "anna stone", "stone"] + ["".join(draw.choice(letters) for _ in range(draw.randrange(5, 12))) for _ in range(30)]
    slips = [w[1:] if k % 3 == 0 else draw.choice(letters) + w[1:] if k % 3 == 1 else w[: len(w) // 2] + draw.choice(letters) + w[len(w) // 2 :] for k, w in enumerate(base)]
    rows = [(f"phone:{i}", n, True, False) for i, n in enumerate(base)] + [(f"email:{i}", n, False, True) for i, n in enumerate(slips + base[:11])]
    df = spark.createDataFrame(rows, "min_node string, name string, wa_dm boolean, gmail_from boolean")
    df = df.withColumns({c: F.lit(False) for c in ("wa_contact", "wa_group", "google_contact", "gmail_to_cc")})
    a, b = (sorted(tuple(r) for r in identity.cross_channel_candidates(df, exhaustive=e).select("chat_node", "mail_node", "score").collect()) for e in (False, True))
    assert a == b and len(a) > 20


def test_canonical_names(spark):
    rows = [
        ("1", "Ramon Berrios", ["h1"]), ("2", "Ramon B", ["h2"]), ("3", "Suhas", ["h3"]), ("4", "Suhas Sumukh", ["h4"]), ("5", "~ Deepak Sai Pendyala", ["h5"]), ("6", "Deepak Sai Pendyla", ["h6"]),
        ("7", "Olga Maria Winter", ["h7"]), ("8", None, ["olga.maria.winter@x.test"]), ("9", "Ann", ["h9"]), ("10", "Ann Lee", ["h10"]), ("11", "Other Name", ["h10"]), ("12", "Ramon Xu", ["h12"]),
    ]
    got = {r["id"]: (r["component"], r["display_name"]) for r in identity.canonical_names(spark.createDataFrame(rows, "id string, name string, handles array<string>")).collect()}
    same = lambda a, b: got[a][0] == got[b][0]
    assert same("1", "2") and same("3", "4") and same("5", "6") and same("7", "8") and same("10", "11")
    assert not same("9", "10") and not same("12", "1") and got["2"][1] == "Ramon Berrios" and got["8"][1] == "Olga Maria Winter"


def test_group_cut_counts_self(spark):
    rows = [("t", "g", f"P{i}", 0) for i in range(30)] + [("t", "h", "P0", 0), ("t", "h", "P1", 0)]
    members = spark.createDataFrame(rows, "user_id string, thread_id string, person_id string, s long").withColumn("last_at", F.timestamp_seconds("s"))
    me = spark.createDataFrame([("t", "ME")], "user_id string, self_id string")
    got = {(r["a"], r["b"]) for r in graph.shared_group_edges(members, me, "2024-01-01").collect()}
    assert got == {("P0", "P1"), ("ME", "P0"), ("ME", "P1")}  # thirty members and self are too many


def test_paths(spark):
    edges = spark.createDataFrame([("t", "a", "b", "DM", 1.0), ("t", "b", "c", "DM", 2.0), ("t", "b", "c", "EMAILED", 3.0), ("t", "c", "d", "DM", 1.0), ("t", "x", "y", "DM", 1.0)], "user_id string, a string, b string, type string, weight double")
    pairs = spark.createDataFrame([("t", "a", "d"), ("t", "a", "a"), ("t", "a", "y")], "user_id string, source string, target string")
    got = {(r["source"], r["target"]): r for r in graph.intro_paths(edges, pairs).collect()}
    assert got["a", "d"]["path"] == ["a", "b", "c", "d"] and got["a", "d"]["types"] == ["DM", "EMAILED", "DM"] and got["a", "d"]["weight"] == 5.0
    assert got["a", "a"]["hops"] == 0 and got["a", "y"]["hops"] is None


def test_recurring(spark):
    rows = [("t", f"w{i}", f"Sync 2024-01-0{i} 7", 604_800 * i, ["a@acme.test"]) for i in range(1, 5)] + [("t", "once", "Lunch", 5, ["b@acme.test"])]
    events = spark.createDataFrame(rows, "user_id string, id string, summary string, s long, attendees array<string>").withColumn("start_at", F.timestamp_seconds("s"))
    got = {r["id"]: (r["cadence"], r["occurrences"]) for r in metrics.collapse_recurring(events).collect()}
    assert got == {"w4": ("weekly", 4), "once": (None, None)}


def test_meetings(spark):
    rows = [("m", "x", "confirmed", None, False, [("me@acme.test", "Me"), ("a@acme.test", "A")]), ("n", "x", "cancelled", None, False, [("a@acme.test", "A")]), ("o", "x", None, "outOfOffice", False, [("a@acme.test", "A")]), ("p", "x", None, None, False, [("me@acme.test", "Me")])]
    events = spark.createDataFrame(rows, "id string, title string, status string, event_type string, all_day boolean, attendees array<struct<email:string,name:string>>")
    got = activity.eligible_meetings(events, ["me@acme.test"]).collect()
    assert [r["id"] for r in got] == ["m"] and [a["email"] for a in got[0]["attendees"]] == ["a@acme.test"]


def test_backfill(spark):
    pairs = spark.createDataFrame([("555 010 2030", "New@acme.test"), ("12", "a@acme.test"), ("555 010 9999", "b@acme.test"), ("555 010 4040", "c@acme.test")], "phone string, email string")
    own = spark.createDataFrame([("P", ["+15550102030"], ["old@acme.test"]), ("Q", ["+15550104040"], []), ("R", ["+15550104040"], [])], "person_id string, phones array<string>, emails array<string>")
    found, counts = activity.backfill_emails(pairs, own)
    assert [tuple(r) for r in found.collect()] == [("P", "new@acme.test")]
    assert {r["reason"]: r["count"] for r in counts.collect()} == {"candidate": 1, "invalid": 1, "no_match": 1, "ambiguous": 1}


def test_readers(spark, tmp_path):
    (tmp_path / "mail.json").write_text('{"id": "1", "threadId": "t", "internalDate": "1000", "payload": {"headers": [{"name": "From", "value": "A <a@acme.test>"}]}}\nnot json\n')
    got = readers.read_mail(spark, str(tmp_path / "mail.json")).collect()
    assert len(got) == 1 and got[0]["headers"] == {"from": "A <a@acme.test>"}
    (tmp_path / "book.json").write_text(json.dumps({"connections": [{"names": [{"displayName": "A"}], "phoneNumbers": [{"value": "1"}]}, {"names": [{"unstructuredName": "B"}]}]}))
    assert [(r["name"], r["phones"]) for r in readers.read_contacts(spark, str(tmp_path / "book.json")).collect()] == [("A", ["1"]), ("B", [])]
    good = {"user_id": "t", "id": "o", "observed_at": "2024-01-01T00:00:00Z", "observer": "me", "kind": "note", "evidence_pointer": "p", "confidence": 0.5, "reasoning": "r", "payload": {"target_person_id": "P", "content": "c"}}
    bad = good | {"kind": "person"}
    (tmp_path / "obs.ndjson").write_text("\n".join([json.dumps(good), "", json.dumps(bad), "{broken"]) + "\n")
    valid, rejects, summary = readers.read_observations(spark, str(tmp_path / "obs.ndjson"))
    assert valid.count() == 1 and {r["line_no"] for r in rejects.collect()} == {3, 4}
    assert tuple(summary.first()) == (3, 1, 2)


def test_writers_are_deterministic(spark, tmp_path):
    df = spark.createDataFrame([(f"n{i}", i) for i in range(50)], "min_node string, x int").repartition(5)
    texts = []
    for k in range(2):
        writers.write_manifest(df, str(tmp_path / f"m{k}"))
        texts.append("".join(p.read_text() for p in sorted((tmp_path / f"m{k}").glob("part-*"))))
    assert texts[0] == texts[1] and texts[0].startswith('{"x":0}')
    nodes = spark.createDataFrame([("t", "a"), ("u", "b")], "user_id string, person_id string")
    writers.write_graph(nodes, nodes, str(tmp_path / "g"))
    writers.write_graph(nodes.where("user_id = 't'").withColumn("person_id", F.lit("z")), nodes.limit(0), str(tmp_path / "g"))
    assert {tuple(r) for r in writers.read_graph(spark, str(tmp_path / "g"))[0].select("user_id", "person_id").collect()} == {("t", "z"), ("u", "b")}


def test_streams(spark, tmp_path):
    schema = "user_id string, source string, source_event_id string, seq long, body string, thread_id string, occurred_at timestamp"
    rows = [("t", "whatsapp", "a", 1, "one", "1@s.whatsapp.net", None), ("t", "whatsapp", "a", 2, "two", "1@s.whatsapp.net", None), ("t", "whatsapp", "b", 3, "x", "1@s.whatsapp.net", None)]
    for k in range(2):
        spark.createDataFrame(rows, schema).withColumn("occurred_at", F.timestamp_seconds("seq")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        read = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        streams.stream_raw_events(read, str(tmp_path / "raw"), str(tmp_path / "c1")).awaitTermination()
        streams.stream_thread_stats(read, str(tmp_path / "stats"), str(tmp_path / "c2")).awaitTermination()
        assert sorted(r["body"] for r in spark.read.parquet(str(tmp_path / "raw")).collect()) == ["one", "x"]
    newest = spark.read.parquet(str(tmp_path / "stats")).orderBy(F.desc("message_count")).first()
    assert newest["message_count"] == 6


def test_streamed_observations(spark, tmp_path):
    rows = observations(spark, [("m", "merge", {"person_id": "P", "merged_observation_ids": ["a"]}), ("n", "note", {"target_person_id": "P", "content": "c"})])
    rows.write.parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for k in range(2):  # the second run reads all again under a new checkpoint
        streams.stream_observations(read, str(tmp_path / "obs"), str(tmp_path / "links"), str(tmp_path / f"c{k}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "obs")).count() == 2 and spark.read.parquet(str(tmp_path / "links")).count() == 3
