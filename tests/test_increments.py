"""What is kept between runs against the same worked out from the start."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tieledger.operators import cards, graph
from tieledger.operators.components import connected_components, extend_components
from tieledger.operators.numbering import numbered
from tieledger.sources import readers, writers
from tieledger.sources.versions import Versions

AS_OF = "2024-03-01"


def invented_rows(draw, n):
    """Rows in no order of time, with corrections of lists that come late."""
    out = []
    for k in range(n):
        phones = draw.sample(["+1", "+2", "+3", "+4"], draw.randrange(3))
        kind, payload = draw.choice([
            ("person", {"name": draw.choice(["Ann", "Bo", ""]), "company": draw.choice([None, "", "Acme"]), "phones": phones, "emails": ["a@x.test"], "category": "other"}),
            ("person", {"emails": draw.sample(["a@x.test", "b@x.test", "c@x.test"], 2)}),
            ("correction", {"field": draw.choice(["phones", "emails"]), "new_value": draw.choice([phones, [], "wrong type"])}),
            ("correction", {"field": draw.choice(["name", "company", "relationship_strength"]), "new_value": draw.choice(["New", "", None])}),
            ("interaction", {"channel": draw.choice(["", "email"]), "title": f"t{k}"}),
            ("note", {"content": "c"}),
        ])
        out.append(("t", f"o{k}", draw.randrange(40), kind, json.dumps(payload), draw.choice("PQR"), draw.randrange(4)))
    return out


@pytest.fixture(scope="module")
def ledger(spark):
    rows = spark.createDataFrame(invented_rows(random.Random(3), 150), "user_id string, id string, s long, kind string, payload string, person_id string, batch int")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s") * 3600)
    return rows.withColumns({"observed_at": at, "ingested_at": at}).cache()


def parts(rows):
    return rows.select("user_id", "id", "observed_at", "ingested_at", "kind", "payload"), rows.select("user_id", "person_id", F.col("id").alias("observation_id"))


def rows_of(df):
    return sorted(str(r) for r in df.collect())


def test_cards_by_batches(spark, ledger, tmp_path):
    versions, done = Versions(spark, str(tmp_path / "cards")), None
    for k in (2, 0, 3, 1):
        part = ledger.where(f"batch = {k}")
        done = part if done is None else done.unionByName(part)
        states = cards.advance_cards(versions, *parts(part), f"batch {k}")
        cards.advance_cards(versions, *parts(part), f"batch {k}")  # again, to no effect
        assert rows_of(cards.finish_cards(states, AS_OF)) == rows_of(cards.fold_person_cards(*parts(done), AS_OF))
    # a third of P's rows go to Q
    moved = ledger.withColumn("person_id", F.when((F.col("person_id") == "P") & (F.col("s") % 3 == 0), "Q").otherwise(F.col("person_id")))
    obs, links = parts(moved)
    again = spark.createDataFrame([("t", "P"), ("t", "Q")], "user_id string, person_id string")
    states = cards.advance_cards(versions, obs.limit(0), links.limit(0), "split", again, obs, links)
    assert rows_of(cards.finish_cards(states, AS_OF)) == rows_of(cards.fold_person_cards(obs, links, AS_OF))
    assert versions.latest().number == 4


def test_components_by_batches(spark):
    draw = random.Random(6)
    edges = [(draw.randrange(120), draw.randrange(120)) for _ in range(110)] + [(7, 7), (None, 3)]
    made = lambda rows: spark.createDataFrame(rows, "a long, b long")
    labels, done = connected_components(made(edges[:20])), edges[:20]
    for at in range(20, len(edges), 30):
        labels, done = extend_components(labels, made(edges[at : at + 30])), done + edges[at : at + 30]
        assert rows_of(labels) == rows_of(connected_components(made(done)))
    assert rows_of(extend_components(labels, made([]))) == rows_of(labels)


def test_graph_is_swapped_whole(spark, tmp_path, monkeypatch):
    """A run that dies between nodes and edges leaves both as they were; many tenants' versions are brought together."""
    monkeypatch.setattr(writers, "MOST_VERSIONS", 3)
    path = str(tmp_path / "g")
    nodes = lambda tenants, k: spark.createDataFrame([(t, f"{t}{k}{i}") for t in tenants for i in range(2)], "user_id string, person_id string")
    edges = lambda tenants, k: spark.createDataFrame([(t, f"{t}{k}0", f"{t}{k}1") for t in tenants], "user_id string, a string, b string")

    def seen():
        n, e = writers.read_graph(spark, path)
        return {r["person_id"] for r in n.collect()}, {(r["a"], r["b"]) for r in e.collect()}

    def graph(of):
        return {f"{t}{k}{i}" for t, k in of.items() for i in range(2)}, {(f"{t}{k}0", f"{t}{k}1") for t, k in of.items()}

    now = dict.fromkeys("abcdef", 0)
    writers.write_graph(nodes("abcdef", 0), edges("abcdef", 0), path)
    lost = edges("a", 1).withColumn("b", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        writers.write_graph(nodes("a", 1), lost, path)
    assert seen() == graph(now)
    for k, t in enumerate("abcab", 1):
        writers.write_graph(nodes(t, k), edges(t, k), path)
        now[t] = k
        assert seen() == graph(now)
        assert writers.Versions(spark, path).read("tenants").select("version").distinct().count() <= 4
    writers.write_graph(nodes("f", 9), edges("f", 9).limit(0), path)
    assert not any(a.startswith("f") for a, _ in seen()[1]) and {"f90", "f91"} <= seen()[0]


def test_numbers_within_a_large_tenant(spark):
    draw = random.Random(9)
    rows = [("big", draw.randrange(10**6), draw.randrange(5)) for _ in range(3000)] + [(t, k, 1) for t in ("a", "z", None) for k in range(3)]
    df = spark.createDataFrame(rows, "user_id string, k long, n int")
    for order, sort in (([F.col("k"), F.col("n")], lambda r: (r[1], r[2])), ([F.desc("k"), F.desc("n")], lambda r: (-r[1], -r[2]))):
        got = {(r["user_id"], r["place"]): (r["k"], r["n"], r["before"]) for r in numbered(df, ["user_id"], order, "n", parts=7).collect()}
        want = {}
        for t in {r[0] for r in rows}:
            total = 0
            for place, (_, k, n) in enumerate(sorted((r for r in rows if r[0] == t), key=sort), 1):
                want[t, place] = (k, n, total)
                total += n
        assert got == want
    plan = numbered(df, ["user_id"], [F.col("k")], parts=7)._jdf.queryExecution().optimizedPlan().toString()
    assert "partitionBy" not in plan and not any("Window [row_number" in x and "__part" not in x for x in plan.splitlines())
    assert numbered(df.limit(0), ["user_id"], [F.col("k")]).count() == 0


def test_lines_are_numbered_across_splits(spark, tmp_path):
    lengths = random.Random(2)
    lines = ["" if k % 50 == 0 else f"{k} " + "x" * lengths.randrange(200) + ("\r" if k % 7 == 0 else "") for k in range(1, 5001)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n", newline="")
    (tmp_path / "b.txt").write_text("only\nsecond", newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        got = readers.read_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        rows = {(r["file"][-5:], r["line_no"]): r["value"] for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == {("a.txt", k): v.removesuffix("\r") for k, v in enumerate(lines, 1)} | {("b.txt", 1): "only", ("b.txt", 2): "second"}


def test_prefixes(spark, tmp_path):
    draw = random.Random(12)
    people = [(f"t{draw.randrange(3)}", f"p{k}", " ".join("".join(draw.choice("abc") for _ in range(draw.randrange(1, 6))).title() for _ in range(2))) for k in range(300)] + [("t0", "q", "Straße Ähre"), ("t0", "n", None)]
    df = spark.createDataFrame(people, "user_id string, person_id string, name string")
    asked = [(t, q) for t in ("t0", "t1", "none") for q in ("a", "ab", " ABC", "bca", "c a", "zz", "", "äh", "straß")]
    got = {}
    for r in cards.match_by_prefix(df, spark.createDataFrame(asked, "user_id string, query string")).collect():
        got.setdefault((r["user_id"], r["query"]), []).append((r["rank"], r["name"], r["person_id"]))
    cards.write_name_index(df, str(tmp_path / "index"), files=6)
    for t, q in asked:
        low = q.strip().lower()
        hits = sorted((n, p) for u, p, n in people if low and n and u == t and any(x.startswith(low) for x in [n.lower(), *n.lower().split()]))[:8]
        assert [x[1:] for x in sorted(got.get((t, low), []))] == hits
        if low:
            assert [(r["name"], r["person_id"]) for r in cards.indexed_prefix(spark, str(tmp_path / "index"), t, q).collect()] == hits
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")  # else the plan is shown cut
    plan = cards.indexed_prefix(spark, str(tmp_path / "index"), "t0", "ab")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(token,ab)" in plan and "LessThan(token,ac)" in plan and "EqualTo(user_id,t0)" in plan


def test_paths_from_both_ends(spark, monkeypatch):
    """Against all shortest paths, with hubs dealt into parts."""
    monkeypatch.setattr(graph, "NEIGHBORS", 3)
    draw = random.Random(7)
    edges = sorted({(f"n{draw.randrange(40):02d}", f"n{draw.randrange(40):02d}", draw.choice(["DM", "EMAILED"])) for _ in range(60)} | {("hub", f"n{k:02d}", "DM") for k in range(0, 40, 4)})
    edges = [("t", a, b, kind, float(draw.randrange(1, 5))) for a, b, kind in edges if a != b]
    best = {}
    for _, a, b, kind, w in edges:
        for x, y in ((a, b), (b, a)):
            best[x, y] = max(best.get((x, y), (0.0, "")), (w, kind))
    nodes = sorted({x for x, _ in best} | {"alone"})
    pairs = [(draw.choice(nodes), draw.choice(nodes)) for _ in range(150)] + [("alone", "hub"), ("hub", "hub")]
    want = {}
    for s, t in pairs:
        level = {s: (s,)}
        seen = {s}
        for _ in range(5):
            if t in level:
                break
            onward = {}
            for path in level.values():
                for (x, y) in best:
                    if x == path[-1] and y not in seen:
                        onward[y] = min(onward.get(y, path + (y,)), path + (y,))
            level, seen = onward, seen | set(onward)
        path = level.get(t)
        if path and len(path) <= 5:
            steps = [best[e] for e in zip(path, path[1:])]
            want[s, t] = (list(path), [k for _, k in steps], sum(w for w, _ in steps))
        else:
            want[s, t] = (None, None, None)
    made = spark.createDataFrame(edges, "user_id string, a string, b string, type string, weight double")
    asked = spark.createDataFrame([("t", *p) for p in pairs], "user_id string, source string, target string")
    got = {(r["source"], r["target"]): (r["path"], r["types"], r["weight"]) for r in graph.intro_paths(made, asked).collect()}
    assert got == want and {len(p[0]) for p in want.values() if p[0]} >= {1, 2, 3, 4, 5}
