"""Joins by likeness against all pairs, and the contest for mail buckets against the plain rule."""

import itertools
import random

import pytest

from tieledger.functions import names as plain
from tieledger.operators import identity, similarity

LETTERS = "abcdeéorst"


def invented(draw, words=3):
    return " ".join("".join(draw.choice(LETTERS) for _ in range(draw.randrange(1, 10))) for _ in range(draw.randrange(1, words + 1)))


def slipped(draw, name):
    k = draw.randrange(len(name))
    return draw.choice([name[:k] + name[k + 1 :], name[:k] + draw.choice(LETTERS) + name[k:], name.title(), name[:k] + name[k : k + 2][::-1] + name[k + 2 :], " ".join(reversed(name.split())), name + " jr"])


def named(spark, names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def test_scores_of_many_are_the_plain_ones():
    draw = random.Random(2)
    a = [invented(draw) for _ in range(1500)] + [None, "", "!!", "same", "ß æ ﬁ"]
    b = [slipped(draw, n) if draw.random() < 0.5 else invented(draw) for n in a[:1500]] + ["x", "x", "x", "Same ", "s fi"]
    assert plain.fuzzy_many(a, b).tolist() == pytest.approx([plain.fuzzy(x, y) for x, y in zip(a, b, strict=True)])


def all_pairs(names, others, least):
    return sorted((x, y, s) for x, y in itertools.product({n for n in names if n}, {n for n in others if n}) if (s := plain.fuzzy(x, y)) >= least and s > 0)


@pytest.mark.parametrize("least", [0.6, 0.76, 0.85, 0.92])
def test_no_pair_is_missed(spark, monkeypatch, least):
    monkeypatch.setattr(similarity, "BLOCK", 20)  # common tokens and keys are dealt into blocks
    draw = random.Random(int(least * 100))
    base = ["Katherine", "Mohammed", "Jo", "x", "Anna Maria Kumar"] + [invented(draw) for _ in range(60)] + [f"{invented(draw, 1)} kumar" for _ in range(30)]
    others = ["Catherine", "Muhammed", "jo ", "", None, "１２ ﬁne", "12 fine"] + [slipped(draw, n) for n in base]
    got = sorted(tuple(r) for r in similarity.similar_names(named(spark, base + base[:5]), named(spark, others), least).collect())
    assert got == all_pairs(base, others, least)
    own = named(spark, others)
    within = sorted(tuple(r) for r in similarity.similar_names(own, own, least).collect())
    assert within == [p for p in all_pairs(others, others, least) if p[0] <= p[1]]


def test_few_others_are_looked_at(spark):
    """Of 8000 names of one word, under one in a hundred pairs; the variants are found."""
    draw = random.Random(1)
    common = "etaoinshrdlucmfwypvbgkjqxz"
    names = {"".join(draw.choices(common, range(27, 1, -1), k=draw.randrange(4, 11))) for _ in range(8000)} | {"katherine", "catherine", "mohammed", "muhammed"}
    rows = named(spark, sorted(names)).repartition(8)
    pairs = similarity.similar_pairs(rows, rows, 0.9).where("na < nb").cache()
    assert pairs.count() < 0.01 * len(names) * (len(names) - 1) / 2
    assert {("catherine", "katherine"), ("mohammed", "muhammed")} <= {tuple(r) for r in pairs.where("na LIKE 'cath%' OR na LIKE 'moh%'").collect()}


def test_texts_by_ratio(spark):
    draw = random.Random(5)
    names = [invented(draw, 2) for _ in range(60)]
    names += [slipped(draw, n) for n in names]
    rows = spark.createDataFrame([(n, n[:1]) for n in names], "name string, first string")
    got = {tuple(r) for r in similarity.like_texts(rows, rows, 0.8, ["first"]).collect()}
    assert got == {(x, y) for x in names for y in names if x < y and x[:1] == y[:1] and plain.ratio(x, y) > 0.8}


def test_name_candidates_find_variants(spark):
    people = spark.createDataFrame([("1", "Katherine"), ("2", "Catherine"), ("3", "Mohammed"), ("4", "Muhammed"), ("5", "Catherine"), ("6", None), ("7", "Kate"), ("8", "Bo Stone"), ("9", "Bo Rivers")], "id string, name string")
    threads = spark.createDataFrame([("8", "t"), ("9", "t"), ("9", "t"), ("6", "t")], "id string, thread_id string")
    want = {("1", "2"), ("1", "5"), ("2", "5"), ("3", "4"), ("8", "9")}
    for review in (0.6, 0.8, 0.9):
        auto, rest = identity.name_candidates(people, threads, review)
        assert {(r["id_a"], r["id_b"]) for r in auto.collect()} == want
        assert all(review <= r["score"] < 0.9 for r in rest.collect())
    first = {(r["id_a"], r["id_b"]): (r["name_a"], r["score"]) for r in auto.collect()}
    assert first["1", "2"] == ("Katherine", 0.926) and first["2", "5"][1] == 1.0


def plain_bridge(rows):
    used, out = set(), set()
    for chat in sorted({r[0] for r in rows}):
        free = [r for r in rows if r[0] == chat and r[1] not in used]
        if free:
            best = min(free, key=lambda r: (-r[2], r[1]))
            used.add(best[1])
            out.add(best)
    return out


@pytest.mark.parametrize("at_once", [3, 40, 100_000])
def test_contest_for_mail_buckets(spark, at_once):
    draw = random.Random(at_once)
    rows = sorted({(f"c{draw.randrange(50):02d}", f"m{draw.randrange(50):02d}"): draw.randrange(85, 100) / 100 for _ in range(160)}.items())
    rows = [(c, m, s) for (c, m), s in rows]
    df = spark.createDataFrame(rows, "chat_node string, mail_node string, score double")
    assert {tuple(r) for r in identity.cross_channel_bridge(df, at_once).collect()} == plain_bridge(rows)
    assert identity.cross_channel_bridge(df.limit(0)).count() == 0


def test_a_long_chain_of_buckets(spark):
    """Each wants its neighbour's mail bucket first: a component of 100 000 pairs in which every choice hangs on the one before."""
    n = 50_000
    rows = spark.range(n).selectExpr("concat('c', lpad(id, 6, '0')) c", "id")
    edges = rows.selectExpr("c AS chat_node", "concat('m', lpad(greatest(id - 1, 0), 6, '0')) AS mail_node", "0.99D AS score").union(rows.selectExpr("c", "concat('m', lpad(id, 6, '0'))", "0.9D"))
    got = identity.cross_channel_bridge(edges, at_once=60_000)
    assert got.where("substr(chat_node, 2) = substr(mail_node, 2)").count() == n == got.count()


def test_no_keys_for_what_the_other_side_lacks(spark, monkeypatch):
    """Names whose lengths and first letters cannot meet have no keys, and a side without names gives the other none."""
    made, written = [], similarity.cut

    def counted(df):
        out = written(df)
        if "k" in out.columns:
            made.append(out.count())
        return out

    monkeypatch.setattr(similarity, "cut", counted)
    short, long = named(spark, [f"last{k}" for k in range(100, 180)]), named(spark, [f"first{k % 97} last{k}" for k in range(1000, 1080)])
    assert similarity.similar_names(short, long, 0.92).count() == 0
    assert similarity.similar_names(short.limit(0), long, 0.92).count() == 0
    assert made == [0, 0, 0, 0]
