"""Blocks of names against blocks: the plain rule's scores, and persons paired without a join of pairs."""

import itertools
import random

import numpy as np
import pytest

from tieledger.functions import names as plain
from tieledger.operators import identity, similarity


def invented(draw):
    words = ["".join(draw.choice("aabcdeerst") for _ in range(draw.randrange(1, 7))) for _ in range(draw.randrange(1, 4))]
    return " ".join(words + draw.sample(words, draw.randrange(2)))


@pytest.mark.parametrize("least", [0.6, 0.8, 0.9])
def test_scores_of_blocks_are_the_plain_ones(least):
    from tieledger.functions.likeness import scores_of_blocks

    draw = random.Random(3)
    a = [invented(draw) for _ in range(300)] + ["x " * 40 + "q", "katherine poe", "a" * 70, "one two three"]
    b = [invented(draw) for _ in range(150)] + ["x " * 41 + "r", "catherine poe", "a" * 66 + "b", "three two one ten"]
    names = [[draw.choice("AB") + x for x in own] for own in (a, b)]  # whose order is not that of the plain ones
    also = sorted({(draw.randrange(len(a)), draw.randrange(len(b))) for _ in range(900)})
    for given in (None, names):
        want = {}
        for (i, x), (j, y) in itertools.product(enumerate(a), enumerate(b)):
            score = plain.fuzzy(y, x) if given and names[0][i] > names[1][j] else plain.fuzzy(x, y)
            if score >= least:
                want[i, j] = score
        got = {(i, j): s for part in scores_of_blocks(a, b, least, given) for i, j, s in zip(*map(np.ndarray.tolist, part), strict=True)}
        assert got == want
        asked = {(i, j): s for i, j in also if (s := plain.fuzzy(b[j], a[i]) if given and names[0][i] > names[1][j] else plain.fuzzy(a[i], b[j])) >= 0.5}
        with_asked = {(i, j): s for part in scores_of_blocks(a, b, least, given, also=(*map(np.array, zip(*also, strict=True)), 0.5)) for i, j, s in zip(*map(np.ndarray.tolist, part), strict=True)}
        assert with_asked == want | asked


@pytest.mark.parametrize("review", [0.6, 0.9])
def test_persons_of_blocks(spark, monkeypatch, review):
    """Every pair of persons once, a common name dealt into blocks; nothing meets by thread or by id."""
    def dies(*_):
        raise AssertionError("joined")

    monkeypatch.setattr(identity, "met", dies)
    for name, value in (("NAMES", 12), ("PERSONS", 3)):
        monkeypatch.setattr(similarity, name, value, raising=False)
    draw = random.Random(7)
    base = [invented(draw) for _ in range(25)]
    people = [(str(i), draw.choice([*base, "Jo Poe", "Jo Poe", "jo poé", "!", None])) for i in range(90)]
    threads = [(str(draw.randrange(95)), draw.choice("stuv")) for _ in range(160)] + [("1", None), ("2", None)]
    of = {i: {t for j, t in threads if i == j and t} for i, _ in people}
    want = set()
    for (i, x), (j, y) in itertools.combinations(sorted(people), 2):
        score = plain.fuzzy(min(x, y), max(x, y)) if x and y else 0
        auto = score >= 0.9 or (score >= 0.7 and bool(of[i] & of[j]))
        if auto or score >= review:
            want.add((i, j, x, y, score, auto))
    auto, rest = identity.name_candidates(spark.createDataFrame(people, "id string, name string"), spark.createDataFrame(threads, "id string, thread_id string"), review)
    got = [(*r, True) for r in auto.collect()] + [(*r, False) for r in rest.collect()]
    assert len(got) == len(want) and set(got) == want


def test_best_of_all_persons(spark, monkeypatch):
    """One row for each name and block leaves the blocks, though many persons bear like names; of equal scores the greatest id counts."""
    monkeypatch.setattr(similarity, "NAMES", 8)
    draw = random.Random(9)
    base = [invented(draw) for _ in range(20)] + ["katherine"]
    persons = [(f"P{i}", draw.choice([*base, "Catherine", "catherine", None, "!"])) for i in range(80)]
    names = [*base, "Katherine", None, ""]
    made, paired = [], similarity._block_pairs
    monkeypatch.setattr(similarity, "_block_pairs", lambda a, b: made.append(paired(a, b).cache()) or made[-1])
    rows = spark.createDataFrame([(str(k), [n]) for k, n in enumerate(names)], "id string, participants array<string>")
    got = {(r["interaction_id"], r["name"], r["person_id"], r["score"]) for r in identity.link_participants(rows, spark.createDataFrame(persons, "id string, name string"), 0.85).collect()}
    want = set()
    for k, n in enumerate(names):
        score, best = max(((plain.fuzzy(n, p), i) for i, p in persons if n and p), default=(0, ""))
        if score >= 0.85:
            want.add((str(k), n, best, score))
    assert got == want
    assert made[0].count() > 2 and made[0].mapInArrow(similarity._best_of_blocks(0.85), "name string, score double, id string").groupBy("name").count().agg({"count": "max"}).first()[0] <= made[0].select("kb").distinct().count()


def test_lengths_rule_out_what_bands_do_not(spark):
    """Names of 13 and of 15 letters are of one band; ten letters are enough for the first, never for the second."""
    short = [f"last{a}{b}{c}{d}{e}{f}" for a, b, c, d, e, f in itertools.islice(itertools.permutations("102389"), 200)]
    long = [f"first{a} last{b}{c}{d}{e}" for a, b, c, d, e in itertools.islice(itertools.permutations("02398"), 100)] + [f"first{k} last{n}" for k in range(10) for n in range(10, 15)]
    a, b = (spark.createDataFrame([(n,) for n in own], "name string") for own in (long, short))
    found = similarity.similar_pairs(a, b, 0.92).collect()
    assert not [r for r in found if len(r["na"]) == 15]
    near = ["first1 last10", "flast102389xx", "last102389"]
    got = similarity.similar_names(spark.createDataFrame([(n,) for n in [*long, *near]], "name string"), b, 0.92).collect()
    assert {tuple(r) for r in got} == {(x, y, s) for x in [*long, *near] for y in short if (s := plain.fuzzy(x, y)) >= 0.92}


def test_tokens_are_taken_from_names_not_from_pairs(spark, monkeypatch):
    taken, real = [], identity.N.name_tokens
    monkeypatch.setattr(identity.N, "name_tokens", lambda c: taken.append(c) or real(c))
    rows = [("phone:1", "Ann Stone", True, False), ("phone:2", "Bert", True, False), ("email:1", "Stone Ann", False, True), ("email:2", "bert", False, True), ("email:3", "Ann Rivers", False, True)]
    df = spark.createDataFrame(rows, "min_node string, name string, wa_dm boolean, gmail_from boolean").selectExpr("*", *[f"false AS {c}" for c in ("wa_contact", "wa_group", "google_contact", "gmail_to_cc")])
    got = {(r["chat_node"], r["mail_node"], r["score"]) for r in identity.cross_channel_candidates(df).collect()}
    assert got == {("phone:1", "email:1", 1.0), ("phone:2", "email:2", 1.0)}
    assert {str(c) for c in taken} == {"Column<'name'>"}  # not na, nb
