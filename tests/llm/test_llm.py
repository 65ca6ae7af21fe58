"""The ten operators on small tables: edge cases, and brute force where SQL cannot say it."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tieledger.llm import annsearch, hashing, langid, licences, minhash, mixing, packing, pii, queries, tokencount, toxicity, vecdedup
from tieledger.llm.tokens import TokenIds

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, lang string, lang_pred string, score string"


def docs_of(spark, rows):
    """(doc_id, text[, source[, lang]]) rows, with two extra columns that clash with what operators add."""
    full = [(*r, *[None] * (4 - len(r)), "old", "old") for r in rows]
    return spark.createDataFrame(full, DOCS)


EDGE = [(1, None), (2, ""), (3, "   \n\t "), (4, "x" * 200_000), (5, "same text of five words here"), (5, "same text of five words here"), (None, "no id but some text of words"), (6, "the end " * 20_000)]


@pytest.fixture(scope="module")
def edge(spark):
    return docs_of(spark, EDGE)


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


def words(n, seed, vocabulary=400):
    draw = random.Random(seed)
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


# language


def test_language(spark, edge, empty):
    train = [(i, t, "s", lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 30)]
    model = langid.fit(docs_of(spark, train))
    out = {r["doc_id"]: r for r in langid.identify(docs_of(spark, [(1, "The dog"), (2, "die Katzen"), (3, "12 !?"), (4, None), (5, "中文")]), model).collect()}
    assert (out[1]["lang_pred"], out[2]["lang_pred"], out[3]["lang_pred"], out[4]["lang_pred"]) == ("en", "de", "und", "und")
    assert out[5]["lang_pred"] in ("de", "en") and out[3]["score"] == 0.0 and 0 <= out[1]["score"] <= 1
    assert langid.identify(edge, model).count() == len(EDGE) and langid.identify(empty, model).count() == 0
    none = langid.fit(empty)
    assert {r["lang_pred"] for r in langid.identify(edge, none).collect()} == {"und"}


def test_language_scores_are_the_plain_sums(spark, monkeypatch):
    alpha = lambda n, seed: [w.translate(str.maketrans("0123456789", "abcdefghij")) for w in words(n, seed, 60)]
    train = [(i, " ".join(alpha(30, i)), "s", "abc"[i % 3]) for i in range(60)]
    model = langid.fit(docs_of(spark, train))
    scorer = langid.Scorer(model)
    monkeypatch.setattr(langid, "PART", 50)  # many parts
    texts = [" ".join(alpha(40, 100 + i)) + " wfx, wfxyz" for i in range(5)] + [None, "", "!!", "wab" * 70 + " wab", "x" * 130]
    sums, _ = scorer.votes(texts)
    for text, got in zip(texts, sums, strict=True):
        want = np.zeros(3)
        for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
            if w in model.words:
                want += model.votes(model.words[w], 0)
                continue
            padded = f" {w} "
            for n in langid.ORDERS:
                if own := [model.votes(model.grams[g], n) for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) in model.grams]:
                    want += np.mean(own, axis=0)
                    break
        assert got == pytest.approx(want, abs=1e-4)


def test_language_letters(spark):
    model = langid.fit(docs_of(spark, [(1, "the cat", "s", "en"), (2, "der hund", "s", "de")]))
    texts = ["½ ² Ⅷ ①", "12 _ !", "\U00030000", "ª", "é", "\u0301"]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs_of(spark, list(enumerate(texts))), model).collect()}
    assert [got[i] == "und" for i in range(6)] == [True, True, False, False, False, True]


def test_every_language_is_learnt(spark):
    """Of 230 languages, beyond any former bound, the rarest is found as well."""
    name = lambda i: "".join(chr(97 + d) for d in divmod(i, 16))
    train = [(i, f"{name(i)}ki {name(i)}tu {name(i)}mo", "s", f"l{i:03d}") for i in range(230)] + [(1000 + i, "ppki pptu", "s", "l000") for i in range(20)]
    model = langid.fit(docs_of(spark, train))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs_of(spark, [(i, f"{name(i)}tu {name(i)}mo", "s") for i in (1, 117, 229)]), model).collect()}
    assert len(model.langs) == 230 and got == {1: "l001", 117: "l117", 229: "l229"}


def test_language_held_out(spark):
    got = queries.op1_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


# packing


def test_packing_round_trip(spark, edge, empty):
    rows = EDGE + [(100 + i, " ".join(words(random.Random(i).randrange(1, 900), i))) for i in range(150)]
    rows += [(300, "a <|endoftext|> b"), (301, "<|endoftext|><|endoftext|>"), (302, "x  <|endoftext|>  <|endoftext|"), (303, "<|endoftext|> end " * 900)]
    got = packing.pack(docs_of(spark, rows)).collect()
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for doc, text, *_ in rows:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        first = len(ids) % 2048 or 2048
        at = [0, *range(first, len(ids), 2048)] if len(ids) > 2048 else [0]
        want.update((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(at, [*at[1:], len(ids)], strict=True)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 2048
    assert len(by) <= 1.02 * sum(r["length"] for r in got) / 2048 + 1
    assert packing.pack(empty).count() == 0


def test_crossover_keeps_all():
    draw = np.random.default_rng(1)
    lengths = draw.integers(1, 2048, 300)
    a, b = packing._first(lengths, 2048, draw, True), packing._first(lengths, 2048, draw, False)
    child = packing.crossover(lengths, 2048, a, b, draw)
    assert len(child) == 300 and np.bincount(child, lengths).max() <= 2048 and set(child) == set(range(child.max() + 1))


def test_leftovers_are_joined(spark, monkeypatch):
    monkeypatch.setattr(packing, "POOL", 40)
    draw = np.random.default_rng(2)
    items = spark.createDataFrame([(i, int(n)) for i, n in enumerate(draw.integers(200, 1500, 700))], "item long, length long")
    got = packing.assign(items).toPandas()
    assert sorted(got["item"]) == list(range(700))
    joined = got.merge(items.toPandas(), on="item").groupby(["round", "pool", "bin"])["length"].sum()
    assert joined.max() <= 2048


# mixing


def test_pivot_keeps_words_and_expectation():
    totals = []
    for seed in range(300):
        p, w = np.full(25, 0.3), np.arange(1.0, 26.0)
        left = mixing.pivot(p, w, np.random.default_rng(seed))
        assert p @ w == pytest.approx(0.3 * w.sum()) and all(i == left or x in (0, 1) for i, x in enumerate(p))
        totals.append(p)
    assert np.abs(np.mean(totals, axis=0) - 0.3).max() < 0.1


def test_mix(spark, edge, empty):
    rows = [(i, " ".join(words(random.Random(i).randrange(1, 60), i)), ["a", "b", "c", "d", None][min(4, int(random.Random(-i).expovariate(0.7)))]) for i in range(3000)]
    one, two = (sorted(tuple(r) for r in mixing.mixed_report(docs_of(spark, rows).repartition(k)).collect()) for k in (1, 7))
    assert one == two and len(one) == 3000
    source = {i: s for i, _, s in rows}
    size, taken, target = Counter(), Counter(), {}
    for doc, n, _, t, k, copies in one:
        size[source[doc]] += n
        taken[source[doc]] += k
        target[source[doc]] = t
        assert k in (0, n, 2 * n) and k == n * copies
    weights = dict(zip(sorted(size, key=lambda s: (s is None, s)), itertools.cycle((5, 2, 1))))
    left, want = dict(weights), {}
    budget = 1.5 * sum(size.values())
    while True:  # deal by weight, cap, deal the rest again
        share = budget / sum(left.values())
        over = [s for s in left if share * left[s] > 2 * size[s]]
        if not over:
            want |= {s: share * w for s, w in left.items()}
            break
        for s in over:
            want[s] = 2.0 * size[s]
            budget -= want[s]
            del left[s]
    for s in size:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) < 60
    mixed = mixing.mix(docs_of(spark, rows))
    assert mixed.columns == docs_of(spark, []).columns and mixed.count() == sum(r[5] for r in one)
    clashing = docs_of(spark, rows).withColumn("_", F.lit(1)).withColumn("_d", F.lit(2)).withColumn("_s", F.lit(3)).withColumn("_n", F.lit(4)).withColumn("_copies", F.lit(5)).withColumn("size", F.lit(6))
    again = mixing.mix(clashing)
    assert again.columns == clashing.columns and again.count() == mixed.count() and again.select("size").distinct().count() == 1
    assert mixing.mixed_report(edge).count() == len(EDGE) and mixing.mixed_report(empty).count() == 0 and mixing.mix(empty).count() == 0


# vectors


def vectors(spark, arrays, labels=None, ids=None):
    rows = [(i if ids is None else ids[i], None if a is None else [None if x is None else float(x) for x in a], None if labels is None else labels[i], "old") for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, component_id string")


ODD = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [1.0] * 5]


def test_search_recall(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(1500, 24)).astype(np.float32)
    x[1000:1010] = x[0]  # equal ones, to the smaller id
    got = annsearch.nearest(vectors(spark, [*x, *ODD]), F.col("vec_id") % 50 == 0).toPandas()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1500, 50):
        s = u @ u[q]
        s[q] = -9
        best = np.lexsort((np.arange(1500), -np.round(s, 12)))[:5]
        own = got[got["query_id"] == q].sort_values("rank")
        hits += len(set(best) & set(own["vec_id"]))
        assert list(own["rank"]) == [1, 2, 3, 4, 5] and np.allclose(own["score"], s[own["vec_id"]])
    assert hits >= 0.9 * 150
    assert list(got[got["query_id"] == 0].sort_values("rank")["vec_id"]) == [1000, 1001, 1002, 1003, 1004]


def test_search_small_tables(spark):
    assert annsearch.nearest(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    got = annsearch.nearest(vectors(spark, [[1, 0], [1, 1], None, [0, 1]], ids=[0, 7, 8, None]), F.col("vec_id") % 50 == 0).collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 7)]


def brute_vectors(arrays, labels, ids, threshold=0.93):
    ok = [i for i, a in enumerate(arrays) if a is not None and len(a) and labels[i] is not None and ids[i] is not None and all(x is not None and np.isfinite(x) for x in a) and any(a)]
    links, parent = Counter(), {i: i for i in ids}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, j in itertools.combinations(ok, 2):
        if labels[i] != labels[j] or len(arrays[i]) != len(arrays[j]):
            continue
        a, b = np.asarray(np.float32(arrays[i]), float), np.asarray(np.float32(arrays[j]), float)
        if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= threshold:
            links[i] += 1
            links[j] += 1
            x, y = find(ids[i]), find(ids[j])
            parent[max(x, y)] = min(x, y)
    return {ids[i]: (links[i], find(ids[i])) for i in range(len(arrays))}


@pytest.mark.parametrize("tiles", [256, 3])
def test_near_vectors(spark, monkeypatch, tiles):
    monkeypatch.setattr(vecdedup, "TILE", 16)
    monkeypatch.setattr(vecdedup, "TILES", tiles)  # few tiles along one axis: those too full are parted along the next
    draw = np.random.default_rng(5)
    base = draw.normal(size=(12, 20))
    arrays = [list((base[i % 12] + draw.normal(size=20) * 0.25).astype(np.float32)) for i in range(150)]
    arrays += [arrays[0]] * 30 + [list(2 * np.float32(arrays[1]))] + ODD
    labels = [int(i % 3 == 0) for i in range(len(arrays))]
    labels[4] = None
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vecdedup.near_vectors(vectors(spark, arrays, labels)).collect()}
    want = brute_vectors(arrays, labels, list(range(len(arrays))))
    assert {k: v[:2] for k, v in got.items()} == want and all(kept == (c == k) for k, (_, c, kept) in got.items())
    assert any(n > 0 for n, _ in want.values())
    assert vecdedup.near_vectors(vectors(spark, [])).count() == 0


# near documents


def brute_documents(rows, percent=75):
    sets = {}
    for doc, text, *_ in rows:
        w = (text or "").encode().lower().split()
        k = min(5, len(w))
        sets[doc] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_near_documents(spark, edge, empty):
    rows, base = [], words(120, 0, 5000)
    for i in range(160):
        own, draw = list(base), random.Random(i)
        for _ in range(draw.randrange(9)):
            own[draw.randrange(120)] = f"edit{draw.randrange(10**6)}"
        rows.append((i, " ".join(own).upper() if i % 7 == 0 else " ".join(own)))
    rows += [(200 + i, " ".join(words(60, 900 + i, 5000)) + " " + " ".join(base[:20])) for i in range(40)]
    rows += [(300, "a b"), (301, "A  b"), (302, "a b c"), (303, ""), (304, None), (305, "É b"), (306, "é b"), (307, "x" * 100_000)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == brute_documents(rows)
    out = minhash.near_duplicates(edge).collect()
    assert len(out) == len(EDGE) and all(r["kept"] for r in out) and minhash.near_duplicates(empty).count() == 0
    assert {r["doc_id"] for r in minhash.deduplicated(docs_of(spark, rows)).collect()} == {d for d, (_, c) in brute_documents(rows).items() if d == c}


def test_a_large_group_and_a_very_long_text(spark, monkeypatch):
    """Groups beyond what is compared with one copy of a centre, many blocks, and a text of 20 MB."""
    monkeypatch.setattr(minhash, "GROUP", 16)
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 16)
    base = words(150, 1, 10**6)
    rows = [(i, " ".join([*base[:140], *words(3, i, 10**6), *base[140:]])) for i in range(300)]
    rows += [(1000 + i, " ".join([*words(100, 5000 + i // 3, 10**6), str(i)])) for i in range(60)]
    long = " ".join(words(200, 3, 10**6)) * 15_000
    rows += [(5000, long), (5001, long + " one more"), (5002, "y" * 20_000_000)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs_of(spark, rows)).collect()}
    assert {got[i] for i in range(300)} == {0} and all(got[1000 + i] == 1000 + i // 3 * 3 for i in range(60))
    assert (got[5000], got[5001], got[5002]) == (5000, 5000, 5002)


def test_similarity_estimate():
    draw = np.random.default_rng(7)
    for share in (0.5, 0.75, 0.9):
        n = 4000
        common = draw.integers(0, 2**63, int(n * share), dtype=np.uint64)
        sets = [np.unique(np.concatenate([common, draw.integers(0, 2**63, (n - len(common)) // 2, dtype=np.uint64)])) for _ in range(2)]
        a, b = (minhash.packed(minhash.minima(s)).view(np.uint64) for s in sets)
        x = a ^ b
        differ = int(np.bitwise_count((x | x >> np.uint64(1) | x >> np.uint64(2) | x >> np.uint64(3)) & np.uint64(0x1111111111111111)).sum())
        agree = 1 - differ / minhash.HASHES
        assert (agree - 1 / 16) / (1 - 1 / 16) == pytest.approx(share, abs=0.15)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_all_pairs_in_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.astype(object).to_numpy().tolist())) == sorted(map(tuple, want.astype(object).to_numpy().tolist()))


# toxicity


def test_toxicity(spark, edge, empty):
    rows = [(i, " ".join(words(40, i)) + (" vile wretch" if i % 5 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)] + [(None, 1), (1, None), (7, 9)], "doc_id long, y int")
    model = toxicity.fit(docs_of(spark, rows), labels, l1=2.0)
    out = {r["doc_id"]: r["score"] for r in toxicity.score(docs_of(spark, [(1, " ".join(words(40, 999)) + " vile wretch"), (2, " ".join(words(40, 998))), (3, None)]), model).collect()}
    assert out[1] > 0.5 > out[2] and 0 <= out[3] < 0.5
    assert toxicity.score(edge, model).count() == len(EDGE)
    # plain FTRL-proximal over the same shard, coordinate by coordinate
    z, n, bias = defaultdict(float), defaultdict(float), -1

    def weight(i):
        if i != bias and abs(z[i]) <= 2.0:
            return 0.0
        return -(z[i] - (0 if i == bias else np.sign(z[i]) * 2.0)) / ((1.0 + np.sqrt(n[i])) / 2.0)

    plain = docs_of(spark, rows).join(labels.where("y IN (0, 1) AND doc_id IS NOT NULL"), "doc_id").select("text", "y", F.xxhash64("text", "y").alias("order")).orderBy("order", "text").collect()
    for turn in range(2):
        if turn:  # a new round starts from weights and sums of squares of what is not zero
            kept = {i: (weight(i), n[i]) for i in list(z) if weight(i) or i == bias}
            z, n = defaultdict(float), defaultdict(float)
            for i, (w, m) in kept.items():
                n[i], z[i] = m, -(w * (1.0 + np.sqrt(m)) / 2.0 + (0 if i == bias else np.sign(w) * 2.0))
        for r in plain * 4:
            at = [*np.unique(toxicity.features(r["text"])).tolist(), bias]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - r["y"]
            for i in at:
                z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / 2.0 * w[i]
                n[i] += g * g
    assert model.bias == pytest.approx(weight(bias), abs=1e-6)
    assert dict(zip(model.ids.tolist(), model.weights.tolist())) == pytest.approx({i: weight(i) for i in list(z) if i != bias and weight(i)}, abs=1e-6)
    none = toxicity.fit(empty, labels.limit(0))
    assert all(r["score"] < 0.01 for r in toxicity.score(edge, none).collect())


# personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, digits[::-1]))) % 10 == 0 if digits else False
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 12 <= len(digits) <= 19 and luhn or kind == "phone" and 9 <= len(digits) <= 15:
                out.append((m.start(), list(BASE).index(kind), m.end(), kind))
    return sorted(out)


def test_base_spans(spark, edge, empty):
    draw = random.Random(8)
    bits = ["a@b.c", "_d@e.fg", "@", "x@y", "1.2.3.4", ".5", "300.1.1.1", "0001.002.3.4", "+1 (555) 010-2030", "+49", " ", "-", "4111 1111 1111 1111", "4111-1111-1111-1112", "7", "é", "(", ")", ".", "\n", "word ", "5500005555555559", "+", "00"]
    rows = [(i, "".join(draw.choice(bits) for _ in range(draw.randrange(14)))) for i in range(400)] + [(900, "1 " * 4000), (901, None), (902, "é" * 5 + " a@b.cd")]
    out = pii.report(docs_of(spark, rows), pii.Boosted()).collect()
    for r, text in ((r, dict(rows)[r["doc_id"]]) for r in out):
        want = brute_spans(text)
        listed = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), text
        assert r["spans"] == listed and r["n_card"] == sum(x[3] == "card" for x in want)
    assert pii.report(edge, pii.fit(edge)).count() == len(EDGE) and pii.report(empty, pii.fit(empty)).count() == 0


def obfuscated(draw, n):
    """Texts with one value that no base rule sees, or with none but numbers that are something else; and the span meant."""
    out = []
    for i in range(n):
        plain = words(draw.randrange(5, 30), i)
        local, host = draw.choice(["jo.doe", "anna", "info_7", "k.lee"]), draw.choice(["acme", "mail-4", "uni"])
        digits = "".join(str(draw.randrange(10)) for _ in range(15))
        check = next(c for c in "0123456789" if sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, (digits + c)[::-1]))) % 10 == 0)
        card = digits + check
        groups = [card[k : k + 4] for k in range(0, 16, 4)]
        ip = [str(draw.randrange(1, 255)) for _ in range(4)]
        value, kind = draw.choice([(f"{local} (at) {host} (dot) com", "email"), (f"{local}[at]{host}.org", "email"), (f"{local} at {host} dot net", "email"), (f"{local} @ {host}.de", "email"), (" . ".join(ip), "ip"), ("[.]".join(ip), "ip"), (".".join(groups), "card"), ("/".join(groups), "card"), ("(555) 210-2030", "phone"), ("555-310-2030", "phone"), ("0049 551 345 6789", "phone")])
        if i % 2:
            value, kind = draw.choice([("invoice no. 555-310-2030", ""), ("ISBN 555-310-2030", ""), (f"order {'/'.join(groups)}", ""), (".".join([*groups[:3], str((int(groups[3]) + 1) % 10000).zfill(4)]), ""), ("300 . 1 . 2 . 3", ""), ("1. 2. 3. 4", ""), ("we met at noon. Then", ""), ("12.5.2020", ""), (f"{local}@{host}. Then", "")])
        head = " ".join(plain) + " "
        out.append((i, head + value + " " + " ".join(words(9, -i)), (kind, len(head), len(head) + len(value)) if kind else None))
    return out


def test_what_the_base_rules_cannot_see(spark):
    """Precision and recall of added spans on texts that training has not seen, base spans kept."""
    model = pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert set(model.least) == {0, 1, 2, 3} and all(p >= 0.95 and r >= 0.8 for p, r in model.measured.values())
    rows = obfuscated(random.Random(12), 400)
    found = {r["doc_id"]: r["spans"] for r in pii.report(docs_of(spark, [(i, t) for i, t, _ in rows]), model).collect()}
    added = {i: {tuple(x.split(":")) for x in found[i].split(",") if x} for i, _, _ in rows}
    want = {i: {(w[0], str(w[1]), str(w[2]))} if w else set() for i, _, w in rows}
    right = sum(len(added[i] & want[i]) for i in added)
    assert right >= 0.95 * sum(map(len, added.values())) and right >= 0.8 * sum(map(len, want.values()))
    # what the base rules drop since it swallows a neighbour
    got = pii.report(docs_of(spark, [(1, "call +1 (843) 555-7672 170.106.47.218 or 5500005555555559 123")]), model).first()
    assert got["spans"] == "phone:5:22,ip:23:37,card:41:57" and (got["n_phone"], got["n_card"], got["n_ip"]) == (0, 0, 1)


def test_added_spans_and_redaction(spark):
    model = pii.Boosted(prior=5.0, least={3: 0.0})
    rows = [(1, "call (555) 010-2030 or +1 (555) 010-2030, a@b.cd"), (2, None), (3, "plain"), (4, "é" * 3000 + "x@y.zz" + "é" * 3000 + " 1.2.3.4")]
    found = {r["doc_id"]: r["spans"] for r in pii.report(docs_of(spark, rows), model).collect()}
    assert found == {1: "phone:5:19,phone:23:40,email:42:48", 2: "", 3: "", 4: "email:3000:3006,ip:6007:6014"}
    clashing = docs_of(spark, rows).withColumn("base", F.lit("b")).withColumn("spans", F.lit("s")).withColumn("base_email", F.lit("e")).withColumn("__row", F.lit("r"))
    new = pii.redacted(clashing, model)
    assert new.columns == clashing.columns
    got = {r["doc_id"]: r for r in new.collect()}
    assert {i: r["text"] for i, r in got.items()} == {1: "call [PHONE] or [PHONE], [EMAIL]", 2: None, 3: "plain", 4: "é" * 3000 + "[EMAIL]" + "é" * 3000 + " [IP]"}
    assert all((r["base"], r["spans"], r["base_email"], r["__row"]) == ("b", "s", "e", "r") for r in got.values())


def test_overlapping_spans_are_one(spark):
    text = "+1 (555) 010-2030 4111 1111 1111 1111 x a@1.2.3.4 y"
    got = pii.redacted(docs_of(spark, [(1, text), (2, "a@1.2.3.4" * 400)]), pii.Boosted()).orderBy("doc_id").collect()
    out, at = "", 0
    for a, _, b, kind in brute_spans(text):
        if a >= at:
            out += text[at:a] + f"[{kind.upper()}]"
        at = max(at, b)
    assert got[0]["text"] == out + text[at:]


def test_places_of_many_matches(spark):
    """Twice the matches take about twice the time, and places stay right beyond a block of sums."""
    model = pii.Boosted()
    took = []
    for n in (4000, 8000, 16_000):
        docs = docs_of(spark, [(1, "é a@b.cd 1.2.3.4 " * n)])
        pii.report(docs, model).collect()
        begin = time.time()
        got = pii.report(docs, model).first()
        took.append(time.time() - begin)
        assert (got["n_email"], got["n_ip"]) == (n, n) and got["spans"].endswith(f",email:{17 * n - 15}:{17 * n - 9},ip:{17 * n - 8}:{17 * n - 1}")
    assert took[2] < 3 * took[1] + 1


def test_boosting_learns():
    f = lambda d, c: (3, d, 0, 0, c, 0, 0, 0, 0, 0, 0)
    cells = [(f(d, c), 50, 50 if d == 10 and c else 0) for d in range(6, 14) for c in (0, 1)]
    model = pii.boost(cells, cells)
    assert model.margin(f(10, 1)) >= model.least[3] > model.margin(f(9, 1))


def test_trees_in_the_plan_are_the_trees(spark):
    model = pii.Boosted(prior=-1.0, trees=[(1, 9, (4, 0, 0.25, 1.5), -0.5), (7, 0, -2.0, (1, 12, 0.125, (2, 3, 4.0, -4.0))), 0.5])
    rows = [[3, d, m, 0, c, 0, 0, v, 0, 0, 0] for d in (8, 10, 14) for m in (1, 5) for c in (0, 1) for v in (0, 1)]
    got = spark.createDataFrame([(r,) for r in rows], "f array<int>").select("f", model.column(F.col("f")).alias("m")).collect()
    assert all(r["m"] == pytest.approx(model.margin(r["f"])) for r in got)


# licences


def test_licences(spark, edge, empty):
    rows = [(i, " ".join(words(60, i))) for i in range(60)]
    rows += [(100, "intro\nLicensed under the Apache License, Version 2.0.\nrest"), (101, "Released under the MIT License."), (102, "the license office was closed and the copyright clerk left")]
    rows += [(103, "This work is licensed under the GNU General Public License, version 3."), (104, "w1\n\nLicensed under CC BY-NC 4.0.\nAll rights reserved.")]
    model = licences.fit(docs_of(spark, rows))
    got = {r["doc_id"]: (r["families"], r["n_notices"], r["n_candidates"]) for r in licences.report(docs_of(spark, rows), model).collect()}
    assert (got[100], got[101], got[103], got[104]) == (("Apache-2.0", 1, 1), ("MIT", 1, 1), ("GPL", 1, 1), ("CC-BY-NC,Proprietary", 2, 2))
    assert got[102] == ("", 0, 1) and got[5] == ("", 0, 0)
    assert licences.report(edge, model).count() == len(EDGE) and licences.report(empty, licences.fit(empty)).count() == 0


WRAPPED = {
    "GPL": """ * Copyright (C) 2011 J. Doe
 *
 * This program is free software; you can redistribute it and/or modify it
 * under the terms of the GNU General Public License as published by the Free
 * Software Foundation; either version 2 of the License, or (at your option)
 * any later version.
 *
 * This program is distributed in the hope that it will be useful,""",
    "LGPL": """# frobnicate is a library.
#
# This library is free software; you can redistribute it and/or
# modify it under the terms of the GNU Lesser General Public
# License as published by the Free Software Foundation; either
# version 2.1 of the License, or (at your option) any later version.
#
# import os""",
    "MPL-2.0": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */""",
    "BSD": """// Redistribution and use in source and binary forms, with or
// without modification, are permitted provided that the
// following conditions are met:
//
// 1. Redistributions of source code must retain the above notice""",
    "MIT": """Permission is hereby granted, free of charge, to any
person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the
Software without restriction, including without limitation the rights""",
}


def test_wrapped_licences(spark):
    plain = [(i, " ".join(words(60, i))) for i in range(60)]
    model = licences.fit(docs_of(spark, plain))
    rows = [(100 + i, mark.join(WRAPPED[f].split("\n"))) for i, (f, mark) in enumerate(itertools.product(sorted(WRAPPED), ["\n", "\r\n"]))]
    rows += [(300 + i, f"import os\n# SPDX-License-Identifier: {x}\nx = 1") for i, x in enumerate(["MIT", "Apache-2.0", "GPL-2.0-only", "MPL-2.0"])]
    rows += [(310, "Distributed under the MIT licence."), (311, "copyright and licence are words of this long line of text about a house by the sea, all rights reserved for the guests of the inn"), (312, " ".join(words(60_000, 5)) + "\n\n" + WRAPPED["MIT"])]
    rows += [(200, "Released under MPL 2.0"), (201, "\n".join(" ".join(words(60, i)) for i in range(40)) + "\n" + WRAPPED["GPL"].replace(" *\n", "") + "\n" + " ".join(words(90, 7)))]
    rows += [(202, "\n".join(" ".join(words(12, i)) + " under the terms of this form or the source of it" for i in range(30)))]
    got = {r["doc_id"]: (r["families"], r["n_notices"]) for r in licences.report(docs_of(spark, rows), model).collect()}
    assert {i: got[100 + i][0] for i in range(10)} == {i: sorted(WRAPPED)[i // 2] for i in range(10)}
    assert [got[300 + i][0] for i in range(4)] == ["MIT", "Apache-2.0", "GPL", "MPL-2.0"] and got[310] == ("MIT", 1) and got[311] == ("", 0) and got[312][0] == "MIT"
    assert got[200] == ("MPL-2.0", 1) and got[201][0] == "GPL" and got[202] == ("", 0)


def test_no_half_of_a_template_is_without_a_gate_word():
    for text in itertools.chain(*licences.TEMPLATES.values()):
        pairs = licences.bigrams_of(text)
        assert sum(not set(g.split()) & set(licences.GATE) for g in pairs) < licences.CONFIRMS * len(pairs)


# token counts


def test_token_counts(spark, edge, monkeypatch):
    count = TokenIds().count
    rows = EDGE + [(10 + i, " ".join(words(200, i)) + "\n\n   end") for i in range(20)]
    df = tokencount.counted(docs_of(spark, rows)).withColumn("edits", tokencount.derived_edits(F.col("doc_id"), F.col("text"), 3))
    for r in tokencount.recounted(df).select("text", "edits", "tree.n_tokens", F.col("tree_after.n_tokens").alias("after"), "chars_encoded").collect():
        text = r["text"] or ""
        assert count(text) == r["n_tokens"]
        for e in r["edits"]:
            text = text[: e["start"]] + e["inserted"] + text[e["start"] + e["removed"] :]
        assert count(text) == r["after"]


@pytest.mark.parametrize("leaf", [4, 8, 40])
def test_edits_at_any_place(monkeypatch, leaf):
    """Any cut, whole and broken added tokens, long runs without a firm cut: the tree's count is that of the whole text."""
    monkeypatch.setattr(tokencount, "LEAF", leaf)
    ids, draw = TokenIds(), random.Random(9)
    count = tokencount.Counter(ids)
    bits = ["a", "b", " ", "  ", "\n", "\n\n", "'s", "'", "é", "1", "22", "!", "...", "\t", "\u3000", "\x1c", "word ", " the", "中文", "的", "e\u0301", "👍", "<|endoftext|>", "<|endof", "text|>", "<", "|", ">", "'ll", "'v", "e"]
    for turn in range(900):
        some = draw.sample(bits, draw.randrange(1, 5)) if turn % 2 else bits
        text = "".join(draw.choice(some) for _ in range(draw.randrange(80)))
        tree = tokencount.Tree.over(text, count)
        assert tree.n_tokens == ids.count(text)
        for _ in range(4):
            text, _n = tree.edit(text, draw.randrange(len(text) + 3), draw.randrange(12), "".join(draw.choice(some) for _ in range(draw.randrange(5))), count)
            tree = tokencount.Tree.of_row(*tree.row())
            assert tree.n_tokens == ids.count(text) and tree.n_chars == len(text)


def test_an_edit_encodes_little():
    """Thousands of characters without white space, and a long text: one edit encodes a few hundred characters."""
    ids, draw = TokenIds(), random.Random(4)
    count = tokencount.Counter(ids)
    texts = ["".join(chr(draw.randrange(0x4E00, 0x9FA5)) for _ in range(5000)), "".join(draw.choice("abcdefgh") for _ in range(8000)), "7" * 6000, "ab1.,;" * 2000, " ".join(words(30_000, 1)), "<|endoftext|>" * 500]
    for text in texts:
        tree = tokencount.Tree.over(text, count)
        assert tree.root.height <= 2 * np.log2(tree.root.leaves + 1) + 1
        for _ in range(20):
            text, n = tree.edit(text, draw.randrange(len(text)), 3, text[:3], count)
            assert n <= 6 * tokencount.LEAF and tree.n_tokens == ids.count(text)
    assert n <= 3 * tokencount.LEAF


def test_vocabularies_agree():
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = TokenIds()
    for text in ["Hello  world\n\n it's", " ".join(words(300, 1)), "é 中文 \t x", ""]:
        assert list(np.frombuffer(ids.of(text), "<u4")) == tok.encode(text, add_special_tokens=False).ids


def test_hashes_of_long_words(monkeypatch):
    monkeypatch.setattr(hashing, "PART", 7)
    inside = np.array([b != 32 for b in range(256)])
    for seed in range(300):
        draw = random.Random(seed)
        symbols = np.frombuffer(bytes(draw.choice(b"ab     " if seed % 3 else b"abab cd") for _ in range(draw.randrange(60))), np.uint8)
        want = hashing.Rolling(symbols).spans(*hashing.runs(inside[symbols]))
        assert hashing.word_hashes(symbols, inside).tolist() == want.tolist()


def test_rolling_hashes():
    codes = np.array([5, 1, 2, 9, 1, 2], np.uint32)
    r = hashing.Rolling(codes)
    h = r.spans(np.array([1, 4, 0]), np.array([3, 6, 2]))
    assert h[0] == h[1] != h[2]
    table = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.uint64))
    found = hashing.Lookup(table).find(np.concatenate([table[::7], np.array([1, 2**64 - 1], np.uint64)]))
    assert (found[:-2] == np.arange(0, len(table), 7)).all() and (found[-2:] == -1).all()
