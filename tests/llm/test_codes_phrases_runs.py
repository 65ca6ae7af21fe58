"""Byte-pair codes, collocations and periodic runs against plain versions, and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import EDGE, docs_of
from tieledger.llm import bytepair, collocations, periodicity, queries

SF = "/root/testdata/sf0.001"
sha = lambda b: hashlib.sha256(b.encode() if isinstance(b, str) else b).hexdigest()


@pytest.fixture(scope="module")
def edge(spark):
    return docs_of(spark, EDGE)


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


# byte-pair codes

SIGNS = ["a", "b", "'", "s", "re", "ll", " ", "  ", "\n", "1", "23", "!", "é", "中", " ", "it's", "'re", "<|endoftext|>", "\x1c", "🙂", "you'll", " "]


def test_chunks_stitch_to_the_whole():
    """Chunks of 40 characters with 12 of overlap: many stitches, and pieces longer than chunks."""
    codec, draw = bytepair.Codec(size=40, overlap=12), random.Random(3)
    for _ in range(1500):
        text = "".join(draw.choice(SIGNS[: draw.randrange(1, len(SIGNS) + 1)]) * draw.choice([1, 1, 1, 1, 30]) for _ in range(draw.randrange(150)))
        assert list(codec.whole(text)) == codec.encoding.encode_ordinary(text), text


def test_byte_pair_query(spark):
    encoding = bytepair.Codec().encoding
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = encoding.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(ids), sha(" ".join(map(str, ids))), sha(r["text"] or ""))
    got = queries.op11_byte_pair_codes(spark, SF)
    assert dict(got.dtypes)["n_tokens"] == "bigint"
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == want


def test_byte_pair_edges(spark, edge, empty):
    """Long texts go through the shuffle: copies, one endless piece, and a blank stretch over many chunks."""
    rows = [(20, "word, " * 300), (21, "word, " * 300), (22, "a " + "z" * 3000 + " b" + " " * 2500 + "\n c 'll"), (23, None), (24, "<|endoftext|>" * 200), (22, "tail")]
    got = bytepair.encoded(edge.unionByName(docs_of(spark, rows)), size=600).withColumn("raw", bytepair.decoded(F.col("ids"))).collect()
    encoding = bytepair.Codec().encoding
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], r[1]) for r in EDGE + rows)
    for r in got:
        assert list(r["ids"]) == encoding.encode_ordinary(r["text"] or "") and bytes(r["raw"]) == (r["text"] or "").encode() and r["lang_pred"] == "old"
    assert bytepair.encoded(empty).count() == 0 and bytepair.report(empty).count() == 0


def test_ids_need_not_be_whole_characters(spark):
    got = spark.createDataFrame([([188],), ([],), (None,)], "ids array<int>").select(bytepair.decoded(F.col("ids"))).collect()
    assert len(got[0][0]) == 1 and got[1][0] == b"" and got[2][0] is None


# collocations


def plain_collocations(rows, least=10, percent=50, top=2000):
    f, sizes = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    found = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    over = {}
    for g, a in found.items():
        if len(g) == 4:
            for part in ((g[0], *g[1:3]), (g[0], *g[2:])):
                over[part] = max(over.get(part, 0), a)
    out = {}
    for g, a in found.items():
        if 100 * over.get(g, 0) >= percent * a:
            continue
        score, _, le, r = min((10**6 * a * a // (f[g[: 1 + k]] * f[(g[0], *g[1 + k :])]), k, f[g[: 1 + k]], f[(g[0], *g[1 + k :])]) for k in range(1, len(g) - 1))
        out.setdefault(g[0], []).append((-score, -a, " ".join(g[1:]).encode(), le, r))
    return sorted((lang, k + 1, p.decode(), -a, le, r, sizes[lang], -s) for lang, own in out.items() for k, (s, a, p, le, r) in enumerate(sorted(own)[:top]))


def phrases(seed, n):
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        words = [draw.choice(["New", "new", "york", "city", "the", "of", "a|b", "é", "Zürich", "中文", str(draw.randrange(40))]) for _ in range(draw.randrange(60))]
        out.append((draw.choice(["en", "en", "de", None]), "".join(w + draw.choice([" ", "  ", "\t", ", ", "\n", ".", "\x00", " "]) for w in words)))
    return out


def test_collocations(spark):
    rows = phrases(1, 600) + [("en", "the of the of the of " * 50), ("fr", None), ("fr", ""), ("fr", " .,; ")]
    docs = spark.createDataFrame([(i, t, lang, "x", 1) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, n string, w1 int").repartition(5)
    want = plain_collocations(rows)
    assert len(want) > 100
    get = lambda **how: sorted(tuple(r) for r in collocations.collocations(docs, **how).collect())
    assert get() == want
    # stripes built of few words, and most dealt into several slices
    assert get(entries=20, at_once=500) == want


def test_collocations_edges(spark, edge, empty):
    assert collocations.collocations(empty.withColumn("n", F.lit(1))).count() == 0
    own = edge.drop("lang").withColumn("lang", F.lit(None).cast("string"))
    assert sorted(tuple(r) for r in collocations.collocations(own).collect()) == plain_collocations([(None, t) for _, t in EDGE])


def test_counts_beyond_64_bits(spark):
    """a = 4 000 000 and more: a * a * 1 000 000 needs 65 bits."""
    docs = spark.range(64).select(F.lit("x").alias("lang"), F.repeat(F.lit("p q "), 65_000).alias("text"))
    got = {r["phrase"]: tuple(r)[3:] for r in collocations.collocations(docs).collect()}
    n = 64 * 65_000
    assert got["p q p"] == (n - 64, n, n, 2 * n, 10**6 * (n - 64) ** 2 // (n * n))


# runs


def plain_runs(words):
    n, out = len(words), []
    codes = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True)[1] if n else np.zeros(0, int)
    for q in range(1, n // 3 + 1):
        same, i = np.append(codes[q:] == codes[:-q], False), 0
        while i < len(same):
            if not same[i]:
                i += int(np.argmax(same[i:])) if same[i:].any() else len(same)
                continue
            j = i + int(np.argmin(same[i:]))
            size = j - i + q
            own = codes[i : i + size]
            if size >= max(24, 3 * q) and not any((own[p:] == own[:-p]).all() for p in range(1, q)):
                out.append((i, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(draw, most):
    parts, goal = [], draw.randrange(30, most)
    while len(parts) < goal:
        block = [draw.randrange(draw.choice([1, 2, 3, 5, 50])) for _ in range(draw.randrange(1, 60))]
        if draw.random() < 0.5:  # a block with a run of its own inside
            block = block[: draw.randrange(1, 5)] * draw.randrange(1, 30) + block
        parts += (block * draw.randrange(1, 7))[: draw.randrange(1, 600)]
    return parts


def test_all_runs_are_found():
    draw, n = random.Random(11), 0
    for _ in range(150):
        codes = repetitive(draw, 700)
        want = plain_runs(codes)
        assert [tuple(map(int, r)) for r in periodicity.find_runs(np.array(codes))] == want
        n += len(want)
    assert n > 300


def test_runs_of_long_periods():
    """Periods of hundreds of words that hold highly periodic stretches of two scales."""
    draw = random.Random(4)
    for period in (100, 255, 700):
        block = ["a"] * (period // 2) + ["b", "c"] * (period // 8)
        block += [str(draw.randrange(9)) for _ in range(period - len(block))]
        words = [str(draw.randrange(99)) for _ in range(50)] + (block * 4)[: 3 * period + period // 3] + ["end"]
        codes = np.unique(words, return_inverse=True)[1]
        assert [tuple(map(int, r)) for r in periodicity.find_runs(codes)] == plain_runs(words)


def test_long_texts_are_fast():
    codes = np.concatenate([np.arange(300_000), np.tile(np.arange(50_000), 4), np.full(100_000, 7)])
    assert [tuple(map(int, r)) for r in periodicity.find_runs(codes)] == [(300_000, 200_000, 50_000), (500_000, 100_000, 1)]


def test_runs_query(spark):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        n, h = len(words), zlib.crc32(str(r["doc_id"]).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = plain_runs(words)
        drop = {i for s, size, q in found for i in range(s + q, s + size)}
        best = max(found, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
        kept = " ".join(w for i, w in enumerate(words) if i not in drop)
        want[r["doc_id"]] = (len(found), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{size},{q}\n" for s, size, q in found)), sha(kept))
    got = queries.op13_periodic_runs(spark, SF)
    assert {k for k, v in dict(got.dtypes).items() if v == "bigint"} == {"doc_id", "n_runs", "start", "length", "period", "exponent_milli"}
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == want and sum(v[0] > 0 for v in want.values()) > 5


def test_runs_edges(spark, edge, empty):
    got = periodicity.with_runs(edge)
    assert got.columns == [*edge.columns, "runs", "collapsed"] and got.count() == len(EDGE) and periodicity.with_runs(empty).count() == 0
    of = {r["doc_id"]: r for r in got.collect()}
    assert of[1]["runs"] == [] and of[1]["collapsed"] == "" and of[3]["collapsed"] == ""
    assert [tuple(x) for x in of[6]["runs"]] == [(0, 40_000, 2)] and of[6]["collapsed"] == "the end"
    assert [tuple(r)[:2] for r in periodicity.report(edge).where("doc_id IS NULL").collect()] == [(None, 0)]
    nul = periodicity.with_runs(docs_of(spark, [(1, "a\x00b c d " * 30)])).first()
    assert [tuple(x) for x in nul["runs"]] == [(0, 60, 2)] and nul["collapsed"] == "a\x00b c d"
