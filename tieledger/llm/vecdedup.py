"""Near-duplicate vectors of one label: PCA-ordered tiles, leading dimensions first.

1. Equal vectors of a label form a class with a count, so copies are never paired.
2. Vectors are turned into the principal axes of a bounded sample.  A label's vectors are ordered along the first axis and
   cut into tiles of bounded size; two tiles are compared only if the boxes around them, on the leading axes, are near
   enough for the threshold.
3. A pair of tiles multiplies the leading dimensions first.  What the rest can add is at most the product of the suffix
   norms, so a pair whose sum stays below the threshold is dropped at once; the others go on with more dimensions.
4. Cosines within 1e-5 of the threshold are computed again from the original vectors in double precision.

A pair of tiles returns, for each vector with links, how many it has and the root of its local component: never the pairs.

Defined cases: vectors that are null, zero or hold null or non-finite components, and rows with a null label or vec_id, link
with nothing (0 links, their own component, kept); vectors of unlike length never link; rows that share a vec_id are one
node, linked with the other vec_ids that any of them is linked with, each counted once; an empty table gives an empty one; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieledger.llm.vectors import sample, unit, usable, usual_length
from tieledger.operators.components import connected_components
from tieledger.sources.tables import cut

#: Vectors of a tile; tiles along one axis; axes of the boxes around tiles; dimensions after which pairs are dropped.
TILE, TILES, BOX, STEPS = 1024, 256, 8, (16, 32)
_CLOSE = 1e-5


def principal_axes(df: DataFrame, most_floats: int = 4_000_000) -> np.ndarray:
    """Columns are the axes by falling variance, from at most about ``most_floats`` numbers of the usual length."""
    dims = usual_length(df)
    x = sample(df, dims, max(2, most_floats // max(1, dims)))
    if len(x) < 2:
        return np.eye(dims)
    _, axes = np.linalg.eigh(np.cov(x, rowvar=False).reshape(dims, dims))
    return axes[:, ::-1].copy()


def _turned(vectors: np.ndarray, axes: np.ndarray) -> np.ndarray:
    x = unit(vectors)
    return x @ axes if x.shape[1] == len(axes) else x


def links_between(a: np.ndarray, b: np.ndarray | None, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the linked pairs of two tiles of original vectors, or of one (i < j) if b is None."""
    ya = _turned(a, axes).astype(np.float32)
    yb = ya if b is None else _turned(b, axes).astype(np.float32)
    steps = [s for s in STEPS if s < ya.shape[1]]
    cuts = [0, *steps, ya.shape[1]]
    left = np.float32(threshold - _CLOSE)

    def suffix(y: np.ndarray, s: int) -> np.ndarray:
        return np.sqrt((y[:, s:] ** 2).sum(axis=1)).astype(np.float32)

    s = cuts[1]
    sums = ya[:, :s] @ yb[:, :s].T
    i, j = np.nonzero(sums + suffix(ya, s)[:, None] * suffix(yb, s)[None, :] >= left)
    if b is None:
        i, j = i[i < j], j[i < j]
    got = sums[i, j]
    for s, t in zip(cuts[1:], cuts[2:], strict=False):
        for k in range(0, len(i), 65536):
            part = slice(k, k + 65536)
            got[part] += np.einsum("nd,nd->n", ya[i[part], s:t], yb[j[part], s:t])
        keep = got + suffix(ya, t)[i] * suffix(yb, t)[j] >= left
        i, j, got = i[keep], j[keep], got[keep]
    near = np.flatnonzero(np.abs(got - threshold) <= 2 * _CLOSE)
    if len(near):
        p, q = a[i[near]], (a if b is None else b)[j[near]]
        exact = (p * q).sum(axis=1) / (np.sqrt((p * p).sum(axis=1)) * np.sqrt((q * q).sum(axis=1)))
        got = got.astype(float)
        got[near] = exact
    keep = got >= threshold
    return i[keep], j[keep]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that links lead to."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(axes: np.ndarray, threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block", ignore_index=True)
        tiles = []
        for r in rows.itertuples(index=False):
            ids, counts = np.frombuffer(r.ids, np.int64), np.frombuffer(r.counts, np.int64)
            tiles.append((ids, counts, np.frombuffer(r.vectors, np.float64).reshape(len(ids), -1), np.frombuffer(r.shared, bool)))
        one, two = tiles[0], tiles[1] if len(tiles) > 1 else None
        i, j = links_between(one[2], two and two[2], axes, threshold)
        shift = len(one[0]) if two else 0
        ids = np.concatenate([one[0], two[0]]) if two else one[0]
        counts = np.concatenate([one[1], two[1]]) if two else one[1]
        shared = np.concatenate([one[3], two[3]]) if two else one[3]
        j = j + shift
        links = np.bincount(i, counts[j], len(ids)) + np.bincount(j, counts[i], len(ids))
        linked = np.flatnonzero(links > 0)
        sums = pd.DataFrame({"rep": ids[linked], "links": links[linked].astype(np.int64), "root": ids[_roots(len(ids), i, j)[linked]], "other": pd.array([pd.NA] * len(linked), "Int64")})
        odd = np.flatnonzero(shared[i] | shared[j])  # few: pairs in which a vec_id has several vectors
        a, b = ids[np.concatenate([i[odd], j[odd]])], ids[np.concatenate([j[odd], i[odd]])]
        pairs = pd.DataFrame({"rep": a, "links": np.zeros(len(a), np.int64), "root": a, "other": pd.array(b, "Int64")})
        return pd.concat([sums, pairs], ignore_index=True)

    return run


def _placed(axes: np.ndarray):
    """First axis of each vector, to order by."""

    @F.pandas_udf("array<double>")
    def run(embeddings: pd.Series) -> pd.Series:
        return pd.Series([_turned(np.asarray(e, float)[None], axes)[0][:BOX].tolist() for e in embeddings])

    return run(F.col("embedding"))


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("rep", ignore_index=True)
    lead = np.array(rows["lead"].tolist())
    vectors = np.array([np.asarray(e, float) for e in rows["embedding"]])
    first = rows.iloc[0]
    return pd.DataFrame(
        {
            "label": [first["label"]], "dims": [first["dims"]], "block": [first["block"]], "lo": [lead.min(axis=0).tolist()], "hi": [lead.max(axis=0).tolist()],
            "ids": [rows["rep"].to_numpy(np.int64).tobytes()], "counts": [rows["n"].to_numpy(np.int64).tobytes()], "shared": [rows["shared"].to_numpy(bool).tobytes()], "vectors": [vectors.tobytes()],
        }
    )


def linked_classes(classes: DataFrame, threshold: float) -> DataFrame:
    """Classes (label, rep, n, shared, embedding) -> (rep, links, root) by pair of tiles, for classes with links.

    Besides, both ways, (rep, other) for linked classes of which one is ``shared``.
    """
    axes = principal_axes(classes)
    placed = cut(classes.withColumn("dims", F.size("embedding")).withColumn("lead", _placed(axes)))
    # tiles by quantiles along the first axis; those still too full along the next, and so on
    placed, by = placed.withColumn("block", F.lit("")), ["label", "dims", "block"]
    for axis in range(BOX):
        n_tiles = F.least(F.ceil(F.col("c") / TILE), F.lit(TILES)).cast("int")
        at = F.get("lead", F.lit(axis))  # null beyond a short vector's axes
        shape = cut(placed.groupBy(*by).agg(F.count("*").alias("c"), F.percentile_approx(at, [k / TILES for k in range(1, TILES)], 2000).alias("q")).withColumn("tiles", n_tiles))
        if (shape.agg(F.max("tiles")).first()[0] or 1) <= 1:
            break
        shape = shape.withColumn("q", F.transform(F.sequence(F.lit(1), F.col("tiles")), lambda k: F.element_at("q", F.greatest(F.lit(1), F.least(F.lit(TILES - 1), (k * TILES / F.col("tiles")).cast("int"))))))
        tile = F.size(F.filter(F.slice("q", 1, F.size("q") - 1), lambda x: x < at))
        placed = placed.join(shape, by).withColumn("block", F.concat("block", F.lpad(F.coalesce(F.greatest(tile, F.lit(0)), F.lit(0)).cast("string"), 4, "0"), F.lit("/"))).drop("q", "c", "tiles")
    # what lies at one place on all axes, or a few too many, is dealt out by a hash
    full = placed.groupBy(*by).agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    tiled = placed.join(full, by).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    tiled = tiled.withColumn("block", F.concat("block", F.col("part").cast("string")))
    schema = "label string, dims int, block string, lo array<double>, hi array<double>, ids binary, counts binary, shared binary, vectors binary"
    tiled = tiled.withColumn("label", F.col("label").cast("string")).select("label", "dims", "block", "rep", "n", "shared", "lead", "embedding")
    blocks = cut(tiled.groupBy("label", "dims", "block").applyInPandas(_packed, schema))
    boxes = blocks.select("label", "dims", "block", "lo", "hi")
    a, b = boxes.alias("a"), boxes.alias("b")
    gap = F.zip_with(F.zip_with("a.lo", "b.hi", lambda x, y: x - y), F.zip_with("b.lo", "a.hi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    apart = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)
    near = (F.col("a.label") == F.col("b.label")) & (F.col("a.dims") == F.col("b.dims")) & (F.col("a.block") <= F.col("b.block")) & (apart <= 2 - 2 * threshold + 1e-6)
    pairs = a.join(b, near).select("a.label", "a.dims", F.col("a.block").alias("one"), F.col("b.block").alias("two"))
    sides = pairs.withColumn("block", F.explode(F.array_distinct(F.array("one", "two"))))
    rows = sides.join(blocks.select("label", "dims", "block", "ids", "counts", "shared", "vectors"), ["label", "dims", "block"])
    return rows.groupBy("label", "dims", "one", "two").applyInPandas(_compare(axes, threshold), "rep long, links long, root long, other long")


def near_vectors(df: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, embedding, label) -> one row per row: vec_id, n_links, component_id, kept."""
    ok = usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    both = [F.when(ok, F.xxhash64("label", "embedding")).alias("h"), F.when(ok, F.xxhash64(F.lit(1), "embedding", "label")).alias("h2")]
    rows = cut(df.select(F.col("vec_id").cast("long"), "label", F.when(ok, F.col("embedding")).alias("embedding"), *both))
    # classes of equal vectors, by the different vec_ids that have them; numbers are firm once written
    members = rows.where("h IS NOT NULL").select("vec_id", "h", "h2").distinct()
    counts = members.groupBy("h", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    first = rows.where("h IS NOT NULL").groupBy("h", "h2").agg(F.first("embedding").alias("embedding"), F.first("label").alias("label"))
    classes = cut(first.join(counts, ["h", "h2"]).withColumn("rep", F.monotonically_increasing_id()))
    members = cut(members.join(classes.select("h", "h2", "rep"), ["h", "h2"]).select("vec_id", "rep"))
    several = members.groupBy("vec_id").agg(F.count("*").alias("c")).where("c > 1").select("vec_id")
    several = cut(members.join(several, "vec_id", "left_semi"))  # (vec_id, rep) of ids with more than one vector
    flagged = classes.join(several.select("rep").distinct().withColumn("shared", F.lit(True)), "rep", "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
    found = cut(linked_classes(flagged.select("label", "rep", "n", "shared", "embedding"), threshold))
    sums = found.where("other IS NULL").groupBy("rep").agg(F.sum("links").alias("links"))
    counted = classes.select("rep", "n").join(sums, "rep", "left").select("rep", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    links = members.join(counted, "rep").select("vec_id", "rep", "n_links")
    if not several.isEmpty():
        links = _each_id_once(links, members, classes, several, found.where("other IS NOT NULL").select("rep", "other").distinct())
    links = links.groupBy("vec_id").agg(F.max("n_links").alias("n_links"))
    rows = cut(rows.select("vec_id").join(links, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    least = classes.select("rep", "least")
    edges = found.where("rep <> root").select("rep", "root").join(least.withColumnRenamed("least", "a"), "rep").join(least.select(F.col("rep").alias("root"), F.col("least").alias("b")), "root").select("a", "b")
    edges = edges.unionByName(members.join(least, "rep").select(F.col("vec_id").alias("a"), F.col("least").alias("b"))).where("a <> b")
    comps = connected_components(edges).withColumnRenamed("node", "vec_id")
    out = rows.join(comps, "vec_id", "left").select("vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _each_id_once(links: DataFrame, members: DataFrame, classes: DataFrame, several: DataFrame, near: DataFrame) -> DataFrame:
    """``links`` (vec_id, rep, n_links) counts the ids of all classes at hand; an id of several of them is to count once, and nobody for itself.

    ``several``: (vec_id, rep) of such ids; ``near``: (rep, other) of linked classes of which one holds such an id.
    """
    of = several.select(F.col("vec_id").alias("d"), F.col("rep").alias("other"))
    reach = near.unionByName(several.select("rep", F.col("rep").alias("other")).distinct())
    # how often an id comes too much among a class and those linked with it
    twice = reach.join(of, "other").groupBy("rep", "d").agg((F.count("*") - 1).alias("more")).where("more > 0").groupBy("rep").agg(F.sum("more").alias("more"))
    plain = links.join(several.select("vec_id").distinct(), "vec_id", "left_anti").join(twice, "rep", "left").select("vec_id", "rep", (F.col("n_links") - F.coalesce("more", F.lit(0))).alias("n_links"))
    # such an id itself: all classes that any of its own is linked with
    own = several.join(reach, "rep").select("vec_id", "other").distinct()
    total = own.join(classes.select(F.col("rep").alias("other"), "n"), "other").groupBy("vec_id").agg(F.sum("n").alias("n"))
    again = own.join(of, "other").groupBy("vec_id", "d").agg((F.count("*") - 1).alias("more")).groupBy("vec_id").agg(F.sum("more").alias("more"))
    odd = total.join(again, "vec_id").select("vec_id", F.lit(None).cast("long").alias("rep"), (F.col("n") - F.col("more") - 1).alias("n_links"))
    return plain.unionByName(odd)
