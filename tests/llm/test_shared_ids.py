"""Vectors of which several have one vec_id: against brute force and the SQL over all pairs."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tieledger.llm import queries, vecdedup


def rows(seed):
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(8, 12))
    out = []
    for k in range(120):
        v = [float(x) for x in (base[k % 8] + draw.normal(size=12) * 0.22).astype(np.float32)]
        out.append((int(draw.integers(60)), v, int(k % 3 == 0) if k % 17 else None))
    out += [out[5], out[5], (out[5][0], out[9][1], out[9][2]), (71, out[5][1], out[5][2]), (72, None, 1), (72, out[8][1], out[8][2]), (None, out[8][1], out[8][2])]
    return out


def brute(rows):
    ok = [(i, np.array(v), label) for i, v, label in rows if i is not None and v and label is not None]
    near, parent = {i: set() for i, *_ in rows if i is not None}, {i: i for i, *_ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, v, label in ok:
        for j, w, other in ok:
            if i != j and label == other and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93:
                near[i].add(j)
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(near[i]), find(i)) for i in near}


@pytest.mark.parametrize("seed", [1, 2])
def test_ids_of_several_vectors(spark, monkeypatch, seed):
    monkeypatch.setattr(vecdedup, "TILE", 16)
    made = rows(seed)
    got = vecdedup.near_vectors(spark.createDataFrame(made, "vec_id long, embedding array<float>, label int")).collect()
    want = brute(made)
    assert len(got) == len(made)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got if r["vec_id"] is not None} == want
    assert [tuple(r)[:3] for r in got if r["vec_id"] is None] == [(None, 0, None)]
    con = duckdb.connect()
    embeddings = pd.DataFrame([r for r in made if r[0] is not None], columns=["vec_id", "embedding", "label"])  # noqa: F841
    sql = con.sql(queries.oracle_sql()["op8_near_vectors"]).fetchall()
    names = [d[0] for d in con.description] if con.description else ["vec_id", "n_links", "component_id", "kept"]
    assert {r[names.index("vec_id")]: (r[names.index("n_links")], r[names.index("component_id")]) for r in sql} == want


def test_one_id_is_no_link_of_its_own(spark):
    v, w, far = [1.0, 0.0], [1.0, 0.01], [0.0, 1.0]
    for made, want in (([(1, v, 0), (1, w, 0), (2, far, 0)], {1: 0, 2: 0}), ([(1, v, 0), (1, v, 0)], {1: 0}), ([(1, v, 0), (1, w, 0), (2, v, 0)], {1: 1, 2: 1})):
        got = vecdedup.near_vectors(spark.createDataFrame(made, "vec_id long, embedding array<float>, label int")).collect()
        assert {r["vec_id"]: r["n_links"] for r in got} == want
