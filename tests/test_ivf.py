"""The vector index: recall, exact search, pruned reads."""

import numpy as np
import pytest

from larkspur.operators import ivf, vectors


def made(spark, n=3000, d=16, seed=1):
    rng = np.random.default_rng(seed)
    hubs = rng.normal(size=(30, d))
    x = hubs[rng.integers(0, 30, n)] + 0.35 * rng.normal(size=(n, d))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def asked(df, every):
    return df.where(f"vec_id % {every} = 0").selectExpr("vec_id AS query_id", "embedding AS q")


def pairs(df):
    return {(r.query_id, r.vec_id): r.similarity for r in df.collect()}


def test_recall_exact_and_pruning(spark, tmp_path):
    rows, df = made(spark)
    index = ivf.build(df, f"file://{tmp_path}/index")
    want = pairs(vectors.topk(df, asked(df, 100)).select("query_id", "vec_id", "similarity"))
    near = pairs(index.search(asked(df, 100), 10, probes=8))
    assert len(set(near) & set(want)) >= 0.9 * len(want)
    assert pairs(index.search(asked(df, 100), 10, probes=2, exact=True)) == want
    assert sum(index.sizes.values()) == 3000 and len(index.lists) == round(3000**0.5)
    some = index.read([int(index.lists[0])])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "list#" in plan.split("PartitionFilters:")[1].split("]")[0] and some.count() == index.sizes[index.lists[0]]


def test_odd_vectors(spark, tmp_path):
    rows, _ = made(spark, 60, 4)
    rows += [(100, None), (101, []), (102, [0.0] * 4), (103, [1.0, 2.0]), (104, [None, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(1, rows[3][1]), (2, [0.0] * 4), (3, None), (4, [1.0, 0.0, 0.0, 0.0])], "query_id long, q array<double>")
    index = ivf.build(df, f"file://{tmp_path}/index", lists=5)
    assert index.sizes[-1] == 5
    for k in (3, 62):
        want = pairs(vectors.topk(df, queries, k).select("query_id", "vec_id", "similarity"))
        got = pairs(index.search(queries, k, probes=1, exact=True))
        keep = lambda p: {x: v for x, v in p.items() if x[0] in (1, 4)}
        assert keep(got) == pytest.approx(keep(want), nan_ok=True) if k == 3 else set(keep(got)) == set(keep(want))
    empty = ivf.build(df.limit(0), f"file://{tmp_path}/empty")
    assert empty.search(queries, 3).count() == 0 and empty.search(queries, 3, exact=True).count() == 0
    assert ivf.build(df.where("vec_id > 99"), f"file://{tmp_path}/none").search(queries, 3, exact=True).count() > 0


def test_a_large_list_is_several_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ivf, "PART", 100)
    rows, df = made(spark, 900, 8)
    index = ivf.build(df, f"file://{tmp_path}/index", lists=2)
    assert pairs(index.search(asked(df, 90), 5, probes=1, exact=True)) == pairs(vectors.topk(df, asked(df, 90), 5).select("query_id", "vec_id", "similarity"))
