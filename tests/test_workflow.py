"""Step graphs against a plain scheduler."""

import random

import pytest

from larkspur.operators import workflow

EDGES = "step long, dep long"


def scheduler(edges, failing=()):
    """Round by round: whatever has all its dependencies behind it runs."""
    deps = {}
    for step, dep in edges:
        if step is not None:
            deps.setdefault(step, set())
            if dep is not None:
                deps[step].add(dep)
    out, level = {}, 0
    while ready := [s for s in deps if s not in out and all(d in out for d in deps[s])]:
        new = {}
        for s in ready:
            stopped = any(out[d][1] != "completed" for d in deps[s])
            new[s] = (level, "stopped" if stopped else "failed" if s in failing else "completed")
        out |= new
        level += 1
    left = set(deps) - set(out)
    core = {s: {d for d in deps[s] if d in left} for s in left}
    while True:
        wanted = {d for ds in core.values() for d in ds}
        less = {s: {d for d in ds if d in core} for s, ds in core.items() if s in wanted and any(d in core for d in ds)}
        if less == core:
            break
        core = less
    return out | {s: (None, "circular" if s in core else "blocked") for s in left}


def ran(spark, edges, failing=()):
    fails = spark.createDataFrame([(s,) for s in failing], "step long")
    rows = workflow.dag_run(spark.createDataFrame(edges, EDGES), fails).collect()
    out = {r.step: (r.level, r.status) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(s, rng.randrange(s) if s and rng.random() < 0.9 else None) for s in range(120) for _ in range(rng.randrange(1, 4))]
    edges += [(s, 0) for s in range(1, 60)]  # a step that half of all depend on
    if seed:
        edges += [(30, 90), (90, 30), (5, 5), (110, 999), (111, 110), (None, 3), (7, None), (7, 6), (7, 6)]
    failing = rng.sample(range(1, 120), 6)
    assert ran(spark, edges, failing) == scheduler(edges, failing)


def test_all_circular_and_empty(spark):
    assert ran(spark, [(1, 2), (2, 3), (3, 1), (4, 1)]) == {1: (None, "circular"), 2: (None, "circular"), 3: (None, "circular"), 4: (None, "blocked")}
    assert ran(spark, [(1, None)]) == {1: (0, "completed")} and ran(spark, []) == {}


def test_rounds_write_no_edges(spark, monkeypatch):
    """What a round writes are the steps that it met, not the edges that are still open."""
    from larkspur.storage import Scratch

    kept, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name="t": kept.append((name, keep(self, df, name))) or kept[-1][1])
    edges = [(1, 0), (2, 1), (3, 2)] + [(s, 3) for s in range(10, 40)] + [(s, s - 30) for s in range(40, 70)]
    monkeypatch.setattr(workflow, "FEW", 2)
    assert ran(spark, edges + [(0, None)], [2]) == scheduler(edges + [(0, None)], [2])
    assert sum("dep" in t.columns for _, t in kept) == 2  # the pairs and the sorted edges


def test_circle_is_named(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(40, 17), (17, 3), (60, 61), (2, 60)]
    got = {r.step: r.dep for r in workflow.circle(spark.createDataFrame(edges, EDGES)).collect()}
    at, seen = min(got), []
    while at not in seen:
        seen.append(at)
        at = got[at]
    assert sorted(seen) == sorted(got) and all((s, d) in edges for s, d in got.items())
    assert workflow.circle(spark.createDataFrame([(1, 2), (2, 3)], EDGES)).count() == 0


def test_step_parameters(spark):
    steps = spark.createDataFrame([("a", None), ("b", "a"), ("c", "a"), ("c", "b"), ("c", "b"), ("d", "x")], "step string, dep string")
    outputs = spark.createDataFrame([("a", "out a"), ("b", "out b")], "step string, output string")
    own = spark.createDataFrame([("c", {"tone": "own", "b_output": "mine"})], "step string, params map<string,string>")
    got = {r.step: r.params for r in workflow.step_parameters(steps, outputs, own, {"tone": "all", "user": "u"}).collect()}
    base = {"tone": "all", "user": "u"}
    assert got == {"a": base, "b": base | {"a_output": "out a"}, "c": {"tone": "own", "user": "u", "a_output": "out a", "b_output": "mine"}, "d": base}
    assert {r.step: r.params for r in workflow.step_parameters(steps, outputs).collect()}["a"] == {}
