"""Steps that depend on one another."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import operator
from ..storage import Scratch


#: Steps of a round that are broadcast.
FEW = 200_000


@operator(category="workflow")
def step_levels(steps: DataFrame) -> DataFrame:
    """step and level of every row (step, dep): 0 without a dependency, else one more than the dependency's.

    Each round doubles the distance that a step has looked back, so a chain of n steps takes log2(n)
    rounds, each written to shared storage. Steps are distinct; a ``dep`` that is null, the step itself or
    no step at all counts as none; a circle is an error.
    """
    scratch = Scratch(steps.sparkSession, "levels")
    known = steps.select(F.col("step").alias("dep"), F.col("step").alias("up"))
    now = scratch.keep(steps.join(known, "dep", "left").select("step", F.when(F.col("up") != F.col("step"), F.col("up")).alias("up"))
        .withColumn("level", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long")))
    total = now.count()
    open_, looked = now.where("up is not null").count(), 1
    while open_:
        if looked > total:
            raise ValueError("the steps depend on one another in a circle")
        far = now.select(F.col("step").alias("up"), F.col("up").alias("_up"), F.col("level").alias("_level"))
        # finished steps stay out of the join, so that the roots are no hot keys of it
        moved = now.where("up is not null").join(far, "up").select("step", F.col("_up").alias("up"), (F.col("level") + F.col("_level")).alias("level"))
        nxt = scratch.keep(now.where("up is null").unionByName(moved))
        scratch.drop(now)
        now, looked = nxt, looked * 2
        open_ = now.where("up is not null").count()
    return now.select("step", "level")


@operator(category="workflow")
def dag_run(steps: DataFrame, failing: DataFrame | None = None) -> DataFrame:
    """step, level and status of every step of a graph (step, dep), a row for each dependency.

    A step runs when all that it depends on are through: level 0 has no dependency, and each level is
    what became runnable by the one before. ``failing`` (step) are those that fail when they run. status
    is ``completed``, ``failed``, ``stopped`` (something that it depends on, at any distance, failed),
    ``circular`` (on a circle or between two) or ``blocked`` (behind a circle, or behind a
    dependency that is no step); the last two have no level. Null dependencies count as none and repeated ones
    once; null steps are left out.

    Edges lie sorted by what they depend on. A round reads those between the smallest and the largest step that the
    last one ended, joins them with these steps, which are broadcast if they are few, and counts for each step
    that was met how many of its dependencies are through; only such counts are written, no edges. Rounds are as
    many as levels. A step that very many depend on is a hot key on the side that adaptive execution splits.
    """
    scratch = Scratch(steps.sparkSession, "dag")
    pairs = scratch.keep(steps.where("step is not null").select("step", "dep").distinct(), "pairs")
    names, bad = pairs.groupBy("step").agg(F.count("dep").alias("need")), F.lit(False)
    if failing is not None:
        names = names.join(failing.select("step").distinct().withColumn("_fails", F.lit(True)), "step", "left")
        bad = F.coalesce("_fails", F.lit(False))
    names = scratch.keep(names.select("step", bad.alias("fails"), "need"), "names")
    edges = scratch.keep(pairs.where("dep is not null").join(names, "step").repartitionByRange("dep").sortWithinPartitions("dep"), "edges")
    scratch.drop(pairs)
    now = names.where("need = 0").select("step", "fails", F.lit(False).alias("hit"), "need", F.lit(0).cast("long").alias("met"))
    done, through = [], 0
    while True:
        ready = now.where("met = need")
        n, low, high = ready.agg(F.count(F.lit(1)), F.min("step"), F.max("step")).first()
        done.append(ready.withColumn("level", F.lit(len(done)).cast("long")))
        if not n:
            break
        through += n
        ended = ready.select(F.col("step").alias("dep"), (F.col("fails") | F.col("hit")).alias("hit"))
        near = edges.where(F.col("dep").between(F.lit(low), F.lit(high))).join(F.broadcast(ended) if n <= FEW else ended, "dep")
        counts = near.select("step", "fails", "hit", "need", F.lit(1).cast("long").alias("met")).unionByName(now.where("met < need"))
        now = scratch.keep(counts.groupBy("step").agg(F.bool_or("fails").alias("fails"), F.bool_or("hit").alias("hit"), F.max("need").alias("need"),
            F.sum("met").alias("met")), "counts")
    ran = reduce(DataFrame.unionByName, done)
    status = F.when(F.col("hit"), "stopped").when(F.col("fails"), "failed").otherwise("completed")
    out = ran.select("step", "level", status.alias("status"))
    if through == names.count():
        return out
    open_ = scratch.keep(edges.select("step", "dep").join(ran.select("step"), "step", "left_anti"), "open")
    core = circular(open_, scratch).select("step").distinct().withColumn("_core", F.lit(True))
    left = names.join(ran.select("step"), "step", "left_anti").join(core, "step", "left")
    return out.unionByName(left.select("step", F.lit(None).cast("long").alias("level"), F.when(F.col("_core"), "circular").otherwise("blocked").alias("status")))


def circular(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """The edges (step, dep) that lie on circles or between two: steps without a dependency and those that nothing depends on are peeled off until none is left."""
    while True:
        has = edges.select(F.col("step").alias("dep")).distinct()
        wanted = edges.select(F.col("dep").alias("step")).distinct()
        n = edges.count()
        less = scratch.keep(edges.join(has, "dep", "left_semi").join(wanted, "step", "left_semi").select("step", "dep"), "core")
        if less.count() == n:
            return less
        edges = less


def circle(steps: DataFrame) -> DataFrame:
    """step and dep along one circle of the graph (step, dep), no row if it has none.

    In the circular part every step is followed to its smallest dependency. The smallest step, led on by
    doubling the distance, comes to a circle, and doubling also gathers the steps on it.
    """
    scratch = Scratch(steps.sparkSession, "circle")
    core = circular(scratch.keep(steps.where("step is not null and dep is not null").select("step", "dep").distinct(), "edges"), scratch)
    to = scratch.keep(core.groupBy("step").agg(F.min("dep").alias("dep")), "to")
    n = to.count()
    jumps, far = [to], 1
    while far < n:
        a, b = jumps[-1], jumps[-1].select(F.col("step").alias("dep"), F.col("dep").alias("_to"))
        jumps.append(scratch.keep(a.join(b, "dep").select("step", F.col("_to").alias("dep")), "jump"))
        far *= 2
    on = to.agg(F.min("step").alias("step")).where("step is not null")
    for jump in jumps:
        on = on.join(jump, "step").select(F.col("dep").alias("step"))
    seen = scratch.keep(on, "on")
    for jump in jumps:
        more = seen.join(jump, "step").select(F.col("dep").alias("step"))
        seen = scratch.keep(seen.unionByName(more).distinct(), "seen")
    return to.join(seen, "step").select("step", "dep")


@operator(category="workflow")
def step_parameters(steps: DataFrame, outputs: DataFrame, own: DataFrame | None = None, context: dict[str, str] | None = None) -> DataFrame:
    """step and params, a map: ``context``, then ``<dep>_output`` of each dependency that has one in ``outputs`` (step, output), then the step's ``own`` (step, params).

    Of equal names the later source counts. Steps without any have the context alone; rows (step, dep) may repeat.
    """
    deps = steps.where("step is not null").select("step", "dep").distinct()
    given = outputs.select(F.col("step").alias("dep"), "output")
    entry = F.when(F.col("output").isNotNull(), F.struct(F.concat(F.col("dep").cast("string"), F.lit("_output")).alias("k"), F.col("output").alias("v")))
    held = deps.join(given, "dep", "left").groupBy("step").agg(F.map_from_entries(F.array_sort(F.collect_set(entry))).alias("_out"))
    base = F.create_map(*[F.lit(str(x)) for kv in (context or {}).items() for x in kv]).cast("map<string,string>") if context else F.expr("cast(map() as map<string,string>)")
    if own is None:
        held = held.withColumn("_own", F.expr("cast(map() as map<string,string>)"))
    else:
        held = held.join(own.select("step", F.col("params").alias("_own")), "step", "left")
    later = F.coalesce("_own", F.expr("cast(map() as map<string,string>)"))
    over = lambda a, b: F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)
    return held.select("step", over(over(base, F.col("_out")), later).alias("params"))
