"""Candidates for links in regions of similar sets, crowded or not.

A plan puts sets into first regions, tree by tree, and can split a region further, so that similar sets stay
together with a known probability. A region is crowded by the sets outside its largest component:
few of them meet all of that component, dealt out in blocks, and up to ``plan.whole`` blocks of sets all meet one
another; more are split again, and those that no depth parts meet in pairs of blocks, however many they are. Sets whose
sketches agree are compared as a whole, every pair of them that isn't linked yet. Sets whose regions are split, and
those that they might have met, get as many further trees as the depth of their regions wants.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable
from functools import reduce
from hashlib import blake2b
from itertools import pairwise
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch
from .cells import by_cell
from .graph import components
from .pairs import COORDINATES, agreement, common

#: Sketches this far below the threshold are not similar (about three and a half standard deviations).
SLACK = 0.12
#: Shingles of the sets that are compared in a task at once, about; more are dealt out in two halves of it.
TOKENS = 1 << 22


class Plan(Protocol):
    """Trees of regions."""

    short: int
    depths: tuple[int, ...]
    #: Sets of a region outside its largest component that are compared with all others.
    crowd: int
    #: Blocks of ``crowd`` sets whose pairs are all compared before a region is split.
    whole: int

    def first(self, sets: DataFrame) -> DataFrame:
        """(tree, cell, fp) of sets (fp, sketch, low, high) in trees low to high - 1."""

    def start(self, crowded: DataFrame) -> DataFrame:
        """What ``deeper`` wants of rows (tree, cell, fp, sketch, root, n)."""

    def deeper(self, crowded: DataFrame, last: int, depth: int) -> DataFrame:
        """The rows in the cells of a larger depth."""

    def trees(self, depth: int) -> int:
        """Trees until a pair at the threshold has met at ``depth`` with the wanted probability."""


def mixture(threshold: float, once: Callable[[int], float], recall: float) -> int:
    """Trees until a pair at the threshold has met with the probability ``recall``, if two sketches that share k values meet in a tree with the probability once(k).

    How many of their values two such sketches share is binomial.
    """
    share = [math.comb(COORDINATES, k) * threshold**k * (1 - threshold) ** (COORDINATES - k) for k in range(COORDINATES + 1)]
    each = [once(k) for k in range(COORDINATES + 1)]
    met = lambda trees: sum(p * (1 - (1 - q) ** trees) for p, q in zip(share, each))
    most = 1
    while met(most) < recall:
        most *= 2
    return bisect_left(range(most + 1), recall, key=met)


def neighbours(sets: DataFrame, scratch: Scratch, plan: Plan) -> DataFrame:
    """(tree, cell, fp, size) of all first regions of two sets or more; of small ones with the same members one."""
    reached = scratch.keep(plan.first(sets), "orders")
    held = reached.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("fp")).alias("members")).where("size > 1")
    once = F.when(F.col("size") > plan.crowd, F.col("cell"))
    one = held.groupBy("size", "members", once.alias("own")).agg(F.min("cell").alias("cell")).select("cell", "size")
    met = scratch.keep(reached.join(one, "cell").select("tree", "cell", "fp", "size"), "met")
    scratch.drop(reached)
    return met


def with_roots(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Rows (fp, ...) with the root of their set's component, the set itself if it has no link."""
    if roots is None:
        return rows.withColumn("root", F.col("fp"))
    return rows.join(roots.select(F.col("node").alias("_fp"), F.col("root").alias("_root")), F.col("fp") == F.col("_fp"), "left").withColumn(
        "root", F.coalesce("_root", "fp")).drop("_fp", "_root")


def mixed(rows: DataFrame) -> DataFrame:
    """Rows (cell, root, ...) of the cells that have sets of several components, with ``size``, ``others`` (sets outside the largest component) and ``main`` (whether the row is in that)."""
    of = F.xxhash64("root")
    held = rows.groupBy("cell", of.alias("_of")).agg(F.count(F.lit(1)).alias("n"))
    held = held.groupBy("cell").agg(F.sum("n").alias("size"), F.max(F.struct("n", "_of")).alias("_top"))
    several = held.where("size > _top.n").select("cell", "size", (F.col("size") - F.col("_top.n")).alias("others"), F.col("_top._of").alias("_main"))
    bare = rows.drop("size", "others", "main")
    return bare.join(several, "cell").withColumn("main", of == F.col("_main")).drop("_main")


def dealt(rows: DataFrame, depth: int, crowd: int) -> DataFrame:
    """(cell, fp, sketch, root, n, depth) of cells: where others are few, the largest component in blocks, each with all others; else all pairs of blocks."""
    few, of = F.col("others") <= crowd, lambda n: F.ceil(n / F.lit(crowd)).cast("int")
    blocks = F.when(few, F.greatest(of(F.col("size") - F.col("others")), F.lit(1))).otherwise(of(F.col("size")))
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    every = F.sequence(F.lit(0), blocks - 1)
    met = F.transform(F.filter(every, lambda b: b != own), lambda b: F.least(b, own).cast("long") * blocks + F.greatest(b, own))
    at = F.when(few & F.col("main"), F.array(own.cast("long"))).when(few, every.cast("array<long>")).otherwise(met)
    placed = rows.withColumn("_block", F.explode(at))
    return placed.select(F.xxhash64("cell", "_block").alias("cell"), "fp", "sketch", "root", "n", F.lit(depth).alias("depth"))


def regions(met: DataFrame, sketches: DataFrame, roots: DataFrame | None, scratch: Scratch, plan: Plan) -> tuple[DataFrame, DataFrame | None]:
    """Regions of several components (cell, fp, sketch, root, n, depth), as deep as it needs for ``plan.crowd`` others or ``plan.whole`` blocks at most; and the first regions that are split (cell, fp), None without one."""
    if roots is None:  # nothing is linked yet: all sets are others
        rows = met.select("tree", "cell", "fp", F.col("fp").alias("root"), "size", F.col("size").alias("others"), F.lit(False).alias("main"))
    else:
        rows = mixed(with_roots(met.select("tree", "cell", "fp"), roots))
    rows = scratch.keep(rows.join(sketches, "fp").select("tree", "cell", "fp", "sketch", "root", "n", "size", "others", "main"), "regions")
    few = (F.col("others") <= plan.crowd) | (F.col("size") <= plan.crowd * plan.whole)
    out = [dealt(rows.where(few), plan.short, plan.crowd)]
    crowded = rows.where(~few)
    if crowded.isEmpty():
        return out[0], None
    first = crowded.select("cell", "fp")
    crowded = scratch.keep(plan.start(crowded), "crowded")
    for last, depth in pairwise((plan.short, *plan.depths)):
        level = scratch.keep(mixed(plan.deeper(crowded, last, depth)), "level")
        scratch.drop(crowded)
        out.append(dealt(level.where(few), depth, plan.crowd))
        crowded = level.where(~few)
        if crowded.isEmpty():
            break
        crowded = scratch.keep(crowded, "crowded")
    else:
        out.append(dealt(crowded, plan.depths[-1], plan.crowd))
    return reduce(DataFrame.unionByName, out), first


def digest(names: list[bytes], *more: int) -> int:
    """64 bits that stand for sets and numbers."""
    return int.from_bytes(blake2b(b"".join(names) + repr(more).encode(), digest_size=8).digest(), "little", signed=True)


def alike(need: int):
    """Cell function: the sets of a region that may be linked, (cell, fp, root) with a cell for each group that pairs of different components whose sketches share ``need`` values connect.

    A group of more than ``TOKENS`` shingles is dealt out in pairs of its parts.
    """

    def run(cell: pa.RecordBatch) -> pa.RecordBatch | None:
        names, roots, sizes = (cell.column(i).to_pylist() for i in (1, 3, 4))
        once = {p: i for i, p in enumerate(names)}
        order = [once[p] for p in sorted(once)]
        x = np.frombuffer(b"".join(cell.column(2).take(pa.array(order)).to_pylist()), np.uint8).reshape(-1, COORDINATES)
        number = {r: i for i, r in enumerate(dict.fromkeys(roots[i] for i in order))}
        of = np.array([number[roots[i]] for i in order])
        i, j = np.nonzero(np.triu((agreement(x) >= need) & (of[:, None] != of[None, :]), 1))
        if not len(i):
            return None
        groups: dict[int, list[int]] = {}
        for k, top in enumerate(connected(i, j, len(order))):
            groups.setdefault(top, []).append(order[k])
        out = []
        for group in groups.values():
            if len(group) == 1:
                continue
            key = digest([names[k] for k in group])
            part = np.cumsum([sizes[k] for k in group]) // (TOKENS // 2)
            last = int(part[-1])
            for k, p in zip(group, (part - part[0]).tolist() if last else [0] * len(group)):
                met = [(min(p, q), max(p, q)) for q in range(last + 1) if q != p] if last else [(0, 0)]
                out += [(digest([], key, *m) if last else key, names[k], roots[k]) for m in met]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))], ["cell", "fp", "root"])

    return run


def linked(threshold: float):
    """Cell function: of sets (cell, fp, root, tokens), the components that links between these join: (a, b), a being the least root of those joined, b each other."""

    def run(cell: pa.RecordBatch) -> pa.RecordBatch | None:
        names, roots = cell.column(1).to_pylist(), cell.column(2).to_pylist()
        once = {p: i for i, p in enumerate(names)}
        order = [once[p] for p in sorted(once)]
        known = sorted(set(roots))
        number = {r: i for i, r in enumerate(known)}
        of = np.array([number[roots[i]] for i in order])
        sets = [np.frombuffer(cell.column(3)[i].as_buffer(), np.uint64) for i in order]
        found = []
        for lo, same in common(sets):
            total = np.array([len(s) for s in sets])
            union = total[lo : lo + len(same), None] + total[None, :] - same
            i, j = np.nonzero((same >= threshold * union - 1e-9) & (of[lo : lo + len(same), None] != of[None, :]))
            found.append((i[j > i + lo] + lo, j[j > i + lo]))
        i, j = (np.concatenate(c) for c in zip(*found))
        joined = [(top, b) for b, top in enumerate(connected(of[i], of[j], len(known))) if top != b]
        return pa.RecordBatch.from_arrays([pa.array([known[k] for k in c], pa.binary()) for c in zip(*joined)], ["a", "b"]) if joined else None

    return run


def connected(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """For each of n nodes the smallest one that the edges connect it with."""
    of = np.arange(n)
    while True:
        low = of.copy()
        np.minimum.at(low, a, of[b])
        np.minimum.at(low, b, of[a])
        low = low[low]
        if (low == of).all():
            return of.tolist()
        of = low


class Links:
    """Components of linked sets, found step by step."""

    def __init__(self, tokens: Callable[[DataFrame], DataFrame], threshold: float, scratch: Scratch):
        """``tokens`` gives the whole sets (fp, tokens) of (fp)."""
        self.tokens, self.threshold, self.scratch = tokens, threshold, scratch
        self.tested: DataFrame | None = None
        #: (node, root) of the components, None while there is none.
        self.roots: DataFrame | None = None

    def look(self, cells: DataFrame) -> None:
        """Find the links between the components that meet in these regions; groups of sets that have been compared are not again."""
        need = math.ceil((self.threshold - SLACK) * COORDINATES)  # sketches below that are not similar
        rows = cells.select("cell", "fp", "sketch", "root", "n")
        groups = by_cell(rows, "cell", alike(need), "cell long, fp binary, root binary").dropDuplicates(["cell", "fp"])
        if self.tested is not None:
            groups = groups.join(self.tested, "cell", "left_anti")
        groups = self.scratch.keep(groups, "groups")
        if groups.isEmpty():
            return
        own = groups.select("cell").distinct()
        self.tested = own if self.tested is None else self.tested.unionByName(own)
        whole = groups.join(self.tokens(groups.select("fp").distinct()), "fp").select("cell", "fp", "root", "tokens")
        new = self.scratch.keep(by_cell(whole, "cell", linked(self.threshold), "a binary, b binary").distinct(), "links")
        if new.isEmpty():
            return
        if self.roots is None:
            self.roots = self.scratch.keep(components(new, self.scratch), "roots")
            return
        # only components that the new links join change
        moved = self.scratch.keep(components(new, self.scratch).select(F.col("node").alias("_old"), F.col("root").alias("_new")), "moved")
        kept = self.roots.join(moved, F.col("root") == F.col("_old"), "left").select("node", F.coalesce("_new", "root").alias("root"))
        fresh = moved.join(self.roots.select("node"), F.col("_old") == F.col("node"), "left_anti").select(F.col("_old").alias("node"), F.col("_new").alias("root"))
        self.roots = self.scratch.keep(kept.unionByName(fresh), "roots")

    def again(self, cells: DataFrame) -> DataFrame:
        """The regions that still hold several components."""
        return self.scratch.keep(mixed(with_roots(cells.drop("root"), self.roots)).drop("size", "others", "main"), "cells")


def complete(links: Links, met: list[DataFrame], sketches: DataFrame, plan: Plan, base: int, scratch: Scratch) -> None:
    """Find the links between the sets of first regions (tree, cell, fp, size), one table after the other; ``base`` trees have been grown."""
    cells, crowds, done = None, [], base
    for part in met:
        some, crowd = regions(part, sketches, links.roots, scratch, plan)
        links.look(some)
        cells = some if cells is None else cells.unionByName(some)
        crowds += [crowd] if crowd is not None else []
    while crowds:
        rest = links.again(cells)
        needs = reduce(lambda c, d: c.when(F.col("depth") == d, F.lit(plan.trees(d))), plan.depths, F.when(F.col("depth") == plan.short, F.lit(0)))
        high = rest.groupBy("fp").agg(F.max(needs).alias("high")).where(F.col("high") > done)
        if high.isEmpty():
            return
        # of a pair that the crowd kept apart both have to be in the further trees
        crowd = reduce(DataFrame.unionByName, crowds)
        around = crowd.join(high, "fp").groupBy("cell").agg(F.max("high").alias("high"))
        open_ = crowd.join(around, "cell").groupBy("fp").agg(F.max("high").alias("high"))
        open_ = scratch.keep(sketches.join(open_, "fp").withColumn("low", F.lit(done)), "open")
        cells, crowd = regions(neighbours(open_, scratch, plan), sketches, links.roots, scratch, plan)
        links.look(cells)
        crowds += [crowd] if crowd is not None else []
        done = open_.agg(F.max("high")).first()[0]
