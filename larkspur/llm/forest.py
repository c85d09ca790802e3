"""Near-duplicate documents by a forest of sorted min-hash signatures.

A distinct set of word shingles is sketched by 128 min-hash values. A tree puts the sketches in the order
of some of their values, in a sequence of its own; sets whose signatures share a long prefix are
neighbours there. A region is all sets with a common prefix. Regions begin at eight values and grow
deeper one by one where they are crowded, until each has few sets; what still agrees on 32 values is
dealt into blocks that all meet. Within a region all sketches are compared, and sets that may be similar on their whole shingles.

Similar sets share d values of a tree with probability s**d, so a region's depth tells how many trees
find a pair with the wanted probability. All sets have the trees that the first depth needs; sets
whose neighbourhood stays crowded, and those that they might have met, get the more that theirs needs. Sets that
are known to be linked are not compared again: a region is crowded by the sets outside its largest
component only, which meet all of that component, dealt out in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch
from .jaccard import fingerprint, sketch
from .joins import sized_join
from .memory import give_back
from .pairs import COORDINATES
from .regions import Links, complete, mixture, neighbours
from .words import mix, parts, shingle_sets

THRESHOLD = 0.85
SHINGLE = 3
RECALL = 0.99
#: Values of a tree's order: the shortest prefix of a region, the longest, and the step between.
SHORT, LONG, STEP = 8, 32, 4
#: Trees whose links are found before the others' regions are looked at.
FIRST_TREES = 4
#: Sets that are compared in a region. Many, since the trees that a region wants grow fast with its depth.
CROWD = 1024
#: Blocks of so many sets whose pairs are all compared before a region is split.
WHOLE = 2


@cache
def trees_for(depth: int, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Trees until a pair at the threshold shares a prefix of ``depth`` values in one of them with the probability ``recall``; a tree's values are drawn without replacement."""
    return mixture(threshold, lambda k: math.comb(k, depth) / math.comb(COORDINATES, depth), recall)


def sequence(tree: int) -> np.ndarray:
    """The values that a tree sorts by, in their order."""
    return np.argsort(mix(np.arange(COORDINATES, dtype=np.uint64) + np.uint64((tree + 1) * COORDINATES)), kind="stable")[:LONG]


def folded(column: pa.Array) -> pa.Array:
    """Texts as bytes with A-Z in lower case."""
    column = column.cast(pa.binary())
    if not len(column):
        return column
    _, offsets, data = column.buffers()
    raw = np.frombuffer(data, np.uint8).copy() if data is not None else np.zeros(0, np.uint8)
    raw[(raw >= 65) & (raw <= 90)] |= 32
    return pa.Array.from_buffers(pa.binary(), len(column), [column.buffers()[0], offsets, pa.py_buffer(raw)], column.null_count, column.offset)


def signatures(docs: DataFrame, k: int, tokens: bool = False) -> DataFrame:
    """doc_id, n_shingles, fp and sketch of every document; with ``tokens``, fp and tokens of distinct sets per task.

    fp and sketch are null where a text has no word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for lo, data, offs in parts(folded(batch.column(1))):
                sets = shingle_sets(data, offs, k)
                prints = [fingerprint(s) if len(s) else None for s in sets]
                if not tokens:
                    marks = [sketch(s).tobytes() if len(s) else None for s in sets]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(
                        prints, pa.binary()), pa.array(marks, pa.binary())], ["doc_id", "n_shingles", "fp", "sketch"])
                    continue
                new = [(p, s.tobytes()) for p, s in zip(prints, sets) if p is not None and p not in seen]
                seen.update(p for p, _ in new)
                if new:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*new)], ["fp", "tokens"])
        give_back()

    schema = "fp binary, tokens binary" if tokens else "doc_id long, n_shingles long, fp binary, sketch binary"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def orders(sets: DataFrame, whole: bool = False) -> DataFrame:
    """(tree, cell, fp) of sets (fp, sketch, low, high) in trees low to high - 1; cell stands for the tree and the first values of its order.

    With ``whole``, sets (tree, fp, sketch, root, n) keep their columns and get ``key``, all values of the tree's order.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, COORDINATES)
            low, high = (batch.column(i).to_numpy() for i in (2, 3))
            for tree in range(int(low.min()), int(high.max())):
                at = np.flatnonzero((low <= tree) & (tree < high))
                prefix = np.ascontiguousarray(x[at][:, sequence(tree)[:SHORT]]).view(np.uint64).reshape(-1)
                cell = mix(prefix ^ mix(np.array([tree + 1], np.uint64))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), tree, np.int32)), pa.array(cell), batch.column(0).take(pa.array(at))],
                    ["tree", "cell", "fp"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, COORDINATES)
                tree = batch.column(0).to_numpy()
                of = {t: sequence(t) for t in np.unique(tree).tolist()}
                key = np.take_along_axis(x, np.stack([of[t] for t in tree.tolist()]), axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k.tobytes() for k in key], pa.binary())], [*batch.schema.names, "key"])

    if whole:
        return sets.select("tree", "fp", "sketch", "root", "n").mapInArrow(keys, "tree int, fp binary, sketch binary, root binary, n long, key binary")
    return sets.select("fp", "sketch", "low", "high").mapInArrow(first, "tree int, cell long, fp binary")


class SortedOrders:
    """Trees whose regions are the sets with a common prefix in a tree's order."""

    short, depths, crowd, whole = SHORT, tuple(range(SHORT + STEP, LONG + 1, STEP)), CROWD, WHOLE

    def __init__(self, threshold: float, recall: float):
        self.threshold, self.recall = threshold, recall

    def first(self, sets: DataFrame) -> DataFrame:
        return orders(sets)

    def start(self, crowded: DataFrame) -> DataFrame:
        return orders(crowded, whole=True)

    def deeper(self, crowded: DataFrame, last: int, depth: int) -> DataFrame:
        return crowded.withColumn("cell", F.xxhash64("tree", F.substring("key", 1, depth)))

    def trees(self, depth: int) -> int:
        return trees_for(depth, self.threshold, self.recall)


def link_sets(docs: DataFrame, threshold: float, recall: float, k: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Documents (doc_id, n_shingles, fp), distinct sets (fp, first_id, copies), and the components (node, root) of linked sets, None without a link."""
    sig = scratch.keep(signatures(docs, k), "signatures")
    classes = sig.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.any_value(
            "sketch").alias("sketch"), F.any_value("n_shingles").alias("n"))
    classes = scratch.keep(classes, "classes")
    plan, base = SortedOrders(threshold, recall), trees_for(SHORT, threshold, recall)
    met = neighbours(classes.select("fp", "sketch", F.lit(0).alias("low"), F.lit(base).alias("high")), scratch, plan)
    near = scratch.keep(classes.join(met.select("fp").distinct(), "fp").select("fp", "first_id", "sketch", "n"), "near")
    wanted = near.select(F.col("first_id").alias("_id")).distinct()
    texts = sized_join(docs.select("doc_id", "text"), wanted, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left_semi")
    sets = scratch.keep(sized_join(signatures(texts, k, tokens=True), near.select("fp"), ["fp"], "left_semi"), "sets")
    links = Links(lambda fps: sized_join(sets, fps, ["fp"], "left_semi"), threshold, scratch)
    early = F.col("tree") < FIRST_TREES
    complete(links, [met.where(early), met.where(~early)], near.select("fp", "sketch", "n"), plan, base, scratch)
    return sig.select("doc_id", "n_shingles", "fp"), classes.select("fp", "first_id", "copies"), links.roots


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document, one row each.

    Linked are documents whose sets of ``k``-word shingles, A-Z in lower case, have a Jaccard similarity of at
    least ``threshold``, checked on the whole sets; a text of fewer words is one shingle. component_id is
    the smallest doc_id that links reach, and kept tells whether it is the document's own. Texts without
    words (null, empty) are linked with nothing, not even one another. Documents with a null id take
    part; their component_id is null if no other id is in the component. Rows that share an id are documents
    of their own, and share ``kept`` if they are in one component.
    """
    scratch = Scratch(docs.sparkSession, "forest")
    rows, classes, roots = link_sets(docs, threshold, recall, k, scratch)
    if roots is None:
        several = classes.where("copies > 1").select("fp", F.col("first_id").alias("component_id"))
    else:
        linked = classes.join(roots.select(F.col("node").alias("_node"), "root"), F.col("fp") == F.col("_node"), "left")
        linked = scratch.keep(linked.where("copies > 1 or root is not null").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "linked")
        least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
        several = scratch.keep(linked.join(least, "root").select("fp", "component_id"), "several")
    several = several.withColumn("_several", F.lit(True))
    out = sized_join(rows, several, ["fp"], "left")
    own = F.when(F.col("_several").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
