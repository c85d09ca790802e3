"""Chosen-path similarity join of word-shingle sets.

Every distinct set is embedded as 128 min-hash values. A run grows a random tree: each node samples
coordinates, 1/threshold on average, and a set follows the branches that its own values name, so
similar sets share paths and others part. The paths of depth 3 are buckets; those that are still large are
dealt into blocks. Runs repeat until a pair at the threshold is met with the wanted probability. Of
buckets with the same sets one is looked at.

In the blocks of the largest buckets all sketches are compared, and each set is joined to its most similar
neighbours by a spanning forest, so the edges grow with the sets and not with their pairs. The most
central set of each of a block's trees stands for it; those of the largest trees go to all blocks, where each set is
joined to the nearest. Every edge is checked on the whole sets: a link is a true Jaccard similarity of at least the threshold.

That joins large groups of copies at small cost, but leaves sets apart. So in all buckets that hold several
components, the sets whose sketches agree are compared as a whole, each with all of other components; buckets of very many
follow their paths on first, and their sets get as many further trees as their depth wants. Classes are what the links
connect, and all links of a class are counted, in pairs of blocks of its sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType
from pyspark.sql.window import Window

from ..storage import Scratch
from .cells import by_cell
from .graph import components
from .joins import quoted, sized_join
from .memory import give_back
from .pairs import COORDINATES, agreement, checked, common
from .regions import TOKENS, Links, complete, mixture
from .words import SHINGLE, mix, parts, shingle_sets

THRESHOLD = 0.8
RECALL = 0.995
DEPTH = 3
#: Runs are counted as if a pair in a large bucket had to meet again in one of so many trees below it.
SUBTREES = 3
#: Sets of a bucket that are compared at once, about.
BLOCK = 256
#: Blocks of a bucket from which on it is large.
LARGE = 16
#: A large bucket is dealt into blocks in one of so many ways, so that sets that meet again make the same edges again.
DEALS = 3
#: Sets of a block when a class's links are counted.
MEMBERS = 1024
#: Spanning forests of a block, and the share of equal values from which an edge needs no other beside it.
FORESTS, SURE = 3, 0.9
#: Sketches this far below the threshold are not similar (over four standard deviations).
SLACK = 0.15
#: Roots of the trees that crowded sets get are numbered from here.
_FURTHER = 1 << 20
_LANES = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """The low 8 bits of 128 min-hash values of a non-empty set."""
    best = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(tokens), 2048):
        best = np.minimum(best, (tokens[None, i : i + 2048] * _LANES[:, None]).min(axis=1))
    return (mix(best) & np.uint64(0xFF)).astype(np.uint8)


def fingerprint(tokens: np.ndarray) -> bytes:
    """16 bytes that stand for a set."""
    import hashlib

    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def share_of_runs(threshold: float, depth: int, share: float | None = None) -> float:
    """The probability that one run brings a pair at the threshold to a common path of ``depth``, or one that shares another part of its values."""
    extra = 1 / threshold - 1
    share = threshold if share is None else share
    lost = 0.0
    for _ in range(depth):
        one = 1 - share + share * lost
        lost = (1 - extra) * one + extra * one * one
    return 1 - lost


def share_met(threshold: float, runs: int) -> float:
    """The probability that a pair at the threshold is met, where all its buckets are large."""
    once = share_of_runs(threshold, DEPTH)
    return 1 - (1 - once * (1 - (1 - once) ** SUBTREES)) ** runs


def runs_for(threshold: float, recall: float) -> int:
    """Runs until a pair at the threshold is met with the probability ``recall``, however large its buckets are."""
    return next(n for n in range(1, 10_000) if share_met(threshold, n) >= recall)


def grow(x: np.ndarray, row: np.ndarray, node: np.ndarray, levels: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Follow the tree from ``node`` for some levels: rows and the nodes that they reach."""
    extra = np.uint64(round((1 / threshold - 1) * 1_000_000))
    for _ in range(levels):
        two = mix(node + np.uint64(1)) % np.uint64(1_000_000) < extra
        kids, rows = [], []
        for j, who in enumerate((slice(None), two)):
            p, r = node[who], row[who]
            at = (mix(p + np.uint64(2 + j)) % np.uint64(x.shape[1])).astype(np.int64)
            kids.append(mix(p * np.uint64(0x9FB21C651E98DF25) + (at.astype(np.uint64) << np.uint64(16)) + x[r, at].astype(np.uint64)))
            rows.append(r)
        node, row = np.concatenate(kids), np.concatenate(rows)
    return row, node


def signatures(docs: DataFrame, k: int = SHINGLE, tokens: bool = False) -> DataFrame:
    """doc_id, fp, sketch and n, the size of the set, of every document; with ``tokens``, fp and tokens of distinct sets per task.

    fp and sketch are null where a text has no word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for lo, data, offs in parts(batch.column(1)):
                sets = shingle_sets(data, offs, k)
                prints = [fingerprint(s) if len(s) else None for s in sets]
                if tokens:
                    new = []
                    for p, s in zip(prints, sets):
                        if p is not None and p not in seen:
                            seen.add(p)
                            new.append((p, s.tobytes()))
                    if new:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*new)], ["fp", "tokens"])
                else:
                    marks = [sketch(s).tobytes() if len(s) else None for s in sets]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(lo, len(sets)), pa.array(prints, pa.binary()), pa.array(marks, pa.binary()), pa.array([len(s) for s in sets], pa.int64())],
                        ["doc_id", "fp", "sketch", "n"],
                    )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "fp binary, tokens binary" if tokens else "doc_id long, fp binary, sketch binary, n long"
    )


def paths(sets: DataFrame, threshold: float, trees: int) -> DataFrame:
    """(path, fp): the nodes that sets (fp, sketch) reach in ``trees`` trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                n = part.num_rows
                x = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(n, COORDINATES)
                root = np.repeat(mix(np.arange(1000, 1000 + trees, dtype=np.uint64)), n)
                row, node = grow(x, np.tile(np.arange(n), trees), root, DEPTH, threshold)
                order = np.lexsort((node, row))
                row, node = row[order], node[order]
                new = np.concatenate([[True], (row[1:] != row[:-1]) | (node[1:] != node[:-1])])
                yield pa.RecordBatch.from_arrays([pa.array(node[new].view(np.int64)), part.column(0).take(pa.array(row[new]))], ["path", "fp"])
        give_back()

    return sets.select("fp", "sketch").mapInArrow(run, "path long, fp binary")


class ChosenPaths:
    """Trees whose regions are the sets that reach a node; a crowded node's sets follow the tree on."""

    short, depths, crowd, whole = DEPTH, (4, 6, 8, 10, 12, 16), 2 * BLOCK, LARGE // 2

    def __init__(self, threshold: float, recall: float):
        self.threshold, self.recall = threshold, recall

    def first(self, sets: DataFrame) -> DataFrame:
        threshold = self.threshold

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, COORDINATES)
                low, high = (batch.column(i).to_numpy() for i in (2, 3))
                for tree in range(int(low.min()), int(high.max())):
                    at = np.flatnonzero((low <= tree) & (tree < high))
                    root = mix(np.array([_FURTHER + tree], np.uint64))
                    row, node = grow(x, at, np.repeat(root, len(at)), DEPTH, threshold)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), tree, np.int32)), pa.array(node.view(np.int64)), batch.column(0).take(pa.array(row))],
                        ["tree", "cell", "fp"])
            give_back()

        return sets.select("fp", "sketch", "low", "high").mapInArrow(run, "tree int, cell long, fp binary")

    def start(self, crowded: DataFrame) -> DataFrame:
        return crowded.select("tree", "cell", "fp", "sketch", "root", "n")

    def deeper(self, crowded: DataFrame, last: int, depth: int) -> DataFrame:
        threshold = self.threshold

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                    n = part.num_rows
                    x = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(n, COORDINATES)
                    row, node = grow(x, np.arange(n), part.column(1).to_numpy().view(np.uint64), depth - last, threshold)
                    took = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([took.column(0), pa.array(node.view(np.int64)), *took.columns[2:]], part.schema.names)
            give_back()

        return self.start(crowded).mapInArrow(run, "tree int, cell long, fp binary, sketch binary, root binary, n long")

    def trees(self, depth: int) -> int:
        return mixture(self.threshold, lambda k: share_of_runs(self.threshold, depth, k / COORDINATES), self.recall)


def buckets(scratch: Scratch, classes: DataFrame, threshold: float, runs: int) -> DataFrame:
    """(path, fp, size) of all buckets of two sets or more, each set of buckets with the same members once."""

    reached = scratch.keep(paths(classes, threshold, runs), "paths")
    held = reached.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("fp")).alias("members")).where("size > 1")
    one = held.groupBy("size", "members").agg(F.min("path").alias("path")).select("path", "size")
    met = scratch.keep(reached.join(one, "path").select("path", "fp", "size"), "met")
    scratch.drop(reached)
    return met


def spanning(same: np.ndarray, need: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest with the largest agreements, all of ``need`` or more; trees begin at their first set."""
    n = len(same)
    left, best, came, edges = np.ones(n, bool), np.zeros(n, np.int16), np.full(n, -1), []
    for _ in range(n):
        i = int(np.argmax(np.where(left, best, -1)))
        if best[i] >= need:
            edges.append((int(came[i]), i))
        left[i] = False
        closer = left & (same[i] > best)
        best[closer], came[closer] = same[i][closer], i
    return edges


def trees(n: int, edges: list[tuple[int, int]]) -> np.ndarray:
    """The first node of each node's tree."""
    of = np.arange(n)
    for a, b in edges:
        of[of == max(of[a], of[b])] = min(of[a], of[b])
    return of


def block_edges(x: np.ndarray, need: int, sure: int, forests: int = FORESTS) -> tuple[list[tuple[int, int]], int, np.ndarray]:
    """The edges of a block's spanning forests, how many of them are the first's, and the centre of each set's tree in that.

    A tree's centre is the set that agrees most with all of the tree.

    Sets that edges of ``sure`` or more connect count as one in the further forests, which take edges
    that no forest has had, so a doubtful edge has others beside it.
    """
    same = agreement(x)
    edges = first = spanning(same, need)
    of = trees(len(x), first)
    total = np.where(of[:, None] == of[None, :], same, 0).sum(axis=1, dtype=np.int64)
    order = np.lexsort((np.arange(len(x)), -total, of))
    begin = np.concatenate([[True], of[order][1:] != of[order][:-1]])
    centre = order[begin][np.searchsorted(of[order][begin], of)]
    known = trees(len(x), [e for e in first if same[e] >= sure])
    for _ in range(forests - 1):
        for e in edges:
            same[e] = same[e[::-1]] = 0
        same[known[:, None] == known[None, :]] = 0
        more = spanning(same, need)
        if not more:
            break
        edges = edges + more
    return edges, len(first), centre


_ELECTED = "a binary, b binary, path long, sketch binary, weight long"


def elected(least: float):
    """Cell function: edges (a, b) of a spanning forest of a cell's sets; of a block of a large bucket also its centres, as (a, path, sketch, weight), the weight being the tree's sets."""
    need, sure = math.ceil(least * COORDINATES), math.ceil(SURE * COORDINATES)

    def run(part: pa.RecordBatch) -> pa.RecordBatch | None:
        names = part.column(0).to_pylist()
        once = {p: i for i, p in enumerate(names)}
        part = part.take(pa.array([once[p] for p in sorted(once)]))
        fps, path = part.column(0), part.column(2)[0].as_py()
        x = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, COORDINATES)
        edges, _, centre = block_edges(x, need, sure, 1)
        kept, size = np.unique(centre, return_counts=True) if part.column(3)[0].as_py() > 1 else (np.zeros(0, np.int64),) * 2
        if not edges and not len(kept):
            return None
        n = len(edges)
        a = pa.array([*[e[0] for e in edges], *kept.tolist()], pa.int64())
        b = pa.array([*[e[1] for e in edges], *[None] * len(kept)], pa.int64())
        sketches = pa.array([None] * n + [x[i].tobytes() for i in kept.tolist()], pa.binary())
        weights = pa.array([None] * n + size.tolist(), pa.int64())
        return pa.RecordBatch.from_arrays([fps.take(a), fps.take(b), pa.array([path] * len(a), pa.int64()), sketches, weights],
            ["a", "b", "path", "sketch", "weight"])

    return run


def attached(least: float):
    """Cell function: an edge (a, b) from each set of a block to the nearest of the bucket's leaders, if it is near enough."""
    need = math.ceil(least * COORDINATES)

    def run(part: pa.RecordBatch) -> pa.RecordBatch | None:
        lead = part.column(2).to_numpy(zero_copy_only=False)
        x = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, COORDINATES)
        names = part.column(0).to_pylist()
        leaders, others = sorted(np.flatnonzero(lead).tolist(), key=names.__getitem__), np.flatnonzero(~lead)
        if not leaders or not len(others):
            return None
        out = []
        for i in others.tolist():
            same = (x[leaders] == x[i]).sum(axis=1)
            same[[j for j, k in enumerate(leaders) if names[k] == names[i]]] = 0
            j = int(np.argmax(same))
            if same[j] >= need:
                out.append((names[i], names[leaders[j]]))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], ["a", "b"]) if out else None

    return run


def candidates(scratch: Scratch, met: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: pairs of sets of buckets (path, fp, size) whose sketches say that they may be similar, few for each set."""
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    deal = F.when(blocks > 1, F.pmod(F.xxhash64("path"), F.lit(DEALS)))
    mine = F.pmod(F.xxhash64("fp", deal), blocks)
    cells = met.join(classes.select("fp", "sketch"), "fp")
    cells = cells.select("fp", "sketch", "path", blocks.alias("blocks"), F.xxhash64("path", mine).alias("cell"))
    got = scratch.keep(by_cell(cells, "cell", elected(threshold - SLACK), _ELECTED), "edges")
    edges = got.where("b is not null").select("a", "b")
    centres = got.where("b is null").select("path", F.col("a").alias("fp"), "sketch", "weight")
    if not centres.isEmpty():
        # a bucket's leaders are as many as a block at most, so what its blocks get of them is about as much as they hold
        rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("weight"), "fp"))
        leaders = centres.withColumn("_rank", rank).where(F.col("_rank") <= BLOCK).drop("_rank", "weight")
        large = cells.where("blocks > 1")
        spread = leaders.join(large.select("path", "cell").distinct(), "path").select("fp", "sketch", F.lit(True).alias("lead"), "cell")
        both = spread.unionByName(large.select("fp", "sketch", F.lit(False).alias("lead"), "cell"))
        edges = edges.unionByName(by_cell(both, "cell", attached(threshold - SLACK), "a binary, b binary"))
    return scratch.keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")


def counted(threshold: float):
    """Cell function: (fp, links) of sets (cell, fp, copies, block, tokens): the documents of the sets that each one is similar to, in a cell of two blocks those of the other block."""

    def run(cell: pa.RecordBatch) -> pa.RecordBatch | None:
        copies, block = (cell.column(i).to_numpy() for i in (2, 3))
        sets = [np.frombuffer(t.as_buffer(), np.uint64) for t in cell.column(4)]
        size, out = np.array([len(t) for t in sets]), []
        for lo, same in common(sets):
            hi = lo + len(same)
            near = same >= threshold * (size[lo:hi, None] + size[None, :] - same) - 1e-9
            if block.min() < block.max():
                near &= block[lo:hi, None] != block[None, :]
            near[np.arange(hi - lo), np.arange(lo, hi)] = False
            out.append((near * copies[None, :]).sum(axis=1))
        return pa.RecordBatch.from_arrays([cell.column(1), pa.array(np.concatenate(out))], ["fp", "links"])

    return run


def link_counts(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(fp, links) of all sets (fp, root, copies, n) of classes: every two sets (fp, tokens) of a class are compared, in pairs of blocks."""
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(MEMBERS)), F.ceil(F.sum("n") / F.lit(TOKENS // 2))).cast("int")
    held = members.groupBy(F.col("root").alias("_root")).agg(blocks.alias("blocks")).where("blocks > 1")
    rows = members.join(held, F.col("root") == F.col("_root"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).drop("_root")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64("root", F.least("block", "_other"), F.greatest("block", "_other"))
    rows = rows.select(cell.alias("cell"), "fp", "copies", "block").join(sets, "fp").select("cell", "fp", "copies", "block", "tokens")
    return by_cell(rows, "cell", counted(threshold), "fp binary, links long").groupBy("fp").agg(F.sum("links").alias("links"))


def link_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, k: int = SHINGLE, counts: bool = True) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, fp) and the classes of equal sets (fp, class_id, first_id, copies, links).

    The second table has the classes of several documents or with links; class_id is the smallest
    doc_id of the class's connected component, links the number of documents in the other classes that
    are similar to it, null without ``counts``. All that is in between stays on shared storage.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    sig = scratch.keep(signatures(docs, k), "signatures")
    classes = scratch.keep(sig.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias(
                "copies"), F.any_value("sketch").alias("sketch"), F.any_value("n").alias("n")), "classes")
    met = buckets(scratch, classes, threshold, runs_for(threshold, recall))

    def tokens(fps: DataFrame) -> DataFrame:
        ids = scratch.keep(fps.join(classes, "fp").select("fp", F.col("first_id").alias("_id")), "ids")
        rows = sized_join(docs.select("doc_id", "text"), ids.select("_id").distinct(), F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left_semi")
        return sized_join(signatures(rows, k, tokens=True), ids.select("fp"), ["fp"], "left_semi").dropDuplicates(["fp"])

    links = Links(tokens, threshold, scratch)
    large = met.where(F.col("size") > BLOCK * LARGE)
    if not large.isEmpty():
        pairs = candidates(scratch, large, classes, threshold)
        ends = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
        sets = scratch.keep(tokens(ends), "sets")
        links.roots = scratch.keep(components(scratch.keep(checked(pairs, sets, threshold), "links"), scratch), "roots")
        scratch.drop(sets)
    # what that has left apart: all sets of all buckets with several components
    first = met.select(F.lit(0).alias("tree"), F.col("path").alias("cell"), "fp", "size")
    complete(links, [first], classes.select("fp", "sketch", "n"), ChosenPaths(threshold, recall), 0, scratch)
    if links.roots is None:
        members = classes.select(F.col("fp").alias("node"), F.col("fp").alias("root")).limit(0)
    else:
        members = links.roots
    several = classes.select("fp", "first_id", "copies", "n").join(members.select(F.col("node").alias("fp"), "root"), "fp", "left")
    several = scratch.keep(several.where("copies > 1 or root is not null").withColumn("linked", F.col("root").isNotNull()).withColumn("root", F.coalesce("root", "fp")), "several")
    least = several.groupBy("root").agg(F.min("first_id").alias("class_id"))
    result = several.join(least, "root").select("fp", "class_id", "first_id", "copies")
    if counts:
        linked = several.where("linked").select("fp", "root", "copies", "n")
        result = result.join(link_counts(linked, tokens(linked.select("fp")), threshold), "fp", "left").withColumn("links", F.coalesce("links", F.lit(0)).cast("long"))
    else:
        result = result.withColumn("links", F.lit(None).cast("long"))
    return sig.select("doc_id", "fp"), scratch.keep(result, "classes")


def join_documents(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id and n_links of every document, one row each.

    ``class_id`` is the smallest doc_id that similar documents reach one another by (a document's own
    id if it has none). ``n_links`` is the number of other documents that are similar to it: those with the same
    set of 5-word shingles, and those of all sets of its class with a Jaccard similarity of at least ``threshold``. Texts of
    1 to 4 words are one shingle; texts without words (null, empty) are similar to nothing. Documents
    with a null id take part; their class_id is null if no other id is in the class.
    """
    rows, classes = link_classes(docs, threshold, recall)
    out = sized_join(rows, classes, ["fp"], "left")
    return out.select(
        "doc_id",
        F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Documents with one left of each class: the row with the smallest doc_id (nulls last).

    Classes are those of ``join_documents``. Rows that agree in id and shingle set, so that the
    smallest id doesn't tell them apart, are reduced to one of them.
    """
    rows, classes = link_classes(docs, threshold, recall, counts=False)
    scratch = Scratch(docs.sparkSession, "keep-one")
    member = sized_join(rows, classes, ["fp"])
    # the first class of a component keeps its smallest id; every other (class, id) goes
    best = classes.where(F.col("first_id").eqNullSafe(F.col("class_id"))).groupBy("class_id").agg(F.min("fp").alias("best"))
    kept = best.select(F.col("class_id").alias("_class"), "best")
    gone = member.join(kept, F.col("class_id").eqNullSafe(F.col("_class")))
    stays = F.col("fp").eqNullSafe(F.col("best")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    ids = gone.select("doc_id", "fp", stays.alias("stays")).groupBy("doc_id", "fp", "stays").agg(F.count(F.lit(1)).alias("rows"))
    ids = scratch.keep(ids.where("not stays or rows > 1"), "ids")
    return _apply(docs, ids)


def _apply(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents without the rows (doc_id, fp) that go; of several that stay, one."""
    columns = docs.columns

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.schema.get_field_index("_text")
            got: list[bytes | None] = []
            for _, data, offs in parts(batch.column(text)):
                got += [fingerprint(s) if len(s) else None for s in shingle_sets(data, offs)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:text], pa.array(got, pa.binary())], [*batch.schema.names[:text], "_fp"])

    named = docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(columns)])
    at = {c: f"c{i}" for i, c in enumerate(columns)}
    id_ = F.col(at["doc_id"]).cast("long")
    touched = ids.select(F.col("doc_id").alias("_id")).distinct()
    marked = sized_join(named.withColumn("_row", id_), touched.withColumn("_hit", F.lit(True)), F.col("_row").eqNullSafe(F.col("_id")),
        "left").drop("_id", "_row")
    clean = marked.where("_hit is null").drop("_hit")
    back = [F.col(f"c{i}").alias(c) for i, c in enumerate(columns)]
    hit = marked.where("_hit").drop("_hit").withColumn("_text", F.col(at["text"]).cast("string"))
    hit = hit.mapInArrow(prints, StructType([*named.schema.fields, StructField("_fp", BinaryType())]))
    rule = ids.select(F.col("doc_id").alias("_id"), F.col("fp").alias("_of"), "stays")
    hit = sized_join(hit, rule, F.col(at["doc_id"]).cast("long").eqNullSafe(F.col("_id")) & F.col("_fp").eqNullSafe(F.col("_of")), "left")
    alone = hit.where("stays is null")
    one = hit.where("stays").dropDuplicates(["_id", "_of"])
    return clean.select(*back).unionByName(alone.select(*back)).unionByName(one.select(*back))
