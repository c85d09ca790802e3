"""A prefix trie of conversations, encoded by preorder intervals.

Every prefix of a conversation is a node. A prefix is known by its length and the XOR of hashes of its
turns with their places (128 bits), a running value, so long conversations cost no more a turn than
short ones. Distinct conversations are ranked lexicographically by blocks of 64 turns, whose ranks are
the letters of the next level. A node first occurs in the smallest rank of its members; nodes in the
order of that rank and their depth are in preorder, and a node's subtree ends with the last node that
the largest rank of its members brings. Leaves and savings of a subtree are differences of prefix sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch
from .joins import sized_join
from .mixing import n_words
from .scan import running

#: Turns, or ranks of blocks, that make one block of the next level.
BLOCK = 64
#: Decimal ids of an end list that one row holds, about, in characters.
CHUNK = 1 << 16


def numbered(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """conv, pos (from 1), sym and words of every turn with a conv_id.

    Turns are in the order of ``turn``, null first, and of ``sym``, the MD5 of role and text, where turns share a number.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    sym = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), sym.alias("sym"),
        n_words(text).alias("words"), F.lit(1).cast("long").alias("one")).where("conv is not null")
    placed = running(scratch.keep(rows, "turns"), [F.asc_nulls_first("turn"), "sym"], scratch, sums=("one",), segment="conv")
    return placed.select("conv", F.col("one_run").alias("pos"), "sym", "words")


def grafted(turns: DataFrame, scratch: Scratch, family: int = 20, most: int = 3) -> DataFrame:
    """conv, d, sym and words of rebuilt conversations, a textless row of depth 0 for each.

    Conversation c begins with the first h = crc32(c) % (most + 1) turns of c - c % family and goes on
    with its own turns after its first h.
    """
    h = lambda c: F.crc32(c.cast("string")) % F.lit(most + 1)
    size = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    size = scratch.keep(size.withColumn("base", F.col("conv") - F.col("conv") % family), "sizes")
    heads_of = size.select(F.col("conv").alias("_base"), F.col("n").alias("_n"))
    taken = F.least(h(F.col("conv")), F.coalesce("_n", F.lit(0)))
    graft = size.join(heads_of, F.col("base") == F.col("_base"), "left").select("conv", "base", taken.alias("taken"))
    graft = scratch.keep(graft, "grafts")
    heads = turns.where(F.col("pos") <= most).withColumnRenamed("conv", "_of")
    heads = graft.join(heads, (F.col("base") == F.col("_of")) & (F.col("pos") <= F.col("taken"))).select("conv", F.col("pos").alias("d"), "sym", "words")
    short = graft.where(F.col("taken") < h(F.col("conv"))).select(F.col("conv").alias("_c"), "taken")
    own = turns.withColumn("h", h(F.col("conv"))).where("pos > h")
    own = sized_join(own, short, F.col("conv") == F.col("_c"), "left")
    own = own.select("conv", (F.col("pos") - F.col("h") + F.coalesce("taken", F.col("h"))).alias("d"), "sym", "words")
    root = graft.select("conv", F.lit(0).cast("long").alias("d"), F.lit("").alias("sym"), F.lit(0).cast("long").alias("words"))
    return scratch.keep(root.unionByName(heads).unionByName(own), "steps")


def ranked(steps: DataFrame, scratch: Scratch) -> DataFrame:
    """conv and its rank: equal for equal sequences, else in their lexicographic order (of ``sym``), a prefix first."""

    def blocks(rows: DataFrame, place: str, letter: Column) -> DataFrame:
        held = F.sort_array(F.collect_list(F.struct(F.col(place).alias("at"), letter.alias("s"))))
        return rows.groupBy("conv", F.floor(F.col(place) / BLOCK).alias("b")).agg(F.array_join(F.transform(held, lambda x: x["s"]), "").alias("key"))

    items = scratch.keep(blocks(steps, "d", F.col("sym")), "blocks")
    while True:
        keys = scratch.keep(items.select("key").distinct().withColumn("one", F.lit(1).cast("long")), "keys")
        rank = running(keys, ["key"], scratch, sums=("one",)).select("key", F.col("one_run").alias("rank"))
        levelled = scratch.keep(items.join(rank, "key").select("conv", "b", "rank"), "ranks")
        scratch.drop(items, keys)
        if not levelled.agg(F.max("b")).first()[0]:
            return levelled.select("conv", "rank")
        items = scratch.keep(blocks(levelled, "b", F.lpad(F.hex("rank"), 16, "0")), "blocks")
        scratch.drop(levelled)


def id_digests(ends: DataFrame) -> DataFrame:
    """rank and sha, the SHA-256 of the decimal conv ids of each rank in ascending order, joined by commas.

    The ids are sorted by ranges and written out as pieces of 64 KB; the pieces of a rank then pass
    through one digest, which is sequential by nature.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([held[0]], pa.int64()), pa.array([",".join(map(str, held))])], ["rank", "low", "ids"])

        for batch in batches:
            out = []
            for rank, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (rank != now or size >= CHUNK):
                    out.append(made())
                    held, size = [], 0
                now = rank
                held.append(conv)
                size += len(str(conv)) + 1
            yield from pa.Table.from_batches(out).combine_chunks().to_batches() if out else ()
        if held:
            yield made()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            ranks, shas = [], []
            for rank, ids in zip(batch.column(0).to_pylist(), batch.column(2)):
                if rank == now:
                    sha.update(b",")
                else:
                    if sha is not None:
                        ranks.append(now)
                        shas.append(sha.hexdigest())
                    now, sha = rank, hashlib.sha256()
                sha.update(ids.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(ranks, pa.int64()), pa.array(shas, pa.string())], ["rank", "sha"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([sha.hexdigest()])], ["rank", "sha"])

    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ends.select("rank", "conv").repartitionByRange(n, "rank", "conv").sortWithinPartitions("rank", "conv")
    cut = ordered.mapInArrow(pieces, "rank long, low long, ids string")
    return cut.repartition("rank").sortWithinPartitions("rank", "low").mapInArrow(digests, "rank long, sha string")


def prefix_trie(steps: DataFrame, scratch: Scratch) -> DataFrame:
    """A row for each distinct prefix of the sequences ``steps`` (conv, d from 0, sym, words); depth 0 is the root.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256, and the
    node's place in preorder with that of the last node of its subtree (preorder, subtree_end, both from 1).
    """
    hashed = [F.when(F.col("d") > 0, F.xxhash64(F.lit(i), "d", "sym")).otherwise(0).alias(f"x{i}") for i in (1, 2)]
    marked = steps.select("conv", "d", "words", *hashed)
    prefix = running(marked, ["d"], scratch, xors=("x1", "x2"), segment="conv")
    length = steps.groupBy("conv").agg(F.max("d").alias("length"))
    ends = scratch.keep(ranked(steps, scratch).join(length, "conv"), "ends")
    rows = prefix.join(ends, "conv").select("conv", "d", "words", "rank", "length", F.col("x1_run").alias("f1"), F.col("x2_run").alias("f2"),
        F.col("x1_run").bitwiseXOR(F.col("x1")).alias("p1"), F.col("x2_run").bitwiseXOR(F.col("x2")).alias("p2"))
    nodes = rows.groupBy("d", "f1", "f2").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"), F.min("rank").alias(
            "first"), F.max("rank").alias("last"), F.max("words").alias("words"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
        F.count_if(F.col("d") == F.col("length")).alias("n_ends"))
    nodes = scratch.keep(nodes, "nodes")
    kids = nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(F.count(F.lit(1))
        .alias("n_children"))
    whole = scratch.keep(nodes.join(kids, ["d", "f1", "f2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    parents = whole.where("n_children > 0").select((F.col("d") + 1).alias("d"), F.col("f1").alias("p1"), F.col("f2").alias("p2"),
        F.col("conv_id").alias("parent_conv_id"))
    whole = whole.join(parents, ["d", "p1", "p2"], "left").select("d", "conv_id", "parent_conv_id", "n_convs", "n_children", "first", "last",
        "n_ends", F.lit(1).cast("long").alias("one"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col(
            "words")).alias("saved"))
    placed = running(scratch.keep(whole, "nodes"), ["first", "d"], scratch, sums=("one", "leaf", "saved"))
    last = placed.groupBy(F.col("first").alias("last")).agg(F.max("one_run").alias("subtree_end"), F.max("leaf_run").alias("leaves_to"), F.max(
            "saved_run").alias("saved_to"))
    digests = id_digests(ends).select(F.col("rank").alias("first"), "sha")
    own = placed.where("n_ends > 0").select("first", "d").join(digests, "first")
    out = placed.join(last, "last").join(own, ["first", "d"], "left")
    return out.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", (F.col("leaves_to") - F.col(
                "leaf_run") + F.col("leaf")).alias("n_leaves"), (F.col("saved_to") - F.col("saved_run") + F.col("saved")).alias(
            "saved_tokens"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"), F.col("one_run").alias("preorder"), "subtree_end")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of the rebuilt ``conversations`` (conv_id, turn, role, text), a row for each node.

    Null roles and texts are empty, so are equal to empty ones. Rows without a conv_id belong to no
    conversation and are left out. Turns that share a number, repeated rows among them, all count, in the
    order of the MD5 of role and text. A conversation that is rebuilt without turns is a member of the
    root alone. Without conversations there is no node. Other columns are ignored.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    return prefix_trie(grafted(numbered(conversations, scratch), scratch), scratch)
