"""Sharding by weighted rendezvous hashing, all in DataFrame functions.

Every (record key, shard) pair draws a uniform number u from an MD5 digest; the record goes to the
shard with the largest weight / -ln(u). Each shard wins a share of the keys in proportion to its
weight, and one more shard takes records only into itself, because the other draws stay as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import Scratch

#: 52 bits of the digest make a double in (0, 1) without rounding.
_BITS = 4503599627370496.0
#: Rows that one task numbers; a group of more rows is numbered in several tasks.
ROWS_PER_TASK = 20_000
_EXPAND = 10_000


def key_text(*keys: Column) -> Column:
    """The record key as text; null keys are the text ``null``."""
    return F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])


def draw(key: Column, salt: str = "") -> Column:
    """A number in 0 .. 2**52 - 1 from the MD5 digest of the key and a salt, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f"#{salt}"))), 1, 13), 16, 10).cast("long")


def unit(key: Column, salt: str = "") -> Column:
    """``draw`` as a double in (0, 1)."""
    return (draw(key, salt).cast("double") + F.lit(0.5)) / F.lit(_BITS)


def score(key: Column, shard: str, weight: float) -> Column:
    """The shard's rendezvous score for a key; the largest wins."""
    return F.lit(float(weight)) / -F.log(unit(key, f"shard-{shard}"))


def assign(key: Column, shards: dict[str, float] | int) -> tuple[Column, Column]:
    """(index, score) of the winning shard; ``shards`` maps names to weights, or is a count of equal ones.

    Of equal scores the first shard wins.
    """
    named = {str(i): 1.0 for i in range(shards)} if isinstance(shards, int) else dict(shards)
    if not named or any(w <= 0 for w in named.values()):
        raise ValueError("shards need positive weights")
    best = F.greatest(*s) if len(s := [score(key, n, w) for n, w in named.items()]) > 1 else s[0]
    index = reduce(lambda rest, i: F.when(s[i] >= best, F.lit(i)).otherwise(rest), range(len(s) - 1, -1, -1), F.lit(None).cast("int"))
    return index.cast("int"), best


def number(df: DataFrame, group: list[str], key: str, rest: list[str], name: str = "slot", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``group``, ``key`` and ``rest`` columns of ``df`` with a gapless number from 0 in each group.

    ``key`` is a long in 0 .. 2**52 - 1, such as ``draw``; rows are numbered in the order of
    ``key`` and ``rest`` (nulls first). Equal rows are counted before the shuffle and take
    numbers in a row. A group is cut by ``key`` into ranges of about ``rows_per_task`` rows; a range
    starts where the counts of those before it end, so a group of any size is numbered by many tasks.
    Memory of a task holds a range's sort only. An empty table gives an empty table.
    """
    cuts = max(1, -(-df.count() // rows_per_task))
    cols = [*group, key, *rest]
    cut = F.floor(F.col(key) / F.lit(_BITS) * F.lit(cuts)).cast("long")
    rows = df.select(*cols).groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).withColumn("_cut", cut)
    in_cut = Window.partitionBy(*group, "_cut").orderBy(key, *[F.col(c).asc_nulls_first() for c in rest])
    begun = F.coalesce(F.sum("_n").over(in_cut.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = rows.groupBy(*group, "_cut").agg(F.sum("_n").alias("_size"))
    before = Window.partitionBy(*group).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_cut").alias("_c"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"),
    )
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)], F.col("_cut") == F.col("_c"))
    placed = rows.withColumn("_first", begun).join(starts, same).withColumn("_first", F.col("_first") + F.col("_start"))
    # equal rows come back in two steps, so that no task makes more than a slice of them
    steps = F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(_EXPAND).cast("long"))
    few = placed.where(F.col("_n") == 1).select(*cols, F.col("_first").cast("long").alias(name))
    many = placed.where(F.col("_n") > 1).withColumn("_at", F.explode(steps)).repartition(*cols, "_at")
    slots = F.sequence(F.col("_first") + F.col("_at"), F.col("_first") + F.least(F.col("_at") + _EXPAND, F.col("_n")) - 1)
    return few.unionByName(many.select(*cols, F.explode(slots).alias(name)))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of all documents.

    Null texts have size 1 and the checksum of no bytes; null ids share one key. Rows with equal ids
    go to one shard. ``slot`` numbers a shard's rows from 0 without gaps, in the order of a digest of
    id and text, so that rows without ids are many ranges too. The texts are read once.
    Only the four named columns are read, so further ones can't clash.
    """
    key = key_text(F.col("doc_id"))
    shard, best = assign(key, shards)
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        shard.alias("shard"),
        F.when(score(key, str(shards), 1.0) > best, F.lit(shards)).otherwise(shard).cast("int").alias("grown_shard"),
        draw(key_text(F.col("doc_id"), F.crc32(F.encode(body, "UTF-8"))), "slot").alias("_key"),
    )
    rows = Scratch(docs.sparkSession, "shard").keep(rows, "rows")
    placed = number(rows, ["shard"], "_key", ["doc_id", "size", "text_crc32", "grown_shard"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
