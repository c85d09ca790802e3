"""Mixing of sources to target weights, all in DataFrame functions.

A source's rate is its target over its tokens. Each document is taken floor(rate) times, and once
more if a number drawn from a digest of its id and text, turned by its source's seed, falls below the
fraction. Of 64 seeds, turns of the circle of draws by 1/64 each, a source has the one that brings
the tokens taken nearest to its target, so that a source of few documents comes near it too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import Scratch
from .joins import quoted, sized_join
from .sharding import draw, key_text

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3
#: Sources that one task puts in order.
SOURCES_PER_RANGE = 100_000
#: Draws are whole numbers below 2**52; a turn adds a multiple of 2**46.
_DRAW_BITS, _TURN_BITS = 52, 46
SEEDS = 1 << (_DRAW_BITS - _TURN_BITS)


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_turn(sizes: DataFrame, weights: tuple[int, ...], scratch: Scratch) -> DataFrame:
    """``sizes`` with _w, the weights in turn over the sources in code-point order, null last.

    Sources are dealt into ranges; a range is numbered by itself, from the number of sources before it.
    """
    n = sizes.count()
    first, last = F.col("source").isNull(), F.col("source")
    ranges = scratch.keep(sizes.repartitionByRange(max(1, -(-n // SOURCES_PER_RANGE)), first, last).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = sorted(map(tuple, ranges.groupBy("_range").count().collect()))
    before = F.create_map(*[F.lit(int(v)) for i, (number, _) in enumerate(counts) for v in (number, sum(c for _,
                    c in counts[:i]))]) if counts else F.create_map(F.lit(0), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(first, last)) - 1 + before[F.col("_range")]
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    return ranges.withColumn("_w", pick.cast("long")).drop("_range")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target and rate from one row (source, source_size) per source.

    Sources in code-point order, null last, have the weights in turn and share all tokens. A target
    stops at ``most`` times its source's size, and the excess is shared by weight among the others.
    That is min(cap, level * weight) with one level for all. The level rises from tokens / weights by the
    excess of the sources that it has stopped, until it stops no more; each step is an aggregate.
    No task sees all sources. A source without tokens has target and rate 0.
    """
    scratch = Scratch(sizes.sparkSession, "targets")
    rows = in_turn(sizes.select("source", F.col("source_size").cast("long").alias("source_size")), weights, scratch)
    rows = scratch.keep(rows.withColumn("_cap", F.col("source_size") * most), "caps")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("_cap") < F.lit(level) * F.col("_w")
        n, full, open_ = rows.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("_cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~over,
                        F.col("_w"))), F.lit(0))).first()
        if n == stopped or not open_:
            break
        level, stopped = float(total - full) / open_, n
    cap = F.col("_cap").cast("double")
    out = rows.select("source", "source_size", (F.least(cap, F.lit(level) * F.col("_w")) if level is not None and open_ else cap).alias("target"))
    return out.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


def copies(rate: Column, drawn: Column, seed: Column) -> Column:
    """floor(rate), plus one if the draw, turned by the seed, falls below the fraction."""
    turned = F.pmod(drawn + seed.cast("long") * F.lit(1 << _TURN_BITS), F.lit(1 << _DRAW_BITS))
    return (F.floor(rate) + ((turned.cast("double") + 0.5) / F.lit(float(1 << _DRAW_BITS)) < rate - F.floor(rate)).cast("long")).cast("long")


def document_draw() -> Column:
    """A document's draw, from its id and text."""
    return draw(key_text(F.col("doc_id"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))), "mix")


def seeds(sized: DataFrame, rates: DataFrame) -> DataFrame:
    """``rates`` with each source's seed, of documents (source, size, draw).

    A draw is bin * 2**46 + rest. With seed s, bin b becomes t = (b + s) mod 64: below the fraction's
    bin all documents are taken, above it none, and in it those whose rest is below the fraction's. So
    two sums for each source and bin give the tokens taken under every seed; of equally near seeds the
    first counts.
    """
    r = rates.select(F.col("source").alias("_source"), "rate", "target", "source_size")
    scaled = (F.col("rate") - F.floor("rate")) * F.lit(float(1 << _DRAW_BITS))
    rows = sized_join(sized, r, F.col("source").eqNullSafe(F.col("_source")))
    rows = rows.withColumn("_bin", F.shiftright("draw", _TURN_BITS)).withColumn("_rest", F.col("draw").bitwiseAND(F.lit((1 << _TURN_BITS) - 1)))
    edge = F.floor(scaled / F.lit(float(1 << _TURN_BITS))).cast("long")
    below = F.col("_rest").cast("double") + 0.5 < scaled - edge * F.lit(float(1 << _TURN_BITS))
    bins = rows.groupBy("source", "_bin").agg(F.sum("size").alias("whole"), F.sum(F.when(below, F.col("size")).otherwise(0)).alias("part"))
    held = bins.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("_bin", F.struct("whole", "part")))).alias("bins"))
    own = rates.join(held.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of"))).drop("_of")

    def taken(s: Column) -> Column:
        of = lambda b: F.pmod(F.lit(b) - s, F.lit(SEEDS)).cast("long")
        at = [F.coalesce(F.try_element_at("bins", of(t))["whole"], F.lit(0)) * (F.lit(t) < edge).cast("long") for t in range(SEEDS)]
        mixed = F.coalesce(F.try_element_at("bins", F.pmod(edge - s, F.lit(SEEDS)).cast("long"))["part"], F.lit(0))
        return F.col("source_size") * F.floor("rate").cast("long") + sum(at, mixed)

    tried = own.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SEEDS - 1))))
    tried = tried.withColumn("_off", F.abs(taken(F.col("_s")).cast("double") - F.col("target")))
    best = tried.groupBy("source").agg(F.min_by("_s", F.struct("_off", "_s")).alias("seed"))
    return rates.join(best.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of"))).drop("_of")


def rated(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table of ``targets`` and seeds, one row per source, and (doc_id, source, size, draw) of all documents; both on shared storage, so the texts are read once."""
    scratch = Scratch(docs.sparkSession, "mix")
    if "source" not in docs.columns:
        raise ValueError("documents need a column source")
    sized = scratch.keep(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), document_draw().alias("draw")), "sizes")
    rates = scratch.keep(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    return scratch.keep(seeds(sized, rates), "seeds"), sized


def with_rate(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """Documents beside their source's _size, _target, _rate and _seed; a hot source is not shuffled.

    A source is one row of a few bytes; the table is broadcast if a count shows that it is small,
    and else joined by a shuffle that adaptive execution splits where a source is hot.
    """
    r = rates.select(F.col("source").alias("_source"), F.col("source_size").alias("_size"), F.col("target").alias("_target"), F.col("rate")
        .alias("_rate"), F.col("seed").alias("_seed"))
    return sized_join(docs, r, F.col("source").eqNullSafe(F.col("_source")))


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of all documents, one row each, taken or not.

    Null texts have size 0; null sources are a source. Rows with equal id and text share their draw.
    """
    rates, sized = rated(docs)
    taken = F.col("size") * copies(F.col("_rate"), F.col("draw"), F.col("_seed"))
    return with_rate(sized, rates).select("doc_id", "size", F.col("_size").alias("source_size"), F.col("_target").alias("target"), taken.alias("taken"))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    columns = docs.columns
    named = docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(columns)], F.col("source"), document_draw().alias("draw"))
    out = with_rate(named, rated(docs)[0]).withColumn("_copies", copies(F.col("_rate"), F.col("draw"), F.col("_seed"))).where("_copies > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*[F.col(f"c{i}").alias(c) for i,
            c in enumerate(columns)])
