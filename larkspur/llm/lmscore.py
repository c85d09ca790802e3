"""Cross-entropy difference: target and background bigram models over one vocabulary.

Both models count the same words with the same smoothing: the background all documents, the target
those that are labelled good. A document's score is the mean over its words of the target's loss less
the background's; lower is closer to the target. Counts are taken over all documents, and every word
and every pair of words has counts of its own.

Documents are dealt into blocks of some MB. A block sends its distinct words and pairs, as sorted
hashes with their counts, to the parts of the range of hashes; a part adds up what all blocks have sent
and replies to each with the sums of what it asked for, in the same order. So no step holds a whole model.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch
from .joins import sized_join
from .words import hashes, mix, parts, spans

#: Bytes of text in a block, and bytes of text whose words and pairs are one part, about.
BLOCK, PART = 8 << 20, 16 << 20
#: Weight of the unigram model, in counts, and of a word without counts.
MU, ALPHA = 20.0, 0.1
#: Key of a text's start. Keys of words are even and keys of pairs odd; this is the least of all.
START = np.uint64(0)


def grams(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of texts, ascending, each word's place and its pair's among them, which words are first, and the texts' sizes."""
    held, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for chunk in column.chunks:
        for _, data, offs in parts(chunk):
            start, end, first = spans(data, offs)
            held.append(hashes(data, start, end) & ~np.uint64(1))
            sizes.append(np.diff(first))
    h, n = np.concatenate(held), np.concatenate(sizes)
    begins = (np.cumsum(n) - n)[n > 0]
    before = np.full(len(h), START)
    before[1:] = h[:-1]
    before[begins] = START
    pair = mix(before * np.uint64(0x9FB21C651E98DF25) + h) | np.uint64(1)
    keys, at = np.unique(np.concatenate([[START], h, pair]), return_inverse=True)
    return keys, at[1 : len(h) + 1], at[len(h) + 1 :], begins, n


def pack(counts: np.ndarray) -> bytes:
    """Counts in a byte each; those of 255 and more follow in full; compressed."""
    return zstandard.compress(np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.int64).tobytes(), 1)


def unpack(raw: pa.Scalar, n: int) -> np.ndarray:
    raw = zstandard.decompress(raw.as_buffer())
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, np.int64, offset=n)
    return out


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as their differences, the bytes of one weight together: the upper ones are nearly all zero."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_keys(raw: pa.Scalar) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw.as_buffer()), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def asked(docs: DataFrame, bits: int) -> DataFrame:
    """(block, part, keys, n, good): the words and pairs of each block of (block, text, target), by part, with their counts in all and in target documents."""

    def run(table: pa.Table) -> pa.Table:
        keys, word, pair, _, size = grams(table["text"])
        target = table["target"].to_numpy().astype(bool)
        good = np.repeat(target, size)
        n = np.bincount(word, minlength=len(keys)) + np.bincount(pair, minlength=len(keys))
        t = np.bincount(word[good], minlength=len(keys)) + np.bincount(pair[good], minlength=len(keys))
        n[0], t[0] = (size > 0).sum(), (target & (size > 0)).sum()
        part = (keys >> np.uint64(64 - bits)).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(keys)]
        cells = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.table([pa.array([table["block"][0].as_py()] * len(cells), pa.int64()), pa.array(part[cuts[:-1]]),
                *[pa.array([f(x[c]) for c in cells], pa.binary()) for f, x in ((pack_keys, keys), (pack, n), (pack, t))]], [
                "block", "part", "keys", "n", "good"],)

    return docs.select("block", "text", "target").groupBy("block").applyInArrow(run, "block long, part long, keys binary, n binary, good binary")


def replies(asks: DataFrame) -> DataFrame:
    """(block, part, size, n, good): the sums over all blocks of the keys that a block asked for; distinct words, words and target words of a part on one of its rows."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        held = [unpack_keys(x) for x in table["keys"]]
        ends = np.cumsum([len(x) for x in held])
        keys, at = np.unique(np.concatenate(held), return_inverse=True)
        sums = [np.bincount(at, np.concatenate([unpack(x, len(k)) for x, k in zip(table[c], held)]), len(keys)).astype(np.int64) for c in ("n", "good")]
        word = (keys & np.uint64(1) == 0) & (keys != START)
        total = [int(word.sum()), *[int(s[word].sum()) for s in sums]]
        back = [[pack(x) for x in np.split(s[at], ends[:-1])] for s in sums]
        return pa.table([table["block"], table["part"], pa.array([len(x) for x in held], pa.int64()), *[pa.array(x,
                        pa.binary()) for x in back], *[pa.array([x] + [0] * (len(held) - 1), pa.int64()) for x in total]], ["block", "part",
                "size", "n", "good", "distinct_words", "words", "good_words"],)

    return asks.groupBy("part").applyInArrow(run, "block long, part long, size long, n binary, good binary, distinct_words long, words long, good_words long")


def losses(counts: np.ndarray, words: int, distinct: int, before: np.ndarray, word: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Nats of each word under one model: bigram counts smoothed by the unigram model, and that by a constant."""
    single = (counts[word] + ALPHA) / (words + ALPHA * distinct)
    return -np.log((counts[pair] + MU * single) / (counts[before] + MU))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score (their difference) of every document.

    The target are the documents whose ``labels.quality`` is 1 on some row. Texts without words (null,
    empty) have 0 tokens and null losses. Documents with null ids are scored, but are never targets.
    Without any target document, the target model is the constant one. Repeated rows count repeatedly.
    """
    scratch = Scratch(docs.sparkSession, "lmscore")
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("_good")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, held // BLOCK))))
    marked = sized_join(rows, good.withColumn("_hit", F.lit(True)), F.col("doc_id") == F.col("_good"), "left")
    asks = asked(marked.withColumn("target", F.coalesce("_hit", F.lit(False))), max(1, int(held // PART).bit_length()))
    replied = scratch.keep(replies(asks), "counts")
    total = replied.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("distinct_words", "words", "good_words")]).first()
    distinct, models = total["distinct_words"], (("good", total["good_words"]), ("n", total["words"]))

    def run(table: pa.Table, counts: pa.Table) -> pa.Table:
        _, word, pair, begins, n = grams(table["text"])
        before = np.zeros(len(word), np.int64)
        before[1:] = word[:-1]
        before[begins] = 0
        counts = counts.sort_by("part")
        got = []
        for c, words in models:
            sums = np.zeros(len(n))
            if len(word):
                own = np.concatenate([unpack(x, k) for x, k in zip(counts[c], counts["size"].to_pylist())])
                sums[n > 0] = np.add.reduceat(losses(own, words, distinct, before, word, pair), begins)
            got.append(np.where(n > 0, sums / np.maximum(n, 1), np.nan))
        target, background = got
        return pa.table(
            [table["doc_id"], pa.array(n.astype(np.int64)), *[pa.array(x, from_pandas=True) for x in (target, background, target - background)]],
            ["doc_id", "n_tokens", "target_loss", "background_loss", "score"],
        )

    own = replied.select("block", "part", "size", "n", "good")
    return rows.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(run,
        "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
