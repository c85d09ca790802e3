"""Alignment of the tokens of two tokenizers, relationally.

Texts are first cut where both tokenizers must end a token: at single spaces between other characters,
which begin a pre-token of the one and a piece of the other. So a text's tokens are those of its parts,
and each distinct part is encoded and aligned once, with the number of its occurrences. The alignment
explodes both token lists with their places, adds up byte lengths in a window, joins the lists on part
and end, numbers the groups by a running count of common ends, and joins the groups. Documents are
blocks of numbers that stand for their parts; a block's parts go back to it with their results.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import Scratch
from .joins import sized_join
from .memory import give_back

TOKENIZERS = "/opt/tokenizers"
#: Characters of text whose distinct parts make one block.
BLOCK = 28 << 20
#: Characters that are split at once.
SLICE = 1 << 18
#: Bytes of a long part's digest.
KEY = 16
#: Linked pairs that are broadcast, at most, if they are within 16 MB too.
PAIRS = 1 << 20
#: A token is one number: its bytes, times this, plus its id.
IDS = 1 << 20
_NO_SPACE = "[^\\s\u2581\u180e\u200b\ufeff]"
_CUT = re.compile(f"(?<={_NO_SPACE}) (?={_NO_SPACE})")


class Pair:
    """The byte-level BPE of a JSON file (A) and a sentence-piece model (B)."""

    def __init__(self, a: str, b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        byte = {c: i for i, c in byte_letters().items()}
        self.a_bytes = [bytes(byte.get(c, 0) for c in self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.ranks = self._ranks(a)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def _ranks(self, a: str):
        """The same encoder by ranks, several times as fast, if ids follow the merges' order and words are split by the usual pattern."""
        import tiktoken

        with open(a) as f:
            rule = json.load(f)
        model, added = rule["model"], {t["id"] for t in rule.get("added_tokens", [])}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        in_order = all(model["vocab"].get(x + y) == 256 + i for i, (x, y) in enumerate(pairs)) and len(model["vocab"]) - len(added & set(model["vocab"].values())) == 256 + len(pairs)
        if not in_order or not splits_words(rule) or model.get("ignore_merges") or model.get("dropout"):
            return None
        ranks = {self.a_bytes[i]: i for i in range(256 + len(pairs))}
        return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        spaced = [f" {t}" for t in texts]
        if self.ranks is not None:
            a = [self.ranks.encode_ordinary(t) for t in spaced]
        else:
            a = [e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        return a, self.b.encode(texts, num_threads=1)


#: Fixed value: how byte-level encoders of this kind split text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def splits_words(rule: dict) -> bool:
    """Whether an encoder's JSON splits text by ``PATTERN`` and does nothing else to it."""
    before = rule.get("pre_tokenizer") or {}
    return rule.get("normalizer") is None and before.get("type") == "ByteLevel" and bool(before.get("use_regex")) and not before.get("add_prefix_space")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [i for i in range(256) if i not in own]
    return {**{i: chr(i) for i in own}, **{i: chr(256 + k) for k, i in enumerate(rest)}}


@cache
def pair(a: str, b: str) -> Pair:
    """One pair for each worker process."""
    return Pair(a, b)


def cut_at_words(a: str, b: str) -> bool:
    """Whether both tokenizers must end a token at a single space: A splits words off with it, and B has no piece with a space behind another character."""
    with open(a) as f:
        words = splits_words(json.load(f))
    return words and not any(re.search("[^▁]▁", p) for p in map(pair(a, b).b.id_to_piece, range(pair(a, b).b.get_piece_size())))


def key(text: str) -> bytes:
    """What stands for a part in joins: its bytes if they are fewer than 16, else a digest of 16."""
    data = text.encode()
    return data if len(data) < KEY else xxhash.xxh3_128_digest(data)


def packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers, compressed by byte planes: the higher ones are mostly zero."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 4).T).tobytes()) if len(numbers) else b""


def unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int32)
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1).T).view(np.int32).reshape(-1)


def slices(text: str, words: bool) -> Iterator[list[str]]:
    """The parts of a text, some at a time; all of it is one part if it isn't cut at words."""
    at = 0
    while words and len(text) - at > SLICE:
        cut = _CUT.search(text, at + SLICE)
        if cut is None:
            break
        yield _CUT.split(text[at : cut.start()])
        at = cut.end()
    rest = text[at:]
    yield _CUT.split(rest) if words else [rest]


def parted(docs: DataFrame, words: bool) -> DataFrame:
    """Documents as numbers of their block's parts (kind 1: block, row, part, doc_id, at), and the parts with their counts (kind 0: block, row, uid, text, n).

    A part's text is null where uid holds it. A block's rows are in one file, and its parts begin with a row -1 that is none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, row = TaskContext.get().partitionId(), 0, 0
        known: dict[str, int] = {}
        held: list[np.ndarray] = []
        size = 0

        def parts() -> Iterator[pa.RecordBatch]:
            counts = np.bincount(np.concatenate(held), minlength=len(known)) if known else np.zeros(0, np.int64)
            texts = list(known)
            yield _documents([(task << 32 | seq, -1, None, None, None)], 0)
            for lo in range(0, len(texts), 8192):
                some = texts[lo : lo + 8192]
                k = len(some)
                ids = [key(t) for t in some]
                some = [t if len(u) == KEY else None for t, u in zip(some, ids)]
                yield pa.RecordBatch.from_arrays([pa.array([task << 32 | seq] * k, pa.int64()), pa.array([0] * k, pa.int32()), pa.array(
                    np.arange(lo, lo + k)), pa.array([None] * k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(
                    ids, pa.binary()), pa.array(some, pa.string()), pa.array(counts[lo : lo + k].astype(np.int64))], _PARTED)

        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                for i, some in enumerate(slices(text, words) if text else [[]]):
                    at = np.fromiter((known.setdefault(t, len(known)) for t in some), np.int32, len(some))
                    held.append(at)
                    out.append((task << 32 | seq, row, i, doc, packed(at)))
                row += 1
                size += len(text)
                if size >= BLOCK:
                    yield _documents(out, 1)
                    yield from parts()
                    known, held, size, seq, out = {}, [], 0, seq + 1, []
                    give_back()
            if out:
                yield _documents(out, 1)
        if row:
            yield from parts()
        give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "block long, kind int, row long, part int, doc_id long, at binary, uid binary, text string, n long")


_PARTED = ["block", "kind", "row", "part", "doc_id", "at", "uid", "text", "n"]


def _documents(rows: list[tuple], kind: int) -> pa.RecordBatch:
    block, row, part, doc, at = zip(*rows)
    k = len(rows)
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array([kind] * k, pa.int32()), pa.array(row, pa.int64()), pa.array(part,
        pa.int32()), pa.array(doc, pa.int64()), pa.array(at, pa.binary()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64())], _PARTED)


def encoded(parts: DataFrame, a: str, b: str) -> DataFrame:
    """uid, n, and both tokenizers' tokens (bytes * IDS + id) of each part (uid, text, n); null where their bytes are not space and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = pair(a, b)
        packed = [np.array([len(x) * IDS + i for i, x in enumerate(side)], np.int64) for side in (two.a_bytes, two.b_bytes)]
        if any(len(p) > IDS or p.max(initial=0) >= 1 << 31 for p in packed):
            raise ValueError("a vocabulary has more than 2**20 ids or a token of 2**11 bytes")
        packed = [p.astype(np.int32) for p in packed]
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                some = batch.slice(lo, 1024)
                texts = [u.decode() if t is None else t for u, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist())]
                ids = two.encode(texts)
                whole = [f" {t}".encode() for t in texts]
                ok = [b"".join([two.a_bytes[i] for i in x]) == w == b"".join([two.b_bytes[i] for i in y]) for x, y, w in zip(*ids, whole)]
                cols = [pa.array([p[x] if o else None for x, o in zip(side, ok)], pa.list_(pa.int32())) for side, p in zip(ids, packed)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), *cols], ["uid", "n", "a", "b"])
        give_back()

    return parts.select("uid", "text", "n").mapInArrow(run, "uid binary, n long, a array<int>, b array<int>")


def aligned(parts: DataFrame) -> DataFrame:
    """uid, n, groups (their text) and links (a * 2**32 + b) of each encoded part.

    Both sides' tokens are exploded with their places, and their byte lengths add up to their ends. Tokens
    of one end meet in one row, the equi-join of the sides on part and end, where a side may be missing. A group
    ends where both are there, so the number of such ends before is the group's; those two tokens are
    linked. Parts are dealt out by uid before they are exploded, and all steps stay in that partition, so the join
    is an aggregate: a join operator would send the exploded tokens of one side again.
    """
    dealt = parts.select("uid", "n", F.size("a").alias("size"), F.concat("a", "b").alias("t")).repartition("uid")
    rows = dealt.select("uid", "n", "size", F.posexplode("t").alias("pos", "t"))
    rows = rows.select("uid", "n", (F.col("pos") >= F.col("size")).alias("side"), "pos", (F.col("t") % IDS).alias("id"), F.floor(F.col("t") / IDS).alias("bytes"))
    so_far = Window.partitionBy("uid", "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ended = rows.withColumn("end", F.sum("bytes").over(so_far))
    of = lambda side: F.max(F.when(F.col("side") == F.lit(side), F.col("id")))
    met = ended.groupBy("uid", "end").agg(F.max("n").alias("n"), of(False).alias("a"), of(True).alias("b"))
    before = Window.partitionBy("uid").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    grouped = met.withColumn("gid", F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).over(before))
    listed = grouped.groupBy("uid", "gid").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("end", "a", "b"))).alias("t"))
    ids = lambda side: F.array_join(F.transform("t", lambda x: x[side].cast("string")), ",")  # noqa: E731  (missing ones are left out)
    last = F.element_at("t", -1)
    one = F.struct("gid", F.concat_ws("|", ids("a"), ids("b")).alias("text"), (F.shiftleft(last["a"].cast("long"), 32) + last["b"]).alias("link"))
    units = listed.groupBy("uid").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(one)).alias("g"))
    return units.select("uid", "n", F.array_join(F.transform("g", lambda x: x["text"]), ";").alias("groups"), F.transform("g", lambda x: x["link"]).alias("links"))


def withdrawn(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """uid and n of the parts of documents that hold a part of ``bad`` (uid), which have no tokens."""
    marks = rows.where("kind = 0").join(bad, "uid", "left_semi").select("block", "kind", "row", F.lit(None).cast("binary").alias("at"))
    docs = rows.where("kind = 1").join(marks.select("block").distinct(), "block", "left_semi").select("block", "kind", "row", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, was, gone, held = None, None, set(), []

        def made() -> Iterator[pa.RecordBatch]:
            at = np.concatenate(held) if held else np.zeros(0, np.int32)
            if len(at) and np.isin(at, list(gone)).any():
                part, n = np.unique(at, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([now] * len(part), pa.int64()), pa.array(part.astype(np.int64)), pa.array(n.astype(np.int64))],
                    ["block", "row", "n"])

        for batch in batches:
            for block, kind, row, at in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if (block, row) != was or kind == 0:
                    yield from made()
                    held = []
                if block != now:
                    now, gone = block, set()
                was = (block, row) if kind else None
                if kind == 0:
                    gone.add(row)
                else:
                    held.append(unpacked(at))
        yield from made()

    both = marks.unionByName(docs).repartition("block").sortWithinPartitions("block", "kind", "row")
    gone = both.mapInArrow(run, "block long, row long, n long").groupBy("block", "row").agg(F.sum("n").alias("n"))
    of = rows.where("kind = 0").select("block", "row", "uid")
    return of.join(gone, ["block", "row"]).groupBy("uid").agg(F.sum("n").alias("gone"))


def linked_pairs(units: DataFrame) -> DataFrame:
    """link and score of the pairs that links hold: twice their number, plus 1 if no other pair of the B id has more; of units (n, links)."""
    counts = units.select("n", F.explode("links").alias("link")).groupBy("link").agg(F.sum("n").alias("count")).where("count > 0")
    top = F.max("count").over(Window.partitionBy(F.col("link") % (1 << 32)))
    return counts.select("link", (F.col("count") * 2 + (F.col("count") == top).cast("long")).alias("score"))


def gathered(parts: DataFrame) -> DataFrame:
    """The documents' results from those of their parts (block, row, n_best, count_sum, groups, file); groups are null where a part has no tokens.

    A task holds the parts of one block at a time and then reads the block's documents from their file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, file = None, None
        pending: list[np.ndarray] = []
        texts: list[bytes | None] = []

        def results() -> Iterator[pa.RecordBatch]:
            table, doc, out = np.concatenate(pending) if pending else np.zeros((0, 5), np.int64), None, []
            for rows, ids, ats in block_documents(file, now):
                for row, id_, at in zip(rows, ids, ats):
                    if doc is None or row != doc.place:
                        out += [doc.row()] if doc else []
                        doc = Document(row, id_)
                    at = unpacked(at)
                    if len(at):
                        doc.add([texts[i] for i in at.tolist()], table[at].sum(axis=0))
                if len(out) >= 4096:
                    yield _results(out)
                    out = []
            yield _results([*out, *([doc.row()] if doc else [])])

        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                some = batch.slice(lo, hi - lo)
                if block[lo] != now:
                    if now is not None:
                        yield from results()
                    now, file, pending, texts = block[lo], some.column(5)[0].as_py(), [], []
                    some = some.slice(1)  # row -1, which names the file
                new = some.column(4).to_pylist()
                counts = np.array([(0, 0, 0) if t is None else _counts(t) for t in new], np.int64).reshape(-1, 3)
                pending.append(np.column_stack([counts, *[some.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in (2, 3)]]))
                texts += new
        if now is not None:
            yield from results()
        give_back()

    rows = parts.select("block", "row", "n_best", "count_sum", F.col("groups").cast("binary").alias("groups"), "file")
    return rows.repartition("block").sortWithinPartitions("block", "row").mapInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def block_documents(file: str, block: int) -> Iterator[tuple[list, list, list]]:
    """row, doc_id and at of a block's documents in order, from the file of its rows; row groups of other blocks are not read."""
    fs, path = pafs.FileSystem.from_uri(file)
    with fs.open_input_file(path) as source:
        held = pq.ParquetFile(source)
        at = held.schema_arrow.names.index("block")
        for g in range(held.num_row_groups):
            stats = held.metadata.row_group(g).column(at).statistics
            if stats is not None and stats.has_min_max and not stats.min <= block <= stats.max:
                continue
            for batch in held.iter_batches(8192, [g], ["block", "kind", "row", "doc_id", "at"]):
                mine = (batch.column(0).to_numpy(zero_copy_only=False) == block) & (batch.column(1).to_numpy(zero_copy_only=False) == 1)
                if mine.any():
                    some = batch.filter(pa.array(mine))
                    yield some.column(2).to_pylist(), some.column(3).to_pylist(), some.column(4).to_pylist()


def _results(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, kinds)], _RESULT)


_RESULT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _counts(groups: bytes) -> tuple[int, int, int]:
    """Tokens of each side and groups of a part: ids are divided by commas within a side, and a group has one bar."""
    n = groups.count(b"|")
    a = n + sum(g.count(b",", 0, g.index(b"|")) for g in groups.split(b";"))
    return a, 2 * n + groups.count(b",") - a, n


class Document:
    """What a document's parts add up to; nothing if one of them has no tokens."""

    def __init__(self, place: int, doc_id: int | None):
        self.place, self.doc_id, self.total, self.sha = place, doc_id, np.zeros(5, np.int64), None
        self.whole = True

    def add(self, groups: list[bytes | None], total: np.ndarray) -> None:
        self.whole = self.whole and None not in groups
        if self.whole:
            self.total += total
            if self.sha is None:
                self.sha = hashlib.sha256()
            else:
                self.sha.update(b";")
            self.sha.update(b";".join(groups))

    def row(self) -> tuple:
        n_a, n_b, n, best, count = self.total.tolist() if self.whole else [0] * 5
        return self.doc_id, n_a, n_b, n, n, best, count, self.sha.hexdigest() if self.whole and self.sha else ""


def align_documents(docs: DataFrame, folder: str = TOKENIZERS, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document, one row each.

    A encodes a space and the text, B the text, whose space it adds. Null and empty texts, and those
    whose tokens' bytes are not the space and the text, have zeros and an empty digest, and their tokens
    count nowhere. Rows that share id or text each have their row and count each. ``folder`` is read on
    the driver and by every task. If the tokenizers don't end tokens at single spaces, whole texts are the parts
    that are aligned. A part without such spaces is one row of a task, however long it is.
    """
    scratch = Scratch(docs.sparkSession, "align", "zstd")
    a, b = f"{folder}/{a}", f"{folder}/{b}"
    rows = scratch.keep(parted(docs, cut_at_words(a, b)), "parts")
    distinct = rows.where("kind = 0 and row >= 0").groupBy("uid", "text").agg(F.sum("n").alias("n"))
    parts = scratch.keep(encoded(distinct, a, b), "tokens")
    units = scratch.keep(aligned(parts.where("a is not null")), "aligned")
    bad = parts.where("a is null").select("uid")
    counted = units.select("uid", "n", "links")
    if not bad.isEmpty():
        gone = scratch.keep(withdrawn(rows, bad), "withdrawn")
        counted = sized_join(counted, gone, ["uid"], "left").withColumn("n", F.col("n") - F.coalesce("gone", F.lit(0)))
    scratch.drop(parts)
    pairs = scratch.keep(linked_pairs(counted), "pairs")
    links = sized_join(units.select("uid", F.explode("links").alias("link")), pairs, ["link"], rows=PAIRS)
    scores = links.groupBy("uid").agg(F.sum(F.col("score") % 2).alias("n_best"), F.sum(F.floor(F.col("score") / 2)).alias("count_sum"))
    scored = units.select("uid", "groups").join(scores, "uid", "left")
    file = F.when(F.col("row") < 0, F.input_file_name())
    back = rows.where("kind = 0").select("block", "row", "uid", file.alias("file")).join(scored, "uid", "left")
    return gathered(back)
