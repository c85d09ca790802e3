"""Quality rules: counts of each text, and bands of n-gram perplexity for each language.

The model is a modified Kneser-Ney 4-gram model of characters: every letter of every script is a symbol
of its own, without case; all digits are one. Each language has a model of its own, null being one.
Spark counts the grams of all documents and makes the estimates with joins and windows. The estimates
lie on shared storage as arrays sorted by the grams' 64-bit hashes, cut into blocks of a range of
hashes; a task looks its documents' distinct grams up block by block, so nothing is broadcast and no
task holds a model. Perplexities of all documents set a lower and an upper band for each language, and
documents outside of it are rejected. The bands are fitted on the rows that they judge, unless
``Rules`` of another corpus are given.
"""

from __future__ import annotations

from collections import Counter, OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ..storage import Scratch
from .joins import quoted, sized_join
from .memory import give_back
from .warc import filesystem
from .words import mix, parts, spans

ORDER = 4
#: Bits of a code point; three fit a long.
BITS = 21
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A band reaches from the lower and the upper quartile outwards by so many interquartile ranges, and by a
#: least width in nats. Prose that is easier to predict than all other prose is rarer than hard prose.
REACH = (3.0, 6.0)
LEAST_WIDTH = (0.12, 0.30)
#: Both ends of a text's band give way by so much over the square root of its words: short texts vary more.
SHORT = 0.6
SYMBOLS = "#*$%&|<>"
#: Symbols read at a time, and distinct grams that a task gathers before it sends them on.
CHUNK, GATHER = 1 << 18, 1 << 19
#: Entries of a block of a model, about, and bytes of blocks that a worker keeps.
BLOCK_ENTRIES, CACHE_BYTES = 1 << 20, 32 << 20
_BLANKS = " \t\x0b\x0c"


def _symbol_table() -> np.ndarray:
    """The symbol of each code point: lower case, one blank, one line end, one digit; 0 is kept for boundaries."""
    out = np.arange(0x110000, dtype=np.int32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isdecimal():
            out[cp] = ord("0")
        elif c in _BLANKS or (cp > 127 and c.isspace()):
            out[cp] = ord(" ")
        elif (low := c.lower()) != c and len(low) == 1:
            out[cp] = ord(low)
    out[ord("\r")] = ord("\n")
    out[0] = 0xFFFD
    return out


_table: np.ndarray | None = None


def symbols(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of texts with three boundaries before and after each, where a gram ends, and where each text begins.

    A gram ends at each symbol and at the boundary after a text; empty texts have none.
    """
    global _table
    if _table is None:
        _table = _symbol_table()
    text = _table[np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)]
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    size = np.diff(lead[offs])
    pad = ORDER - 1
    start = pad + np.cumsum(size + pad) - (size + pad)
    z = np.zeros(int(size.sum()) + pad * (len(size) + 1), np.int32)
    ends = np.zeros(len(z), bool)
    at = np.arange(len(text)) + np.repeat(start - (np.cumsum(size) - size), size)
    z[at] = text
    ends[at] = True
    ends[(start + size)[size > 0]] = True
    return z, ends, start


def chunks(z: np.ndarray, ends: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(first place, which places end a gram, packed grams there, distinct symbols, bits) of runs of places.

    Grams are packed in 64 bits by the numbers of the run's own symbols; a run with more than 2**16
    distinct ones is cut into short runs.
    """
    pad = ORDER - 1
    for lo in range(pad, len(z), most):
        hi = min(lo + most, len(z))
        seen = np.zeros(0x110000, bool)
        seen[z[lo - pad : hi]] = True
        own = np.flatnonzero(seen)
        if len(own) > 1 << 16:
            for at, here, packed, syms, bits in chunks(z[lo - pad : hi], ends[lo - pad : hi], 1 << 14):
                yield at + lo - pad, here, packed, syms, bits
            continue
        number = np.zeros(int(own[-1]) + 1, np.uint32)
        number[own] = np.arange(len(own), dtype=np.uint32)
        x = number[z[lo - pad : hi]].astype(np.uint64)
        bits = max(1, (len(own) - 1).bit_length())
        packed = x[pad:].copy()
        for j in range(1, ORDER):
            packed |= x[pad - j : len(x) - j] << np.uint64(bits * j)
        here = ends[lo:hi]
        yield lo, here, packed[here], own, bits


def ranked(packed: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct packed grams, ascending, and the number of each gram among them.

    A gram is two pairs of symbols. Where a run's distinct pairs are few, as in alphabets, tables give
    the numbers; else a search among the sorted grams does.
    """
    if 2 * bits <= 16:
        half = np.uint64((1 << (2 * bits)) - 1)
        high, low = (packed >> np.uint64(2 * bits)).astype(np.int64), (packed & half).astype(np.int64)
        seen = np.zeros(1 << (2 * bits), bool)
        seen[high] = seen[low] = True
        pairs = np.flatnonzero(seen)
        if len(pairs) <= 2048:
            number = np.zeros(len(seen), np.int32)
            number[pairs] = np.arange(len(pairs), dtype=np.int32)
            cell = number[high] * len(pairs) + number[low]
            used = np.zeros(len(pairs) ** 2, bool)
            used[cell] = True
            cells = np.flatnonzero(used)
            place = np.zeros(len(used), np.int32)
            place[cells] = np.arange(len(cells), dtype=np.int32)
            grams = (pairs[cells // len(pairs)].astype(np.uint64) << np.uint64(2 * bits)) | pairs[cells % len(pairs)].astype(np.uint64)
            return grams, place[cell]
    grams = np.unique(packed)
    return grams, np.searchsorted(grams, packed)


def opened(packed: np.ndarray, own: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, last symbol) of packed grams; a context is three code points in a long."""
    mask = np.uint64((1 << bits) - 1)
    point = [own[((packed >> np.uint64(bits * j)) & mask).astype(np.int64)].astype(np.int64) for j in range(ORDER)]
    return (point[3] << (2 * BITS)) | (point[2] << BITS) | point[1], point[0]


def model_of(lang: str = "lang") -> Column:
    """The number of a language's model, null being a language."""
    return F.xxhash64(F.coalesce(F.col(lang).cast("string"), F.lit("\0null")))


def count_grams(docs: DataFrame) -> DataFrame:
    """(model, context, symbol, n) of all 4-grams of all documents, summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def merged(m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            c, s, n = (np.concatenate(x) for x in zip(*held[m]))
            order = np.lexsort((s, c))
            c, s, n = c[order], s[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (s[1:] != s[:-1])]))
            return c[first], s[first], np.add.reduceat(n, first)

        def sent(m: int, part) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(part[0]), 65536):
                c, s, n = (x[i : i + 65536] for x in part)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), m)), pa.array(c), pa.array(s.astype(np.int32)), pa.array(n)], [
                        "model", "context", "symbol", "n"])

        for batch in batches:
            model = batch.column(0).to_numpy()
            for m in np.unique(model).tolist():
                for _, data, offs in parts(batch.column(1).take(pa.array(np.flatnonzero(model == m))), CHUNK):
                    z, ends, _ = symbols(data, offs)
                    for _, _, packed, own, bits in chunks(z, ends):
                        if len(packed):
                            u, at = ranked(packed, bits)
                            n = np.bincount(at, minlength=len(u))
                            held.setdefault(m, []).append((*opened(u, own, bits), n))
            if sum(len(x[0]) for v in held.values() for x in v) > GATHER:
                for m in list(held):
                    held[m] = [merged(m)]
                if sum(len(x[0]) for v in held.values() for x in v) > GATHER // 2:
                    for m in list(held):
                        yield from sent(m, held.pop(m)[0])
        for m in list(held):
            yield from sent(m, merged(m))
            del held[m]
        give_back()

    rows = docs.select(model_of().alias("model"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(run, "model long, context long, symbol int, n long")
    return counted.groupBy("model", "context", "symbol").agg(F.sum("n").alias("n"))


def discounted(grams: DataFrame, order: int) -> DataFrame:
    """``grams`` with the discount of each one's count, from the numbers of grams seen one to four times in its model.

    Where one of those numbers is 0, the discounts are 0.5, 1 and 1.5.
    """
    n = [F.sum((F.col("n") == k).cast("double")) for k in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    fit = [F.least(F.greatest(F.lit(0.05), F.lit(float(k)) - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")), F.lit(float(k))) for k in (1, 2, 3)]
    whole = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)
    of = grams.groupBy("model").agg(*[c.alias(f"n{k}") for k, c in enumerate(n, 1)], F.count(F.lit(1)).alias("kinds"))
    of = of.select(F.col("model").alias("_m"), "kinds", *[F.when(whole, f).otherwise(F.lit(k / 2)).alias(f"d{k}") for k, f in enumerate(fit, 1)])
    out = sized_join(grams, of, F.col("model") == F.col("_m")).drop("_m")
    return out.withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))).drop("d1", "d2", "d3")


def estimates(counted: DataFrame, scratch: Scratch) -> DataFrame:
    """(model, kind, context, symbol, value): log probabilities of grams (kind is their order) and log backoff weights of contexts (kind is their order + 8).

    Lower orders count the different symbols before a gram. Order 1 falls back on equal chances of the
    model's symbols and one unknown symbol. A window holds the grams of one context, which are no
    more than there are symbols.
    """
    levels = {ORDER: counted}
    for order in range(ORDER - 1, 0, -1):
        above = levels[order + 1]
        mask = (1 << (BITS * (order - 1))) - 1  # the context without its first symbol
        levels[order] = scratch.keep(above.groupBy("model", F.col("context").bitwiseAND(F.lit(mask)).alias("context"), "symbol")
            .agg(F.count(F.lit(1)).alias("n")), f"order{order}")
    out = below = None
    for order in range(1, ORDER + 1):
        of = Window.partitionBy("model", "context")
        rows = discounted(levels[order], order).withColumns({"total": F.sum("n").over(of), "left": F.sum("d").over(of)})
        weight = F.col("left") / F.col("total")
        if order == 1:
            rows = rows.withColumn("p", (F.col("n") - F.col("d")) / F.col("total") + weight / (F.col("kinds") + 1))
            unknown = rows.groupBy("model").agg(F.max(weight / (F.col("kinds") + 1)).alias("p"))
            out = unknown.select("model", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("context"), F.lit(0).alias("symbol"), F.log(
                    "p").cast("float").alias("value"))
        else:
            tail = F.col("context").bitwiseAND(F.lit((1 << (BITS * (order - 2))) - 1))
            rows = rows.withColumn("_tail", tail).join(below, (F.col("model") == F.col("_m")) & (F.col("_tail") == F.col("_c")) & (F.col(
                        "symbol") == F.col("_s"))).drop("_m", "_c", "_s", "_tail")
            rows = rows.withColumn("p", (F.col("n") - F.col("d")) / F.col("total") + weight * F.col("_p"))
        rows = scratch.keep(rows.select("model", "context", "symbol", "p", weight.alias("weight")), f"p{order}")
        below = rows.select(F.col("model").alias("_m"), F.col("context").alias("_c"), F.col("symbol").alias("_s"), F.col("p").alias("_p"))
        out = out.unionByName(rows.select("model", F.lit(order).alias("kind"), "context", "symbol", F.log("p").cast("float").alias("value")))
        if order > 1:
            backed = rows.groupBy("model", "context").agg(F.max("weight").alias("weight"))
            out = out.unionByName(backed.select("model", F.lit(order + 7).alias("kind"), "context", F.lit(0).alias("symbol"),
                    F.log(F.greatest("weight", F.lit(1e-12))).cast("float").alias("value")))
    return out


def entry_hash(kind: int | np.ndarray, context: np.ndarray, symbol: int | np.ndarray) -> np.ndarray:
    """The 64-bit hash of a model's entry."""
    tag = (np.atleast_1d(kind).astype(np.uint64) << np.uint64(BITS)) + np.atleast_1d(symbol).astype(np.uint64)
    return mix(mix(context.astype(np.uint64)) + (tag + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25))


def store(entries: DataFrame, path: str) -> None:
    """Write entries as sorted hash arrays: a row (keys, values) for each block, in ``path``/model=/bits=/block=.

    A block is the range of hashes with the same first ``bits`` bits; a model has as many as make
    about ``BLOCK_ENTRIES`` entries each.
    """
    size = entries.groupBy(F.col("model").alias("_m")).agg(F.count(F.lit(1)).alias("_n"))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("_n") / F.lit(float(BLOCK_ENTRIES))))).cast("int")
    rows = sized_join(entries, size.select("_m", bits.alias("bits")), F.col("model") == F.col("_m")).drop("_m")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model, kind, context, symbol, value, bits = (c.to_numpy() for c in batch.columns)
            h = entry_hash(kind, context, symbol)
            block = np.where(bits > 0, h >> (np.uint64(64) - np.maximum(bits, 1).astype(np.uint64)), np.uint64(0)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(5), pa.array(block), pa.array(h.view(np.int64)),
                    batch.column(4)], ["model", "bits", "block", "key", "value"])

    def array(table: pa.Table) -> pa.Table:
        key, value = table["key"].to_numpy().view(np.uint64), table["value"].to_numpy().astype(np.float32)
        order = np.argsort(key)
        return table.slice(0, 1).select(["model", "bits", "block"]).append_column("keys", pa.array([key[order].tobytes()],
                pa.binary())).append_column("values", pa.array([value[order].tobytes()], pa.binary()))

    rows = rows.select("model", "kind", "context", "symbol", "value", "bits").mapInArrow(hashed, "model long, bits int, block long, key long, value float")
    blocks = rows.groupBy("model", "bits", "block").applyInArrow(array, "model long, bits int, block long, keys binary, values binary")
    blocks.write.partitionBy("model", "bits", "block").parquet(path)


class Models:
    """A reader of stored models that keeps the blocks used last."""

    def __init__(self, path: str):
        self.fs, self.path = filesystem(path)
        self.bits: dict[int, int | None] = {}
        self.blocks: OrderedDict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = OrderedDict()
        self.held = 0

    def _listed(self, path: str) -> list[str]:
        return [f.path for f in self.fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))]

    def bits_of(self, model: int) -> int | None:
        """The number of bits that name the model's blocks; None for a language without a model."""
        if model not in self.bits:
            found = [p.rpartition("bits=")[2] for p in self._listed(f"{self.path}/model={model}") if "bits=" in p]
            self.bits[model] = int(found[0]) if found else None
        return self.bits[model]

    def block(self, model: int, bits: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if (model, n) in self.blocks:
            self.blocks.move_to_end((model, n))
            return self.blocks[model, n]
        files = [p for p in self._listed(f"{self.path}/model={model}/bits={bits}/block={n}") if p.endswith(".parquet")]
        got = (np.zeros(0, np.uint64), np.zeros(0, np.float32))
        for f in files:
            with self.fs.open_input_file(f) as stream:
                row = pq.ParquetFile(stream).read(columns=["keys", "values"])
            if row.num_rows:
                got = (np.frombuffer(row["keys"][0].as_buffer(), np.uint64), np.frombuffer(row["values"][0].as_buffer(), np.float32))
        self.blocks[model, n] = got
        self.held += 12 * len(got[0])
        while self.held > CACHE_BYTES and len(self.blocks) > 1:
            self.held -= 12 * len(self.blocks.popitem(last=False)[1][0])
        return got

    def find(self, model: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash has an entry, and its value or 0."""
        hit, value = np.zeros(len(wanted), bool), np.zeros(len(wanted))
        bits = self.bits_of(model)
        block = wanted >> np.uint64(64 - bits) if bits else np.zeros(len(wanted), np.uint64)
        for n in np.unique(block).tolist():
            keys, values = self.block(model, bits, n)
            if len(keys):
                mine = np.flatnonzero(block == n)
                at = np.minimum(np.searchsorted(keys, wanted[mine]), len(keys) - 1)
                same = keys[at] == wanted[mine]
                hit[mine], value[mine] = same, np.where(same, values[at], 0)
        return hit, value

    def log_prob(self, model: int, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Natural log probability of symbols after three others."""
        out, todo = np.zeros(len(symbol)), np.arange(len(symbol))
        for order in range(ORDER, 0, -1):
            c, s = context[todo] & ((1 << (BITS * (order - 1))) - 1), symbol[todo]
            hit, value = self.find(model, entry_hash(order, c, s))
            out[todo[hit]] += value[hit]
            todo, c = todo[~hit], c[~hit]
            if len(todo) and order > 1:
                out[todo] += self.find(model, entry_hash(order + 7, c, 0))[1]
        if len(todo):
            out[todo] += self.find(model, entry_hash(0, np.zeros(len(todo), np.int64), 0))[1]
        return out

    def nats(self, model: np.ndarray, column: pa.Array) -> np.ndarray:
        """Nats a symbol of each text under its model; NaN for empty texts and languages without a model."""
        out = np.full(len(model), np.nan)
        for m in np.unique(model).tolist():
            rows = np.flatnonzero(model == m)
            if self.bits_of(m) is None:
                continue
            for lo, data, offs in parts(column.take(pa.array(rows)), CHUNK):
                z, ends, start = symbols(data, offs)
                sums = np.zeros(len(start))
                for at, here, packed, own, bits in chunks(z, ends):
                    if not len(packed):
                        continue
                    u, number = ranked(packed, bits)
                    value = np.zeros(len(here))
                    value[here] = self.log_prob(m, *opened(u, own, bits))[number]
                    upto = np.concatenate([[0], np.cumsum(value)])
                    edge = np.clip(np.append(start, len(z)) - at, 0, len(here))
                    sums += np.diff(upto[edge])
                n = np.add.reduceat(ends.astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
                with np.errstate(invalid="ignore"):
                    out[rows[lo : lo + len(start)]] = np.where(n > 0, -sums / np.maximum(n, 1), np.nan)
        return out


def counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a UTF-8 text."""
    words = text.split()
    word_chars = len(text.decode("utf-8", "replace")) - sum(map(text.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    symbols_ = sum(map(text.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    repeated = 0
    n = len(words) - 2
    if n > 1:
        seen = set(zip(words, words[1:], words[2:]))
        if len(seen) < n:
            several = Counter(zip(words, words[1:], words[2:]))
            until = 0
            for i, t in enumerate(zip(words, words[1:], words[2:])):
                if several[t] > 1:
                    repeated += i + 3 - max(i, until)
                    until = i + 3
    return len(words), word_chars, symbols_, len(lines) - len(set(lines)), repeated


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = [*[StructField(c, LongType()) for c in _COUNTS], StructField("base_failed", BooleanType()), StructField("nats", DoubleType())]


def featured(docs: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """The columns as c0, c1, ..., the language as _lang, and the features of each document, its nats a symbol under the stored model."""
    given = docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(columns)], F.col("lang").cast("string").alias("_lang"))
    rows = docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(columns)], F.col("lang").cast("string").alias("_lang"), model_of()
        .alias("_model"), F.col("text").cast("string").alias("_text"))
    n = len(given.columns)
    schema = StructType([*given.schema.fields, *FEATURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = Models(path)
        for batch in batches:
            nats = models.nats(batch.column(n).to_numpy(), batch.column(n + 1))
            got = []
            for _, data, offs in parts(batch.column(n + 1)):
                raw = data.tobytes()
                got += [counts(raw[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            own = [pa.array([x[i] for x in got], pa.int64()) for i in range(5)]
            failed = pa.array([base_failed(x[0], x[4]) for x in got], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *own, failed, pa.array(nats, from_pandas=True)], schema.names)
        del models
        give_back()

    return rows.mapInArrow(run, schema)


def bands(features: DataFrame, reach: tuple[float, float] = REACH, width: tuple[float, float] = LEAST_WIDTH) -> DataFrame:
    """(lang, lower, upper): the perplexity bands, in nats, from approximate quartiles of the scores of all documents of enough words."""
    scores = features.where((F.col("n_words") >= MIN_WORDS) & F.col("nats").isNotNull())
    q = scores.groupBy(F.col("_lang").alias("lang")).agg(F.percentile_approx("nats", [0.25, 0.75], 10_000).alias("q"))
    out = [F.greatest((F.col("q")[1] - F.col("q")[0]) * reach[i], F.lit(width[i])) for i in (0, 1)]
    return q.select("lang", (F.col("q")[0] - out[0]).alias("lower"), (F.col("q")[1] + out[1]).alias("upper"))


@dataclass
class Rules:
    """The folder of the stored models, and the bands; no bands: those of the judged rows."""

    path: str
    bands: DataFrame | None = None


def fit(docs: DataFrame) -> Rules:
    """The models of a corpus, stored on shared storage."""
    scratch = Scratch(docs.sparkSession, "quality")
    counted = scratch.keep(count_grams(docs), "counts")
    entries = scratch.keep(estimates(counted, scratch), "entries")
    store(entries, f"{scratch.path}/models")
    return Rules(f"{scratch.path}/models")


def learn(docs: DataFrame, rules: Rules | None = None) -> Rules:
    """Models and bands of a corpus; with ``rules``, bands under their models."""
    rules = rules or fit(docs)
    scratch = Scratch(docs.sparkSession, "quality")
    return Rules(rules.path, scratch.keep(bands(featured(docs, rules.path, [])), "bands"))


def _verdict(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows of ``featured`` with their band and ``kept``."""
    rows = sized_join(rows, limits.select(F.col("lang").alias("_of"), "lower", "upper"), F.col("_lang").eqNullSafe(F.col("_of")), "left").drop("_of", "_lang")
    give = F.lit(SHORT) / F.sqrt(F.greatest("n_words", F.lit(1)))
    rows = rows.withColumns({"lower": F.col("lower") - give, "upper": F.col("upper") + give})
    inside = F.coalesce((F.col("nats") >= F.col("lower")) & (F.col("nats") <= F.col("upper")), F.lit(True))
    return rows.withColumn("kept", ~F.col("base_failed") & inside)


def judge_documents(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """doc_id, counts, base_failed, kept, perplexity and its band for every document.

    Null texts have no words and fail. A null language is a language. A document whose language has no
    model or no band is kept if it passes the base rules. Rows are judged one by one, so repeated rows agree.
    """
    rules = rules or fit(docs)
    rows = Scratch(docs.sparkSession, "quality").keep(featured(docs.withColumn("doc_id", F.col("doc_id").cast("long")), rules.path, ["doc_id"]), "features")
    return _verdict(rows, rules.bands or bands(rows)).select(
        F.col("c0").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.exp("nats").alias("perplexity"), F.exp("lower").alias("lower"), F.exp("upper").alias("upper"),
    )


def keep_good(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The documents that ``judge_documents`` keeps, with all their columns.

    Texts are scored for the bands, and again with them: a copy of all texts would take more than that.
    """
    columns = docs.columns
    rules = rules if rules and rules.bands else learn(docs, rules)
    return _verdict(featured(docs, rules.path, columns), rules.bands).where("kept").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
