"""The quality rules' Kneser-Ney models, perplexities, bands and verdicts against a direct count in plain Python."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import quality

LOW = {"\r": "\n", "\t": " ", "　": " "}


def read(text):
    """The symbols of a text with its boundaries."""
    if not text:
        return []
    return ["", "", "", *["0" if c.isdecimal() else LOW.get(c, c.lower() if len(c.lower()) == 1 else c) for c in text], ""]


class Direct:
    """Modified Kneser-Ney of 4-grams, from its definition."""

    def __init__(self, texts):
        self.n = {4: Counter(tuple(s[i : i + 4]) for s in map(read, texts) for i in range(len(s) - 3))}
        for k in (3, 2, 1):
            self.n[k] = Counter(g[1:] for g in self.n[k + 1])
        self.d, self.total, self.left = {}, defaultdict(int), defaultdict(float)
        for k in self.n:
            of = [sum(c == j for c in self.n[k].values()) for j in (1, 2, 3, 4)]
            if all(of):
                y = of[0] / (of[0] + 2 * of[1])
                self.d[k] = [min(max(0.05, j - (j + 1) * y * of[j] / of[j - 1]), j) for j in (1, 2, 3)]
            else:
                self.d[k] = [0.5, 1.0, 1.5]
            for g, c in self.n[k].items():
                self.total[g[:-1]] += c
                self.left[g[:-1]] += self.d[k][min(c, 3) - 1]

    def p(self, g):
        lower = self.p(g[1:]) if len(g) > 1 else 1 / (len(self.n[1]) + 1)
        if not self.total[g[:-1]]:
            return lower
        c = self.n[len(g)][g]
        return (c - self.d[len(g)][min(c, 3) - 1] if c else 0) / self.total[g[:-1]] + self.left[g[:-1]] / self.total[g[:-1]] * lower

    def nats(self, text):
        s = read(text)
        return -sum(math.log(self.p(tuple(s[i : i + 4]))) for i in range(len(s) - 3)) / (len(s) - 3) if s else None


def scripts():
    rng = random.Random(8)
    alphabets = {"en": "aeioutnsrh A.1", "ru": "абвгдеёжзик оА,5", "zh": "的一是不了人我在有他这中大来上个国到说们 。", "el": "αβγδεζηθικλ μΩ", None: "xyzw ", "🙂": "🙂🙃😀 😁", "he": "אבגדה "}
    alphabets |= {f"l{i}": "abc d" + chr(0x100 + i) for i in range(9)}
    rows = []
    for lang, letters in alphabets.items():
        for _ in range(12):
            rows.append((len(rows), "".join(rng.choice(letters) if rng.random() < 0.6 else rng.choice(letters[:4]) for _ in range(rng.randint(0, 700))), lang))
    return [*rows, (900, None, "en"), (901, "", None)]


@pytest.mark.parametrize("small", [False, True])
def test_every_language_has_a_true_model(spark, monkeypatch, small):
    if small:  # several runs of symbols, several blocks, and a cache that holds one of them
        monkeypatch.setattr(quality, "BLOCK_ENTRIES", 64)
        monkeypatch.setattr(quality, "CHUNK", 101)
        monkeypatch.setattr(quality.chunks, "__defaults__", (101,))
        monkeypatch.setattr(quality, "CACHE_BYTES", 1)
        monkeypatch.setattr(quality, "GATHER", 50)
    rows = scripts()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    rules = quality.fit(df)
    langs = {lang for _, _, lang in rows}
    direct = {lang: Direct([t for _, t, x in rows if x == lang and t]) for lang in langs}
    got = {r["c0"]: r["nats"] for r in quality.featured(df, rules.path, ["doc_id"]).collect()}
    for i, text, lang in rows:
        assert got[i] == (pytest.approx(direct[lang].nats(text), rel=1e-5) if text else None)
    fresh = [(i, "".join(random.Random(i).sample(t, len(t))) + "?", lang) for i, t, lang in rows if t]  # grams that were never counted
    other = {r["c0"]: r["nats"] for r in quality.featured(spark.createDataFrame([*fresh, (999, "no model", "qq")], df.schema), rules.path, ["doc_id"]).collect()}
    assert other[999] is None
    for i, text, lang in fresh:
        assert other[i] == pytest.approx(direct[lang].nats(text), rel=1e-5)


def test_chances_sum_to_one(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat. " * 5 + "a dog ran", "en")], "doc_id long, text string, lang string")
    models = quality.Models(quality.fit(df).path)
    model = df.select(quality.model_of()).first()[0]
    known = sorted(set(read(df.first()["text"])))
    codes = np.array([ord(c) if c else 0 for c in known] + [ord("Ж")])
    for context in ("", "the", "at ", "zzz"):
        packed = sum(ord(c) << (21 * (2 - i)) for i, c in enumerate(context))
        p = np.exp(models.log_prob(model, np.full(len(codes), packed), codes))
        assert p.sum() == pytest.approx(1, abs=1e-5) and (p > 0).all()


def test_many_symbols_in_one_text():
    z = np.concatenate([np.zeros(3, np.int32), np.arange(1, 70_000, dtype=np.int32), np.zeros(3, np.int32)])
    ends = np.zeros(len(z), bool)
    ends[3:-2] = True
    seen = 0
    for at, here, packed, own, bits in quality.chunks(z, ends):
        context, last = quality.opened(packed, own, bits)
        assert (last == z[at : at + len(here)][here]).all() and bits <= 16
        assert (context & (2**21 - 1) == z[at - 1 : at - 1 + len(here)][here]).all()
        seen += len(packed)
    assert seen == 70_000


def test_bands_and_verdicts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rules = quality.fit(docs)
    scores = {r["c0"]: r for r in quality.featured(docs, rules.path, ["doc_id"]).collect()}
    bands = {}
    for lang in {r["_lang"] for r in scores.values()}:
        mine = sorted(r["nats"] for r in scores.values() if r["_lang"] == lang and r["n_words"] >= 50)
        if mine:
            q = [mine[max(0, math.ceil(len(mine) * p) - 1)] for p in (0.25, 0.75)]
            bands[lang] = (q[0] - max(3 * (q[1] - q[0]), 0.12), q[1] + max(6 * (q[1] - q[0]), 0.30))
    for r in quality.judge_documents(docs).collect():
        s = scores[r["doc_id"]]
        low, high = bands[s["_lang"]]
        give = 0.6 / math.sqrt(max(s["n_words"], 1))
        assert r["kept"] == (not s["base_failed"] and low - give <= s["nats"] <= high + give)
        assert (math.log(r["lower"]), math.log(r["upper"])) == pytest.approx((low - give, high + give))
    held_out = quality.judge_documents(docs.where("doc_id % 2 = 0"), quality.learn(docs.where("doc_id % 2 = 1")))
    good = held_out.where("not base_failed").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good > 0.9
