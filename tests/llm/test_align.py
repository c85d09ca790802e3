"""Token alignment against a plain one over whole texts."""

import hashlib
from collections import Counter, defaultdict
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from larkspur.llm import align

A, B = f"{align.TOKENIZERS}/byte_bpe_50k.json", f"{align.TOKENIZERS}/piece_bpe_32k.model"
ODD = ["", None, "one", " lead", "trail ", "a  b   c", "tab\tnew\nline \n x", "don't we'll 'tis", "<|endoftext|> <s> <unk> <0x0A>", "a▁b c", "ok fine a▁b ok fine",
    "nul\x00l", "漢字 仮名交じり文 🙂🙂 é é", "x" * 3000, "  　wide  thin", "word " * 400 + "end", "1234 56,78 -9.0", "ok fine", "ok fine", "ﬁ ½ Ⅷ"]


def brute(rows):
    """Whole texts, token by token."""
    two = align.pair(A, B)
    aligned, count = [], Counter()
    for doc, text in rows:
        if not text:
            aligned.append((doc, None))
            continue
        x = two.a.encode(f" {text}", add_special_tokens=False).ids
        y = two.b.encode(text)
        xb, yb = [two.a_bytes[i] for i in x], [two.b_bytes[i] for i in y]
        if not b"".join(xb) == b"".join(yb) == f" {text}".encode():
            aligned.append((doc, None))
            continue
        xe, ye = list(accumulate(map(len, xb))), list(accumulate(map(len, yb)))
        ends = sorted(set(xe) & set(ye))
        groups, links, lo = [], [], 0
        for e in ends:
            groups.append(",".join(str(i) for i, at in zip(x, xe) if lo < at <= e) + "|" + ",".join(str(i) for i, at in zip(y, ye) if lo < at <= e))
            links.append((x[xe.index(e)], y[ye.index(e)]))
            lo = e
        count.update(links)
        aligned.append((doc, (len(x), len(y), groups, links)))
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for doc, got in aligned:
        if got is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = got
            out.append((doc, n_a, n_b, len(groups), len(links), sum(count[k] == best[k[1]] for k in links), sum(count[k] for k in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return Counter(out)


def rows_of(df):
    return Counter(tuple(r) for r in align.align_documents(df).collect())


@pytest.mark.parametrize("block,slice_", [(align.BLOCK, align.SLICE), (3000, 40)])
def test_odd_texts(spark, monkeypatch, block, slice_):
    monkeypatch.setattr(align, "BLOCK", block)
    monkeypatch.setattr(align, "SLICE", slice_)
    data = [(i % 17 if i != 5 else None, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({"block": F.lit("b"), "n": F.lit(None).cast("int"), "uid": F.lit(1)})
    assert rows_of(df) == brute(data)
    assert align.align_documents(df.limit(0)).count() == 0


def test_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    assert rows_of(df) == brute([tuple(r) for r in df.collect()])


def test_long_text(spark, sf):
    """A text of many slices, which share one document row."""
    text = " ".join(r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(120).collect() if r["text"])
    assert len(text) > align.SLICE
    data = [(1, text), (2, text[:5000])]
    got = align.align_documents(spark.createDataFrame(data, "doc_id long, text string")).collect()
    two = align.pair(A, B)
    by = {r.doc_id: r for r in got}
    assert (by[1].n_a, by[1].n_b) == (len(two.a.encode(f" {text}", add_special_tokens=False).ids), len(two.b.encode(text)))
    assert by[2].n_groups == by[2].n_links > 0 and len(got) == 2


def test_cut_at_words(tmp_path):
    assert align.cut_at_words(A, B)
    assert [x for s in align.slices("a  b c  d▁ e 'f", True) for x in s] == ["a  b", "c  d▁ e", "'f"]
    assert list(align.slices("a b", False)) == [["a b"]]


def test_ranks_are_the_merges(spark, sf):
    """The encoder by ranks gives what the merges give."""
    two = align.pair(A, B)
    texts = [t for t in ODD if t] + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r["text"]]
    assert two.ranks is not None and [two.ranks.encode_ordinary(f" {t}") for t in texts] == [e.ids for e in two.a.encode_batch([f" {t}" for t in texts], add_special_tokens=False)]
