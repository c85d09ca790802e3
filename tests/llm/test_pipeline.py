"""The pipeline's stages: odd columns, empty tables, and each stage against brute force on its own input."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from larkspur.llm import mixing, packing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def odd(docs):
    """Columns whose names need quoting, of types that hold others, with nulls, and names that operators use inside."""
    struct = F.when(F.col("doc_id") % 2 == 0, F.struct(F.col("doc_id").alias("in ner"), F.array(F.lit("x")).alias("`t`")))
    more = {"an extra": struct, "dot.ted": F.create_map(F.lit("k"), F.col("n_chars")), "ba`ck": F.lit(None).cast("decimal(20,3)"), "c0": F.current_timestamp(), "_lang": F.lit(1), "_text": F.lit("t"), "kept": F.lit(False), "nats": F.lit(0.5), "_copies": F.lit(7), "draw": F.lit(1), "_key": F.lit("k"), "tkey": F.lit(2), "fp": F.lit("f"), "_row": F.lit(1), "lower": F.lit(2.0), "rate": F.lit(9.0)}
    return docs.withColumns(more)


@pytest.mark.parametrize("stage", [s for s, _ in p.STAGES])
def test_stage_keeps_odd_columns(spark, sf, docs, odd, stage):
    fn = dict(p.STAGES)[stage]
    got, plain = fn(spark, odd, sf), fn(spark, docs, sf)
    if stage != "packing":
        assert got.columns == odd.columns and got.schema["an extra"].dataType == odd.schema["an extra"].dataType
        assert Counter(map(tuple, got.select(*docs.columns).collect())) == Counter(map(tuple, plain.collect()))
        if stage != "substring_dedup":
            assert got.where("`an extra`['in ner'] <> doc_id").count() == 0
    else:
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, plain.collect()))


def test_empty_tables(spark, sf, docs, odd, tmp_path):
    for given in (docs, odd):
        now = given.limit(0)
        for name, fn in p.STAGES:
            now = fn(spark, now, sf)
            assert now.count() == 0, name
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
    docs.where("doc_id = 1").write.parquet(f"{tmp_path}/one/documents.parquet")
    assert p.run(spark, f"{tmp_path}/one").count() <= 3


def test_nulls_everywhere(spark, sf):
    rows = [(None, None, None, None, None)] * 3 + [(1, None, "en", "a", 3), (None, "word " * 80, None, None, None), (2, "", "en", None, 0)]
    now = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, fn in p.STAGES:
        now = fn(spark, now, sf)
        now.collect()


def test_stages_against_brute_force(spark, sf, docs):
    """Mixing takes whole documents at their source's rate; packing pads to the best bounds and fills its batches."""
    now = docs
    for name, fn in p.STAGES[:3]:
        now = fn(spark, now, sf)
    kept = {r["doc_id"]: r for r in now.collect()}
    assert len(kept) == now.count()  # one row an id is left
    mixed = dict(p.STAGES)["mixing"](spark, now, sf)
    rows = mixed.collect()
    times = Counter(r["doc_id"] for r in rows)
    assert all(tuple(r) == tuple(kept[r["doc_id"]]) for r in rows)
    size = {d: len(WORD.findall(r["text"])) for d, r in kept.items()}
    rates, _ = mixing.rated(now)
    rate = {r["source"]: r["rate"] for r in rates.collect()}
    assert all(times[d] in (int(rate[r["source"]]), int(rate[r["source"]]) + 1) for d, r in kept.items())
    packed = dict(p.STAGES)["packing"](spark, mixed, sf).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in packed) == Counter({(d, size[d]): n for d, n in times.items() if n})
    lengths = sorted(Counter(r["n_tokens"] for r in packed).items())
    bounds = packing.boundaries([x for x, _ in lengths], [n for _, n in lengths], packing.BUCKETS)
    for r in packed:
        assert r["bucket_tokens"] == next(b for b in bounds if b >= r["n_tokens"]) and r["padding"] == r["bucket_tokens"] - r["n_tokens"]
    for (bucket, batch), n in Counter((r["bucket"], r["batch"]) for r in packed).items():
        top = bounds[bucket]
        fit = max(1, packing.BUDGET // max(top, 1))
        full = sum(r["bucket"] == bucket for r in packed)
        assert n == min(fit, full - batch * fit)


def test_pipeline_is_its_stages(spark, sf, docs):
    got = Counter((r["doc_id"], r["n_tokens"], r["bucket"]) for r in p.run(spark, sf).collect())
    now = docs
    for _, fn in p.STAGES:
        now = fn(spark, now, sf)
    assert got == Counter((r["doc_id"], r["n_tokens"], r["bucket"]) for r in now.collect())
    assert quality.keep_good(docs).count() < docs.count()
