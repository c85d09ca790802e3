"""Text conditions by trigrams give the rows of a scan, and read less."""

import random

from larkspur.operators import grams, index

ROWS = "id string, text string, metadata map<string,string>, embedding array<double>"


def filled(spark, tmp_path, buckets=4):
    rng = random.Random(2)
    words = ["apple", "pear", "engine", "piston", "Ärger", "日本語", "a", "  ", "plum tree"]
    rows = [(f"r{i}", " ".join(rng.choice(words) for _ in range(rng.randrange(6))) if i % 17 else None, None, [1.0]) for i in range(120)]
    c = index.Collections(spark, f"file://{tmp_path}/store", buckets=buckets)
    c.upsert("c", spark.createDataFrame(rows, ROWS))
    return c


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_same_rows_as_a_scan(spark, tmp_path):
    c = filled(spark, tmp_path)
    text = grams.TextIndex(c, "c")
    everything = c.get("c").collect()
    for built in (False, True):
        for part in ("pear", "plum tree", "ge", "", "Ärger", "ärger", "日本語 ap", "none of these", "istone", "pple pe"):
            assert ids(text.contains(part)) == sorted(r["id"] for r in everything if r["text"] is not None and part in r["text"]), (built, part)
        assert text.refresh() == (0 if built else 4)
    found, rest = text.candidates("plum tree")
    assert rest == {} and 0 < found.count() < 120
    assert grams.TextIndex(c, "unknown").contains("x").count() == 0


def test_only_new_folders_are_indexed(spark, tmp_path):
    c = filled(spark, tmp_path)
    text = grams.TextIndex(c, "c")
    text.refresh()
    c.upsert("c", spark.createDataFrame([("r3", "a zebra crosses", None, [1.0])], ROWS))
    assert ids(text.contains("zebra")) == ["r3"]  # its bucket is scanned
    assert text.refresh() == 1 and text.refresh() == 0 and ids(text.contains("zebra")) == ["r3"]
    plan = text.postings([f"{f}-{b}" for b, f in text._folders().items()], ["zeb"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan or "EqualTo(gram" in plan
