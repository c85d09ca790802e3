"""Output layouts and the files that are written by them."""

import os
import random
import re
from collections import defaultdict

import pytest

from larkspur.operators import layout
from larkspur.sources import file_sink


def plain(paths):
    """Names of their own stay; the others take the free numbers in the order of their paths."""
    groups = defaultdict(list)
    for p in sorted(paths):
        groups[p.rsplit("/", 1)[-1]].append(p)
    out = {}
    for name, members in groups.items():
        stem, ext = re.fullmatch(r"(?s)(.+?)(\.[^./]*)?", name).groups()
        out[members[0]], k = name, 0
        for p in members[1:]:
            k += 1
            while f"{stem}_{k}{ext or ''}" in groups:
                k += 1
            out[p] = f"{stem}_{k}{ext or ''}"
    return out


@pytest.mark.parametrize("seed", range(4))
def test_flattened_names(spark, seed):
    rng = random.Random(seed)
    names = ["a.txt", "a_1.txt", "a_2.txt", "a_4.txt", "a_1_1.txt", "b", "b_1", ".hid", "x.tar.gz", "x.tar_1.gz", "a_01.txt", "é.csv"]
    paths = sorted({f"d{rng.randrange(40)}/{rng.choice(names)}" for _ in range(150)})
    rows = spark.createDataFrame([(p,) for p in paths] + [(None,)], "path string").repartition(3)
    got = {r.path: r.target for r in layout.output_targets(rows, "flattened", stamp="20240101_000000").collect()}
    assert len(got) == len(set(got.values())) == len(paths)
    assert got == {p: f"flattened_structure/20240101_000000/{t}" for p, t in plain(paths).items()}


def test_maintained_and_categorized(spark):
    paths = ["/in/a/x.txt", "/in/y.csv", "/else/z.py", "/in/b/x.txt"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    kept = {r.path: r.target for r in layout.output_targets(rows, "maintained", "/in", "s").collect()}
    assert kept == {"/in/a/x.txt": "maintained_structure/s/a/x.txt", "/in/y.csv": "maintained_structure/s/y.csv", "/else/z.py": "maintained_structure/s/z.py", "/in/b/x.txt": "maintained_structure/s/b/x.txt"}
    sorted_ = {r.path: r.target for r in layout.output_targets(rows, "categorized").collect()}
    folders = {p: t.split("/")[1] for p, t in sorted_.items()}
    assert folders["/in/a/x.txt"] == folders["/in/b/x.txt"] != folders["/else/z.py"] and len(set(sorted_.values())) == 4
    with pytest.raises(ValueError):
        layout.output_targets(rows, "other")


def test_written_files(spark, tmp_path):
    files = [(f"in/{i % 7}/f{i % 3}.txt", f"text {i}".encode()) for i in range(21)]
    rows = spark.createDataFrame(files, "path string, content binary").repartition(5)
    named = layout.output_targets(rows.select("path"), "flattened").join(rows, "path")
    file_sink.write_files(named, f"file://{tmp_path}/out")
    want = {r.target: bytes(r.content) for r in named.collect()}
    held = lambda: {os.path.relpath(os.path.join(d, n), tmp_path / "out"): open(os.path.join(d, n), "rb").read() for d, _, ns in os.walk(tmp_path / "out") for n in ns}
    assert held() == want and len(want) == 21 and not (tmp_path / "out" / ".staging").exists()
    one = spark.createDataFrame([(next(iter(want)), b"new"), ("more/empty", None)], "target string, content binary")
    file_sink.write_files(one, str(tmp_path / "out"))
    assert held() == want | {"more/empty": b""}
    file_sink.write_files(one, str(tmp_path / "out"), overwrite=True)
    assert held()[next(iter(want))] == b"new"
    with pytest.raises(Exception, match="below the root"):
        file_sink.write_files(spark.createDataFrame([("ok", b"1"), ("../up", b"2")], "target string, content binary"), str(tmp_path / "bad"))
    assert not [n for _, _, ns in os.walk(tmp_path / "bad") for n in ns]


def test_a_task_that_runs_twice_leaves_one_file(tmp_path):
    writer = file_sink.FileWriter(str(tmp_path), False)
    first = writer.write(iter([{"target": "a/x", "content": b"lost"}, {"target": "a/y", "content": b"lost"}]))
    second = writer.write(iter([{"target": "a/x", "content": b"kept"}]))
    assert first.folder != second.folder and not (tmp_path / "a").exists()
    writer.commit([second, None])
    assert [p.name for p in (tmp_path / "a").iterdir()] == ["x"] and (tmp_path / "a" / "x").read_bytes() == b"kept" and not (tmp_path / ".staging").exists()
    again = file_sink.FileWriter(str(tmp_path), True)
    again.abort([again.write(iter([{"target": "z", "content": b"1"}]))])
    assert sorted(os.listdir(tmp_path)) == ["a"]
