"""Delimited files cut into ranges give the rows of the whole file."""

import random

import pytest
from pyspark.sql import functions as F

from larkspur.sources import splits, tables

QUOTED = '\n\nname,"long, text",n\r\na,"one\ntwo ""quoted"",\n",1\n\nb,,2,too,many\nc,"x\n\ny"\n"d\n""\n""",plain "in" middle,3\re,é,4\nlast,"no end\nhere'


def expected(data, header=True, sep=","):
    text, used = tables.decode(data)
    rows = list(tables.cells(text, sep))
    names = [c or f"Unnamed: {j}" for j, c in enumerate(rows[0])] if header and rows else None
    return [(used, i, names or list(map(str, range(len(r)))), r) for i, r in enumerate(rows[1:] if header else rows)]


def got(spark, path, **options):
    return sorted((r.encoding, r.line, r.names, r.cells) for r in tables.read_csv(spark, str(path), **options).collect())


def by_parts(data, size, sep=","):
    """The same without Spark: ranges of ``size`` bytes from the first row on, each under both beginnings."""
    class Held(splits.Part):
        def __init__(self):
            self.size = len(data)

        def bytes(self, start, end):
            return data[start : max(start, min(end, self.size))]

    part, rows, quoted = Held(), [], False
    for low in range(0, len(data), size):
        start, end = part.begin(low), part.begin(low + size)
        if start < end:
            rows += splits.whole_rows(part, start, end, sep, quoted, splits.plain)
            quoted = splits.looked_at(splits.plain(data[start:end]), sep, quoted)[1]
    return rows


def test_cut_at_every_byte():
    data = QUOTED.encode()
    for size in range(1, len(data) + 2):
        assert by_parts(data, size) == splits.table(splits.plain(data), ","), size


@pytest.mark.parametrize("seed", range(30))
def test_random_files_in_parts(seed, monkeypatch):
    monkeypatch.setattr(splits, "STEP", 3)
    rng = random.Random(seed)
    data = "".join(rng.choice(['"', '""', ",", "\n", "\r\n", "a", "b c", "\n\n", '"x\ny"', "é"]) for _ in range(60)).encode()
    for size in (1, 2, 5, 17, 64):
        assert by_parts(data, size) == splits.table(splits.plain(data), ","), (seed, size)


@pytest.mark.parametrize("split", [1, 7, 40, 1 << 20])
def test_ranges_on_spark(spark, tmp_path, split):
    files = {"q.csv": QUOTED.encode(), "latin.csv": "a,b\né,1\n".encode("latin-1") * 9, "bom.csv": b"\xef\xbb\xbfa,b\n1,2\n", "empty.csv": b"", "blank.csv": b"\n\n\n", "one.csv": b"only,names", "marked.csv": "é;x\n".encode() * 3}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = tables.read_csv(spark, str(tmp_path), split=split).withColumn("name", F.element_at(F.split("path", "/"), -1)).collect()
    for name, data in files.items():
        mine = sorted((r.encoding, r.line, r.names, r.cells) for r in rows if r.name == name)
        assert mine == expected(data), name


def test_without_header_and_other_encodings(spark, tmp_path):
    (tmp_path / "a.tsv").write_bytes(b"\nx\ty\n1\t2\n")
    assert got(spark, tmp_path / "a.tsv", sep="\t", header=False, split=3) == expected(b"\nx\ty\n1\t2\n", False, "\t")
    (tmp_path / "wide.csv").write_bytes("a,b\n1,é\n".encode("utf-16"))
    assert got(spark, tmp_path / "wide.csv", encoding="utf-16") == [("utf-16", 0, ["a", "b"], ["1", "é"])]
