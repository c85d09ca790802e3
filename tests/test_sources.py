"""Files, pages, images and workbooks."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import images
from larkspur.sources import files, html, sinks


def test_texts_and_tables(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Café".encode())
    (tmp_path / "b.TXT").write_bytes("Café".encode("latin-1"))
    (tmp_path / "c.csv").write_text("name,age\nx,1\ny,\n")
    got = {r["name"]: r["content"] for r in files.read_texts(spark, str(tmp_path), ["txt"]).collect()}
    assert got == {"a.txt": "Café", "b.TXT": "Café"}
    assert [r["text"] for r in files.read_delimited_as_text(spark, str(tmp_path / "c.csv")).collect()] == ["x | 1", "y | "]


def test_page():
    p = html.parse(1, "http://a.com/x/", '<html lang="en"><title>T</title><meta name="description" content="d"><!-- <h1> --><script>var a="</p><h1>";</script><h1>H</h1><p>one<p>two &amp; <a href="/y">l</a><a href="mailto:q">m</a><img src=i alt=z>')
    assert (p["title"], p["description"], p["lang"], dict(p["headings"]), p["images_with_alt"]) == ("T", "d", "en", {"h1": 1}, 1)
    assert p["links"] == [{"href": "http://a.com/y", "text": "l", "relative": True, "internal": True}]
    assert html.parse(2, None, None)["text"] == ""


def test_images(spark):
    x = np.zeros((10, 20, 3), np.uint8)
    x[:, :, 2] = 255  # blue first: red
    df = spark.createDataFrame([(("o", 10, 20, 3, 16, bytearray(x.tobytes())),)], "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    r = images.image_stats(df).first()
    assert (r["aspect"], r["mean"], r["dominant"], sum(r["histogram"])) == ("2:1", [255.0, 0.0, 0.0], ["#e00000"], 200)
    red = images.rgb(10, 20, 3, x.tobytes())
    for name, fn in images.ENHANCE.items():
        assert fn(red, 1.2).shape[:2] == red.shape[:2], name
    assert (images.ENHANCE["blur"](red, 1.2) == red).all() and images.resize(red, 3).shape == (30, 60, 3)


def test_workbook(spark):
    data = sinks.xlsx(spark.createDataFrame([(1, "a<b"), (2, None)], "n int, t string"))
    sheet = zipfile.ZipFile(io.BytesIO(data)).read("xl/worksheets/sheet1.xml").decode()
    assert sheet.count("<row>") == 3 and "a&lt;b" in sheet


def test_page_parts():
    p = html.parse(1, "http://a.com/x/", '<meta name="k" content="1"><meta property="k" content="2"><meta name="e" content=""><h2> A <b>b</b></h2><h3> </h3><img src="i.png" width=3><img alt="no source"><a href="http://[bad">z</a>')
    assert (p["meta"], p["heading_texts"]) == ([("k", "2")], [{"level": "h2", "text": "A b"}])
    assert p["image_list"] == [{"src": "http://a.com/x/i.png", "alt": "", "title": "", "width": "3", "height": ""}]
    assert p["links"][0]["href"] == "http://[bad"


def _docx() -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>".format
    row = "<w:tr>" + "".join(f"<w:tc>{p(x)}</w:tc>" for x in ("a", " ", "b")) + "</w:tr>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{p("one")}<w:tbl>{row}</w:tbl>{p(" ")}{p("two")}</w:body></w:document>')
    return out.getvalue()


def test_ingest(spark, tmp_path):
    from larkspur.sources import ingest

    files_ = {"a.txt": "Café".encode("latin-1"), "b.csv": b"n,v\nx,1\n\n", "c.json": b'{"a": {"b": [1, null]}, "c": {}}', "d.docx": _docx(), "e.docx": b"no archive", "f.TSV": b"p\tq\n", "g.html": b"<p>one</p>\n<script>x</script>two", "h.up": b"abc"}
    for name, data in files_.items():
        (tmp_path / name).write_bytes(data)
    ingest.register_reader("UP", lambda b: b.decode().upper())
    try:
        rows = {r["path"].rsplit("/", 1)[1]: (r["text"], r["error"]) for r in ingest.read_documents(spark, str(tmp_path)).collect()}
    finally:
        del ingest.READERS[".up"]
    assert {k: v[0] for k, v in rows.items()} == {"a.txt": "Café", "b.csv": "n | v\nx | 1", "c.json": "a: b[0]: 1\na: b[1]: None", "d.docx": "one\ntwo\na | b", "e.docx": None, "f.TSV": "p | q", "g.html": "one\ntwo", "h.up": "ABC"}
    assert "BadZipFile" in rows["e.docx"][1] and not any(v[1] for k, v in rows.items() if k != "e.docx")
    small = ingest.read_documents(spark, str(tmp_path), ["CSV"], most_bytes=3).collect()
    assert [(r["text"], r["error"]) for r in small] == [(None, "file too large")]
    docs = spark.createDataFrame([("p", "Some words. " * 200), ("q", None), ("r", "  ")], "path string, text string")
    assert {r["path"] for r in ingest.ingest(docs).collect()} == {"p"}


def test_csv_ladder(spark, tmp_path):
    from larkspur.sources import tables

    (tmp_path / "a.csv").write_bytes("name,café\nx,1\n\ny,2,too many\nz\n".encode("latin-1"))
    (tmp_path / "b.csv").write_bytes(b"\xef\xbb\xbfp,q\n1,\"2,\n3\"\n")
    (tmp_path / "empty.csv").write_bytes(b"")
    rows = tables.read_csv(spark, str(tmp_path)).collect()
    got = {(r["path"].rpartition("/")[2], r["line"]): r for r in rows}
    assert [got["a.csv", i]["cells"] for i in range(3)] == [["x", "1"], [None, None], ["z", None]] and len(rows) == 4
    assert got["a.csv", 0]["names"] == ["name", "café"] and got["a.csv", 0]["encoding"] == "latin-1" and got["b.csv", 0]["cells"] == ["1", "2,\n3"]
    bare = tables.read_csv(spark, str(tmp_path / "b.csv"), header=False).collect()
    assert [r["cells"] for r in bare] == [["p", "q"], ["1", "2,\n3"]] and bare[0]["names"] == ["0", "1"]
    stats = tables.conversion_stats(tables.read_csv(spark, str(tmp_path)).selectExpr("*", "100 AS input_size", "150 AS output_size")).orderBy("path").collect()
    assert [(r["rows"], r["columns"], r["change_percent"]) for r in stats] == [(3, 2, 50.0), (1, 2, 50.0)]
    assert [tables.guess_encoding(x) for x in (b"abc", "é".encode(), "é".encode("latin-1") + b"a", "漢".encode()[:2], b"\xff\xfea\0")] == ["ascii", "utf-8", "unknown", "utf-8", "utf-16"]


def test_directory_tree(spark, tmp_path):
    import os

    from larkspur.sources.directories import check_directory, scan

    for name in ("a/b/c/d/deep.TXT", "a/x.py", "top.txt", "a/b/y.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("12345")
    os.symlink(tmp_path / "a", tmp_path / "loop")
    os.symlink(tmp_path / "nowhere", tmp_path / "broken")
    want = {os.path.relpath(os.path.join(d, n), tmp_path) for d, ds, fs in os.walk(tmp_path) for n in ds + fs} - {"broken"}
    rows = {os.path.relpath(r["path"], tmp_path): r for r in scan(spark, str(tmp_path)).collect()}
    assert set(rows) == want and rows["a/b/c/d/deep.TXT"]["extension"] == ".txt" and rows["a/b/c/d/deep.TXT"]["size"] == 5 and rows["loop"]["is_symlink"] and rows["a"]["size"] == 0
    names = lambda **k: sorted(r["name"] for r in scan(spark, str(tmp_path), **k).collect())
    assert names(pattern="*.t?t", folders=False) == ["top.txt", "y.txt"] and names(recursive=False) == ["a", "loop", "top.txt"]
    assert names(max_depth=2, files=False) == ["a", "b", "loop"] and scan(spark, str(tmp_path / "none")).count() == 0
    assert check_directory(str(tmp_path))["valid"] and check_directory(str(tmp_path / "top.txt"))["errors"] == ["Path is not a directory"]
    assert check_directory(str(tmp_path / "no"))["errors"] and check_directory(str(tmp_path / "no"), must_exist=False)["valid"]


def test_directory_conditions_are_pushed_down(spark, tmp_path, monkeypatch):
    """Conditions give the rows that they give on the whole table; folders that none can lie in are not opened."""
    import os

    from larkspur.sources import directories

    for name in ("a/b/one.csv", "a/b/two.CSV", "a/b/none", "a/c/one.csv", "d/e/f/one.csv", "d/top.py", "x.csv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("1" * len(name))
    every = directories.scan(spark, str(tmp_path)).collect()
    tests = {"extension = '.csv'": lambda r: r.extension == ".csv", "extension = ''": lambda r: r.extension == "", "size > 9 and is_file": lambda r: r.size > 9 and r.is_file, "depth <= 2": lambda r: r.depth <= 2, "depth = 3 and name like 'one%'": lambda r: r.depth == 3 and r.name.startswith("one"), f"parent = '{tmp_path}/a/b'": lambda r: r.parent == f"{tmp_path}/a/b", f"path like '{tmp_path}/a/%'": lambda r: r.path.startswith(f"{tmp_path}/a/"), "name in ('x.csv', 'top.py') or size < 0": lambda r: r.name in ("x.csv", "top.py"), "modified >= 1e9 and name like '%o%'": lambda r: "o" in r.name}
    for condition, test in tests.items():
        got = directories.scan(spark, str(tmp_path)).where(condition).select("path").collect()
        assert sorted(r.path for r in got) == sorted(r.path for r in every if test(r)), condition
    opened, looked = [], []
    entries, row = directories.entries, directories.row
    monkeypatch.setattr(directories, "entries", lambda p: opened.append(os.path.relpath(p, tmp_path)) or entries(p))
    monkeypatch.setattr(directories, "row", lambda e, d: looked.append(e.name) or row(e, d))
    reader = directories.TreeReader({"path": str(tmp_path), "splitdepth": "0"})
    rest = list(reader.pushFilters([directories.StringStartsWith(("path",), f"{tmp_path}/a/"), directories.EqualTo(("name",), "one.csv"), directories.EqualTo(("is_file",), None)]))
    found = [r[0] for part in reader.partitions() for r in reader.read(part)]
    assert sorted(found) == [f"{tmp_path}/a/{d}/one.csv" for d in "bc"] and len(rest) == 1
    assert sorted(set(opened)) == [".", "a", "a/b", "a/c"] and set(looked) == {"one.csv"}


def test_office_files(spark):
    from larkspur.sources import ingest, office

    text = [("heading1", "A (Title)"), ("normal", "word " * 300 + "café \\ end"), ("heading2", "NOTES:"), ("normal", "last")]
    pdf = office.write_pdf(text)
    pages = office.pdf_pages(pdf)
    assert " ".join(" ".join(pages).split()) == " ".join(" ".join(t for _, t in text).split()) and all(office.text_width(line) <= 612 for p in pages for line in p.split("\n"))
    assert len(office.pdf_pages(office.write_pdf([("normal", f"line {i}") for i in range(100)]))) == 3 and ingest.READERS[".pdf"](pdf).startswith("A (Title)")
    docx = office.write_docx(text)
    assert office.docx_paragraphs(docx) == [(s, t) for s, t in text] and ingest.docx(docx).startswith("A (Title)")
    there, method, _ = office.convert(docx, ".docx", ".pdf")
    back, again, _ = office.convert(there, ".pdf", ".docx")
    assert (method, again) == ("styled", "structured") and ("heading2", "NOTES:") in office.docx_paragraphs(back)
    assert office.convert(b"PK", ".docx", ".pdf")[0] is None and len(office.convert(b"PK", ".docx", ".pdf")[2]) == 3 and office.methods(".pdf", ".docx") == ["structured", "plain"]
    blank = office.convert(office.write_pdf([]), ".pdf", ".docx")
    assert blank[1] == "plain" and len(blank[2]) == 1
    files = spark.createDataFrame([("a.docx", docx), ("b.docx", b""), ("c.txt", b"x")], "path string, content binary")
    got = {r["path"]: r for r in office.convert_files(files, ".pdf").collect()}
    assert got["a.docx"]["method"] == "styled" and got["b.docx"]["warnings"] == ["File is empty"] and got["c.txt"]["output"] is None
    assert office.wrap("aa bb  cc", office.text_width("aa bb ")) == ["aa bb", "cc"] and office.wrap("", 10) == [] and office.wrap("wide", 1) == ["wide"]
    assert [office.paragraph_style(n) for n in ("Heading 1", "Title", "heading 3", "Body")] == ["heading1", "heading1", "heading2", "normal"]
    raw = b"BT /F1 12 Tf 72 700 Td [(Hel) -20 (lo) -300 (w\\157rld)] TJ 0 -14 Td <6162> Tj (x\\)y) ' ET"
    assert office._shown(raw) == "Hello world\nab\nx)y"


def test_enhancement(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (9, 7, 3), dtype=np.uint8)
    inner = lambda k, by, add, i, j, c: sum(k[a][b] * int(x[i - 1 + a, j - 1 + b, c]) for a in range(3) for b in range(3)) / by + add
    for name in ("sharpen", "edge_enhance", "smooth", "emboss", "find_edges"):
        k, by, add = images.KERNELS[name]
        out = images.convolve(x, name)
        for i, j, c in ((1, 1, 0), (4, 3, 1), (7, 5, 2)):
            assert out[i, j, c] == min(max(int(np.floor(inner(k, by, add, i, j, c) + 0.5)), 0), 255)
        assert (out[0] == x[0]).all() and (out[:, -1] == x[:, -1]).all()
    assert (images.ENHANCE["brightness"](x, 0.5) == x // 2).all() and (images.ENHANCE["contrast"](x, 1.0) == x).all() and (images.ENHANCE["color"](x, 0.0)[:, :, 0] == images.grey(x)).all()
    flat = images.ENHANCE["equalize"](np.full((4, 4, 3), 9, np.uint8), 1)
    assert (flat == 9).all() and images.ENHANCE["auto_contrast"](np.array([[[10], [20]]], np.uint8), 1).ravel().tolist() == [0, 255]
    for method in ("nearest", "bilinear", "bicubic", "lanczos"):
        assert (images.resize(np.full((5, 6, 3), 77, np.uint8), 3, method) == 77).all() and images.resize(x, 2, method).shape == (18, 14, 3)
    step = images.resize(np.array([[[0], [0], [0], [255], [255], [255]]], np.uint8), 2, "bicubic")[0, :, 0]
    assert step[0] == 0 and step[-1] == 255 and step.tolist() == [0, 0, 0, 0, 0, 30, 225, 255, 255, 255, 255, 255] or (np.diff(step.astype(int)) >= 0).all()
    tone = images.hsv(np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [9, 9, 9]]], np.uint8))[0]
    assert tone.tolist() == [[0, 255, 255], [85, 255, 255], [170, 255, 255], [0, 0, 9]]


def test_image_operators(spark):
    x = np.random.default_rng(2).integers(0, 256, (6, 8, 3), dtype=np.uint8)
    rows = [("d/a.png", 6, 8, 3, 16, bytearray(x.tobytes())), ("b.jpg", 6, 8, 1, 0, bytearray(x[:, :, 0].tobytes())), ("bad", -1, -1, -1, -1, bytearray(b""))]
    df = spark.createDataFrame([((o, h, w, c, m, d),) for o, h, w, c, m, d in rows], "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    got = {r["origin"]: r for r in images.enhance(df, ["grayscale", "unknown", "invert", "blur"]).collect()}
    assert got["d/a.png"]["output"] == "d/a_enhanced_grayscale_unknown_invert.png" and got["d/a.png"]["applied"] == ["grayscale", "invert", "blur"] and got["d/a.png"]["channels"] == 1 and len(got) == 2
    assert got["b.jpg"]["improvement_rating"] in images.RATINGS and got["b.jpg"]["colourfulness_change_percent"] is None
    big = images.upscale(df, [2, 4], ["nearest", "lanczos"], "PNG").collect()
    assert len(big) == 8 and {(r["factor"], r["height"]) for r in big} == {(2, 12), (4, 24)} and {r["output"] for r in big if r["factor"] == 2} == {"d/a_x2.png", "b_x2.png"} and big[0]["pixel_growth"] == 4.0
    with pytest.raises(ValueError):
        images.upscale(df, [9])
    stats = {r["origin"]: r for r in images.image_stats(df).collect()}
    assert stats["b.jpg"]["hsv_mean"][1] == 0 and stats["d/a.png"]["least"] == x[:, :, ::-1].min(axis=(0, 1)).tolist()
    batch = images.image_batch(spark.createDataFrame([(True, 2.0, "good"), (True, 1.0, "odd"), (False, 9.0, "excellent"), (None, None, None)], "success boolean, megapixels double, quality string")).first()
    assert tuple(batch) == (4, 2, 2, 3.0, 2.0)


def test_collections(spark, tmp_path):
    from larkspur.operators import index

    (tmp_path / "docs").mkdir()
    for i, t in enumerate(["apples and pears grow on trees in the orchard behind the house", "engines burn fuel and pistons move the heavy shaft of the machine", "apples are pressed into cider in autumn by the people of the village"]):
        (tmp_path / "docs" / f"{i}.txt").write_text(t)
    c = index.quick_setup(spark, str(tmp_path / "docs"), f"file://{tmp_path}/store", "fruit")
    assert c.names() == ["fruit"] and c.stats("fruit")["document_count"] == 3 and c.stats("fruit")["embedding_dimension"] == 64 and c.stats("fruit")["metadata_fields"] == ["chunk", "source"]
    asked = spark.createDataFrame([(1, "apples and pears grow on trees"), (2, "engines burn fuel"), (3, None)], "query_id long, text string")
    hits = c.query("fruit", asked, 2).collect()
    best = {r["query_id"]: r for r in hits if r["rank"] == 1}
    assert "pears" in best[1]["document"] and "engines" in best[2]["document"] and best[1]["distance"] == pytest.approx(1 - best[1]["similarity"]) and len(hits) == 6 and best[3]["similarity"] is None
    assert [r["document"][:6] for r in c.query("fruit", asked.where("query_id = 1"), 5, contains="cider").collect()] == ["apples"]
    assert c.query("fruit", asked, 5, F.expr("metadata['source'] LIKE '%1.txt'"), include=("metadata",)).columns == ["query_id", "rank", "id", "metadata"]
    rows = spark.createDataFrame([("a", "old", {"k": "1"}, [1.0, 0.0], 1), ("a", "new", {"k": "2"}, [0.0, 1.0], 2), ("b", "x", None, [1.0, 1.0], 1), (None, "y", None, [2.0, 0.0], 1)], "id string, text string, metadata map<string,string>, embedding array<double>, v int")
    assert c.create("other", {"space": "l2"}) and not c.create("other") and c.about("other") == {"space": "l2"} and c.get("other").count() == 0
    assert c.upsert("other", rows, "v") == 3 and {r["id"]: r["text"] for r in c.get("other").collect() if r["id"] in "ab"} == {"a": "new", "b": "x"}
    assert c.upsert("other", rows.where("id = 'b'").withColumn("text", F.lit("z"))) == 1 and sorted(r["text"] for r in c.get("other").collect()) == ["new", "y", "z"]
    assert c.delete("other") and not c.delete("other") and c.names() == ["fruit"] and c.stats("other")["document_count"] == 0
    with pytest.raises(ValueError):
        c.create("../up")
    near = c.query("fruit", spark.createDataFrame([(7, [0.0] * 64)], "query_id long, embedding array<double>"), 1).collect()
    assert near[0]["similarity"] is None


def test_batches(spark):
    from larkspur.operators import batches

    df = spark.createDataFrame([(i,) for i in range(5)], "n long")
    out = batches.batch_map(df, lambda n: 10 // (n - 2), "n", "long")
    got = {r["n"]: (r["status"], r["result"], r["error"]) for r in out.collect()}
    assert got[2][0] == "failed" and "division" in got[2][2] and got[4] == ("success", 5, None)
    counts = batches.batch_counts(batches.batch_map(df, lambda n: str(1 / n), "n", mode="serial")).first()
    assert (counts["processed"], counts["successful"], counts["failed"], counts["errors"]) == (5, 4, 1, ["division by zero"])
    with pytest.raises(ValueError):
        batches.batch_map(df, str, "n", mode="magic")
    files = spark.createDataFrame([("/in/x/a.DOCX", ".DOCX"), ("/in/b.csv", ".csv"), ("/else/c.docx", ".docx")], "path string, extension string")
    there = spark.createDataFrame([("out/x/a.pdf",)], "path string")
    plan = {r["path"]: (r["output"], r["action"]) for r in batches.conversion_plan(files, "/in/", ".pdf", "out", there).collect()}
    assert plan == {"/in/x/a.DOCX": ("out/x/a.pdf", "skip"), "/in/b.csv": ("out/b.pdf", "unsupported"), "/else/c.docx": ("out/c.pdf", "convert")}
    assert {r["action"] for r in batches.conversion_plan(files, "/in", "pdf", "out", there, overwrite=True).collect()} == {"convert", "unsupported"}


def test_ip_literals_against_python(spark):
    import ipaddress

    from larkspur.operators.web import ip_literals

    hosts = ["1.2.3.4", "256.1.1.1", "01.2.3.4", "1.2.3", "::", "::1", "1::", "fe80::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7::", "1::2::3", "12345::", ":1", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "g::", "a.com", "", ":::", "1:", "::1.2.3.4:5"]

    def kind(h):
        try:
            return f"ipv{ipaddress.ip_address(h).version}"
        except ValueError:
            return "name"

    got = {r["host"]: r["kind"] for r in ip_literals(spark.createDataFrame([(h,) for h in hosts], "host string")).collect()}
    assert got == {h: kind(h) for h in hosts}


def test_page_parts_and_issues(spark):
    from larkspur.operators import web
    from larkspur.sources.html import parse_pages

    pages = spark.createDataFrame([(1, "http://a.com", "<html><title>" + "t" * 40 + "</title><img src=x><img src=y alt=z></html>"), (2, "http://b.com", "")], "page_id long, url string, html string")
    parsed = parse_pages(pages)
    assert web.extract(parsed, ["links", "title", "nothing", "title"]).columns == ["page_id", "url", "links", "title"]
    got = {r["page_id"]: r["issues"] for r in web.seo_issues(parsed).collect()}
    assert got == {1: ["Missing meta description", "Only 50% of images have alt"], 2: ["Missing title", "Missing meta description"]}


@pytest.mark.parametrize("name", ["page_title", "page_text", "page_headings", "page_grade", "web_pipeline"])
def test_cut_references_stay_as_they_are(spark, tmp_path, name):
    """Pages whose text was cut within a reference, against the SQL."""
    import duckdb

    from larkspur.queries import ORACLE_SQL, QUERIES

    tails = ["&amp", "&am", "&a", "&quot", "&lt", "&#39", "&", "&amp;", "&amp;lt;", "&quot;&copy;&middot;&#39;", "&ampx;", "&notit;", "&copy2", "&;"]
    page = lambda x: f"<html lang=\"en\"><title>{'t' * 25}{x}</title><h1>a{x}</h1><p>{'word ' * 99}{x}</p></html>"
    rows = [(i, f"http://example.com/{i}", page(x)) for i, x in enumerate(tails)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL[name])
    assert sorted(map(tuple, got.select([d[0] for d in want.description]).collect())) == sorted(want.fetchall())
