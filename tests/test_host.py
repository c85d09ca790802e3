"""The driver's side: settings, files, reports, logs, operations; prompts and photos."""

import json
import logging
import struct

import numpy as np
import pytest

from larkspur import host
from larkspur.operators import images, photos, prompts
from larkspur.registry import registry


def test_settings(tmp_path):
    path = tmp_path / "a" / "config.json"
    path.parent.mkdir()
    path.write_text('{"ai": {"model": "m"}, "own": 1}')
    s = host.Settings([tmp_path / "none.json", path])
    assert s.path == path and s.get("ai.model") == "m" and s.get("ai.timeout") == 120 and s.get("own") == 1 and s.get("ai.no.such", 5) == 5
    s.set("x.y.z", [1])
    s.save(tmp_path / "b" / "c.json")
    assert json.loads((tmp_path / "b" / "c.json").read_text())["x"] == {"y": {"z": [1]}} and host.DEFAULTS["ai"]["model"] == "mistral"
    assert s.ai_errors() == []
    s.set("ai.base_url", "ftp://x")
    s.set("ai.provider", "")
    assert s.ai_errors() == ["missing provider", "not an http address: ftp://x"]
    s.set("ai.enabled", False)
    assert s.ai_errors() == [] and host.Settings().get("conversion.default_format") == "txt"


def test_files(tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "d" / "e" / "b")
    assert not host.transfer(a, b)
    (tmp_path / "a").write_bytes(b"x" * 10)
    assert host.transfer(a, b) and not host.transfer(a, b) and host.transfer(a, b, overwrite=True)
    assert host.backup(a) == a + ".bak" and host.backup(a, str(tmp_path / "f"), ".old").endswith("f/a.old") and host.backup("none") is None
    assert list(host.read_chunks(a, 4)) == [b"xxxx", b"xxxx", b"xx"]
    assert host.transfer(a, str(tmp_path / "moved"), move=True) and not (tmp_path / "a").exists()
    assert host.temporary(".txt", str(tmp_path)).endswith(".txt")


def test_reports_and_logs(tmp_path):
    def broken():
        raise OSError("down")

    report = host.health_report({"good": lambda: [], "bad": lambda: ["issue"], "broken": broken}, tmp_path / "r" / "health.json")
    assert report["summary"] == {"total_checks": 3, "passed_checks": 1, "failed_checks": 2, "all_passed": False} and report["checks"]["broken"]["issues"] == ["OSError: down"]
    assert json.loads((tmp_path / "r" / "health.json").read_text())["checks"] == report["checks"]
    record = logging.LogRecord("n", logging.INFO, "f", 1, "hello %s", ("you",), None)
    record.user = 7
    line = json.loads(host.JsonLines().format(record))
    assert (line["message"], line["level"], line["user"]) == ("hello you", "INFO", 7)
    got = host.status()
    assert "token_counts" in got["operators"]["text"] and got["disk"]["total"] > 0 and got["memory_mb"] > 0


def test_operations(tmp_path):
    ops, seen = host.Operations(), []
    ops.kind("double", lambda input: 2 * input)
    ops.on_completion("one", lambda r: 1 / 0)
    ops.on_completion("one", seen.append)
    assert ops.run("one", "double", input=4)["result"] == 8 and seen[0]["success"] and ops.run("two", "none")["error"] == "unknown operation type: none"
    out = ops.batch([{"kind": "double", "input": 3}, {"kind": "double"}, {"kind": "odd", "input": 1}])
    assert (out["total_operations"], out["successful_operations"], out["failed_operations"]) == (3, 1, 2) and out["operations"][0]["result"] == 6 and out["operations"][1]["error"]
    ops.snapshot(tmp_path / "s.json")
    assert len(json.loads((tmp_path / "s.json").read_text())["completed_operations"]) == 4


def test_execution_records(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    got = registry.execute("token_counts", df)
    assert got["success"] and got["rows"] == 1 and not registry.execute("token_counts", df, none=1)["success"]
    assert registry.stats("token_counts")["executions"] >= 2 and 0 < registry.stats("token_counts")["success_rate"] < 100
    spark.udf.register("slow_text", lambda t: __import__("time").sleep(20) or t)
    slow = registry.execute("token_counts", df.selectExpr("doc_id", "slow_text(text) AS text"), timeout_s=1.0)
    assert not slow["success"] and "timed out" in slow["error"] and slow["seconds"] < 15
    own = registry.export("top_words")
    assert own["parameters"]["n"] == {"type": "int", "required": False, "default": "10"} and own["returns"]["type"] == "DataFrame" and own["category"] == "text"


def test_batches_of_a_stream(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    host.notify(stream, seen.append).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sum(x["rows"] for x in seen) == 5


def test_prompts(spark):
    df = spark.createDataFrame([("f", "text {x}", "q"), (None, None, "r")], "file_path string, content string, other string")
    got = [r["prompt"] for r in prompts.prompts(df, "code_analysis").collect()]
    assert got[0].endswith("\n\ntext {x}") and "code from f," in got[0] and got[1].endswith("\n\n")
    assert prompts.prompts(df, "mine", {"mine": "{{{other}}}"}).first()["prompt"] == "{q}" and prompts.parameters("{b}{a}{b}") == ["b", "a"]
    with pytest.raises(ValueError, match="file_type"):
        prompts.prompts(df, "file_conversion")
    with pytest.raises(ValueError, match="unknown"):
        prompts.prompts(df, "code_analysis", {"mine": ""})
    with pytest.raises(ValueError):
        prompts.parameters("{}")


def tiff(order):
    """Two directories with texts, fractions and a position."""
    p = lambda form, *v: struct.pack(order + form, *v)
    entry = lambda tag, kind, n, raw: p("HHI", tag, kind, n) + raw
    main = 8
    data = 200
    blob = b"Camera\0\0" + p("II", 1, 250) + p("IIIIII", 52, 1, 30, 1, 0, 1) + b"2024:01:01 00:00:00\0"
    at = lambda off: p("I", data + off)
    first = [entry(0x010F, 2, 7, at(0)), entry(0x0132, 2, 20, at(40)), entry(0x8769, 4, 1, p("I", 80)), entry(0x8825, 4, 1, p("I", 140)), entry(0x0100, 3, 1, p("HH", 5, 0))]
    photo = [entry(0x829A, 5, 1, at(8)), entry(0x8827, 3, 1, p("HH", 400, 0))]
    gps = [entry(2, 5, 3, at(16)), entry(1, 2, 2, b"N\0\0\0")]
    pack = lambda es: p("H", len(es)) + b"".join(es) + p("I", 0)
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + p("I", main))
    for where, es in ((main, first), (80, photo), (140, gps)):
        out += b"\0" * (where - len(out)) + pack(es)
    return bytes(out + b"\0" * (data - len(out)) + blob)


@pytest.mark.parametrize("order", ["<", ">"])
def test_photos(spark, order):
    block = tiff(order)
    want = {"Make": "Camera", "DateTime": "2024:01:01 00:00:00", "ExposureTime": "0.004", "ISOSpeedRatings": "400", "GPSLatitude": "52,30,0", "GPSLatitudeRef": "N"}
    jpeg = b"\xff\xd8\xff\xe0\0\4ab" + b"\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block + b"\xff\xd9"
    assert photos.exif(block) == photos.exif(jpeg) == want and photos.exif(b"\xff\xd8\xff\xd9") == photos.exif(b"") == {}
    files = spark.createDataFrame([("a.jpg", jpeg), ("b.tif", block[:150]), ("c", None)], "path string, content binary")
    got = {r["path"]: r for r in photos.photo_info(files).collect()}
    assert got["a.jpg"]["info"] == {"camera_make": "Camera", "capture_date": "2024:01:01 00:00:00", "exposure_time": "0.004", "iso": "400", "gpslatitude": "52,30,0"} and got["c"]["info"] == {}


def test_image_steps(spark):
    x = np.random.default_rng(3).integers(0, 256, (4, 5, 3), dtype=np.uint8)
    df = spark.createDataFrame([(("o", 4, 5, 3, 16, bytearray(x.tobytes())),)], "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    got = images.image_steps(df, [("invert", {}), ("none", {}), ("upscale", {"factor": 3, "method": "nearest"}), ("upscale", {"factor": "x"})]).orderBy("index").collect()
    assert [(r["status"], r["height"]) for r in got] == [("success", 4), ("failed", 4), ("success", 12), ("failed", 12)] and got[1]["error"] == "Tool not found: none"
    assert bytes(got[0]["data"]) == (255 - x).tobytes()
