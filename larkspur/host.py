"""The driver's side: settings, files, health reports, logs, status, and operations with callbacks."""

from __future__ import annotations

import copy
import json
import logging
import os
import platform
import shutil
import sys
import tempfile
import time
from collections.abc import Callable, Iterator
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame

from .operators import batches, files, images, index, photos, prompts, records, text, vectors, web, workflow  # noqa: F401  they register themselves
from .registry import registry

#: Settings that are filled in where a file has none.
DEFAULTS = {
    "system": {"debug": False, "log_level": "INFO"},
    "ai": {"provider": "ollama", "model": "mistral", "base_url": "http://localhost:11434", "timeout": 120, "temperature": 0.7, "max_tokens": 2048, "enabled": True},
    "file_operations": {"default_input_dir": "./input", "default_output_dir": "./output", "backup_files": True, "max_file_size_mb": 100},
    "conversion": {"default_format": "txt", "preserve_structure": True, "overwrite_existing": False, "create_backups": True},
}


def merged(low: dict, high: dict) -> dict:
    """Both maps, inner ones merged too; ``high`` wins."""
    out = copy.deepcopy(low)
    for k, v in high.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


class Settings:
    """Settings of the first file that exists, over the defaults; JSON, and YAML where a reader for it is installed."""

    def __init__(self, paths: list[str | Path] = (), defaults: dict = DEFAULTS):
        self.path = next((Path(p) for p in paths if Path(p).exists()), None)
        self.values = merged(defaults, self._read(self.path) if self.path else {})

    @staticmethod
    def _read(path: Path) -> dict:
        text = path.read_text(encoding="utf-8")
        if path.suffix.lower() in (".yaml", ".yml"):
            import yaml

            return yaml.safe_load(text) or {}
        return json.loads(text)

    def get(self, dotted: str, default=None):
        node = self.values
        for part in dotted.split("."):
            if not isinstance(node, dict) or part not in node:
                return default
            node = node[part]
        return node

    def set(self, dotted: str, value) -> None:
        *outer, last = dotted.split(".")
        node = self.values
        for part in outer:
            node = node.setdefault(part, {})
        node[last] = value

    def save(self, path: str | Path) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(self.values, indent=2, ensure_ascii=False), encoding="utf-8")

    def ai_errors(self) -> list[str]:
        """What the section ``ai`` lacks; nothing where it is switched off."""
        own = self.get("ai", {})
        if not own.get("enabled", True):
            return []
        missing = [f"missing {k}" for k in ("provider", "model", "base_url") if not own.get(k)]
        url = own.get("base_url") or ""
        return missing + ([f"not an http address: {url}"] if url and not url.startswith(("http://", "https://")) else [])


def transfer(source: str, target: str, overwrite: bool = False, move: bool = False) -> bool:
    """Copy or move a file with its times, folders made; false, and nothing done, without a source or over a target."""
    if not os.path.exists(source) or os.path.exists(target) and not overwrite:
        return False
    Path(target).parent.mkdir(parents=True, exist_ok=True)
    if move:
        shutil.move(source, target)
    else:
        shutil.copy2(source, target)
    return True


def backup(path: str, folder: str | None = None, suffix: str = ".bak") -> str | None:
    """A copy beside the file, or in ``folder``, over an older one; None without a file."""
    target = os.path.join(folder or os.path.dirname(path), os.path.basename(path) + suffix)
    return target if transfer(path, target, overwrite=True) else None


def read_chunks(path: str, size: int = 8192) -> Iterator[bytes]:
    with open(path, "rb") as f:
        yield from iter(lambda: f.read(size), b"")


def temporary(suffix: str = "", folder: str | None = None) -> str:
    """The path of a new empty file of the driver's own."""
    handle, path = tempfile.mkstemp(suffix=suffix, dir=folder)
    os.close(handle)
    return path


def write_json(path: str | Path, content) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(content, indent=2, default=str), encoding="utf-8")


def health_report(checks: dict[str, Callable[[], list[str]]], path: str | Path | None = None) -> dict:
    """Run checks that return their issues; the report has each one's health and a summary. A check that raises is unhealthy."""
    results = {}
    for name, check in checks.items():
        try:
            issues = list(check())
        except Exception as e:  # whatever a check raises is its issue
            issues = [f"{type(e).__name__}: {e}"]
        results[name] = {"healthy": not issues, "issues": issues}
    passed = sum(r["healthy"] for r in results.values())
    summary = {"total_checks": len(results), "passed_checks": passed, "failed_checks": len(results) - passed, "all_passed": passed == len(results)}
    report = {"timestamp": datetime.now().isoformat(), "system_info": {"python_version": platform.python_version(), "platform": platform.platform()}, "checks": results, "summary": summary}
    if path is not None:
        write_json(path, report)
    return report


class JsonLines(logging.Formatter):
    """A log record as a line of JSON, with the extra fields that it was given."""

    _OWN = set(vars(logging.makeLogRecord({}))) | {"message", "asctime"}

    def format(self, record: logging.LogRecord) -> str:
        line = {"timestamp": datetime.fromtimestamp(record.created).isoformat(), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        line |= {k: v for k, v in vars(record).items() if k not in self._OWN}
        if record.exc_info:
            line["exception"] = self.formatException(record.exc_info)
        return json.dumps(line, default=str)


def status() -> dict:
    """What is at hand: operators by category, cores, memory and disk."""
    names = {c: registry.names(c) for c in sorted({registry.export(n)["category"] for n in registry.names()})}
    disk = shutil.disk_usage("/")
    rss = 0.0
    if os.path.exists("/proc/self/statm"):
        rss = int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 2**20
    host = {"system": platform.system(), "platform": platform.platform(), "python": sys.version.split()[0], "cores": os.cpu_count()}
    return {"operators": names, "host": host, "memory_mb": rss, "disk": {"total": disk.total, "free": disk.free, "percent": round(100 * disk.used / disk.total, 2)}}


class Operations:
    """Kinds of operations by name; each run has a record, and callbacks when it has ended."""

    def __init__(self) -> None:
        self.kinds: dict[str, Callable[..., DataFrame | dict]] = {}
        self.callbacks: dict[str, list[Callable[[dict], None]]] = {}
        self.records: list[dict] = []

    def kind(self, name: str, fn: Callable[..., DataFrame | dict]) -> None:
        self.kinds[name] = fn

    def on_completion(self, operation_id: str, fn: Callable[[dict], None]) -> None:
        self.callbacks.setdefault(operation_id, []).append(fn)

    def run(self, operation_id: str, kind: str, **params) -> dict:
        """The record: id, kind, success, result or error, seconds. A callback that raises doesn't stop the others."""
        begun, record = time.monotonic(), {"id": operation_id, "kind": kind, "success": False, "result": None, "error": None}
        try:
            if kind not in self.kinds:
                raise ValueError(f"unknown operation type: {kind}")
            record |= {"result": self.kinds[kind](**params), "success": True}
        except Exception as e:  # whatever an operation raises is its record's error
            record["error"] = str(e)
        record["seconds"] = time.monotonic() - begun
        self.records.append(record)
        for fn in self.callbacks.pop(operation_id, []):
            try:
                fn(record)
            except Exception:
                logging.getLogger(__name__).exception("a callback of %s failed", operation_id)
        return record

    def batch(self, steps: list[dict]) -> dict:
        """Run steps (kind, input, parameters) in order: each one's index, status and result or error, and how many succeeded."""
        out = []
        for i, step in enumerate(steps):
            if not step.get("kind") or step.get("input") is None:
                out.append({"index": i, "status": "failed", "error": "Missing kind or input"})
                continue
            got = self.run(f"batch-{i}", step["kind"], input=step["input"], **step.get("parameters", {}))
            out.append({"index": i, "status": "success" if got["success"] else "failed", "kind": step["kind"]} | ({"result": got["result"]} if got["success"] else {"error": got["error"]}))
        good = sum(o["status"] == "success" for o in out)
        return {"total_operations": len(out), "successful_operations": good, "failed_operations": len(out) - good, "operations": out}

    def snapshot(self, path: str | Path) -> None:
        """The records so far as a JSON file."""
        write_json(path, {"timestamp": datetime.now().isoformat(), "completed_operations": self.records})


def notify(stream: DataFrame, fn: Callable[[dict], None]):
    """A stream writer that calls ``fn`` with the number and the rows of each batch after it is complete."""
    return stream.writeStream.foreachBatch(lambda rows, number: fn({"batch": number, "rows": rows.count()}))
