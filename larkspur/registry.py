"""Named operators: DataFrame -> DataFrame transforms with parameters taken from their signatures."""

from __future__ import annotations

import inspect
import re
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import get_type_hints

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


#: What a job group sets for the jobs of a thread.
_GROUP = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")


def _wait_for_end(spark: SparkSession, group: str, most_s: float = 30.0) -> None:
    """Wait until no task of a cancelled group is at work, so that none of them is killed beside a later job."""
    tracker, until = spark.sparkContext.statusTracker(), time.monotonic() + most_s
    while time.monotonic() < until:
        jobs = [j for i in tracker.getJobIdsForGroup(group) if (j := tracker.getJobInfo(i))]
        stages = [s for j in jobs for i in j.stageIds if (s := tracker.getStageInfo(i))]
        if not any(s.numActiveTasks for s in stages):
            return
        time.sleep(0.1)


@dataclass
class Operator:
    name: str
    fn: Callable[..., DataFrame]
    category: str = "general"
    doc: str = ""
    params: dict[str, inspect.Parameter] = field(default_factory=dict)


class Registry:
    """Operators by name; a name may be registered anew, the last one counts."""

    def __init__(self) -> None:
        self._ops: dict[str, Operator] = {}
        self._runs: dict[str, list[tuple[bool, float]]] = {}

    def operator(self, name: str | None = None, category: str = "general"):
        def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            key = name or fn.__name__
            if not _NAME.fullmatch(key):
                raise ValueError(f"not an operator name: {key!r}")
            params = dict(list(inspect.signature(fn).parameters.items())[1:])
            self._ops[key] = Operator(key, fn, category, inspect.getdoc(fn) or "", params)
            return fn

        return add

    def unregister(self, name: str) -> bool:
        return self._ops.pop(name, None) is not None

    def names(self, category: str | None = None) -> list[str]:
        return sorted(n for n, o in self._ops.items() if category in (None, o.category))

    def check(self, name: str, params: dict) -> list[str]:
        """What is wrong with a call: unknown operator, missing or unknown parameters."""
        if name not in self._ops:
            return [f"unknown operator {name}"]
        own = self._ops[name].params
        missing = [p for p, v in own.items() if v.default is inspect.Parameter.empty and p not in params]
        return [f"missing parameter {p}" for p in missing] + [f"unknown parameter {p}" for p in params if p not in own]

    def run(self, name: str, df: DataFrame, **params) -> DataFrame:
        """The operator's lazy result; bad calls fail here, before any job."""
        if wrong := self.check(name, params):
            raise ValueError("; ".join(wrong))
        return self._ops[name].fn(df, **params)

    def execute(self, name: str, df: DataFrame, timeout_s: float | None = None, **params) -> dict:
        """Run an operator to its end: success, rows, seconds and error; a job beyond ``timeout_s`` is cancelled.

        Outcomes are counted; ``stats`` gives them.
        """
        spark, group = df.sparkSession, f"{name}-{uuid.uuid4().hex}"
        begun, out = time.monotonic(), {"operator": name, "success": False, "rows": None, "error": None}
        late = threading.Event()

        def stop() -> None:
            late.set()
            spark.sparkContext.cancelJobGroup(group)

        timer = threading.Timer(timeout_s, stop) if timeout_s else None
        before = {p: spark.sparkContext.getLocalProperty(p) for p in _GROUP}
        spark.sparkContext.setJobGroup(group, name, interruptOnCancel=True)
        try:
            result = self.run(name, df, **params)
            if timer:
                timer.start()
            seen = Observation()
            result.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()  # all columns are made
            out |= {"rows": seen.get["rows"], "success": True}
        except Exception as e:  # whatever the operator or its job raises is the record's error
            out["error"] = f"timed out after {timeout_s} s" if late.is_set() else f"{type(e).__name__}: {e}"
        finally:
            if timer:
                timer.cancel()
            for p, v in before.items():
                spark.sparkContext.setLocalProperty(p, v)
            if late.is_set():
                _wait_for_end(spark, group)
        out["seconds"] = time.monotonic() - begun
        self._runs.setdefault(name, []).append((out["success"], out["seconds"]))
        return out

    def stats(self, name: str) -> dict:
        """Executions, successes, errors, their rate in percent and the mean of seconds of ``execute``."""
        runs = self._runs.get(name, [])
        good = sum(ok for ok, _ in runs)
        return {"executions": len(runs), "successes": good, "errors": len(runs) - good, "success_rate": round(100 * good / len(runs), 2) if runs else 0.0, "mean_s": sum(s for _, s in runs) / len(runs) if runs else 0.0}

    def export(self, name: str) -> dict:
        """An operator's name, description, category, parameters with their kinds and defaults, what it returns, and its statistics."""
        o = self._ops[name]
        hints = get_type_hints(o.fn)
        kind = lambda h: getattr(h, "__name__", str(h)) if h is not None else "any"
        params = {p: {"type": kind(hints.get(p)), "required": v.default is inspect.Parameter.empty} | ({} if v.default is inspect.Parameter.empty else {"default": repr(v.default)}) for p, v in o.params.items()}
        return {"name": o.name, "description": o.doc, "category": o.category, "parameters": params, "returns": {"type": kind(hints.get("return"))}, "stats": self.stats(name)}

    def describe(self, spark: SparkSession) -> DataFrame:
        rows = [(o.name, o.category, o.doc.split("\n")[0], sorted(o.params)) for o in self._ops.values()]
        return spark.createDataFrame(rows, "name string, category string, doc string, params array<string>")


registry = Registry()
operator = registry.operator
