"""Driver-side plans: step graphs and operator pipelines, run as lazy DataFrame transforms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..registry import registry


def order(steps: dict[str, list[str]]) -> list[str]:
    """Steps after all that they depend on; a cycle or an unknown step is an error."""
    if unknown := {d for ds in steps.values() for d in ds} - steps.keys():
        raise ValueError(f"unknown steps: {sorted(unknown)}")
    done: list[str] = []
    while len(done) < len(steps):
        ready = [s for s, ds in steps.items() if s not in done and all(d in done for d in ds)]
        if not ready:
            raise ValueError("the steps depend on one another in a circle")
        done += ready
    return done


def run_graph(steps: dict[str, tuple[list[str], Callable[..., DataFrame]]]) -> dict[str, DataFrame]:
    """Each step's DataFrame, made from those of the steps that it depends on."""
    out: dict[str, DataFrame] = {}
    for name in order({k: v[0] for k, v in steps.items()}):
        deps, fn = steps[name]
        out[name] = fn(*[out[d] for d in deps])
    return out


def pipeline(df: DataFrame, *steps: tuple[str, dict]) -> DataFrame:
    """Registered operators one after the other."""
    for name, params in steps:
        df = registry.run(name, df, **params)
    return df
