"""Plans of named steps: dependency levels, runs with retries and gates, isolated passes, resumption."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


class PlanError(ValueError):
    """A step depends on itself, in a circle or on one that isn't there."""


def levels(depends: dict[str, Iterable[str]]) -> list[list[str]]:
    """Steps by level; each level needs only those before it. Names are sorted within a level."""
    left = {k: set(v) for k, v in depends.items()}
    if missing := {d for v in left.values() for d in v} - set(left):
        raise PlanError(f"unknown steps: {sorted(missing)}")
    out: list[list[str]] = []
    done: set[str] = set()
    while left:
        ready = sorted(k for k, v in left.items() if v <= done)
        if not ready:
            raise PlanError(f"circle among {sorted(left)}")
        out.append(ready)
        done.update(ready)
        for k in ready:
            del left[k]
    return out


@dataclass
class Step:
    """A named transformation of a state of frames. ``confidence`` rates its output from 0 to 1."""

    name: str
    run: Callable[[dict], dict]
    depends: tuple[str, ...] = ()
    version: str = "1.0.0"
    confidence: Callable[[dict], float] = lambda out: 1.0


class Registry:
    """Steps by name; two of one name are refused."""

    def __init__(self, steps: Iterable[Step] = ()):
        self.steps: dict[str, Step] = {}
        for s in steps:
            self.register(s)

    def register(self, step: Step) -> None:
        if step.name in self.steps:
            raise PlanError(f"step {step.name} is registered twice")
        self.steps[step.name] = step

    def plan(self, only: set[str] | None = None) -> list[list[str]]:
        chosen = {k: [d for d in s.depends if only is None or d in only] for k, s in self.steps.items() if only is None or k in only}
        return levels(chosen)


@dataclass
class Report:
    name: str
    ok: bool
    seconds: float
    attempts: int = 1
    confidence: float | None = None
    error: str = ""


@dataclass
class Outcome:
    state: dict
    reports: list[Report] = field(default_factory=list)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(r.name, r.ok, r.seconds, r.attempts, r.confidence, r.error) for r in self.reports], "name string, ok boolean, seconds double, attempts int, confidence double, error string")


def run(registry: Registry, state: dict, retries: int = 2, gate: float = 0.2, fail_fast: bool = False, pause: float = 0.0, only: set[str] | None = None) -> Outcome:
    """Run level by level. A step below the gate or with an error is tried again; its last low-rated output is accepted."""
    out = Outcome(dict(state))
    failed: set[str] = set()
    for level in registry.plan(only):
        for name in level:
            step = registry.steps[name]
            if failed & set(step.depends):
                out.reports.append(Report(name, False, 0.0, 0, None, "a step before it failed"))
                failed.add(name)
                continue
            began, error = time.monotonic(), ""
            for attempt in range(1, retries + 2):
                try:
                    made = step.run(out.state)
                    rated = float(step.confidence(made))
                    error = ""
                    if rated >= gate or attempt == retries + 1:
                        break
                except Exception as e:  # noqa: BLE001 - a step may fail in any way; the report has it
                    error = f"{type(e).__name__}: {e}"
                time.sleep(pause * attempt)
            if error:
                if fail_fast:
                    raise RuntimeError(f"{name}: {error}")
                failed.add(name)
                out.reports.append(Report(name, False, time.monotonic() - began, attempt, None, error))
            else:
                out.state.update(made)
                out.reports.append(Report(name, True, time.monotonic() - began, attempt, rated))
    return out


PASSES = ("linking", "clustering", "inference", "decay", "contradiction")


def consolidate_corpus(state: dict, passes: dict[str, Callable[[dict], dict]], active: Iterable[str] = PASSES) -> Outcome:
    """Ordered passes over a corpus graph; one that fails is reported and the next still runs."""
    out = Outcome(dict(state))
    for name in [p for p in PASSES if p in set(active) and p in passes]:
        began = time.monotonic()
        try:
            out.state.update(passes[name](out.state))
            out.reports.append(Report(name, True, time.monotonic() - began))
        except Exception as e:  # noqa: BLE001 - isolation is the point
            out.reports.append(Report(name, False, time.monotonic() - began, error=f"{type(e).__name__}: {e}"))
    return out


def resume(steps: list[str], start: str | None) -> list[str]:
    """Steps from ``start`` on; all of them without one."""
    if start is None:
        return list(steps)
    if start not in steps:
        raise PlanError(f"no step {start}")
    return steps[steps.index(start) :]
