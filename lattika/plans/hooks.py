"""What users add: reductions, interpolators and routines that run at given points of an evolution."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from lattika.functions.reductions import REDUCTIONS


def register_reduction(name: str, rule: Callable[..., Column]) -> None:
    """rule(value, weight, strict=False) -> aggregate column; also gives the point-counting form `i<name>`."""
    if name in REDUCTIONS:
        raise ValueError(f"{name} exists")
    REDUCTIONS[name] = rule


def unregister_reduction(name: str) -> None:
    del REDUCTIONS[name]


class Schedule:
    """Routines in bins, ordered by what they come before and after; groups of tables pass through them."""

    def __init__(self):
        self.bins: dict[str, dict[str, tuple[Callable[[dict[str, DataFrame]], dict[str, DataFrame]], set[str]]]] = {}

    def add(self, where: str, name: str, routine: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], after: tuple[str, ...] = (), before: tuple[str, ...] = ()) -> None:
        steps = self.bins.setdefault(where, {})
        steps[name] = (routine, set(after) | steps.get(name, (None, set()))[1])
        for b in before:
            steps[b] = (steps[b][0], steps[b][1] | {name}) if b in steps else (None, {name})

    def order(self, where: str) -> list[str]:
        steps = {k: v for k, v in self.bins.get(where, {}).items() if v[0] is not None}
        out: list[str] = []
        while len(out) < len(steps):
            ready = [k for k, (_, after) in steps.items() if k not in out and not (after & set(steps)) - set(out)]
            if not ready:
                raise ValueError(f"{where}: routines wait for each other")
            out.append(ready[0])
        return out

    def run(self, where: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        for name in self.order(where):
            tables = tables | (self.bins[where][name][0](tables) or {})
        return tables
