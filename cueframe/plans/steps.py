"""A chain of named steps: each takes DataFrames by the name of an earlier output, and gives one.

Only names and references are checked here; Spark plans and runs the work.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Step:
    name: str
    tool: Callable[..., DataFrame]
    inputs: Mapping[str, str] = field(default_factory=dict)
    parameters: Mapping[str, object] = field(default_factory=dict)


def chained(steps: Sequence[Step], sources: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Outputs by step name; ValueError for a repeated name or a reference to no source and no earlier step."""
    known = dict(sources)
    for step in steps:
        if step.name in known:
            raise ValueError(f"{step.name} is named twice")
        if lost := [r for r in step.inputs.values() if r not in known]:
            raise ValueError(f"{step.name} refers to {lost[0]}, which is no source and no earlier step")
        known[step.name] = step.tool(**{k: known[r] for k, r in step.inputs.items()}, **step.parameters)
    return {s.name: known[s.name] for s in steps}
