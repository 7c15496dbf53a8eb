"""What an algorithm gives back."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Result:
    algorithm: str
    labels: DataFrame  # (node, label)
    hierarchy: DataFrame | None = None  # (level, node, label)
    objective: float | None = None
    modularity: float | None = None
    elapsed_ms: float | None = None
    diagnostics: dict[str, float] = field(default_factory=dict)
