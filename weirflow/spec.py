"""What a join is asked to do."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class JoinSpec:
    """strategy: a name in operators.strategies.STRATEGIES. workers: partitions of the shuffles that the strategy does itself; None leaves them to Spark.
    group_size: copies of R, and slices of S, per key in the salted strategies. sort_step: a run's part of a side, in percent.
    window_ms: tumbling window, None for one window that holds everything."""

    strategy: str = "NPO"
    workers: int | None = None
    group_size: int = 2
    sort_step: int = 20
    radix_bits: int = 8
    window_ms: int | None = None

    def __post_init__(self):
        if (self.workers is not None and self.workers < 1) or self.group_size < 1 or not 0 < self.sort_step <= 100:
            raise ValueError(f"workers and group_size are 1 at least, sort_step is 1 to 100: {self}")
