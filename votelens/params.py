"""Run parameters."""
from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # scoring
    p0: float = 0.12
    gamma: float = 5.0
    mdr: float = 0.1
    fpr: float = 0.01
    controversy: str = "pow"          # or "multiply"
    # layout of ordered windows: rows that a block should hold, or one of so many shares of the table if that is more
    split_rows: int = 1_000_000
    shares: int = 2048

    def __post_init__(self):
        if self.gamma <= 0:
            raise ValueError("gamma must be positive: a voter without gold votes would divide by zero")
        if not 0 < self.p0 < 1:
            raise ValueError("p0 must lie strictly between 0 and 1")
        if self.controversy not in ("pow", "multiply"):
            raise ValueError("controversy is 'pow' or 'multiply'")
