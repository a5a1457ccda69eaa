"""Boosted-tree settings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from subloom.learning.trees import Limits


@dataclass(frozen=True)
class Member:
    """One kind of booster.

    A tree grows to ``leaves`` leaves, the one of largest gain first, or to ``depth`` (0: not
    bounded by that one). Each tree sees the share ``columns`` of the features and ``sample`` of
    the rows, drawn anew every ``redraw`` rounds. A held-out fold ends the boosting after
    ``patience`` rounds without gain, and the trees up to the best round stay. ``rounds`` is a bound
    far above that; without a held-out fold so many trees are grown.
    """

    name: str
    step: float
    leaves: int = 0
    depth: int = 0
    min_rows: int = 1
    min_weight: float = 1e-3
    penalty: float = 0.0
    columns: float = 1.0
    sample: float = 1.0
    redraw: int = 1
    rounds: int = 200_000
    patience: int = 10

    def __post_init__(self):
        if self.leaves < 2 and self.depth < 1:
            raise ValueError("bound the leaves or the depth")

    @property
    def limits(self) -> Limits:
        return Limits(self.leaves, self.depth, self.min_rows, self.min_weight, self.penalty)


def best_round(errors: Sequence[float], patience: int) -> tuple[int, bool]:
    """Number of the round with the least error before ``patience`` rounds bring no gain, and
    whether that many followed it."""
    best = 0
    for i, error in enumerate(errors):
        if error < errors[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


# Fixed values of both pipelines' boosters.
CHURN_MEMBERS = (
    Member("broad", step=0.05, leaves=31, min_rows=20, columns=0.8, sample=0.8, redraw=5),
    Member("deep", step=0.05, depth=6, penalty=1.0, columns=0.8, sample=0.8),
)
GAP_MEMBERS = (
    Member("broad", step=0.01, leaves=40, min_rows=20, columns=0.9),
    Member("deep", step=0.01, depth=8, penalty=1.0),
)
