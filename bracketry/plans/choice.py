"""Which entities to follow first, by the contests that each adds."""

from __future__ import annotations

from ..operators import choice
from .base import perspectives
from .registry import query

#: Entities chosen.
MOST = 100


@query()
def q_greedy_cover(spark, sf):
    """The hundred entities picked one by one for the most rounds of contests that none before was in."""
    rows = perspectives(spark, sf).select("entity", "contest_id", "scheduled")
    return choice.greedy_cover(rows, "entity", "contest_id", MOST, "scheduled")
