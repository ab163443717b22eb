"""Enforcement run to its end: insertions and deletions, round by round."""

from __future__ import annotations

from ..catalog import Catalog
from ..diagnostics import oscillation_risk
from ..rules import Enforcement
from ..store import shared_folder, written


class Unstable(ValueError):
    pass


def repair(catalog: Catalog, enforcements: list[Enforcement], most_rounds: int = 100) -> int:
    """Apply all enforcements until none changes anything; returns the rounds. Sets at risk of oscillation are refused."""
    if risk := oscillation_risk(enforcements):
        raise Unstable(f"repairs may undo each other: {risk}")
    folder = shared_folder(catalog.spark)
    for turn in range(most_rounds):
        changed = False
        for k, e in enumerate(enforcements):
            relation = catalog.get(e.relation.name, e.relation.src, e.relation.tgt)
            new, gone = e.inserts(), e.deletes()
            if (new is not None and not new.isEmpty()) or (gone is not None and not gone.isEmpty()):
                relation.frame, relation.is_set = written(e.applied(), f"{folder}/{turn}-{k}"), True
                changed = True
        if not changed:
            return turn
    raise Unstable(f"not settled after {most_rounds} rounds")
