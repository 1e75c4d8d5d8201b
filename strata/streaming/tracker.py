"""Announcements from an ordered walk over cells.

Cells arrive depth first. Whenever the walk leaves a subtree, each cell that is
closed by it and had children is announced, deepest first, with its numbers of
children by layer: what ``announced_fold`` waits for.
"""

from __future__ import annotations

from strata.errors import StrataError
from strata.names import cell_text

Cell = tuple[tuple[str, int], ...]


class CellTracker:
    """Feed with ``enter``, end with ``close``; each returns (cell, {layer: children}) pairs. The job is ``()``."""

    def __init__(self):
        self._open: list[tuple[Cell, dict[str, int]]] = []

    def _leave(self, depth: int) -> list[tuple[Cell, dict[str, int]]]:
        gone = []
        while len(self._open) > depth:
            cell, counts = self._open.pop()
            if counts:
                gone.append((cell, counts))
        return gone

    def enter(self, cell: Cell) -> list[tuple[Cell, dict[str, int]]]:
        if not cell:
            if self._open:
                raise StrataError("The job can only be the first cell")
            self._open.append(((), {}))
            return []
        if not self._open:
            raise StrataError("The first cell must be the job")
        depth = len(cell)
        if depth > len(self._open) or any(c != cell[:k] for k, (c, _) in enumerate(self._open[:depth])):
            raise StrataError(f"Cell {cell_text([n for n, _ in cell], [k for _, k in cell])} skips its parent")
        gone = self._leave(depth)
        counts = self._open[-1][1]
        counts[cell[-1][0]] = counts.get(cell[-1][0], 0) + 1
        self._open.append((cell, {}))
        return gone

    def close(self) -> list[tuple[Cell, dict[str, int]]]:
        return self._leave(0)
