"""Order-dependent rules of one system: visiting order, stage flags and candidates.

These rules are defined by the order in which members are visited, so they run
as a small helper inside grouped kernels.  ``Walk`` keeps its whole state in
plain fields: it can run a system in one go or stop at a page boundary and be
resumed from tables.  Everything that does not depend on the order (joining and
confirming candidates) is left to DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from gridtrack.config import TrackConfig


@dataclass
class SystemView:
    """Members of one component and their pruned links, in canonical order."""

    area: dict[int, float]
    outer: dict[int, float]
    inner: dict[int, float]
    parents: dict[int, list[int]]
    children: dict[int, list[int]]


@dataclass
class Candidate:
    """A possible mature system inside a component."""

    number: int
    shield_count: int = 0
    duration: int = 0
    top: int | None = None
    top_frame: int = 0
    core_frames: set[int] = field(default_factory=set)

    def raise_top(self, node: int) -> None:
        if frame_of(node) > self.top_frame:
            self.top, self.top_frame = node, frame_of(node)


@dataclass
class Placed:
    """Where a visited node ended up; a node that no rule keeps has no candidate."""

    candidate: Candidate | None = None
    core: bool = False
    stage: str | None = None


def frame_of(node: int) -> int:
    return node >> 32


class Walk:
    """Visits a component depth first, parents before children, newest discovery first."""

    def __init__(self, view: SystemView, config: TrackConfig) -> None:
        self.view, self.config = view, config
        self.pushed: dict[int, int] = {}
        self.pending: list[int] = []
        self.placed: dict[int, Placed] = {}
        self.seen_large = False
        self.next_push = 0
        self.next_candidate = 1

    def run(self) -> Walk:
        self.discover(min(self.view.area))
        while self.pending:
            self.visit(self.pending.pop())
        return self

    def discover(self, node: int) -> None:
        if node not in self.pushed:
            self.pushed[node] = self.next_push
            self.next_push += 1
            self.pending.append(node)

    def visit(self, node: int) -> None:
        parents, children = self.view.parents.get(node, ()), self.view.children.get(node, ())
        self.placed[node] = Placed()
        self._place(node, *self._flags(node))
        for parent in parents:
            if parent not in self.pushed:
                for child in children:
                    self.discover(child)
                self.discover(parent)
        for child in children:
            self.discover(child)

    def _flags(self, node: int) -> tuple[bool, bool, str]:
        """Shield criterion, core criterion and provisional stage."""
        view, config = self.view, self.config
        large = view.area[node] >= config.outer_area
        self.seen_large = self.seen_large or large
        shield = large and view.outer[node] >= config.outer_area
        core = shield and view.inner[node] >= config.inner_area
        return shield, core, "M" if core else "I" if self.seen_large else "D"

    def _place(self, node: int, shield: bool, core: bool, stage: str) -> None:
        """Apply the first rule that fits."""
        parents, children = self.view.parents.get(node, ()), self.view.children.get(node, ())
        if found := self._owner(parents, core_only=True):
            self._after_core(found, node, shield, core, stage)
        elif found := self._owner(children, core_only=False):
            self._before_body(found, node, shield, core, stage)
        elif found := self._owner(parents, core_only=False):
            self._after_body(found, node, shield, core)
        else:
            self._open(node, shield, core)

    def _owner(self, neighbours, core_only: bool) -> Candidate | None:
        for near in neighbours:
            spot = self.placed.get(near)
            if spot and spot.candidate and (spot.core or not core_only):
                return spot.candidate
        return None

    def _open(self, node: int, shield: bool, core: bool) -> None:
        fresh = Candidate(self.next_candidate, shield_count=int(shield))
        self.next_candidate += 1
        self._keep(fresh, node, core, "I")
        if core:
            fresh.duration = 1
            fresh.raise_top(node)

    def _after_core(self, found: Candidate, node: int, shield: bool, core: bool, stage: str) -> None:
        known_frame = frame_of(node) in found.core_frames
        if core:
            self._keep(found, node, True, "M")
            if not known_frame:
                found.shield_count += 1
                found.duration += 1
                found.raise_top(node)
        elif known_frame:
            self._keep(found, node, False, stage)
            found.shield_count += int(shield)
        elif frame_of(node) > found.top_frame or found.top_frame == 0:
            self._open(node, shield, core)

    def _before_body(self, found: Candidate, node: int, shield: bool, core: bool, stage: str) -> None:
        if core:
            self._keep(found, node, True, "M")
            found.raise_top(node)
        elif frame_of(node) in found.core_frames:
            self._keep(found, node, False, stage)
            found.shield_count += int(shield)
        elif shield:
            found.shield_count += 1
        else:
            self._keep(found, node, False, stage)

    def _after_body(self, found: Candidate, node: int, shield: bool, core: bool) -> None:
        if core:
            self._keep(found, node, True, "M")
            found.duration += 1
            found.raise_top(node)
        elif found.top_frame == 0 or frame_of(node) <= found.top_frame:
            self._keep(found, node, False, "I")
            found.shield_count += int(shield)

    def _keep(self, owner: Candidate, node: int, core: bool, stage: str) -> None:
        self.placed[node] = Placed(owner, core, stage)
        if core:
            owner.core_frames.add(frame_of(node))
