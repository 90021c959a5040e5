"""Which direction the next level of a traversal takes."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class DirectionPolicy:
    """Top-down while the frontier is small, bottom-up while it is large, then top-down to the end.

    ``forced`` pins one direction. ``record`` holds what tuning looks at.
    ``by_work``, if it isn't 0, is the sum of all degrees, and another rule holds: a step joins the edges of
    the frontier (top-down) or of what is unreached (bottom-up), so bottom-up is taken where those are
    fewer by ``gain``, which pays for the table of unreached vertices.
    """

    num_edges: int
    num_vertices: int
    edge_factor: float = 16
    alpha: float = 10.0
    beta: float = 14.0
    forced: str | None = None
    growing: bool = True
    forward: bool = True
    size: int = 0
    level: int = 0
    record: dict = field(default_factory=dict)
    by_work: int = 0
    gain: float = 4.0
    reached: int = 0

    def direction(self) -> str:
        return self.forced or ("top_down" if self.forward else "bottom_up")

    def advance(self, next_size: int, next_edges: int) -> None:
        """Take in the frontier that a level has found, and decide for the next one."""
        self.level += 1
        self.reached += next_edges
        if self.by_work:
            self.forward = next_edges <= self.gain * max(0, self.by_work - self.reached)
        elif self.growing and next_size > self.size and self.forward:
            if next_edges > int(self.num_edges / self.alpha):
                self.forward = False
                self.record |= {"t2b_level": self.level, "nq_edges": next_edges, "num_edges": self.num_edges}
            else:
                self.record["pre_nq_edges"] = next_edges
        elif not self.forward:
            if next_size < int(self.num_vertices / (self.beta * self.edge_factor * 2)):
                self.forward, self.growing = True, False
                self.record |= {"b2t_level": self.level, "nq_size": next_size, "num_verts": self.num_vertices}
            else:
                self.record["pre_nq_size"] = next_size
        self.size = next_size
        self.record["level"] = self.level
