"""Step-by-step tuning of the thresholds that switch directions."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass
class Tuner:
    """Moves a threshold one record at a time in one direction while runs get faster.

    records: what DirectionPolicy.record held for each key. The next value is the
    mildest one that changes the switch level of at least one key: its
    threshold is crossed by a hundredth.
    """

    alpha: float = 10.0
    beta: float = 14.0
    edge_factor: float = 16

    def next_alpha(self, records: list[dict], up: bool) -> float | None:
        """Greater alpha switches to bottom-up earlier; smaller later."""
        key = "pre_nq_edges" if up else "nq_edges"
        ratios = sorted(r["num_edges"] / r[key] for r in records if r.get(key) and r.get("num_edges"))
        ahead = [x for x in ratios if (x > self.alpha if up else x <= self.alpha)]
        if not ahead:
            return None
        return ahead[0] * 1.01 if up else ahead[-1] * 0.99

    def next_beta(self, records: list[dict], up: bool) -> float | None:
        """Greater beta switches back to top-down later; smaller earlier."""
        key = "nq_size" if up else "pre_nq_size"
        ratios = sorted(r["num_verts"] / (r[key] * self.edge_factor * 2) for r in records if r.get(key) and r.get("num_verts"))
        ahead = [x for x in ratios if (x > self.beta if up else x <= self.beta)]
        if not ahead:
            return None
        return ahead[0] * 1.01 if up else ahead[-1] * 0.99

    def tune(self, measure) -> tuple[float, float]:
        """measure(alpha, beta) gives (rate, records); alpha is tuned, then beta, up and down, until a step is slower."""
        best, records = measure(self.alpha, self.beta)
        for name, step in (("alpha", self.next_alpha), ("beta", self.next_beta)):
            for up in (True, False):
                seen = records
                while (value := step(seen, up)) is not None and value != getattr(self, name):
                    old = getattr(self, name)
                    setattr(self, name, value)
                    rate, seen = measure(self.alpha, self.beta)
                    if rate <= best:
                        setattr(self, name, old)
                        break
                    best, records = rate, seen
        return self.alpha, self.beta
