"""Thresholds of the counting rules; every operator takes its time of reference explicitly."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    min_sessions: int = 3
    min_projects: int = 2
    min_events: int = 5
    routing_pct: int = 80
    overlay_pct: int = 40
    window_sessions: int = 20
    baseline_sessions: int = 15
    window_uses: int = 20
    canary_days: int = 14
    alert_pct: float = 20.0
    noise_floor: float = 0.1
    breaker_reverts: int = 3
    rate_per_day: int = 5

    def clamped(self) -> Thresholds:
        """Each value within the bounds that keep a rule meaningful."""
        def clip(x, low, high):
            return min(max(x, low), high)

        return Thresholds(
            clip(self.min_sessions, 1, 1000), clip(self.min_projects, 1, 1000), clip(self.min_events, 1, 1000), clip(self.routing_pct, 1, 100), clip(self.overlay_pct, 1, 100),
            clip(self.window_sessions, 1, 1000), clip(self.baseline_sessions, 1, 1000), clip(self.window_uses, 1, 1000), clip(self.canary_days, 1, 365), clip(self.alert_pct, 1.0, 100.0),
            clip(self.noise_floor, 0.0, 1.0), clip(self.breaker_reverts, 1, 1000), clip(self.rate_per_day, 1, 1000),
        )


DEFAULT = Thresholds()
#: Names before an agent's own name; a longer one first.
AGENT_PREFIXES = ("hub:review:", "hub:")
WRONG_REASONS = ("agent_wrong", "severity_miscalibrated")
OVERRIDE_EVENTS = ("override", "disagreement_override")
CROSS_CUTTING = ("fd-architecture", "fd-quality", "fd-safety", "fd-correctness")
SAFETY_FLOOR = ("fd-architecture", "fd-correctness", "fd-safety", "fd-quality")
SOURCE_WEIGHTS = {"bootstrap": 0.5, "self-building": 0.7, "normal": 1.0}
