"""What a run does, step by step, and a note of each step as it is reached."""

from __future__ import annotations

import time
from collections.abc import Callable


def steps(cfg: dict, debug: bool = False, input_clip: bool = False) -> list[str]:
    """Names of a sampling run's steps, by its settings."""
    whole = not cfg["performance"]["stream_frames"]
    how = {"motion_gated": "Gate by motion, score, select", "online": "Score and select in order"}.get(cfg["scoring"]["algorithm"], "Score and select")
    writes = [name for name, wanted in (("Write the input clip", input_clip), ("Write the sampled frames", True), ("Write the overlay", debug)) if wanted]
    return [*(["Materialise the frames"] if whole else []), how, *writes, "Write manifest and report"]


class Progress:
    """Tells which of the planned steps begins and how long it took, by ``say`` (print, a logger, or nothing)."""

    def __init__(self, plan: list[str], say: Callable[[str], None] | None = print):
        self.plan, self.say, self.at = plan, say or (lambda _: None), 0
        self.began = self.since = time.monotonic()

    def begin(self, label: str | None = None) -> None:
        self.since = time.monotonic()
        name = label or (self.plan[self.at] if self.at < len(self.plan) else f"Step {self.at + 1}")
        self.at += 1
        self.say(f"[{self.at}/{max(self.at, len(self.plan))}] {name} ({self.since - self.began:.0f} s so far)")

    def done(self, detail: str = "") -> float:
        took = time.monotonic() - self.since
        self.say(f"  {took:.1f} s" + (f", {detail}" if detail else ""))
        return took
