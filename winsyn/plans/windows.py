"""Window specifications over event time (milliseconds) or over ordinals in event-time order."""

from __future__ import annotations

import random
import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Window:
    """[k * slide, k * slide + size) for every k; tumbling if slide equals size. ``slide`` may exceed ``size``: gaps."""

    size: int
    slide: int
    measure: str = "time"

    def __post_init__(self):
        if self.size <= 0 or self.slide <= 0:
            raise ValueError("size and slide must be positive")
        if self.measure not in ("time", "count"):
            raise ValueError("measure is 'time' or 'count'")

    @property
    def kind(self) -> str:
        return "tumbling" if self.size == self.slide else "sliding"

    @property
    def label(self) -> str:
        return f"{self.kind}-{self.measure}({self.size},{self.slide})"


@dataclass(frozen=True)
class Session:
    """Maximal runs whose neighbours are at most ``gap`` apart; the result is [first, last + gap)."""

    gap: int
    measure: str = "time"

    def __post_init__(self):
        if self.gap <= 0:
            raise ValueError("gap must be positive")
        if self.measure != "time":
            raise ValueError("sessions are defined over time only")

    kind = "session"

    @property
    def label(self) -> str:
        return f"session-time({self.gap})"


def tumbling(size: int, measure: str = "time") -> Window:
    return Window(size, size, measure)


def sliding(size: int, slide: int, measure: str = "time") -> Window:
    return Window(size, slide, measure)


def session(gap: int) -> Session:
    return Session(gap)


UNITS = {"ms": 1, "s": 1000, "min": 60_000, "h": 3_600_000, "d": 86_400_000}


def millis(n: int, unit: str = "ms") -> int:
    """A length of time in milliseconds."""
    return n * UNITS[unit]


def parse(text: str, seed: int = 10) -> list[Window | Session]:
    """Workload notation, joined by ``+``: Sliding(a,b) in ms; Tumbling(s) and Session(s) in seconds; Count(n);
    randomTumbling(n,min,max), randomSession(n,min,max) in seconds and randomCount(n,min,max)."""
    out: list[Window | Session] = []
    for part in text.replace(" ", "").split("+"):
        m = re.fullmatch(r"([A-Za-z]+)\((\d+(?:,\d+)*)\)", part)
        if not m:
            raise ValueError(f"not a window: {part}")
        name, args = m[1].lower(), [int(x) for x in m[2].split(",")]
        rnd = random.Random(seed)
        if name == "sliding" and len(args) == 2:
            out.append(sliding(*args))
        elif name in ("tumbling", "session", "count") and len(args) == 1:
            out.append({"tumbling": lambda n: tumbling(n * 1000), "session": lambda n: session(n * 1000), "count": lambda n: tumbling(n, "count")}[name](args[0]))
        elif name in ("randomtumbling", "randomsession", "randomcount") and len(args) == 3:
            sizes = [rnd.randint(args[1], args[2]) for _ in range(args[0])]
            out += [tumbling(s, "count") if name == "randomcount" else tumbling(s * 1000) if name == "randomtumbling" else session(s * 1000) for s in sizes]
        else:
            raise ValueError(f"not a window: {part}")
    return out
