"""Rules that say when a window closes.

``closes(n, first_ns, now_ns)`` is asked before each record joins its key's open
window, of which n records and the first one's time are known.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


class Strategy:
    def closes(self, n: int, first_ns: int, now_ns: int) -> bool:
        raise NotImplementedError


@dataclass(frozen=True)
class Count(Strategy):
    """Closes once it holds ``n`` records; with n below 1, each record has its own window."""

    n: int

    def closes(self, n: int, first_ns: int, now_ns: int) -> bool:
        return n >= self.n


@dataclass(frozen=True)
class Time(Strategy):
    """Closes for a record more than ``ns`` later than the window's first. Earlier records never close it."""

    ns: int

    @classmethod
    def of(cls, days: float = 0, hours: float = 0, minutes: float = 0, seconds: float = 0) -> Time:
        return cls(round((((days * 24 + hours) * 60 + minutes) * 60 + seconds) * 1_000_000_000))

    def closes(self, n: int, first_ns: int, now_ns: int) -> bool:
        return now_ns - first_ns > self.ns


@dataclass(frozen=True)
class Never(Strategy):
    """One window for each key."""

    def closes(self, n: int, first_ns: int, now_ns: int) -> bool:
        return False


class AnyOf(Strategy):
    """Closes as soon as one of its rules does; without rules, never."""

    def __init__(self, *rules: Strategy):
        self.rules = rules

    def closes(self, n: int, first_ns: int, now_ns: int) -> bool:
        return any(r.closes(n, first_ns, now_ns) for r in self.rules)


@dataclass(frozen=True)
class Custom(Strategy):
    """A function of count, first time and incoming time."""

    rule: Callable[[int, int, int], bool]

    def closes(self, n: int, first_ns: int, now_ns: int) -> bool:
        return self.rule(n, first_ns, now_ns)
