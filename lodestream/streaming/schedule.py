"""Times at which periodic work is due, by cron lines: minute, hour, day, month, weekday.

Fields are stars, numbers, ranges, lists, and any of these with a step, as in ``*/10``.  Weekdays are 0 to 7, Sunday being both.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

#: First and last value of each field (fixed by the format).
BOUNDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))


def _values(field: str, low: int, high: int) -> frozenset[int]:
    out: set[int] = set()
    for part in field.split(","):
        body, _, step = part.partition("/")
        a, dash, b = body.partition("-")
        first, last = (low, high) if body == "*" else (int(a), int(b) if dash else high if step else int(a))
        if not low <= first <= last <= high:
            raise ValueError(f"{part!r} is not within {low} and {high}")
        out.update(range(first, last + 1, int(step or 1)))
    return frozenset(out)


@dataclass(frozen=True)
class Line:
    fields: tuple[frozenset[int], ...]
    command: str

    @classmethod
    def parse(cls, text: str) -> Line:
        parts = text.split(None, 5)
        if len(parts) < 6:
            raise ValueError(f"five fields and a command are needed: {text!r}")
        return cls(tuple(_values(f, *b) for f, b in zip(parts, BOUNDS, strict=False)), parts[5].strip())

    def due(self, when: datetime) -> bool:
        weekday = when.isoweekday() % 7
        now = (when.minute, when.hour, when.day, when.month)
        return all(v in f for v, f in zip(now, self.fields, strict=False)) and bool({weekday, 7 if weekday == 0 else weekday} & self.fields[4])


def parse_table(text: str) -> list[Line]:
    return [Line.parse(line) for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#")]


def run_due(table: list[Line], when: datetime, commands: dict[str, Callable[[], None]]) -> dict[str, str]:
    """Run what is due, one after the other; a failure is reported and the rest goes on."""
    out = {}
    for line in table:
        if line.due(when):
            try:
                commands[line.command]()
                out[line.command] = "done"
            except Exception as e:  # noqa: BLE001  reported
                out[line.command] = f"failed: {e}"
    return out
