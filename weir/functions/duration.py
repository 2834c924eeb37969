"""Durations written as text, e.g. ``10ms``, ``1m30s`` or ``-1.5h``."""

from __future__ import annotations

import re
from decimal import Decimal

# Microseconds per duration unit.
UNIT_MICROS = {
    "ns": Decimal("0.001"),
    "us": Decimal(1),
    "µs": Decimal(1),
    "μs": Decimal(1),
    "ms": Decimal(1_000),
    "s": Decimal(1_000_000),
    "m": Decimal(60_000_000),
    "h": Decimal(3_600_000_000),
}

_TERM = re.compile(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|μs|ms|s|m|h)")


def parse_duration(text: str) -> int:
    """Microseconds in ``text``; a bare ``0`` needs no unit. Raises ValueError on anything else."""
    if not isinstance(text, str):
        raise ValueError(f"a duration is text such as '10s', got {text!r}")
    body = text.strip()
    sign = -1 if body.startswith("-") else 1
    if body[:1] in "+-":
        body = body[1:]
    if body == "0":
        return 0
    total, at = Decimal(0), 0
    for term in _TERM.finditer(body):
        if term.start() != at:
            break
        total += Decimal(term.group(1)) * UNIT_MICROS[term.group(2)]
        at = term.end()
    if at == 0 or at != len(body):
        raise ValueError(f"not a duration: {text!r}")
    return sign * int(total)


def window_micros(text: str) -> int:
    """A duration that may be zero but not negative."""
    micros = parse_duration(text)
    if micros < 0:
        raise ValueError(f"the duration must not be negative: {text!r}")
    return micros


def interval_micros(text: str) -> int:
    """A duration that must be positive."""
    micros = parse_duration(text)
    if micros <= 0:
        raise ValueError(f"the interval must be positive: {text!r}")
    return micros
