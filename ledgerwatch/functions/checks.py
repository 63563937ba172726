"""Checks of arguments, shared by the operators."""

from __future__ import annotations


def require(holds: bool, kind: type[Exception], message: str) -> None:
    if not holds:
        raise kind(message)


def require_count(name: str, value: object, least: int) -> None:
    """A whole number (no truth value) of at least ``least``."""
    require(isinstance(value, int) and not isinstance(value, bool), TypeError, f"{name}: expected a whole number, not {value!r}")
    require(value >= least, ValueError, f"{name}: {value} is below {least}")


def require_number(name: str, value: object, above: float, below: float) -> None:
    """A number between two bounds, neither of them included."""
    require(isinstance(value, (int, float)) and not isinstance(value, bool), TypeError, f"{name}: expected a number, not {value!r}")
    require(above < value < below, ValueError, f"{name}: {value} is not between {above} and {below}")
